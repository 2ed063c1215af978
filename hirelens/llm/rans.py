"""Token-id files coded with a static range asymmetric numeral system.

All files of a folder share one frequency table, counted over all ids and
scaled to 2**SCALE_BITS.  A file is a sequence of independent blocks; each block
codes up to BLOCK ids on LANES interleaved lanes (id k is on lane k % LANES, at
step k // LANES) with 64-bit states renormalised by 32-bit words.  Every SEGMENT
steps a block holds a checkpoint (all states and the place in its word stream),
so that segments decode in parallel, here as columns of numpy arrays.

File: MAGIC, blocks, index, trailer.  A block: segments' states (uint64),
segments' word offsets (uint32), words (uint32).  The index: block table (offset,
bytes, ids, words, crc32 of the block, crc32 of its ids), document table (id,
null flag, number of ids).  The trailer: offset and crc32 of the index, crc32 of
the frequency table, MAGIC.  All numbers are little-endian.

Files hold documents in ascending doc_id order (nulls first) and follow each
other in that order; rows with the same doc_id stay separate.  A null text is
empty and gives the end id alone.  An empty table gives no files and no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.llm.common import cut, scratch_path, slices, to_batch
from hirelens.llm.files import open_file, write_file
from hirelens.llm.tokens import encoder

MAGIC = b"RANSIDS1"
SCALE_BITS = 18
LANES = 64
SEGMENT = 256
BLOCK = 1 << 16
LOW = 1 << 31
BATCH_BLOCKS = 16
FILE_BYTES = 16_000_000


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for each id that occurs."""
    total = 1 << SCALE_BITS
    used = np.flatnonzero(counts)
    if len(used) > total:
        raise ValueError("more distinct ids than the scale has slots")
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        freq[0] = total
        return freq
    spare = total - len(used)
    freq[used] = 1 + (counts[used].astype(object) * spare // int(counts.sum())).astype(np.int64)
    left = total - int(freq.sum())
    order = used[np.lexsort((used, -counts[used]))]
    freq[order[:left]] += 1
    return freq


class Table:
    """Frequencies, their running sums and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> Iterator[tuple[bytes, int, int, int]]:
    """(block, ids, words, crc32 of the ids) for each BLOCK ids; up to BATCH_BLOCKS are coded side by side."""
    scale, half = np.uint64(SCALE_BITS), np.uint64(32)
    whole = len(ids) - len(ids) % BLOCK
    cuts = [*range(0, whole, BLOCK * BATCH_BLOCKS), whole, len(ids)]
    for at, end in zip(cuts, cuts[1:]):  # the last, shorter block by itself
        some = ids[at:end]
        if not len(some):
            continue
        n = -(-len(some) // BLOCK)
        used = min(-(-len(some) // LANES), BLOCK // LANES)
        grid = np.full(n * used * LANES, np.argmax(table.freq), np.uint32)
        grid[:len(some)] = some
        grid = grid.reshape(n, used, LANES)
        x = np.full((n, LANES), LOW, np.uint64)
        words = np.empty((used, n, LANES), np.uint32)
        emitted = np.empty((used, n, LANES), bool)
        states = np.empty((-(-used // SEGMENT), n, LANES), np.uint64)
        for t in range(used - 1, -1, -1):
            sym = grid[:, t, :]
            f = table.freq[sym]
            out = x >= f << np.uint64(63 - SCALE_BITS)
            words[t] = x.astype(np.uint32)
            emitted[t] = out
            x = np.where(out, x >> half, x)
            q = x // f
            x = (q << scale) + (x - q * f) + table.start[sym]
            if t % SEGMENT == 0:
                states[t // SEGMENT] = x
        for b in range(n):
            own = some[b * BLOCK:(b + 1) * BLOCK]
            mask = emitted[:, b, :]
            stream = words[:, b, :][mask]
            upto = np.concatenate([[0], np.cumsum(mask.sum(1))])[0:used:SEGMENT]
            block = states[:, b, :].astype("<u8").tobytes() + upto.astype("<u4").tobytes() \
                + stream.astype("<u4").tobytes()
            yield block, len(own), len(stream), zlib.crc32(own.astype("<u4").tobytes())


def decode_blocks(blocks: list[tuple[bytes, int, int, int]], table: Table) -> list[np.ndarray]:
    """Inverse of ``encode_blocks`` for (block, ids, words, crc32 of the ids); all segments run side by side."""
    states, places, streams, sizes, base = [], [], [], [], 0
    for raw, n_ids, n_words, _ in blocks:
        segments = -(-(-(-n_ids // LANES)) // SEGMENT)
        head = segments * LANES * 8
        states.append(np.frombuffer(raw, "<u8", segments * LANES).reshape(segments, LANES))
        places.append(np.frombuffer(raw, "<u4", segments, head).astype(np.int64) + base)
        streams.append(np.frombuffer(raw, "<u4", n_words, head + 4 * segments))
        sizes.append(segments)
        base += n_words
    x = np.concatenate(states).astype(np.uint64)
    place = np.concatenate(places)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    out = np.empty((len(x), SEGMENT, LANES), np.uint32)
    mask, scale, half, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LOW)
    for t in range(SEGMENT):
        slot = x & mask
        sym = table.slot[slot]
        out[:, t, :] = sym
        x = table.freq[sym] * (x >> scale) + slot - table.start[sym]
        need = x < low
        rank = np.cumsum(need, 1)
        at = np.minimum(place[:, None] + rank - 1, len(stream) - 1)
        x = np.where(need, x << half | stream[np.maximum(at, 0)], x)
        place += rank[:, -1]
    found, at = [], 0
    for (_, n_ids, _, crc), segments in zip(blocks, sizes, strict=True):
        ids = out[at:at + segments].reshape(-1)[:n_ids]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids don't have the checksum they were written with")
        found.append(ids)
        at += segments
    return found


_ENTRY = struct.Struct("<QIIIII")  # offset, bytes, ids, words, crc32 of the block, crc32 of its ids
_TRAILER = struct.Struct("<QII8s")


def file_parts(docs: list[tuple[int | None, bytes]], table: Table) -> Iterator[bytes]:
    """The bytes of one file for (doc_id, ids)."""
    ids = np.frombuffer(b"".join(raw for _, raw in docs), "<u4")
    entries, at = [], len(MAGIC)
    yield MAGIC
    for block, n_ids, n_words, crc in encode_blocks(ids, table):
        entries.append(_ENTRY.pack(at, len(block), n_ids, n_words, zlib.crc32(block), crc))
        at += len(block)
        yield block
    index = struct.pack("<II", len(entries), len(docs)) + b"".join(entries) \
        + np.array([d or 0 for d, _ in docs], "<i8").tobytes() \
        + np.array([d is None for d, _ in docs], "u1").tobytes() \
        + np.array([len(raw) // 4 for _, raw in docs], "<u8").tobytes()
    yield index
    yield _TRAILER.pack(at, zlib.crc32(index), table.crc, MAGIC)


def read_index(f, table: Table) -> tuple[list[tuple], list[int | None], np.ndarray]:
    """Block entries, document ids and their numbers of ids."""
    size = f.size()
    at, crc, table_crc, magic = _TRAILER.unpack(f.read_at(_TRAILER.size, size - _TRAILER.size))
    if magic != MAGIC or table_crc != table.crc:
        raise ValueError("not a file of this folder's frequency table")
    index = f.read_at(size - _TRAILER.size - at, at)
    if zlib.crc32(index) != crc:
        raise ValueError("the index doesn't have the checksum it was written with")
    n_blocks, n_docs = struct.unpack_from("<II", index)
    rest = 8 + n_blocks * _ENTRY.size
    entries = [_ENTRY.unpack_from(index, 8 + k * _ENTRY.size) for k in range(n_blocks)]
    doc_ids = np.frombuffer(index, "<i8", n_docs, rest).tolist()
    nulls = np.frombuffer(index, "u1", n_docs, rest + 8 * n_docs)
    counts = np.frombuffer(index, "<u8", n_docs, rest + 9 * n_docs).astype(np.int64)
    return entries, [None if z else d for d, z in zip(doc_ids, nulls, strict=True)], counts


def read_blocks(f, entries: list[tuple], table: Table) -> list[np.ndarray]:
    """Ids of any run of blocks; nothing before them is read."""
    blocks = []
    for at, size, n_ids, n_words, crc, ids_crc in entries:
        raw = f.read_at(size, at)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block doesn't have the checksum it was written with")
        blocks.append((raw, n_ids, n_words, ids_crc))
    return decode_blocks(blocks, table)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """run, seq, doc_id, ids: documents in ascending order of (run, seq), with their end id."""
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("run", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", 4_000_000):
                ids = []
                for text in some["text"].to_pylist():
                    raw = np.frombuffer(enc.encode(text) + end, "<u4")
                    ids.append(raw.astype("<u2").tobytes() if raw.max() < 1 << 16 else b"\0" + raw.tobytes())
                yield to_batch(schema, [[part] * len(ids), list(range(seq, seq + len(ids))),
                                        some["doc_id"].to_pylist(), ids])
                seq += len(ids)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.repartitionByRange("doc_id").sortWithinPartitions("doc_id") \
        .mapInArrow(run, "run int, seq long, doc_id long, ids binary")


def _wide(ids: bytes) -> bytes:
    """Stored ids (16 bits each, or a zero byte and 32 bits each) as little-endian uint32."""
    return ids[1:] if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _histogram(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for some in slices(batch, "ids", 4_000_000):
                ids = np.frombuffer(b"".join(map(_wide, some["ids"].to_pylist())), "<u4")
                more = np.bincount(ids, minlength=len(counts))
                more[:len(counts)] += counts
                counts = more
        used = np.flatnonzero(counts)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files of ``folder``; returns its stored manifest.

    Manifest: path, run, seq (place of the first document), docs, ids.  The
    frequency table has a row per id of the vocabulary, a fixed bound.
    """
    tokens = cut(tokenised(docs, tokenizer, end_id), "rans-tokens", compression="zstd")
    counted = _histogram(tokens).collect()
    counts = np.zeros(max([r.id for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    freq = scaled(counts)
    schema = pa.schema([("path", pa.string()), ("run", pa.int32()), ("seq", pa.int64()), ("docs", pa.int64()),
                        ("ids", pa.int64())])

    def flush(table, run, seq, held):
        path = write_file(folder, f"ids-{run:06d}-{seq:012d}", ".rans", file_parts(held, table))
        return to_batch(schema, [[path], [run], [seq], [len(held)], [sum(len(raw) for _, raw in held) // 4]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, first, follows = Table(freq), [], 0, None, None
        for batch in batches:
            for some in slices(batch, "ids", 4_000_000):
                for run, seq, doc, ids in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if held and ((run, seq) != follows or size >= FILE_BYTES):
                        yield flush(table, *first, held)
                        held, size = [], 0
                    if not held:
                        first = (run, seq)
                    held.append((doc, _wide(ids)))
                    size += len(held[-1][1]) // 4
                    follows = (run, seq + 1)
        if held:
            yield flush(table, *first, held)

    manifest = tokens.mapInArrow(write, "path string, run int, seq long, docs long, ids long")
    write_file(folder, "frequencies", ".u4", [freq.astype("<u4").tobytes()])
    docs.sparkSession.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "freq binary") \
        .write.parquet(f"{folder}/frequencies.parquet")
    return cut(manifest, "rans-manifest")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, a task for each run of files."""
    freq = np.frombuffer(bytes(spark.read.parquet(f"{folder}/frequencies.parquet").first().freq), "<u4")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq.astype(np.int64))
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with open_file(path) as f:
                    entries, doc_ids, counts = read_index(f, table)
                    crcs, lengths, k, crc, need = [], counts.tolist(), 0, 0, None
                    for at in range(0, len(entries), BATCH_BLOCKS):
                        ids = np.concatenate(read_blocks(f, entries[at:at + BATCH_BLOCKS], table)).astype("<u4")
                        pos = 0
                        while pos < len(ids):
                            need = lengths[k] if need is None else need
                            some = ids[pos:pos + need]
                            crc = zlib.crc32(some.tobytes(), crc)
                            pos, need = pos + len(some), need - len(some)
                            if not need:
                                crcs.append(crc)
                                k, crc, need = k + 1, 0, None
                starts = start + np.cumsum(counts) - counts
                yield to_batch(schema, [doc_ids, starts.tolist(), lengths, crcs])

    before = Window.orderBy("run", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "start")
    tasks = max(1, min(manifest.count(), 4096))  # without a number, so few rows would go to one task
    return files.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    folder = scratch_path(spark, "rans-files")
    manifest = write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, folder, manifest)
