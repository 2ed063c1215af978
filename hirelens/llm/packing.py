"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

A document's ids are cut into pieces of ``capacity`` tokens (only longer ones
are cut; the last piece may be shorter).  A full piece is a sequence of its
own.  The other pieces are items: every task packs its items best-fit
decreasing, emits bins that are nearly full, and hands on underfull bins as
items of the next round, dealt to fewer tasks, until one task holds the rest
or a round no longer joins anything.  A task gets at most about
``items_per_task`` items, so no task grows with the input.

An item holds its pieces in order; it has at most ``capacity`` of them.

Nulls: a null text is empty and gives one piece with the end id alone; a null
doc_id stays null.  Repeated rows are packed as often as they come.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import cut, slices, to_batch
from hirelens.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBERS = f"array<struct<{', '.join(f'{n}:{t}' for n, t in (f.split() for f in PIECE.split(', ')))}>>"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each row of (doc_id, text)."""
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = enc.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(own) // 4, zlib.crc32(own)))
                yield to_batch(schema, list(zip(*rows, strict=True)) or [[]] * 5)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices; ``sizes`` must not rise.  The fullest bin that still has room gets the item."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has r tokens of room
    for i, size in enumerate(sizes):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            by_room[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins


def _round(items: DataFrame, capacity: int, least: int) -> DataFrame:
    """Best fit within each task; ``done``: filled to ``least`` at least."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                               ("length", pa.int32()), ("ids_crc32", pa.int64())]))
    schema = pa.schema([("size", pa.int32()), ("members", kind), ("done", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held).combine_chunks()
        first = pc.list_element(items["members"], 0).combine_chunks()
        keys = pa.table({"size": items["size"], "doc": pc.struct_field(first, "doc_id"),
                         "piece": pc.struct_field(first, "piece")})
        order = pc.sort_indices(keys, [("size", "descending"), ("doc", "ascending"), ("piece", "ascending")])
        items = items.take(order)
        sizes = items["size"].to_pylist()
        members = items["members"].combine_chunks()
        members = members.combine_chunks() if isinstance(members, pa.ChunkedArray) else members
        starts = members.offsets.to_pylist()
        bins = best_fit(sizes, capacity)
        totals = [sum(sizes[i] for i in b) for b in bins]
        for at in range(0, len(bins), 20_000):
            some = bins[at:at + 20_000]
            take, offsets = [], [0]
            for b in some:
                for i in b:
                    take.extend(range(starts[i], starts[i + 1]))
                offsets.append(len(take))
            own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                           members.values.take(pa.array(take, pa.int64())).cast(kind.value_type))
            yield to_batch(schema, [totals[at:at + 20_000], own.cast(kind),
                                    [t >= least for t in totals[at:at + 20_000]]])

    return items.mapInArrow(run, f"size int, members {MEMBERS}, done boolean")


def pack(pieces: DataFrame, capacity: int = 2048, nearly: float = 0.998, items_per_task: int = 100_000) -> DataFrame:
    """pieces plus sequence_id and offset.  ``pieces`` must be a stored table."""
    whole = F.col("length") == capacity
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    done = [pieces.where(whole).select(F.array(item).alias("members"))]
    items = pieces.where(~whole).select(F.col("length").alias("size"), F.array(item).alias("members"))
    least, before, last = int(nearly * capacity), None, False
    while True:
        packed = cut(_round(items, capacity, least), "pack-round")
        if last:
            done.append(packed.select("members"))
            break
        done.append(packed.where("done").select("members"))
        items = packed.where("not done").select("size", "members")
        left = items.count()
        tasks = -(-left // items_per_task)
        last = tasks <= 1 or before is not None and left > 0.95 * before
        before = left
        items = items.repartition(max(tasks, 1))
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    bins = cut(bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members"), "pack-bins")
    ends = F.aggregate("members", F.array(F.lit(0).cast("long")),
                       lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + m["length"])))
    return bins.select("sequence_id", ends.alias("ends"), F.posexplode("members").alias("k", "m")) \
        .select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32",
                "sequence_id", F.col("ends")[F.col("k")].alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack(cut(token_pieces(docs, tokenizer, end_id, capacity), "pack-pieces"), capacity)


def op8_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
