"""op10 by its contract: of passages of 51 words that two documents share, those of 400 bytes or more go, whole and alone."""

import hashlib
import random

import pytest

from hirelens.llm import suffix_index


def passage(rng, n_bytes, n_words=51):
    letters = rng.choices("abcdefghijklmnopqrstuvwxyz", k=n_bytes)
    for k in range(1, n_words):
        letters[k * n_bytes // n_words] = " "
    return "".join(letters)


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows = random.Random(10), []
    for k, size in enumerate((300, 399, 400, 401, 640)):
        shared = passage(rng, size)
        assert len(shared.split()) == 51 and len(shared) == size
        for copy, (a, z) in enumerate((("<", ">"), ("[", "]"))):  # other bytes on either side: no longer string is shared
            left, right = passage(rng, 500), passage(rng, 700)
            rows.append((2 * k + copy, left + a + shared + z + right, size, left + a + z + right))
    clean = [passage(rng, size) for size in (450, 900, 1600)]
    rows += [(100 + k, text, 0, text) for k, text in enumerate(clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, {r.doc_id: r for r in suffix_index.op10_query(docs).collect()}


def test_passages_of_400_bytes_go_and_nothing_else(planted):
    rows, got = planted
    for doc_id, text, size, without in rows:
        kept = without if size >= 400 else text
        assert (got[doc_id].n_removed, got[doc_id].n_spans) == ((size, 1) if size >= 400 else (0, 0))
        assert got[doc_id].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_n_bytes_is_the_length_whatever_goes(planted):
    rows, got = planted
    assert [got[doc_id].n_bytes for doc_id, *_ in rows] == [len(text) for _, text, *_ in rows]
