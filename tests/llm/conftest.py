import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

PASSAGE = " ".join(f"shared{k} passage{k % 7}" for k in range(60))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, copies, near copies, extra columns with clashing names."""
    plain = " ".join(f"w{k}x" for k in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, plain), (5, plain), (6, plain + " more"), (7, plain[:300]),
            (8, "a b c"), (9, "A b C"), (10, "one"), (11, "Éé ß² ½ don't we'll  x\n\ny <|endoftext|>"),
            (12, "head12 " + PASSAGE + " tail12"), (13, "x " * 3 + PASSAGE + " other13 end"), (14, "z" * 3000),
            (15, " ".join(f"long{k % 977} run{k % 31}" for k in range(20_000))), (16, "\n".join(["line one"] * 5)),
            (17, plain), (17, plain), (None, "no id here"), (None, None), (18, "crossing " + "é" * 500),
            (19, "other " + "é" * 500)]
    data = [(i, t, "en" if i != 4 else None, f"src{(i or 0) % 12}" if i != 5 else None, None if t is None else len(t),
             "clash", 1, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "key string, n int, row string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
