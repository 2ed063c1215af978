"""Code tables of any depth, wrapped files, parents without a code."""

import json

import pytest

from hirelens.session import scratch_path
from hirelens.sources import codes as K


def _file(spark, text):
    path = scratch_path(spark, "code-test")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _flat(spark, nodes):
    rows = K.flatten_code_tree(K.read_code_tree(spark, _file(spark, json.dumps(nodes)))).collect()
    return {r.code: (r.name, r.depth, r.is_leaf) for r in rows}


def test_ten_levels(spark):
    node = {"no": "L9", "des": "level 9"}
    for k in range(8, -1, -1):
        node = {"no": f"L{k}", "des": f"level {k}", "n" if k % 2 else "children": [node]}
    got = _flat(spark, [node])
    assert len(got) == 10 and got["L8.L9"] == ("level 9", 9, True) and got["L8"] == ("level 8", 8, True)


def test_parent_without_code_keeps_its_children(spark):
    got = _flat(spark, [{"des": "x", "children": [{"no": "A1", "des": "a"}, {"no": "A2", "des": "b"}]},
                        {"no": "B", "des": "y", "children": [{"no": "B1", "des": "c"}, {"no": "C", "des": "d"}]}])
    assert {k: v[0] for k, v in got.items()} == {"A1": "a", "A2": "b", "B": "y", "B1": "c", "B.C": "d"}


def test_last_of_equal_codes_wins(spark):
    got = _flat(spark, [{"no": "A", "des": "first"}, {"no": "B", "des": "b", "n": [{"no": "A", "des": "last"}]}])
    assert got["A"] == ("last", 1, True)


def test_wrapped_and_empty_files(spark):
    wrapped = K.load_code_table(spark, _file(spark, '{"data": [{"no": "A1", "des": "a"}]}'), "area")
    assert [tuple(r) for r in wrapped.collect()] == [("A1", "a")]
    for text in ("[]", '{"data": []}', "{}"):
        assert K.load_code_table(spark, _file(spark, text), "area").count() == len(K.BUILTIN["area"])


def _adjacent(spark, nodes):
    return {r.code: tuple(r)[1:] for r in K.flatten_adjacency(nodes).collect()}


def test_adjacency_gives_the_nested_tree(spark):
    nodes = [{"no": "A", "des": "a", "children": [{"no": "A1", "des": "x"}, {"no": "B", "des": "y", "n": [{"no": "Q", "des": "deep"}]}],
              "n": [{"no": "C", "des": "c", "children": [{"no": "D", "des": "d"}, {"no": "", "des": "no code", "n": [{"no": "E", "des": "e"}]}]}]},
             {"des": "no code", "children": [{"no": "B", "des": "other"}]}, {"no": "Q", "des": "last"}, {"no": "Z"}]
    tree = K.read_code_tree(spark, _file(spark, json.dumps(nodes)))
    nested = {r.code: tuple(r)[1:] for r in K.flatten_code_tree(tree).collect()}
    assert _adjacent(spark, K.adjacency_of(tree)) == nested
    assert nested["Q"][0] == "last" and nested["A.B"][0] == "y" and nested["C.D"][0] == "d" and nested["E"][1] == 3


def test_adjacency_of_many_nodes_and_levels(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None, "n" if k else None, 0, f"c{k}", "chain") for k in range(60)]
    wide = [(f"w{k}", "c5", "children", k, f"w{k}", "wide") for k in range(3000)]
    lost = [("l1", "l2", "n", 0, "l1", "a cycle no root leads to"), ("l2", "l1", "n", 0, "l2", "lost"), ("o", "gone", "n", 0, "o", "orphan")]
    got = _adjacent(spark, spark.createDataFrame(chain + wide + lost, K.ADJACENCY))
    assert len(got) == 3060 and got["c59"][1] == 59 and got["c5.w7"][1:5] == (6, True, "c0", True)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_adjacency_deeper_than_allowed_is_an_error(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None, "n", 0, f"c{k}", "chain") for k in range(30)]
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        K.flatten_adjacency(spark.createDataFrame(chain, K.ADJACENCY), max_depth=10)


def test_adjacency_files_and_empty_tables(spark):
    path = scratch_path(spark, "nodes")
    spark.createDataFrame([("1", None, None, 0, "A", "a"), ("2", "1", "children", 0, "B", "b")], K.ADJACENCY).write.json(path)
    assert {tuple(r) for r in K.load_code_table(spark, path, layout="adjacency").collect()} == {("A", "a"), ("A.B", "b")}
    empty = scratch_path(spark, "nodes")
    spark.createDataFrame([], K.ADJACENCY).write.json(empty)
    assert K.load_code_table(spark, empty, "area", layout="adjacency").count() == len(K.BUILTIN["area"])


def test_a_file_of_many_lines_is_one_tree(spark):
    nodes = [{"no": "A", "des": "a", "n": [{"no": "B", "des": "b"}]}]
    tree = K.read_code_tree(spark, _file(spark, json.dumps(nodes, indent=2)))
    assert {r.code for r in K.flatten_code_tree(tree).collect()} == {"A", "B"}
