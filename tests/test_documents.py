"""Filter documents against a plain reading of their rules, row by row; and what reaches the scan."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hirelens.operators import documents as DOC
from hirelens.session import scratch_path

ROWS = [
    ("1", "台北市", 5, 1.5, dt.date(2001, 7, 1), ["a", "b"], ("https://x", None), True, '{"x": 5, "tags": ["p", "q"], "in": {"deep": "v"}}'),
    ("2", None, None, None, None, None, None, None, None),
    ("3", "", 0, -1.0, dt.date(2001, 7, 31), [], (None, "c"), False, '{"x": "5", "tags": "p", "z": null}'),
    ("4", "高雄市", 7, 0.0, dt.date(2001, 8, 2), ["b", None], ("http://y", ""), None, '{"x": 5.5, "in": {"deep": 3}, "flag": true}'),
    ("5", "Ab\ncd", -3, 2.0, dt.date(2002, 1, 1), ["abc"], ("HTTPS://z", "c"), True, '[1, 2]'),
]
SCHEMA = ("jobNo string, city string, n int, score double, day date, tags array<string>, "
          "link struct<job string, cust string>, flag boolean, text string")

FILTERS = [
    ({}, "12345"), (None, "12345"), ({"jobNo": "3"}, "3"), ({"city": None}, "2"), ({"city": {"$ne": None}}, "1345"),
    ({"city": {"$ne": ""}}, "1245"), ({"n": {"$gt": 0}}, "14"), ({"n": {"$gte": 0, "$lt": 7}}, "13"), ({"n": {"$lte": None}}, "2"),
    ({"n": {"$gt": None}}, ""), ({"n": "5"}, ""), ({"city": 5}, ""), ({"city": {"$ne": 5}}, "12345"), ({"flag": 1}, ""),
    ({"flag": True}, "15"), ({"flag": {"$ne": True}}, "234"), ({"n": True}, ""), ({"day": {"$gte": "2001-07-31"}}, "345"),
    ({"day": dt.date(2001, 7, 1)}, "1"), ({"day": "not a day"}, ""), ({"score": {"$in": [1.5, 2, None]}}, "125"),
    ({"n": {"$in": []}}, ""), ({"n": {"$nin": []}}, "12345"), ({"n": {"$nin": [5, 7]}}, "235"), ({"n": {"$nin": [5, None]}}, "345"),
    ({"n": {"$in": [5, "x"]}}, "1"), ({"tags": "b"}, "14"), ({"tags": ["a", "b"]}, "1"), ({"tags": []}, "3"), ({"tags": {"$ne": "b"}}, "235"),
    ({"tags": {"$in": ["a", "abc"]}}, "15"), ({"tags": {"$nin": ["a", "abc"]}}, "234"), ({"tags": {"$all": ["a", "b"]}}, "1"),
    ({"tags": {"$all": []}}, ""), ({"tags": {"$size": 0}}, "3"), ({"tags": {"$not": {"$size": 0}}}, "1245"), ({"city": {"$size": 1}}, ""),
    ({"tags": {"$regex": "^a"}}, "15"), ({"tags": {"$elemMatch": {"$gt": "a", "$lt": "abd"}}}, "5"), ({"tags": {"$elemMatch": {"$ne": "a"}}}, "145"),
    ({"city": {"$elemMatch": {"$gt": "a"}}}, ""), ({"city": {"$regex": "^ab.cd$", "$options": "is"}}, "5"), ({"city": {"$regex": "^cd$", "$options": "m"}}, "5"),
    ({"city": {"$not": {"$regex": "市$"}}}, "235"), ({"n": {"$regex": "5"}}, ""), ({"link.job": {"$regex": "^https", "$options": "i"}}, "15"),
    ({"link.cust": None}, "12"), ({"link.cust": {"$exists": True}}, "345"), ({"link": None}, "2"), ({"nothing": None}, "12345"),
    ({"nothing": {"$exists": True}}, ""), ({"nothing": {"$ne": 3}}, "12345"), ({"nothing": {"$gt": 3}}, ""), ({"link.none": {"$exists": False}}, "12345"),
    ({"$or": [{"n": 5}, {"city": ""}]}, "13"), ({"$and": [{"n": {"$gt": -5}}, {"flag": True}], "jobNo": {"$ne": "1"}}, "5"),
    ({"$nor": [{"n": {"$gt": 0}}, {"city": ""}]}, "25"), ({"$nor": [{"$or": [{"n": 0}, {"$nor": [{"flag": True}]}]}]}, "15"),
    ({"n": {"$not": {"$gte": 0, "$lt": 6}}}, "245"),
    # fields inside the VARIANT column
    ({"x": 5}, "1"), ({"x": "5"}, "3"), ({"x": {"$gt": 5}}, "4"), ({"doc.x": {"$in": [5, "5"]}}, "13"), ({"x": {"$ne": 5}}, "2345"),
    ({"doc.tags": "p"}, "13"), ({"in.deep": "v"}, "1"), ({"in.deep": 3}, "4"), ({"in.deep": {"$exists": False}}, "235"), ({"z": {"$exists": True}}, "3"),
    ({"z": None}, "12345"), ({"doc.flag": True}, "4"), ({"x": {"$regex": "5"}}, "3"), ({"doc.tags": {"$size": 2}}, "1"),
]


@pytest.fixture(scope="module")
def rows(spark):
    path = scratch_path(spark, "find")
    spark.createDataFrame(ROWS, SCHEMA).withColumn("doc", F.parse_json("text")).drop("text").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("document,expected", FILTERS, ids=[str(d)[:60] for d, _ in FILTERS])
def test_filter_documents(rows, document, expected):
    own = rows.drop("tags", "flag") if document and any(k.startswith("doc.") for k in document) else rows
    assert "".join(sorted(r.jobNo for r in DOC.find(own, document).select("jobNo").collect())) == expected


def test_double_negation_is_the_condition(rows):
    for document, _ in FILTERS:
        if document and not any(k.startswith(("$", "doc.")) for k in document):
            once = DOC.find(rows, document).count()
            assert DOC.find(rows, {"$nor": [{"$nor": [document]}]}).count() == once
            assert DOC.find(rows, {"$nor": [document]}).count() == len(ROWS) - once


@pytest.mark.parametrize("document", [{"$xor": []}, {"n": {"$near": 1}}, {"$or": []}, {"city": {"$regex": "a", "$options": "q"}}, {"city": {"$options": "i"}}])
def test_unknown_operators_are_errors(rows, document):
    with pytest.raises(ValueError):
        DOC.find(rows, document)


@pytest.mark.parametrize("document,pushed", [
    ({"city": "x"}, "EqualTo(city,x)"), ({"day": {"$gte": "2001-07-30"}, "n": {"$lt": 4}}, "GreaterThanOrEqual(day,2001-07-30)"),
    ({"$and": [{"n": {"$in": [1, 2]}}]}, "In(n, [1,2])"), ({"$or": [{"n": 1}, {"city": "x"}]}, "Or(EqualTo(n,1),EqualTo(city,x))"),
    ({"city": {"$exists": False}}, "IsNull(city)"), ({"n": {"$nin": [3, 4]}}, "Or(IsNull(n),Not(In(n, [3,4])))"), ({"n": {"$ne": 3}}, "Or(IsNull(n),Not(EqualTo(n,3)))"),
])
def test_conditions_reach_the_scan(rows, document, pushed):
    plan = DOC.find(rows, document).select("jobNo")._jdf.queryExecution().executedPlan().toString()
    assert pushed in re.search(r"PushedFilters: \[.*?\], ReadSchema", plan).group(0), plan


def test_limit_and_empty(spark, rows):
    assert DOC.find(rows, {"n": {"$ne": 100}}, limit=2).count() == 2
    assert DOC.find(rows.limit(0), {"$or": [{"n": 1}, {"tags": "a"}]}).count() == 0
