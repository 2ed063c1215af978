"""The given city and district dimension, and exports by table name."""

import json
import uuid

from hirelens.operators import dimensions as DM
from hirelens.session import scratch_path
from hirelens.sources import io as IO


def given(spark, text, lines=False):
    path = scratch_path(spark, "districts")
    spark.createDataFrame([(t,) for t in ([text] if isinstance(text, str) else text)], "value string").coalesce(1).write.text(path)
    return DM.read_city_districts(spark, path, lines)


def test_a_map_of_lists_is_read_whole(spark):
    text = json.dumps({"B": ["y", "x", "y", None], "A": ["x"], "C": [], "D": None}, indent=1)
    dim = given(spark, text)
    assert sorted(map(tuple, dim.collect()), key=str) == [("A", "x"), ("B", "x"), ("B", "y"), ("C", None), ("D", None)]
    choices = {r.city: r.districts for r in DM.location_choices(dim).collect()}
    assert choices == {"A": ["x"], "B": ["x", "y"], "C": [], "D": [], "全部城市": ["x", "y"]}


def test_maps_per_line_and_none(spark):
    dim = given(spark, ['{"A": ["x"]}', '{"A": ["z"], "B": []}', '{"B": ["q"]}', "{}"], lines=True)
    assert sorted(map(tuple, dim.collect())) == [("A", "x"), ("A", "z"), ("B", "q")]
    assert given(spark, "{}").count() == 0 and DM.location_choices(given(spark, "{}")).count() == 0


def test_unknown_places_are_kept(spark):
    dim = given(spark, '{"A": ["x", "y"], "C": []}')
    rows = [("A", "x"), ("A", "x"), ("A", "new"), ("A", None), ("A", ""), ("U", "x"), ("U", None), (None, "x"), ("", "x")]
    jobs = spark.createDataFrame(rows, "city string, district string")
    got = {(r.city, r.district): (r.known, r.job_count) for r in DM.postings_by_location(jobs, dim).collect()}
    assert got == {("A", "x"): (True, 2), ("A", "y"): (True, 0), ("A", "new"): (False, 1), ("A", None): (True, 2), ("C", None): (True, 0),
                   ("U", "x"): (False, 1), ("U", None): (False, 1)}
    assert DM.postings_by_location(jobs.limit(0), dim).count() == 4


def test_export_by_table_name(spark):
    name = f"t_{uuid.uuid4().hex}"
    rows = [("1", "2001-01-01", "x"), ("2", None, "y"), ("3", "2001-01-03", "z"), ("4", "2001-01-03", "w")]
    path = scratch_path(spark, "recent")
    assert not IO.export_recent_table(spark, name, path)
    spark.createDataFrame(rows, "jobNo string, Updated_At string, crawl_date string").write.option("path", scratch_path(spark, "t")).saveAsTable(name)
    try:
        assert IO.date_like_column(spark, name) == "Updated_At"
        assert IO.export_recent_table(spark, name, path, n=3)
        assert sorted(r.jobNo for r in spark.read.json(path).collect()) == ["1", "3", "4"]
    finally:
        spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([("1", "x"), ("2", "y")], "jobNo string, name string").write.option("path", scratch_path(spark, "t")).saveAsTable(name)
    try:
        assert IO.date_like_column(spark, name) == "jobNo"
        newest = scratch_path(spark, "recent")
        assert IO.export_recent_table(spark, name, newest, n=1) and spark.read.json(newest).first().jobNo == "2"
    finally:
        spark.sql(f"DROP TABLE {name}")
