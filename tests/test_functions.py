"""Hand-computed unit rows for the column functions (FIXTURES part C)."""

import pytest
from pyspark.sql import functions as F

from hirelens.functions import parsing as P


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("desc,expected", [
    ("0~5人應徵", (0, 5, 2.5)), ("11~30人應徵", (11, 30, 20.5)), ("7人應徵", (7, 7, 7.0)),
    ("大於30人應徵", (0, 0, 0.0)), (None, (0, 0, 0.0)), ("", (0, 0, 0.0)), ("很多", (0, 0, 0.0)),
])
def test_applicant_range(spark, desc, expected):
    r = one(spark, P.applicant_range, desc)
    assert (r["min"], r["max"], r["avg"]) == expected


@pytest.mark.parametrize("desc,expected", [
    ("月薪40,000~60,000元", (40000, 60000, 50000.0)), ("月薪50,000元", (50000, 50000, 50000.0)),
    ("時薪200元", (32000, 32000, 32000.0)), ("時薪200~300元", (0, 0, 0.0)), ("月薪40,000元以上", (0, 0, 0.0)),
    ("月薪1~2~3元", (0, 0, 0.0)), ("待遇面議", (0, 0, 0.0)), (None, (0, 0, 0.0)),
])
def test_salary_range(spark, desc, expected):
    r = one(spark, P.salary_range, desc)
    assert (r["min"], r["max"], r["avg"]) == expected


@pytest.mark.parametrize("addr,city,district", [
    ("台北市大安區", "台北市", "大安區"), ("新竹縣竹北市", "新竹縣", "竹北市"), ("新竹市", "新竹市", ""),
    ("日本", "", "日本"), ("台北市大安區信義路", "", "台北市大安區信義路"), (None, None, None),
])
def test_split_city_district(spark, addr, city, district):
    assert one(spark, P.split_city, addr) == city
    assert one(spark, P.split_district, addr) == district


@pytest.mark.parametrize("url,expected", [("//x", "https://x"), ("http://x", "http://x"), ("", "")])
def test_ensure_https(spark, url, expected):
    assert one(spark, P.ensure_https, url) == expected


@pytest.mark.parametrize("first,growth,label", [
    (0, 3, "首次出現"), (0, 0, "0%"), (3, 1, "33.33%"), (2, -2, "-100.0%"), (8, 1, "12.5%"), (1, 123456, "12345600.0%"),
])
def test_growth_label(spark, first, growth, label):
    df = spark.createDataFrame([(first, growth)], "f long, g long")
    assert df.select(P.growth_label("f", "g").alias("r")).first()["r"] == label


def test_link_string(spark):
    s = "{'applyAnalyze': //a.tw/x?c=1, 'job': //a.tw/job/5, 'cust': //a.tw/c/9}"
    r = one(spark, P.link_urls_from_string, s)
    assert (r["applyAnalyze"], r["job"], r["cust"]) == ("https://a.tw/x?c=1", "https://a.tw/job/5", "https://a.tw/c/9")


def test_search_url(spark):
    df = spark.createDataFrame([("c++ dev~*",)], "k string")
    url = df.select(P.search_url(F.col("k"), F.lit(2), F.lit("6001001000")).alias("u")).first()["u"]
    assert url == ("https://www.104.com.tw/jobs/search/list?keyword=c%2B%2B+dev~%2A&page=2&area=6001001000"
                   "&industry=&jobCat=&exp=&edu=&mode=s&jobsource=index")


def test_parse_keyword_list(spark):
    assert one(spark, P.parse_keyword_list, " python, django,, ") == ["python", "django"]


def test_applicant_open_ended_option(spark):
    df = spark.createDataFrame([("大於30人應徵",)], "x string")
    parity = df.select(P.applicant_range("x").alias("r")).first()["r"]
    opened = df.select(P.applicant_range("x", open_ended=True).alias("r")).first()["r"]
    assert (parity["min"], parity["max"]) == (0, 0)
    assert (opened["min"], opened["max"], opened["avg"]) == (30, 30, 30.0)


def test_with_city_district_matches_column_functions(spark):
    addrs = ["台北市大安區", "新竹縣竹北市", "新竹市", "日本", "台北市大安區信義路", "", None, "高雄市鳳山區"]
    df = spark.createDataFrame([(a,) for a in addrs], "a string")
    staged = P.with_city_district(df, "a").collect()
    direct = df.select("a", P.split_city("a").alias("city"), P.split_district("a").alias("district")).collect()
    assert [tuple(r) for r in staged] == [tuple(r) for r in direct]
