"""Dimensions: keyword choices (O10), and districts (U4) as postings show them or as a given file lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keyword_choices(jobs: DataFrame) -> DataFrame:
    """Distinct keywords over all postings (one column ``keyword``)."""
    return jobs.select(F.explode("search_keyword").alias("keyword")).where(F.col("keyword").isNotNull()).distinct()


def keyword_suggest(choices: DataFrame, typed: str, n: int = 5) -> DataFrame:
    """Suggestions for the keyword being typed (text after the last comma):
    case-insensitive prefix match, first ``n`` in keyword order.
    """
    if not typed or typed.endswith(","):
        return choices.limit(0)
    current = typed.split(",")[-1].strip().lower()
    if not current:
        return choices.limit(0)
    return (choices.where(F.lower("keyword").startswith(current))
            .orderBy("keyword").limit(n))


def districts_from_postings(jobs: DataFrame) -> DataFrame:
    """(city, district) dimension observed in the postings (empty parts dropped)."""
    return (jobs.where(F.col("city").isNotNull() & (F.col("city") != "")
                       & F.col("district").isNotNull() & (F.col("district") != ""))
            .select("city", "district").distinct())


def districts_by_city(dim: DataFrame) -> DataFrame:
    """U4: per city the sorted district list (bounded by districts per city)."""
    return dim.groupBy("city").agg(F.array_sort(F.collect_set("district")).alias("districts"))


def all_districts(dim: DataFrame) -> DataFrame:
    """U4: union of districts over all cities, deduplicated, sorted."""
    return dim.select("district").distinct().orderBy("district")


ALL_CITIES = "全部城市"  # fixed value: the choice that stands for every city


def read_city_districts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """U4: (city, district) of JSON objects that map a city to its list of districts.

    ``lines``: an object per line instead of one per file.  A district named
    several times comes once; a city without districts comes with a null one;
    null names are dropped.
    """
    text = spark.read.text(path, wholetext=not lines)
    cities = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("city", "list"))
    known = F.filter(F.coalesce("list", F.array().cast("array<string>")), lambda d: d.isNotNull())
    pairs = cities.select("city", F.explode_outer(known).alias("district")).distinct()
    # a city that also comes with districts doesn't need its empty row
    some = pairs.where(F.col("district").isNotNull()).select("city").distinct()
    return pairs.where(F.col("district").isNotNull()).unionByName(
        pairs.where(F.col("district").isNull()).join(some, "city", "left_anti"))


def location_choices(dim: DataFrame) -> DataFrame:
    """U4: per city its sorted districts, and the entry for all cities with the districts of all."""
    both = dim.select(F.explode(F.array(F.col("city"), F.lit(ALL_CITIES))).alias("city"), "district")
    return districts_by_city(both)


def postings_by_location(jobs: DataFrame, dim: DataFrame) -> DataFrame:
    """(city, district, known, job_count): postings of every place of the dimension (0 too) and of places it lacks.

    Postings without a city are left out; one without a district counts for its
    city alone (null district), which is known if the dimension has the city.
    """
    found = jobs.where(F.col("city").isNotNull() & (F.col("city") != "")).groupBy(
        "city", F.when(F.col("district") != "", F.col("district")).alias("district")).agg(F.count(F.lit(1)).alias("n"))
    places = dim.select("city", "district").unionByName(dim.select("city", F.lit(None).cast("string").alias("district"))).distinct()
    p, f = places.alias("p"), found.alias("f")
    same = (F.col("p.city") == F.col("f.city")) & F.col("p.district").eqNullSafe(F.col("f.district"))
    return p.join(f, same, "full_outer").select(
        F.coalesce("p.city", "f.city").alias("city"), F.coalesce("p.district", "f.district").alias("district"),
        F.col("p.city").isNotNull().alias("known"), F.coalesce("f.n", F.lit(0).cast("long")).alias("job_count"))
