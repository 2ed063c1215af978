"""R2–R5 as one frame each: all counts of a report from one scan and one GROUPING SETS aggregation.

Rows are ``(output, key, key2, n, n2, value, value2)``; each report's docstring
says what they mean for its outputs.  What follows the aggregation (running
totals, ranks, shares, bins) are windows over the aggregated rows, whose number
is bounded by days, labels and places, not by postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions import parsing as P
from hirelens.functions.literals import literal_frame
from hirelens.operators.filters import analysis_projection
from hirelens.operators.trends import with_dates

COLUMNS = ["output", "key", "key2", "n", "n2", "value", "value2"]
KINDS = dict(zip(COLUMNS, ["string", "string", "string", "bigint", "bigint", "double", "double"], strict=True))


def _row(output: str | Column, **values: Column) -> Column:
    """A report row as a struct; fields that aren't given are null."""
    fields = {"output": F.lit(output) if isinstance(output, str) else output} | values
    return F.struct(*[(fields[c] if c in fields else F.lit(None)).cast(KINDS[c]).alias(c) for c in COLUMNS])


def _only(holds: Column, row: Column) -> Column:
    return F.when(holds, row)


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    """Each row of ``df`` as the report rows that are not null."""
    return df.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")


def _sets(df: DataFrame, columns: list[str], sets: dict[str, list[str]], *aggregates: Column) -> DataFrame:
    """GROUPING SETS with the set's name as ``set``; a column outside a row's set is null."""
    bits = {name: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in used) for name, used in sets.items()}
    grouped = df.groupingSets([[F.col(c) for c in used] for used in sets.values()], *columns) \
        .agg(F.grouping_id().alias("_set"), *aggregates)
    name = None
    for label, bit in bits.items():
        name = F.when(F.col("_set") == bit, label) if name is None else name.when(F.col("_set") == bit, label)
    return grouped.withColumn("set", name).drop("_set")


def daily_changes(jobs: DataFrame) -> DataFrame:
    """R2.  ``day``: n new, n2 removed, value postings so far, value2 change of new postings since the day before,
    for every day from the first appearance on.  ``month``: n new, n2 removed, value the best day's new postings.
    """
    both = F.array(F.struct(F.col("appear_dt").alias("date"), F.lit(1).alias("new"), F.lit(0).alias("gone")),
                   F.struct(F.col("delisted_dt").alias("date"), F.lit(0).alias("new"), F.lit(1).alias("gone")))
    events = with_dates(jobs).select(F.explode(both).alias("e")).where(F.col("e.date").isNotNull()).select(
        "e.*", P.month_label(F.col("e.date")).alias("month"))
    counts = _sets(events, ["date", "month"], {"day": ["date", "month"], "month": ["month"]},
                   F.sum("new").alias("new"), F.sum("gone").alias("gone"))
    w = Window.partitionBy("set").orderBy("date", "month")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_day = F.col("set") == "day"
    spans = counts.select("*", F.min(F.when(F.col("new") > 0, F.col("date"))).over(whole).alias("first"),
                          F.max(F.when(is_day, F.col("new"))).over(Window.partitionBy("month")).alias("best"),
                          F.when(is_day, F.lead("date").over(w)).alias("next"))
    filled = spans.select("*", F.explode(F.when(is_day, F.sequence("date", F.coalesce(F.date_sub("next", 1), "date")))
                                         .otherwise(F.array(F.lit(None).cast("date")))).alias("day"))
    absent = is_day & (F.col("day") != F.col("date"))
    filled = filled.where(~is_day | (F.col("day") >= F.col("first"))).select(
        "set", "day", "month", "best", *[F.when(absent, 0).otherwise(F.col(c)).alias(c) for c in ("new", "gone")])
    days = Window.partitionBy("set").orderBy("day", "month")
    total = F.sum(F.col("new") - F.col("gone")).over(days.rowsBetween(Window.unboundedPreceding, 0))
    series = filled.select("*", total.alias("total"), (F.col("new") - F.lag("new").over(days)).alias("step"))
    return _rows(series,
                 _only(is_day, _row("day", key=F.col("day"), n=F.col("new"), n2=F.col("gone"), value=F.col("total"), value2=F.col("step"))),
                 _only(~is_day, _row("month", key=F.col("month"), n=F.col("new"), n2=F.col("gone"), value=F.col("best"))))


def industry_trends(jobs: DataFrame, top: int = 5) -> DataFrame:
    """R3.  ``industry``: n postings, n2 companies, value share of all postings in %.  ``industry_month``: key2 the
    month, n postings, n2 the industry's rank in the last month if among the ``top``.  ``growth``: n postings of the
    first month, n2 of the last, value growth in %.
    """
    rows = jobs.select(F.col("coIndustryDesc").alias("industry"), P.month_label(F.to_date("appearDate", "yyyyMMdd")).alias("month"),
                       F.col("custName").alias("company"), "jobNo")
    counts = _sets(rows, ["industry", "month", "company"],
                   {"industry": ["industry"], "industry_month": ["industry", "month"], "company": ["industry", "company"]},
                   F.count(F.lit(1)).alias("n"), F.count("jobNo").alias("numbered"))
    # companies are counted per industry, everything else stays as it is
    company = F.col("set") == "company"
    counts = counts.groupBy("industry", "month", F.when(company, "industry").otherwise(F.col("set")).alias("set")).agg(
        F.sum(F.when(~company, F.col("n"))).alias("n"), F.sum(F.when(~company, F.col("numbered"))).alias("numbered"),
        F.count_if(company & F.col("company").isNotNull()).alias("companies"))
    whole, by_month = F.col("set") == "industry", F.col("set") == "industry_month"
    known = F.col("industry").isNotNull()
    every = Window.partitionBy()
    counts = counts.select(
        "*", F.sum(F.when(whole, F.col("n"))).over(every).alias("total"),
        F.min(F.when(by_month & known, F.col("month"))).over(every).alias("first"),
        F.max(F.when(by_month & known, F.col("month"))).over(every).alias("last")).where(known)
    place = F.row_number().over(Window.partitionBy("set", "month").orderBy(F.desc("numbered"), "industry"))
    counts = counts.withColumn("place", F.when(by_month & (F.col("month") == F.col("last")), place))
    own = Window.partitionBy("industry")

    def month_count(which: str) -> Column:
        return F.sum(F.when(by_month & (F.col("month") == F.col(which)), F.col("numbered")).otherwise(0)).over(own)

    counts = counts.select("*", F.min("place").over(own).alias("rank"), month_count("first").alias("n_first"),
                           month_count("last").alias("n_last"))
    growth = P.growth_pct("n_first", F.col("n_last") - F.col("n_first"))
    return _rows(counts,
                 _only(whole, _row("industry", key=F.col("industry"), n=F.col("n"), n2=F.col("companies"),
                                   value=F.col("n") / F.col("total") * F.lit(100.0))),
                 _only(whole, _row("growth", key=F.col("industry"), n=F.col("n_first"), n2=F.col("n_last"), value=growth)),
                 _only(by_month, _row("industry_month", key=F.col("industry"), key2=F.col("month"), n=F.col("numbered"),
                                      n2=F.when(F.col("rank") <= top, F.col("rank")))))


def hiring_efficiency(jobs: DataFrame, as_of, bins: int = 20) -> DataFrame:
    """R4.  ``shelf_days``: key the bin, n postings, value and value2 its bounds.  ``experience``: key2 the applicant
    label, ``education``: key2 the salary label, ``competition``: key the level, each with n postings.  ``flags``:
    key long_unfilled or recent, n postings, n2 all postings, value the share.
    """
    a = analysis_projection(jobs, as_of).withColumn("competition", P.competition_level("apply_desc"))
    counts = _sets(a, ["shelf_days", "experience", "apply_desc", "competition", "education", "salary_desc"],
                   {"shelf_days": ["shelf_days"], "experience": ["experience", "apply_desc"], "competition": ["competition"],
                    "education": ["education", "salary_desc"], "flags": []},
                   F.count(F.lit(1)).alias("n"), F.count_if("long_unfilled").alias("long"), F.count_if("recent").alias("fresh"))
    days = Window.partitionBy("set")
    x = F.col("shelf_days").cast("double")
    counts = counts.withColumns({"lo": F.min(x).over(days), "width": (F.max(x).over(days) - F.min(x).over(days)) / F.lit(float(bins))})
    b = F.when(F.col("width") == 0, 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.col("width")), F.lit(bins - 1))).cast("int")
    is_set = lambda name: F.col("set") == name
    rows = _rows(
        counts,
        _only(is_set("shelf_days") & x.isNotNull(), _row("shelf_days", key=b, n=F.col("n"), value=F.col("lo") + b * F.col("width"),
                                                         value2=F.col("lo") + (b + 1) * F.col("width"))),
        *[_only(is_set(name) & F.col(one).isNotNull() & F.col(two).isNotNull(), _row(name, key=F.col(one), key2=F.col(two), n=F.col("n")))
          for name, one, two in (("experience", "experience", "apply_desc"), ("education", "education", "salary_desc"))],
        _only(is_set("competition"), _row("competition", key=F.col("competition"), n=F.col("n"))),
        *[_only(is_set("flags"), _row("flags", key=F.lit(name), n=F.col(c), n2=F.col("n"), value=F.try_divide(F.col(c), F.col("n"))))
          for name, c in (("long_unfilled", "long"), ("recent", "fresh"))])
    # several shelf days fall into a bin; of the other outputs each row is alone
    return rows.groupBy("output", "key", "key2", "value", "value2").agg(F.sum("n").alias("n"), F.max("n2").alias("n2")).select(*COLUMNS)


def salary_location(jobs: DataFrame, cities: int = 10, districts: int = 15, district_salaries: int = 10) -> DataFrame:
    """R5.  ``salary``: key the label.  ``city``: key the city, value and value2 its longitude and latitude where known.
    ``district``: key city, key2 district of the ``districts`` largest.  ``city_salary`` and ``district_salary``: key the
    city, or city and district, key2 the label, of the largest ``cities`` and ``district_salaries``.  All with n postings.
    """
    counts = _sets(jobs.select("salaryDesc", "city", "district"), ["salaryDesc", "city", "district"],
                   {"salary": ["salaryDesc"], "city": ["city"], "district": ["city", "district"],
                    "city_salary": ["salaryDesc", "city"], "district_salary": ["salaryDesc", "city", "district"]},
                   F.count(F.lit(1)).alias("n"))
    needs = {"salary": ["salaryDesc"], "city": ["city"], "district": ["city", "district"], "city_salary": ["salaryDesc", "city"],
             "district_salary": ["salaryDesc", "city", "district"]}
    is_set = lambda name: F.col("set") == name
    whole = F.lit(False)
    for name, columns in needs.items():
        held = is_set(name)
        for c in columns:
            held = held & F.col(c).isNotNull()
        whole = whole | held
    # the rows to rank are together, each of the others is alone
    apart = F.when(~F.col("set").isin("city", "district"), F.hash("salaryDesc", "city", "district"))
    place = F.row_number().over(Window.partitionBy("set", apart).orderBy(F.desc("n"), "city", "district"))
    counts = counts.where(whole).withColumn("place", place)
    counts = counts.select(
        "*", F.min(F.when(is_set("city"), F.col("place"))).over(Window.partitionBy("city")).alias("city_place"),
        F.min(F.when(is_set("district"), F.col("place"))).over(Window.partitionBy("city", "district")).alias("district_place"))
    coords = literal_frame(jobs.sparkSession, C.CITY_COORDINATES, [("at_city", "string"), ("lon", "double"), ("lat", "double")])
    counts = counts.join(F.broadcast(coords), F.col("city") == F.col("at_city"), "left")
    n, label = F.col("n"), F.col("salaryDesc")
    return _rows(
        counts,
        _only(is_set("salary"), _row("salary", key=label, n=n)),
        _only(is_set("city"), _row("city", key=F.col("city"), n=n, value=F.col("lon"), value2=F.col("lat"))),
        _only(is_set("district") & (F.col("place") <= districts), _row("district", key=F.col("city"), key2=F.col("district"), n=n)),
        _only(is_set("city_salary") & (F.col("city_place") <= cities), _row("city_salary", key=F.col("city"), key2=label, n=n)),
        _only(is_set("district_salary") & (F.col("district_place") <= min(district_salaries, districts)),
              _row("district_salary", key=P.city_district_key(), key2=label, n=n)))
