"""Daily ingest: S18, S20, P21, A26, A30, J10, J11, J13, U3, U5.

Raw search responses land as JSON files (one record per fetched page); the
whole batch is then one DataFrame plan: explode the posting lists, tag them,
merge duplicates by ``jobNo``, parse fields and hand the batch to the
lifecycle merge.  Nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens import constants as C
from hirelens.functions import parsing as P

LINK_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("applyAnalyze", "job", "cust")])
POSTING_TYPE = T.StructType([
    T.StructField("jobNo", T.StringType()), T.StructField("jobName", T.StringType()),
    T.StructField("custName", T.StringType()), T.StructField("coIndustryDesc", T.StringType()),
    T.StructField("jobDetail", T.StringType()), T.StructField("jobAddrNo", T.StringType()),
    T.StructField("jobAddrNoDesc", T.StringType()), T.StructField("link", LINK_TYPE),
    T.StructField("appearDate", T.StringType()), T.StructField("salaryDesc", T.StringType()),
    T.StructField("applyDesc", T.StringType()), T.StructField("periodDesc", T.StringType()),
    T.StructField("optionEdu", T.StringType())])
RESPONSE_TYPE = T.StructType([
    T.StructField("today", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("first_url", T.StringType()), T.StructField("crawl_url", T.StringType()),
    T.StructField("keyword", T.StringType()), T.StructField("page_key", T.LongType()),
    T.StructField("page_block", T.LongType()), T.StructField("fetch_seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("error", T.StringType()),
        T.StructField("data", T.StructType([
            T.StructField("totalPage", T.IntegerType()), T.StructField("totalCount", T.IntegerType()),
            T.StructField("list", T.ArrayType(POSTING_TYPE))]))]))])


def _open_type(t: T.DataType) -> T.DataType:
    if t == T.ArrayType(POSTING_TYPE):
        return T.ArrayType(T.VariantType())
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _open_type(f.dataType)) for f in t])
    return t


#: Responses whose postings are VARIANT values: any field of a posting is kept.
OPEN_RESPONSE_TYPE = _open_type(RESPONSE_TYPE)


def _lit_date(d) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)))


def response_class(result: Column | None = None) -> Column:
    """Error / no_data / no_list / valid."""
    result = F.col("result") if result is None else result
    return (F.when(result.getField("error").isNotNull(), F.lit("error"))
            .when(result.getField("data").isNull(), F.lit("no_data"))
            .when(result.getField("data").getField("list").isNull(), F.lit("no_list"))
            .otherwise(F.lit("valid")))


def response_classes(responses: DataFrame) -> DataFrame:
    return responses.groupBy(response_class().alias("response_class")).agg(F.count(F.lit(1)).alias("page_count"))


def explode_responses(responses: DataFrame, as_of) -> DataFrame:
    """S18 + P21: one row per posting of every valid page, tagged with the
    page keyword and ingest metadata, with the arrival ordinal
    ``ord = (fetch_seq, page_key, page_block, pos, keyword)``.  ``fetch_seq``
    is the order in which pages were fetched; where responses lack it, the
    page's place and the keyword decide, so no tie is left open.

    Postings read as VARIANT (``OPEN_RESPONSE_TYPE``) give the named columns and
    the whole posting as ``doc``.  A field of another type than its column reads
    as null there and stays as it is in ``doc``.
    """
    return _described(_tagged(responses), as_of, ("search_keyword", "ord", "page_key", "page_block", "pos"))


def _tagged(responses: DataFrame) -> DataFrame:
    """jobNo, search_keyword, ord and the whole posting ``p`` of every posting of the valid pages."""
    if "fetch_seq" not in responses.columns:
        responses = responses.withColumn("fetch_seq", F.lit(None).cast("long"))
    ok = responses.where(response_class() == "valid")
    ex = ok.select("keyword", "fetch_seq", "page_key", "page_block", F.posexplode("result.data.list").alias("pos", "p"))
    return ex.select(
        posting_fields(ex.schema["p"].dataType, "jobNo")[0], "p",
        F.when(F.col("keyword").isNotNull() & (F.col("keyword") != ""), F.col("keyword")).alias("search_keyword"),
        F.struct("fetch_seq", "page_key", "page_block", "pos", "keyword").alias("ord"), "page_key", "page_block", "pos")


def _described(rows: DataFrame, as_of, more: tuple[str, ...], last: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the postings ``p``, with ingest metadata."""
    today = _lit_date(as_of)
    kind = rows.schema["p"].dataType
    # jobNo is the rows' own column: what they are grouped and dealt by stays known to the plan
    columns = [F.col("jobNo") if name == "jobNo" else c for name, c in zip(posting_names(kind), posting_fields(kind), strict=True)]
    named = rows.select(*columns, *more, *last).withColumns({
        "crawl_date": today,
        "status": F.lit(C.STATUS_ACTIVE),
        "last_update_date": today,
        "area_code": F.coalesce(F.col("jobAddrNo"), F.lit("")),
        "area_name": F.coalesce(F.col("jobAddrNoDesc"), F.lit("")),
    })
    return named.select(*[c for c in named.columns if c not in last], *last)


def posting_fields(kind: T.DataType, only: str | None = None) -> list[Column]:
    """The columns of a posting ``p`` (or ``only`` one); ``doc`` too if it is a VARIANT."""
    if not isinstance(kind, T.VariantType):
        return [F.col("p")[name].alias(name) for name in ([only] if only else posting_names(kind))]
    if only:
        return [F.try_variant_get("p", f"$.{only}", POSTING_TYPE[only].dataType.simpleString()).alias(only)]
    named = [F.try_variant_get("p", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in POSTING_TYPE]
    return [*named, F.col("p").alias("doc")]


def posting_names(kind: T.DataType) -> list[str]:
    """Names of the columns of ``posting_fields``."""
    return [*POSTING_TYPE.names, "doc"] if isinstance(kind, T.VariantType) else kind.names


def has_posting(responses: DataFrame) -> Column:
    """Whether a page's list holds a posting with a ``jobNo``."""
    open_list = isinstance(responses.select("result.data.list").schema[0].dataType.elementType, T.VariantType)
    return F.exists("result.data.list", lambda p: (
        F.try_variant_get(p, "$.jobNo", "string") if open_list else p["jobNo"]) != "")


def set_fields(old: Column, new: Column) -> Column:
    """Shallow update of VARIANT objects: fields of ``new`` replace or join those of ``old``, the others stay.

    A null, or a value that is no object, has no fields; without fields on both sides the result is null.
    """
    def fields(c: Column) -> Column:
        return F.try_variant_get(c, "$", "map<string,variant>")

    a, b = fields(old), fields(new)
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.to_variant_object(F.coalesce(both, b, a))


def keyword_lists(hits: DataFrame, ord_col: str = "ord", key: str = "jobNo", keyword_col: str = "search_keyword") -> DataFrame:
    """A26, keyword half: per ``jobNo`` its distinct keywords in first-seen order, as ``_kws``; none without keywords."""
    rows = hits.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(keyword_col).isNotNull())
    return (rows.groupBy(key, keyword_col).agg(F.min(ord_col).alias("_kord"))
            .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_kord", F.col(keyword_col).alias("k")))).alias("_kws"))
            .select(key, F.transform("_kws", lambda e: e["k"]).alias("_kws")))


def merge_postings(hits: DataFrame, ord_col: str = "ord", key: str = "jobNo",
                   keyword_col: str = "search_keyword", found: DataFrame | None = None) -> DataFrame:
    """One row per ``jobNo``; the first record (smallest ``ord``) wins and
    ``search_keyword`` becomes the distinct keywords in first-seen order.
    Rows without ``jobNo`` (null or empty) are dropped.

    Skew-safe: the record is one ``min_by`` per posting and the keywords are
    counted down on narrow rows, first per (jobNo, keyword); all of it is
    partially aggregated before a shuffle.  ``found`` gives the ``keyword_lists``
    of the hits where they were made before.
    """
    rec_cols = [c for c in hits.columns if c not in (ord_col, keyword_col, key)]
    rows = hits.where(F.col(key).isNotNull() & (F.col(key) != ""))
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rec_cols), F.col(ord_col)).alias("_rec"))
    found = keyword_lists(hits, ord_col, key, keyword_col) if found is None else found
    none = F.array().cast("array<string>")
    return first.join(found, key, "left").select(
        *[F.col(c) if c == key else F.col("_rec")[c].alias(c) for c in hits.columns if c not in (ord_col, keyword_col)],
        F.coalesce("_kws", none).alias(keyword_col))


def parse_fields(postings: DataFrame) -> DataFrame:
    """F4–F7 on a batch: link URLs and city / district."""
    out = postings
    if "link" in postings.columns:
        dtype = dict(postings.dtypes)["link"]
        urls = P.link_urls_from_struct("link") if dtype.startswith("struct") else P.link_urls_from_string("link")
        out = out.withColumns({"applyAnalyze": urls.applyAnalyze, "job": urls.job, "cust": urls.cust})
    if "jobAddrNoDesc" in postings.columns:
        out = P.with_city_district(out)
    return out


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row-count metric, filled in by whatever action runs the plan."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def batch_keywords(responses: DataFrame) -> DataFrame:
    """The ``keyword_lists`` of a batch, which ``prepare_batch`` takes as ``found``."""
    return keyword_lists(_tagged(responses).select("jobNo", "search_keyword", "ord"))


def prepare_batch(responses: DataFrame, as_of, metrics: dict | None = None, found: DataFrame | None = None) -> DataFrame:
    """S18 → P21 → A26 → F4–F7: the posting batch of one crawl day.

    With ``metrics={}``, row counts before and after the merge (A31) are
    registered as ``metrics["hits"]`` / ``metrics["postings"]`` Observations.

    The merge moves each posting once, as the page has it; its columns are read after.
    """
    hits = _tagged(responses).drop("page_key", "page_block", "pos")
    if metrics is not None:
        hits, metrics["hits"] = observed(hits, "hits")
    merged = parse_fields(_described(merge_postings(hits, found=found), as_of, (), ("search_keyword",)))
    if metrics is not None:
        merged, metrics["postings"] = observed(merged, "postings")
    return merged


def crawl_log_from_responses(responses: DataFrame, seq: int = 0) -> DataFrame:
    """S10 input rows: one crawl-log record per fetched page.

    ``status`` is ``ok`` only when the response carries data (decision for
    quirk Q18: a response holding an error is retried the same day).
    """
    ok = response_class() == "valid"
    return responses.select(
        "today", "keyword", "first_url", "crawl_url",
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.col("result.data.totalCount")).alias("total_count"),
        F.lit(seq).alias("seq"))


def fetch_stats(responses: DataFrame) -> DataFrame:
    """Pages fetched OK / failed and postings fetched, per keyword."""
    valid = response_class() == "valid"
    return responses.groupBy("keyword").agg(
        F.count_if(valid).alias("pages_ok"),
        F.count_if(~valid).alias("pages_failed"),
        F.sum(F.when(valid, F.size("result.data.list")).otherwise(0)).cast("bigint").alias("jobs_fetched"))


# ---------------------------------------------------------------------------
# Frontier (J10, J11, J13, U3, F12)
# ---------------------------------------------------------------------------
def crawl_frontier(keywords: DataFrame, areas: DataFrame) -> DataFrame:
    """J10 + F12 + U3: every keyword in every area, pages 1..totalPage, with URLs.

    Every keyword with every area is the feature, so this is a plain cross
    join of the two dimensions, of any size.  ``areas`` needs ``area_code``,
    ``area_name`` and ``total_page``.
    """
    pairs = keywords.select("keyword").crossJoin(areas.select("area_code", "area_name", "total_page"))
    pages = pairs.select("keyword", "area_code", "area_name",
                         F.explode(F.sequence(F.lit(1), F.col("total_page").cast("int"))).alias("page"))
    return pages.withColumns({
        "crawl_url": P.search_url(F.col("keyword"), F.col("page"), F.col("area_code")),
        "first_url": P.search_url(F.col("keyword"), F.lit(1), F.col("area_code")),
    })


def frontier_pending(frontier: DataFrame, crawl_log: DataFrame, as_of) -> DataFrame:
    """J11 + S11: frontier entries not yet fetched OK today (anti join)."""
    done = crawl_log.where((F.col("today") == F.lit(_iso(as_of))) & (F.col("status") == "ok")) \
        .select("crawl_url", "first_url").distinct()
    return frontier.join(done, ["crawl_url", "first_url"], "left_anti")


TAIL, TAILS = 8, 256  # bytes that a planned URL's end is told by, and its hash values
SALTS = 64


def _bytes(url: Column, start: Column, end: Column) -> Column:
    """The bytes ``start`` (from 1) to ``end`` of a URL."""
    return F.substring(url.cast("binary"), start, end - start + 1)


def _tail(url: Column, start: Column, end: Column) -> Column:
    """Hash value of the end of the piece that is the bytes ``start`` to ``end`` of a URL."""
    return F.crc32(_bytes(url, F.greatest(start, end - TAIL + 1), end)) % TAILS


def page_keyword_match(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Each fetched page with each keyword it belongs to, as ``matched_keyword``.

    A page belongs to a keyword of the frontier if it was fetched for it, or if
    its URL contains one of the keyword's planned URLs; one row for both.  A
    null or empty planned URL is contained in none, null keywords match nothing.

    Containment is a join on equality: a planned URL can only start where the
    page's URL has its ``://``, so a page's URL gives the pieces at those places
    that are as long as some planned URL and end like one of that length, and an
    equal piece is the proof.  Planned URLs without ``://`` are tried at every place.
    Ends are told apart by TAILS hash values, so what tasks hold of them is bounded
    by URL lengths.  Keywords are few for many pages: a page takes one of SALTS
    copies of its keyword, so that no task gets all pages of one.
    """
    planned = frontier.where(F.col("keyword").isNotNull() & (F.length("crawl_url") > 0)).select(
        F.col("keyword").alias("matched_keyword"), F.col("crawl_url").alias("piece")).distinct()
    whole = (F.col("piece"), F.lit(1), F.octet_length("piece"))
    mark = F.when(F.contains("piece", F.lit("://")), F.octet_length(F.substring_index("piece", "://", 1)) + 1).otherwise(0)
    shapes = planned.groupBy(mark.alias("mark"), F.octet_length("piece").alias("n")) \
        .agg(F.collect_set(_tail(*whole)).alias("tails")) \
        .agg(F.collect_list(F.struct("mark", "n", "tails"))).scalar()
    urls = pages.where(F.length("url") > 0).select("url").distinct().withColumn("_shapes", shapes)
    parts = F.split("url", "://")  # its marks follow all parts but the last
    marked = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, k: F.octet_length(
        F.array_join(F.slice(parts, F.lit(1), k + 1), "://")) + 1)
    free = F.exists("_shapes", lambda shape: shape["mark"] == 0)
    # rows, not arrays, of a URL's places and the shapes there: compiled code goes through them, by bytes
    tried = urls.select("url", "_shapes", F.explode(
        F.when(free, F.sequence(F.lit(1), F.octet_length("url"))).otherwise(marked)).alias("_at")).select("url", "_at", F.inline("_shapes"))
    url, at = F.col("url"), F.col("_at")
    start = F.when(F.col("mark") > 0, at - F.col("mark") + 1).otherwise(at)
    end = start + F.col("n") - 1
    meets = (F.col("mark") == 0) | (_bytes(url, at, at + 2) == F.lit(b"://"))
    piece = _bytes(url, start, end).cast("string")
    # a piece that the URL has at several places is taken at the first
    first = F.octet_length(F.left(url, F.instr(url, piece) - 1)) + 1
    pieces = tried.where((start >= 1) & (end <= F.octet_length("url"))).where(meets) \
        .where(F.array_contains("tails", _tail(url, start, end))).where(first == start).select("url", piece.alias("piece"))
    found = pieces.join(planned, "piece").select("url", "matched_keyword").distinct()
    names = frontier.where(F.col("keyword").isNotNull()).select("keyword").distinct() \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_name = pages.where(F.col("keyword").isNotNull()).withColumn("_salt", F.floor(F.rand(0) * SALTS).cast("int")) \
        .join(names, ["keyword", "_salt"], "left_semi").select(*pages.columns, F.col("keyword").alias("matched_keyword"))
    by_url = pages.join(found, "url").where(~F.col("keyword").eqNullSafe(F.col("matched_keyword"))) \
        .select(*pages.columns, "matched_keyword")
    return by_name.unionByName(by_url)


def _iso(d) -> str:
    return d.isoformat() if isinstance(d, dt.date) else str(d)
