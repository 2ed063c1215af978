"""URL filters: a path-template tree per host, and templates rejected by smoothed labelled purity.

The tree is built level by level.  A segment's shape has runs of digits as <n>
and long hexadecimal runs as <h>.  Among the children of a branch, a shape
becomes the wildcard * where the branch has more than ``max_children`` shapes,
this one holds less than a tenth of its pages (a variable segment), and its
labels don't set it apart from the other shapes under the wildcard: their
two-sample G is below z^2 + 2 ln(labelled shapes there), so that chance keeps
few at any fan-out.  Those set apart leave the wildcard, and the rest are tested
again until none does; a shape that alone has labels stays a branch too.  The
others are taken in the order of their share of good pages; one joins the group
before it if it differs (two-proportion z of ``z`` or more) neither from the
group's sum nor from its first.  Shapes without labels are a group of their own,
or join the labelled ones if those are several and make one group.  A group is
one branch {a|b} (with more than ``max_children`` shapes, the first and the
number of others), or * if it is all.  From level ``max_depth`` on, the rest of a longer path is one **.  Levels are aggregated before anything is joined; the
join back has a row per kept branch; grouping reads a row per branch and pair of
counts, in order, and holds one group's sums.

A template is rejected if its purity, (good + m * host's) / (labelled + m), is
below ``least``; the host's is smoothed the same way towards that of all pages,
which is (good + 1) / (labelled + 2).  Rules given come first: one fits its host
and all subdomains if the path starts with the rule's, and the longest wins.

Nulls: a null url, or one without ``://``, has empty host and path and the
template ''; pages without a label count for no purity.  Repeated rows count
and are judged each.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import cut, lower_ascii, to_batch

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))


@dataclass(frozen=True)
class Settings:
    max_children: int = 32
    z: float = 1.96
    max_depth: int = 8
    m: float = 5.0
    least: float = 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the last that is set wins
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shapes(path: Column, max_depth: int) -> Column:
    """A path's segment shapes; an ending slash gives an empty last one."""
    flat = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "<h>"),
                            "[0-9]+", "<n>")
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(flat, "^/", ""), "/", -1))
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))) \
        .otherwise(parts)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count("good").alias("lab"),
            F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("pos")]


def _fit(pos: Column, lab: Column) -> Column:
    """Log-likelihood of pos good pages among lab at their own share."""
    def part(c):
        return F.when(c > 0, c * F.log(c / lab)).otherwise(0.0)
    return part(pos) + part(lab - pos)


def folded(kids: DataFrame, s: Settings) -> DataFrame:
    """Stored ``kids`` (host, template, seg, n, lab, pos) with ``kids`` (shapes of the branch) and ``wild`` (becomes *)."""
    node = ["host", "template"]
    up = kids.groupBy(node).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"))
    out = cut(kids.join(up, node).withColumn("wild", (F.col("kids") > s.max_children) & (F.col("n") * 10 < F.col("all_n")))
              .drop("all_n"), "url-branches")
    while True:
        pool = out.where("wild and lab > 0").groupBy(node).agg(
            F.count(F.lit(1)).alias("tests"), F.sum("lab").alias("p_lab"), F.sum("pos").alias("p_pos"))
        lab, pos = F.col("p_lab") - F.col("lab"), F.col("p_pos") - F.col("pos")
        g = 2 * (_fit(F.col("pos"), F.col("lab")) + _fit(pos, lab) - _fit(F.col("p_pos"), F.col("p_lab")))
        apart = (F.col("tests") == 1) | (g >= s.z ** 2 + 2 * F.log("tests"))
        leave = cut(out.where("wild and lab > 0").join(pool, node).where(apart).select(*node, "seg"), "url-apart")
        if leave.isEmpty():
            return out
        out = cut(out.join(leave.withColumn("leaves", F.lit(True)), [*node, "seg"], "left")
                  .withColumn("wild", F.col("wild") & F.col("leaves").isNull()).drop("leaves"), "url-branches")


def _apart(a: tuple[int, int], b: tuple[int, int], z: float) -> bool:
    """Whether the shares of two (lab, pos) differ."""
    pooled = (a[1] + b[1] + 1) / (a[0] + b[0] + 2)
    error = math.sqrt(pooled * (1 - pooled) * (1 / (a[0] + 1) + 1 / (b[0] + 1)))
    return abs((a[1] + 0.5) / (a[0] + 1) - (b[1] + 0.5) / (b[0] + 1)) >= z * error


def parts(own: DataFrame, z: float) -> DataFrame:
    """host, template, lab, pos, part (from 0 on) of labelled shapes (host, template, lab, pos); equal counts share one."""
    schema = pa.schema([("host", pa.string()), ("template", pa.string()), ("lab", pa.int64()), ("pos", pa.int64()),
                        ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, part, first, held = None, 0, (0, 0), (0, 0)
        for batch in batches:
            found = []
            for host, template, lab, pos, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (host, template):
                    node, part, first, held = (host, template), 0, (lab, pos), (0, 0)
                elif _apart((lab, pos), held, z) or _apart((lab, pos), first, z):
                    part, first, held = part + 1, (lab, pos), (0, 0)
                held = held[0] + same * lab, held[1] + same * pos
                found.append(part)
            yield to_batch(schema, [*batch.columns[:4], found])

    counts = own.groupBy("host", "template", "lab", "pos").agg(F.count(F.lit(1)).alias("same"))
    return counts.repartition("host", "template").sortWithinPartitions(
        "host", "template", (F.col("pos") + 0.5) / (F.col("lab") + 1), "lab").mapInArrow(
        run, "host string, template string, lab long, pos long, part long")


def branches(kids: DataFrame, s: Settings) -> DataFrame:
    """host, template, seg, branch of the shapes that stay; ``kids`` as ``folded`` returns them."""
    node = ["host", "template"]
    own = kids.where("not wild")
    known = cut(parts(own.where("lab > 0"), s.z), "url-parts")
    own = own.join(known, [*node, "lab", "pos"], "left")
    alike = own.groupBy(node).agg(F.max("part").alias("last"), F.count("part").alias("labelled"))
    bare = F.when((F.col("last") == 0) & (F.col("labelled") > 1), 0).otherwise(-1)
    own = cut(own.join(alike, node).select(*node, "seg", "kids", F.coalesce("part", bare).alias("part")),
              "url-own")
    size = own.groupBy(*node, "part").agg(F.count(F.lit(1)).alias("size"), F.min("seg").alias("least"))
    names = own.join(size, [*node, "part"]).where(F.col("size") <= s.max_children).groupBy(*node, "part").agg(
        F.array_join(F.array_sort(F.collect_list("seg")), "|").alias("names"))
    named = size.join(names, [*node, "part"], "left")
    whole = (F.col("size") == F.col("kids")) & (F.col("kids") > 1)
    listed = F.coalesce("names", F.concat("least", F.lit("|+"), F.col("size") - 1))
    return own.join(named, [*node, "part"]).select(
        *node, "seg", F.when(whole, "*").when(F.col("size") == 1, F.col("seg"))
        .otherwise(F.concat(F.lit("{"), listed, F.lit("}"))).alias("branch"))


def templates(pages: DataFrame, s: Settings) -> DataFrame:
    """``pages`` (host, path, good and others) with ``template``."""
    rows = cut(pages.withColumn("parts", shapes(F.col("path"), s.max_depth)).withColumn("template", F.lit("")),
               "url-level")
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(deepest):
        here = rows.withColumn("seg", F.get("parts", F.lit(level)))
        kids = here.where("seg is not null").groupBy("host", "template", "seg").agg(*_counts())
        own = branches(folded(cut(kids, "url-kids"), s), s).select(
            F.col("host").alias("b_host"), F.col("template").alias("b_template"), F.col("seg").alias("b_seg"), "branch")
        here = here.join(own, (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template"))
                         & (F.col("seg") == F.col("b_seg")), "left")
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("/"), F.when(F.col("seg") == "**", F.col("seg")).otherwise(
                F.coalesce("branch", F.lit("*")))))
        rows = cut(here.withColumn("template", F.concat("template", step))
                   .drop("seg", "b_host", "b_template", "b_seg", "branch"), "url-level")
    return rows.drop("parts")


def rejected(rows: DataFrame, s: Settings) -> DataFrame:
    """host, template, purity of the templates below the least purity."""
    own = rows.groupBy("host", "template").agg(*_counts())
    total = own.agg(F.sum("lab").alias("lab"), F.sum("pos").alias("pos")).select(
        (F.coalesce("pos", F.lit(0)) + 1) / (F.coalesce("lab", F.lit(0)) + 2)).scalar()
    hosts = own.groupBy("host").agg(((F.sum("pos") + s.m * total) / (F.sum("lab") + s.m)).alias("host_purity"))
    return own.join(hosts, "host").withColumn(
        "purity", (F.col("pos") + s.m * F.col("host_purity")) / (F.col("lab") + s.m)) \
        .where(F.col("purity") < s.least).select("host", "template", "purity")


def judge_urls(pages: DataFrame, rules=RULES, settings: Settings = Settings()) -> DataFrame:
    """``pages``: page_id, url, good (boolean, null without label).  Returns page_id, host, path, rule, verdict, template."""
    own = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good")
    rows = templates(own, settings)
    bad = cut(rejected(rows, settings), "url-rejected").select(
        F.col("host").alias("r_host"), F.col("template").alias("r_template"), "purity")
    rows = rows.join(bad, (F.col("host") == F.col("r_host")) & (F.col("template") == F.col("r_template")), "left")
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("r_host").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                       "template")


def op1_query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("label_id")) \
        .agg(F.min(F.col("quality") == 1).alias("good"))
    number = F.regexp_extract(path_of(F.col("url")), r"/0*([0-9]+)(?:[.][a-z]+)?/?$", 1)
    own = pages.select("page_id", "url", number.alias("number"))
    return judge_urls(own.join(known, F.col("number") == F.col("label_id"), "left").select("page_id", "url", "good"))
