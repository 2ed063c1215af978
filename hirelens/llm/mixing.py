"""Mixing sources to target weights: hierarchical budgeting (DataFrame functions only).

A tree of levels (domain, language, source) gets a token budget.  Each node's
capacity is the tokens below it times ``max_epochs``.  Top-down, a parent's
budget is shared by its children in proportion to their weights; a child that
can't take its share keeps its whole capacity and the rest goes to its
siblings (water filling).  As a parent's capacity is the sum of its leaves', a
shortage reaches the ancestors' siblings only when all nearer ones are full.

Each leaf then takes a prefix of its epochs: in epoch e its documents are
ordered by md5(seed:e:doc_id), then doc_id, then tokens; documents are taken
while the tokens before them are below the quota, so the last one may overshoot
(``take_tokens`` says how many of its tokens the quota holds).

The prefix is found without sorting a leaf: tokens are summed by leaf and the
first hex digits of the key; only the one bucket in which the quota ends is
ordered by a window.  All shares are integers, so results don't depend on the
order of summation.

Nulls: a null level value counts as ''; a null text has no tokens; a null
doc_id hashes as '' and stays.  Repeated rows are separate documents; rows with
the same doc_id and tokens share their place and are taken or left together.
A leaf without tokens, an empty table, or weights that are all 0 give no rows
for it.  Extra columns are passed through by ``mix`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import WORD, cut

BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Level:
    """``weights``: whole numbers by node value; others weigh ``default``."""

    name: str
    value: Column
    weights: dict[str, int] = field(default_factory=dict)
    default: int = 1

    def weight(self) -> Column:
        known = [F.lit(x) for kv in self.weights.items() for x in kv]
        return F.coalesce(F.create_map(*known)[F.col(self.name)], F.lit(self.default)).cast("long") \
            if known else F.lit(self.default).cast("long")


@dataclass(frozen=True)
class Plan:
    """``budget_share``: tokens to select, in thousandths of the table's tokens."""

    levels: Sequence[Level]
    budget_share: int = 800
    max_epochs: int = 3
    seed: int = 17


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def allocate(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves``: a row per leaf with the levels' names and ``tokens``.  Adds ``quota``."""
    names = [lv.name for lv in plan.levels]
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(
        F.floor(F.col("t") * plan.budget_share / 1000).cast("long"))
    parents = None
    for depth, lv in enumerate(plan.levels):
        up, path = names[:depth], names[:depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens")) \
            .withColumn("cap", F.col("tokens") * plan.max_epochs).withColumn("w", lv.weight())
        nodes = nodes.withColumn("budget", total.scalar()) if parents is None else nodes.join(parents, up)
        order = [F.col("w") == 0, F.col("cap") / F.col("w").cast("double"), F.col(lv.name)]
        before = Window.partitionBy(*up).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        on = Window.partitionBy(*up).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) \
            .withColumn("w_left", F.sum("w").over(on)) \
            .withColumn("full", (F.col("w") > 0)
                        & (_exact(F.col("cap")) * F.col("w_left") <= _exact(F.col("left")) * F.col("w")))
        kin = Window.partitionBy(*up)
        nodes = nodes.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap"))
                                                                 .otherwise(0)).over(kin)) \
            .withColumn("w_rest", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(kin))
        share = F.expr("cast(cast(rest as decimal(38,0)) * w div w_rest as long)")
        nodes = nodes.withColumn("quota", F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, share)
                                 .otherwise(0))
        parents = nodes.select(*path, F.col("quota").alias("budget"))
    return leaves.join(parents.withColumnRenamed("budget", "quota"), names)


def _key(plan: Plan, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def leaf_cuts(narrow: DataFrame, plan: Plan) -> DataFrame:
    """``narrow``: doc_id, levels, n_tokens.  Per leaf: ``full`` epochs, then documents up to ``last`` of one more."""
    names = [lv.name for lv in plan.levels]
    leaves = cut(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-leaves")
    quotas = allocate(leaves, plan).withColumn("full", F.expr("cast(quota div tokens as int)")) \
        .withColumn("rest", F.expr("quota % tokens"))
    quotas = cut(quotas.select(*names, "quota", "full", "rest"), "mix-quotas")
    keyed = narrow.join(quotas.where("rest > 0"), names).withColumn("key", _key(plan, F.col("full"))) \
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*names, "rest", "bucket").agg(F.sum("n_tokens").alias("held"))
    upto = Window.partitionBy(*names).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("held").over(upto.rowsBetween(Window.unboundedPreceding, 0))
                           - F.col("held"))
    ends = sums.where("before < rest and rest <= before + held").select(*names, "bucket", "before")
    inside = keyed.join(ends, [*names, "bucket"])
    place = Window.partitionBy(*names).orderBy("key", "doc_id", "n_tokens").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(place)) \
        .withColumn("before", F.col("upto") - F.sum("n_tokens").over(
            Window.partitionBy(*names, "key", "doc_id", "n_tokens"))).where("before < rest")
    last = taken.groupBy(*names).agg(
        F.max(F.struct("key", F.coalesce("doc_id", F.lit(-2**63)).alias("doc_id"), "n_tokens", "before")).alias("last"))
    return quotas.join(last, names, "left")


def mix(docs: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as epochs take it, with struct ``mix`` (levels, epoch, n_tokens, take_tokens).

    ``docs`` must be a stored table: it is read twice (counts, then the selection).
    """
    names = [lv.name for lv in plan.levels]
    levels = [F.coalesce(lv.value.cast("string"), F.lit("")).alias(lv.name) for lv in plan.levels]
    own = [F.col(doc_id).cast("long").alias("doc_id"), *levels, count_words(F.col(text)).alias("n_tokens")]
    narrow = cut(docs.select(*own), "mix-narrow")
    cuts = leaf_cuts(narrow, plan).select(F.struct(*names).alias("mix_leaf"),
                                          F.struct("quota", "full", "rest", "last").alias("mix_cut"))
    rows = docs.withColumn("mix", F.struct(*own))
    leaf = F.struct(*[F.col(f"mix.{n}").alias(n) for n in names])
    rows = rows.join(cuts, leaf == F.col("mix_leaf"))
    of = {k: F.col(f"mix_cut.{k}") for k in ("quota", "full", "rest", "last")}
    id_ = F.coalesce(F.col("mix.doc_id"), F.lit(-2**63))
    key = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), of["full"].cast("string"),
                            F.coalesce(F.col("mix.doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.struct(key.alias("key"), id_.alias("doc_id"), F.col("mix.n_tokens").alias("n_tokens"))
    end = F.struct(F.col("mix_cut.last.key").alias("key"), F.col("mix_cut.last.doc_id").alias("doc_id"),
                   F.col("mix_cut.last.n_tokens").alias("n_tokens"))
    extra = (of["rest"] > 0) & (place <= end)
    epochs = F.when(extra, F.sequence(F.lit(0), of["full"])) \
        .when(of["full"] > 0, F.sequence(F.lit(0), of["full"] - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("mix_epoch", F.explode(epochs))
    used = F.when((F.col("mix_epoch") == of["full"]) & (place == end),
                  F.least(F.col("mix.n_tokens"), of["rest"] - F.col("mix_cut.last.before"))) \
        .otherwise(F.col("mix.n_tokens"))
    return rows.withColumn("mix", F.struct(*[F.col(f"mix.{n}").alias(n) for n in names],
                                           F.col("mix_epoch").alias("epoch"), F.col("mix.n_tokens").alias("n_tokens"),
                                           used.alias("take_tokens"))).drop("mix_leaf", "mix_cut", "mix_epoch")


LANGS = {"en": 4, "de": 2, "fr": 2, "es": 1}


def production_plan(budget_share: int = 800) -> Plan:
    """Tree of the documents table: sources with one digit are web crawls, the others are curated."""
    return Plan([Level("domain", F.expr("case when source rlike '^src[0-9]$' then 'web' else 'curated' end"),
                       {"web": 2, "curated": 3}),
                 Level("lang", F.col("lang"), LANGS), Level("source", F.col("source"))], budget_share)


def op9_query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "lang", "source"), production_plan()) \
        .select("doc_id", "mix.*")


SQL = r"""
WITH narrow AS (
  SELECT doc_id, CASE WHEN regexp_full_match(source, 'src[0-9]') THEN 'web' ELSE 'curated' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM narrow GROUP BY ALL HAVING sum(n_tokens) > 0),
d0 AS (SELECT domain, sum(tokens)::HUGEINT * 3 AS cap, CASE domain WHEN 'web' THEN 2 WHEN 'curated' THEN 3 ELSE 1 END AS w,
       (SELECT sum(tokens)::HUGEINT * 800 // 1000 FROM leaves) AS budget FROM leaves GROUP BY domain),
d1 AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS lft,
       sum(w) OVER (ORDER BY cap / w::DOUBLE, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_left FROM d0),
d2 AS (SELECT *, cap * w_left <= lft * w AS is_full FROM d1),
d3 AS (SELECT domain, CASE WHEN is_full THEN cap ELSE
       (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::HUGEINT * w // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::HUGEINT END AS budget FROM d2),
l0 AS (SELECT domain, lang, sum(tokens)::HUGEINT * 3 AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w
       FROM leaves GROUP BY ALL),
l1 AS (SELECT l0.*, budget, budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w::DOUBLE, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS lft,
       sum(w) OVER (PARTITION BY domain ORDER BY cap / w::DOUBLE, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_left FROM l0 JOIN d3 USING (domain)),
l2 AS (SELECT *, cap * w_left <= lft * w AS is_full FROM l1),
l3 AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE
       (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain))::HUGEINT * w
       // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain))::HUGEINT END AS budget FROM l2),
s0 AS (SELECT domain, lang, source, tokens, tokens * 3 AS cap, 1 AS w FROM leaves),
s1 AS (SELECT s0.*, budget, budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS lft,
       sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_left FROM s0 JOIN l3 USING (domain, lang)),
s2 AS (SELECT *, cap * w_left <= lft * w AS is_full FROM s1),
quotas AS (SELECT domain, lang, source, tokens, CASE WHEN is_full THEN cap ELSE
       (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang))::HUGEINT * w
       // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang))::HUGEINT END AS quota FROM s2),
keyed AS (SELECT n.*, (quota // tokens)::INTEGER AS whole, (quota % tokens)::BIGINT AS rest,
          md5('17:' || (quota // tokens)::INTEGER || ':' || coalesce(doc_id::VARCHAR, '')) AS k
          FROM narrow n JOIN quotas USING (domain, lang, source)),
placed AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens))::BIGINT
           - (sum(n_tokens) OVER (PARTITION BY domain, lang, source, k, doc_id, n_tokens))::BIGINT AS before FROM keyed),
epochs AS (SELECT *, unnest(CASE WHEN before < rest THEN range(0, whole + 1) ELSE range(0, whole) END)::INTEGER AS epoch FROM placed)
SELECT doc_id, domain, lang, source, epoch, n_tokens,
       (CASE WHEN epoch = whole THEN least(n_tokens, rest - before) ELSE n_tokens END)::BIGINT AS take_tokens
FROM epochs
"""
