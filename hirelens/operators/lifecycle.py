"""Posting lifecycle: L1–L5, S9, S10, S17, J4–J6.

The stored state is a snapshot DataFrame (one row per ``jobNo``).  A crawl
day is applied as ONE full outer join of state and batch on ``jobNo``:

* in both      → batch fields win; ``last_update_date = as_of``; a previously
                 inactive posting is reactivated (status active, delisted
                 date cleared); discovery date kept            (L2, L3, S9)
* state only   → an active posting is delisted: status inactive,
                 ``last_update_date = delisted_date = as_of`` — unless the
                 crawl is empty (no-op guard)                  (L1, J4)
* batch only   → new posting, discovered today                  (S9)

A VARIANT column (``doc``, the whole posting) is updated field by field: fields
that the batch's posting lacks keep their stored values.

The result is a new snapshot; writing it goes to a NEW directory (see
``hirelens.sources.io.publish``), never over the one being read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.operators.ingest import set_fields

STATE_ONLY = ("status", "delisted_date", "discovery_date", "last_update_date")


def _lit_date(d) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)))


def existing_statuses(state: DataFrame) -> DataFrame:
    """(jobNo, status) with a missing status read as active."""
    return state.select("jobNo", F.coalesce(F.col("status"), F.lit(C.STATUS_ACTIVE)).alias("status"))


def sync_snapshot(state: DataFrame, batch: DataFrame, as_of, delist: bool = True,
                  nonempty: Column | None = None) -> DataFrame:
    """Next snapshot from the stored state and today's posting batch.

    Adds ``change`` = new | kept | reactivated | delisted | untouched.
    ``delist=False`` gives the plain upsert (S9) without L1.  ``nonempty`` says
    whether the crawl found anything (guard of L1); by default the batch is
    asked, which builds it a second time.
    """
    today = _lit_date(as_of)
    today_txt = F.date_format(today, "yyyy-MM-dd")
    batch_nonempty = batch.limit(1).select(F.count(F.lit(1)) > 0).scalar() if nonempty is None else nonempty
    s = state.alias("s")
    b = batch.withColumn("_in_batch", F.lit(True)).alias("b")
    j = s.join(b, F.col("s.jobNo") == F.col("b.jobNo"), "full_outer")
    in_s = F.col("s.jobNo").isNotNull()
    in_b = F.col("b._in_batch").isNotNull()
    s_status = F.coalesce(F.col("s.status"), F.lit(C.STATUS_ACTIVE))

    change = (F.when(in_s & in_b & (s_status == C.STATUS_INACTIVE), F.lit("reactivated"))
              .when(in_s & in_b, F.lit("kept"))
              .when(in_b, F.lit("new"))
              .when(F.lit(delist) & batch_nonempty & (s_status == C.STATUS_ACTIVE), F.lit("delisted"))
              .otherwise(F.lit("untouched")))

    cols = []
    batch_cols = set(batch.columns)
    all_cols = list(dict.fromkeys(list(state.columns) + list(batch.columns)))
    for c in all_cols:
        if c in STATE_ONLY:
            continue
        if c in batch_cols and c in state.columns and dict(batch.dtypes)[c] == "variant":
            cols.append(F.when(in_s & in_b, set_fields(F.col(f"s.{c}"), F.col(f"b.{c}")))
                        .when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        elif c in batch_cols and c in state.columns:
            cols.append(F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        elif c in batch_cols:
            cols.append(F.col(f"b.{c}").alias(c))
        else:
            cols.append(F.col(f"s.{c}").alias(c))
    ch = F.col("change")
    has = set(state.columns)
    s_delisted = F.col("s.delisted_date") if "delisted_date" in has else F.lit(None).cast("string")
    s_disc = F.col("s.discovery_date") if "discovery_date" in has else F.lit(None).cast("date")
    s_upd = F.col("s.last_update_date") if "last_update_date" in has else F.lit(None).cast("date")
    out = j.select(*cols, change.alias("change"), s_status.alias("_s_status"),
                   s_delisted.alias("_s_delisted"), s_disc.alias("_s_disc"), s_upd.alias("_s_upd"))
    return out.select(
        *[F.col(c) for c in out.columns if not c.startswith("_") and c != "change"],
        F.when(ch.isin("new", "kept", "reactivated"), F.lit(C.STATUS_ACTIVE))
         .when(ch == "delisted", F.lit(C.STATUS_INACTIVE)).otherwise(F.col("_s_status")).alias("status"),
        F.when(ch.isin("new", "reactivated"), F.lit(None).cast("string"))
         .when(ch == "delisted", today_txt).otherwise(F.col("_s_delisted")).alias("delisted_date"),
        F.when(ch == "new", today).otherwise(F.col("_s_disc")).alias("discovery_date"),
        F.when(ch == "untouched", F.col("_s_upd")).otherwise(today).alias("last_update_date"),
        ch)


def close_day(state: DataFrame, as_of) -> DataFrame:
    """L1 on a stored snapshot: active postings that the day ``as_of`` did not update are delisted.

    Without any posting updated that day the crawl was empty and nothing changes.
    """
    today = _lit_date(as_of)
    any_seen = state.where(F.col("last_update_date") == today).limit(1).select(F.count(F.lit(1)) > 0).scalar()
    gone = any_seen & (F.coalesce("status", F.lit(C.STATUS_ACTIVE)) == C.STATUS_ACTIVE) \
        & ~F.coalesce(F.col("last_update_date") >= today, F.lit(False))
    return state.withColumns({
        "status": F.when(gone, C.STATUS_INACTIVE).otherwise(F.col("status")),
        "delisted_date": F.when(gone, F.date_format(today, "yyyy-MM-dd")).otherwise(F.col("delisted_date")),
        "last_update_date": F.when(gone, today).otherwise(F.col("last_update_date"))})


def upsert(state: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """Upsert by jobNo without delisting."""
    return sync_snapshot(state, batch, as_of, delist=False)


def upsert_counts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """S9 result: inserted and modified (matched) postings of a batch."""
    keys = batch.select("jobNo").distinct()
    matched = keys.join(state.select("jobNo"), "jobNo", "left_semi")
    total = keys.select(F.count(F.lit(1))).scalar()
    return matched.agg(F.count(F.lit(1)).alias("modified")).select((total - F.col("modified")).alias("inserted"), "modified")


def change_counts(snapshot: DataFrame) -> DataFrame:
    """Rows per change class of a sync."""
    return snapshot.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def crawl_log_upsert(old: DataFrame, new: DataFrame,
                     key=("today", "keyword", "first_url", "crawl_url"), seq_col: str = "seq") -> DataFrame:
    """S10 + W7: last write wins per composite key (one ``max_by`` aggregation, partial before the shuffle)."""
    rows = old.unionByName(new, allowMissingColumns=True)
    other = [c for c in rows.columns if c not in key]
    return (rows.groupBy(*key).agg(F.max_by(F.struct(*other), F.col(seq_col)).alias("_r"))
            .select(*key, *[F.col("_r")[c].alias(c) for c in other]))
