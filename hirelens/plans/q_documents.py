"""Registered queries of filter documents (S8), one per operator or group of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF_SQL, with_jobs
from hirelens.operators import documents as DOC
from hirelens.plans.catalog import register
from hirelens.session import scratch_path
from hirelens.sources import io as IO

#: name -> (filter document, the same condition in SQL)
FILTERS = {
    "find_equal": ({"status": "active", "coIndustryDesc": None}, "status = 'active' AND coIndustryDesc IS NULL"),
    "find_not_equal": ({"coIndustryDesc": {"$ne": "MACHINERY"}, "jobDetail": {"$ne": None}},
                       "coIndustryDesc IS DISTINCT FROM 'MACHINERY' AND jobDetail IS NOT NULL"),
    "find_range": ({"crawl_date": {"$gte": "2001-07-28", "$lt": "2001-08-01"}, "appearDate": {"$gt": "19950101", "$lte": "19971231"}},
                   f"crawl_date >= {AS_OF_SQL} - 5 AND crawl_date < {AS_OF_SQL} - 1 AND appearDate > '19950101' AND appearDate <= '19971231'"),
    "find_in": ({"city": {"$in": ["台北市", "高雄市", None]}, "periodDesc": {"$in": ["不拘", None]}},
                "(city IN ('台北市', '高雄市') OR city IS NULL) AND (periodDesc = '不拘' OR periodDesc IS NULL)"),
    "find_not_in": ({"jobNo": {"$nin": [str(k) for k in range(0, 3000, 7)]}, "applyDesc": {"$nin": ["0~5人應徵"]}, "status": "active"},
                    "CAST(jobNo AS BIGINT) NOT IN (SELECT unnest(range(0, 3000, 7))) AND applyDesc IS DISTINCT FROM '0~5人應徵' AND status = 'active'"),
    "find_or": ({"$or": [{"city": "新竹市"}, {"salaryDesc": {"$regex": "^月薪4"}}, {"$and": [{"optionEdu": "碩士"}, {"cust": ""}]}], "status": "inactive"},
                "(city = '新竹市' OR starts_with(salaryDesc, '月薪4') OR (optionEdu = '碩士' AND cust = '')) AND status = 'inactive'"),
    "find_nor": ({"$nor": [{"salaryDesc": {"$in": ["", None]}}, {"jobDetail": {"$gt": "3"}}, {"district": {"$exists": False}}]},
                 "NOT coalesce(salaryDesc = '' OR salaryDesc IS NULL, false) AND NOT coalesce(jobDetail > '3', false) AND district IS NOT NULL"),
    "find_exists": ({"delisted_date": {"$exists": True}, "salaryDesc": {"$exists": False}, "no_such_field": {"$exists": False}},
                    "delisted_date IS NOT NULL AND salaryDesc IS NULL"),
    "find_regex": ({"jobName": {"$regex": "ROLE-1[0-4]$", "$options": "i"}, "custName": {"$not": {"$regex": "[02468]$"}}},
                   "regexp_matches(lower(jobName), 'role-1[0-4]$') AND NOT coalesce(regexp_matches(custName, '[02468]$'), false)"),
    "find_lists": ({"search_keyword": {"$all": ["Python", "SRE"], "$nin": ["JAVA"], "$not": {"$size": 2}}},
                   "list_has_all(search_keyword, ['Python', 'SRE']) AND NOT list_contains(search_keyword, 'JAVA') AND len(search_keyword) <> 2"),
    "find_elements": ({"search_keyword": {"$elemMatch": {"$gte": "D", "$lt": "K"}, "$regex": "^f"}},
                      "len(list_filter(search_keyword, lambda k: k >= 'D' AND k < 'K')) > 0 AND len(list_filter(search_keyword, lambda k: starts_with(k, 'f'))) > 0"),
}


def _register(name, document, condition):
    @register(name, with_jobs(f"SELECT jobNo, custName, city FROM jobs WHERE {condition}"))
    def query(spark, sf):
        return IO.doc_scan(X.jobs_df(spark, sf), document).select("jobNo", "custName", "city")

    query.__doc__ = f"S8: {document}"


for _name, (_document, _condition) in FILTERS.items():
    _register(_name, _document, _condition)


@register("find_open_fields", with_jobs("""
, f AS (SELECT jobNo, CAST(jobNo AS BIGINT) AS k FROM jobs)
SELECT jobNo FROM f
WHERE k % 4 <> 0 AND k % 9 >= 5 AND (k % 3 = 1 OR k % 4 = 2) AND NOT (k % 5 = 0)"""))
def q_find_open_fields(spark, sf):
    """Fields that only some stored documents have, at paths inside the VARIANT column, and a struct's field."""
    k = F.col("jobNo").cast("long")
    body = F.to_json(F.struct(k.alias("n"), F.struct((k % 9).alias("score"), F.when(k % 4 != 0, F.lit("web")).alias("via")).alias("meta"),
                              F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).alias("tags"),
                              (k % 4 == 2).alias("remote"), F.when(k % 5 == 0, F.lit("x")).otherwise("y").alias("group")))
    stored = scratch_path(spark, "documents")
    X.jobs_df(spark, sf).select("jobNo", F.parse_json(body).alias("doc")).write.parquet(stored)
    rows = spark.read.schema("jobNo string, doc variant").parquet(stored)
    return DOC.find(rows, {"doc.meta.via": {"$exists": True}, "meta.score": {"$gte": 5}, "group": {"$ne": "x"},
                           "$or": [{"tags": "b"}, {"remote": True}]}).select("jobNo")
