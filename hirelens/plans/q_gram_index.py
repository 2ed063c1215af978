"""Registered queries of the keyword index."""

from __future__ import annotations

from hirelens import fixtures as X
from hirelens.fixtures import with_jobs
from hirelens.plans.catalog import register
from hirelens.session import scratch_path
from hirelens.sources import gram_index as G

KEYWORDS_SQL = "lower(array_to_string(search_keyword, ' '))"
TEXT_SQL = "lower(jobName || ' ' || coalesce(jobDetail, '') || ' ' || coalesce(custName, ''))"


def _find(spark, sf, keywords, field):
    jobs, base = X.jobs_df(spark, sf), scratch_path(spark, "keyword-index")
    G.write_indexed(jobs, base)
    return G.find_containing(spark, base, jobs, keywords, field).select("jobNo", "jobName", "custName", "status")


def _register(name, keywords, field, text):
    condition = " AND ".join(f"contains({text}, '{k.lower()}')" for k in keywords) or "true"

    @register(name, with_jobs(f"SELECT jobNo, jobName, custName, status FROM jobs WHERE {condition}"))
    def query(spark, sf):
        return _find(spark, sf, keywords, field)

    query.__doc__ = f"Postings whose {field} contain {keywords}."


_register("keyword_index_filter", ["Python", "k8s"], "keywords", KEYWORDS_SQL)
_register("keyword_index_across_words", ["n Django"], "keywords", KEYWORDS_SQL)  # the list is one text
_register("keyword_index_text", ["ole-17 2-HI", "#0000001"], "text", TEXT_SQL)  # across name, detail and company
_register("keyword_index_short", ["8", "4-"], "text", TEXT_SQL)
_register("keyword_index_absent", ["no such posting"], "text", TEXT_SQL)
