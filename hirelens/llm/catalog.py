"""One registered query per operator, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm import (
    exact_dedup,
    gru_lm,
    jaccard_join,
    lexical_search,
    mixing,
    nn_descent,
    packing,
    quality_rules,
    rans,
    spelling,
    suffix_index,
    url_templates,
    warc,
)
from hirelens.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_templates": lambda s, d: url_templates.op1_query(table(s, d, "pages"), table(s, d, "labels")),
        "op2_quality_llr": lambda s, d: quality_rules.op2_query(table(s, d, "documents"), table(s, d, "labels")),
        "op3_jaccard_join": lambda s, d: jaccard_join.op3_query(table(s, d, "documents")),
        "op4_nn_descent": lambda s, d: nn_descent.op4_query(table(s, d, "embeddings")),
        "op5_gru_lm": lambda s, d: gru_lm.op5_query(table(s, d, "documents")),
        "op6_warc": lambda s, d: warc.op6_query(table(s, d, "pages")),
        "op7_rans_ids": lambda s, d: rans.op7_query(table(s, d, "documents")),
        "op8_best_fit_packing": lambda s, d: packing.op8_query(table(s, d, "documents")),
        "op9_mixing": lambda s, d: mixing.op9_query(table(s, d, "documents")),
        "op10_suffix_index": lambda s, d: suffix_index.op10_query(table(s, d, "documents")),
        "op11_geometric_blocks": lambda s, d: lexical_search.op11_query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_reduced_spelling": lambda s, d: spelling.op12_query(table(s, d, "documents")),
        "op13_exact_mph": lambda s, d: exact_dedup.op13_query(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.SQL, "op9_mixing": mixing.SQL, "op11_geometric_blocks": lexical_search.SQL,
            "op13_exact_mph": exact_dedup.SQL}
