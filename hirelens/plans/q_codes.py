"""Registered code-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import with_jobs
from hirelens.plans.catalog import register
from hirelens.session import scratch_path
from hirelens.sources import codes as K

FLAT_SQL = """
WITH flat AS (
  SELECT 'R' || r_regionkey AS code, r_name AS name, 0 AS depth, r_regionkey % 2 = 0 AS is_leaf, 'R' || r_regionkey AS root_no
  FROM region
  UNION ALL
  SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey || '.N' || n_nationkey ELSE 'N' || n_nationkey END,
         n_name, 1, true, 'R' || n_regionkey
  FROM nation)
"""


def _tree_file(spark, sf):
    """Write the table-derived tree as a code-table file with a root node per line."""
    path = scratch_path(spark, "code-file")
    tree = K.tree_from_tables(spark, sf).withColumn("pos", F.substring("no", 2, 9).cast("long"))
    tree.select(F.to_json(F.struct(*tree.columns)).alias("value")).write.text(path)
    return path


def _flat_via_file(spark, sf):
    """Read the file back (S19) and flatten it (H1)."""
    return K.flatten_code_tree(K.read_code_roots(spark, _tree_file(spark, sf)))


@register("code_tree_flat", FLAT_SQL + "SELECT code, name, depth, is_leaf, root_no FROM flat")
def q_code_tree_flat(spark, sf):
    return _flat_via_file(spark, sf).select("code", "name", "depth", "is_leaf", "root_no")


@register("leaf_area_codes", FLAT_SQL + """
SELECT code, name FROM flat WHERE root_no = 'R1' AND depth > 0 AND is_leaf
  AND (contains(name, 'NATION_1') OR contains(name, 'NATION_2'))""")
def q_leaf_area_codes(spark, sf):
    return K.leaf_area_codes(_flat_via_file(spark, sf), "R1", ["NATION_1", "NATION_2"])


@register("code_search", FLAT_SQL + "SELECT code, name FROM flat WHERE contains(lower(name), 'nation_1')")
def q_code_search(spark, sf):
    return K.code_search(_flat_via_file(spark, sf), "NATION_1")


@register("code_table_load", FLAT_SQL + "SELECT code, name FROM flat")
def q_code_table_load(spark, sf):
    return K.load_code_table(spark, _tree_file(spark, sf), "area", layout="roots")


# ---- the same operators on an adjacency table of growing size (brands, types, parts; regions, nations, suppliers)

FOREST_SQL = """
WITH b AS (SELECT p_brand AS brand, min(p_partkey) AS first FROM part GROUP BY 1),
t AS (SELECT p_brand AS brand, p_type AS type, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
flat AS (
  SELECT brand AS code, brand AS name, 0 AS depth, NOT EXISTS (SELECT 1 FROM b x WHERE x.brand = b.brand AND first % 2 = 1) AS is_leaf,
         brand AS root_no, false AS via_children FROM b
  UNION ALL
  SELECT brand || '.' || type, type, 1, NOT EXISTS (SELECT 1 FROM part p WHERE p_brand = brand AND p_type = type AND p_partkey % 2 = 0),
         brand, true FROM t JOIN b USING (brand) WHERE first % 2 = 0
  UNION ALL
  SELECT type, type, 1, NOT EXISTS (SELECT 1 FROM part p WHERE p_brand = brand AND p_type = type AND p_partkey % 2 = 0), brand, false
  FROM t JOIN b USING (brand) WHERE first % 2 = 1 QUALIFY row_number() OVER (PARTITION BY type ORDER BY first DESC, pos DESC) = 1
  UNION ALL
  SELECT CASE WHEN p_partkey % 3 = 0 THEN p_type || '-' || p_partkey WHEN p_partkey % 2 = 1 THEN p_type || '.P' || p_partkey ELSE 'P' || p_partkey END,
         p_name, 2, true, p_brand, first % 2 = 0 OR p_partkey % 2 = 1
  FROM part JOIN b ON p_brand = brand
  UNION ALL
  SELECT 'R' || r_regionkey, r_name, 0, r_regionkey % 2 = 0 OR r_regionkey NOT IN (SELECT n_regionkey FROM nation), 'R' || r_regionkey, false FROM region
  UNION ALL
  SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey || '.N' || n_nationkey ELSE 'N' || n_nationkey END, n_name, 1,
         n_nationkey NOT IN (SELECT s_nationkey FROM supplier), 'R' || n_regionkey, n_regionkey % 2 = 0 FROM nation
  UNION ALL
  SELECT 'S' || s_suppkey, s_name, 2, true, 'R' || n_regionkey, n_regionkey % 2 = 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def _forest(spark, sf):
    return K.flatten_adjacency(K.adjacency_from_tables(spark, sf))


@register("code_adjacency_flat", FOREST_SQL + "SELECT * FROM flat")
def q_code_adjacency_flat(spark, sf):
    return _forest(spark, sf).drop("path")


@register("code_adjacency_leaves", FOREST_SQL + """
SELECT code, name FROM flat WHERE root_no = 'R1' AND depth > 0 AND NOT via_children AND is_leaf
  AND (contains(name, '7') OR contains(name, '3'))""")
def q_code_adjacency_leaves(spark, sf):
    return K.leaf_area_codes(_forest(spark, sf), "R1", ["7", "3"])


@register("code_adjacency_search", FOREST_SQL + "SELECT code, name FROM flat WHERE contains(lower(name), 'red')")
def q_code_adjacency_search(spark, sf):
    return K.code_search(_forest(spark, sf), "Red")


@register("code_adjacency_load", FOREST_SQL + "SELECT code, name FROM flat")
def q_code_adjacency_load(spark, sf):
    """Written as a code table with a node per line, read back and flattened."""
    path = scratch_path(spark, "code-nodes")
    K.adjacency_from_tables(spark, sf).write.json(path)
    return K.load_code_table(spark, path, "area", layout="adjacency")


AREA_VALUES = ("(VALUES ('6001001000', '台北市', 0), ('6001002000', '新北市', 1), ('6001005000', '桃園市', 2), "
               "('6001006000', '新竹市', 3), ('6001007000', '新竹縣', 4), ('6001008000', '台中市', 5), "
               "('6001016000', '台南市', 6), ('6001017000', '高雄市', 7)) t(code, name, ordinal)")


@register("code_lookup", with_jobs(f""", area AS (SELECT * FROM {AREA_VALUES})
SELECT jobs.jobNo, jobs.jobAddrNo, a1.name AS area_name, jobs.city, a2.code AS city_code
FROM jobs LEFT JOIN area a1 ON jobs.jobAddrNo = a1.code LEFT JOIN area a2 ON jobs.city = a2.name"""))
def q_code_lookup(spark, sf):
    codes = K.builtin_codes(spark, "area")
    jobs = X.jobs_df(spark, sf).select("jobNo", "jobAddrNo", "city")
    out = K.code_to_name(jobs, "jobAddrNo", codes, "area_name")
    return K.name_to_code(out, "city", codes, "city_code")


def _values(kind):
    return ", ".join(f"('{kind}', '{code}', '{name}')" for code, name in K.BUILTIN[kind])


@register("builtin_codes", with_jobs(f""", dict AS (
  SELECT * FROM (VALUES {_values("area")}, {_values("job_cat")}, {_values("industry")}) t(kind, code, name))
SELECT kind, dict.code, dict.name, count(jobs.jobNo) AS postings, count(DISTINCT jobs.city) AS cities
FROM dict LEFT JOIN jobs ON jobs.jobAddrNo = dict.code OR jobs.coIndustryDesc = dict.name
GROUP BY ALL"""))
def q_builtin_codes(spark, sf):
    """H4: all three dictionaries, joined to the postings by code or by industry name."""
    codes = None
    for kind in ("area", "job_cat", "industry"):
        own = K.builtin_codes(spark, kind).select(F.lit(kind).alias("kind"), "code", "name")
        codes = own if codes is None else codes.unionByName(own)
    jobs = X.jobs_df(spark, sf).select("jobNo", "city", "jobAddrNo", "coIndustryDesc")
    keyed = jobs.select("jobNo", "city", F.explode(F.array(
        F.struct(F.lit("code").alias("by"), F.col("jobAddrNo").alias("key")),
        F.struct(F.lit("name").alias("by"), F.col("coIndustryDesc").alias("key")))).alias("k")).select("jobNo", "city", "k.*")
    both = codes.select("*", F.explode(F.array(F.struct(F.lit("code").alias("by"), F.col("code").alias("key")),
                                               F.struct(F.lit("name").alias("by"), F.col("name").alias("key")))).alias("k")) \
        .select("kind", "code", "name", "k.*")
    return both.join(keyed, ["by", "key"], "left").groupBy("kind", "code", "name").agg(
        F.countDistinct("jobNo").alias("postings"), F.countDistinct("city").alias("cities"))
