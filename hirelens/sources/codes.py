"""Code tables: H1–H4, J12, S19.

A code tree (area / job category / industry) is a nested JSON document of
nodes ``{no, des, n: [...], children: [...]}`` of any depth.  Each level is
parsed from the JSON text of the one above.

A large tree comes as an adjacency table instead, one row per node with the id
of its parent, and is flattened by a recursive query: no task or row ever holds
a subtree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions.literals import literal_frame
from hirelens.session import scratch_path

BUILTIN = {"area": C.BUILTIN_AREA_CODES, "job_cat": C.BUILTIN_JOB_CAT_CODES, "industry": C.BUILTIN_INDUSTRY_CODES}

#: One level of a tree; the lists below it stay JSON text until their level is read.
NODE = "no string, des string, n string, children string"


def read_code_tree(spark: SparkSession, path: str) -> DataFrame:
    """Root nodes of code-table files: a JSON array of nodes, or an object that holds it as ``data``."""
    files = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<struct<{NODE.replace(' ', ':')}>>".replace(",:", ","))
    wrapped = F.from_json("value", f"struct<data:array<struct<{NODE.replace(' ', ':')}>>>".replace(",:", ","))
    roots = F.when(F.ltrim("value").startswith("{"), wrapped["data"]).otherwise(plain)
    return files.select(F.posexplode(roots).alias("pos", "node")).select("pos", "node.*")


def read_code_roots(spark: SparkSession, path: str) -> DataFrame:
    """Root nodes of code-table files with one root node per line, which Spark splits; ``pos`` is the root's ``pos`` field."""
    kind = f"struct<pos:bigint,{NODE.replace(' ', ':')}>".replace(",:", ",").replace(", ", ",")
    return spark.read.text(path).select(F.from_json("value", kind).alias("node")).select("node.*")


#: A node of an adjacency table; ``via`` is the parent's list that holds it, ``pos`` its place there.
ADJACENCY = "id string, parent string, via string, pos long, no string, des string"


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """A code table as JSON lines, one node each."""
    return spark.read.schema(ADJACENCY).json(path)


def _deduplicated(rows: DataFrame) -> DataFrame:
    """The last node of each code in depth-first order; its path says where that is."""
    return rows.groupBy("code").agg(F.max_by(F.struct(
        "name", "depth", "is_leaf", "root_no", "via_children", "path"), "path").alias("r")).select("code", "r.*")


def flatten_adjacency(nodes: DataFrame, max_depth: int = 100) -> DataFrame:
    """H1 on an adjacency table (``ADJACENCY``): the same rows as ``flatten_code_tree`` gives for the nested tree.

    Nodes whose ancestors don't lead to a root are unreachable and give no rows;
    a cycle below a root, or a tree deeper than ``max_depth``, is an error.  The
    walk is written to the shared folder, so it runs once.
    """
    spark = nodes.sparkSession
    path, rows = scratch_path(spark, "code-walk"), "spark.sql.cteRecursionRowLimit"
    limit = spark.conf.get(rows)
    spark.conf.set(rows, "-1")  # the table may have any number of nodes
    try:
        spark.sql(f"""
            WITH RECURSIVE walk(id, no, des, up, root_no, via_children, path, depth) MAX RECURSION LEVEL {int(max_depth)} AS (
              SELECT id, no, des, '', no, false, array(pos), 0 FROM {{nodes}} WHERE parent IS NULL
              UNION ALL
              SELECT n.id, n.no, n.des, if(n.via = 'children', coalesce(w.no, ''), ''), w.root_no,
                     w.via_children OR n.via = 'children', concat(w.path, array(if(n.via = 'children', 0L, 1L), n.pos)), w.depth + 1
              FROM walk w JOIN {{nodes}} n ON n.parent = w.id)
            SELECT * FROM walk""", nodes=nodes).write.parquet(path)
    finally:
        spark.conf.set(rows, limit)
    walk = spark.read.parquet(path)
    inner = nodes.where(F.col("via") == "n").select(F.col("parent").alias("id")).distinct().withColumn("has_n", F.lit(True))
    code, up = F.col("no"), F.col("up")
    full = F.when((up == "") | code.startswith(up), code).otherwise(F.concat(up, F.lit("."), code))
    return _deduplicated(walk.join(inner, "id", "left").where((code != "") & (F.col("des") != "")).select(
        full.alias("code"), F.col("des").alias("name"), "depth", F.col("has_n").isNull().alias("is_leaf"), "root_no",
        "via_children", "path"))


def adjacency_of(tree: DataFrame) -> DataFrame:
    """Adjacency rows of a nested tree, level by level; ids are the nodes' places in it."""
    return _levels(tree).select(
        F.array_join("path", "/").alias("id"),
        F.when(F.size("path") > 1, F.array_join(F.slice("path", F.lit(1), F.size("path") - 2), "/")).alias("parent"),
        F.when(F.size("path") > 1, F.when(F.element_at("path", -2) == 0, "children").otherwise("n")).alias("via"),
        F.element_at("path", -1).alias("pos"), F.col("node.no").alias("no"), F.col("node.des").alias("des"))


def flatten_code_tree(tree: DataFrame) -> DataFrame:
    """H1: code -> name over every node of the tree, of any depth.

    A child reached through ``children`` gets ``parent.child`` unless its code
    already starts with the parent's code; a child under ``n``, or under a
    parent without code, keeps its code.  Nodes without code or name are
    skipped; for a duplicate code the last node in depth-first order wins.
    Output: code, name, depth, is_leaf (no ``n`` children), root_no,
    via_children, path.

    """
    rows = _levels(tree)
    kind = f"array<struct<{NODE.replace(' ', ':')}>>".replace(",:", ",")
    leaf = F.size(F.coalesce(F.from_json("node.n", kind), F.array().cast(kind))) == 0
    code, up = F.col("node.no"), F.col("parent_no")
    full = F.when((up == "") | code.startswith(up), code).otherwise(F.concat(up, F.lit("."), code))
    return _deduplicated(rows.where((code != "") & (F.col("node.des") != "")).select(
        full.alias("code"), F.col("node.des").alias("name"), "depth", leaf.alias("is_leaf"), "root_no", "via_children", "path"))


def _levels(tree: DataFrame) -> DataFrame:
    """All nodes of a nested tree with their path, depth and root.

    Each level is one explode over both lists, written before the next one
    starts, until a level has no node; the files are read once.
    """
    kind = f"array<struct<{NODE.replace(' ', ':')}>>".replace(",:", ",")
    empty = F.array().cast(kind)

    def below(field: str):
        return F.coalesce(F.from_json(F.col(f"node.{field}"), kind), empty)

    def numbered(field: str, number: int):
        return F.transform(below(field), lambda c, i: F.struct(
            c.alias("node"), F.lit(number).cast("long").alias("kind"), i.cast("long").alias("at")))

    level = tree.select(F.struct("no", "des", "n", "children").alias("node"), F.lit("").alias("parent_no"),
                        F.col("no").alias("root_no"), F.lit(False).alias("via_children"),
                        F.array(F.col("pos").cast("long")).alias("path"), F.lit(0).alias("depth"))
    levels = []
    while True:
        path = scratch_path(tree.sparkSession, "code-level")
        level.write.parquet(path)
        level = tree.sparkSession.read.schema(level.schema).parquet(path)
        if level.isEmpty():
            break
        levels.append(level)
        kids = F.concat(numbered("children", 0), numbered("n", 1))
        level = level.select(F.explode(kids).alias("kid"), F.coalesce("node.no", F.lit("")).alias("up"), "root_no",
                             F.col("via_children").alias("via"), "path", "depth").select(
            "kid.node", F.when(F.col("kid.kind") == 0, F.col("up")).otherwise("").alias("parent_no"), "root_no",
            (F.col("via") | (F.col("kid.kind") == 0)).alias("via_children"),
            F.concat("path", F.array("kid.kind", "kid.at")).alias("path"), (F.col("depth") + 1).alias("depth"))

    rows = levels[0] if levels else level
    for more in levels[1:]:
        rows = rows.unionByName(more)
    return rows


def leaf_area_codes(flat: DataFrame, root_code: str = C.TAIWAN_AREA_ROOT,
                    substrings=tuple(C.TARGET_CITY_SUBSTRINGS)) -> DataFrame:
    """H2: leaf codes under a root (reached through ``n``) whose name contains a target substring."""
    pred = F.lit(False)
    for s in substrings:
        pred = pred | F.col("name").contains(s)
    return flat.where((F.col("root_no") == root_code) & (F.col("depth") > 0) & ~F.col("via_children")
                      & F.col("is_leaf") & pred).select("code", "name")


def code_search(flat: DataFrame, keyword: str) -> DataFrame:
    """H3: case-insensitive substring search in code names."""
    return flat.where(F.lower("name").contains(keyword.lower())).select("code", "name")


def builtin_codes(spark: SparkSession, kind: str = "area") -> DataFrame:
    """H4: built-in code dictionary as a DataFrame (code, name, ordinal)."""
    return literal_frame(spark, [(c, n, i) for i, (c, n) in enumerate(BUILTIN[kind])],
                         [("code", "string"), ("name", "string"), ("ordinal", "int")])


def load_code_table(spark: SparkSession, path: str | None, kind: str = "area", layout: str = "document") -> DataFrame:
    """Read a code-tree JSON file and flatten it; the built-in
    dictionary is used when there is no file or the file yields no code.

    ``layout``: ``document`` (a whole tree per file), ``roots`` (a root node per
    line) or ``adjacency`` (a node per line).
    """
    builtin = builtin_codes(spark, kind).select("code", "name")
    if not path:
        return builtin
    if layout == "adjacency":
        flat = flatten_adjacency(read_adjacency(spark, path))
    else:
        flat = flatten_code_tree((read_code_roots if layout == "roots" else read_code_tree)(spark, path))
    flat = flat.select("code", "name")
    n = flat.select(F.count(F.lit(1))).scalar()
    return flat.unionByName(builtin.where(n == 0))


def code_to_name(df: DataFrame, code_col: str, codes: DataFrame, out: str = "code_name") -> DataFrame:
    """Code -> name (left join; unknown codes give NULL)."""
    dim = codes.select(F.col("code").alias(code_col), F.col("name").alias(out))
    return df.join(dim, code_col, "left")


def name_to_code(df: DataFrame, name_col: str, codes: DataFrame, out: str = "code") -> DataFrame:
    """J12 reverse: name -> first code with that name (by ordinal)."""
    order = F.col("ordinal") if "ordinal" in codes.columns else F.col("code")
    dim = codes.groupBy(F.col("name").alias(name_col)).agg(F.min_by("code", order).alias(out))
    return df.join(dim, name_col, "left")


def adjacency_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test forest of growing tables: brand -> type -> part, and region -> nation -> supplier.

    Types sit under ``children`` of brands with even first part and under ``n``
    of the others (so the same type code comes from several brands), odd parts
    under ``children``; every third part's code begins with its type.
    """
    def tbl(t):
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")

    def node(kind, parent, via, pos, no, des):
        return [kind.alias("id"), parent.cast("string").alias("parent"), via.cast("string").alias("via"),
                pos.cast("long").alias("pos"), no.alias("no"), des.alias("des")]

    key, brand, type_ = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    part, none = tbl("part"), F.lit(None)
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    types = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos")).join(first, "p_brand")
    type_id = F.concat(brand, F.lit("/"), type_)
    region, nation, supplier = tbl("region"), tbl("nation"), tbl("supplier")
    list_of = lambda even: F.when(even, "children").otherwise("n")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (first.select(*node(brand, none, none, F.col("first"), brand, brand))
            .unionByName(types.select(*node(type_id, brand, list_of(F.col("first") % 2 == 0), F.col("pos"), type_, type_)))
            .unionByName(part.select(*node(
                name("part ", "p_partkey"), type_id, list_of(key % 2 == 1), key,
                F.concat(F.when(key % 3 == 0, F.concat(type_, F.lit("-"))).otherwise("P"), key.cast("string")), F.col("p_name"))))
            .unionByName(region.select(*node(name("R", "r_regionkey"), none, none, F.col("r_regionkey"), name("R", "r_regionkey"), F.col("r_name"))))
            .unionByName(nation.select(*node(name("N", "n_nationkey"), name("R", "n_regionkey"), list_of(F.col("n_regionkey") % 2 == 0),
                                             F.col("n_nationkey"), name("N", "n_nationkey"), F.col("n_name"))))
            .unionByName(supplier.select(*node(name("S", "s_suppkey"), name("N", "s_nationkey"), F.lit("n"), F.col("s_suppkey"),
                                               name("S", "s_suppkey"), F.col("s_name")))))


def tree_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test tree from region -> nation: nations sit under ``children`` for even
    regions (so their codes get the parent prefix) and under ``n`` for odd ones.
    """
    def tbl(t):
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")

    nation = tbl("nation").select(
        "n_regionkey", F.struct(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("no"),
                                F.col("n_name").alias("des"),
                                F.lit(None).cast("string").alias("n"),
                                F.lit(None).cast("string").alias("children")).alias("node"),
        F.col("n_nationkey"))
    per_region = nation.groupBy("n_regionkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "node"))), lambda e: e["node"]).alias("kids"))
    region = tbl("region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    even = F.col("r_regionkey") % 2 == 0
    empty = F.array().cast(per_region.schema["kids"].dataType)
    return region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("no"),
                         F.col("r_name").alias("des"),
                         F.when(even, empty).otherwise(F.coalesce("kids", empty)).alias("n"),
                         F.when(even, F.coalesce("kids", empty)).otherwise(empty).alias("children"))
