"""The quality model learns from every label, however many there are."""

from hirelens.llm import quality_rules

GOOD, BAD = "the quiet river runs past the old mill " * 3, "zxq vvk wpp qqz jjx kkv zzq xxj " * 3


def test_no_label_is_left_out(spark):
    n = 50_400  # more than the 50,000 labels that a fit once stopped at
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    docs = labels.selectExpr("doc_id", f"CASE WHEN quality = 1 THEN '{GOOD}' ELSE '{BAD}' END AS text")
    known = quality_rules.known_labels(labels)
    counts = quality_rules.count_grams(docs, known).selectExpr("sum(raw) AS raw", "sum(target) AS target").first()
    per = [len(quality_rules.grams(t.encode().split())) for t in (BAD, GOOD)]
    assert (counts.raw, counts.target) == (n // 2 * sum(per), n // 2 * per[1])
    model = quality_rules.fit(docs, labels)
    assert quality_rules.score(BAD.encode(), model.table) < model.least <= quality_rules.score(GOOD.encode(), model.table)


def test_labels_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, GOOD), (1, GOOD), (None, GOOD), (2, BAD), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    counts = quality_rules.count_grams(docs, quality_rules.known_labels(labels)).selectExpr("sum(raw) AS raw", "sum(target) AS target").first()
    per = [len(quality_rules.grams(t.encode().split())) for t in (BAD, GOOD)]
    assert (counts.raw, counts.target) == (per[0] + 3 * per[1], 2 * per[1])


def test_few_labels_take_the_join_of_many(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, BAD)], "doc_id long, text string")
    known = quality_rules.known_labels(spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    plan = quality_rules.count_grams(docs, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
