"""The pipeline removes passages of a little over 50 words that two documents share."""

import corpus_pipeline


def test_a_shared_passage_of_51_words_goes(spark, sf):
    shared = " ".join(f"w{k:03d}x" for k in range(51))
    texts = [" ".join(f"{name}{k:03d}" for k in range(120)) for name in ("one", "two", "six")]
    rows = [(1, texts[0] + " " + shared + " end1"), (2, texts[1] + " " + shared + " end2"), (3, texts[2]), (4, None)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    assert 250 < len(shared) < 400
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert shared not in left[1] and shared not in left[2]
    assert left[1].startswith(texts[0][:-3]) and left[2].startswith(texts[1][:-3]) and left[3] == texts[2]
