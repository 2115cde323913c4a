"""The near-duplicate stage of the pipeline links by SimHash as well as by sets of shingles."""

import corpus_pipeline


def test_simhash_links_texts_whose_sets_differ(spark):
    phrase = "one two three four five six seven"
    texts = [" ".join([phrase] * 120 + [f"tail{i}x{k}" for k in range(12)]) for i in range(2)]
    texts += [texts[1] + " more", " ".join(f"other{k}" for k in range(60)), None, " ".join(f"other{k}" for k in range(60)) + " end"]
    rows = [(10 * (i + 1), t, "s", "en") for i, t in enumerate(texts)] + [(60, texts[5], "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [10, 40, 50]
