"""Columns of any type and name pass through; repeated ids count once."""

import corpus_pipeline
from cobblestone.llm import minhash_dedup, mixing, toxicity

WORDS = "one two three four five six seven eight nine ten".split()


def test_map_columns_are_mixed(spark):
    rows = [(i % 30, "a b c", "s%d" % (i % 3), {"k": i % 2}) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m map<string,int>")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 60 and all(r.m in ({"k": 0}, {"k": 1}) and r.size == 3 for r in got)


def test_map_columns_pass_through_the_stages(spark, tmp_path):
    rows = [(i, " ".join(WORDS[j % 10] + str(i // 2) for j in range(40)), "s", i % 2, {"k": i % 2}) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int, m map<string,int>")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 4, 6] and all(r.m == {"k": 0} for r in kept)
    assert len(corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()) == 8


def test_rows_of_one_id_and_text_but_another_source_leave_one_by_their_hash(spark, tmp_path):
    text = " ".join(WORDS * 3)
    rows = [(1, text, "b", 1), (1, text, "a", 1), (1, text, "c", 1)]
    kind = "doc_id bigint, text string, source string, n_chars int"
    left = {corpus_pipeline.near_duplicates(spark, spark.createDataFrame(part, kind), str(tmp_path)).first().source for part in (rows, rows[::-1])}
    assert len(left) == 1


def test_an_id_that_documents_share_is_learnt_from_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad word" if i < 20 else "good word") for i in range(40)] + [(3, "bad word again")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] * 2, "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows.num_rows))
    toxicity.train(docs, labels)
    used = labels.where(~toxicity.held_out()).select("doc_id").distinct().count()
    assert seen == [used]


def test_words_that_polynomials_confuse_differ(spark):
    a = "a"
    b = "b"
    for _ in range(11):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert {r.component_id for r in minhash_dedup.linked(docs).collect()} == {1, 2}
