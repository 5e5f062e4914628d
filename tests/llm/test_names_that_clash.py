"""A caller's columns with names that operators use inside come out with their values."""

import corpus_pipeline
from tessera.llm import language_id as L
from tessera.llm import license_scan as Z
from tessera.llm import quality_rules as Q
from tessera.llm import substring_dedup as D


def test_own_columns_keep_their_values(spark):
    rows = [(i, t, f"mine {i}", i * 10, [i], "x") for i, t in enumerate(["some words of a text", "", None, "again again again again"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, _w int, _lines array<int>, _canon string")
    want = sorted(rows, key=repr)
    for out in (Q.measures(docs), Q.apply(docs), Z.scan(docs)):
        assert sorted((tuple(r) for r in out.select(*docs.columns).collect()), key=repr) == want
    assert {r.doc_id: r.n_words for r in Q.measures(docs).collect()} == {0: 5, 1: 0, 2: 0, 3: 4}
    assert Q.measures(docs.withColumnRenamed("text", "body").withColumnRenamed("_t", "text").withColumnRenamed("body", "_t"), "_t").where("doc_id = 0").first()["n_words"] == 5


def test_filtering_stages_keep_values_of_own_columns(spark, tmp_path):
    text = "the quick brown fox jumps over a lazy dog and comes back again for more"
    rows = [(i, f"{text} {i} {chr(97 + i) * 6}", lang, "s", 0, 77 + i, "mine", i / 4) for i, lang in enumerate(["en", "de", "en", "de"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, _pred string, _score double")
    names = ["doc_id", "n_removed", "_pred", "_score"]
    want = sorted(tuple(r[n] for n in names) for r in docs.collect())
    for out in (L.identified(docs, L.fit(docs)), D.deduplicated(docs, removed="gone").drop("gone"), corpus_pipeline.without_repeats(spark, docs, str(tmp_path))):
        assert out.columns == docs.columns or set(out.columns) == set(docs.columns)
        assert sorted(tuple(r[n] for n in names) for r in out.collect()) == want
