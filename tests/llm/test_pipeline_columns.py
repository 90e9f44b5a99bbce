"""Columns of documents that bear the stages' own names pass through as they are."""

import corpus_pipeline

NAMES = ["__score", "__kept", "leaks", "secret_spans", "__secrets_id", "__secrets_mask", "leaks_0"]


def test_columns_with_clashing_names_pass_through(spark, sf):
    rows = [(1, "password=abcdef12 and more", "en", "s", 26, *NAMES), (2, "quiet words of another kind", "en", "s", 27, *NAMES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert [[r[n] for n in NAMES] for r in out.collect()] == [NAMES, NAMES], name
