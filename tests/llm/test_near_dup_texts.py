"""Whole texts are sent to other tasks only where rows share an id."""

import corpus_pipeline


def test_unique_ids_send_no_text(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "s", 6) for k in range(20)] + [(None, "n", "en", "s", 1)]
    write = lambda rows, name: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name))
    write(rows, "unique")
    one = corpus_pipeline.one_row_an_id(spark.read.parquet(str(tmp_path / "unique")))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in one.collect()) == list(range(20))
    write([*rows, (3, "other", "en", "s", 5), (3, "third", "en", "s", 5)], "repeated")
    again = corpus_pipeline.one_row_an_id(spark.read.parquet(str(tmp_path / "repeated")))
    assert sorted(r["doc_id"] for r in again.collect()) == list(range(20))
