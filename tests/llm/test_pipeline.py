"""The pipeline as a whole on the smallest tables, and each stage on what it gets."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from textloom.llm import ngram_join

SF = "/root/testdata/sf0.001"


def test_pipeline_and_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in cp.STAGES] == [
        "language ID", "quality classifier", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if i < 4:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > 0.95 * sizes[0] and sizes[1] > sizes[2] > 0.8 * sizes[1] and sizes[3] > sizes[4] > 0
    words = before.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert docs.agg(F.sum("length")).first()[0] == words
    whole = cp.run(spark, SF)
    assert whole.exceptAll(docs).count() == 0 and docs.exceptAll(whole).count() == 0


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "f g h i"), (3, None), (3, None), (4, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.without_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 3]


@pytest.mark.parametrize("limit", [ngram_join.BROADCAST_BYTES, 0])
def test_near_duplicates_leave_texts_where_they_are(spark, monkeypatch, limit):
    """Whether texts shuffle is planned from counts; it is not left to which of Spark's stages ends first."""
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", limit)
    rows = [(i, f"w{i} x{i} y{i} z{i}") for i in range(40)] + [(i, f"w{i} x{i} y{i} z{i}") for i in range(0, 40, 4)]
    rows += [(100, "w1 x1 y1 z1"), (101, None), (101, None), (None, None), (102, ""), (None, "a b c d"), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.without_near_duplicates(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [r.doc_id for r in out.collect()]
        final = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got, key=lambda i: (i is None, i)) == [*range(40), 101, 101, 102, None, None]
    if limit:
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4
    else:
        assert "SortMergeJoin" in plan and "ReusedExchange" in final
