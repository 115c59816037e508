"""Streams: documents that arrive in a folder into the postings, queries as they come, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chunk as C
from textloom.operators import index as I
from textloom.operators import retrieve as R


def stream_documents(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def append_postings(docs: DataFrame, folder: str, checkpoint: str, config, id_col: str = "doc_id", text_col: str = "text"):
    """Chunk and index each batch; batches that are run again after a failure replace their own files."""
    def write(batch: DataFrame, number: int) -> None:
        chunks = C.chunk(batch, config, text_col, id_col)
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        I.postings(stored, id_col).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_lookup(queries: DataFrame, postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, gram): stream of queries (query_id, query) against static postings."""
    terms = R.query_terms(queries).select("query_id", F.explode("grams").alias("gram"))
    return terms.join(postings, "gram").select("query_id", id_col, "idx", "gram")


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, late: str | None = None, keys: list[str] = ("event_type",)) -> DataFrame:
    """(start, end, keys, n, total) by tumbling or, with ``slide``, sliding event-time windows of a table or stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, keys: list[str] = ("user_id",)) -> DataFrame:
    """(start, end, keys, n) of runs of events with at most that gap between neighbours."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
