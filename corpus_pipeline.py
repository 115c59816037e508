"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of the
``documents`` table; the last returns the packed sequences. Between stages the documents are written as
Parquet to the shared checkpoint folder and read again, so that no stage is computed twice and a lost
executor costs only its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import langid, line_dedup, ngram_join, packing, quality
from textloom.llm.common import cut, fresh, maybe_broadcast, row_key, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (9): documents without words go, those of which no known language has a fair share, and those whose
    n-grams are unfamiliar to all known languages. Null and empty texts have no words; repeated rows are judged alike."""
    model = langid.train(docs)
    return langid.identify(docs, model, with_runs=False).where("accepted").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (8), fitted on the labelled documents among the stage's own: bad ones go.

    Repeated rows are judged alike; null and empty texts get the score of a text that neither dictionary explains."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).where("keep").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (1): later runs of lines go, and documents of which nothing is left.

    ``n_chars`` becomes the length of the new text. Null texts stay; rows that repeat both id and text lose the same lines.
    """
    rest = line_dedup.line_dedup(docs).where((F.col("removed_lines") == 0) | (F.trim(F.col("text")) != ""))
    changed = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", changed).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (7): of each group of near duplicates the document of the least id stays.

    Rows that repeat both id and text are one document to the join: one of them stays, that of the least
    hash of all columns. Rows without text are left as they are. To find repeated rows only keys shuffle; the texts of
    other rows do so only if the keys are too many to be broadcast.
    """
    key, nth = fresh(docs, "key", "nth")
    name = row_key("doc_id", "text")
    twice = cut(docs.where("text is not null").select(name.alias(key)).groupBy(key).count().where("count > 1").select(key))
    twice = maybe_broadcast(twice, twice.count(), 48, ngram_join.BROADCAST_BYTES)
    rest = ngram_join.near_duplicates_removed(docs).withColumn(key, name)
    again = rest.join(twice, key, "left_semi")  # texts only, as keys of texts are; the other join can reuse its shuffle
    order = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    first = again.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    single = rest.join(twice, key, "left_anti")
    return single.unionByName(first.drop(nth)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (4): which words of which documents each training sequence holds."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("best-fit packing", packed),
]

# Fitted models and sequential packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:  # nothing reads what the stage before wrote any more
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
