"""Numeric functions as column expressions: hashes of strings, vectors, TF-IDF, decay and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = 4294967295


def utf8(text: Column) -> Column:
    """The bytes of a text as array<bigint>."""
    raw = F.hex(F.encode(text, "UTF-8"))
    n = F.length(raw)
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))


def _masked(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def _fnv1a(b: Column) -> Column:
    return F.aggregate(b, F.lit(2166136261).cast("bigint"), lambda h, x: _masked(h.bitwiseXOR(x) * F.lit(16777619).cast("bigint")))


def _djb2(b: Column) -> Column:
    return F.aggregate(b, F.lit(5381).cast("bigint"), lambda h, x: _masked(h * 33 + x))


def _murmur(b: Column, length: Column) -> Column:
    m = F.lit(1540483477).cast("bigint")
    h = F.aggregate(
        b, F.lit(2538058380).cast("bigint"),
        lambda a, x: F.transform(F.array(_masked(a.bitwiseXOR(x) * m)), lambda v: v.bitwiseXOR(F.shiftright(v, 15)))[0],
    )
    h = _masked(h.bitwiseXOR(length.cast("bigint")) * m)
    return h.bitwiseXOR(F.shiftright(h, 13))


def hash_fnv1a(text: Column, size: int) -> Column:
    return _fnv1a(utf8(text)) % size


def hash_djb2(text: Column, size: int) -> Column:
    return _djb2(utf8(text)) % size


def hash_murmur(text: Column, size: int) -> Column:
    """A 32-bit multiply-and-shift hash that ends with the text's length; not the one of Spark."""
    return _murmur(utf8(text), F.length(text)) % size


def hash_all(text: Column, size: int) -> Column:
    """The three hashes, from one pass that makes the bytes."""
    return F.transform(F.array(utf8(text)), lambda b: F.array(_fnv1a(b) % size, _murmur(b, F.length(text)) % size, _djb2(b) % size))[0]


def table_size(n: Column, load: float = 0.35, least: int = 4096) -> Column:
    """The least power of two that is ``least`` or more and holds n entries at that load."""
    need = F.floor(n / load)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.lit(least).cast("bigint"), lambda size, _: F.when(size < need, size * 2).otherwise(size)
    )


# ---- vectors


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the elements that both have; null elements count as nothing."""
    return _sum(F.transform(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), lambda v: F.coalesce(v, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: F.coalesce(x * x, F.lit(0.0)))))


def normalized(a: Column) -> Column:
    v = F.array(F.struct(a.cast("array<double>").alias("v"), norm(a).alias("n")))
    return F.transform(v, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is empty or has no length; the longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(x) * norm(y)
    return F.when((n > 0) & (length > 0), dot(x, y) / length).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    gap = F.zip_with(F.slice(a, 1, n).cast("array<double>"), F.slice(b, 1, n).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(_sum(gap))


# ---- weights


def tfidf_score(tf: Column, df: Column, n: Column) -> Column:
    return F.when(df > 0, tf * (F.ln((n + 1) / (df + 1)) + 1)).otherwise(F.lit(0.0))


def tfidf(words: DataFrame, id_col: str, word_col: str) -> DataFrame:
    """(<id>, <word>, tf, df, tfidf) of a table with a row per word of a document."""
    tf = words.where(F.col(word_col).isNotNull()).groupBy(id_col, word_col).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(F.col(word_col).alias("__w")).agg(F.count(F.lit(1)).alias("df"))
    n = words.select(id_col).distinct().agg(F.count(F.lit(1)).alias("__n"))  # one row
    out = tf.join(df, F.col(word_col) == F.col("__w")).crossJoin(F.broadcast(n))
    return out.select(id_col, word_col, "tf", "df", tfidf_score(F.col("tf"), F.col("df"), F.col("__n")).alias("tfidf"))


def moving_average(value: Column, window: int, partition: list, order: list) -> Column:
    """The mean of a value and up to ``window - 1`` before it."""
    return F.avg(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - window, 0))


def exponential_decay(value: Column, age: Column, half_life: float) -> Column:
    return value * F.pow(F.lit(0.5), age / half_life) if half_life > 0 else F.lit(0.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted_average(value: Column, weight: Column) -> Column:
    """An aggregate; 0 where the weights sum to 0."""
    total = F.sum(weight)
    return F.when(total != 0, F.sum(value * weight) / total).otherwise(F.lit(0.0))
