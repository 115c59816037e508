"""Vectors: exact and hashed nearest neighbours for batches of queries, and embedders."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.plans.shared import cut

BLOCK_ROWS = 1 << 13
BLOCK_VALUES = 1 << 22
TILE_QUERIES, TILE_VECTORS = 256, 1 << 13
EXACT_PAIRS = 1 << 33


def with_norms(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(<id>, v, norm): vectors as doubles, without null, empty and zero ones."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(id_col, v.alias("v")).where(F.size("v") > 0).withColumn("norm", M.norm(F.col("v"))).where("norm > 0")


def vector_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = None, query_id: str = "query_id", query_col: str = "vector",
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, <id>, score, rank): for every query the k vectors with the greatest cosine, of at least ``threshold``.

    Exact: every query meets every vector, in blocks of both. Scores equal to nine digits are in order of id. Vectors of
    other dimensions are compared over the elements that both have.
    """
    found = block_search(queries, vectors, k, query_id, query_col, id_col, vec_col)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def by_size(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each number of dimensions."""
    lists = column.combine_chunks()
    flat, length = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    begin, out = np.cumsum(length) - length, []
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        out.append((rows, flat[begin[rows][:, None] + np.arange(n)]))
    return out


def unit32(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.divide(m, norm[:, None], out=np.zeros(m.shape), where=norm[:, None] > 0).astype(np.float32)


def slack32(dim: int) -> float:
    """More than the scalar product of two unit vectors of single precision can be wrong by."""
    return (dim + 8) * 2.0**-23


def last_of(row: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of the k-th greatest value of each row that has so many."""
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    at = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
    return row[at], value[at]


def nearest(qm: np.ndarray, vm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the k nearest rows of ``vm`` to each row of ``qm``, with all that are equal to the last to nine digits.

    Tiles are compared in single precision; what may be among the best is scored in double precision. Rows with elements
    that are not finite are scored in double precision alone, NaN being the greatest.
    """
    qn, vn = (np.linalg.norm(m, axis=1) for m in (qm, vm))
    fast = bool(np.isfinite(qn).all() and np.isfinite(vn).all())
    qf, vf = (unit32(m, n) for m, n in ((qm, qn), (vm, vn))) if fast else (None, None)
    slack, out = 2 * slack32(qm.shape[1]), []
    for at in range(0, len(qm), TILE_QUERIES):
        q, n = qm[at : at + TILE_QUERIES], qn[at : at + TILE_QUERIES]
        low = np.full(len(q), -np.inf)
        i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for to in range(0, len(vm), TILE_VECTORS):
            if fast:
                score = qf[at : at + TILE_QUERIES] @ vf[to : to + TILE_VECTORS].T
            else:
                length = n[:, None] * vn[to : to + TILE_VECTORS]
                score = np.divide(q @ vm[to : to + TILE_VECTORS].T, length, out=np.zeros_like(length), where=length != 0)
                score = np.where(np.isnan(score), np.inf, score)
            if to == 0 and k < score.shape[1]:
                low = np.partition(score, -k, axis=1)[:, -k].astype(float) - slack
            x, y = np.nonzero(score >= low[:, None].astype(score.dtype))
            i, j, s = np.concatenate([i, x]), np.concatenate([j, y + to]), np.concatenate([s, score[x, y]])
            rows, least = last_of(i, s, k)
            low[rows] = np.maximum(low[rows], least - slack)
            keep = s >= low[i]
            i, j, s = i[keep], j[keep], s[keep]
        if not len(i):
            continue
        length = n[i] * vn[j]
        exact = np.divide(np.einsum("ij,ij->i", q[i], vm[j]), length, out=np.zeros(len(i)), where=length != 0)
        rank = np.where(np.isnan(exact), np.inf, np.round(exact, 9))
        low = np.full(len(q), -np.inf)
        rows, least = last_of(i, rank, k)
        low[rows] = least
        keep = rank >= low[i]
        out.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, float)))


def best_of_group(k: int):
    """Of a group (asks, q, i, v): (q, i, score) of the k nearest vectors to each that asks."""
    def best(group: pa.Table) -> pa.Table:
        asks, has = group.filter(group["asks"]), group.filter(pc.invert(group["asks"]))
        x, y, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for left, qm in by_size(asks["v"]):
            for right, vm in by_size(has["v"]):
                n = min(qm.shape[1], vm.shape[1])
                i, j, score = nearest(qm[:, :n].astype(float), vm[:, :n].astype(float), k)
                x.append(left[i])
                y.append(right[j])
                s.append(score)
        x, y = pa.array(np.concatenate(x)), pa.array(np.concatenate(y))
        return pa.table({"q": asks["q"].take(x), "i": has["i"].take(y), "score": pa.array(np.concatenate(s))})

    return best


def sides(queries: DataFrame, vectors: DataFrame, query_id: str, query_col: str, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(asks, q, i, v) of queries and of vectors; elements as they are, null ones being 0."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    made = []
    for df, own, col, asks in ((queries, query_id, query_col, True), (vectors, id_col, vec_col, False)):
        kind = "array<float>" if df.schema[col].dataType.simpleString() == "array<float>" else "array<double>"
        v = F.col("__v")
        rows = df.select(F.col(own).alias("__id"), F.col(col).cast(kind).alias("__v"))
        rows = rows.where((F.size(v) > 0) & (M.norm(v) > 0))
        q, i = (F.col("__id"), none(vectors, id_col)) if asks else (none(queries, query_id), F.col("__id"))
        zero = F.lit(0.0).cast(kind[6:-1])
        made.append(rows.select(F.lit(asks).alias("asks"), q.alias("q"), i.alias("i"), F.transform(v, lambda x: F.coalesce(x, zero)).cast("array<double>" if kind[6] == "d" else kind).alias("v")))
    a, b = made
    if a.schema["v"].dataType != b.schema["v"].dataType:
        a, b = (x.withColumn("v", F.col("v").cast("array<double>")) for x in made)
    return a, b


def block_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, query_id: str = "query_id", query_col: str = "vector", id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """As :func:`vector_search`, for many queries: each pair of blocks of queries and vectors is one group, scored in numpy.

    Blocks hold ``BLOCK_VALUES`` elements, those of queries fewer if there would be fewer groups than cores; a query travels
    once for each block of vectors, and a vector once for each block of queries.
    """
    cores = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n, wide = zip(*(df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(c)), F.lit(1))).first() for df, c in ((queries, query_col), (vectors, vec_col))))
    rows = max(1, BLOCK_VALUES // max(1, *wide))
    qs, vs = (max(1, -(-x // rows)) for x in n)
    qs = max(qs, min(-(-cores // vs), max(1, -(-n[0] // BLOCK_ROWS))))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a, b = sides(queries, vectors, query_id, query_col, id_col, vec_col)
    a = a.withColumn("qb", block("q", qs)).withColumn("vb", each(vs))
    b = b.withColumn("vb", block("i", vs)).withColumn("qb", each(qs))
    return best_of_groups(a.unionByName(b), ["qb", "vb"], k, queries, vectors, query_id, id_col)


def best_of_groups(rows: DataFrame, keys: list[str], k: int, queries: DataFrame, vectors: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """(query_id, <id>, score, rank): the k best of the groups (asks, q, i, v) of those keys; a pair may meet in several."""
    schema = T.StructType([T.StructField("q", queries.schema[query_id].dataType), T.StructField("i", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    found = rows.groupBy(*keys).applyInArrow(best_of_group(k), schema)
    found = found.select(F.col("q").alias(query_id), F.col("i").alias(id_col), "score")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id_col)
    if "tab" in keys:
        found = found.dropDuplicates([query_id, id_col])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_within(
    queries: DataFrame, vectors: DataFrame, allowed: DataFrame, k: int, id_col: str = "doc_id"
) -> DataFrame:
    """(query_id, <id>, idx, score) of the k nearest vectors (<id>, idx, vector) of the documents (query_id, <id>) of each query."""
    q = with_norms(queries, "query_id", "vector").select("query_id", F.col("v").alias("qv"), F.col("norm").alias("qn"))
    v = vectors.select(F.struct(id_col, "idx").alias("__key"), "vector")
    v = with_norms(v, "__key", "vector").select(F.col(f"__key.{id_col}").alias(id_col), F.col("__key.idx").alias("idx"), "v", "norm")
    rows = allowed.select("query_id", id_col).distinct().join(q, "query_id").join(v, id_col)
    rows = rows.select("query_id", id_col, "idx", (M.dot(F.col("qv"), F.col("v")) / (F.col("qn") * F.col("norm"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col, "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def lsh_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, tables: int = 24, bits: int = 8, seed: int = 5, query_id: str = "query_id",
    query_col: str = "vector", id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95,
) -> DataFrame:
    """As :func:`vector_search`, over the vectors that share a bucket of random hyperplanes with the query.

    Signs of ``bits`` random projections name a bucket in each of ``tables`` tables; those of a bucket are
    compared as one group, of which only the k best leave it. True neighbours score at least what the k-th found one does, so the
    result stands only if at that cosine the tables meet a vector with probability ``recall``; other
    queries, and those that meet fewer than k vectors, are searched exactly. So are all queries where they
    and the vectors make at most ``EXACT_PAIRS`` pairs, as hashing costs more than it saves there.
    """
    if queries.count() * vectors.count() <= EXACT_PAIRS:
        return block_search(queries, vectors, k, query_id, query_col, id_col, vec_col)
    sure = guaranteed_cosine(recall, bits, tables)

    def buckets(df: DataFrame) -> DataFrame:
        """The rows (asks, q, i, v) once for each table, with the bucket there."""
        def hashed(batches):
            drawn: dict[int, np.ndarray] = {}
            weight = 1 << np.arange(bits, dtype=np.int64)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for rows, x in by_size(table["v"]):
                    dim = x.shape[1]
                    if dim not in drawn:
                        drawn[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))
                    for at in range(0, len(rows), 512):
                        part = rows[at : at + 512]
                        bucket = (x[at : at + 512].astype(float) @ drawn[dim] > 0).reshape(len(part), tables, bits) @ weight
                        out = batch.take(pa.array(np.repeat(part, tables)))
                        columns = [*out.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(bucket.ravel())]
                        yield pa.RecordBatch.from_arrays(columns, names=[*out.schema.names, "tab", "bucket"])

        schema = T.StructType([*df.schema.fields, T.StructField("tab", T.IntegerType()), T.StructField("bucket", T.LongType())])
        return df.mapInArrow(hashed, schema)

    a, b = sides(queries, vectors, query_id, query_col, id_col, vec_col)
    a, b = buckets(a), buckets(b)
    # at most 2 ** bits buckets in each table; each side of one is cut into blocks
    size = a.drop("v").unionByName(b.drop("v")).groupBy("tab", "bucket").agg(
        *[F.ceil(F.sum(F.col("asks").eqNullSafe(F.lit(x)).cast("long")) / BLOCK_ROWS).cast("int").alias(n) for n, x in (("qs", True), ("vs", False))]
    )
    size = cut(size.where("qs > 0 and vs > 0"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(F.broadcast(size), ["tab", "bucket"]).withColumn("qb", block("q", "qs")).withColumn("vb", each("vs"))
    b = b.join(F.broadcast(size), ["tab", "bucket"]).withColumn("vb", block("i", "vs")).withColumn("qb", each("qs"))
    near = best_of_groups(a.unionByName(b), ["tab", "bucket", "qb", "vb"], k, queries, vectors, query_id, id_col)
    near = cut(near)
    full = near.where((F.col("rank") == k) & (F.col("score") >= sure)).select(query_id)
    rest = queries.join(full, query_id, "left_anti")
    return near.join(full, query_id, "left_semi").unionByName(block_search(rest, vectors, k, query_id, query_col, id_col, vec_col))


def remove_vectors(vectors: DataFrame, gone: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return vectors.join(gone.select(id_col), id_col, "left_anti")


def add_vectors(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Vectors with new ones in place of those of the same id."""
    return remove_vectors(vectors, new, id_col).unionByName(new.select(*vectors.columns))


def vector_retrieve(query_vectors: DataFrame, chunk_vectors: DataFrame, k: int = 5, threshold: float = 0.6, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, score, rank) over chunk vectors (<id>, idx, vector): the k best at the threshold, of the 2k nearest."""
    keyed = chunk_vectors.select(F.struct(id_col, "idx").alias("key"), F.col("vector").alias("embedding"))
    found = vector_search(query_vectors, keyed, 2 * k, None, id_col="key").where(F.col("score") >= threshold)
    return found.where(F.col("rank") <= k).select("query_id", f"key.{id_col}", "key.idx", "score", "rank")


# ---- embedders


def hashed_tfidf(texts: DataFrame, corpus: DataFrame, dim: int = 384, text_col: str = "text", out_col: str = "vector") -> DataFrame:
    """``texts`` with unit TF-IDF vectors; words are hashed to ``dim`` places, and the weights come from all of ``corpus``.

    Queries and chunks share one vocabulary. A text without words has a vector of zeros.
    """
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    words = F.array_distinct(X.tokenize_simple(F.col(text_col)))
    seen = corpus.select(F.explode(F.array_distinct(F.transform(words, place))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.struct("p", "df")))
    weights = seen.agg(pairs.alias("df")).crossJoin(n)  # one row of ``dim`` entries
    idf = weights.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda p: F.ln((F.col("n") + 1) / (F.coalesce(F.try_element_at("df", p), F.lit(0)) + 1)) + 1,
        ).alias("__idf")
    )

    @F.pandas_udf("array<double>")
    def counted(places: pd.Series) -> pd.Series:
        lengths = places.map(len).to_numpy()
        row = np.repeat(np.arange(len(places)), lengths)
        flat = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        return pd.Series(list(np.bincount(row * dim + flat, minlength=len(places) * dim).reshape(-1, dim).astype(float)))

    places = F.transform(X.tokenize_simple(F.coalesce(F.col(text_col), F.lit(""))), place)
    counts = texts.withColumn("__counts", counted(places)).crossJoin(F.broadcast(idf))
    return counts.withColumn(out_col, M.normalized(F.zip_with("__counts", "__idf", lambda n, w: n * w))).drop("__idf", "__counts")


def embed_with(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", out_col: str = "vector", batch: int = 32) -> DataFrame:
    """``texts`` with vectors from a function of a list of texts, called on executors for ``batch`` texts at a time."""
    def run(frames):
        for frame in frames:
            values = frame[text_col].fillna("").tolist()
            found = [v for i in range(0, len(values), batch) for v in model(values[i : i + batch])]
            frame[out_col] = [[float(x) for x in v] for v in found]
            yield frame

    schema = T.StructType([*texts.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    return texts.mapInPandas(run, schema)


def remote_model(url: str, key: str | None = None, name: str = "", send: Callable | None = None, batch: int = 100) -> Callable[[list[str]], list[list[float]]]:
    """A model behind HTTP for :func:`embed_with`; ``send`` (url, headers, body) -> dict can replace the transport."""
    def post(address, headers, body):
        import urllib.request

        request = urllib.request.Request(address, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=60) as reply:
            return json.loads(reply.read())

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        for i in range(0, len(texts), batch):
            reply = (send or post)(url, headers, {"input": texts[i : i + batch], "model": name})
            rows = reply["data"] if "data" in reply else [{"embedding": v} for v in reply["embeddings"]]
            out += [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        return out

    return call


def agreement_share(angle_cos: float, bits: int, tables: int) -> float:
    """The probability that two vectors with that cosine share a bucket of :func:`lsh_search`."""
    return 1 - (1 - (1 - math.acos(max(-1.0, min(1.0, angle_cos))) / math.pi) ** bits) ** tables


def guaranteed_cosine(recall: float, bits: int, tables: int) -> float:
    """The least cosine at which :func:`agreement_share` is ``recall``."""
    return math.cos(math.pi * (1 - (1 - (1 - recall) ** (1 / tables)) ** (1 / bits)))
