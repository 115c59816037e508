"""Near duplicates among embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1, and equal ones are one. A table draws ``k`` Gaussian directions and shifts and
quantises the projections, floor((a . v + b) / width); vectors that agree on all k share a bucket. Every vector
is a query: those that share a bucket in any table are compared by exact cosine. k grows with the logarithm
of the number of vectors, so that a bucket holds at most ``crowd`` unrelated ones per vector, and the number of
tables follows from k and the recall wanted at the threshold itself; closer pairs are found more surely.

Only vectors that share a bucket travel. Buckets go to groups of bounded size, many small ones to a group;
a larger one is cut into blocks, and every pair of blocks is a group member of its own. A group gives a
row per vector, not per pair: how many it is linked to and the least one that it reaches. A pair that
meets in several tables counts in the first of them: its other buckets are worked out again from the vectors,
whose projections are sums of integers and therefore the same everywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.classes import classified
from textloom.llm.common import cut, q

UNRELATED = math.sqrt(2)  # distance of two random directions
BLOCK = 1 << 10
GROUP_ROWS = 1 << 14
STEP_ROWS = 64
ALL_BLOCK = 1 << 15
ALL_TILE = 512
GRID = float(1 << 20)


def agreement(distance: float, width: float) -> float:
    """The probability that one quantised projection of two points at that distance agrees."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, width: float, recall: float, crowd: float) -> tuple[int, int]:
    """(k, tables) for that many vectors."""
    k = max(2, math.ceil(math.log(max(rows / crowd, 2)) / -math.log(agreement(UNRELATED, width))))
    near = agreement(max(math.sqrt(2 - 2 * threshold), 1e-6), width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near)))


class Tables:
    """The random directions of all tables, by dimension."""

    def __init__(self, k: int, tables: int, width: float, seed: int) -> None:
        self.k, self.tables, self.width, self.seed, self.drawn = k, tables, width, seed, {}

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row of vectors of one dimension in each table."""
        dim = x.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            self.drawn[dim] = np.rint(rng.normal(size=(dim, self.k * self.tables)) * GRID), rng.uniform(0, self.width, self.k * self.tables)
        a, b = self.drawn[dim]
        cell = np.floor((np.rint(x * GRID) @ a / GRID**2 + b) / self.width).astype(np.int64)  # exact integers below 2**53
        rng = np.random.default_rng([self.seed, dim, 1])
        weight = rng.integers(1, 1 << 62, self.k * self.tables, dtype=np.int64) | 1
        salt = rng.integers(1, 1 << 62, self.tables, dtype=np.int64)
        return (cell * weight).reshape(len(x), self.tables, self.k).sum(2) + salt


def matrices(lists: pa.Array):
    """(rows, matrix) of the vectors of each dimension."""
    flat, length = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    ends = np.cumsum(length)
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        yield at, flat[(ends[at] - dim)[:, None] + np.arange(dim)[None]]


def candidates(bucket: np.ndarray, side: np.ndarray, x: np.ndarray, threshold: float):
    """(a, b) of rows, sorted by bucket, that share one and have at least that cosine; in different sides of a pair of blocks."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(first, len(bucket)))
    small = np.repeat(size <= STEP_ROWS, size)
    at, step = np.flatnonzero(small), 1
    while len(at):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        cosine = np.einsum("ij,ij->i", x[at], x[at + step])
        some = at[(cosine >= threshold) & ((side[at] != side[at + step]) | (side[at] < 0))]
        yield some, some + step
        step += 1
    for a, n in zip(first[size > STEP_ROWS], size[size > STEP_ROWS]):
        part, mine = x[a : a + n], side[a : a + n]
        i, j = np.nonzero(np.triu((part @ part.T >= threshold) & ((mine[:, None] != mine[None]) | (mine < 0)), 1))
        yield a + i, a + j


def all_links(sets: DataFrame, count: int, threshold: float) -> DataFrame:
    """As :func:`linked_vectors`, by comparing all vectors: where so many tables are needed that each would meet as many in
    them. Every pair of blocks is a group; tiles are compared in single precision, and again in double near the threshold."""
    blocks = max(-(-count // ALL_BLOCK), min(8, -(-count // (ALL_BLOCK // 8))), 1)
    rows = sets.withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(blocks)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("part", "y").alias("i"), F.greatest("part", "y").alias("j"), "part", "sig", "copies", "v")

    def link(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["sig"]))
        sig, copies, part = (group[c].to_numpy() for c in ("sig", "copies", "part"))
        one = group["i"][0].as_py() == group["j"][0].as_py()
        links, least = np.zeros(len(sig), np.int64), np.arange(len(sig))
        for at, x in matrices(group["v"].combine_chunks()):
            sides = (at, at) if one else (at[part[at] == part.min()], at[part[at] != part.min()])
            left, right = (np.searchsorted(at, side) for side in sides)
            x32, near = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
            for a in range(0, len(left), ALL_TILE):
                p, r = [], []
                rows = left[a : a + ALL_TILE]
                for b in range(a if one else 0, len(right), 8 * ALL_TILE):
                    others = right[b : b + 8 * ALL_TILE]
                    score = x32[rows] @ x32[others].T
                    i, j = np.nonzero(score >= np.float32(threshold - near))
                    if one:
                        i, j = i[rows[i] < others[j]], j[rows[i] < others[j]]
                    sure = score[i, j] >= threshold + near
                    doubt = np.flatnonzero(~sure)
                    sure[doubt] = np.einsum("ij,ij->i", x[rows[i[doubt]]], x[others[j[doubt]]]) >= threshold
                    p.append(at[rows[i[sure]]])
                    r.append(at[others[j[sure]]])
                p, r = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (p, r))
                links += np.bincount(p, weights=copies[r], minlength=len(sig)).astype(np.int64)
                links += np.bincount(r, weights=copies[p], minlength=len(sig)).astype(np.int64)
                join_least(least, p, r)
        some = np.flatnonzero(links > 0)
        return pa.table({"sig": pa.array(sig[some]), "links": pa.array(links[some]), "root": pa.array(sig[least[some]])})

    return cut(rows.groupBy("i", "j").applyInArrow(link, "sig long, links long, root long"))


def join_least(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Of each linked pair, and of all that point to the same, the least one."""
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least[:] = least[least]


def linked_vectors(sets: DataFrame, threshold: float, width: float, recall: float, crowd: float, seed: int) -> DataFrame:
    """(sig, links, root) of sets (sig, copies, v): see :func:`textloom.llm.classes.classified`."""
    count = sets.count()
    k, tables = plan(count, threshold, width, recall, crowd)
    if tables * crowd >= count:
        return all_links(sets, count, threshold)

    def hashed(batches):
        made = Tables(k, tables, width, seed)
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                found = made.buckets(x)
                sig = np.repeat(batch.column(0).to_numpy()[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(found.ravel())], names=["sig", "bucket"])

    buckets = cut(sets.select("sig", "v").mapInArrow(hashed, "sig long, bucket long"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    some = cut(buckets.join(shared, "bucket"))
    wide = F.ceil(F.col("rows") / BLOCK).cast("int")
    some = some.withColumn("k", wide).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    some = some.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    # the bucket of a pair of blocks; within a block the side is -1: all pairs count
    i, j = F.least("part", "y"), F.greatest("part", "y")
    some = some.select("sig", "bucket", F.xxhash64("bucket", i, j).alias("spot"), F.when(i == j, F.lit(-1)).otherwise(F.col("part")).alias("side"))
    groups = max(1, -(-some.count() // GROUP_ROWS))
    rows = some.join(sets.select("sig", "copies", "v"), "sig").withColumn("group", F.pmod("spot", F.lit(groups)))
    out = pa.schema([("sig", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def link(group: pa.Table) -> pa.Table:
        made = Tables(k, tables, width, seed)
        lists = group["v"].combine_chunks()
        sig, spot, bucket, side, copies = (group[c].to_numpy() for c in ("sig", "spot", "bucket", "side", "copies"))
        names, of = np.unique(sig, return_inverse=True)
        links, least = np.zeros(len(names), np.int64), np.arange(len(names))
        for rows, x in matrices(lists):
            order = np.argsort(spot[rows], kind="stable")
            rows, x = rows[order], x[order]
            for a, b in candidates(spot[rows], side[rows], x, threshold):
                if not len(a):
                    continue
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                cell = made.buckets(x[used])
                p, r = place[: len(a)], place[len(a) :]
                here = bucket[rows[a]]
                one = np.zeros(len(a), bool)
                for at in range(0, len(a), 1 << 16):  # in the first table in which it meets
                    part = slice(at, at + (1 << 16))
                    meet = cell[p[part]] == cell[r[part]]
                    one[part] = cell[p[part], meet.argmax(1)] == here[part]
                a, b = of[rows[a]], of[rows[b]]
                links += np.bincount(a[one], weights=copies_of(names, sig, copies)[b[one]], minlength=len(names)).astype(np.int64)
                links += np.bincount(b[one], weights=copies_of(names, sig, copies)[a[one]], minlength=len(names)).astype(np.int64)
                join_least(least, a, b)
        some = np.flatnonzero((links > 0) | (least != np.arange(len(names))))
        return pa.table([pa.array(names[some]), pa.array(links[some]), pa.array(names[least[some]])], schema=out)

    def copies_of(names, sig, copies):
        many = np.zeros(len(names), np.int64)
        many[np.searchsorted(names, sig)] = copies
        return many

    rows = rows.select("group", "sig", "spot", "bucket", "side", "copies", "v")
    return cut(rows.groupBy("group").applyInArrow(link, "sig long, links long, root long"))


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    width: float = 2.0,
    recall: float = 0.97,
    crowd: float = 0.125,
    seed: int = 11,
) -> DataFrame:
    """(<id>, class_id, links) of each row: the least id of its class, and the number of its partners.

    Partners are all other rows whose vectors have at least that cosine, equal vectors among them; a class is a
    connected component of partners. Rows that repeat both id and vector are one row. Null vectors, those
    with null, NaN or infinite elements, and those of length 0 have no partners; vectors of different
    dimensions are never compared. Null ids come last in order. Other columns are ignored, whatever their
    names; an empty table gives no rows. Pairs at the threshold itself are found with probability ``recall``,
    closer ones more surely, equal ones always.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    raw = vectors.select(F.col(q(id_col)).alias("id"), F.col(q(vec_col)).cast("array<double>").alias("v"))
    raw = raw.withColumn("key", F.xxhash64("id", "v")).withColumn("norm", F.when(fine, norm)).dropDuplicates(["key"])
    unit = F.when(F.col("norm") > 0, F.transform(v, lambda x: x / F.col("norm") + 0.0))
    rows = raw.select("key", "id", unit.alias("v"))
    members = cut(rows.withColumn("sig", F.when(F.col("v").isNotNull(), F.xxhash64(F.size("v"), "v"))))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    sets = members.where("sig is not null").groupBy("sig").agg(
        F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"), F.min("v").alias("v")
    )
    sets = cut(sets)
    links = linked_vectors(sets, threshold, width, recall, crowd, seed)
    out = classified(members.select("sig", "key", "id"), sets.drop("v"), links)
    return out.select(F.col("id").alias(id_col), "class_id", "links")
