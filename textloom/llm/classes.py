"""Classes of near copies: connected components of links between sets, and one row per member."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

LOCAL_EDGES = 1 << 20


def stars(batches):
    """(node, root) of all edges (u, v) of a task."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    name, at = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]).ravel(), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(name))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(len(name)))
    yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(name[root[some]])], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the connected component of each node of (a, b) but the roots.

    Alternates large-star and small-star steps, each a shuffle of the remaining edges, until every node
    points to a root; the number of rounds grows with the logarithm of a component's size. A node's least
    neighbour is joined back to its edges, so no node's neighbours are collected. If some node does not point to a
    root after ``max_rounds``, that is an error. Up to ``LOCAL_EDGES`` distinct edges, 16 bytes each, go to one task
    instead, which repeats the same two steps in memory.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if now.count() <= LOCAL_EDGES:
        return now.coalesce(1).mapInArrow(stars, "node bigint, root bigint")
    for _ in range(max_rounds):
        deeper = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        twice = now.groupBy("u").count().where("count > 1").limit(1)
        if deeper.isEmpty() and twice.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least).distinct())
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def classified(members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, class_id, class_key, links) of each member.

    ``members`` has (sig, key, id), ``sets`` (sig, copies, least) with the least (none, id, key) of each set, ``links``
    (sig, links, root), any number of rows for a set. A member with a null ``sig`` is a class of its own; one that
    has a set is linked to the set's other members too.
    """
    roots = components(links.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("sig").agg(F.sum("links").alias("others"))
    named = sets.join(roots.toDF("node", "root"), F.col("sig") == F.col("node"), "left").join(total, "sig", "left")
    named = named.select(
        "sig", F.coalesce("root", "sig").alias("root"), "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    head = named.groupBy("root").agg(F.min("least").alias("head"))
    named = named.join(head, "root").select(F.col("sig").alias("named_sig"), "head", "links")
    every = members.join(named, F.col("sig") == F.col("named_sig"), "left")
    none = F.col("head").isNull()
    return every.select(
        "key", "id", F.when(none, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(none, F.col("key")).otherwise(F.col("head.key")).alias("class_key"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
