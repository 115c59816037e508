"""Best-fit packing by the sum-of-squares rule.

Sequences hold ``capacity`` words. A document is cut at multiples of the capacity; full pieces are
sequences of their own and the rest is placed, online, where the sum over all gaps g of the squared
number of open sequences with gap g becomes smallest. Documents are spread over shards by row hash, a
shard for each ``shard_rows`` documents, and the rule is applied in each; only ids and lengths shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import q, row_key


def sum_of_squares(sizes, capacity: int) -> np.ndarray:
    """The sequence of each size (1 to capacity - 1), in order.

    Among placements that are equally good: an open sequence before a new one, then the smallest gap,
    then the sequence that got this gap last.
    """
    twice = np.zeros(capacity + 1, np.int64)  # twice the number of open sequences with each gap
    twice[0] = -1  # a full sequence leaves the sum, so filling one gains less by one
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    opened = 0
    far = np.int64(1) << 40
    for k, size in enumerate(sizes):
        size = int(size)
        old = twice[size:capacity]
        change = twice[: capacity - size] - old
        change[old == 0] = far
        best = int(change.argmin())
        if change[best] + 2 <= twice[capacity - size] + 1:
            gap = size + best
            at = stacks[gap].pop()
            twice[gap] -= 2
        else:
            gap, at, opened = capacity, opened, opened + 1
        rest = gap - size
        if rest:
            stacks.setdefault(rest, []).append(at)
            twice[rest] += 2
        out[k] = at
    return out




def best_fit_packing(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = 2048, shard_rows: int = 50_000
) -> DataFrame:
    """(bin_id, <id>, piece, start, length): which words of which document each sequence holds.

    ``start`` and ``length`` count white-space separated words. Every row is placed, repeated rows and
    null ids too, and every word exactly once; null and blank texts have no words and give no row. Ties
    are settled as in :func:`sum_of_squares`; documents come in the order of their row hash. Other
    columns are ignored.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    shards = max(1, -(-docs.count() // shard_rows))
    kind = docs.schema[id_col].dataType
    sized = docs.select(
        F.pmod(F.xxhash64(row_key(id_col, text_col), F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
        row_key(id_col, text_col).alias("key"),
        F.col(q(id_col)).alias("id"),
        F.regexp_count(F.col(q(text_col)), F.lit(r"\S+")).cast("long").alias("words"),
    ).where("words > 0")
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("id", kind)])
    schema = schema.add("piece", "integer").add("start", "long").add("length", "long")

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["key"].to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        words = group["words"].to_numpy()
        full, rest = words // capacity, words % capacity
        some = np.flatnonzero(rest)
        placed = sum_of_squares(rest[some], capacity)
        opened = int(placed.max()) + 1 if len(placed) else 0
        whole = np.repeat(np.arange(len(words)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        doc = np.concatenate([whole, some])
        piece = np.concatenate([piece, full[some]])
        length = np.concatenate([np.full(len(whole), capacity, np.int64), rest[some]])
        local = np.concatenate([opened + np.arange(len(whole)), placed])
        base = np.int64(group["shard"][0].as_py()) << np.int64(32)
        return pa.table(
            {
                "bin_id": pa.array(base + local),
                "id": group["id"].take(pa.array(doc)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(piece.astype(np.int64) * capacity),
                "length": pa.array(length.astype(np.int64)),
            }
        )

    out = sized.groupBy("shard").applyInArrow(pack, schema)
    return out.select("bin_id", F.col("id").alias(id_col), "piece", "start", "length")
