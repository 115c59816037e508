"""Exact deduplication by two passes over Bloom filters.

Pass one sends a 64-bit hash of every text, once per batch, to the filter partition of its range. A partition
sets ``hashes`` counters per hash among ``bits_per_row`` times its number of hashes, and keeps the hashes of
which every counter was hit twice or more: those that possibly repeat. Partitions grow in number with the
table, not in size. A second filter holds only these hashes, in blocks of a megabit, and is broadcast: it has
16 bits for each, and at most ``max_filter_bits``. Pass two probes it: rows whose bits are not all set pass
straight through; only the others shuffle, and are compared as whole texts. A filter can only send too many
rows to the comparison, never too few, so the result is exact whatever its size. Once there are more possible
repeats than its bits allow for, more rows than necessary shuffle: with b bits for each, a share of
(1 - exp(-2 / b)) ** 2 of the rows that occur once (0.01 for b = 16, 0.15 for b = 4, 0.75 for b = 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import mix
from textloom.llm.common import cut, fresh, q

PARTITION_ROWS = 1 << 21
BLOCK_BITS = 1 << 20


def possible_repeats(hashes: DataFrame, rows: int, bits_per_row: int, number: int) -> DataFrame:
    """(hash): those of the one column of ``hashes`` that possibly occur twice or more, and each that does."""
    wide = max(1, -(-rows // PARTITION_ROWS))

    def emit(batches):
        for batch in batches:
            h, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
            part = (mix(h.view(np.uint64)) % np.uint64(wide)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(h), pa.array(times > 1)], names=["part", "hash", "twice"])

    def filtered(group: pa.Table) -> pa.Table:
        h, twice = group["hash"].to_numpy(), group["twice"].to_numpy(zero_copy_only=False)
        size = 64
        while size < bits_per_row * len(h):
            size *= 2
        maybe = np.ones(len(h), bool)
        slots = [(mix(h.view(np.uint64) + np.uint64(i + 1)) & np.uint64(size - 1)).astype(np.int64) for i in range(number)]
        hit = np.zeros(size, np.uint8)
        for slot in slots:  # saturating counters
            hit = np.minimum(hit + np.minimum(np.bincount(slot, weights=1 + twice, minlength=size), 2).astype(np.uint8), 2)
        for slot in slots:
            maybe &= hit[slot] > 1
        return pa.table({"hash": pa.array(np.unique(h[maybe]))})

    made = hashes.mapInArrow(emit, "part int, hash long, twice boolean")
    return made.groupBy("part").applyInArrow(filtered, "hash long")


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    bits_per_row: int = 8,
    hashes: int = 2,
    max_filter_bits: int = 1 << 30,
) -> DataFrame:
    """One row of each distinct text, with all columns of ``docs``.

    Of rows with equal texts, the one with the least id stays, null ids last; among equal ids the one
    whose other columns have the least JSON hash, so repeated rows become one. Rows with null text are
    never repeats and all stay. Empty texts equal each other. An empty table gives an empty table.
    """
    cols = docs.columns
    hash_, flag, row = fresh(docs, "hash", "flag", "row")
    own = F.xxhash64(F.col(q(text_col)))
    texts = docs.where(F.col(q(text_col)).isNotNull()).select(own.alias("hash"))
    repeats = cut(possible_repeats(texts, docs.count(), bits_per_row, hashes))
    many, bits = repeats.count(), 64
    while bits < 16 * many and bits < max_filter_bits:
        bits *= 2
    block = min(bits, BLOCK_BITS)
    spot = lambda h, i: F.pmod(F.xxhash64(h, F.lit(i)), F.lit(block))
    which = lambda h: F.pmod(F.xxhash64(h, F.lit(-1)), F.lit(bits // block))

    def packed(group: pa.Table) -> pa.Table:
        on = np.zeros(block, bool)
        for i in range(hashes):
            on[group[f"s{i}"].to_numpy()] = True
        words = np.packbits(on, bitorder="little").view(np.int64)
        return pa.table({"block": group["block"].combine_chunks()[:1], "words": pa.array([words.tolist()], pa.list_(pa.int64()))})

    slots = repeats.select(which("hash").alias("block"), *[spot("hash", i).alias(f"s{i}") for i in range(hashes)])
    filter_ = slots.groupBy("block").applyInArrow(packed, "block long, words array<bigint>")
    filter_ = F.broadcast(cut(filter_).toDF(f"{hash_}b", f"{hash_}w"))  # at most max_filter_bits
    hashed = docs.withColumn(hash_, F.when(F.col(q(text_col)).isNotNull(), own))
    hashed = hashed.join(filter_, which(hash_) == F.col(f"{hash_}b"), "left")
    again = F.lit(True)
    for i in range(hashes):
        word = F.get(F.col(f"{hash_}w"), F.shiftright(spot(hash_, i), 6).cast("int"))
        again &= F.call_function("shiftright", word, (spot(hash_, i) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    hashed = hashed.withColumn(flag, F.coalesce(again, F.lit(False))).drop(f"{hash_}b", f"{hash_}w")
    single, maybe = hashed.where(~F.col(flag)), hashed.where(F.col(flag))
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(q(c)) for c in cols if c != text_col], F.lit(0).alias("_"))))
    least = (
        maybe.groupBy(F.col(hash_), F.col(q(text_col)).alias(f"{hash_}t"))
        .agg(
            F.min_by(
                F.struct(*[F.col(q(c)) for c in cols if c != text_col], F.lit(0).alias("_")),
                F.struct(F.col(q(id_col)).isNull(), F.col(q(id_col)), rest),
            ).alias(row)
        )
        .select(*[F.col(f"{hash_}t").alias(c) if c == text_col else F.col(f"{row}.{q(c)}").alias(c) for c in cols])
    )
    return single.select(*[F.col(q(c)) for c in cols]).unionByName(least)
