"""Line deduplication by winnowing over line hashes.

Every window of ``min_lines`` consecutive non-blank lines selects its least line hash (the rightmost on
ties) as fingerprint, so any run of at least that many lines that occurs twice has the same fingerprint
in both places. Neighbouring windows that select the same line share one fingerprint position, and only
these positions travel, each with the lines around it that its windows reach. The first position, in (id, row,
line) order, of each fingerprint and window is found by an aggregate that combines before it shuffles; all positions
are joined with it, and a later one matches. A match is extended to the left and to the right, through the windows
around the fingerprint and from one fingerprint to the next, so it reaches its full length in time linear
in the number of lines, even for lines that occur in most documents, and its lines are deleted. A line of
``min_words`` words or more is a run of its own. Texts shuffle only if the list of deleted lines is too large to be
broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.arrays import Hasher, mix, ranges, row_slices, text_bytes
from textloom.llm.common import cut, fresh, maybe_broadcast, q, row_key

BROADCAST_BYTES = 64 << 20
SLICE_BYTES = 1 << 22
PIECE_BYTES = 1 << 19


def full_lines(column: pa.Array, hasher: Hasher):
    """Document, position, hash and number of blanks of each line that is not blank.

    A line is hashed without the blanks around it.
    """
    buf, offsets = text_bytes(column)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    pos = np.arange(len(starts)) - first[doc] if len(starts) else starts
    full, hashes, blanks = [np.zeros(0, bool)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(starts):  # some hundred kilobytes of whole lines at a time, for memory
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES)))
        base = starts[at]
        piece = buf[base : ends[to - 1] + 1]
        s, e = starts[at:to] - base, ends[at:to] - base
        spaces = np.concatenate([[0], np.cumsum(piece == 32, dtype=np.int32)])
        inked = np.flatnonzero((piece != 32) & (piece != 10))
        a, b = np.searchsorted(inked, s), np.searchsorted(inked, e)
        some = a < b
        hashes.append(hasher.ranges(piece, inked[a[some]], inked[b[some] - 1] + 1))
        blanks.append((spaces[e] - spaces[s])[some].astype(np.int64))
        full.append(some)
        at = to
    keep = np.concatenate(full)
    return doc[keep], pos[keep].astype(np.int32), np.concatenate(hashes), np.concatenate(blanks)


def fingerprints(doc: np.ndarray, h: np.ndarray, w: int):
    """(fingerprint, first line, windows) of each fingerprint position, and the hash of each window by its first line.

    The windows of a position begin at consecutive lines, from the first one given.
    """
    n = len(h) - w + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    around = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.arange(n)
    chosen = at + w - 1 - around[:, ::-1].argmin(1)
    name = np.full(n, w, np.uint64)
    for i in range(w):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + around[:, i])
    inside = doc[:n] == doc[w - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
    first = at[begins]
    number = np.diff(np.append(np.cumsum(inside)[first] - 1, inside.sum()))
    return h[chosen[first]], first, number, name


def repeated_lines(docs: DataFrame, text_col: str, id_col: str, min_lines: int, min_words: int) -> DataFrame:
    """(key, lines): for each row that loses lines, its row key and the positions of those lines."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    kind, w = docs.schema[id_col].dataType, min_lines
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("key", T.LongType()), T.StructField("id", kind)])
    schema = schema.add("windows", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.IntegerType()))

    def lists(values, starts, lengths):
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[ranges(starts, lengths)]))

    def emit(batches):
        hasher = Hasher()
        for batch in (b.slice(*part) for b in batches for part in row_slices(b.column(2), SLICE_BYTES)):
            doc, pos, h, blanks = full_lines(batch.column(2), hasher)
            fp, first, number, name = fingerprints(doc, h, w)
            alone = np.flatnonzero(blanks >= min_words - 1)
            one = np.ones(len(alone), np.int64)
            parts = [
                (fp, first, lists(name.view(np.int64), first, number), lists(pos, first, number + w - 1)),
                (h[alone], alone, lists(mix(~h).view(np.int64), alone, one), lists(pos, alone, one)),
            ]
            for prints, lines, windows, places in parts:
                if len(lines):
                    rows = pa.array(doc[lines])
                    arrays = [pa.array(prints.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), windows, places]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    staged = docs.where(F.col(q(text_col)).isNotNull()).select(
        row_key(id_col, text_col).alias("key"), F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text")
    )
    found = cut(staged.mapInArrow(emit, schema))
    rows = found.select("fp", "key", "id", "places", F.posexplode("windows").alias("i", "win")).select(
        "fp", "win", "key", F.expr("slice(places, i + 1, if(size(places) > 1, int({}), 1))".format(w)).alias("pos"),
        F.struct(F.col("id").isNull().alias("none"), "id", "key", F.col("places")[F.col("i")].alias("line")).alias("spot"),
    )
    first = rows.groupBy("fp", "win").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(first.drop("n"))
    match = rows.join(maybe_broadcast(first, first.count(), 96, BROADCAST_BYTES), ["fp", "win"]).where(~F.col("spot").eqNullSafe(F.col("first")))
    return match.select("key", F.explode("pos").alias("pos")).groupBy("key").agg(F.collect_set("pos").alias("lines"))


def line_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_lines: int = 2,
    min_words: int = 50,
    count_col: str = "removed_lines",
) -> DataFrame:
    """``docs`` with the text of each row lacking the runs of lines that occur earlier, and their number.

    A run is ``min_lines`` or more consecutive non-blank lines, or one line of ``min_words`` words or
    more; lines are compared without the white space around them. "Earlier" is by id (null ids last),
    then row hash, then line, so a text repeats within itself too. Rows that repeat both id and text are
    one document and get the same result. Null texts stay null with 0 removed, empty texts stay empty;
    blank lines are neither matched nor removed. A text of which all lines go becomes blank. A column of
    the input that is named like ``count_col`` is replaced; other columns pass through.
    """
    key, lines, cut_, parts = fresh(docs, "key", "lines", "cut", "parts")
    gone = repeated_lines(docs, text_col, id_col, min_lines, min_words).select(
        F.col("key").alias(f"{key}r"), F.col("lines").alias(lines)
    )
    gone = cut(gone)
    rows, size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()
    gone = maybe_broadcast(gone, rows + size // 16, 64, BROADCAST_BYTES)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(gone, F.col(key) == F.col(f"{key}r"), "left")
    # The text is split once, inside a one-element array, not once for each line that is kept.
    kept = F.expr(
        f"""transform(array(split({q(text_col)}, '\\n')), a ->
            array_join(transform(array_except(sequence(0, size(a) - 1), {lines}), i -> a[i]), '\\n'))[0]"""
    )
    text = F.when(F.col(lines).isNull(), F.col(q(text_col))).otherwise(kept)
    count = F.coalesce(F.size(F.col(lines)), F.lit(0))
    count = F.when(F.col(lines).isNull(), F.lit(0)).otherwise(count)
    keep = [c for c in docs.columns if c.lower() != count_col.lower()]
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(q(c)) for c in keep], count.cast("int").alias(count_col)
    )
