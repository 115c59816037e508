"""Scoring by a class-based n-gram model in the manner of Brown et al.

Exchange clustering assigns every word to one of ``classes`` classes so that class bigrams become as
likely as possible. In each round the corpus is read once for the classes to the left and right of every
word; then each word moves to the class that maximises the likelihood given the others' current ones,
its own share taken out of the class it leaves. P(w | v) = P(class(w) | class(v)) P(w | class(w)), both
smoothed, gives each text's likelihood and perplexity.

Every distinct word has a number of its own: its place in the sorted 64-bit hashes of all words, gathered
in a first pass. Counts travel as sorted, delta-coded, compressed blocks, one per shard of a fixed number of
words, so shards grow in number with the vocabulary, not in size. The driver and each worker hold a hash and
a class (and a count or probability) per distinct word, some 20 bytes. With ``vocab_bits`` words are numbered
by bits of their hash instead, and what is held has a fixed size, but words share numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import Hasher, row_slices, word_hashes
from textloom.llm.common import cut, q

SHARD_BITS = 8
LOCAL_BITS = 14
SLICE_BYTES = 1 << 23
BLOCKS = "shard int, keys binary, counts binary"
ARROW = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def parts(batches, text: int):
    """The batches in slices of some megabytes of text, for memory."""
    for batch in batches:
        for at, rows in row_slices(batch.column(text), SLICE_BYTES):
            yield batch.slice(at, rows)


class Vocabulary:
    """Numbers of words: places in sorted ``hashes``, one more for all words not there; or bits of the hash."""

    def __init__(self, hashes: np.ndarray | None, bits: int | None = None) -> None:
        self.hashes, self.bits, self.first = hashes, bits, None

    def __len__(self) -> int:
        return 1 << self.bits if self.hashes is None else len(self.hashes) + 1

    def __getstate__(self):
        return self.hashes, self.bits, None  # the index is built where it is used

    def __setstate__(self, state) -> None:
        self.hashes, self.bits, self.first = state

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            return (h >> np.uint64(64 - self.bits)).astype(np.int64)
        n = len(self.hashes)
        wide = max(1, n.bit_length())
        if self.first is None:  # where the hashes of each prefix begin
            self.first = np.searchsorted(self.hashes, np.arange(1 << wide, dtype=np.uint64) << np.uint64(64 - wide))
        at = self.first[(h >> np.uint64(64 - wide)).astype(np.int64)]
        todo = np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < n]
            todo = todo[self.hashes[at[todo]] < h[todo]]
            at[todo] += 1
        known = at < n
        known[known] = self.hashes[at[known]] == h[known]
        return np.where(known, at, n)


def words_in(column: pa.Array, vocabulary: Vocabulary, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    h, bounds = word_hashes(column, hasher)
    return vocabulary.numbers(h), bounds


def distinct_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of all words, and how often each occurs."""
    spark = texts.sparkSession
    top = max(SHARD_BITS, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def unigrams(batches):
        hasher, press = Hasher(), zstandard.ZstdCompressor(level=1).compress
        for batch in parts(batches, 0):
            h, counts = np.unique(word_hashes(batch.column(0), hasher)[0], return_counts=True)
            shard = (h >> np.uint64(64 - top)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange((1 << top) + 1))
            rows = [
                (s, press(np.diff(h[a:b], prepend=np.uint64(0)).tobytes()), press(counts[a:b].astype(np.uint32).tobytes()))
                for s, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if a < b
            ]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ARROW)], schema=ARROW)

    def added(group: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        h = np.concatenate([np.cumsum(np.frombuffer(expand(x), np.uint64)) for x in group["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(expand(x), np.uint32) for x in group["counts"].to_pylist()])
        h, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        return pa.table(
            [group["shard"].combine_chunks()[:1], pa.array([h.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=ARROW
        )

    rows = texts.mapInArrow(unigrams, BLOCKS).groupBy("shard").applyInArrow(added, BLOCKS).collect()
    rows.sort(key=lambda r: r.shard)
    return tuple(np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("keys", np.uint64), ("counts", np.int64)))


def neighbours(word: np.ndarray, bounds: np.ndarray, cls: np.ndarray, edge: int):
    """Class of each word, and of the words before and after it; ``edge`` beyond either end of a text."""
    own = cls[word].astype(np.int64)
    left = np.concatenate([[edge], own[:-1]])[: len(own)]
    right = np.concatenate([own[1:], [edge]])[: len(own)]
    begins, ends = bounds[:-1][bounds[1:] > bounds[:-1]], bounds[1:][bounds[1:] > bounds[:-1]]
    left[begins] = edge
    right[ends - 1] = edge
    return own, left, right


def pack(keys: np.ndarray, counts: np.ndarray, shift: int, extra: list | None = None) -> pa.RecordBatch:
    """Blocks of sorted keys, from the shard's first, by shard (key >> shift), and any extra blocks."""
    press = zstandard.ZstdCompressor(level=1).compress
    shard = keys >> shift
    cuts = np.searchsorted(shard, np.arange(int(shard[-1]) + 2)) if len(keys) else np.zeros(1, np.int64)
    rows = list(extra or [])
    for s in range(len(cuts) - 1):
        a, b = cuts[s], cuts[s + 1]
        if a < b:
            delta = np.diff(keys[a:b], prepend=s << shift).astype(np.uint32)
            rows.append((s, press(delta.tobytes()), press(counts[a:b].astype(np.uint32).tobytes())))
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ARROW)], schema=ARROW)


def unpack(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    keys = [np.cumsum(np.frombuffer(expand(x), np.uint32).astype(np.int64)) for x in group["keys"].to_pylist()]
    counts = [np.frombuffer(expand(x), np.uint32) for x in group["counts"].to_pylist()]
    return np.concatenate(keys), np.concatenate(counts)


class Model:
    """Word counts and classes by word number, and class bigram counts (left, right; the last is the edge)."""

    def __init__(self, vocabulary: Vocabulary, classes: int, alpha: float) -> None:
        self.vocabulary, self.classes, self.alpha = vocabulary, classes, alpha
        self.count = np.zeros(len(vocabulary), np.int64)
        self.cls = np.zeros(len(vocabulary), np.uint8)
        self.bigram = np.zeros((classes + 1, classes + 1))

    def start(self) -> None:
        """The most frequent words have a class each, the others share the last one."""
        order = np.argsort(-self.count, kind="stable")[: self.classes - 1]
        self.cls[:] = self.classes - 1
        self.cls[order] = np.arange(len(order))

    def transitions(self) -> np.ndarray:
        """log P(right class | left class), add-alpha smoothed."""
        n = self.bigram + self.alpha
        return np.log(n / n.sum(1, keepdims=True))

    def emissions(self) -> np.ndarray:
        """log P(word | its class), by word number; one that was never seen counts as half a word."""
        size = np.bincount(self.cls, weights=self.count, minlength=self.classes)
        numbers = np.bincount(self.cls, minlength=self.classes)
        return np.log((self.count + 0.5) / (size + 0.5 * numbers)[self.cls]).astype(np.float32)


def move(left: np.ndarray, right: np.ndarray, cls: np.ndarray, bigram: np.ndarray, alpha: float) -> np.ndarray:
    """The best class of each word, from its counts of neighbours' classes and the class bigrams.

    ``left`` and ``right`` are (words, classes + 1). Ties keep the current class, else the first.
    """
    k = bigram.shape[0] - 1
    out_of, into = bigram[:k].sum(1), bigram[:, :k].sum(0)
    total = right.sum(1)
    after = np.log((bigram[:k] + alpha) / (out_of + alpha * (k + 1))[:, None])  # P(right | class)
    # P(class | left) P(word | class): the word's own count is the same for all classes
    before = np.log((bigram[:, :k] + alpha) / (bigram.sum(1) + alpha * (k + 1))[:, None])
    score = right @ after.T + left @ before - total[:, None] * np.log(into + 1)[None]
    at = np.arange(len(cls))
    own_right = np.maximum(bigram[cls] - right, 0) + alpha
    own_out = np.maximum(out_of[cls] - total, 0) + alpha * (k + 1)
    own_left = np.maximum(bigram[:, cls].T - left, 0) + alpha
    own_before = bigram.sum(1)[None] + alpha * (k + 1)
    own = (right * np.log(own_right / own_out[:, None])).sum(1) + (left * np.log(own_left / own_before)).sum(1)
    own -= total * np.log(np.maximum(into[cls] - total, 0) + 1)
    score[at, cls] = own
    best = score.argmax(1)
    return np.where(score[at, best] > own + 1e-9, best, cls)


def train(
    docs: DataFrame, text_col: str = "text", classes: int = 64, vocab_bits: int | None = None, rounds: int = 3, alpha: float = 0.1
) -> Model:
    """Classes and counts from all words of all texts; see the module's text."""
    if not 2 <= classes <= 127 or not (vocab_bits is None or SHARD_BITS <= vocab_bits <= 22):
        raise ValueError("classes must be 2 to 127, vocab_bits 8 to 22 or None")
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.col(q(text_col)).isNotNull()).select(F.lower(F.col(q(text_col))).alias("text"))
    if vocab_bits is None:
        hashes, counts = distinct_words(texts)
        model, local = Model(Vocabulary(hashes), classes, alpha), LOCAL_BITS
        model.count[:-1] = counts
    else:
        model, local = Model(Vocabulary(None, vocab_bits), classes, alpha), vocab_bits - SHARD_BITS

        def unigrams(batches):
            hasher = Hasher()
            for batch in parts(batches, 0):
                word, _ = words_in(batch.column(0), vocabulary.value, hasher)
                keys, counts = np.unique(word, return_counts=True)
                yield pack(keys, counts, local)

        def added(group: pa.Table) -> pa.Table:
            keys, counts = unpack(group)
            shard = group["shard"][0].as_py()
            dense = np.bincount(keys, weights=counts, minlength=1 << local).astype(np.int64)
            return pa.table({"shard": pa.array([shard], pa.int32()), "dense": pa.array([dense.tobytes()], pa.binary())})

    vocabulary = sc.broadcast(model.vocabulary)
    if vocab_bits is not None:
        for row in texts.mapInArrow(unigrams, BLOCKS).groupBy("shard").applyInArrow(added, "shard int, dense binary").collect():
            model.count[row.shard << local : (row.shard + 1) << local] = np.frombuffer(row.dense, np.int64)
    model.start()
    edge = classes
    for turn in range(rounds + 1):
        shared = sc.broadcast(model.cls)  # a byte per word number
        last = turn == rounds

        def around(batches):
            hasher, cls, total = Hasher(), shared.value, np.zeros((edge + 1) ** 2, np.int64)
            for batch in parts(batches, 0):
                word, bounds = words_in(batch.column(0), vocabulary.value, hasher)
                own, left, right = neighbours(word, bounds, cls, edge)
                total += np.bincount(left * (edge + 1) + own, minlength=len(total))
                total += np.bincount((own * (edge + 1) + edge)[right == edge], minlength=len(total))
                if not last:
                    both = np.concatenate([word * 256 + left, word * 256 + 128 + right])
                    keys, counts = np.unique(both, return_counts=True)
                    yield pack(keys, counts, local + 8)
            yield pack(np.zeros(0, np.int64), np.zeros(0), 0, [(-1, total.tobytes(), b"")])

        def summed(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.int64) for x in group["keys"].to_pylist())
            return pa.table({"dense": pa.array([total.tobytes()], pa.binary())})

        found = texts.mapInArrow(around, BLOCKS)
        found = found if last else cut(found)
        bigram = found.where("shard = -1").groupBy("shard").applyInArrow(summed, "dense binary").collect()
        for row in bigram:
            model.bigram = np.frombuffer(row.dense, np.int64).reshape(edge + 1, edge + 1).astype(float)
        if last or not bigram:
            break
        matrix = model.bigram

        def exchanged(group: pa.Table) -> pa.Table:
            shard = group["shard"][0].as_py()
            keys, counts = unpack(group)
            cls = shared.value[shard << local : (shard + 1) << local].astype(np.int64)
            dense = np.bincount(keys, weights=counts, minlength=len(cls) << 8).reshape(len(cls), 2, 128)
            seen = np.flatnonzero(dense.sum((1, 2)))
            new = cls.copy()
            new[seen] = move(dense[seen, 0, : edge + 1], dense[seen, 1, : edge + 1], cls[seen], matrix, alpha)
            return pa.table(
                {"shard": pa.array([shard], pa.int32()), "dense": pa.array([new.astype(np.uint8).tobytes()], pa.binary())}
            )

        moved = found.where("shard >= 0").groupBy("shard").applyInArrow(exchanged, "shard int, dense binary").collect()
        model.cls = model.cls.copy()
        for row in moved:
            model.cls[row.shard << local : (row.shard + 1) << local] = np.frombuffer(row.dense, np.uint8)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(<id>, n_words, log_likelihood, perplexity) of each row.

    The likelihood covers every word of the text, the first one after the text's edge, and the edge at
    its end; the perplexity is per word. Null and wordless texts have 0 words, likelihood 0 and null
    perplexity. Rows that repeat give equal rows; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    tables = sc.broadcast((model.vocabulary, model.cls, model.emissions(), model.transitions()))
    edge = model.classes

    def likelihood(batches):
        hasher = Hasher()
        vocabulary, cls, emit, step = tables.value
        for batch in parts(batches, 1):
            word, bounds = words_in(batch.column(1), vocabulary, hasher)
            own, left, right = neighbours(word, bounds, cls, edge)
            value = step[left, own] + emit[word] + np.where(right == edge, step[own, edge], 0)
            sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            n = np.diff(bounds)
            total = sums[bounds[1:]] - sums[bounds[:-1]]
            with np.errstate(over="ignore"):
                perplexity = np.exp(-total / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(total), pa.array(perplexity, mask=n == 0)],
                names=[id_col, "n_words", "log_likelihood", "perplexity"],
            )

    staged = docs.select(F.col(q(id_col)).alias("id"), F.lower(F.col(q(text_col))).alias("text"))
    schema = docs.select(F.col(q(id_col))).schema.add("n_words", "long").add("log_likelihood", "double")
    return staged.mapInArrow(likelihood, schema.add("perplexity", "double"))
