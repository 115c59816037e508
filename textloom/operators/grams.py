"""N-grams of chunks, made a batch at a time: words as numbers, runs by shifting, strings only for what is emitted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import constants as K
from textloom.functions import text as X

SLICE_WORDS = 1 << 18
ASKED = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def gram_hashes(grams: list[str]) -> np.ndarray:
    """64 bits for each n-gram, by its words; the same as of runs of words in a batch."""
    parts = [g.split(" ") for g in grams]
    own = dict(zip(words := sorted({w for p in parts for w in p}), _word_hashes(words).tolist()))
    out = np.zeros(len(grams), np.uint64)
    for i, p in enumerate(parts):
        h = np.zeros(1, np.uint64)
        for w in p:
            h = _mix(h * _MUL + np.uint64(own[w]))
        out[i] = h[0]
    return out


def asked_hashes(grams: DataFrame) -> np.ndarray | None:
    """Sorted hashes of a one-column table of n-grams; None if there are more than ``ASKED`` distinct ones."""
    rows = grams.distinct().limit(ASKED + 1).collect()
    return None if len(rows) > ASKED else np.sort(gram_hashes([r[0] for r in rows]))


class Batch:
    """The words of some rows: distinct ones, the number of each in place, and the row of each place."""

    def __init__(self, lists: pa.ListArray) -> None:
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.word, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(length)), length)
        self.texts = self.word.to_pylist()
        self.hash = _word_hashes(self.texts)
        self.size = pc.utf8_length(self.word).to_numpy(zero_copy_only=False)

    def test(self, words: frozenset, lower: bool = False) -> np.ndarray:
        """Whether each distinct word is one of those."""
        return np.array([(w.lower() if lower else w) in words for w in self.texts], bool)

    def runs(self, n: int, ok: np.ndarray | None) -> np.ndarray:
        """Where runs of n words of a row begin; their ends satisfy ``ok``, by distinct word."""
        if len(self.row) < n:
            return np.zeros(0, np.int64)
        last = len(self.row) - n + 1
        fits = self.row[:last] == self.row[n - 1 :]
        if ok is not None:
            good = ok[self.code]
            fits &= good[:last] & good[n - 1 :]
        return np.flatnonzero(fits)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = _mix(h * _MUL + self.hash[self.code[at + i]])
        return h

    def strings(self, at: np.ndarray, n: int) -> pa.Array:
        if n == 1:
            return self.word.take(pa.array(self.code[at]))
        return pc.binary_join_element_wise(*[self.word.take(pa.array(self.code[at + i])) for i in range(n)], pa.scalar(" ", self.word.type))


def slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Whole rows, some hundred thousand words at a time."""
    for batch in batches:
        length = pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(length), 0
        while at < len(length):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + SLICE_WORDS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each (row, hash), in no particular order, and how often it occurs."""
    key = _mix(h ^ _mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return first, times


def gram_rows(
    chunks: DataFrame, id_col: str, min_n: int = 2, max_n: int = 4, singles: str | None = "long", only: np.ndarray | None = None
) -> DataFrame:
    """(<id>, idx, gram, size, n) of every distinct n-gram of a chunk's words, and how often it occurs there.

    Ends of runs are neither common nor noise. ``singles`` adds words: "long" those of five characters or more that are
    neither, each once; "terms" those of two or more that are not noise. ``only`` keeps n-grams of these hashes.
    """
    kind = chunks.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("idx", chunks.schema["idx"].dataType), T.StructField("gram", T.StringType())])
    schema = schema.add("size", "integer").add("n", "long")
    stop, noise = X.STOP_TERMS, K.NOISE_TERMS

    def emit(batches):
        for part in slices(batches, 2):
            b = Batch(part.column(2))
            ok = ~b.test(stop, True)
            kinds = [(n, b.runs(n, ok)) for n in range(min_n, max_n + 1)]
            if singles == "long":
                kinds.append((1, np.flatnonzero((ok & (b.size > 4))[b.code])))
            elif singles == "terms":
                kinds.append((1, np.flatnonzero((~b.test(noise) & (b.size > 1))[b.code])))
            for n, at in kinds:
                h = b.hashes(at, n)
                if only is not None:
                    place = np.minimum(np.searchsorted(only, h), max(0, len(only) - 1))
                    keep = only[place] == h if len(only) else np.zeros(len(h), bool)
                    at, h = at[keep], h[keep]
                first, times = _distinct(b.row[at], h)
                if n == 1 and singles == "long":
                    times = np.ones(len(first), np.int64)
                at = at[first]
                rows = pa.array(b.row[at])
                for i in range(0, len(at), 1 << 17):
                    s = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows[s]), part.column(1).take(rows[s]), b.strings(at[s], n), pa.array(np.full(len(at[s]), n, np.int32)),
                         pa.array(times[s].astype(np.int64))],
                        names=schema.names,
                    )

    return chunks.select(F.col(id_col), "idx", "words").mapInArrow(emit, schema)


def cut_suffix(word: str, pattern: re.Pattern) -> str:
    found = pattern.fullmatch(word)
    return next(x for x in found.groups() if x is not None) if found else word


def stem_rows(chunks: DataFrame, id_col: str, only: np.ndarray | None = None, content: bool = True) -> DataFrame:
    """(<id>, idx, w) of every distinct stem of a chunk's words: with ``content`` of those of three characters or more that
    are neither common nor noise, otherwise of all, beside the words themselves."""
    kind = chunks.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("idx", chunks.schema["idx"].dataType), T.StructField("w", T.StringType())])
    stop, pattern = X.STOP_TERMS, "|".join(f"(.{{3,}}){s}" for s in X.STEM_SUFFIXES)

    def emit(batches):
        shape = re.compile(pattern)
        for part in slices(batches, 2):
            b = Batch(part.column(2))
            stems = [cut_suffix(w, shape) for w in b.texts]
            names = sorted(set(stems) | set(b.texts)) if not content else sorted(set(stems))
            number = {w: i for i, w in enumerate(names)}
            of = np.array([number[w] for w in stems], np.int64)
            keep = np.ones(len(b.texts), bool)
            if content:
                keep = ~b.test(stop) & (b.size > 2)
            wanted = np.ones(len(names), bool)
            if only is not None and len(names):
                h = gram_hashes(names)
                place = np.minimum(np.searchsorted(only, h), max(0, len(only) - 1))
                wanted = only[place] == h if len(only) else np.zeros(len(names), bool)
            row, w = b.row[keep[b.code]], of[b.code[keep[b.code]]]
            if not content:
                own = np.array([number[x] for x in b.texts], np.int64)
                row, w = np.concatenate([row, b.row]), np.concatenate([w, own[b.code]])
            row, w = row[wanted[w]], w[wanted[w]]
            both = np.unique(row * max(1, len(names)) + w)
            row, w = both // max(1, len(names)), both % max(1, len(names))
            rows, texts = pa.array(row), pa.array(names, pa.string())
            for i in range(0, len(row), 1 << 17):
                s = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows[s]), part.column(1).take(rows[s]), texts.take(pa.array(w[s]))], names=schema.names)

    return chunks.select(F.col(id_col), "idx", "words").mapInArrow(emit, schema)


# ---- whole documents


URL_MARK = re.compile(r"isbn|issn|[.:/]", re.I)


def whole_documents(batches: Iterator[pa.RecordBatch], words: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with a document, and the number of each row's document in them.

    The first column is the document; its rows follow each other (see :func:`textloom.plans.shared.by_document`).
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in batches if words is None else slices(batches, words):
        if part.num_rows == 0:
            continue
        held.append(part)
        size += part.num_rows if words is None else len(part.column(words).flatten())
        if words is not None and size < SLICE_WORDS:
            continue
        batch = joined()
        number = _document_numbers(batch.column(0))
        last = int(np.searchsorted(number, number[-1]))
        held, size = [batch], 2 * SLICE_WORDS if words is None else 0
        if last:
            yield batch.slice(0, last), number[:last]
            held, size = [batch.slice(last)], 0
    if held:
        batch = joined()
        yield batch, _document_numbers(batch.column(0))


def _document_numbers(ids: pa.Array) -> np.ndarray:
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.append(0, code[1:] != code[:-1]))


class DocumentTerms:
    """The distinct terms of each document of a batch, as :func:`gram_rows` makes them of chunks with ``singles="terms"``:
    by document and term the size ``n``, a place ``at``, the occurrences ``freq`` and the number of chunks ``chunks``."""

    def __init__(self, batch: pa.RecordBatch, doc: np.ndarray, max_n: int = 3) -> None:
        self.batch, self.b = batch, Batch(batch.column(2))
        b, idx = self.b, batch.column(1).to_numpy(zero_copy_only=False)
        ok, marked = ~b.test(X.STOP_TERMS, True), np.array([bool(URL_MARK.search(w)) for w in b.texts], bool)
        noise = re.compile(X.URL_NOISE)
        places, sizes, hashes = [], [], []
        for n in range(1, max_n + 1):
            at = np.flatnonzero((~b.test(K.NOISE_TERMS) & (b.size > 1))[b.code]) if n == 1 else b.runs(n, ok)
            if n > 1 and marked.any():
                some = np.zeros(len(at), bool)
                for i in range(n):
                    some |= marked[b.code[at + i]]
                spots = np.flatnonzero(some)
                bad = [noise.search(t) is not None for t in b.strings(at[spots], n).to_pylist()]
                at = np.delete(at, spots[np.array(bad, bool)])
            places.append(at)
            sizes.append(np.full(len(at), n, np.int8))
            hashes.append(b.hashes(at, n))
        at, n = np.concatenate(places), np.concatenate(sizes)
        self.doc_of_place = doc[b.row]
        key = self.keys(np.concatenate(hashes), self.doc_of_place[at])
        order = np.argsort(key, kind="stable")
        key, spot = key[order], idx[b.row[at[order]]]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        fresh = new.copy()
        fresh[1:] |= spot[1:] != spot[:-1]
        first = np.flatnonzero(new)
        self.freq = np.diff(np.append(first, len(key)))
        self.chunks = np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        self.key, self.at, self.n = key[first], at[order[first]], n[order[first]]
        self.doc = self.doc_of_place[self.at]
        self._spots, self._ends = spot[fresh], np.cumsum(self.chunks)
        self.total = np.bincount(doc)

    @staticmethod
    def keys(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return _mix(h ^ _mix(doc.astype(np.uint64) + np.uint64(1)))

    def pmi(self) -> np.ndarray:
        """Of each term: 1 for single words, otherwise at least 0; see :func:`textloom.operators.index.pmi`."""
        b, out = self.b, np.ones(len(self.at))
        one = np.flatnonzero(self.n == 1)
        keys, df = np.append(self.key[one], np.uint64(0)), np.append(self.chunks[one], 0)
        for n in np.unique(self.n[self.n > 1]).tolist():
            some = np.flatnonzero(self.n == n)
            logs, known = np.zeros(len(some)), np.ones(len(some), bool)
            for i in range(n):
                k = self.keys(b.hashes(self.at[some] + i, 1), self.doc[some])
                place = np.searchsorted(keys[:-1], k)
                found = (keys[place] == k) & (place < len(one))
                known &= found
                logs += np.log(np.where(found, df[place], 1))
            total = np.log(self.total[self.doc[some]])
            value = (np.log(self.freq[some]) - total - (logs - n * total)) / np.log(2.0)
            out[some] = np.where(known, np.maximum(value, 0.0), 0.0)
        return out

    def most_frequent(self, k: int, least: int = 5) -> np.ndarray:
        """Of each document the k most frequent terms of ``least`` characters that are neither common nor noise, in order."""
        b = self.b
        rank = np.empty(len(b.texts), np.int64)
        rank[np.array(sorted(range(len(b.texts)), key=b.texts.__getitem__), np.int64)] = np.arange(len(b.texts))
        length, name = np.full(len(self.at), -1, np.int64), np.zeros(len(self.at), np.int64)
        for i in range(3):  # a batch has fewer than 2**21 different words, so the places of three make one number
            code = b.code[np.minimum(self.at + i, len(b.code) - 1)]
            length += np.where(self.n > i, b.size[code] + 1, 0)
            name = (name << 21) + np.where(self.n > i, rank[code] + 1, 0)
        fits = (length >= least) & ((self.n > 1) | ~b.test(X.STOP_TERMS)[b.code[self.at]])
        often = np.bincount(self.doc[fits & (self.freq > 1)], minlength=len(self.total)) >= k
        some = np.flatnonzero(fits & ((self.freq > 1) | ~often[self.doc]))
        some = some[np.lexsort([name[some], -self.freq[some], self.doc[some]])]
        doc = self.doc[some]
        begin = np.searchsorted(doc, doc)
        return some[np.arange(len(some)) - begin < k]

    def spots(self, of: np.ndarray) -> pa.ListArray:
        """The chunks of those terms, each once and in order."""
        n = self.chunks[of]
        ends = np.cumsum(n)
        at = np.repeat(self._ends[of] - ends, n) + np.arange(ends[-1] if len(ends) else 0)
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(self._spots[at]))

    def texts(self, of: np.ndarray) -> pa.Array:
        out, place = [], []
        for n in np.unique(self.n[of]).tolist():
            some = np.flatnonzero(self.n[of] == n)
            out.append(self.b.strings(self.at[of[some]], n))
            place.append(some)
        if not out:
            return pa.array([], pa.string())
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(place))))

    def ids(self, of: np.ndarray) -> pa.Array:
        return self.batch.column(0).take(pa.array(self.b.row[self.at[of]]))


def document_terms(chunks: DataFrame, id_col: str, values: tuple = ("freq", "chunks"), least: int = 1) -> DataFrame:
    """(<id>, term, ...) of every term of each document, with those of freq, chunks, chunk_ids, total_chunks and pmi that are
    asked for, in place: the rows of a document must follow each other. ``least`` leaves out terms that are rarer."""
    kinds = {"freq": "long", "chunks": "long", "chunk_ids": f"array<{chunks.schema['idx'].dataType.simpleString()}>", "total_chunks": "long", "pmi": "double"}
    schema = f"`{id_col}` {chunks.schema[id_col].dataType.simpleString()}, term string, " + ", ".join(f"{v} {kinds[v]}" for v in values)

    def emit(batches):
        for batch, doc in whole_documents(batches, 2):
            t = DocumentTerms(batch, doc)
            pmi = t.pmi() if "pmi" in values else None
            every = np.flatnonzero(t.freq >= least)
            for i in range(0, len(every), 1 << 16):
                of = every[i : i + (1 << 16)]
                made = {
                    "freq": lambda: pa.array(t.freq[of]), "chunks": lambda: pa.array(t.chunks[of]), "chunk_ids": lambda: t.spots(of),
                    "total_chunks": lambda: pa.array(t.total[t.doc[of]]), "pmi": lambda: pa.array(pmi[of]),
                }
                yield pa.RecordBatch.from_arrays([t.ids(of), t.texts(of), *[made[v]() for v in values]], names=[id_col, "term", *values])

    return chunks.select(id_col, "idx", "words").mapInArrow(emit, schema)


def frequent_terms(chunks: DataFrame, id_col: str, k: int = 20) -> DataFrame:
    """(<id>, labels, chunk_ids): a row per document with its k most frequent longer terms, and the chunks of each, in place:
    the rows of a document must follow each other."""
    schema = f"`{id_col}` {chunks.schema[id_col].dataType.simpleString()}, labels array<string>, chunk_ids array<array<{chunks.schema['idx'].dataType.simpleString()}>>"

    def emit(batches):
        for batch, doc in whole_documents(batches, 2):
            t = DocumentTerms(batch, doc)
            of = t.most_frequent(k)
            if not len(of):
                continue
            first = np.flatnonzero(np.append(True, np.diff(t.doc[of]) != 0))
            offsets = pa.array(np.append(first, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (t.texts(of), t.spots(of))]
            yield pa.RecordBatch.from_arrays([t.ids(of[first]), *lists], names=[id_col, "labels", "chunk_ids"])

    return chunks.select(id_col, "idx", "words").mapInArrow(emit, schema)


# ---- statistics of hash tables


_M32 = np.uint64(0xFFFFFFFF)


def table_hashes(texts: pa.Array) -> np.ndarray:
    """(3, texts): the hashes of :func:`textloom.functions.measures.hash_all`, of 32 bits each."""
    flat = texts.cast(pa.binary()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.binary())
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    raw = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None and len(flat.buffers()[2]) else np.zeros(1, np.uint8)
    begin, size = ends[:-1], np.diff(ends)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    f, m, d = (np.full(len(flat), x, np.uint64) for x in (2166136261, 2538058380, 5381))
    mul = np.uint64(1540483477)
    n = len(flat)
    for i in range(int(size[0]) if n else 0):  # longest first: those that have an i-th byte are a prefix
        n = int(np.searchsorted(-size[:n], -i, side="left"))
        x = raw[begin[:n] + i].astype(np.uint64)
        f[:n] = ((f[:n] ^ x) * np.uint64(16777619)) & _M32
        d[:n] = (d[:n] * np.uint64(33) + x) & _M32
        v = ((m[:n] ^ x) * mul) & _M32
        m[:n] = v ^ (v >> np.uint64(15))
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.uint64)[order]
    m = ((m ^ chars) * mul) & _M32
    m = m ^ (m >> np.uint64(13))
    out = np.empty((3, len(flat)), np.uint64)
    out[:, order] = f, m, d
    return out


def table_sizes(entries: np.ndarray, load: float, least: int = 4096) -> np.ndarray:
    need, size = np.floor(entries / load), np.full(len(entries), least, np.int64)
    while (size < need).any():
        size = np.where(size < need, size * 2, size)
    return size


def table_counts(chunks: DataFrame, id_col: str, load: float) -> DataFrame:
    """(<id>, unique_ngrams, total_insertions, table_size, used_slots, collisions) of each document, in place: its rows must
    follow each other. See :func:`textloom.operators.index.table_stats`."""
    names = ["unique_ngrams", "total_insertions", "table_size", "used_slots", "collisions"]
    schema = T.StructType([chunks.schema[id_col], *[T.StructField(c, T.LongType()) for c in names]])

    def emit(batches):
        for batch, doc in whole_documents(batches, 2):
            b, idx = Batch(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ok = ~b.test(X.STOP_TERMS, True)
            kinds = [(n, b.runs(n, ok)) for n in (2, 3, 4)]
            one = np.flatnonzero((ok & (b.size > 4))[b.code])
            kinds.append((1, np.sort(one[np.unique(b.row[one] * max(1, len(b.texts)) + b.code[one], return_index=True)[1]])))
            row_at = np.searchsorted(b.row, np.arange(batch.num_rows))
            found = []
            for k, (n, at) in enumerate(kinds):  # places in order of chunk, then of size, words by themselves being last
                row = b.row[at]
                found.append((at, np.full(len(at), n), DocumentTerms.keys(b.hashes(at, n), doc[row]), (idx[row] * 4 + k) * (1 << 34) + at - row_at[row]))
            at, n, key, place = (np.concatenate(c) for c in zip(*found))
            if not len(at):
                continue
            order = np.lexsort([place, key])
            at, n, key, place = at[order], n[order], key[order], place[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            at, n, place = at[first], n[first], place[first]
            own = doc[b.row[at]]
            docs, of = np.unique(own, return_inverse=True)
            inserted = np.bincount(of, weights=times).astype(np.int64)
            size = table_sizes(inserted, load)
            used, lost = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            texts = pa.concat_arrays([b.strings(at[n == x], x) for x in (1, 2, 3, 4)])
            texts = texts.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(n == x) for x in (1, 2, 3, 4)]))))
            name = None
            for h in table_hashes(texts):
                slot = (h % size[of].astype(np.uint64)).astype(np.int64)
                where = of * int(size.max()) + slot
                held = np.lexsort([place, where])
                where_, place_ = where[held], place[held]
                new = np.append(True, where_[1:] != where_[:-1])
                same = np.flatnonzero(~new & np.append(False, place_[1:] == place_[:-1]))
                if len(same):  # of rows of one document with the same number: the first by name holds the slot
                    name = np.argsort(np.argsort(np.array(texts.to_pylist(), object))) if name is None else name
                    held = np.lexsort([name, place, where])
                used += np.bincount(of[held[new]], minlength=len(docs))
                lost += np.bincount(of[held[~new]], weights=times[held[~new]], minlength=len(docs)).astype(np.int64)
            ids = batch.column(0).take(pa.array(b.row[at[np.unique(of, return_index=True)[1]]]))
            counts = [np.bincount(of), 3 * inserted, size, used, lost]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in counts]], names=[id_col, *names])

    return chunks.select(id_col, "idx", "words").mapInArrow(emit, schema)


def posting_counts(chunks: DataFrame, id_col: str) -> DataFrame:
    """(<id>, idx, grams, multi, chars) of the postings of each chunk, in place: rows of a document must follow each other, in order."""
    schema = T.StructType([chunks.schema[id_col], chunks.schema["idx"], *[T.StructField(c, T.LongType()) for c in ("grams", "multi", "chars")]])

    def emit(batches):
        for batch, doc in whole_documents(batches, 2):
            b, idx = Batch(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            ok = ~b.test(X.STOP_TERMS, True)
            chunk = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (idx[1:] != idx[:-1])))
            grams, multi, chars = (np.zeros(chunk[-1] + 1, np.int64) for _ in range(3))
            for n in (1, 2, 3, 4):
                at = np.flatnonzero((ok & (b.size > 4))[b.code]) if n == 1 else b.runs(n, ok)
                at = at[_distinct(chunk[b.row[at]], b.hashes(at, n))[0]]
                own, length = chunk[b.row[at]], sum(b.size[b.code[at + i]].astype(np.int64) for i in range(n)) + n - 1
                grams += np.bincount(own, minlength=len(grams))
                multi += np.bincount(own, minlength=len(grams)) if n > 1 else 0
                chars += np.bincount(own, weights=length, minlength=len(grams)).astype(np.int64)
            some = np.flatnonzero(grams)
            rows = pa.array(np.searchsorted(chunk, some))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c[some]) for c in (grams, multi, chars)]], names=schema.names)

    return chunks.select(id_col, "idx", "words").mapInArrow(emit, schema)


# ---- frequencies over all documents


def packed_counts(chunks: DataFrame, id_col: str, parts: int, max_n: int = 4) -> DataFrame:
    """(part, counts): what some hundred thousand words of whole documents add to the n-grams of each part of all n-grams.

    Words of a batch are written once, n-grams as numbers of words, and the whole is compressed: it is the same n-gram
    that meets in a part, and each travels in a few bytes.
    """
    def emit(batches):
        for batch, doc in whole_documents(batches, 2):
            b, idx = Batch(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            ok = ~b.test(X.STOP_TERMS, True)
            of_part: list[list] = [[] for _ in range(parts)]
            for n in range(1, max_n + 1):
                at = np.flatnonzero((ok & (b.size > 4))[b.code]) if n == 1 else b.runs(n, ok)
                h = b.hashes(at, n)
                order = np.argsort(h, kind="stable")
                at, h = at[order], h[order]
                row = b.row[at]
                new = np.append(True, h[1:] != h[:-1])[: len(h)]
                other_doc = new | np.append(True, doc[row[1:]] != doc[row[:-1]])[: len(h)]
                other_row = other_doc | np.append(True, row[1:] != row[:-1])[: len(h)]
                other_chunk = other_doc | np.append(True, idx[row[1:]] != idx[row[:-1]])[: len(h)]
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                # a word by itself counts once in a chunk
                counts = np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (other_row if n == 1 else np.ones(len(h), bool), other_chunk, other_doc)])
                codes = np.stack([b.code[at[first] + i] for i in range(n)])
                part = ((h[first] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                by = np.lexsort([codes[0], part])
                ends = np.searchsorted(part[by], np.arange(parts + 1))
                codes, counts = codes[:, by], counts[:, by]
                for p in range(parts):
                    if ends[p] < ends[p + 1]:
                        of_part[p].append((codes[:, ends[p] : ends[p + 1]], counts[:, ends[p] : ends[p + 1]]))
            mine = np.zeros(len(b.texts), np.int64)
            for p, pieces in enumerate(of_part):
                if pieces:
                    mine[:] = 0
                    for codes, _ in pieces:
                        mine[codes] = 1
                    used = np.flatnonzero(mine)
                    mine[used] = np.arange(len(used))
                    yield _packed(p, [b.texts[i] for i in used.tolist()], [(mine[codes], counts) for codes, counts in pieces])

    return chunks.select(id_col, "idx", "words").mapInArrow(emit, "part int, counts binary")


def _packed(part: int, words: list[str], pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    import pickle
    import zlib

    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    pieces = [([small(np.diff(codes[0], prepend=0)), *map(small, codes[1:])], [*map(small, counts)]) for codes, counts in pieces]
    data = zlib.compress(pickle.dumps(("\n".join(words), pieces), 5), 1)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "counts"])


def summed_counts(packed: DataFrame) -> DataFrame:
    """(gram, size, occurrences, chunks, docs) of all n-grams, from :func:`packed_counts`."""
    schema = "gram string, size int, occurrences long, chunks long, docs long"

    def add(group: pa.Table) -> pa.Table:
        import pickle
        import zlib

        found: dict[int, list] = {}
        blobs = [pickle.loads(zlib.decompress(data.as_py())) for data in group["counts"]]
        lists = pc.split_pattern(pa.array([words for words, _ in blobs], pa.string()), "\n")
        names = lists.flatten().dictionary_encode()
        code, begin = names.indices.to_numpy(zero_copy_only=False).astype(np.int32), 0
        for n_words, (_, pieces) in zip(pc.list_value_length(lists).to_pylist(), blobs):
            own, begin = code[begin : begin + n_words], begin + n_words
            for place, counts in pieces:
                columns = [np.cumsum(place[0], dtype=np.int64), *place[1:]]
                found.setdefault(len(place), []).append((np.stack([own[c] for c in columns]), np.stack([c.astype(np.int32) for c in counts])))
        blobs.clear()
        word, out = names.dictionary, []
        for n, pieces in found.items():
            codes, counts = (np.concatenate(c, 1) for c in zip(*pieces))
            pieces.clear()
            order = np.lexsort(codes[::-1])
            codes, counts = codes[:, order], counts[:, order]
            first = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(0)))
            sums, codes = np.add.reduceat(counts, first, axis=1, dtype=np.int64), codes[:, first]
            texts = [word.take(pa.array(c)) for c in codes]
            gram = texts[0] if n == 1 else pc.binary_join_element_wise(*texts, " ")
            out.append(pa.table([gram, pa.array(np.full(len(first), n, np.int32)), *[pa.array(s) for s in sums]], names=["gram", "size", "occurrences", "chunks", "docs"]))
        return pa.concat_tables(out)

    return packed.groupBy("part").applyInArrow(add, schema)


# ---- the best chunks of each query


class Asked:
    """Strings that queries ask for: the hash of each, and the numbers of what it stands for (``owner``)."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        names = sorted({s for s, _ in rows})
        h = gram_hashes(names)
        order = np.argsort(h)
        self.hash = h[order]
        number = {names[i]: k for k, i in enumerate(order.tolist())}
        pairs = np.array(sorted({(number[s], o) for s, o in rows}), np.int64).reshape(-1, 2)
        self.begin, self.owner = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1)), pairs[:, 1]

    def met(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, owner) of each hash that is asked for, for all owners."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[place] == h)
        place = place[at]
        n = self.begin[place + 1] - self.begin[place]
        ends = np.cumsum(n)
        return np.repeat(at, n), self.owner[np.repeat(self.begin[place] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def met_pairs(b: Batch, asked: Asked, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(row * owners + owner, size) of what the postings of each row meet, each pair once, with the longest n-gram."""
    ok, found = ~b.test(X.STOP_TERMS, True), []
    for n in (1, 2, 3, 4):
        at = np.flatnonzero((ok & (b.size > 4))[b.code]) if n == 1 else b.runs(n, ok)
        i, owner = asked.met(b.hashes(at, n))
        found.append(np.unique((b.row[at[i]] * owners + owner) * 8 + n))
    both = np.unique(np.concatenate(found))
    key = both >> 3
    last = np.append(key[1:] != key[:-1], True)[: len(key)]
    return key[last], (both & 7)[last]


def best_rows(chunks: DataFrame, id_col: str, k: int, score, schema: T.StructType) -> DataFrame:
    """Rows (query_id, <id>, idx, ...) of the k best of each query in each batch of chunks (<id>, idx, words, toc).

    ``score(b, toc)`` gives (row, query number, query ids, descending keys, columns); ties are in order of the other keys that
    it names: chunk number and document.
    """
    def emit(batches):
        for part in slices(batches, 2):
            b = Batch(part.column(2))
            row, q, ids, keys, columns, by_document = score(b, part.column(3).to_numpy(zero_copy_only=False))
            if not len(row):
                continue
            doc = pc.rank(part.column(0), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)[row].astype(np.int64)
            idx = part.column(1).to_numpy(zero_copy_only=False)[row]
            order = np.lexsort([*((idx, doc) if by_document else (doc, idx)), *[-x for x in reversed(keys)], q])
            q = q[order]
            at = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            rows = pa.array(row[at])
            made = [ids.take(pa.array(queries_of(at, order, q))), part.column(0).take(rows), part.column(1).take(rows), *[pa.array(c[at]) for c in columns]]
            yield pa.RecordBatch.from_arrays([m.cast(f) for m, f in zip(made, to_arrow(schema))], names=schema.names)

    def queries_of(at, order, q):
        own = np.empty(len(order), np.int64)
        own[order] = q
        return own[at]

    def to_arrow(s):
        from pyspark.sql.pandas.types import to_arrow_type

        return [to_arrow_type(f.dataType) for f in s.fields]

    return chunks.select(id_col, "idx", "words", "toc").mapInArrow(emit, schema)
