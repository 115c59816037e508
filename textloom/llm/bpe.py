"""Byte-level BPE by replaying merges over the words of a corpus part.

Texts are cut into words as the public byte-level vocabularies expect. The distinct words that are new to
a partition of the corpus lie in one flat array of symbols, with an inverted index from token pair to the positions where it occurs.
Merges are replayed in rank order: each takes all positions of its pair at once, joins them, and enters
only the pairs with the touched neighbours into the index. The words' tokens are kept for the rest of the
partition, so no word is replayed twice there, and copied to every place in the texts. Decoding concatenates the tokens' bytes. No rows shuffle.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import Hasher, ranges, row_slices
from textloom.llm.common import numbered, q

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SLICE_WORDS = 1 << 19
SLICE_BYTES = 1 << 23
KNOWN_WORDS = 1 << 22


def character_classes() -> np.ndarray:
    """The class of every code point: letters, numbers, white space, others."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    return out


def word_starts(points: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where each word begins, in texts laid end to end.

    A word is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of others with
    at most one blank before it, or white space that nothing follows or up to its last character.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    opens = np.zeros(n + 1, bool)
    opens[text_starts] = True
    opens[n] = True
    begin = np.ones(n + 1, bool)
    begin[1:n] = (kind[1:] != kind[:-1]) | opens[1:n]
    ends = np.flatnonzero(begin[1:]) + 1  # ends of runs
    last = ends[(kind[ends - 1] == SPACE) & ~opens[ends]] - 1  # last white space before something in the text
    begin[last] = True
    begin[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & begin[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~opens[quote + 1]]
    one = points[quote + 1]
    inside = quote + 2 < n
    two = np.where(inside, points[np.minimum(quote + 2, n - 1)], 0)
    two[inside & opens[np.minimum(quote + 2, n)]] = 0
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
    double |= (one == ord("l")) & (two == ord("l"))
    for where, size in ((quote[single], 2), (quote[double], 3)):
        begin[where + 1] = False
        begin[where + size] = True
    return np.flatnonzero(begin[:n])


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary, the pair that makes each token, and the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.size = size
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                best = min(
                    ((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank),
                    default=None,
                )
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
        made = np.flatnonzero(self.left >= 0)
        key = self.left[made] * size + self.right[made]
        order = np.argsort(key)
        self.pair, self.merged = key[order], made[order]
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the pair does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], -1)


def load(path: str) -> Vocabulary:
    """A vocabulary from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as file:
        lines = (line.split() for line in file if line.strip())
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in lines})


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words, end to end, and their number in each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    symbol = vocab.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        good = ranks >= 0
        positions, ranks = positions[good], ranks[good]
        if not len(ranks):
            return
        by = np.argsort(ranks, kind="stable")
        positions, ranks = positions[by], ranks[by]
        cuts = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(ranks)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            r = int(ranks[a])
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(order, r)

    at = np.flatnonzero(after >= 0)
    enter(at, vocab.rank(symbol[at], symbol[after[at]]))
    while order:
        r = heapq.heappop(order)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        left, right = vocab.left[r], vocab.right[r]
        at = at[alive[at] & (symbol[at] == left)]
        to = after[at]
        good = to >= 0
        at, to = at[good], to[good]
        good = symbol[to] == right
        at = at[good]
        if left == right and len(at) > 1:  # of overlapping pairs take every other one, from the left
            at = np.unique(at)
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            first = np.maximum.accumulate(np.where(follows, 0, place))
            at = at[(place - first) % 2 == 0]
        if not len(at):
            continue
        to = after[at]
        symbol[at] = r
        alive[to] = False
        symbol[to] = -1
        beyond = after[to]
        after[at] = beyond
        tail = beyond >= 0
        before[beyond[tail]] = at[tail]
        ahead = before[at]
        head = ahead >= 0
        left_at = ahead[head]
        enter(
            np.concatenate([left_at, at[tail]]),
            vocab.rank(
                np.concatenate([symbol[left_at], symbol[at[tail]]]), np.concatenate([symbol[at[head]], symbol[beyond[tail]]])
            ),
        )
    return symbol[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))


class Words:
    """Tokens of the words met so far, by the words' sorted hashes; it starts again beyond ``KNOWN_WORDS``."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, word) -> np.ndarray:
        """Places among the known words of sorted, distinct hashes; ``word`` gives the bytes of those at some indices."""
        if len(self.hashes) + len(hashes) > KNOWN_WORDS:
            self.clear()
        place = np.searchsorted(self.hashes, hashes)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            tokens, number = replay(word(new), self.vocab)
            at = np.cumsum(number) - number + len(self.tokens)
            self.tokens = np.concatenate([self.tokens, tokens])
            self.at, self.number = np.insert(self.at, place[new], at), np.insert(self.number, place[new], number)
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
        return np.searchsorted(self.hashes, hashes)


def encode_texts(texts: list[str], words: Words, classes: np.ndarray, hasher: Hasher):
    """Each word's place among the known words, and the word at which texts begin."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    starts = word_starts(points, begins[sizes > 0], classes)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    hashes, first, place = np.unique(hasher.ranges(points, starts, ends), return_index=True, return_inverse=True)
    joined = "".join(texts)
    found = words.find(hashes, lambda new: [joined[a:b].encode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
    return found[place], np.append(np.searchsorted(starts, begins), len(starts))


def tokens_to_bytes(tokens: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    return vocab.bytes[ranges(vocab.start[tokens], vocab.length[tokens])]


def bpe_encode(
    docs: DataFrame, vocab_path: str, text_col: str = "text", id_col: str = "doc_id", verify: bool = False
) -> DataFrame:
    """(<id>, tokens, n_tokens) of each row, and with ``verify`` round_trip, whether decoding gives the text.

    A null text has null tokens, number and round trip; an empty text has no tokens. Strings of special
    tokens in a text are ordinary text. Rows that repeat give equal rows; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((load(vocab_path), character_classes()))  # as large as the vocabulary
    names = [id_col, "tokens", "n_tokens"] + ["round_trip"] * verify

    def encode(batches):
        vocab, classes = shared.value
        hasher, words = Hasher(), Words(vocab)
        for batch in (b.slice(*part) for b in batches for part in row_slices(b.column(1), SLICE_BYTES)):
            column = batch.column(1)
            texts = [t or "" for t in column.to_pylist()]
            place, bounds = encode_texts(texts, words, classes, hasher)
            tokens, number, begin = words.tokens, words.number, words.at
            at = 0
            while at < len(texts):  # whole texts, about SLICE_WORDS words at a time
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_WORDS, side="right")) - 1)
                to = min(to, len(texts))
                mine = place[bounds[at] : bounds[to]]
                flat = tokens[ranges(begin[mine], number[mine])]
                per_word = np.concatenate([[0], np.cumsum(number[mine])])
                offsets = per_word[bounds[at : to + 1] - bounds[at]]
                null = np.array([not x.is_valid for x in column.slice(at, to - at)]) if column.null_count else np.zeros(to - at, bool)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(flat))
                arrays = [batch.column(0).slice(at, to - at), lists, pa.array(np.diff(offsets).astype(np.int64), mask=null)]
                if verify:
                    made = tokens_to_bytes(flat, vocab)
                    want = "".join(texts[at:to]).encode()
                    if made.tobytes() == want:
                        same = np.ones(to - at, bool)
                    else:
                        same = np.array(
                            [tokens_to_bytes(flat[a:b], vocab).tobytes() == t.encode() for a, b, t in zip(offsets, offsets[1:], texts[at:to])]
                        )
                    arrays.append(pa.array(same, mask=null))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                at = to

    staged = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text"))
    blank = docs.select(F.col(q(id_col)), F.lit(None).cast("array<int>").alias("tokens"), F.lit(None).cast("long").alias("n_tokens"))
    schema = blank.schema.add("round_trip", "boolean") if verify else blank.schema
    return staged.mapInArrow(encode, schema)


def bpe_decode(rows: DataFrame, vocab_path: str, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """``rows`` with the text that the tokens spell; a column of that name is replaced.

    Null lists give null and empty lists empty texts. Null tokens and numbers outside the vocabulary are
    skipped; bytes that are not UTF-8 become U+FFFD.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load(vocab_path))
    cols = [c for c in rows.columns if c.lower() != text_col.lower()]

    def decode(batches):
        vocab = shared.value
        for batch in batches:
            texts = []
            for value in batch.column(len(cols)):
                ids = value.as_py()
                if ids is None:
                    texts.append(None)
                    continue
                ids = np.array([t for t in ids if t is not None and 0 <= t < vocab.size], np.int64)
                texts.append(tokens_to_bytes(ids, vocab).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(cols)] + [pa.array(texts, pa.string())], names=[*cols, text_col])

    staged = numbered(rows, cols, F.col(q(tokens_col)).alias("tokens"))
    return staged.mapInArrow(decode, rows.select(*[F.col(q(c)) for c in cols]).schema.add(text_col, "string"))
