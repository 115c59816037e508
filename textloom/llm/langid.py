"""Language identification of every word by a linear-chain conditional random field.

A word's score for each language sums learned weights of its affixes (two and three bytes at either
end), of the three-byte n-grams in it and of its lexicon entry, if it has one. A learned matrix of
transitions links neighbouring words of a line. Forward-backward gives each word's marginals, and the
likeliest language is its label, so text that switches languages is labelled word by word. All lines
of a batch advance together, one word a step, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrays import WORD_BYTE, Hasher, pieces, row_slices, spans, text_bytes
from textloom.llm.common import q, with_text

GRAM_BITS, AFFIX_BITS, LEXICON_BITS = 16, 16, 18
LINES_WORDS = 1 << 18
SLICE_BYTES = 1 << 21
HELD_OUT = 4
PRIOR = 30
MOST_ASKED = 0.9


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher):
    """Indices of the features of words: n-grams (one per byte, 0 between words), four affixes, word hash."""
    x = np.where(WORD_BYTE[buf], buf, 32).astype(np.uint32)
    pad = np.concatenate([[np.uint32(32)] * 3, x, [np.uint32(32)] * 3])
    gram = (pad[2:-4] | (pad[3:-3] << np.uint32(8)) | (pad[4:-2] << np.uint32(16))) * np.uint32(2654435761)
    gram >>= np.uint32(32 - GRAM_BITS)
    gram = np.where(WORD_BYTE[buf], np.maximum(gram, 1), 0)
    s, e = starts + 3, ends + 3
    affixes = []
    for kind, parts in enumerate(
        ((pad[s], pad[s + 1]), (pad[s], pad[s + 1], pad[s + 2]), (pad[e - 2], pad[e - 1]), (pad[e - 3], pad[e - 2], pad[e - 1]))
    ):
        v = np.full(len(s), kind + 1, np.uint32)
        for p in parts:
            v = v * np.uint32(0x01000193) ^ p
        affixes.append((v * np.uint32(2654435761)) >> np.uint32(32 - AFFIX_BITS))
    return gram, affixes, hasher.ranges(buf, starts, ends)


def without_digits(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf < 58))])
    return digits[ends] == digits[starts]


def forward_backward(score: np.ndarray, begin: np.ndarray, length: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Scaled forward and backward vectors of each word; ``step`` and ``start`` are weights, not logs."""
    e = np.exp(score - score.max(1, keepdims=True))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    if not len(begin):
        return e, alpha, beta
    longest = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    a = start * e[begin]
    a /= a.sum(1, keepdims=True)
    alpha[begin] = a
    for t in range(1, longest):
        at = begin[: active[t]] + t
        a = (a[: active[t]] @ step) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    back = np.ascontiguousarray(step.T)
    b = np.ones((len(begin), e.shape[1]), e.dtype)
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        b[: active[t]] = (b[: active[t]] * e[at]) @ back
        b[: active[t]] /= b[: active[t]].sum(1, keepdims=True)
        beta[at - 1] = b[: active[t]]
    return e, alpha, beta


class Model:
    """The languages and the weights of all features, transitions and starts."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.gram = np.zeros((1 << GRAM_BITS, n), np.float32)
        self.affix = np.zeros((1 << AFFIX_BITS, n), np.float32)
        self.lexicon = np.zeros((1 << LEXICON_BITS, n), np.float32)
        self.entry = np.zeros(1 << LEXICON_BITS, np.uint64)  # the word whose weights a slot has
        self.step, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        self.familiar = np.zeros(1 << GRAM_BITS, np.float32)  # whether an n-gram occurs in the sample
        self.min_familiar = 0.0

    def calibrate(self, gram: np.ndarray, starts: np.ndarray, plain: np.ndarray, doc: np.ndarray, lang: np.ndarray) -> None:
        """What share of familiar n-grams a text must have, from sample texts that are held out.

        The threshold is half-way from what texts of one language get from those of all others (the mean of
        the languages' medians) to a low quantile of what texts get from other texts of all languages, and at
        most ``MOST_ASKED``, as languages may share most n-grams and clean text has names and addresses.
        """
        size = np.diff(np.append(starts, len(gram)))
        byte_doc = np.repeat(doc, size)
        mine = np.where(np.repeat(plain, size), gram[starts[0] :], 0)
        inside = mine > 0

        def shares(out: np.ndarray) -> np.ndarray:
            known = np.zeros(1 << GRAM_BITS, bool)
            known[mine[inside & ~out]] = True
            held = inside & out
            n, hits = np.bincount(byte_doc[held]), np.bincount(byte_doc[held], weights=known[mine[held]])
            return (hits[n > 0] + PRIOR) / (n[n > 0] + PRIOR)

        near = np.concatenate([shares(byte_doc % HELD_OUT == k) for k in range(HELD_OUT)])
        far = [shares(lang[byte_doc] == k) for k in range(len(self.languages))]
        far = [float(np.median(x)) for x in far if len(x)]
        self.familiar[mine[inside]] = 1
        if len(near) and far:
            low = float(np.quantile(near, 0.02))
            self.min_familiar = max(0.0, min((low + sum(far) / len(far)) / 2, MOST_ASKED))

    def slot(self, words: np.ndarray) -> np.ndarray:
        """Lexicon slots of words; 0, which has no weight, for those without an entry."""
        at = (words >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        return np.where(self.entry[at] == words, at, 0)

    def scores(self, gram, starts, affixes, slot) -> np.ndarray:
        out = np.add.reduceat(self.gram[gram], starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)), np.float32)
        for a in affixes:
            out += self.affix[a]
        return out + self.lexicon[slot]

    def label(self, column: pa.Array, hasher: Hasher):
        """Label and probability of each word, how many of its n-grams the sample has and lacks, and the word at which each text begins."""
        buf, offsets = text_bytes(column)
        scores, lines, begins, familiar, at_line = [], [], [], [], 0
        for a, b in pieces(buf):
            piece = buf[a:b]
            s, e = spans(piece)
            breaks = np.cumsum(piece == 10)
            if len(s):
                gram, affixes, words = features(piece, s, e, hasher)
                scores.append(self.scores(gram, s, affixes, self.slot(words)))
                hits = np.add.reduceat(self.familiar[gram], s)
                familiar.append(np.stack([hits, e - s - hits], 1) * without_digits(piece, s, e)[:, None])
                lines.append(breaks[s] + at_line)
                begins.append(s + a)
            at_line += int(breaks[-1])
        if not scores:
            return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, 2)), np.zeros(len(offsets), np.int64)
        score, line, begin = np.concatenate(scores), np.concatenate(lines), np.concatenate(begins)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        length = np.diff(np.append(first, len(line)))
        step, start = np.exp(self.step), np.exp(self.start)
        label, sure = np.empty(len(line), np.int64), np.empty(len(line), np.float32)
        at = 0
        while at < len(first):  # a slice of whole lines, for memory
            to = max(at + 1, int(np.searchsorted(first, first[at] + LINES_WORDS)))
            w0, w1 = first[at], first[to] if to < len(first) else len(line)
            _, alpha, beta = forward_backward(score[w0:w1], first[at:to] - w0, length[at:to], step, start)
            p = alpha * beta
            label[w0:w1] = p.argmax(1)
            sure[w0:w1] = p.max(1) / p.sum(1)
            at = to
        return label, sure, np.concatenate(familiar), np.searchsorted(begin, offsets)


def fit(texts: list[str], labels: list[str], rounds: int = 25, rate: float = 0.5, min_count: int = 3) -> Model:
    """Maximise the likelihood of labelled word sequences by full-batch AdaGrad.

    Sequences are the lines of the texts, each word labelled with its text's language, and, so that
    transitions between languages are learned too, as many lines again spliced from two texts each.
    """
    languages = sorted(set(labels))
    model, n, hasher = Model(languages), len(languages), Hasher()
    rng = np.random.default_rng(7)
    buf, offsets = text_bytes(pa.array([t.lower() for t in texts], pa.string()))
    s, e = spans(buf)
    if not len(s) or n < 2:
        return model
    gram, affixes, words = features(buf, s, e, hasher)
    doc = np.searchsorted(offsets, s, side="right") - 1
    lang = np.array([languages.index(x) for x in labels])
    model.calibrate(gram, s, without_digits(buf, s, e), doc, lang)
    truth_of = lang[doc]
    common, count = np.unique(words, return_counts=True)
    common = common[count >= min_count]
    at = (common >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    model.entry[at[at > 0]] = common[at > 0]
    slot = model.slot(words)
    line = np.cumsum(buf == 10)[s]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    length = np.diff(np.append(first, len(line)))
    parts = [np.arange(len(s))]
    lengths = [length]
    for i, j in zip(rng.permutation(len(first)), rng.permutation(len(first))):  # spliced lines
        x, y = first[i] + np.arange(min(length[i], 60)), first[j] + np.arange(min(length[j], 60))
        cut = sorted(rng.integers(0, len(x) + 1, 2))
        spliced = np.concatenate([x[: cut[0]], y, x[cut[1] :]])
        parts.append(spliced)
        lengths.append([len(spliced)])
    index, length = np.concatenate(parts), np.concatenate(lengths)
    begin = np.cumsum(length) - length
    truth = truth_of[index]
    inner = np.ones(len(index), bool)
    inner[begin] = False
    to = np.flatnonzero(inner)
    gold_step = np.zeros((n, n))
    np.add.at(gold_step, (truth[to - 1], truth[to]), 1)
    gold_start = np.bincount(truth[begin], minlength=n)
    gold = np.zeros((len(index), n), np.float32)
    gold[np.arange(len(index)), truth] = 1
    word_len = np.diff(np.append(s, len(buf)))
    word_of_byte = np.repeat(np.arange(len(s)), word_len)
    gram_at = gram[s[0] :]
    history: dict = {}

    def update(name: str, gradient: np.ndarray) -> None:
        h = history.setdefault(name, np.full(gradient.shape, 1e-6))
        h += gradient * gradient
        weights = getattr(model, name)
        weights += (rate * gradient / np.sqrt(h)).astype(np.float32)

    for _ in range(rounds):
        score = model.scores(gram, s, affixes, slot)[index]
        step, start = np.exp(model.step), np.exp(model.start)
        ex, alpha, beta = forward_backward(score, begin, length, step, start)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        pair = alpha[to - 1][:, :, None] * step[None] * (ex[to] * beta[to])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        error = gold - p
        token = np.stack([np.bincount(index, weights=error[:, k], minlength=len(s)) for k in range(n)], 1)
        scale = 1 / len(index)

        def spread(where, values, size):
            return np.stack([np.bincount(where, weights=values[:, k], minlength=size) for k in range(n)], 1)

        g = spread(gram_at, token[word_of_byte], 1 << GRAM_BITS)
        g[0] = 0
        update("gram", g * scale - 1e-6 * model.gram)
        update("affix", sum(spread(a, token, 1 << AFFIX_BITS) for a in affixes) * scale - 1e-6 * model.affix)
        g = spread(slot, token, 1 << LEXICON_BITS)
        g[0] = 0
        update("lexicon", g * scale - 1e-6 * model.lexicon)
        update("step", (gold_step - pair.sum(0)) * scale)
        update("start", (gold_start - p[begin].sum(0)) * scale)
    return model


def train(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str = "lang",
    max_per_language: int = 80,
    min_per_language: int = 10,
    max_languages: int = 256,
    max_bytes: int = 1 << 16,
) -> Model:
    """Fit on at most ``max_per_language`` documents of each language, those with the least hash of their row.

    Rows without text or language are left out, and so are texts of more than ``max_bytes`` bytes, whole, so that the
    sample fits the driver, languages with fewer documents than ``min_per_language`` in it, and all but the
    ``max_languages`` most frequent languages. Rows that repeat are one; an id with several texts or languages gives an
    example for each. Other columns are ignored, whatever their names. With fewer than two languages left
    every word gets the only one, or none.
    """
    named = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text"), F.col(q(lang_col)).cast("string").alias("lang"))
    named = named.where((F.octet_length("text") <= max_bytes) & F.col("lang").isNotNull())
    named = named.withColumn("h", F.xxhash64("id", "lang", F.octet_length("text"), F.substring("text", 1, 64)))
    order = Window.partitionBy("lang").orderBy("h")
    some = named.select("lang", "h").withColumn("rank", F.rank().over(order)).where(F.col("rank") <= max_per_language)
    common = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    sample = some.join(F.broadcast(common), "lang").select(F.col("h").alias("sample_h"), F.col("lang").alias("sample_lang")).distinct()
    texts = (
        named.join(F.broadcast(sample), (F.col("h") == F.col("sample_h")) & (F.col("lang") == F.col("sample_lang")))  # bounded by the limits
        .select("sample_h", "lang", "text")
        .distinct()
        .collect()
    )
    texts.sort(key=lambda r: (r.sample_h, r.lang, r.text))
    many: dict[str, int] = {}
    for r in texts:
        many[r.lang] = many.get(r.lang, 0) + 1
    some = [r for r in texts if many[r.lang] >= min_per_language]
    return fit([r.text for r in some], [r.lang for r in some])


def identify(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    min_share: float = 0.3,
    languages: list[str] | None = None,
    columns: list[str] | None = None,
    with_runs: bool = True,
) -> DataFrame:
    """``docs`` with the columns main_lang, main_share, confidence, familiar, n_words, run_langs, run_words, accepted.

    ``main_lang`` labels most words (the first in order of the languages on ties), ``main_share`` of
    them; ``confidence`` is the mean probability of all labels, ``familiar`` the share of the text's n-grams, in
    words without digits, that the sample has, as if ``PRIOR`` more were there that it has. ``run_langs`` and ``run_words`` give the
    label of every word, as runs of equal labels. A document is accepted if its main language is one of
    ``languages`` (all that are known, by default), has at least ``min_share`` of its words, and the text is as familiar
    as the model asks, which text in an unknown language or none is not. Null
    texts and texts without words have no main language, share 0, no runs, and are not accepted. Columns
    of the input with the names of new ones are replaced; all others, or those in ``columns``, pass through.
    """
    names = ["main_lang", "main_share", "confidence", "familiar", "n_words", "run_langs", "run_words", "accepted"]
    if not with_runs:
        names = [x for x in names if "run_" not in x]
    cols = [c for c in (docs.columns if columns is None else columns) if c.lower() not in names]
    kinds = {"main_lang": "string", "main_share": "double", "confidence": "double", "familiar": "double", "n_words": "long", "accepted": "boolean"}
    kinds |= {"run_langs": "array<string>", "run_words": "array<int>"}
    blank = docs.select(*[F.col(q(c)) for c in cols])
    for x in names:
        blank = blank.withColumn(x, F.lit(None).cast(kinds[x]))
    allowed = np.array([languages is None or x in languages for x in model.languages] or [False])

    def tag(batches):
        hasher, n = Hasher(), max(1, len(model.languages))
        known = pa.array(model.languages or [None], pa.string())
        for batch in (b.slice(*part) for b in batches for part in row_slices(b.column(place), SLICE_BYTES)):
            if model.languages:
                label, sure, familiar, bounds = model.label(pc.utf8_lower(batch.column(place)), hasher)
            else:
                label, sure, familiar, bounds = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2)), np.zeros(len(batch) + 1, np.int64)
            words = np.diff(bounds)
            doc = np.repeat(np.arange(len(words)), words)
            counts = np.bincount(doc * n + label, minlength=len(words) * n).reshape(-1, n)
            main, most = counts.argmax(1), counts.max(1)
            share = most / np.maximum(words, 1)
            mean = np.bincount(doc, weights=sure, minlength=len(words)) / np.maximum(words, 1)
            hits, misses = (np.bincount(doc, weights=familiar[:, c], minlength=len(words)) for c in (0, 1))
            known_share = np.where(words > 0, (hits + PRIOR) / (hits + misses + PRIOR), 0.0)
            fine = (known_share >= model.min_familiar) & (words > 0) & (share >= min_share) & allowed[main]
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            offsets = pa.array(np.searchsorted(at, bounds).astype(np.int32))
            made = {
                "familiar": pa.array(known_share),
                "main_lang": known.take(pa.array(main, mask=words == 0)),
                "main_share": pa.array(share),
                "confidence": pa.array(mean),
                "n_words": pa.array(words.astype(np.int64)),
                "run_langs": pa.ListArray.from_arrays(offsets, known.take(pa.array(label[at]))),
                "run_words": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(at, len(label))).astype(np.int32))),
                "accepted": pa.array(fine),
            }
            arrays = batch.columns[: len(cols)] + [made[x] for x in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *names])

    staged, place = with_text(docs, cols, text_col)
    return staged.mapInArrow(tag, blank.schema)
