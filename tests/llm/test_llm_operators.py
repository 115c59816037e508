"""Each operator against a brute-force version, and the cases its docstring defines."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import (
    bpe,
    chat_template,
    class_lm,
    classes,
    embed_dedup,
    exact_dedup,
    langid,
    line_dedup,
    ngram_join,
    packing,
    quality,
)
from textloom.llm.arrays import Hasher, word_hashes

DOCS = "doc_id long, text string, key string, hash int, `a.b` map<string,int>"
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, f"k{n}", n, {"x": 1}) for n, (i, t) in enumerate(pairs)], DOCS)


LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(None, "null id"), (None, None), (1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (5, "one"), (6, LONG), (7, LONG + " x")]


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    word = [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "el", "io", "um", "ys")]
    lines = [" ".join(rng.choice(word) for _ in range(rng.randint(1, 70))) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.5 else " ".join(rng.choice(word) for _ in range(rng.randint(1, 70)))
                       for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[i // 2]
    return [(100 + i, t) for i, t in enumerate(texts)]


# ---- exact dedup


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs_of(spark, ODD + [(0, "one"), (9, "")])).collect()
    want = [(None, "null id"), (None, None), (1, None), (2, ""), (3, " \n "), (0, "one"), (6, LONG[:8]), (7, LONG[:8])]
    assert sorted(((r.doc_id, r.text and r.text[:8]) for r in got), key=str) == sorted(want, key=str)
    assert got[0].asDict().keys() == {"doc_id", "text", "key", "hash", "a.b"}
    assert exact_dedup.exact_dedup(docs_of(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("bits,block,part", [(64, 64, 7), (256, 64, 1 << 21), (1 << 30, 1 << 20, 20)])
def test_exact_dedup_whatever_the_filter(spark, monkeypatch, bits, block, part):
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", block)
    monkeypatch.setattr(exact_dedup, "PARTITION_ROWS", part)
    rows = corpus()
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    got = exact_dedup.exact_dedup(docs_of(spark, rows), max_filter_bits=bits).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for t, i in first.items())


# ---- line dedup


def lines_by_hand(rows, min_lines=2, min_words=50):
    seen, cut = set(), defaultdict(set)
    for i, t in sorted(rows):
        full = [(p, x.strip(" "), x) for p, x in enumerate(t.split("\n")) if x.strip(" ")]
        for j in range(len(full)):
            runs = [full[j : j + min_lines]] if j + min_lines <= len(full) else []
            runs += [full[j : j + 1]] if full[j][2].count(" ") >= min_words - 1 else []
            for run in runs:
                name = (len(run) > 1, tuple(x for _, x, _ in run))
                if name in seen:
                    cut[i].update(p for p, _, _ in run)
                seen.add(name)
    return {i: ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut[i]), len(cut[i])) for i, t in rows}


@pytest.mark.parametrize("min_lines", [2, 3])
def test_line_dedup(spark, min_lines):
    rows = corpus(1)
    got = line_dedup.line_dedup(docs_of(spark, rows), min_lines=min_lines).collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in got} == lines_by_hand(rows, min_lines)


def test_line_dedup_cases(spark):
    long_line = " ".join("word" for _ in range(50))
    rows = [(1, "a\nb\nc"), (2, "x\na\n\nb\ny"), (3, "a\nz\nb"), (4, "q\nq\nq"), (5, None), (6, ""), (7, long_line), (8, "h\n" + long_line)]
    rows += [(None, "a\nb"), (1, "a\nb\nc"), (9, "a\nb\nc")]
    df = docs_of(spark, rows).withColumn("removed_lines", F.lit("mine"))
    out = line_dedup.line_dedup(df)
    got = [(r.doc_id, r.text, r.removed_lines) for r in out.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x\n\ny", 2), (3, "a\nz\nb", 0), (4, "q", 2), (5, None, 0), (6, "", 0),
         (7, long_line, 0), (8, "h", 1), (9, "", 3), (None, "", 2)], key=str)
    assert out.columns == ["doc_id", "text", "key", "hash", "a.b", "removed_lines"]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {i} of many" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own"] + lines[5_000:] + ["end"])), (3, "\n".join(["a", "b"] * 3_000))]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("own\nend", 15_000)
    assert got[3] == lines_by_hand(rows[2:])[3]


# ---- packing




def test_sum_of_squares_is_least_at_each_step():
    rng = random.Random(3)
    sizes, capacity = [rng.randint(1, 19) for _ in range(400)], 20
    placed = packing.sum_of_squares(sizes, capacity)
    gaps = {}
    for s, at in zip(sizes, placed):
        def after(k, g):
            n = Counter({**gaps, k: g - s}.values())
            return sum(v * v for g_, v in n.items() if 0 < g_ < capacity)
        best = min([after(k, g) for k, g in gaps.items() if g >= s] + [after(-1, capacity)])
        assert after(at, gaps.get(at, capacity)) == best
        gaps[at] = gaps.get(at, capacity) - s
        assert gaps[at] >= 0


@pytest.mark.parametrize("shard_rows", [5, 1000])
def test_packing_places_every_word_once(spark, shard_rows):
    rows = corpus(2) + ODD
    out = packing.best_fit_packing(docs_of(spark, rows), capacity=64, shard_rows=shard_rows).toPandas()
    assert out.groupby("bin_id").length.sum().max() <= 64
    assert out.length.sum() == sum(len((t or "").split()) for _, t in rows)
    for _, part in out[out.doc_id != 4].groupby(["doc_id", "start"]):
        assert len(part) == 1
    per_doc = out.groupby("doc_id").length.sum()
    assert per_doc[6] == 30_000 and per_doc[4] == 2 and 2 not in per_doc
    assert packing.best_fit_packing(docs_of(spark, rows).limit(0)).count() == 0


# ---- n-gram join


def sets_by_hand(rows, n=3):
    out = {}
    for i, t in rows:
        w = ["".join(x) for x in _words((t or "").lower())]
        if w:
            out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    return out


def _words(t):
    import re

    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t)


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    word = [f"v{i}" for i in range(400)]
    boiler = " ".join(rng.choice(word) for _ in range(12))
    rows = []
    for _ in range(n):
        base = [rng.choice(word) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = [rng.choice(word) if rng.random() < 0.08 else x for x in base]
            rows.append(" ".join(copy) + (" " + boiler if rng.random() < 0.5 else ""))
    rows += [boiler] * 3 + [boiler + f" t{i}" for i in range(6)]
    return list(enumerate(rows))


def links_by_hand(sets, threshold=0.5):
    """{(i, j): similarity} of all documents with words, i < j."""
    ids = sorted(sets)
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for k, i in enumerate(ids) for j in ids[k + 1 :]}
    return {p: v for p, v in pairs.items() if v >= threshold}


def classes_by_hand(ids, pairs):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    links = Counter(x for p in pairs for x in p)
    return {i: (least[i], links[i]) for i in ids}


@pytest.mark.parametrize("hot,threshold,block", [(32, 0.5, 1 << 11), (1, 0.5, 5), (2, 0.8, 1 << 11), (3, 1.0, 3)])
def test_ngram_join(spark, monkeypatch, hot, threshold, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rows = near_corpus(5)
    rows += [(1000 + i, t) for i, t in rows[::3]] + [(2000 + i, t) for i, t in rows[::9]]
    sets = sets_by_hand(rows)
    pairs = links_by_hand(sets, threshold)
    docs = docs_of(spark, rows).repartition(3)
    got = ngram_join.ngram_jaccard_join(docs, threshold=threshold, hot=hot).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.links) for r in got} == classes_by_hand(sets, pairs)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    heads = set(least.values())
    want = {p: v for p, v in pairs.items() if heads.issuperset(p)} | {(least[s], i): 1.0 for i, s in sets.items() if least[s] != i}
    got = ngram_join.ngram_jaccard_pairs(docs, threshold=threshold, hot=hot).collect()
    assert len(got) == len(want)
    assert {(r.doc_id_a, r.doc_id_b): pytest.approx(r.jaccard) for r in got} == want


def test_ngram_join_cases(spark):
    rows = ODD + [(8, "ONE!"), (10, "é è"), (11, "É È"), (None, "é È")]
    docs = docs_of(spark, rows).withColumn("class_id", F.lit("x")).withColumn("links", F.lit("y"))
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.links) for r in got) == Counter(
        [(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (8, 4, 2), (6, 6, 1), (7, 6, 1),
         (10, 10, 2), (11, 10, 2), (None, 10, 2)])
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.ngram_jaccard_pairs(docs).collect()}
    assert set(pairs) == {(4, 5), (4, 8), (6, 7), (10, 11), (10, None)}
    assert pairs[6, 7] == pytest.approx(29_998 / 29_999)
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0 and ngram_join.ngram_jaccard_pairs(docs.limit(0)).count() == 0
    kept = ngram_join.near_duplicates_removed(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "hash", "a.b"]
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("4") == 2 and ids.count("10") == 1 and len(ids) == len(rows) - 5


def test_ngram_join_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 100)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(f"e{rng.randint(0, 10**6)}" if rng.random() < 0.05 else w for w in base)) for i in range(500)]
    sets = sets_by_hand(rows)
    want = classes_by_hand(sets, links_by_hand(sets))
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.ngram_jaccard_join(docs_of(spark, rows)).collect()}
    assert got == want and max(n for _, n in want.values()) > 300


def test_near_duplicates_one_of_each_group(spark):
    rows = near_corpus(6)
    sets = sets_by_hand(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5:
                root[find(i)] = find(j)
    kept = [r.doc_id for r in ngram_join.near_duplicates_removed(docs_of(spark, rows)).collect()]
    assert sorted(kept) == sorted({find(i): i for i in sorted(sets, reverse=True)}.values())


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_of_a_chain(spark, monkeypatch, local):
    monkeypatch.setattr(classes, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in classes.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(41)) and got[101] == 100


def test_components_that_do_not_converge_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(classes, "LOCAL_EDGES", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        classes.components(edges, max_rounds=1)


# ---- quality


def test_quality_on_held_out_text(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "flows", "under", "bridge", "and", "light"]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["WIN", "$$$", "CLICK", "!!!", "FREE", "###"]) for _ in range(60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 2] + [(None, 1), (1, None), (9999, 0)], "doc_id long, quality int")
    docs = docs_of(spark, rows + ODD)
    model = quality.train(docs, labels, dictionary_bytes=2048)
    out = quality.quality_scores(docs.withColumn("KEEP", F.lit(1)), model).collect()
    assert len(out) == len(rows) + len(ODD)
    scores = {r.doc_id: r.quality_score for r in out if r.doc_id is not None and r.text and len(r.text) > 100}
    held = [i for i in range(240) if i % 2 == 0]
    right = sum((scores[i] > 0.5) == (i < 120) for i in held if i > 10)
    assert right >= 0.98 * sum(i > 10 for i in held)
    assert out[0].asDict()["keep"] in (True, False) and "hash" in out[0].asDict()
    assert quality.quality_scores(docs.limit(0), model).count() == 0


def test_quality_sizes_and_sample(spark):
    """Scores from sizes that plain zstandard gives, whatever the tables' other columns are called."""
    import zstandard

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "star"] if i % 2 else ["XX", "YY", "ZZ"]) for _ in range(900))) for i in range(60)]
    rows += [(1, "another text for id 1"), (60, "x" * 5000), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("quality", "lid", "did", "toxic", "h")
    odd = docs.select("*", *[F.lit(7).alias(c) for c in names])
    labels = spark.createDataFrame([(i, i % 2, int(i == 5)) for i in range(62)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    models = [quality.train(d, x, dictionary_bytes=1024, block=100, max_bytes=4900) for d, x in ((docs, labels), (odd, labels.select("*", F.lit(1).alias("text"))))]
    assert (models[0].good, models[0].bad, models[0].slope) == (models[1].good, models[1].bad, models[1].slope)
    got = quality.quality_scores(odd, models[1]).collect()
    assert set(names) <= set(got[0].asDict())
    for r in got:
        sizes = []
        for raw in (models[0].good, models[0].bad):
            d = zstandard.ZstdCompressionDict(raw)
            c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            t = (r.text or "").encode()
            sizes.append(sum(len(c.compress(t[i : i + 100])) for i in range(0, len(t), 100)))
        x = (sizes[1] - sizes[0]) / (sizes[0] + sizes[1] + quality.PRIOR)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-(models[0].slope * x + models[0].offset))), abs=1e-9)
    empty = quality.train(docs.limit(0), labels)
    assert all(r.quality_score == 0.5 for r in quality.quality_scores(docs, empty).collect())


def test_quality_without_labels_keeps_all(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality_scores(docs, quality.train(docs, labels)).collect()
    assert all(r.quality_score == 0.5 and r.keep for r in out)


# ---- language ID


LEXICA = {
    "en": "the and of house water light which strong night thing".split(),
    "de": "der und das haus wasser licht welche stark nacht ding".split(),
    "fr": "le et du maison eau lumière quelle fort nuit chose".split(),
}


def sentence(rng, lang, n):
    return [rng.choice(LEXICA[lang]) + rng.choice({"en": ["", "ing", "ly"], "de": ["", "ung", "lich"], "fr": ["", "ment", "eux"]}[lang]) for _ in range(n)]


def test_language_id_labels_switched_text(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, lang, 20)), lang) for i in range(90) for lang in [list(LEXICA)[i % 3]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "x", None), (902, "", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    truth, texts = [], []
    for i in range(40):
        words, labels = [], []
        for _ in range(3):
            lang = rng.choice(list(LEXICA))
            n = rng.randint(4, 9)
            words += sentence(rng, lang, n)
            labels += [lang] * n
        truth.append(labels)
        texts.append((i, " ".join(words)))
    out = {r.doc_id: r for r in langid.identify(docs_of(spark, texts), model).collect()}
    right = total = 0
    for i, labels in enumerate(truth):
        got = [x for lang, n in zip(out[i].run_langs, out[i].run_words) for x in [lang] * n]
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.95
    odd = langid.identify(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all((r.n_words == 0) == (r.main_lang is None) for r in odd)
    assert all(not r.accepted and r.run_words == [] for r in odd if r.n_words == 0)
    assert [r.n_words for r in odd if r.doc_id == 6] == [30_000]
    assert langid.identify(docs_of(spark, ODD).limit(0), model).count() == 0
    nobody = langid.fit([], [])
    assert nobody.min_familiar == 0
    assert all(not r.accepted for r in langid.identify(docs_of(spark, ODD), nobody).collect())


def test_language_labels_are_those_of_all_paths(spark):
    """Each word's label from the sum over all label sequences of its line, with features looked up one by one."""
    import itertools

    from textloom.llm.arrays import spans, text_bytes

    rng = random.Random(5)
    rows = [(i, " ".join(sentence(rng, list(LEXICA)[i % 3], 15)), list(LEXICA)[i % 3]) for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(sentence(rng, "en", 3) + sentence(rng, "fr", 2)) + "\n" + " ".join(sentence(rng, "de", 4)) for _ in range(5)]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        want = []
        for line in text.split("\n"):
            buf, _ = text_bytes(pa.array([line]))
            s, e = spans(buf)
            gram, affixes, words = langid.features(buf, s, e, Hasher())
            slot = model.slot(words)
            score = [[sum(model.gram[g][k] for g in gram[a:b]) + sum(x[j] for x in [model.affix[f[w]] for f in affixes] for j in [k])
                      + model.lexicon[slot[w]][k] for k in range(3)] for w, (a, b) in enumerate(zip(s, e))]
            total = np.zeros((len(s), 3))
            for path in itertools.product(range(3), repeat=len(s)):
                value = model.start[path[0]] + sum(score[t][path[t]] for t in range(len(s))) + sum(model.step[a][b] for a, b in zip(path, path[1:]))
                total[np.arange(len(s)), path] += math.exp(value)
            want += [model.languages[k] for k in total.argmax(1)]
        r = got[i]
        assert [x for lang, n in zip(r.run_langs, r.run_words) for x in [lang] * n] == want
        assert r.main_lang == max(model.languages, key=lambda x: (want.count(x), [-model.languages.index(x)])) and r.accepted


def test_language_sample_and_rejection(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(sentence(rng, list(LEXICA)[i % 3], 60)), list(LEXICA)[i % 3]) for i in range(90)]
    plain = spark.createDataFrame(rows + [(0, "das ist alles", "de"), rows[4]], "doc_id long, text string, lang string")
    docs = plain.select("*", *[F.lit(9).alias(c) for c in ("lang_of", "sample_h", "sample_lang", "h", "rank", "id")])
    models = [langid.train(docs.repartition(n)) for n in (1, 5)] + [langid.train(plain)]
    assert all((m.gram == models[0].gram).all() and m.min_familiar == models[0].min_familiar for m in models)
    noise = [(i, " ".join("".join(rng.choice("qxzkvjwbpyg") for _ in range(6)) for _ in range(50))) for i in range(30)]
    other = [(i, "ελληνικά είναι μια γλώσσα που δεν υπάρχει στο δείγμα " * 3) for i in range(30, 40)]
    clean = [(100 + i, " ".join(sentence(rng, list(LEXICA)[i % 3], rng.choice([1, 3, 40])))) for i in range(60)]
    got = {r.doc_id: r.accepted for r in langid.identify(docs_of(spark, noise + other + clean), models[0]).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i, _ in clean)
    assert langid.train(plain.limit(0)).languages == []


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    score, step, start = rng.normal(size=(9, 3)), np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3))
    _, alpha, beta = langid.forward_backward(score, np.array([0, 4]), np.array([4, 5]), step, start)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    import itertools

    for begin, length in ((0, 4), (4, 5)):
        want = np.zeros((length, 3))
        for path in itertools.product(range(3), repeat=length):
            w = start[path[0]] * np.exp(score[begin, path[0]])
            for t in range(1, length):
                w *= step[path[t - 1], path[t]] * np.exp(score[begin + t, path[t]])
            want[np.arange(length), path] += w
        assert np.allclose(p[begin : begin + length], want / want.sum(1, keepdims=True))


# ---- class-based language model


def test_class_lm_against_brute_force(spark):
    rows = corpus(4, 60) + ODD[:6]
    docs = docs_of(spark, rows)
    bits, classes, alpha, rounds = 12, 6, 0.1, 2
    model = class_lm.train(docs, classes=classes, vocab_bits=bits, rounds=rounds, alpha=alpha)
    texts = [t.lower() for _, t in rows if t is not None]
    number = {}
    for t in texts:
        for w in _words(t):
            number[w] = int(word_hashes(pa.array([w]), Hasher())[0][0] >> np.uint64(64 - bits))
    tokens = [[number[w] for w in _words(t)] for t in texts]
    count = Counter(x for t in tokens for x in t)
    order = sorted(range(1 << bits), key=lambda b: (-count[b], b))
    cls = [classes - 1] * (1 << bits)
    for k, b in enumerate(order[: classes - 1]):
        cls[b] = k

    def bigrams():
        n = np.zeros((classes + 1, classes + 1))
        for t in tokens:
            path = [classes, *[cls[x] for x in t], classes] if t else []
            for a, b in zip(path, path[1:]):
                n[a, b] += 1
        return n

    for _ in range(rounds):
        n = bigrams()
        new = list(cls)
        for w in count:
            left, right = np.zeros(classes + 1), np.zeros(classes + 1)
            for t in tokens:
                path = [classes, *[cls[x] for x in t], classes]
                for k, x in enumerate(t):
                    if x == w:
                        left[path[k]] += 1
                        right[path[k + 2]] += 1

            def value(c):
                mine = c == cls[w]
                total = 0.0
                out, into = n[c].sum() - mine * right.sum(), n[:, c].sum() - mine * right.sum()
                for d in range(classes + 1):
                    total += right[d] * math.log((max(n[c, d] - mine * right[d], 0) + alpha) / (out + alpha * (classes + 1)))
                    total += left[d] * math.log((max(n[d, c] - mine * left[d], 0) + alpha) / (n[d].sum() + alpha * (classes + 1)))
                return total - right.sum() * math.log(into + 1)

            best = max(range(classes), key=value)
            if value(best) > value(cls[w]) + 1e-9:
                new[w] = best
        cls = new
    assert list(model.cls) == cls
    n = bigrams()
    assert (model.bigram == n).all()
    step = np.log((n + alpha) / (n + alpha).sum(1, keepdims=True))
    size = Counter()
    kinds = Counter(cls)
    for w, k in count.items():
        size[cls[w]] += k
    got = {r.doc_id: r for r in class_lm.score(docs, model).collect() if r.doc_id is not None}
    for (i, t) in rows[:60]:
        path = [number[w] for w in _words(t.lower())]
        total, before = 0.0, classes
        for x in path:
            total += step[before, cls[x]] + math.log((count[x] + 0.5) / (size[cls[x]] + 0.5 * kinds[cls[x]]))
            before = cls[x]
        total += step[before, classes]
        assert got[i].n_words == len(path) and got[i].log_likelihood == pytest.approx(total, rel=1e-4)
        assert got[i].perplexity == pytest.approx(math.exp(-total / len(path)), rel=1e-3)
    assert got[1].perplexity is None and got[4].n_words == 1
    empty = docs_of(spark, ODD).limit(0)
    assert class_lm.score(empty, class_lm.train(empty, vocab_bits=8)).count() == 0


def test_class_lm_keeps_every_word_apart(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "LOCAL_BITS", 8)
    # two words whose hashes agree in 22 bits: one frequent, one rare
    names = pa.array([f"w{i}" for i in range(20_000)])
    top = (word_hashes(names, Hasher())[0] >> np.uint64(42)).tolist()
    seen = {}
    often, rare = next((seen[x], i) for i, x in enumerate(top) if x in seen or seen.setdefault(x, i) is None)
    rows = [(i, f"w{often} x y") for i in range(50)] + [(50, f"w{rare} x y")] + [(51, " ".join(f"u{i}" for i in range(2000)))]
    docs = docs_of(spark, rows)
    model = class_lm.train(docs, classes=4)
    want = Counter(w for _, t in rows for w in t.split())
    words = sorted(want)
    number = model.vocabulary.numbers(word_hashes(pa.array(words), Hasher())[0])
    assert len(model.cls) == len(words) + 1 and len(set(number)) == len(words)
    assert [model.count[k] for k in number] == [want[w] for w in words]
    assert model.vocabulary.numbers(word_hashes(pa.array(["never"]), Hasher())[0])[0] == len(words)
    size = np.bincount(model.cls, weights=model.count, minlength=4)[model.cls]
    own = np.log((model.count + 0.5) / (size + 0.5 * np.bincount(model.cls, minlength=4)[model.cls]))
    assert np.allclose(model.emissions(), own, atol=1e-5) and model.bigram.sum() == sum(want.values()) + len(rows)
    got = {r.doc_id: r.log_likelihood for r in class_lm.score(docs, model).collect()}
    assert got[50] < got[0] - 1


def test_class_lm_learns_and_handles_wordless_texts(spark):
    docs = docs_of(spark, corpus(9, 80) + [(500, None), (501, ""), (502, "...")])
    plain = class_lm.train(docs, rounds=0, classes=8, vocab_bits=14)
    model = class_lm.train(docs, rounds=3, classes=8, vocab_bits=14)
    total = [class_lm.score(docs, m).agg(F.sum("log_likelihood")).first()[0] for m in (plain, model)]
    assert total[1] > total[0]
    out = {r.doc_id: r for r in class_lm.score(docs, model).where("doc_id >= 500").collect()}
    assert all(out[i].n_words == 0 and out[i].perplexity is None and out[i].log_likelihood == 0 for i in (500, 501, 502))


# ---- embeddings


@pytest.mark.parametrize("block,step", [(1 << 10, 64), (4, 2)])
def test_embedding_near_duplicates(spark, monkeypatch, block, step):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "STEP_ROWS", step)
    monkeypatch.setattr(embed_dedup, "GROUP_ROWS", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 24))
    vectors = np.concatenate([base, base[:60] + 0.03 * rng.normal(size=(60, 24)), base[:20], base[:1] + 0.02 * rng.normal(size=(40, 24))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] * 24)]
    extra = [(None, rows[0][1]), rows[3], (1005, rows[3][1][:10])]
    df = spark.createDataFrame(rows + odd + extra, "vec_id long, embedding array<float>")
    df = df.select(*[F.col(c) for c in df.columns], F.lit(1).alias("sig"), F.lit("x").alias("v"), F.lit(2).alias("class_id"), F.lit(0).alias("a.b"))
    got = embed_dedup.embedding_near_duplicates(df, recall=0.99999).collect()
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.concatenate([unit, unit[:1]])
    g = unit @ unit.T
    pairs = [(i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if g[i, j] >= 0.95]
    want = classes_by_hand(range(len(g)), pairs)
    null = want.pop(len(vectors))
    want |= {i: (i, 0) for i, _ in odd} | {1005: (1005, 0), None: null}
    assert len(got) == len(want) and {r.vec_id: (r.class_id, r.links) for r in got} == want
    assert embed_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(400, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = embed_dedup.embedding_near_duplicates(df).where("links > 0").count()
    assert got >= 0.93 * 800


def test_equal_vectors_are_one(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    df = df.unionByName(spark.createDataFrame([(5000, [2.0, 4.0]), (5001, [-1.0, 0.0])], df.schema))
    got = {r.vec_id: (r.class_id, r.links) for r in embed_dedup.embedding_near_duplicates(df).collect()}
    assert got == {i: (0, 3000) for i in [*range(3000), 5000]} | {5001: (5001, 0)}


# ---- BPE


@pytest.mark.parametrize("known", [1 << 22, 300])
def test_bpe_matches_the_public_library(spark, monkeypatch, known):
    import tiktoken

    monkeypatch.setattr(bpe, "KNOWN_WORDS", known)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 2000)

    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "1", "42", "é", "ß", "漢字", "😀", "!", "...", " ", "Ⅷ", "<|endoftext|>", "aaaa"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "'s", " 's", "!'s x", "it's's", "'", "a'", "'l", "'r", "don't  stop \n\n now", LONG, "a" * 1000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (None, "x"), (5, texts[5])]
    df = docs_of(spark, rows)
    enc = bpe.bpe_encode(df, VOCAB, verify=True)
    out = {r.doc_id: r for r in enc.collect()}
    for i, t in enumerate(texts):
        assert list(out[i].tokens) == reference.encode_ordinary(t), t
        assert out[i].round_trip and out[i].n_tokens == len(out[i].tokens)
    assert out[9000].tokens is None and out[9000].n_tokens is None and out[9000].round_trip is None
    back = {r.doc_id: r.text for r in bpe.bpe_decode(enc, VOCAB).collect()}
    assert all(back[i] == t for i, t in rows)
    assert bpe.bpe_encode(df.limit(0), VOCAB).count() == 0


# ---- chat templates


def test_chat_rendering(spark):
    turns = [(1, 1, "assistant", "fine"), (1, 0, "user", "how?"), (1, None, "system", "late"), (2, 0, None, None), (None, 3, "user", "x"), (1, 0, "user", "how?")]
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, messages int")
    out = {r.conv_id: r for r in chat_template.format_chats(df).collect()}
    user = "<|im_start|>user\nhow?<|im_end|>\n"
    assert out[1].text == user * 2 + "<|im_start|>assistant\nfine<|im_end|>\n<|im_start|>system\nlate<|im_end|>\n"
    assert [out[1].text[s.start : s.end] for s in out[1].spans] == ["fine<|im_end|>"] and out[1].n_turns == 4
    assert out[2].text == "<|im_start|>\n<|im_end|>\n" and None in out
    assert chat_template.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "template,want",
    [
        ("{{ 1 + 2 * 3 }}{{ 'a' ~ 1 }}", "7a1"),
        ("{% if 1 > 2 %}x{% elif n == 3 %}y{% else %}z{% endif %}", "y"),
        ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", "1a,2b"),
        ("{% for i in [] %}{{ i }}{% else %}none{% endfor %}", "none"),
        ("  {%- set k = xs[0] | upper -%}  {{ k }}{# note #}", "A"),
        ("{{ missing.x.y }}{{ missing | default('d') }}{{ m.a if m.a is defined else 'no' }}", "d5"),
        ("{{ xs | join('-') }}{{ xs[1:] | length }}{{ 'a' in xs and 'q' not in xs }}", "a-b1true"),
        ("{{ m | tojson }}{{ none }}{{ (n - 1) // 2 }}{{ -n }}", '{"a": 5}1-3'),
        ("{{ 'it\\'s\\n' }}", "it's\n"),
        ("{{ xs.append }}{{ m.__class__ }}{{ ''.__class__ }}", ""),
    ],
)
def test_template_language(template, want):
    values = {"n": 3, "xs": ["a", "b"], "m": {"a": 5}}
    assert chat_template.compile_template(template)(**values)[0] == want


@pytest.mark.parametrize(
    "bad", ["{{ f() }}", "{{ import }} {{ x | eval }}", "{% for x %}", "{% if x %}", "{{ 1 + }}", "{% while x %}", "{{ x }", "{{ x %}", "{% generation %}", "{{ x is odd }}", "{{ $ }}"]
)
def test_templates_refused(bad):
    if bad == "{{ x }":
        assert chat_template.compile_template(bad)()[0] == bad  # no tag at all: plain text
    else:
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)


def test_constants_are_folded():
    tree = chat_template.fold_all(chat_template.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 2 + 3 }}{% endif %}{% if false %}{{ x }}{% endif %}"))
    assert tree == [("text", "aBc5")]
