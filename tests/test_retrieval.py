"""Index, retrieval, reranking, gate and expansion against restatements in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import constants as K
from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import chunk as C
from textloom.operators import generate as G
from textloom.operators import index as I
from textloom.operators import retrieve as R
from textloom.operators import vector as V
from textloom.plans.config import Config
from textloom.plans.engine import Engine
from textloom.sources.store import IndexStore

STOP = K.COMMON_WORDS | K.NOISE_TERMS
VOCAB = "neural network gradient descent kernel matrix tensor graph vertex protein enzyme market inflation yield learning learned learns the of and".split()


def chunk_rows(n=40, seed=1):
    rng = random.Random(seed)
    return [(i // 5, i % 5, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(3, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = chunk_rows()
    df = spark.createDataFrame(rows, "doc_id long, idx int, text string").withColumn("words", X.chunk_words(F.col("text")))
    return df.cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "neural network learning"), (2, "the market inflation yield"), (3, "unknownword"), (4, "of the and"), (5, ""), (6, None), (7, "Protein enzyme, tensor graph kernel!")]
    return spark.createDataFrame(rows, "query_id int, query string").cache()


def stem(w):
    if len(w) > 3:
        for s in X.STEM_SUFFIXES:
            if w.endswith(s) and len(w) - len(s) >= 3:
                return w[: -len(s)]
    return w


def tokens(t):
    return [w for w in re.sub(r"[^\w\s]|[-_]", " ", (t or "").lower()).split() if len(w) > 1 and w not in STOP]


def grams(w, stop, low=2):
    return [(" ".join(w[i : i + n]), n) for n in range(low, 5) for i in range(len(w) - n + 1) if not stop or (w[i] not in STOP and w[i + n - 1] not in STOP)]


def asked(q):
    t = tokens(q)
    whole = " ".join(re.sub(r"[^\w\s]", " ", (q or "").lower()).split())
    return list(dict.fromkeys([g for g, _ in grams(t, False)] + t)) or ([whole] if whole else [])


def by_hand(query, rows):
    t = tokens(query)
    q = set(asked(query)) | {stem(w) for w in t}
    out = {}
    content = lambda ws: {stem(w) for w in ws if w not in STOP and len(w) > 2}
    for d, i, text in rows:
        w = text.split()
        own = dict(grams(w, True)) | {x: 1 for x in w if x not in STOP and len(x) > 4}
        hits, size = set(), 0
        for g in q:
            parts = tokens(g)
            pieces = {x for x, _ in grams(parts, False)} | set(parts) or {g}
            met = [own[p] for p in pieces if p in own]
            if met:
                hits.add(g)
                size = max(size, *met)
        if not hits:
            continue
        multi = sum(" " in g for g in hits)
        overlap = len(content(t) & content(w)) / len(content(t)) if content(t) else 0.0
        r, m = len(hits) / len(q), multi / len(q)
        s = 0.35 * r + 0.3 * overlap + 0.2 * m + 0.15 if multi and len(hits) > multi else 0.4 * r + 0.35 * overlap + 0.25 * m if multi else 0.5 * r + 0.5 * overlap
        if len(t) > 1 and len(hits) == 1 and not multi:
            s *= 0.4
        out[d, i] = min(max(s, 0) + 0.02 * size, 1.0), len(hits)
    return out


def test_hash_retrieval(chunks, queries):
    posted = I.postings(chunks)
    got = {}
    for r in R.hash_retrieve(queries, chunks, posted, 10).collect():
        got.setdefault(r.query_id, []).append(r)
    for q in queries.collect():
        want = sorted(by_hand(q.query, chunk_rows()).items(), key=lambda x: (-round(x[1][0], 9), -x[1][1], x[0][1], x[0][0]))[:10]
        mine = sorted(got.get(q.query_id, []), key=lambda r: r.rank)
        assert [round(r.score, 6) for r in mine] == [round(s, 6) for _, (s, _) in want], q.query
        assert {(r.doc_id, r.idx): r.hash_hits for r in mine} == {k: h for k, (_, h) in want} or len({s for _, (s, _) in want}) < len(want)
    assert not got.get(3) and not got.get(5) and not got.get(6)


def test_postings_of_asked_grams_only(spark, chunks, queries):
    terms = R.query_terms(queries)
    only = R.pieces(terms).select("piece")
    wanted = {r.piece for r in only.collect()}
    whole = {(r.doc_id, r.idx, r.gram, r["size"]) for r in I.postings(chunks).collect() if r.gram in wanted}
    assert {(r.doc_id, r.idx, r.gram, r["size"]) for r in I.postings(chunks, only=only).collect()} == whole and whole
    a, b = (sorted(map(str, R.hash_retrieve(queries, chunks, p, 10).collect())) for p in (I.postings(chunks), None))
    assert a == b


def test_engine_leaves_out_documents_before_it_ranks(spark):
    """25 documents that repeat one of the query's seven words, and one that begins with three of them."""
    docs = [(i, "Rivers everywhere. " + "quartz " * 40 + "and sediment rivers quartz sediment flows.") for i in range(25)]
    docs += [(99, "Quartz crystal lattices vibrate. " + "They are stable over long times in clocks and sensors. " * 3)]
    engine = Engine(spark, Config(context_gate_enabled=False))
    engine.ingest(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "crystal lattices vibrate sediment basins erosion delta")], "query_id int, query string")
    assert 99 in {r.doc_id for r in engine.retrieve(asked, 5, "hash").collect()}


def test_engine_of_files_removal_and_reopening(spark, tmp_path):
    for i, t in enumerate(["Copper conducts electricity well in wires.", "Granite is a coarse igneous rock of quartz."]):
        (tmp_path / f"f{i}.txt").write_text(t * 5)
    engine = Engine(spark, Config(context_gate_enabled=False))
    engine.ingest_path(str(tmp_path))
    asked = spark.createDataFrame([(1, "granite quartz rock")], "query_id int, query string")
    granite = next(r.doc_id for r in engine.index.docs.collect() if "Granite" in r.text)
    store = IndexStore(spark, str(tmp_path / "index"))
    engine.index.save(store)
    again = Engine.open(spark, store, Config(context_gate_enabled=False))
    assert {r.doc_id for r in again.retrieve(asked, 3, "hash").collect()} == {granite}
    again.remove(spark.createDataFrame([(granite,)], "doc_id long"))
    assert granite not in {r.doc_id for r in again.index.postings.collect()} and again.index.docs.count() == 1


def test_fallback_by_stems(spark, chunks):
    q = spark.createDataFrame([(1, "descents vertexes")], "query_id int, query string")
    found = R.hash_retrieve(q, chunks, I.postings(chunks).limit(0), 50).collect()
    want = {(d, i) for d, i, t in chunk_rows() if {"descent", "vertex", "descents", "vertexes"} & set(t.split())}
    assert {(r.doc_id, r.idx) for r in found} <= want and all(r.multi_hits == 0 for r in found)


def test_rerank_and_diversity(chunks, queries):
    found = R.hash_retrieve(queries, chunks, I.postings(chunks), 10)
    rows = R.rerank_features(found, queries, chunks).collect()
    texts = {(d, i): t for d, i, t in chunk_rows()}
    for r in rows:
        query = next(q.query for q in queries.collect() if q.query_id == r.query_id)
        w, t = texts[r.doc_id, r.idx].split(), tokens(query)
        a = {x for x in t if x not in K.RERANK_STOP_WORDS and len(x) > 2}
        own = {g for g, _ in grams(w, True)} | {x for x in w if x not in K.NOISE_TERMS}
        match = len(set(asked(query)) & own)
        assert r.matching == match and r.density == pytest.approx(match / len(own))
        assert r.position == pytest.approx(1 / (1 + r.idx / 5))
        n = sum(x in " ".join(w) for x in a)
        assert r.specificity == pytest.approx(min(0.6 * n / len(a) + 40 * n / len(w), 1.0) if a else 0.0)
        at = sorted(w.index(x) for x in a if x in w)
        near = 0.5 if len(a) < 2 else 0.0 if len(at) < 2 else 1 / (1 + (at[-1] - at[0]) / (len(at) - 1) / 10) * len(at) / len(a)
        assert r.proximity == pytest.approx(near)
        assert 0 <= r.rerank_score <= 1
    kept = R.rerank(found, queries, chunks).collect()
    heads = {}
    for r in sorted(kept, key=lambda r: (r.query_id, r.rank)):
        mine = set(texts[r.doc_id, r.idx].split()[:30])
        for other in heads.setdefault(r.query_id, []):
            assert len(mine & other) / len(mine | other) < 0.85
        heads[r.query_id].append(mine)
    assert len(kept) <= len(rows)


def gate_by_hand(scores, spec, least=2, most=7, level=0.3):
    spread = max(scores) - min(scores) if len(scores) > 1 else 0.0
    avg = sum(scores) / len(scores)
    n, cut = (max(least, 3), max(level, 0.7 * avg)) if spec > 0.7 else (most, level) if spec > 0.4 else (min(most + 3, 10), min(level, 0.15))
    rows = list(enumerate(scores))
    good = [x for x in rows if x[1] >= cut]
    if len(good) < least:
        good += sorted((x for x in rows if x[1] < cut), key=lambda x: -x[1])[: least - len(good)]
    if spread < 0.05 and len(good) > least + 1:
        top = good[0][1]
        good = [x for x in good if x[1] >= top - 0.15]
        if len(good) < least:
            good = rows[:least]
    return [i for i, _ in good[:n]]


def test_gate(spark):
    rng = random.Random(3)
    texts = {0: "define the gradient descent method", 1: "is it so or not and how the", 2: "of the", 3: "tell me about the network and its matrix"}
    cases = {q: [round(rng.uniform(0, 1) if q % 3 else rng.uniform(0.5, 0.53), 3) for _ in range(rng.randint(1, 14))] for q in range(40)}
    rows = [(q, i + 1, s) for q, v in cases.items() for i, s in enumerate(v)]
    results = spark.createDataFrame(rows, "query_id int, rank int, score double")
    asked_ = spark.createDataFrame([(q, texts[q % 4]) for q in cases], "query_id int, query string")
    spec = {r.query_id: r.s for r in asked_.select("query_id", R.query_specificity(F.col("query")).alias("s")).collect()}
    got = {}
    for r in R.gate_decide(results.withColumn("at", F.col("rank") - 1), asked_).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.at))
    for q, scores in cases.items():
        assert [at for _, at in sorted(got[q])] == gate_by_hand(scores, spec[q]), q
    simple = R.gate_apply(results).groupBy("query_id").count().collect()
    assert all(min(2, len(cases[r.query_id])) <= r["count"] <= 7 for r in simple)


def test_dual_merge(spark):
    h = spark.createDataFrame([(1, 1, 0, 0.5, 2), (1, 1, 1, 0.9, 1)], "query_id int, doc_id long, idx int, score double, hash_hits long")
    v = spark.createDataFrame([(1, 1, 0, 0.8), (1, 2, 0, 0.7)], "query_id int, doc_id long, idx int, score double")
    got = {(r.doc_id, r.idx): r.score for r in R.dual_merge(h, v).collect()}
    assert got == {(1, 0): pytest.approx((0.3 + 0.32) * 1.2), (1, 1): pytest.approx(0.54), (2, 0): pytest.approx(0.28)}


def test_expansion_fills_gaps(spark, chunks):
    posted = I.postings(chunks)
    q = spark.createDataFrame([(1, "protein"), (2, "zzzz qqqq")], "query_id int, query string")
    none = spark.createDataFrame([], "query_id int, doc_id long, idx int, score double")
    out = R.expand(none, q, posted, target=3).collect()
    assert [r.query_id for r in out] == [1, 1, 1] and all(r.score == pytest.approx(0.77) and r.source == "unigram" for r in out)
    concepts = spark.createDataFrame([(0, "zzzz", [1], "about protein"), (0, "other", [3, 4], "")], "doc_id long, label string, chunk_ids array<int>, definition string")
    links = spark.createDataFrame([(0, "zzzz", "other", 1.0)], "doc_id long, term string, other string, weight double")
    rows = R.expand(none, q, posted, concepts, links, target=40).where("query_id = 2").collect()
    assert "definition" in {r.source for r in rows} and all(r.score < 0.9 for r in rows)
    rows = R.expand(none, q, posted, concepts.withColumn("definition", F.lit("")), links, target=40).where("query_id = 2").collect()
    assert {(r.source, r.doc_id, r.idx) for r in rows} == {("graph", 0, 3), ("graph", 0, 4)}


def test_postings_and_statistics(chunks):
    got = {(r.doc_id, r.idx, r.gram, r["size"]) for r in I.postings(chunks).collect()}
    want = {(d, i, g, n) for d, i, t in chunk_rows() for g, n in grams(t.split(), True) + [(x, 1) for x in t.split() if x not in STOP and len(x) > 4]}
    assert got == want
    for r in I.table_stats(chunks).collect():
        mine = [g for d, _, t in chunk_rows() if d == r.doc_id for g, _ in grams(t.split(), True) + [(x, 1) for x in dict.fromkeys(t.split()) if x not in STOP and len(x) > 4]]
        assert r.unique_ngrams == len(set(mine)) and r.total_insertions == 3 * len(mine) and r.table_size >= max(4096, int(len(mine) / 0.35))


def test_hashes_by_hand(spark):
    words = ["", "a", "neural network", "éü漢"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", M.hash_all(F.col("w"), 4096).alias("h"))
    for r in df.collect():
        f, d, m = 2166136261, 5381, 2538058380
        for b in r.w.encode():
            f, d, m = ((f ^ b) * 16777619) & M.MASK, (d * 33 + b) & M.MASK, ((m ^ b) * 1540483477) & M.MASK
            m ^= m >> 15
        m = ((m ^ len(r.w)) * 1540483477) & M.MASK
        assert r.h == [f % 4096, (m ^ (m >> 13)) % 4096, d % 4096]


def test_concepts_and_graph(spark):
    text = "Gradient descent is defined as an update. " + "gradient descent moves weights. " * 12 + "\n# Kernel Tensors\nkernel tensors map data. " + "kernel tensors are fast. " * 12
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    chunks = C.fixed_chunks(docs, 20)
    found = {r.label: r for r in I.concepts(docs, chunks).collect()}
    assert "gradient descent" in found and "kernel tensors" in found and found["gradient descent"].in_definition
    assert all(r.doc_id == 1 and r.score > 0 and len(r.chunk_ids) >= 1 for r in found.values())
    ranks = sorted(found.values(), key=lambda r: r["rank"])
    assert [r.score for r in ranks] == sorted((r.score for r in ranks), reverse=True)
    assert I.concepts(docs, chunks, max_concepts=2).count() == 2
    rows = spark.createDataFrame([(1, "graph", [0, 1, 2]), (1, "graph theory", [1, 2]), (1, "enzyme", [2])], "doc_id long, label string, chunk_ids array<int>")
    edges = I.graph(rows)
    assert {(r.source, r.target, r.weight) for r in edges.where("edge_type = 'hierarchical'").collect()} == {("graph", "graph theory", 0.8)}
    assert {(r.source, r.target): r.weight for r in I.cooccurrence(rows).collect()} == {("graph", "graph theory"): 0.4, ("enzyme", "graph"): 0.2, ("enzyme", "graph theory"): 0.2}
    got = {r.term: (r.dependents, r.prerequisites, r.impact) for r in I.impact(edges).collect()}
    assert got["graph"] == (1, 0, 3.0) and got["graph theory"][:2] == (0, 1)
    chain = spark.createDataFrame([(1, "a", "b", 1.0, "co_occurrence"), (1, "b", "c", 1.0, "co_occurrence"), (1, "c", "d", 1.0, "co_occurrence")], "doc_id long, source string, target string, weight double, edge_type string")
    start = spark.createDataFrame([(1, "a")], "doc_id long, term string")
    assert {(r.other, r.depth) for r in I.related(chain, start, 2).collect()} == {("b", 1), ("c", 2)}
    merged = I.merge_concepts(
        spark.createDataFrame([(1, "x", 2, 1.0, [1])], "doc_id long, label string, frequency long, score double, chunk_ids array<int>"),
        spark.createDataFrame([(1, "x", 3, 4.0, [2])], "doc_id long, label string, frequency long, score double, chunk_ids array<int>"),
    ).collect()
    assert [tuple(merged[0])] == [(1, "x", 5, 4.0, [1, 2])]


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = vectors.where("vec_id < 10 or vec_id >= 60").selectExpr("vec_id query_id", "embedding vector")
    got = {(r.query_id, r["rank"]): r for r in V.vector_search(q, vectors, 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i in range(10):
        want = sorted(((-cos(rows[i][1], v), j) for j, v in rows[:60]))[:3]
        assert [got[i, k + 1].vec_id for k in range(3)] == [j for _, j in want]
    assert len(got) == 30
    near = {(r.query_id, r.vec_id) for r in V.lsh_search(q, vectors, 3).collect()}
    exact = {(r.query_id, r.vec_id) for r in got.values()}
    assert len(near) == 30 and len(near & exact) >= 0.9 * 30
    texts = spark.createDataFrame([("neural network",), ("",), (None,), ("neural neural market",)], "text string")
    out = V.hashed_tfidf(texts, texts, 32).collect()
    assert [round(math.sqrt(sum(x * x for x in r.vector)), 6) for r in out] == [1, 0, 0, 1]
    assert V.embed_with(texts, lambda t: [[float(len(x))] for x in t], batch=2).select("vector").collect()[1][0] == [0.0]
    model = V.remote_model("http://x", send=lambda u, h, b: {"data": [{"index": 1 - i, "embedding": [len(t)]} for i, t in enumerate(b["input"])]})
    assert model(["a", "bb"]) == [[2], [1]]


@pytest.mark.parametrize("pairs", [0, 1 << 33])
def test_lsh_recall_on_the_embeddings(spark, monkeypatch, pairs):
    monkeypatch.setattr(V, "EXACT_PAIRS", pairs)
    monkeypatch.setattr(V, "BLOCK_ROWS", 200)
    from textloom.queries import vector_lsh

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
    want = {(ids[i], ids[j]) for i, near in enumerate(best) for j in near if i != j}
    got = {(r.query_id, r.vec_id) for r in vector_lsh(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert V.agreement_share(V.guaranteed_cosine(0.95, 8, 24), 8, 24) == pytest.approx(0.95)


def test_prompts_and_evaluation(spark, chunks):
    results = spark.createDataFrame([(1, 0, 0, 0.5, 1), (1, 0, 1, 0.25, 2)], "query_id int, doc_id long, idx int, score double, rank int")
    asked_ = spark.createDataFrame([(1, "what?"), (2, "why?")], "query_id int, query string")
    prompts = {r.query_id: r.prompt for r in G.rag_prompt(asked_, G.sources(results, chunks.withColumn("section", F.lit("S")).withColumn("page", F.lit(3)))).collect()}
    assert "[1] (relevance: 0.50) section: S page: 3\n" in prompts[1] and prompts[1].index("[1]") < prompts[1].index("[2]") and "[none found]" in prompts[2]
    assert spark.range(1).select(G.shorten(F.repeat(F.lit("x"), 130_000)).alias("s")).first().s.endswith("[cut]")
    rows = [("Cats chase mice. Purple rockets explode above distant frozen moons tonight.", "Cats chase mice in the barn. Dogs sleep."), ("", "x"), (None, None), ("It is not covered in the text.", "other words")]
    out = G.evaluate(spark.createDataFrame(rows, "response string, source string")).collect()
    assert out[0].grounding_score == 0.5 and out[0].is_grounded and len(out[0].hallucination_flags) == 1 and out[0].source_coverage == 0.5
    assert [r.grounding_score for r in out[1:]] == [0, 0, 0] and out[3].has_uncertainty_language and not out[0].has_uncertainty_language
    assert G.confidence(results).first().confidence == pytest.approx(0.15)
    assert set(G.backends()) >= {"openai", "anthropic", "deepseek", "ollama"}
    with pytest.raises(ValueError):
        G.create_backend("nothing")
    done = G.generate(spark.createDataFrame([("a",), ("b",)], "prompt string"), lambda p: p.upper() if p == "a" else {}["x"]).collect()
    assert [r.answer for r in done] == ["A", None]


def test_engine_end_to_end(spark):
    text = "Neural networks learn weights from data. " * 30
    other = "Market inflation moves bond yields over time. " * 30
    docs = spark.createDataFrame([(1, text), (2, other), (3, None)], "doc_id long, text string")
    engine = Engine(spark, Config(context_gate_enabled=True))
    with pytest.raises(RuntimeError):
        engine.retrieve(spark.createDataFrame([(1, "x")], "query_id int, query string"))
    engine.ingest(docs)
    q = spark.createDataFrame([(1, "neural networks weights"), (2, "bond yields inflation")], "query_id int, query string")
    for method in ("hash", "dual"):
        out = engine.retrieve(q, 3, method).collect()
        assert {(r.query_id, r.doc_id) for r in out} == {(1, 1), (2, 2)} and all(r["rank"] <= 3 for r in out)
    assert "neural" in engine.query("neural networks weights").lower() and engine.query("neural networks weights") and engine.metrics.counters["queries"] == 1
    with pytest.raises(ValueError):
        engine.retrieve(q, method="other")
    with pytest.raises(ValueError):
        Engine(spark, Config(final_top_k=0))
    assert Config.from_dict({"final_top_k": 3, "unknown": 1}).final_top_k == 3 and not Config().validate()
