"""Queries that must not move each n-gram, term or pair of the corpus: their plans, and odd rows against plain Python."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import constants as K
from textloom import queries as Q
from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import caches
from textloom.operators import chunk as C
from textloom.operators import grams as N
from textloom.operators import index as I
from textloom.operators import retrieve as R
from textloom.operators import vector as V
from textloom.plans import shared

SMALL = "/root/testdata/sf0.001"
STOP = K.COMMON_WORDS | K.NOISE_TERMS
#: Made of each document where it lies: no exchange by key.
IN_PLACE = ["graph_impact", "graph_neighbors_2hop", "pmi", "cooccurrence_edges", "hierarchical_edges", "term_stats", "table_stats", "ngram_postings"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_PLACE)
def test_no_shuffle(spark, name):
    assert "Exchange hashpartitioning" not in plan(Q.QUERIES[name](spark, SMALL))


#: Document 1 has two rows, and its chunks the same numbers; one document has no words, one no id.
ROWS = [(1, 0, "graph theory graph theory enzyme issn graph"), (2, 0, "enzyme enzyme kinase of kinase"), (1, 1, "graph theory market"), (1, 0, "market graph theory"), (3, 0, ""), (None, 0, "enzyme kinase")]


def terms_by_hand(rows):
    found = defaultdict(list)
    for d, i, text in rows:
        w = text.split()
        for n in (1, 2, 3):
            for a in range(len(w) - n + 1):
                g = " ".join(w[a : a + n])
                if n == 1 and g not in K.NOISE_TERMS and len(g) > 1 or n > 1 and w[a] not in STOP and w[a + n - 1] not in STOP and "issn" not in g:
                    found[d, g].append(i)
    return found


def odd_chunks(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, idx int, text string")
    return df.select("doc_id", "idx", F.expr("filter(split(text, ' '), w -> w <> '')").alias("words"))


def test_terms_of_documents(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_WORDS", 4)
    made = shared.by_document(odd_chunks(spark), lambda rows: rows)
    got = {(r.doc_id, r.term): (r.freq, r.chunks, list(r.chunk_ids)) for r in N.document_terms(made, "doc_id", ("freq", "chunks", "chunk_ids")).collect()}
    assert got == {k: (len(v), len(set(v)), sorted(set(v))) for k, v in terms_by_hand(ROWS).items()}
    same = shared.by_document(odd_chunks(spark), lambda rows: rows)
    known = I.pmi(I.term_statistics(I.chunk_terms(odd_chunks(spark))), odd_chunks(spark).groupBy("doc_id").agg(F.count("*").alias("total_chunks")))
    want = {(r.doc_id, r.term): round(r.pmi, 9) for r in known.collect()}
    assert {(r.doc_id, r.term): round(r.pmi, 9) for r in N.document_terms(same, "doc_id", ("pmi",)).where("doc_id is not null").collect()} == want


def test_frequent_terms_and_their_graph(spark):
    made = N.frequent_terms(shared.by_document(odd_chunks(spark), lambda rows: rows), "doc_id", 4)
    best = {}
    for d in (1, 2, None):
        freq = Counter({g: len(v) for (e, g), v in terms_by_hand(ROWS).items() if e == d and len(g) > 4 and g not in STOP})
        best[d] = sorted(freq, key=lambda g: (-freq[g], g))[:4]
    assert {r.doc_id: r.labels for r in made.collect()} == best
    edges = I.graph(made)
    assert {tuple(r) for r in I.document_impact(made).collect()} == {tuple(r) for r in I.impact(edges).collect()}
    start = made.where("doc_id is not null").select("doc_id", F.array_min("labels").alias("term"))
    assert {tuple(r) for r in I.document_related(made).collect()} == {tuple(r) for r in I.related(edges, start).where("other <> term").collect()}


def test_nearest_in_tiles(monkeypatch):
    monkeypatch.setattr(V, "TILE_QUERIES", 7)
    monkeypatch.setattr(V, "TILE_VECTORS", 11)
    rng = np.random.default_rng(3)
    vm = rng.normal(size=(60, 8))
    vm[40:] = vm[:20] * 3  # equal cosines
    vm[5] = 0
    qm = np.concatenate([vm[::3], rng.normal(size=(9, 8))])
    for odd in (False, True):
        if odd:
            vm[7, 2] = np.nan
        length = np.linalg.norm(qm, axis=1)[:, None] * np.linalg.norm(vm, axis=1)
        score = np.round(np.divide(qm @ vm.T, length, out=np.zeros_like(length), where=length != 0), 9)
        score = np.where(np.isnan(score), np.inf, score)
        for k in (1, 4, 100):
            i, j, _ = V.nearest(qm, vm, k)
            least = np.sort(score, 1)[:, max(0, 60 - k), None]
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(score >= least))))


def test_buckets_that_are_cut(spark, monkeypatch):
    """Only the best leave a bucket, whose sides are cut into blocks; of pairs themselves there is no join."""
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {tuple(r)[:2] for r in V.block_search(asked, vectors, 3).collect()}
    monkeypatch.setattr(V, "EXACT_PAIRS", 0)
    monkeypatch.setattr(V, "BLOCK_ROWS", 30)
    monkeypatch.setattr(V, "BLOCK_VALUES", 64 * 100)
    met = []
    whole = V.best_of_groups
    monkeypatch.setattr(V, "best_of_groups", lambda rows, *a: met.append(rows.count()) or whole(rows, *a))
    assert {tuple(r)[:2] for r in V.lsh_search(asked, vectors, 3).collect()} == want
    assert met[0] < 24 * 2 * 3 * vectors.count()


def test_postings_and_tables_of_repeated_documents(spark, monkeypatch):
    """Counts of rows of one document with the same number, in batches of a few words, against the postings themselves."""
    monkeypatch.setattr(N, "SLICE_WORDS", 4)
    made = shared.by_document(odd_chunks(spark), lambda rows: rows)
    want = I.postings(odd_chunks(spark)).distinct().groupBy("doc_id", "idx").agg(F.count("*"), F.sum((F.col("size") > 1).cast("long")), F.sum(F.length("gram")))
    assert {tuple(r) for r in N.posting_counts(made, "doc_id").collect()} == {tuple(r) for r in want.collect()}
    tables = {r.doc_id: (r.unique_ngrams, r.total_insertions) for r in I.table_stats(odd_chunks(spark)).collect()}
    grams = defaultdict(list)
    for r in I.postings(odd_chunks(spark), max_n=4).collect():
        grams[r.doc_id].append(r.gram)
    assert {d: n for d, (n, _) in tables.items()} == {d: len(set(g)) for d, g in grams.items()}
    texts = ["", "a", "graph theory", "été naïve", "graph theory enzyme kinase"]
    hashes = spark.createDataFrame([(t,) for t in texts], "t string").select(M.hash_all(F.col("t"), 1 << 32).alias("h")).collect()
    assert N.table_hashes(pa.array(texts)).T.tolist() == [list(r.h) for r in hashes]


def test_frequency_of_grams(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_WORDS", 4)
    want = defaultdict(lambda: [0, set(), set()])
    for d, i, text in ROWS:
        w = text.split()
        runs = [(n, w[a : a + n]) for n in (2, 3, 4) for a in range(len(w) - n + 1)] + [(1, [x]) for x in dict.fromkeys(w) if len(x) > 4]
        for n, g in runs:
            if g[0] not in STOP and g[-1] not in STOP:
                have = want[" ".join(g), n]
                have[0] += 1
                have[1].add((d, i))
                have[2].add(d)
    for whole in (True, False):
        made = shared.by_document(odd_chunks(spark), lambda rows: rows) if whole else odd_chunks(spark)
        got = {(r.gram, r["size"]): (r.occurrences, r.chunks, r.docs) for r in I.gram_frequency(made, whole=whole, parts=3).collect()}
        assert got == {k: (n, len(c), len(d)) for k, (n, c, d) in want.items()}


def test_sentences_keep_their_first_digit(spark):
    """Spark's trim of the elements of this text's split drops the first digit of one of them."""
    path = "/root/testdata/check_s/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no check_s")
    docs = spark.read.parquet(path).where("doc_id = 8775").select("doc_id", "text")
    assert any(s.startswith("4596436320684846 ") for s in docs.select(X.base_sentences(F.col("text")).alias("s")).first().s)


def test_merged_sentences_by_hand(spark):
    texts = ["One two. Three four five six seven eight nine ten. 11 is next. see www. a@b.c Mail x@y.de. And http://a.b/c. So on... Then. ", "", "no end", "A. B. C; d", "Wait... What?  Yes!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: list(r.s) for r in docs.select("doc_id", X.sentences(F.col("text")).alias("s")).collect()}
    got = defaultdict(list)
    for r in sorted(C.merged_sentences(docs).collect()):
        got[r.doc_id].append(r.sentence)
    assert {d: s for d, s in want.items() if s} == got
    assert "ArrowEvalPythonExec" not in plan(C.merged_sentences(docs)) and "MapInArrow" in plan(C.merged_sentences(docs))


def test_near_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("graph theory enzyme kinase market yield".split()) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(60, None)]
    asked = spark.createDataFrame(rows, "query_id long, query string")
    pairs = {}
    for a, x in rows:
        for b, y in rows:
            if a < b and x and y:
                f, g = np.array(caches.ApproximateCache.print_of(x)), np.array(caches.ApproximateCache.print_of(y))
                cos = f @ g / (np.sqrt(f @ f) * np.sqrt(g @ g))
                if cos >= 0.85:
                    pairs[a, b] = round(cos, 12)
    for size in (7, 1000):
        monkeypatch.setattr(caches, "NEAR_BLOCK", size)
        found = caches.near_queries(asked)
        assert "NestedLoop" not in plan(found)
        assert {(r.query_a, r.query_b): round(r.cosine, 12) for r in found.collect()} == pairs and found.count() == len(pairs)


def test_chunks_scored_in_place(spark):
    """The best of each batch hold the best of all, the queries without hits in the postings included."""
    rng = random.Random(5)
    vocab = "neural network gradient descent kernel matrix tensor graph learning learned learns the of and protein 7".split()
    rows = [(i // 5, i % 5, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, idx int, text string").withColumn("words", X.chunk_words(F.col("text"))).cache()
    asked = spark.createDataFrame([(1, "neural network learning"), (2, "the graph matrix"), (3, "unknownword"), (4, "of the and"), (5, None), (6, "learnly")], "query_id int, query string")
    want, got = (sorted(map(tuple, R.hash_retrieve(asked, made, p, 3, once=once).collect())) for p, once in ((I.postings(made), False), (None, True)))
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want])
    terms = R.query_terms(asked)
    assert sorted(map(tuple, R.local_lookup(terms, made, 3).collect())) == sorted(map(tuple, R.top_lookup(terms, I.postings(made), 3).select("query_id", "doc_id", "idx", "match_count", "size", "relevance", "rank").collect()))
