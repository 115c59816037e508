"""Retrieval for batches of queries: lookup in the postings, scores, reranking, diversity, gate, expansion.

Queries are a table (query_id, query), results a table (query_id, <id>, idx, score, hash_hits, ...), and
every step a join, aggregate or window by query. Join sides that are small are broadcast by Spark itself,
by their measured sizes; nothing is broadcast by hint.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import constants as K
from textloom.functions import text as X
from textloom.operators import grams as N
from textloom.operators import index
from textloom.plans.shared import cut

SPECIFIC = ("what is", "define", "explain", "how does", "what are", "describe", "difference between")
WEIGHTS = {"coverage": 0.30, "density": 0.25, "alignment": 0.20, "position": 0.08, "specificity": 0.12, "proximity": 0.05}


def strings() -> Column:
    return F.array().cast("array<string>")


def grams_of(tokens: Column, max_n: int = 4) -> Column:
    """The distinct n-grams of a query's tokens, and the tokens."""
    grams = F.transform(X.indexable_ngrams(tokens, max_n, boundaries=False, unigrams=False), lambda g: g["gram"])
    return F.array_distinct(F.concat(grams, tokens))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query, tokens, grams, stemmed): grams are n-grams and tokens, stemmed has stems too.

    A query of only common words has its normalised text as only gram; one without words has none.
    """
    tokens = X.concept_tokens(F.coalesce(F.col("query"), F.lit("")))
    base = queries.select("query_id", "query", tokens.alias("tokens"))
    whole = X.normalize(F.coalesce(F.col("query"), F.lit("")))
    alone = F.when(whole != "", F.array(whole)).otherwise(strings())
    grams = grams_of(F.col("tokens"))
    return base.withColumn("grams", F.when(F.size("tokens") > 0, grams).otherwise(alone)).withColumn(
        "stemmed", F.array_union("grams", F.transform("tokens", X.stem))
    )


def pieces(terms: DataFrame, grams: str = "stemmed") -> DataFrame:
    """(query_id, gram, piece): all runs of words in each gram; an n-gram is met through any of them."""
    each = terms.select("query_id", F.explode(grams).alias("gram"))
    words = X.concept_tokens(F.col("gram"))
    parts = F.when(F.size(words) > 0, grams_of(words)).otherwise(F.array(F.col("gram")))
    return each.select("query_id", "gram", F.explode(parts).alias("piece"))


def hits(terms: DataFrame, postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, hits, multi_hits, max_size): the grams of a query that meet a chunk."""
    rows = pieces(terms).withColumnRenamed("gram", "asked")
    found = rows.join(postings.select(id_col, "idx", F.col("gram").alias("piece"), "size"), "piece")
    each = found.groupBy("query_id", id_col, "idx", "asked").agg(F.max("size").alias("size"))
    return each.groupBy("query_id", id_col, "idx").agg(
        F.count(F.lit(1)).alias("hits"), F.sum((F.instr("asked", " ") > 0).cast("int")).alias("multi_hits"), F.max("size").alias("max_size")
    )


def lookup(terms: DataFrame, postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, match_count, size, relevance): the share of grams that a chunk has, and 0.1 for each word of the longest."""
    asked = terms.select("query_id", F.explode("grams").alias("gram"), F.size("grams").alias("n"))
    found = asked.join(postings, "gram").groupBy("query_id", id_col, "idx").agg(
        F.count(F.lit(1)).alias("match_count"), F.max("size").alias("size"), F.max("n").alias("n")
    )
    return found.withColumn("relevance", F.col("match_count") / F.col("n") + F.col("size") * 0.1).drop("n")


def top_lookup(terms: DataFrame, postings: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best of :func:`lookup` for each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), id_col, "idx")
    return lookup(terms, postings, id_col).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def content_stems(words: Column) -> Column:
    kept = F.filter(words, lambda w: ~X.is_stop(w) & (F.length(w) > 2))
    return F.array_distinct(F.transform(kept, X.stem))


def content_overlap(asked: Column, words: Column) -> Column:
    """The share of the query's content stems that the words have."""
    def share(q):
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_stems(words))) / F.greatest(F.size(q), F.lit(1)))

    return X.let(content_stems(asked), share)


def least_overlap(n: Column) -> Column:
    return F.when(n <= 1, 0.0).when(n == 2, 0.30).when(n == 3, 0.25).when(n <= 5, 0.20).otherwise(0.15)


def hash_score(total: Column, overlap: Column, toc: Column, n_tokens: Column) -> Column:
    """From hits, multi_hits and max_size."""
    h, m = F.col("hits"), F.col("multi_hits")
    n = F.greatest(total, F.lit(1))
    r, many = h / n, m / n
    s = (
        F.when((m > 0) & (h > m), 0.35 * r + 0.30 * overlap + 0.20 * many + 0.15)
        .when(m > 0, 0.40 * r + 0.35 * overlap + 0.25 * many)
        .otherwise(0.50 * r + 0.50 * overlap)
    )
    s = s * F.when((n_tokens > 1) & (h == 1) & (m == 0), 0.4).otherwise(1.0)
    return F.least(F.greatest(s - 0.4 * toc, F.lit(0.0)) + 0.02 * F.col("max_size"), F.lit(1.0))


def overlaps(rows: DataFrame, terms: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (query_id, <id>, idx, ...) with ``overlap``, the share of a query's content stems that the chunk has.

    Only stems that are asked for become rows, and are counted per pair.
    """
    own = terms.select(F.col("query_id").alias("__q"), content_stems(F.col("tokens")).alias("stems"))
    asked = own.select("__q", F.size("stems").alias("__n"), F.explode("stems").alias("w"))
    have = N.stem_rows(chunks, id_col, N.asked_hashes(asked.select("w")))
    both = asked.join(have, "w").groupBy("__q", F.col(id_col).alias("__d"), F.col("idx").alias("__i")).agg(
        (F.count(F.lit(1)) / F.first("__n")).alias("overlap")
    )
    same = (F.col("query_id") == F.col("__q")) & (F.col(id_col) == F.col("__d")) & (F.col("idx") == F.col("__i"))
    return rows.join(both, same, "left").drop("__q", "__d", "__i").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def restricted(rows: DataFrame, allowed: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """``rows`` of the documents that are allowed (query_id, <id>); queries that have none are not restricted."""
    if allowed is None:
        return rows
    bound = allowed.select("query_id").distinct()
    return rows.join(allowed.select("query_id", id_col), ["query_id", id_col], "left_semi").unionByName(rows.join(bound, "query_id", "left_anti"))


def fallback_hits(left: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits by words and stems for queries, as of :func:`query_terms`, that met nothing in the postings."""
    asked = left.select("query_id", F.explode(F.array_union("tokens", F.transform("tokens", X.stem))).alias("w"), F.size("tokens").alias("n"))
    have = N.stem_rows(chunks, id_col, N.asked_hashes(asked.select("w")), content=False)
    rows = asked.join(have, "w").groupBy("query_id", id_col, "idx").agg(F.countDistinct("w").alias("hits"), F.first("n").alias("n"))
    rows = overlaps(rows, left, chunks, id_col)
    return rows.where(F.col("overlap") >= least_overlap(F.col("n"))).select("query_id", id_col, "idx", "hits", F.lit(0).cast("long").alias("multi_hits"), F.lit(2).alias("max_size"))


def hash_retrieve(
    queries: DataFrame, chunks: DataFrame, postings: DataFrame | None, k: int = 20, id_col: str = "doc_id", fallback: bool = True,
    allowed: DataFrame | None = None, once: bool = False,
) -> DataFrame:
    """(query_id, <id>, idx, score, hash_hits, multi_hits, overlap, rank), the best k per query.

    ``once`` says that no two chunks have the same document and number: each is then scored where it lies.

    Ties are settled by hits, document and chunk. Chunks need (<id>, idx, text, words). Without ``postings``
    only those of the queries' n-grams are made. ``allowed`` (query_id, <id>) names the documents that are searched
    for a query, before its best are chosen; queries that it does not name search all.
    """
    terms = cut(query_terms(queries))
    if postings is None and allowed is None and once:
        best = local_hits(terms, chunks, k, id_col)
        if best is not None:
            left = cut(terms.join(best.select("query_id").distinct(), "query_id", "left_anti")) if fallback else None
            if left is None or left.isEmpty():
                return best
            return best.unionByName(ranked_hits(fallback_hits(left, chunks, id_col), terms, chunks, k, id_col))
    if postings is None:
        postings = index.postings(chunks, id_col, only=pieces(terms).select("piece"))
    met = cut(hits(terms, postings, id_col))
    found = restricted(met, allowed, id_col)
    left = cut(terms.join(met.select("query_id"), "query_id", "left_anti")) if fallback else None
    if left is not None and not left.isEmpty():
        found = found.unionByName(restricted(fallback_hits(left, chunks, id_col), allowed, id_col))
    return ranked_hits(found, terms, chunks, k, id_col)


def ranked_hits(found: DataFrame, terms: DataFrame, chunks: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The best k of the hits (query_id, <id>, idx, hits, multi_hits, max_size) of each query, by their score."""
    rows = found.join(terms.select("query_id", F.size("tokens").alias("n_tokens"), F.size("stemmed").alias("total")), "query_id")
    rows = overlaps(rows, terms, chunks, id_col)
    toc = chunks.select(F.col(id_col).alias("__d"), F.col("idx").alias("__i"), X.toc_ratio(F.col("text")).alias("toc")).where("toc > 0")
    rows = rows.join(toc, (F.col(id_col) == F.col("__d")) & (F.col("idx") == F.col("__i")), "left").drop("__d", "__i")
    rows = rows.withColumn("score", hash_score(F.col("total"), F.col("overlap"), F.coalesce("toc", F.lit(0.0)), F.col("n_tokens")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), "idx", id_col)
    return (
        rows.select("query_id", id_col, "idx", "score", F.col("hits").alias("hash_hits"), "multi_hits", "overlap", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= k)
    )


def collected(terms: DataFrame) -> tuple[pa.Array, list] | None:
    """The ids of queries, as of :func:`query_terms`, and their rows; None if there are too many n-grams to hold, or repeated ids."""
    count = terms.agg(F.count(F.lit(1)), F.countDistinct("query_id"), F.sum(F.size("stemmed"))).first()
    if count[0] != count[1] or (count[2] or 0) > N.ASKED // 16:
        return None
    own = pieces(terms).groupBy("query_id").agg(F.collect_list(F.struct("gram", "piece")).alias("pieces"))
    stems = terms.select("query_id", "tokens", "grams", "stemmed", content_stems(F.col("tokens")).alias("stems"))
    rows = stems.join(own, "query_id", "left").collect()
    return pa.array([r.query_id for r in rows]), rows


def local_hits(terms: DataFrame, chunks: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame | None:
    """The rows of :func:`hash_retrieve` that meet the postings, the best k per query: each chunk is scored where it lies, and only
    the best of a batch leave it. None if the queries are too many to be sent to all tasks."""
    held = collected(terms)
    if held is None:
        return None
    ids, rows = held
    grams = [(q, g) for q, r in enumerate(rows) for g in sorted({p.gram for p in r.pieces or ()})]
    number = {x: i for i, x in enumerate(grams)}
    of, multi = np.array([q for q, _ in grams], np.int64), np.array([" " in g for _, g in grams], np.int64)
    asked = N.Asked([(p.piece, number[q, p.gram]) for q, r in enumerate(rows) for p in r.pieces or ()])
    stems = N.Asked([(w, q) for q, r in enumerate(rows) for w in r.stems])
    n_stems, n_tokens, total = (np.array([len(r[c]) for r in rows], np.int64) for c in ("stems", "tokens", "stemmed"))
    pattern, stop = "|".join(f"(.{{3,}}){x}" for x in X.STEM_SUFFIXES), X.STOP_TERMS

    def score(b, toc):
        key, size = N.met_pairs(b, asked, max(1, len(grams)))
        row, gram = key // max(1, len(grams)), key % max(1, len(grams))
        q = of[gram]
        both = row * len(rows) + q
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        if not len(first):
            return [], [], ids, [], [], False
        h, m, most = np.diff(np.append(first, len(both))), np.add.reduceat(multi[gram], first), np.maximum.reduceat(size, first)
        row, q, both = row[first], q[first], both[first]
        shape = re.compile(pattern)
        word = N._mix(N._word_hashes([N.cut_suffix(w, shape) for w in b.texts]))
        content = np.flatnonzero((~b.test(stop) & (b.size > 2))[b.code])
        pairs = _unique_pairs(b.row[content], word[b.code[content]])
        at, owner = stems.met(pairs[1])
        have, times = np.unique(pairs[0][at] * len(rows) + owner, return_counts=True)
        place = np.minimum(np.searchsorted(have, both), max(0, len(have) - 1))
        times = np.where(have[place] == both, times[place], 0) if len(have) else np.zeros(len(both), np.int64)
        overlap = times / np.maximum(n_stems[q], 1)
        n = np.maximum(total[q], 1)
        r, many = h / n, m / n
        s = np.where((m > 0) & (h > m), 0.35 * r + 0.30 * overlap + 0.20 * many + 0.15, np.where(m > 0, 0.40 * r + 0.35 * overlap + 0.25 * many, 0.50 * r + 0.50 * overlap))
        s = s * np.where((n_tokens[q] > 1) & (h == 1) & (m == 0), 0.4, 1.0)
        s = np.minimum(np.maximum(s - 0.4 * toc[row], 0.0) + 0.02 * most, 1.0)
        return row, q, ids, [s, h], [s, h, m, overlap], False

    schema = T.StructType([terms.schema["query_id"], chunks.schema[id_col], chunks.schema["idx"], T.StructField("score", T.DoubleType()), T.StructField("hash_hits", T.LongType()), T.StructField("multi_hits", T.LongType()), T.StructField("overlap", T.DoubleType())])
    toc = chunks.select(id_col, "idx", "words", F.coalesce(X.toc_ratio(F.col("text")), F.lit(0.0)).alias("toc"))
    found = cut(N.best_rows(toc, id_col, k, score, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hash_hits"), "idx", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unique_pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, _ = N._distinct(row, h)
    return row[first], h[first]


def local_lookup(terms: DataFrame, chunks: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """As :func:`top_lookup` over all postings of the chunks: only the best of a batch leave it."""
    held = collected(terms)
    if held is None:
        return top_lookup(terms, index.postings(chunks, id_col, only=terms.select(F.explode("grams"))), k, id_col)
    ids, rows = held
    grams = [(q, g) for q, r in enumerate(rows) for g in r.grams]
    of, n = np.array([q for q, _ in grams], np.int64), np.array([len(r.grams) for r in rows], np.int64)
    asked = N.Asked([(g, i) for i, (_, g) in enumerate(grams)])

    def score(b, toc):
        key, size = N.met_pairs(b, asked, max(1, len(grams)))
        row, q = key // max(1, len(grams)), of[key % max(1, len(grams))]
        both = row * len(rows) + q
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        if not len(first):
            return [], [], ids, [], [], True
        times, most = np.diff(np.append(first, len(both))), np.maximum.reduceat(size, first)
        row, q = row[first], q[first]
        relevance = times / n[q] + most * 0.1
        return row, q, ids, [relevance], [times, most, relevance], True

    schema = T.StructType([terms.schema["query_id"], chunks.schema[id_col], chunks.schema["idx"], T.StructField("match_count", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("relevance", T.DoubleType())])
    found = cut(N.best_rows(chunks.select(id_col, "idx", "words", F.lit(0.0).alias("toc")), id_col, k, score, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), id_col, "idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_documents(chunks: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The chunks of the documents of the results, written to the shared folder."""
    wanted = cut(found.select(id_col).distinct())
    few = wanted.count() <= N.ASKED
    return cut(chunks.join(F.broadcast(wanted) if few else wanted, id_col, "left_semi"))


# ---- reranking


def rerank_content(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: ~X.member(w, K.RERANK_STOP_WORDS | K.NOISE_TERMS) & (F.length(w) > 2)))


def share(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    )


def specificity(asked: Column, words: Column) -> Column:
    """How many of the query's words occur, even inside other words, for their number and for the chunk's length."""
    joined = F.lower(F.array_join(words, " "))

    def score(t):
        n = F.size(F.filter(asked, lambda w: F.contains(t, w)))
        return F.least(0.6 * n / F.greatest(F.size(asked), F.lit(1)) + 40 * n / F.greatest(F.size(words), F.lit(1)), F.lit(1.0))

    return F.when((F.size(asked) == 0) | (F.size(words) == 0), F.lit(0.0)).otherwise(X.let(joined, score))


def proximity(asked: Column, text: Column) -> Column:
    """How near to each other the query's words first occur, and how many of them do."""
    def score(words):
        at = F.filter(F.transform(asked, lambda w: F.array_position(words, w)), lambda p: p > 0)

        def value(p):
            gap = (F.array_max(p) - F.array_min(p)) / F.greatest(F.size(p) - 1, F.lit(1))
            return F.when(F.size(p) < 2, F.lit(0.0)).otherwise(1 / (1 + gap / 10) * F.size(p) / F.greatest(F.size(asked), F.lit(1)))

        return X.let(at, value)

    return F.when(F.size(asked) < 2, F.lit(0.5)).otherwise(X.let(X.split_words(F.lower(text)), score))


def tie_break() -> Column:
    """Digits beyond those that count, as a small difference between equal scores."""
    rest = lambda c, n: F.col(c) - F.floor(F.col(c) * n) / n
    return (
        0.001 * (rest("density", 1000) + rest("proximity", 1000) + rest("specificity", 100))
        + 0.0005 * (rest("position", 100) + rest("overlap", 100))
    )


def rerank_features(
    results: DataFrame, queries: DataFrame, chunks: DataFrame, id_col: str = "doc_id", concept_chunks: DataFrame | None = None
) -> DataFrame:
    """``results`` with coverage, density, alignment, position, specificity, proximity, overlap, penalty and
    rerank_score. ``concept_chunks`` (query_id, <id>, idx) are chunks of the concept that is asked for."""
    terms = query_terms(queries).select("query_id", "grams", rerank_content(F.col("tokens")).alias("asked"), "tokens")
    total = chunks.groupBy(F.col(id_col).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    keep = [c for c in results.columns if c != "overlap"]
    rows = results.select(*keep).join(terms, "query_id").join(chunks.select(id_col, "idx", "text", "words"), [id_col, "idx"])
    rows = rows.join(total, F.col(id_col) == F.col("__d"))
    if concept_chunks is None:
        rows = rows.withColumn("alignment", F.lit(0.0))
    else:
        mark = concept_chunks.select("query_id", id_col, "idx", F.lit(1.0).alias("alignment")).distinct()
        rows = rows.join(mark, ["query_id", id_col, "idx"], "left").na.fill(0.0, ["alignment"])
    own = F.array_union(
        F.transform(X.indexable_ngrams(F.col("words"), 4, unigrams=False), lambda g: g["gram"]), F.filter("words", lambda w: ~X.is_noise(w))
    )
    rows = rows.withColumn("__own", own).withColumn("__content", rerank_content(F.col("words")))
    rows = rows.withColumn("matching", F.size(F.array_intersect("grams", "__own")))
    overlap = F.greatest(share(F.col("asked"), F.col("__content")), share(X.stem_set(F.col("asked")), X.stem_set(F.col("__content"))))
    rows = rows.withColumn("overlap", overlap).withColumns(
        {
            "coverage": 0.5 * F.col("matching") / F.greatest(F.size("grams"), F.lit(1)) + 0.5 * F.col("overlap"),
            "density": F.when(F.size("__own") > 0, F.col("matching") / F.greatest(F.size("__own"), F.lit(1))).otherwise(0.0),
            "position": 1 / (1 + F.col("idx") / F.greatest("__n", F.lit(1))),
            "specificity": specificity(F.col("asked"), F.col("words")),
            "proximity": proximity(F.col("asked"), F.col("text")),
            "__head": F.array_distinct(F.slice("words", 1, 20)),
        }
    )
    me = F.struct(F.col(id_col).alias("d"), F.col("idx").alias("i"), F.col("__head").alias("w"))
    rows = rows.withColumn("__me", me).withColumn("__all", F.collect_list("__me").over(Window.partitionBy("query_id")))
    others = F.filter("__all", lambda x: (x["d"] != F.col(id_col)) | (x["i"] != F.col("idx")))
    most = F.coalesce(F.array_max(F.transform(others, lambda x: jaccard(x["w"], F.col("__head")))), F.lit(0.0))
    rows = rows.withColumn("__most", most).withColumn("penalty", F.when(F.col("__most") > 0.8, 0.2).when(F.col("__most") > 0.6, 0.1).otherwise(0.0))
    base = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)) - F.col("penalty")
    score = F.least(F.greatest(base, F.lit(0.0)) + tie_break(), F.lit(1.0))
    features = ["coverage", "density", "alignment", "position", "specificity", "proximity", "overlap", "penalty", "matching"]
    return rows.withColumn("rerank_score", F.when(F.size("grams") == 0, F.col("score")).otherwise(score)).select(*keep, *features, "rerank_score", "words")


def diverse(ranked: DataFrame, most: float = 0.85, id_col: str = "doc_id", order: tuple = ("rerank_score",)) -> DataFrame:
    """Results less alike than ``most`` to all better ones that stay, by the Jaccard of their first 30 words; ``rank`` is made anew."""
    w = Window.partitionBy("query_id").orderBy(*[F.desc(c) for c in order], "idx", id_col)
    rows = ranked.drop("rank").withColumn("rank", F.row_number().over(w))
    item = F.struct("rank", F.array_distinct(F.slice("words", 1, 30)).alias("w"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    chosen = F.aggregate(
        "all", none, lambda acc, x: F.when(F.exists(acc, lambda y: jaccard(x["w"], y["w"]) >= most), acc).otherwise(F.concat(acc, F.array(x)))
    )
    kept = lists.select("query_id", F.posexplode(F.transform(chosen, lambda x: x["rank"])).alias("new", "rank"))
    return rows.join(kept, ["query_id", "rank"]).withColumn("rank", F.col("new") + 1).drop("new")


def rerank(results: DataFrame, queries: DataFrame, chunks: DataFrame, id_col: str = "doc_id", concept_chunks: DataFrame | None = None) -> DataFrame:
    """:func:`rerank_features` in order of the new score, without results that repeat better ones."""
    return diverse(rerank_features(results, queries, chunks, id_col, concept_chunks), id_col=id_col)


def rerank_four(found: DataFrame, terms: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lookup results by 0.35 coverage, 0.30 density and 0.10 position, as the postings table ranks its own entries."""
    total = chunks.groupBy(F.col(id_col).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    rows = found.join(terms.select("query_id", "grams"), "query_id").join(chunks.select(id_col, "idx", "words"), [id_col, "idx"], "left")
    rows = rows.join(total, F.col(id_col) == F.col("__d"), "left")
    own = F.array_union(F.transform(X.indexable_ngrams(F.col("words"), 4, unigrams=False), lambda g: g["gram"]), F.filter("words", lambda w: ~X.is_noise(w)))
    rows = rows.withColumn("__own", own).withColumn("m", F.size(F.array_intersect("grams", "__own")))
    score = 0.35 * F.col("m") / F.greatest(F.size("grams"), F.lit(1)) + 0.30 * F.col("m") / F.greatest(F.size("__own"), F.lit(1))
    score = score + 0.10 / (1 + F.col("idx") / F.greatest("__n", F.lit(1)))
    score = F.when(F.col("words").isNull(), F.col("relevance") * 0.5).otherwise(score)
    return rows.select("query_id", id_col, "idx", "relevance", score.alias("score"))


# ---- merging, gate, expansion


def dual_merge(hash_results: DataFrame, vector_results: DataFrame, hash_weight: float = 0.6, vector_weight: float = 0.4, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, score, hash_score, vector_score, hash_hits, both): chunks found both ways count for more."""
    rows = hash_results.select("query_id", id_col, "idx", F.col("score").alias("h"), F.lit(None).cast("double").alias("v"), "hash_hits").unionByName(
        vector_results.select("query_id", id_col, "idx", F.lit(None).cast("double").alias("h"), F.col("score").alias("v"), F.lit(0).cast("long").alias("hash_hits"))
    )
    out = rows.groupBy("query_id", id_col, "idx").agg(F.max("h").alias("h"), F.max("v").alias("v"), F.max("hash_hits").alias("hash_hits"))
    both = F.col("h").isNotNull() & F.col("v").isNotNull()
    h, v = F.coalesce("h", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    score = F.least((hash_weight * h + vector_weight * v) * F.when(both, 1.2).otherwise(1.0), F.lit(1.0))
    return out.select("query_id", id_col, "idx", score.alias("score"), h.alias("hash_score"), v.alias("vector_score"), "hash_hits", both.alias("both"))


def query_specificity(query: Column) -> Column:
    words = X.split_words(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", " "))

    def score(w):
        content = F.size(F.filter(w, lambda x: ~X.member(x, K.GATE_STOP_WORDS) & (F.length(x) > 2)))
        quoted = F.contains(query, F.lit('"')) | F.contains(query, F.lit("'"))
        special = F.lower(query).rlike("|".join(SPECIFIC))
        s = content / F.greatest(F.size(w), F.lit(1)) + F.when(quoted, 0.2).otherwise(0.0) + F.when(special, 0.1).otherwise(0.0)
        return F.when(F.size(w) == 0, F.lit(0.5)).otherwise(F.least(s + F.when(content >= 4, 0.1).otherwise(0.0), F.lit(1.0)))

    return X.let(words, score)


def _fill(rows: DataFrame, threshold: Column, least: int) -> DataFrame:
    """Rows at the threshold or, if those are fewer than ``least``, the best of the others too; ``ord`` has their order."""
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("__ok", F.col("score") >= threshold).withColumn("__n", F.sum(F.col("__ok").cast("int")).over(q))
    rows = rows.withColumn("__f", F.row_number().over(Window.partitionBy("query_id", "__ok").orderBy(F.desc("score"), "rank")))
    rows = rows.where(F.col("__ok") | (F.col("__f") <= least - F.col("__n")))
    order = Window.partitionBy("query_id").orderBy(F.desc("__ok"), F.when(F.col("__ok"), F.col("rank")).otherwise(F.col("__f")))
    return rows.withColumn("ord", F.row_number().over(order)).drop("__ok", "__n", "__f")


def gate_apply(results: DataFrame, least: int = 2, most: int = 7, threshold: float = 0.3) -> DataFrame:
    """Results (query_id, rank, score, ...) at the threshold, at least ``least`` and at most ``most`` per query."""
    return _fill(results, F.lit(threshold), least).where(F.col("ord") <= most).withColumn("rank", F.col("ord")).drop("ord")


def gate_decide(
    results: DataFrame, queries: DataFrame, least: int = 2, most: int = 7, threshold: float = 0.3, relevance: Column | None = None
) -> DataFrame:
    """As :func:`gate_apply`, with bounds from how specific the query is, and fewer results where all score alike."""
    q = Window.partitionBy("query_id")
    spec = queries.select("query_id", F.coalesce(query_specificity(F.col("query")), F.lit(0.5)).alias("__s"))
    rows = results.join(spec, "query_id").withColumn("__avg", F.avg("score").over(q))
    rows = rows.withColumn("__spread", F.max("score").over(q) - F.min("score").over(q)).withColumn("__rank", F.row_number().over(q.orderBy("rank")))
    s = F.col("__s")
    limit = F.when(s > 0.7, max(least, 3)).when(s > 0.4, most).otherwise(min(most + 3, 10))
    if relevance is not None:
        limit = F.when(relevance < 0.2, F.least(limit + 2, F.lit(10))).when(relevance > 0.7, F.greatest(F.lit(least), limit - 2)).otherwise(limit)
    level = F.when(s > 0.7, F.greatest(F.lit(threshold), 0.7 * F.col("__avg"))).when(s > 0.4, threshold).otherwise(min(threshold, 0.15))
    rows = rows.withColumn("__limit", limit).withColumn("__level", level)
    kept = _fill(rows, F.col("__level"), least)
    kept = kept.withColumn("__count", F.count(F.lit(1)).over(q)).withColumn("__top", F.first("score").over(q.orderBy("ord")))
    flat = (F.col("__spread") < 0.05) & (F.col("__count") > least + 1)
    near = F.col("score") >= F.col("__top") - 0.15
    kept = kept.withColumn("__near", F.sum(near.cast("int")).over(q))
    kept = kept.where(~flat | F.when(F.col("__near") >= least, near).otherwise(F.col("__rank") <= least))
    kept = kept.withColumn("rank", F.row_number().over(q.orderBy("ord"))).where(F.col("rank") <= F.col("__limit"))
    return kept.drop("ord", *[c for c in kept.columns if c.startswith("__")])


def expand(
    results: DataFrame, queries: DataFrame, postings: DataFrame, concepts: DataFrame | None = None, links: DataFrame | None = None,
    target: int = 3, id_col: str = "doc_id",
) -> DataFrame:
    """(query_id, <id>, idx, score, source, rank): results, filled up to ``target`` for queries with fewer.

    First by single words of the query (0.7), then by definitions of concepts that share a word with it
    (0.5), then by neighbours of concepts named in it (0.3). ``concepts`` has (<id>, label, chunk_ids,
    definition), ``links`` (<id>, term, other, weight). A later stage counts only where those before left a gap.
    """
    terms = query_terms(queries)
    have = results.select("query_id", id_col, "idx", "score", F.lit("result").alias("source"), F.lit(0).alias("stage"))
    words = terms.select("query_id", F.explode(F.filter("tokens", lambda t: F.length(t) > 2)).alias("gram")).distinct()
    unigram = words.join(postings, "gram").groupBy("query_id", id_col, "idx").agg(((1.0 + F.max("size") * 0.1) * 0.7).alias("score"))
    rows = have.unionByName(unigram.select("*", F.lit("unigram").alias("source"), F.lit(1).alias("stage")))
    if concepts is not None:
        lower = F.lower("query")
        asked = queries.select("query_id", lower.alias("q"), F.explode(F.array_distinct(X.split_words(lower))).alias("w"))
        named = concepts.select(id_col, "label", "chunk_ids", F.coalesce("definition", F.lit("")).alias("definition"), F.explode(F.array_distinct(X.split_words(F.lower("label")))).alias("w"))
        meet = asked.join(named, "w").groupBy("query_id", "q", id_col, "label").agg(
            F.count(F.lit(1)).alias("n"), F.first("chunk_ids").alias("chunk_ids"), F.first("definition").alias("definition")
        )
        best = Window.partitionBy("query_id").orderBy(F.desc("n"), "label", id_col)
        near = meet.where(F.lower("label") != F.col("q")).withColumn("r", F.row_number().over(best)).where("r <= 5 and definition <> ''")
        key = F.array_join(F.slice(X.concept_tokens(F.substring("definition", 1, 300)), 1, 10), " ")
        found = lookup(query_terms(near.select(F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("r").cast("string")).alias("query_id"), key.alias("query"))), postings, id_col)
        back = F.substring_index("query_id", "\u0001", 1).cast(queries.schema["query_id"].dataType)
        found = found.select(back.alias("query_id"), id_col, "idx", (F.col("relevance") * 0.5).alias("score"), F.lit("definition").alias("source"), F.lit(2).alias("stage"))
        rows = rows.unionByName(found)
        if links is not None:
            inside = F.contains(F.col("q"), F.lower("label")) | F.contains(F.lower("label"), F.col("q"))
            start = meet.where(inside).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("label", id_col))).where("r <= 3")
            other = start.select("query_id", F.col(id_col).alias("__d"), F.col("label").alias("__t")).join(
                links, (F.col("__d") == F.col(id_col)) & (F.col("__t") == F.col("term"))
            ).select("query_id", id_col, F.col("other").alias("label"))
            near = other.join(concepts.select(id_col, "label", "chunk_ids"), [id_col, "label"]).select("query_id", id_col, F.explode("chunk_ids").alias("idx"))
            rows = rows.unionByName(near.select("query_id", id_col, "idx", F.lit(0.3).alias("score"), F.lit("graph").alias("source"), F.lit(3).alias("stage")))
    once = Window.partitionBy("query_id", id_col, "idx").orderBy("stage", F.desc("score"))
    rows = rows.withColumn("__o", F.row_number().over(once)).where("__o = 1").drop("__o")
    q = Window.partitionBy("query_id")
    early = F.sum((F.col("stage") < 3).cast("int")).over(q)
    n0 = F.sum((F.col("stage") == 0).cast("int")).over(q)
    rows = rows.withColumn("__early", early).withColumn("__n0", n0).where((F.col("stage") == 0) | (F.col("__n0") < target))
    first = F.when(F.col("__early") >= target, F.col("stage")).otherwise(0)
    ranked = rows.withColumn("rank", F.row_number().over(q.orderBy(first, F.desc("score"), id_col, "idx")))
    return ranked.where((F.col("rank") <= target) | (F.col("__n0") >= target)).drop("stage", "__early", "__n0")


def document_relevance(queries: DataFrame, chunks: DataFrame, concepts: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, relevance): the share of a query's content words in the first 200 characters of the
    first 30 chunks, half for those found only inside a concept; pairs without any have no row, and neither has a
    query without such words, which is for all documents alike.

    Up to ``N.ASKED`` distinct words become one automaton that reads each document once; beyond, documents meet the words
    in blocks of them.
    """
    head = chunks.where("idx < 30").groupBy(id_col).agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substring("text", 1, 200).alias("t")))), lambda x: x["t"]), " ")).alias("head")
    )
    if concepts is not None:
        labels = concepts.groupBy(id_col).agg(F.lower(F.array_join(F.array_sort(F.collect_set("label")), "\n")).alias("labels"))
        head = head.join(labels, id_col, "left")
    else:
        head = head.withColumn("labels", F.lit(""))
    content = F.array_distinct(F.filter(X.split_words(F.lower("query")), lambda w: ~X.member(w, K.RELEVANCE_STOP_WORDS) & (F.length(w) > 2)))
    asked = queries.select("query_id", F.coalesce(content, strings()).alias("words"))
    asked = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("w"))
    words = asked.select("w").distinct()
    parts = max(1, -(-words.count() // N.ASKED))
    found = None
    for part in range(parts):
        mine = [r.w for r in words.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == part).collect()]
        made = head.select(id_col, "head", F.coalesce("labels", F.lit("")).alias("labels")).mapInArrow(_finder(mine, id_col), _found_schema(head, id_col))
        found = made if found is None else found.unionByName(made)
    met = asked.join(found, "w").groupBy("query_id", id_col)
    return met.agg((F.sum("worth") / F.first("n")).alias("relevance"))


def _found_schema(head: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([T.StructField(id_col, head.schema[id_col].dataType), T.StructField("w", T.StringType()), T.StructField("worth", T.DoubleType())])


def _finder(words: list[str], id_col: str):
    """Over (<id>, head, labels): (<id>, w, worth) of the words that occur in either, anywhere."""
    def find(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        if words:
            machine.make_automaton()
        for batch in batches:
            at, got, worth = [], [], []
            for i, (text, labels) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                first = {w for _, w in machine.iter(text or "")} if words else set()
                second = ({w for _, w in machine.iter(labels)} if words and labels else set()) - first
                at += [i] * (len(first) + len(second))
                got += [*first, *second]
                worth += [1.0] * len(first) + [0.5] * len(second)
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(got, pa.string()), pa.array(worth, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "w", "worth"])

    return find


def relevant_documents(relevance: DataFrame, least: float = 0.15) -> DataFrame:
    """The documents worth searching for each query: those with enough relevance. A query that has none here searches all."""
    return relevance.where(F.col("relevance") >= least)


def context(chunks: DataFrame, window: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(<id>, idx, context): the text of each chunk with ``window`` chunks before and after it."""
    around = Window.partitionBy(id_col).orderBy("idx").rowsBetween(-window, window)
    return chunks.select(id_col, "idx", F.array_join(F.collect_list("text").over(around), "\n\n").alias("context"))


def answer(results: DataFrame, chunks: DataFrame, n: int = 3, chars: int = 200, id_col: str = "doc_id") -> DataFrame:
    """(query_id, answer): the beginnings of the best n results."""
    rows = results.where(F.col("rank") <= n).join(chunks.select(id_col, "idx", "text"), [id_col, "idx"])
    parts = F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("answer"))
