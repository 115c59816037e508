"""The index as tables: n-gram postings, scored concepts and the graph between them.

A chunk is known by its document and number. An inverted index answers what slots of hash tables would,
so lookups are equi-joins on the n-gram; slots are worked out only for statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import grams as N
from textloom.plans.shared import sorted_by_document

DEFINITIONS = (
    r"(?im)\b([A-Za-z][A-Za-z -]{2,40}?)\s+(?:is|are)\s+(?:defined\s+as|known\s+as|called|referred\s+to\s+as)\b",
    r"(?im)(?:^|[.!?]\s+)(?:a|an|the)?\s*([A-Za-z][A-Za-z -]{2,40}?)\s+(?:is|are)\s+(?:a|an|the)\s+\w+",
    r"(?im)\b([A-Za-z][A-Za-z -]{2,40}?)\s+(?:refers|refer)\s+to\b",
    r"(?im)\b([A-Za-z][A-Za-z -]{2,40}?)\s+(?:means|denotes|describes|represents)\b",
    r"(?im)\b(?:define|defines|defined)\s+([A-Za-z][A-Za-z -]{2,40}?)\s+as\b",
    r"(?im)^\s*([A-Z][A-Za-z -]{2,40}?)\s*:\s+\S",
    r"(?im)\bthe\s+term\s+[\"']?([A-Za-z][A-Za-z -]{2,40}?)[\"']?\s+(?:is|means|refers)\b",
    r"(?im)\b([A-Za-z][A-Za-z -]{2,40}?)\s+\([A-Z]{2,6}\)",
    r"(?im)\b(?:called|termed|named)\s+(?:a\s+|an\s+|the\s+)?([A-Za-z][A-Za-z-]{2,40})\b",
)
BOLD = r"\*\*(.+?)\*\*|__(.+?)__"


def postings(chunks: DataFrame, id_col: str = "doc_id", max_n: int = 4, only: DataFrame | None = None) -> DataFrame:
    """(<id>, idx, gram, size) of every distinct n-gram of a chunk; made in place, without a shuffle.

    With ``only``, a table of one column, just those n-grams: by their hashes before they become rows, if they are few.
    """
    asked = None if only is None else N.asked_hashes(only)
    rows = N.gram_rows(chunks, id_col, 2, max_n, "long", asked).select(id_col, "idx", "gram", "size")
    return rows if only is None else rows.join(only.toDF("gram").distinct(), "gram", "left_semi").select(id_col, "idx", "gram", "size")


def gram_frequency(chunks: DataFrame, id_col: str = "doc_id", max_n: int = 4, whole: bool = False, parts: int = 64) -> DataFrame:
    """(gram, size, occurrences, chunks, docs): how often and where each n-gram occurs.

    ``whole`` says that the rows of a document follow each other; otherwise the chunks are sorted by document. N-grams are
    added up in ``parts`` groups, each in the memory of one task.
    """
    made = chunks if whole else sorted_by_document(chunks, id_col)
    return N.summed_counts(N.packed_counts(made, id_col, parts, max_n))


def inverted_index(postings_: DataFrame, concepts: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(gram, chunk_ids): the chunks of each n-gram, those that concepts name included, in order."""
    rows = postings_.select("gram", id_col, "idx")
    if concepts is not None:
        named = concepts.select(F.explode("ngrams").alias("g"), id_col, F.explode("chunk_ids").alias("idx"))
        rows = rows.unionByName(named.select(X.normalize(F.col("g")).alias("gram"), id_col, F.col("idx").cast(rows.schema["idx"].dataType)))
    return rows.groupBy("gram").agg(F.array_sort(F.collect_set(F.struct(id_col, "idx"))).alias("chunk_ids"))


def insert(postings_: DataFrame, key: Column, id_: int, idx: int, id_col: str = "doc_id") -> DataFrame:
    """The postings with one n-gram more."""
    row = postings_.sparkSession.range(1).select(
        F.lit(id_).cast(postings_.schema[id_col].dataType).alias(id_col), F.lit(idx).cast("int").alias("idx"),
        X.normalize(key).alias("gram"), F.size(X.split_words(X.normalize(key))).alias("size"),
    )
    return postings_.unionByName(row).distinct()


def table_stats(chunks: DataFrame, id_col: str = "doc_id", load: float = 0.35, whole: bool = False) -> DataFrame:
    """One row per document: n-grams, insertions, table size, load factor, collisions and memory, per set of three tables.

    ``whole`` says that the rows of a document follow each other; otherwise the chunks are sorted by document.

    A collision is an insertion into a slot that another n-gram holds first, in order of chunk and n-gram.
    """
    out = N.table_counts(chunks if whole else sorted_by_document(chunks, id_col), id_col, load)
    return out.select(
        id_col, "unique_ngrams", "total_insertions", "table_size", "used_slots", "collisions",
        (F.col("used_slots") / (F.col("table_size") * 3)).alias("load_factor"),
        (F.col("collisions") / F.greatest(F.col("total_insertions"), F.lit(1)) * 100).alias("collision_rate"),
        (F.col("total_insertions") * 200 + F.col("used_slots") * 64).alias("memory_estimate"),
    )


# ---- terms and concepts


def chunk_terms(chunks: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """(<id>, idx, term, n) of words without noise and of runs of two or three words.

    With ``text_col``, chunks that are tables of contents give only the words that no table names.
    """
    if text_col is None:
        return N.gram_rows(chunks, id_col, 2, 3, "terms").where((F.col("size") == 1) | ~F.col("gram").rlike(X.URL_NOISE)).select(
            id_col, "idx", F.col("gram").alias("term"), "n"
        )
    w = F.col("words")
    single = F.transform(F.filter(w, lambda x: (F.length(x) > 1) & ~X.is_noise(x)), lambda x: x)
    # a run's ends are never noise, so the share of noise in it cannot reach the limit; only the patterns count
    grams = F.filter(F.transform(X.indexable_ngrams(w, 3, unigrams=False), lambda g: g["gram"]), lambda g: ~g.rlike(X.URL_NOISE))
    toc = X.toc_ratio(F.col(text_col)) > 0.5
    marked = chunks.withColumn("__toc", toc)
    per_doc = Window.partitionBy(id_col)
    tokens = F.when(F.col("__toc"), F.filter(X.concept_tokens(F.col(text_col)), lambda x: F.length(x) > 2))
    marked = marked.withColumn("__terms", F.array_distinct(F.flatten(F.collect_list(tokens).over(per_doc))))
    terms = F.when(F.col("__toc"), F.filter(single, lambda x: ~F.array_contains("__terms", x))).otherwise(F.concat(single, grams))
    return marked.select(id_col, "idx", F.explode(terms).alias("term")).groupBy(id_col, "idx", "term").agg(F.count(F.lit(1)).alias("n"))


def term_statistics(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(<id>, term, freq, chunks, chunk_ids): occurrences, and the chunks that have the term, in order."""
    rows = terms.groupBy(id_col, "term").agg(F.sum("n").alias("freq"), F.array_sort(F.collect_set("idx")).alias("chunk_ids"))
    return rows.select(id_col, "term", "freq", F.size("chunk_ids").cast("long").alias("chunks"), "chunk_ids")


def pmi(stats: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``stats`` with the pointwise mutual information of the words of each term, 0 at least; 1 for single words.

    ``totals`` has (<id>, total_chunks). A term of which a word is not counted (noise) has 0.
    """
    base = stats.join(totals.withColumnRenamed(id_col, "__t"), F.col(id_col) == F.col("__t")).drop("__t")
    words = base.where(F.instr("term", " ") > 0).select(id_col, "term", F.explode(F.split("term", " ")).alias("word"))
    single = stats.where(F.instr("term", " ") == 0).select(F.col(id_col).alias("__t"), F.col("term").alias("__w"), F.col("chunks").alias("df"))
    each = words.join(single, (F.col(id_col) == F.col("__t")) & (F.col("word") == F.col("__w")), "left")
    joint = each.groupBy(F.col(id_col).alias("__t"), F.col("term").alias("__w")).agg(
        F.sum(F.ln("df")).alias("logs"), F.count("df").alias("known"), F.count(F.lit(1)).alias("k")
    )
    out = base.join(joint, (F.col(id_col) == F.col("__t")) & (F.col("term") == F.col("__w")), "left").drop("__t", "__w")
    n = F.ln("total_chunks")
    value = (F.ln("freq") - n - (F.col("logs") - F.col("k") * n)) / F.ln(F.lit(2.0))
    score = F.when(F.col("k").isNull(), 1.0).when(F.col("known") < F.col("k"), 0.0).otherwise(F.greatest(value, F.lit(0.0)))
    return out.withColumn("pmi", score).drop("logs", "known", "k")


def marked_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>, term, in_definition, in_heading, in_bold) of terms that the whole text defines, heads or sets in bold."""
    t = F.col(text_col)

    def clean(found):
        tidy = F.transform(F.filter(found, lambda x: (F.length(x) > 2) & ~X.is_url_noise(F.lower(x))), X.normalize_concept)
        return F.filter(tidy, lambda x: (x != "") & ~X.is_url_noise(x))

    defined = clean(F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.trim) for p in DEFINITIONS]))
    bold = clean(F.concat(*[F.regexp_extract_all(t, F.lit(BOLD), F.lit(i)) for i in (1, 2)]))
    tokens = F.transform(X.headings(t), X.concept_tokens)
    heads = F.flatten(F.transform(tokens, lambda w: F.concat(w, F.transform(X.indexable_ngrams(w, 3, unigrams=False), lambda g: g["gram"]))))
    kinds = [F.transform(F.array_distinct(terms), lambda x, k=k: F.struct(x.alias("term"), F.lit(k).alias("kind"))) for k, terms in enumerate((defined, heads, bold))]
    rows = docs.select(id_col, F.inline(F.concat(*kinds)))
    flag = lambda k: F.max(F.col("kind") == k)
    return rows.groupBy(id_col, "term").agg(flag(0).alias("in_definition"), flag(1).alias("in_heading"), flag(2).alias("in_bold"))


def concept_score(min_freq: int = 2) -> Column:
    """The score of a term, from term, freq, chunks, total_chunks, pmi and the three marks; null if it is refused."""
    w = X.split_words(F.col("term"))
    k = F.size(w)
    common = F.size(F.filter(w, X.is_common)) / F.greatest(k, F.lit(1))
    content = F.size(F.filter(w, lambda x: ~X.is_stop(x)))
    f, c = F.col("freq"), F.col("chunks")
    give = lambda cond, points: F.when(cond, F.lit(float(points))).otherwise(0.0)
    s = F.least(3 * F.ln(f + 1), F.lit(20.0)) + F.when(c >= 2, F.least(1.5 * c, F.lit(15.0))).otherwise(0.0)
    s = s + give(k >= 2, 10) + give(k >= 3, 5)
    s = s + give(F.col("in_definition"), 18) + give(F.col("in_heading"), 12) + give(F.col("in_bold"), 10)
    s = s + give(~X.is_common(F.col("term")), 10) + give(F.exists(w, X.is_technical_term), 5) + give(k >= 2, 5)
    s = s - give((k == 1) & X.is_common(F.col("term")), 25) - give((k == 1) & (f > 0.7 * F.col("total_chunks")), 15)
    tight = F.when(F.col("pmi") < 0.5, F.greatest(F.col("pmi"), F.lit(0.2))).when(F.col("pmi") >= 2, F.lit(1.15)).otherwise(1.0)
    s = s * F.when(k >= 2, tight).otherwise(1.0)
    s = s * F.when((k >= 2) & (common >= 0.5), 1 - 0.8 * common).otherwise(1.0)
    s = s * F.when((k >= 2) & (content < 2), F.lit(0.3)).otherwise(1.0)
    enough = (f >= min_freq) | F.col("in_definition") | F.col("in_heading")
    return F.when(enough & (s >= F.when(F.col("in_definition"), 10.0).otherwise(12.0)), s)


def concept_cap(words: Column, unique: Column, chunks: Column) -> Column:
    """How many concepts a document of that length may have, 15 to 150."""
    base = F.greatest(F.lit(15), F.least(F.lit(150), F.floor(words / 1000)))
    base = F.floor(base * F.when(unique > 3000, 1.3).when(unique > 1500, 1.15).otherwise(1.0))
    base = F.floor(base * F.when(chunks > 200, 1.2).when(chunks > 100, 1.1).otherwise(1.0))
    return F.greatest(F.lit(15), F.least(F.lit(150), base)).cast("int")


def concepts(
    docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_freq: int = 2, max_concepts: int = 0,
    chunk_text: str | None = None,
) -> DataFrame:
    """The best concepts of each document, terms that differ only in number or articles being one.

    (<id>, concept_id, label, ngrams, frequency, chunk_ids, score, tags, primary_chunk, in_definition,
    in_heading, in_bold, word_count, rank). Chunks are in order, the first 15 of the first term of a
    concept and all of its others; ``max_concepts`` of 0 or less means as many as the length allows.
    """
    stats = term_statistics(chunk_terms(chunks, id_col, chunk_text), id_col)
    totals = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_chunks"))
    marks = marked_terms(docs, id_col, text_col).withColumnRenamed(id_col, "__m").withColumnRenamed("term", "__term")
    flags = ["in_definition", "in_heading", "in_bold"]
    rows = pmi(stats, totals, id_col).join(marks, (F.col(id_col) == F.col("__m")) & (F.col("term") == F.col("__term")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}).withColumn("score", concept_score(min_freq))
    rows = rows.where(F.col("score").isNotNull() & ~X.is_url_noise(F.col("term"))).withColumn("cleaned", X.normalize_concept(F.col("term")))
    rows = rows.where((F.length("cleaned") >= 2) & ~X.is_concept_noise(F.col("cleaned"))).withColumn("key", X.concept_key(F.col("cleaned")))
    first = F.struct(F.element_at("chunk_ids", 1), F.col("term"))
    merged = rows.groupBy(id_col, "key").agg(
        F.min(F.struct(F.length("cleaned"), first, F.col("cleaned").alias("label")))["label"].alias("label"),
        F.sum("freq").alias("frequency"), F.max("score").alias("score"),
        F.min(F.struct(first, F.slice("chunk_ids", 1, 15).alias("ids")))["ids"].alias("__first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.lit(True), F.col("chunk_ids")))))).alias("__all"),
        F.count(F.lit(1)).alias("__terms"),
        *[F.max(c).alias(c) for c in flags], F.min_by(F.size(F.split("term", " ")), first).alias("word_count"),
    )
    ids = F.when(F.col("__terms") == 1, F.col("__first")).otherwise(F.col("__all"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.desc("frequency"), "key")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    if max_concepts > 0:
        ranked = ranked.where(F.col("rank") <= max_concepts)
    else:
        w = X.split_words(F.col(text_col))
        caps = docs.select(F.col(id_col).alias("__c"), F.size(w).alias("w"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("u"))
        caps = caps.join(totals.withColumnRenamed(id_col, "__t"), F.col("__c") == F.col("__t")).select(
            "__c", concept_cap(F.col("w"), F.col("u"), F.col("total_chunks")).alias("cap")
        )
        ranked = ranked.join(caps, F.col(id_col) == F.col("__c")).where(F.col("rank") <= F.col("cap"))
    tags = F.filter(F.array(*[F.when(F.col(c), F.lit(t)) for c, t in zip(flags, "DHB")]), lambda x: x.isNotNull())
    return ranked.select(
        id_col, F.col("key").alias("concept_id"), "label", F.concat(F.array("label"), F.split("label", " ")).alias("ngrams"),
        "frequency", ids.alias("chunk_ids"), "score", tags.alias("tags"), F.element_at(F.col("__first"), 1).alias("primary_chunk"),
        *flags, "word_count", "rank",
    )


def merge_concepts(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Concepts of an index and of what is added, by label: frequencies summed, best score, 15 chunks at most."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    rest = [c for c in old.columns if c not in (id_col, "label", "frequency", "score", "chunk_ids")]
    out = both.groupBy(id_col, "label").agg(
        F.sum("frequency").alias("frequency"), F.max("score").alias("score"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))), 1, 15).alias("chunk_ids"),
        *[F.min_by(c, "__o").alias(c) for c in rest],
    )
    return out.select(*old.columns)


# ---- graph


def gathered(concepts_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(<id>, labels, chunk_ids): the concepts (<id>, label, chunk_ids) of each document in one row; no row for a null id."""
    if "labels" in concepts_.columns:
        return concepts_.where(F.col(id_col).isNotNull())
    rows = concepts_.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct("label", "chunk_ids")).alias("c"))
    return rows.select(id_col, F.col("c.label").alias("labels"), F.col("c.chunk_ids").alias("chunk_ids"))


class DocumentGraph:
    """The concepts of one document in order of their names, and the number of chunks that each two share."""

    def __init__(self, labels: list[str], chunk_ids: list) -> None:
        order = sorted(range(len(labels)), key=labels.__getitem__)
        self.labels = [labels[i] for i in order]
        of, spots = [], []
        for i, at in enumerate(order):
            own = {c for c in chunk_ids[at] or () if c is not None}
            of += [i] * len(own)
            spots += own
        names, place = np.unique(np.array(spots, np.int64), return_inverse=True)
        has = np.zeros((len(order), len(names)), np.float32)
        has[of, place] = 1
        self.shared = (has @ has.T).astype(np.int64)

    def edges(self) -> Iterator[tuple[int, int, int]]:
        i, j = np.nonzero(np.triu(self.shared, 1))
        return zip(i.tolist(), j.tolist(), self.shared[i, j].tolist())

    def hierarchy(self) -> list[tuple[int, int]]:
        """(general, special): the special one's chunks are part of the other's, and one's words are among the other's."""
        n = self.shared.diagonal()
        some = np.triu((self.shared == np.minimum(n, n[:, None])) & (n != n[:, None]) & (self.shared > 0), 1)
        i, j = np.nonzero(some)
        if not len(i):
            return []
        w = [frozenset(x.lower().split()) for x in self.labels]
        return [(a, b) if n[a] > n[b] else (b, a) for a, b in zip(i.tolist(), j.tolist()) if w[a] <= w[b] or w[b] <= w[a]]


def per_document(concepts_: DataFrame, rows, columns: dict[str, pa.DataType], id_col: str = "doc_id") -> DataFrame:
    """(<id>, ...) of ``rows(graph)``, tuples of ``columns``, for the :class:`DocumentGraph` of each document, in place."""
    lists = gathered(concepts_, id_col).select(id_col, "labels", "chunk_ids")
    schema = T.StructType([lists.schema[id_col], *[T.StructField(c, from_arrow_type(t)) for c, t in columns.items()]])

    def emit(batches):
        for batch in (part for whole in batches for part in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500))):
            at, out = [], []
            for i, (labels, chunks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = rows(DocumentGraph(labels, chunks))
                out += found
                at += [i] * len(found)
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=[id_col, *columns])

    return lists.mapInArrow(emit, schema)


EDGE = {"source": pa.string(), "target": pa.string()}


def cooccurrence(concepts_: DataFrame, id_col: str = "doc_id", full_weight: int = 5) -> DataFrame:
    """(<id>, source, target, shared, weight): pairs of concepts of a document with a chunk in common."""
    def rows(g):
        return [(g.labels[i], g.labels[j], n, min(n / full_weight, 1.0)) for i, j, n in g.edges()]

    return per_document(concepts_, rows, EDGE | {"shared": pa.int64(), "weight": pa.float64()}, id_col)


def hierarchy(concepts_: DataFrame, id_col: str = "doc_id", weight: float = 0.8) -> DataFrame:
    """(<id>, source, target, weight): a general concept and one whose chunks are part of its own.

    One's words must be among the other's. By counts of shared chunks, so only pairs that share one are met.
    """
    def rows(g):
        return [(g.labels[i], g.labels[j], weight) for i, j in g.hierarchy()]

    return per_document(concepts_, rows, EDGE | {"weight": pa.float64()}, id_col)


def graph(concepts_: DataFrame, id_col: str = "doc_id", full_weight: int = 5, weight: float = 0.8) -> DataFrame:
    """(<id>, source, target, weight, edge_type); a hierarchical edge stands beside the one by chunks."""
    def rows(g):
        near = [(g.labels[i], g.labels[j], min(n / full_weight, 1.0), "co_occurrence") for i, j, n in g.edges()]
        return near + [(g.labels[i], g.labels[j], weight, "hierarchical") for i, j in g.hierarchy()]

    return per_document(concepts_, rows, EDGE | {"weight": pa.float64(), "edge_type": pa.string()}, id_col)


def document_related(concepts_: DataFrame, max_depth: int = 2, id_col: str = "doc_id") -> DataFrame:
    """As :func:`related`, from the first concept by name of each document, without a shuffle of edges."""
    def rows(g):
        near = g.shared > 0
        now = seen = np.arange(len(g.labels)) == 0
        out = []
        for step in range(1, max_depth + 1):
            now = near[now].any(0) & ~seen
            seen = seen | now
            out += [(g.labels[0], g.labels[i], step) for i in np.flatnonzero(now).tolist()]
        return out

    return per_document(concepts_, rows, {"term": pa.string(), "other": pa.string(), "depth": pa.int32()}, id_col)


def document_impact(concepts_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As :func:`impact` of :func:`graph`, without a shuffle of edges."""
    def rows(g):
        near = (g.shared > 0).sum(1) - (g.shared.diagonal() > 0)
        up = g.hierarchy()
        down, into = (np.bincount([e[k] for e in up], minlength=len(near)) if up else np.zeros(len(near), np.int64) for k in (0, 1))
        return [(g.labels[i], int(near[i]), int(down[i]), int(into[i]), 2.0 * int(down[i]) + 0.5 * int(near[i])) for i in np.flatnonzero(near).tolist()]

    counts = {c: pa.int64() for c in ("neighbours", "dependents", "prerequisites")}
    return per_document(concepts_, rows, {"term": pa.string()} | counts | {"impact": pa.float64()}, id_col)


def neighbours(edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(<id>, term, other, weight) both ways; a hierarchical weight replaces the other."""
    both = edges.select(id_col, F.col("source").alias("term"), F.col("target").alias("other"), "weight", "edge_type").unionByName(
        edges.select(id_col, F.col("target").alias("term"), F.col("source").alias("other"), "weight", "edge_type")
    )
    return both.groupBy(id_col, "term", "other").agg(F.max_by("weight", F.struct(F.col("edge_type") == "hierarchical", "weight")).alias("weight"))


def related(edges: DataFrame, start: DataFrame, max_depth: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(<id>, term, other, depth): what can be reached from the terms of ``start`` (<id>, term) in that many steps.

    A join for each step, whose number is ``max_depth``; order results by depth, weight and name.
    """
    links = neighbours(edges, id_col).select(F.col(id_col).alias("d"), F.col("term").alias("t"), F.col("other").alias("o"))
    seen = start.select(id_col, "term", F.col("term").alias("other"), F.lit(0).alias("depth"))
    level = seen
    for step in range(1, max_depth + 1):
        level = level.join(links, (F.col(id_col) == F.col("d")) & (F.col("other") == F.col("t"))).select(
            id_col, "term", F.col("o").alias("other"), F.lit(step).alias("depth")
        ).distinct()
        seen = seen.unionByName(level)
    return seen.groupBy(id_col, "term", "other").agg(F.min("depth").alias("depth")).where("depth > 0")


def impact(edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(<id>, term, prerequisites, dependents, neighbours, impact): 2 for each dependent, 0.5 for each neighbour."""
    near = neighbours(edges, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("neighbours"))
    up = edges.where("edge_type = 'hierarchical'")
    out = up.groupBy(id_col, F.col("source").alias("term")).agg(F.countDistinct("target").alias("dependents"))
    into = up.groupBy(id_col, F.col("target").alias("term")).agg(F.countDistinct("source").alias("prerequisites"))
    joined = reduce(lambda a, b: a.join(b, [id_col, "term"], "left"), (out, into), near).na.fill(0, ["dependents", "prerequisites"])
    return joined.withColumn("impact", 2.0 * F.col("dependents") + 0.5 * F.col("neighbours"))


def detect_definitions(text: Column) -> Column:
    """All terms that a text defines, as written."""
    return F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.trim) for p in DEFINITIONS]))


def top_concepts(concepts_: DataFrame, n: int = 20, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.desc("frequency"), "concept_id")
    return concepts_.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")

