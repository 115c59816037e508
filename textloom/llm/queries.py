"""The operators of this subpackage as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat_template, class_lm, embed_dedup, exact_dedup, langid, line_dedup, ngram_join, packing, quality
from textloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select("doc_id", "quality_score", "keep")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return class_lm.score(docs, class_lm.train(docs))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_template.format_chats(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.format_string("%d:%d", s["start"], s["end"])), ",")
    return chats.select("conv_id", "text", spans.alias("spans"), "n_turns")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary, verify=True)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs), columns=["doc_id"])


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_classes_lower_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, at a cosine that pairs in the small tables reach, with small k and so few tables for a high recall."""
    return embed_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.4, recall=0.99999, crowd=64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    order = sorted(own, key=lambda k: int(k[2:].split("_")[0]))
    return {k: own[k] for k in order} | {"embedding_classes_lower_cosine": embedding_classes_lower_cosine} | {"pipeline": corpus_pipeline.run}


SQL = {
    "op1_line_dedup": """
        WITH line AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM documents),
        full_line AS (
          SELECT doc_id, line, pos, trim(line) AS t,
                 lead(trim(line)) OVER w AS t2, lead(pos) OVER w AS pos2
          FROM line WHERE trim(line) <> ''
          WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        pair AS (
          SELECT doc_id, pos, pos2, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, pos) AS nth
          FROM full_line WHERE t2 IS NOT NULL),
        long_line AS (
          SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS nth
          FROM full_line WHERE length(line) - length(replace(line, ' ', '')) >= 49),
        gone AS (
          SELECT doc_id, pos FROM pair WHERE nth > 1
          UNION SELECT doc_id, pos2 FROM pair WHERE nth > 1
          UNION SELECT doc_id, pos FROM long_line WHERE nth > 1),
        kept AS (
          SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
                 CAST(count(g.pos) AS INT) AS removed_lines
          FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(k.text, '') AS text, d.lang, d.source, d.n_chars, k.removed_lines
        FROM documents d JOIN kept k ON d.doc_id = k.doc_id""",
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM documents),
        g AS (
          SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END)) AS grams
          FROM w WHERE len(words) > 0),
        gram AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
        link AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM gram a JOIN gram b ON a.gram = b.gram AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5),
        reach AS (
          SELECT a, a AS b FROM link UNION
          SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS links
        FROM documents d LEFT JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON d.doc_id = c.a
        LEFT JOIN (SELECT a, count(*) AS links FROM link GROUP BY a) k ON d.doc_id = k.a""",
    "op3_chat_format": """
        WITH piece AS (
          SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body
          FROM conversations),
        placed AS (
          SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
                   PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + length(head) AS spot
          FROM piece)
        SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY turn) AS text,
               coalesce(string_agg(CAST(CAST(spot AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(spot + length(body) AS BIGINT) AS VARCHAR), ','
                 ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS spans,
               CAST(count(*) AS INT) AS n_turns
        FROM placed GROUP BY conv_id""",
    "op6_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM (
          SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
        WHERE nth = 1""",
}


EMBEDDING_CLASSES = """
        WITH RECURSIVE link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {}),
        reach AS (
          SELECT a, a AS b FROM link UNION
          SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT e.vec_id, coalesce(c.class_id, e.vec_id) AS class_id, coalesce(k.links, 0) AS links
        FROM embeddings e LEFT JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON e.vec_id = c.a
        LEFT JOIN (SELECT a, count(*) AS links FROM link GROUP BY a) k ON e.vec_id = k.a"""
SQL["op10_embedding_near_dedup"] = EMBEDDING_CLASSES.format(0.95)
SQL["embedding_classes_lower_cosine"] = EMBEDDING_CLASSES.format(0.4)


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
