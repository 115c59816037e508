"""Prompts from results, grounding of answers in their sources, and language models as pluggable callables."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X

SYSTEM = "Answer from the sources below only. Say so if they do not hold the answer, and name the sources that you use."
TASKS = {
    "recall": "Ask for one fact that stands in the sources.",
    "understanding": "Ask for an explanation, in own words, that combines what the sources say.",
    "application": "Ask what follows from the sources in a new situation.",
}
UNCERTAIN = (
    "not in the provided", "not covered in", "not mentioned in", "i don't have", "cannot be determined", "the source does not",
    "the documents do not", "this information is not", "based on the provided", "according to the source",
)
PROMPT_CHARS = 120_000
CUT_MARK = "\n\n[cut]"


def source_header(rank: Column, score: Column, section: Column, page: Column) -> Column:
    return F.concat_ws(
        " ", F.format_string("[%d]", rank), F.when(score > 0, F.format_string("(relevance: %.2f)", score)),
        F.when(section != "", F.concat(F.lit("section: "), section)), F.when(page > 0, F.format_string("page: %d", page)),
    )


def sources(results: DataFrame, chunks: DataFrame, id_col: str = "doc_id", full_header: bool = True) -> DataFrame:
    """(query_id, sources, n): the texts of the results of each query, in order, under headers."""
    have = {c: F.col(c) if c in chunks.columns else F.lit(v).alias(c) for c, v in (("section", ""), ("page", 0))}
    rows = results.select("query_id", id_col, "idx", "rank", "score").join(chunks.select(id_col, "idx", "text", *have.values()), [id_col, "idx"])
    rank = F.col("rank").cast("int")
    head = source_header(rank, F.col("score"), F.col("section"), F.col("page")) if full_header else F.format_string("[%d]", rank)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.lit("\n" if full_header else " "), F.col("text")).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("sources"), F.count(F.lit(1)).alias("n"))


def shorten(prompt: Column, limit: int = PROMPT_CHARS) -> Column:
    return F.when(F.length(prompt) > limit, F.concat(F.substring(prompt, 1, limit), F.lit(CUT_MARK))).otherwise(prompt)


def rag_prompt(questions: DataFrame, found: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(query_id, prompt) for questions (query_id, query) and :func:`sources`; those without sources are told so."""
    rows = questions.select("query_id", "query").join(found, "query_id", "left")
    text = F.concat_ws("\n\n", F.lit(system), F.lit("SOURCES"), F.coalesce("sources", F.lit("[none found]")), F.lit("---"), F.concat(F.lit("QUESTION: "), F.coalesce("query", F.lit(""))), F.lit("ANSWER:"))
    return rows.select("query_id", shorten(text).alias("prompt"))


def no_context_prompt(query: Column) -> Column:
    return F.concat(F.lit("No source text was found for the question below. Answer only that the given documents do not cover it.\n\nQUESTION: "), query)


def evaluation_prompt(question: Column, answer: Column, source_text: Column) -> Column:
    return F.concat_ws(
        "\n\n", F.lit("Compare the answer with the sources."), F.lit("SOURCES"), source_text, F.lit("---"), F.concat(F.lit("QUESTION: "), question),
        F.concat(F.lit("ANSWER: "), answer), F.lit("List under CORRECT, MISSED, UNVERIFIABLE and FEEDBACK."),
    )


def question_prompt(concept: Column, source_text: Column, difficulty: str = "understanding") -> Column:
    return F.concat_ws(
        "\n\n", F.lit("Write one question about the concept, from the sources only."), F.concat(F.lit("CONCEPT: "), concept),
        F.lit(f"DIFFICULTY: {difficulty}\n{TASKS.get(difficulty, TASKS['understanding'])}"), F.lit("SOURCES"), source_text, F.lit("---"),
        F.lit("Give QUESTION, EXPECTED ANSWER and SOURCE REFERENCE."),
    )


def summary_prompt(source_text: Column, max_words: int | None = None) -> Column:
    limit = [F.lit(f"Use fewer than {max_words} words.")] if max_words else []
    return F.concat_ws("\n\n", F.lit("Summarise the sources and add nothing."), *limit, F.lit("SOURCES"), source_text, F.lit("---"), F.lit("SUMMARY:"))


# ---- evaluation


def _words(text: Column) -> Column:
    return F.array_distinct(X.tokenize_simple(text))


def _sentences(text: Column) -> Column:
    return X.drop_empty(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), F.trim))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def has_uncertainty(text: Column) -> Column:
    return F.lower(text).rlike("|".join(p.replace(".", r"\.") for p in UNCERTAIN))


def evaluate(rows: DataFrame, response: str = "response", source: str = "source") -> DataFrame:
    """``rows`` with grounding_score, source_coverage, hallucination_flags, is_grounded, has_uncertainty_language,
    sentence_count, grounded_sentences.

    A sentence is grounded if 30 % of its words are in the source; one of more than five words that is not
    is flagged, ten at most. The coverage is the share of source sentences of which over 20 % of the words
    are in the response. Null or empty responses and sources score 0.
    """
    r, s = F.coalesce(F.col(response), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    have = (F.trim(r) != "") & (F.trim(s) != "")
    out = rows.withColumn("__rw", _words(r)).withColumn("__sw", _words(s))
    each = F.transform(_sentences(r), lambda t: F.struct(t.alias("t"), _words(t).alias("w")))
    out = out.withColumn("__each", F.when(have, each))
    good = F.size(F.filter("__each", lambda x: (F.size(x["w"]) > 0) & (_overlap(x["w"], F.col("__sw")) >= 0.3)))
    bad = F.filter("__each", lambda x: (F.size(x["w"]) > 5) & (_overlap(x["w"], F.col("__sw")) < 0.3))
    theirs = F.transform(_sentences(s), _words)
    covered = F.size(F.filter(theirs, lambda w: (F.size(w) > 0) & (_overlap(w, F.col("__rw")) > 0.2))) / F.greatest(F.size(theirs), F.lit(1))
    n = F.size("__each")
    score = F.when(have, good / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "grounding_score": F.round(score, 3), "source_coverage": F.when(have, F.round(covered, 3)).otherwise(F.lit(0.0)),
            "hallucination_flags": F.coalesce(F.slice(F.transform(bad, lambda x: x["t"]), 1, 10), F.array().cast("array<string>")),
            "is_grounded": have & (score >= 0.5), "has_uncertainty_language": has_uncertainty(r),
            "sentence_count": F.coalesce(F.when(have, n), F.lit(0)), "grounded_sentences": F.coalesce(F.when(have, good), F.lit(0)),
        }
    )
    return out.drop("__rw", "__sw", "__each")


def confidence(results: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, confidence): the mean score, less if there are fewer than k results."""
    value = F.avg("score") * F.least(F.count(F.lit(1)) / max(k, 1), F.lit(1.0))
    return results.groupBy("query_id").agg(F.round(F.least(value, F.lit(1.0)), 3).alias("confidence"))


def claim_support(claims: DataFrame, results: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, <id>, idx, overlap, words, supports): how much of a claim (query_id, claim) each result has."""
    rows = results.select("query_id", id_col, "idx").join(claims, "query_id").join(chunks.select(id_col, "idx", "text"), [id_col, "idx"])
    rows = rows.withColumn("__c", _words(F.col("claim"))).withColumn("__t", _words(F.col("text"))).where(F.size("__c") > 0)
    share = _overlap(F.col("__c"), F.col("__t"))
    return rows.select("query_id", id_col, "idx", F.round(share, 3).alias("overlap"), F.size(F.array_intersect("__c", "__t")).alias("words"), (share > 0.2).alias("supports"))


# ---- language models

Backend = Callable[[str], str]
KEYS = {"deepseek": "DEEPSEEK_API_KEY", "openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}
_BACKENDS: dict[str, Callable[..., Backend]] = {}


def register_backend(name: str, make: Callable[..., Backend]) -> None:
    """Add a language model: ``make(config)`` gives a function from prompt to answer."""
    _BACKENDS[name.lower()] = make


def backends() -> list[str]:
    return sorted(_BACKENDS)


def create_backend(name: str, config=None) -> Backend:
    if name.lower() not in _BACKENDS:
        raise ValueError(f"unknown language model {name!r}; known: {', '.join(backends())}")
    return _BACKENDS[name.lower()](config)


def best_available(order: tuple = ("deepseek", "openai", "anthropic", "ollama")) -> str | None:
    """The first of the names for which a key is set; a local server needs none."""
    return next((n for n in order if n in _BACKENDS and (n not in KEYS or os.environ.get(KEYS[n]))), None)


def http_backend(url: str, body: Callable[[str], dict], read: Callable[[dict], str], headers: dict | None = None, send: Callable | None = None) -> Backend:
    """A model behind HTTP; ``send`` (url, headers, body) -> dict can replace the transport."""
    def post(address, head, data):
        import urllib.request

        request = urllib.request.Request(address, json.dumps(data).encode(), {"Content-Type": "application/json"} | head)
        with urllib.request.urlopen(request, timeout=120) as reply:
            return json.loads(reply.read())

    return lambda prompt: read((send or post)(url, headers or {}, body(prompt)))


def _chat(default_url: str, default_model: str, key_name: str | None):
    def make(config):
        key = getattr(config, "llm_api_key", None) or (os.environ.get(key_name) if key_name else None)
        model = getattr(config, "llm_model", None) or default_model
        base = getattr(config, "llm_base_url", None) or default_url
        extra = {"temperature": getattr(config, "llm_temperature", 0.3), "max_tokens": getattr(config, "llm_max_tokens", 2048)}
        turn = lambda p: {"model": model, "messages": [{"role": "user", "content": p}], **extra}
        if key_name == KEYS["anthropic"]:
            return http_backend(f"{base}/v1/messages", turn, lambda r: r["content"][0]["text"], {"x-api-key": key or "", "anthropic-version": "2023-06-01"})
        if key_name is None:
            return http_backend(f"{base}/api/generate", lambda p: {"model": model, "prompt": p, "stream": False}, lambda r: r["response"])
        return http_backend(f"{base}/v1/chat/completions", turn, lambda r: r["choices"][0]["message"]["content"], {"Authorization": f"Bearer {key}"})

    return make


register_backend("deepseek", _chat("https://api.deepseek.com", "deepseek-chat", KEYS["deepseek"]))
register_backend("openai", _chat("https://api.openai.com", "gpt-4o-mini", KEYS["openai"]))
register_backend("anthropic", _chat("https://api.anthropic.com", "claude-3-5-haiku-latest", KEYS["anthropic"]))
register_backend("ollama", _chat("http://localhost:11434", "llama3", None))


def generate(prompts: DataFrame, backend: Backend, prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with the column ``answer``, from calls on the executors; null where a call fails."""
    def run(frames):
        for frame in frames:
            answers = []
            for prompt in frame[prompt_col]:
                try:
                    answers.append(backend(prompt))
                except (OSError, KeyError, IndexError, ValueError):
                    answers.append(None)
            frame["answer"] = answers
            yield frame

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())]))
