"""Chunking: documents to passages.

Greedy packing carries state from sentence to sentence, so a chunker is a Python function from one text to
its passages, run over Arrow batches without a shuffle; fixed-size chunks and the overlap with the chunk
before are plain DataFrame operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.constants import EXTENSION_LANGUAGE
from textloom.functions import text as X

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\d])")
LOOSE = re.compile(r"(?<=[.!?;])\s+")
HEADING = re.compile(
    r"^#{1,6}[^\S\n]+(?P<md>.+)$|^[^\S\n]*(?:\d+(?:\.\d+){0,2}\.?)[^\S\n]+(?P<num>[A-Z][^\n]{3,60})$"
    r"|^[^\S\n]*(?:Chapter|Section|Part|Lesson)[^\S\n]+\d+[.:][^\S\n]*(?P<named>.+)$|^[^\S\n]*(?P<caps>[A-Z][A-Z ]{3,60})[^\S\n]*$",
    re.M,
)
PAGE_BREAK = re.compile(
    r"\f|(?:^|\n)[^\S\n]*(?:page|p\.?)[^\S\n]*\d+[^\S\n]*(?:of[^\S\n]*\d+)?[^\S\n]*(?:\n|$)|(?:^|\n)[^\S\n]*\d+[^\S\n]*/[^\S\n]*\d+[^\S\n]*(?:\n|$)", re.I
)
PARENS = r"\([^)]*\)"
NAMED = r"(?P<name>[A-Za-z_]\w*)"
BLOCKS: dict[str, list[tuple[str, str]]] = {
    "python": [("class", rf"^class\s+{NAMED}\s*(?:{PARENS})?\s*:"), ("function", rf"^(?:async\s+)?def\s+{NAMED}\s*{PARENS}[^:\n]*:")],
    "javascript": [
        ("class", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAMED}"),
        ("interface", rf"^(?:export\s+)?interface\s+{NAMED}"),
        ("enum", rf"^(?:export\s+)?enum\s+{NAMED}"),
        ("type", rf"^(?:export\s+)?type\s+{NAMED}"),
        ("function", rf"^(?:export\s+)?(?:async\s+)?function\s*\*?\s*{NAMED}\s*\("),
    ],
    "go": [("function", rf"^func\s+(?:{PARENS}\s+)?{NAMED}\s*\("), ("struct", rf"^type\s+{NAMED}\s+struct\b")],
    "rust": [
        ("struct", rf"^(?:pub\s+)?struct\s+{NAMED}"),
        ("enum", rf"^(?:pub\s+)?enum\s+{NAMED}"),
        ("function", rf"^(?:pub\s+)?(?:async\s+)?fn\s+{NAMED}"),
    ],
    "ruby": [("definition", r"^\s*(?:def|class|module)\s+(?P<name>\w[\w!?]*)")],
    "c": [
        ("struct", rf"^(?:typedef\s+)?struct\s+{NAMED}"),
        ("enum", rf"^enum\s+{NAMED}"),
        ("function", rf"^[A-Za-z_][\w\s*]*?\b{NAMED}\s*{PARENS}\s*\{{"),
    ],
    "java": [
        ("class", rf"^(?:(?:public|private|protected|static|abstract|final|data|sealed|open)\s+)*class\s+{NAMED}"),
        ("interface", rf"^(?:(?:public|private|protected)\s+)*(?:interface|trait|protocol)\s+{NAMED}"),
        ("enum", rf"^(?:(?:public|private|protected)\s+)*enum\s+{NAMED}"),
    ],
    "css": [("at-rule", r"^@(?P<name>media|keyframes|font-face|supports|layer)\b[^{]*\{"), ("rule", r"^(?P<name>[.#]?\w[\w\s.,:>+~#\[\]=]*?)\s*\{")],
    "sql": [
        ("definition", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|INDEX|FUNCTION|PROCEDURE|TRIGGER|SCHEMA|DATABASE)\s+(?P<name>[\w.]+)"),
        ("alteration", r"(?i)^ALTER\s+TABLE\s+(?P<name>[\w.]+)"),
        ("insert", r"(?i)^INSERT\s+INTO\s+(?P<name>[\w.]+)"),
        ("select", r"(?i)^SELECT\b.*?\bFROM\s+(?P<name>[\w.]+)"),
    ],
}
SAME_BLOCKS = {"typescript": "javascript", "vue": "javascript", "svelte": "javascript", "cpp": "c", "csharp": "java", "kotlin": "java"}
SAME_BLOCKS |= {"scala": "java", "swift": "java", "scss": "css"}
IMPORTS = re.compile(r"^\s*(?:import\b.*|from\s+\S+\s+import\b.*|#include\b.*|using\s+[\w.:]+;|use\s+[\w:{}, *]+;|require\b.*|package\s+[\w.]+;?)$", re.M)


def words(text: str) -> int:
    return len(text.split())


def split_sentences(text: str) -> list[str]:
    """As :func:`textloom.functions.text.base_sentences`, for one text."""
    flat = " ".join(text.split())
    parts = SENTENCE.split(flat)
    if len(parts) <= 1:
        parts = LOOSE.split(flat)
    return [p.strip() for p in parts if p.strip()]


GUARDED = re.compile(r"((?:https?://|[^\s@]+@[^\s@]+\.)\S*|\.{3,})([.!?]?)(\s)", re.A)
BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z\d])", re.A)


def merge_sentences(flat: str, min_words: int = 8) -> list[str]:
    """As :func:`textloom.functions.text.sentences`, for one text whose white space is single blanks; in one pass."""
    out: list[list[str]] = []
    count = 0
    for part in BREAK.split(GUARDED.sub("\\1\\2\u0001\\3", flat)):
        part = part.replace("\u0001", "").strip(" ")
        if part:
            n = sum(1 for w in part.split(" ") if w)
            if out and count < min_words:
                out[-1].append(part)
                count += n
            else:
                out.append([part])
                count = n
    return [" ".join(parts) for parts in out]


def merged_sentences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 8) -> DataFrame:
    """(<id>, pos, sentence) of the sentences of each text, short ones merged into what follows."""
    schema = T.StructType([docs.schema[id_col], T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType())])

    def emit(batches):
        for batch in (part for whole in batches for part in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500))):
            found = [merge_sentences(t, min_words) if t else [] for t in batch.column(1).to_pylist()]
            at = [i for i, parts in enumerate(found) for _ in parts]
            pos = [i for parts in found for i in range(len(parts))]
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array([s for parts in found for s in parts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, X.squeeze(F.col(text_col)).alias("text")).mapInArrow(emit, schema)


def windows(text: str, size: int) -> list[str]:
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def packed(parts, limit: int, least: int, keep_small: bool = False) -> Iterator[str]:
    """Consecutive parts joined up to ``limit`` words; results under ``least`` words are dropped.

    With ``keep_small`` they are appended to the result before instead, if there is one.
    """
    done: str | None = None
    held, size = [], 0

    def close():
        nonlocal done
        out = None
        if held and size >= least:
            out, done = done, " ".join(held)
        elif held and keep_small:
            done = " ".join(([done] if done else []) + held)
        return out

    for part in parts:
        n = words(part)
        if held and size + n > limit:
            out = close()
            if out is not None:
                yield out
            held, size = [], 0
        held.append(part)
        size += n
    out = close()
    if out is not None:
        yield out
    if done is not None:
        yield done


def pieces(parts, limit: int) -> Iterator[str]:
    """The parts, those over ``limit`` words cut to windows of ten words less."""
    for part in parts:
        if words(part) > limit:
            yield from windows(part, limit - 10)
        else:
            yield part


def sections(text: str, least: int) -> Iterator[tuple[str, str]]:
    """(heading, body) of each section; a preamble of ``least`` words or more has no heading.

    The body of a section begins with its heading's line, without Markdown marks; a heading in capitals
    is left out of the body.
    """
    found = list(HEADING.finditer(text))
    if not found:
        yield "", text
        return
    head = text[: found[0].start()].strip()
    if found[0].start() > 10 and words(head) >= least:
        yield "", head
    for m, after in zip(found, [*found[1:], None]):
        body = text[m.start() : after.start() if after else len(text)].strip()
        label = m[m.lastgroup].strip()
        if m.lastgroup == "caps":
            body = body[len(label) :]
        body = body.lstrip("#").strip()
        if body:
            yield label, body


Passage = tuple[str, str, int]  # text, section, page


def recursive(text: str, c) -> Iterator[Passage]:
    """Sections at headings; in each, paragraphs packed to ``max_chunk_words``, long ones by sentences."""
    tidy = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()
    for label, body in sections(tidy, c.min_chunk_words):
        def parts():
            for paragraph in re.split(r"\n\s*\n", body):
                flat = " ".join(paragraph.split())
                n = words(flat)
                if n >= 3:
                    yield from [flat] if n <= c.max_chunk_words else pieces(split_sentences(flat), c.max_chunk_words)

        for out in packed(parts(), c.max_chunk_words, c.min_chunk_words, c.merge_small_chunks):
            yield out, label, 0


def hierarchical(text: str, c) -> Iterator[Passage]:
    """Small chunks, with the large chunk that holds them as section, and then the large chunks."""
    small = list(packed(pieces(split_sentences(text), c.hierarchical_small), c.hierarchical_small, c.min_chunk_words, c.merge_small_chunks))
    large, size, parent = [[]], 0, []
    for part in small:
        n = words(part)
        if large[-1] and size + n > c.hierarchical_large:
            large.append([])
            size = 0
        large[-1].append(part)
        size += n
        parent.append(len(large) - 1)
    for part, k in zip(small, parent):
        yield part, f"parent:large_{k}", 0
    for k, group in enumerate(large):
        if group:
            yield " ".join(group), f"large_{k}", 0


def sentence_vectors(parts: list[str]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of sentences, with the sentences of the text as corpus."""
    counts = [Counter(t for t in re.sub(r"[^\w\s]|_", " ", p.lower()).split() if len(t) > 1) for p in parts]
    df = Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        v = {t: n * (math.log((len(parts) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({t: x / norm for t, x in v.items()})
    return out


def semantic(text: str, c) -> Iterator[Passage]:
    """Cuts between neighbouring sentences less alike than the share ``semantic_threshold`` of all such pairs."""
    parts = split_sentences(text)
    if len(parts) < 2:
        yield from ((p, "", 0) for p in parts)
        return
    vectors = sentence_vectors(parts)
    alike = [sum(x * b.get(t, 0.0) for t, x in a.items()) for a, b in zip(vectors, vectors[1:])]
    level = sorted(alike)[max(0, min(int(len(alike) * c.semantic_threshold), len(alike) - 1))]
    segments, now = [], [parts[0]]
    for part, near in zip(parts[1:], alike):
        if near < level:
            segments.append(now)
            now = []
        now.append(part)
    segments.append(now)
    last = None
    for segment in segments:
        joined, n = " ".join(segment), sum(map(words, segment))
        if n > c.max_chunk_words:
            if last is not None:
                yield last, "", 0
            last = None
            for part in packed(segment, c.max_chunk_words, c.min_chunk_words, c.merge_small_chunks):
                if last is not None:
                    yield last, "", 0
                last = part
        elif n < c.min_chunk_words and last is not None and words(last) + n <= c.max_chunk_words:
            last = f"{last} {joined}"
        else:
            if last is not None:
                yield last, "", 0
            last = joined
    if last is not None:
        yield last, "", 0


def page(text: str, c) -> Iterator[Passage]:
    """Pages at form feeds and page numbers; short ones join the page before, long ones are cut."""
    last: tuple[str, int] | None = None
    for number, part in enumerate(PAGE_BREAK.split(text), 1):
        flat = " ".join(part.split())
        n = words(flat)
        if not flat:
            continue
        if last and n < c.min_chunk_words and words(last[0]) + n <= 2 * c.max_chunk_words:
            last = f"{last[0]}\n\n{flat}", last[1]
            continue
        for piece in [flat] if n <= c.max_chunk_words else packed(split_sentences(flat), c.max_chunk_words, c.min_chunk_words):
            if last:
                yield last[0], "", last[1]
            last = piece, number
    if last:
        yield last[0], "", last[1]


def code(text: str, c, language: str = "unknown", max_lines: int = 150) -> Iterator[Passage]:
    """Imports, then a chunk for each block of the language, long ones cut by lines; else packed lines."""
    language = SAME_BLOCKS.get(language, language)
    kinds = BLOCKS.get(language) or [*BLOCKS["python"], *BLOCKS["javascript"], *BLOCKS["rust"][2:], *BLOCKS["go"][:1]]
    found = sorted(
        (m.start(), m.end(), kind, m["name"]) for kind, pattern in kinds for m in re.finditer(pattern, text, re.M)
    )
    starts = [f for i, f in enumerate(found) if not i or f[0] > found[i - 1][0]]

    def by_lines(block: str):
        held, n = [], 0
        for line in block.split("\n"):
            if held and (n + words(line) > c.max_chunk_words or len(held) >= max_lines):
                yield "\n".join(held)
                held, n = [], 0
            held.append(line)
            n += words(line)
        yield "\n".join(held)

    if not starts:
        for part in by_lines(text):
            if words(part) >= c.min_chunk_words or part == text and part.strip():
                yield part.strip("\n"), "", 0
        return
    imports = "\n".join(m[0].strip() for m in IMPORTS.finditer(text))
    names = ", ".join(f"{kind} {name}" for _, _, kind, name in starts)
    head = "\n\n".join(x for x in (f"{language} code: {names}", imports) if x)
    if words(head) >= 5:
        yield head, "header", 0
    for (a, _, kind, name), after in zip(starts, [*starts[1:], None]):
        block = text[a : after[0] if after else len(text)].rstrip()
        for part in [block] if words(block) <= 2 * c.max_chunk_words else by_lines(block):
            if words(part) >= 5:
                yield part, f"{kind}:{name}", 0
    rest = IMPORTS.sub("", text[: starts[0][0]]).strip()
    if words(rest) >= c.min_chunk_words:
        yield rest, "remaining", 0


CHUNKERS: dict[str, Callable] = {"recursive": recursive, "hierarchical": hierarchical, "semantic": semantic, "page": page, "code": code}


def register_chunker(name: str, chunker: Callable) -> None:
    """Add a chunker: a function of (text, config) that yields (text, section, page)."""
    CHUNKERS[name.lower()] = chunker


def chunkers() -> list[str]:
    return sorted(CHUNKERS)


def chunk(
    docs: DataFrame, config, text_col: str = "text", id_col: str = "doc_id", strategy: str | None = None, language: str | None = None
) -> DataFrame:
    """(<id>, chunk_id, idx, section, page, text, word_count, words, original_text) of every passage.

    Null and blank texts give none. With ``chunk_overlap_sentences`` a chunk begins with the last
    sentences of the chunk before; ``original_text`` has it without.
    """
    name = (strategy or config.chunk_strategy).lower()
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(chunkers())}")
    chunker = CHUNKERS[name]
    if name == "code":
        chunker = lambda t, c: code(t, c, EXTENSION_LANGUAGE.get((language or "").lower(), (language or "unknown").lower()))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("idx", T.IntegerType())])
    schema = schema.add("section", "string").add("page", "integer").add("text", "string")

    def cut(batches):
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = [(j, p[1], p[2], p[0]) for j, p in enumerate(x for x in chunker(value or "", config) if x[0].strip())]
                at += [i] * len(found)
                rows += found
                if len(rows) > 5000:
                    yield _batch(batch, at, rows)
                    at, rows = [], []
            yield _batch(batch, at, rows)

    source = F.col(f"`{text_col}`")
    if config.strip_references and name != "code":
        source = X.strip_references(source, scan_lines=40 * config.max_reference_pages)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("text")).mapInArrow(cut, schema)
    made = made.withColumn("original_text", F.col("text")).withColumn("words", X.chunk_words(F.col("text")))
    if config.chunk_overlap_sentences > 0 and name in ("recursive", "semantic", "hierarchical"):
        made = with_overlap(made, config.chunk_overlap_sentences, "id", small_only=name == "hierarchical")
    prefix = {"hierarchical": "small_", "code": "code_"}.get(name, "chunk_")
    chunk_id = F.concat(F.lit(prefix), F.col("idx").cast("string"))
    section = F.col("section")
    if name == "hierarchical":
        chunk_id = F.when(section.startswith("large_"), section).otherwise(chunk_id)
        section = F.when(section.startswith("large_"), "").otherwise(section)
    return made.select(
        F.col("id").alias(id_col), chunk_id.alias("chunk_id"), "idx", section.alias("section"), "page", "text",
        X.word_count(F.col("text")).alias("word_count"), "words", "original_text",
    )


def _batch(batch: pa.RecordBatch, at: list[int], rows: list) -> pa.RecordBatch:
    idx, section, number, text = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(idx, pa.int32()), pa.array(section, pa.string()),
         pa.array(number, pa.int32()), pa.array(text, pa.string())],
        names=["id", "idx", "section", "page", "text"],
    )


def tail_sentences(text, n: int):
    """The last n sentences, by a rule that needs no capital after the break."""
    def tail(s):
        return F.when(F.size(s) <= n, F.trim(text)).otherwise(F.array_join(F.slice(s, F.greatest(F.size(s) - n + 1, F.lit(1)), n), " "))

    return X.let(F.split(F.trim(text), r"(?<=[.!?])\s+"), tail)


def with_overlap(chunks: DataFrame, n: int, id_col: str = "doc_id", small_only: bool = False) -> DataFrame:
    """Chunks that begin with the last n sentences of the chunk before in their document."""
    order = Window.partitionBy(id_col).orderBy("idx")
    before = F.lag("text").over(order)
    if small_only:
        before = F.when(~F.col("section").startswith("large_"), before)
    tail = F.col("__tail")
    return (
        chunks.withColumn("__tail", tail_sentences(before, n))
        .withColumn("words", F.when(tail != "", F.concat(X.tokenize_simple(tail), F.col("words"))).otherwise(F.col("words")))
        .withColumn("text", F.when(tail != "", F.concat_ws(" ", tail, F.col("text"))).otherwise(F.col("text")))
        .drop("__tail")
    )


def fixed_chunks(docs: DataFrame, size: int = 120, text_col: str = "text", id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    """(<id>, idx, words) of consecutive runs of ``size`` chunk words; the last run is shorter."""
    def runs(w):
        count = F.ceil(F.size(w) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(w, i * size + 1, size))
        return F.when(count > 0, cut)

    # tokens are a variable of one expression, so a long text is split once, not once for each chunk
    return docs.select(F.col(id_col), *keep, F.posexplode(X.let(X.chunk_words(F.col(text_col)), runs)).alias("idx", "words"))


def assign_pages(chunks: DataFrame, spans: DataFrame, texts: DataFrame, id_col: str = "doc_id", lengths=(25, 20, 15, 10, 8, 6, 4)) -> DataFrame:
    """``chunks`` with the page on which their text begins.

    ``spans`` has (<id>, start, end, page) over ``texts`` (<id>, text). The longest of the first words of a
    chunk that occurs in the text places it, by a range join with the spans; otherwise the first page
    whose relative position is within 0.15 of the chunk's counts, or 0.
    """
    squeezed = F.regexp_replace(F.col("text"), r"(?U)\s+", " ")
    full = texts.select(F.col(id_col).alias("__d"), squeezed.alias("__full"), F.length("text").alias("__len"), (F.length("text") / F.length(squeezed)).alias("__scale"))
    w = X.split_words(F.col("original_text") if "original_text" in chunks.columns else F.col("text"))
    placed = chunks.join(full, F.col(id_col) == F.col("__d"), "left")
    spot = F.coalesce(*[
        F.when(F.size(w) >= n, F.nullif(F.instr(F.col("__full"), F.array_join(F.slice(w, 1, n), " ")), F.lit(0))) for n in lengths
    ])
    placed = placed.withColumn("__at", ((spot - 1) * F.col("__scale")).cast("long"))
    total = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    placed = placed.withColumn("__frac", F.col("idx") / total).withColumn("__row", F.struct(id_col, "chunk_id"))
    s = spans.select(F.col(id_col).alias("__sd"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("page").alias("__p"))
    joined = placed.join(s, F.col(id_col) == F.col("__sd"), "left")
    hit = F.when((F.col("__at") >= F.col("__s")) & (F.col("__at") < F.col("__e")), F.struct("__s", "__p"))
    near = F.when(F.abs(F.col("__s") / F.greatest(F.col("__len"), F.lit(1)) - F.col("__frac")) < 0.15, F.struct("__s", "__p"))
    cols = [c for c in chunks.columns if c != "page"]
    found = joined.groupBy("__row").agg(*[F.first(c).alias(c) for c in cols], F.min(hit).alias("__h"), F.min(near).alias("__n"), F.first("__at").alias("__at"))
    pages = F.coalesce(F.col("__h.__p"), F.col("__n.__p"), F.lit(0)).cast("int")
    return found.select(*cols, pages.alias("page")).select(*chunks.columns)
