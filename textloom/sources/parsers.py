"""Parsers: markup, records, logs and code to readable text.

Markup, CSV, JSON lines, logs and code are column expressions. Formats with nesting or containers go
through Python functions over Arrow batches, with the standard library only; PDF, images and others take
a function registered by the user.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators.chunk import BLOCKS, SAME_BLOCKS

# ---- markup


def html_text(html: Column) -> Column:
    """Readable text: scripts and styles dropped, headings marked with #, blocks on lines of their own."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|iframe|object|embed)\b[^>]*>.*?</\1\s*>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n" + "#" * level + " $1\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|tr|blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?t[dh]\b[^>]*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    t = F.regexp_replace(t, r"&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#[xX][0-9A-Fa-f]+);", " ")
    lines = X.drop_empty(F.transform(F.split(t, "\n"), lambda x: X.trim_all(F.regexp_replace(x, r"(?U)[^\S\n]+", " "))))
    return F.array_join(lines, "\n")


def html_title(html: Column) -> Column:
    found = X.squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    return F.when(found != "", found)


def html_headings(html: Column) -> Column:
    """array<struct<level, heading>> in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    level = lambda x: F.regexp_extract(x, r"(?i)^<h([1-6])", 1).cast("int")
    return F.transform(found, lambda x: F.struct(level(x).alias("level"), X.squeeze(F.regexp_replace(x, r"(?s)<[^>]+>", "")).alias("heading")))


def html_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"'#]+)"), F.lit(1)))


def markdown_text(md: Column) -> Column:
    """Readable text: fences named, emphasis, links and quotes reduced to their words, lists as dashes."""
    t = F.regexp_replace(md, r"(?s)```[^\S\n]*([\w+-]+)[^\S\n]*\n(.*?)```", "[Code $1]\n$2[/Code]")
    t = F.regexp_replace(t, r"(?s)```[^\S\n]*\n(.*?)```", "[Code]\n$1[/Code]")
    t = F.regexp_replace(t, r"(?m)^([^\n]+)\n=+[^\S\n]*$", "# $1")
    t = F.regexp_replace(t, r"(?m)^([^\n]+)\n-{2,}[^\S\n]*$", "## $1")
    for pattern, to in (
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(\*\*\*|\*\*|\*)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"\b(__|_)(?=\S)(.+?)(?<=\S)\1\b", "$2"), (r"~~(.+?)~~", "$1"), (r"`([^`\n]+)`", "$1"),
        (r"(?m)^[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+", "- "), (r"(?m)^[^\S\n]*>[^\S\n]?", ""), (r"(?m)^[^\S\n]*(?:\*[^\S\n]*){3,}$|^-{3,}$", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return X.trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


RST_LEVELS = {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5, "'": 6, "`": 3, "+": 4, "*": 2, "#": 1}


def rst_text(rst: Column) -> Column:
    """Readable text: underlined headings marked with #, directives, roles and fields reduced or dropped."""
    t = F.regexp_replace(rst, r"(?m)^([=\-~^\"'`+*#])\1{2,}[^\S\n]*\n[^\S\n]*([^\n]+)\n\1{3,}[^\S\n]*$", "$2\n$1$1$1")
    for mark, level in RST_LEVELS.items():
        t = F.regexp_replace(t, rf"(?m)^(?=\S)([^\n]+)\n\{mark}{{3,}}[^\S\n]*$", "#" * level + " $1")
    for pattern, to in (
        (r"(?m)^\.\.[^\S\n]+[\w-]+::[^\n]*$", ""), (r"(?m)^\.\.[^\S\n][^\n]*$", ""), (r"(?m)^[^\S\n]*:[\w -]+:(?:[^\S\n][^\n]*)?$", ""),
        (r":[\w:]+:`([^`]+)`", "$1"), (r"``([^`]+)``", "$1"), (r"`([^`<]+?)\s*<[^>]+>`_{1,2}", "$1"), (r"`([^`]+)`_?", "$1"),
        (r"(\*\*|\*)(?=\S)(.+?)(?<=\S)\1", "$2"), (r"::[^\S\n]*$", ":"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return X.trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


def xml_text(xml: Column) -> Column:
    """The text between tags, a line each; comments and instructions dropped, CDATA kept."""
    t = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.array_join(X.drop_empty(F.transform(F.split(t, r"(?s)<[^>]+>"), X.squeeze)), "\n")


# ---- records


def csv_text(columns: list[str]) -> Column:
    """``name: value`` pairs of a row, without null and empty values."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns])


def csv_document(raw: str) -> str:
    """A delimited text as a header line and a line per row; rows of another width as they are."""
    try:
        dialect = csv.Sniffer().sniff(raw[:4096], delimiters=",\t;|")
    except csv.Error:
        dialect = csv.excel_tab if "\t" in raw.partition("\n")[0] else csv.excel
    rows = [r for r in csv.reader(io.StringIO(raw), dialect) if any(x.strip() for x in r)]
    if not rows:
        return ""
    head = [h.strip() for h in rows[0]]
    out = [" | ".join(head), "-" * 40]
    for r in rows[1:]:
        named = ", ".join(f"{h}: {v.strip()}" for h, v in zip(head, r) if v.strip())
        out.append(named if len(r) == len(head) else " | ".join(x.strip() for x in r))
    return "\n".join(out)


def flat(value, depth: int = 0, name: str | None = None) -> list[str]:
    """Nested values as indented lines."""
    pad = "  " * depth
    if isinstance(value, dict):
        head = [f"{pad}{name}:"] if name is not None else []
        return head + [line for k, v in value.items() for line in flat(v, depth + (name is not None), str(k))]
    if isinstance(value, list):
        out = [f"{pad}{name}:"] if name is not None else []
        inner = depth + (name is not None)
        for i, v in enumerate(value, 1):
            out += flat(v, inner, f"Item {i}") if isinstance(v, (dict, list)) else [f"{'  ' * inner}- {scalar(v)}"]
        return out
    return [f"{pad}{name}: {scalar(value)}" if name is not None else f"{pad}{scalar(value)}"]


def scalar(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def json_document(raw: str) -> str:
    try:
        return "\n".join(flat(json.loads(raw)))
    except ValueError:
        return raw


def jsonl_document(raw: str) -> str:
    parts = []
    for n, line in enumerate((x for x in raw.splitlines() if x.strip()), 1):
        try:
            parts.append("\n".join([f"Record {n}:", *flat(json.loads(line), 1)]))
        except ValueError:
            parts.append(f"Record {n}: {line}")
    return "\n".join(parts)


def json_pairs(value: Column, separator: str = ", ") -> Column:
    """``key: value`` pairs of a flat JSON object, by key; without Python. Null if it is none."""
    entries = F.array_sort(F.map_entries(F.from_json(value, "map<string,string>")))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], F.coalesce(e["value"], F.lit("null")))), separator)


def yaml_document(raw: str) -> str:
    try:
        import yaml
    except ImportError:
        kept = (re.sub(r"(^|\s)#.*$", "", x).rstrip() for x in raw.splitlines())
        return "\n".join(x for x in kept if x.strip() and x.strip() != "---")
    try:
        return "\n".join(line for doc in yaml.safe_load_all(raw) for line in flat(doc))
    except yaml.YAMLError:
        return raw


def toml_document(raw: str) -> str:
    try:
        return "\n".join(flat(tomllib.loads(raw)))
    except tomllib.TOMLDecodeError:
        lines = (re.sub(r"\s+#.*$", "", x).strip() for x in raw.splitlines())
        return "\n".join(re.sub(r"^\[+([^\]]+)\]+$", r"\1:", re.sub(r"^([\w.-]+)\s*=\s*", r"\1: ", x)) for x in lines if x and x[0] != "#")


def email_document(raw: str) -> str:
    """Headers, the plain body (or the HTML one as text) and the names of attachments."""
    message = email.message_from_string(raw, policy=email.policy.default)
    out = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Bcc", "Subject", "Date", "Reply-To", "Message-ID") if message[h]]
    body = message.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        if body.get_content_type() == "text/html":
            text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", text)
            text = re.sub(r"[^\S\n]+", " ", re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>|</p>|</div>", "\n", text)))
        out += ["", text.strip()]
    names = [a.get_filename() for a in message.iter_attachments() if a.get_filename()]
    return "\n".join([*out, *([f"Attachments: {', '.join(names)}"] if names else [])])


# ---- office


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _paragraph(element: ET.Element) -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e) == "t").strip()


def docx_pages(content: bytes) -> list[str]:
    """One page: paragraphs, headings marked with #, tables as rows with bars."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    out = []
    for block in next(e for e in _xml(archive, "word/document.xml") if _local(e) == "body"):
        if _local(block) == "p":
            text = _paragraph(block)
            style = next((v for e in block.iter() if _local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
            level = re.match(r"[Hh]eading\s*(\d)", style)
            if text:
                out.append("#" * int(level[1]) + " " + text if level else text)
        elif _local(block) == "tbl":
            for row in (e for e in block.iter() if _local(e) == "tr"):
                out.append(" | ".join(" ".join(filter(None, (_paragraph(p) for p in cell.iter() if _local(p) == "p"))) for cell in row if _local(cell) == "tc"))
    return ["\n".join(out)]


def pptx_pages(content: bytes) -> list[str]:
    """A page per slide."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [f"Slide {i}\n" + "\n".join(t for p in _xml(archive, n).iter() if _local(p) == "p" and (t := _paragraph(p))) for i, n in slides]


def xlsx_pages(content: bytes) -> list[str]:
    """A page per sheet; rows as ``header: value`` pairs."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [_paragraph(e) for e in _xml(archive, "xl/sharedStrings.xml") if _local(e) == "si"]
    names = [e.attrib.get("name", "") for e in _xml(archive, "xl/workbook.xml").iter() if _local(e) == "sheet"]
    sheets = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    pages = []
    for k, (_, path) in enumerate(sheets):
        rows = []
        for row in (e for e in _xml(archive, path).iter() if _local(e) == "row"):
            cells = []
            for c in (e for e in row if _local(e) == "c"):
                raw = next((e.text or "" for e in c if _local(e) == "v"), None)
                inline = _paragraph(c) if c.attrib.get("t") == "inlineStr" else None
                cells.append(inline if inline is not None else shared[int(raw)] if c.attrib.get("t") == "s" and raw else raw or "")
            if any(cells):
                rows.append(cells)
        head = rows[0] if rows else []
        lines = [", ".join(f"{h}: {v}" for h, v in zip(head, r) if v) if len(r) == len(head) else " | ".join(r) for r in rows[1:]]
        pages.append("\n".join([f"Sheet: {names[k] if k < len(names) else k + 1}", *([" | ".join(head)] if head else []), *lines]))
    return pages


# ---- logs


LOG_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
LOG_LEVEL = r"\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL|TRACE)\b"


def log_entries(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(<id>, entry, timestamp, level, message): a line with a time or level begins an entry, other lines go on
    with it, a blank line ends it; lines outside entries are entries without either. WARN counts as WARNING."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    starts = F.col("line").rlike(rf"^\[?(?:{LOG_TIME})") | F.col("line").rlike(rf"^{LOG_LEVEL}|^(?i)\[{LOG_LEVEL}\]")
    own = Window.partitionBy(id_col).orderBy("pos")
    blank = F.col("line") == ""
    marked = lines.withColumn("__s", starts & ~blank).withColumn("__run", F.sum((F.col("__s") | blank).cast("int")).over(own))
    marked = marked.where(~blank)
    found = marked.groupBy(id_col, "__run").agg(
        F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"), F.max("__s").alias("__s")
    )
    first = F.element_at("all", 1)["line"]
    level = F.upper(F.regexp_extract(first, rf"(?i){LOG_LEVEL}", 1))
    time = F.regexp_extract(first, f"({LOG_TIME})", 1)
    rest = X.squeeze(F.regexp_replace(F.regexp_replace(first, rf"^\[?(?:{LOG_TIME})\]?", ""), rf"(?i)^\s*[\[-]*\s*{LOG_LEVEL}\]?\s*[:-]*", ""))
    more = F.transform(F.slice("all", 2, 1 << 30), lambda x: x["line"])
    return found.select(
        id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("pos")).alias("entry"),
        F.when(time != "", time).alias("timestamp"), F.when(level == "WARN", "WARNING").when(level != "", level).alias("level"),
        F.concat_ws("\n", F.when(rest != "", rest), more).alias("message"),
    )


def log_levels(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def log_text(entries: DataFrame, id_col: str = "doc_id", most: int = 5000) -> DataFrame:
    """(<id>, text): the first ``most`` entries of each log, a line each."""
    line = F.concat_ws(" ", F.when(F.col("timestamp").isNotNull(), F.concat(F.lit("["), "timestamp", F.lit("]"))), F.concat(F.col("level"), F.lit(":")), "message")
    rows = entries.where(F.col("entry") <= most).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("entry", line.alias("t")))).alias("a"))
    return rows.select(id_col, F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("text"))


# ---- code

CODE_IMPORTS = r"(?m)^\s*((?:import\b|from\s+\S+\s+import\b|#include\b|using\s+[\w.:]+;|use\s+[\w:]+|require\b)[^\n]*)$"


def code_structure(source: Column, language: str) -> Column:
    """struct<imports, one array of names per kind of block>, by regular expressions of the language."""
    kinds = BLOCKS.get(SAME_BLOCKS.get(language, language), BLOCKS["python"])
    java = lambda p: p.replace("(?P<name>", "(")
    parts = [F.transform(F.regexp_extract_all(source, F.lit(CODE_IMPORTS), F.lit(1)), F.trim).alias("imports")]
    for kind, pattern in kinds:
        parts.append(F.regexp_extract_all(source, F.lit("(?m)" + java(pattern)), F.lit(1)).alias(kind.replace("-", "_")))
    return F.struct(*parts)


def code_text(source: Column, language: str) -> Column:
    """A summary of what the code declares, then the code."""
    s = code_structure(source, language)
    kinds = [k.replace("-", "_") for k, _ in BLOCKS.get(SAME_BLOCKS.get(language, language), BLOCKS["python"])]
    lines = [F.when(F.size(s[k]) > 0, F.concat(F.lit(f"{k}: "), F.array_join(s[k], ", "))) for k in ["imports", *kinds]]
    return F.concat_ws("\n", F.lit(f"{language} code"), *lines, F.lit(""), source)


# ---- documents

TEXT_PARSERS: dict[str, Callable[[str], str]] = {
    "json": json_document, "jsonl": jsonl_document, "csv": csv_document, "tsv": csv_document, "yaml": yaml_document,
    "toml": toml_document, "eml": email_document, "email": email_document,
}
PAGE_PARSERS: dict[str, Callable[[bytes], list[str]]] = {"docx": docx_pages, "pptx": pptx_pages, "xlsx": xlsx_pages}
NATIVE: dict[str, Callable[[Column], Column]] = {"html": html_text, "markdown": markdown_text, "rst": rst_text, "xml": xml_text}


def register_parser(name: str, parser: Callable[[bytes], list[str]]) -> None:
    """A parser from bytes to the texts of pages, as for PDF or images."""
    PAGE_PARSERS[name] = parser


def plain_text(text: Column) -> Column:
    return X.collapse_whitespace(X.strip_control_chars(text))


def parse(files: DataFrame, content: str = "content", kind: str = "format", text: Callable[[Column], Column] | None = None) -> DataFrame:
    """``files`` with text, pages array<struct<start, end, page>>, error: by a format in the column ``kind``.

    Formats without a parser give null text and say so in ``error``, as does content that its parser
    refuses. Pages are joined by blank lines, and a page begins at the separator before it.
    """
    from textloom.sources import formats

    decoded = text(F.col(content)) if text else formats.decode(F.col(content))
    python = F.col(kind).isin(*TEXT_PARSERS, *PAGE_PARSERS)
    native = F.lit(None).cast("string")
    for name, f in NATIVE.items():
        native = F.when(F.col(kind) == name, f(decoded)).otherwise(native)
    native = F.when(F.col(kind).isin("text", "txt", "log", "code"), plain_text(decoded)).otherwise(native)
    out = T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    @F.udf(out)
    def run(raw, as_text, name):
        try:
            if name in TEXT_PARSERS:
                return [TEXT_PARSERS[name](as_text or "")], None
            return PAGE_PARSERS[name](bytes(raw or b"")), None
        except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ET.ParseError) as e:
            return None, f"{type(e).__name__}: {e}"

    rows = files.withColumn("__p", F.when(python, run(F.col(content), decoded, F.col(kind))))
    pages = F.when(python, F.col("__p.pages")).when(native.isNotNull(), F.array(native))
    rows = rows.withColumn("__pages", pages)
    step = lambda acc, p: F.concat(
        acc,
        F.array(
            F.struct(
                F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)).alias("start"),
                (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] + 2, F.lit(0)) + F.length(p)).alias("end"), (F.size(acc) + 1).alias("page"),
            )
        ),
    )
    spans = F.aggregate("__pages", F.array().cast("array<struct<start:int,end:int,page:int>>"), step)
    missing = F.concat(F.lit("no parser for "), F.coalesce(F.col(kind), F.lit("null")))
    return rows.withColumns(
        {
            "text": F.array_join("__pages", "\n\n"), "pages": spans,
            "error": F.coalesce(F.col("__p.error"), F.when(F.col("__pages").isNull(), missing)),
        }
    ).drop("__p", "__pages")


def parse_result(text: Column) -> Column:
    """struct of the counts and the quality of a text."""
    return F.struct(F.length(text).alias("total_chars"), X.word_count(text).alias("total_words"), X.quality(text).alias("text_quality"))


def read_files(spark, path: str, recursive: bool = True) -> DataFrame:
    """(path, format, text, pages, error) of all files below a path."""
    from textloom.sources import formats

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parse(files.select("path", "content", formats.detect(F.col("path"), F.col("content")).alias("format"))).drop("content")
