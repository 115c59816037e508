"""What format a file is in, by name, content type or first bytes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import constants as K


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def extension(path: Column) -> Column:
    """The part after the last dot of a path's or URL's last step, in lower case; null if there is none."""
    name = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/\\]*)$", 1)
    found = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9_+-]+)$", 1))
    return F.when(found != "", found)


def from_extension(path: Column) -> Column:
    """Null if the extension is unknown."""
    return F.try_element_at(_map(K.EXTENSION_FORMAT), extension(path))


def from_content_type(value: Column) -> Column:
    return F.try_element_at(_map(K.CONTENT_TYPE_FORMAT), F.lower(F.trim(F.substring_index(value, ";", 1))))


def code_language(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(K.EXTENSION_LANGUAGE), extension(path)), F.lit("unknown"))


@F.udf(T.StringType())
def zip_kind(content):
    """What a zip archive holds, by the names in it."""
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, ValueError):
        return "binary"
    for start, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")):
        if any(n.startswith(start) for n in names):
            return kind
    return "epub" if any(n.endswith(".opf") for n in names) else "zip"


def from_bytes(content: Column) -> Column:
    """By magic numbers and first characters; only archives are opened, in Python."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")
    start = F.regexp_replace(text, r"^[\sï»¿]+", "")
    printable = F.length(F.regexp_replace(text, r"[^\t\n\r -~\u0080-ÿ]", "")) / F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.length(content) < 4, "text")
        .when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("504B"), zip_kind(content))
        .when(head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF"), "text")
        .when(start.rlike(r"^[{\[]"), "json")
        .when(start.startswith("---"), "yaml")
        .when(start.startswith("<"), F.when(text.rlike(r"(?i)<html|<!doctype html"), "html").otherwise("xml"))
        .when(printable > 0.7, "text")
        .otherwise("binary")
    )


def detect(path: Column, content: Column | None = None, content_type: Column | None = None) -> Column:
    """By extension, else by content type, else by content; text if nothing tells."""
    tries = [from_extension(path)]
    if content_type is not None:
        tries.append(from_content_type(content_type))
    if content is not None:
        tries.append(from_bytes(content))
    return F.coalesce(*tries, F.lit("text"))


def decode(content: Column) -> Column:
    """Text of bytes: by byte order mark, else UTF-8 if they are valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = content.cast("string")
    return (
        F.when(head == "EFBBBF", F.substring(utf8, F.lit(2), F.length(utf8)))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(utf8), utf8)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
