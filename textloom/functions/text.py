"""Scalar text functions as column expressions: no UDFs, so scans stay in generated JVM code.

``\\w`` and ``\\s`` are taken in their Unicode sense, through ``(?U)``. A null text gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from textloom import constants as K

LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
LIGATURES |= {"\u00c6": "AE", "\u00e6": "ae", "\u0152": "OE", "\u0153": "oe", "\u00df": "ss"}
URL_NOISE = (
    r"(?i)(?:https?://|www\.|\.(?:org|com|edu|net)/|doi\.org|arxiv\.org|arxiv:|doi:|isbn|issn"
    r"|(?:pp|vol)\.\s*\d|\d{4}\.\d{4,5}|arxiv\s+\d{4}\.\d{4,5})"
)
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\d])"
REFERENCE_HEADING = r"(?im)^\s*(?:references|bibliography|works cited|selected references)"
REFERENCE_LINES = (
    r"^\s*\[?\d+[\].)]?\s*[A-Z][a-z]+.*?\d{4}",
    r"^\s*[A-Z][a-z]+,?\s+[A-Z]\..*?\d{4}",
    r"^\s*[A-Z][a-z]+\s+(?:and|&)\s+[A-Z][a-z]+.*?\d{4}",
)
CITATION = r"\[[\d,\s-]+\]|\(\s*[A-Z][a-z]+(?:\s+(?:et al\.?|and|&)(?:\s+[A-Z][a-z]+)?)?,?\s+\d{4}\s*\)"
STEM_SUFFIXES = (
    "ting ing tion sion ment ness able ible ful ous ive ory ize ise ify ate ent ant est ers ies led red ed er es ly al th ty"
).split()
RERANK_SUFFIXES = [s for s in STEM_SUFFIXES if s not in ("led", "red", "al", "th", "ty")]
TECHNICAL_SUFFIXES = (
    "tion ment ness ity ism ive ory able ible ful ous ize ise ify ate ent ant ing net ary acy ics oid gram graph scope "
    "meter ology onomy pathy genic phile phobe form fold ward wise"
).split()
CODE_MARKS = ("def ", "class ", "import ", "function ", "var ", "const ", "let ", "#include", "public ", "private ")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def drop_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def split_words(text: Column) -> Column:
    """White-space separated tokens; none for a blank text."""
    return drop_empty(F.split(text, r"(?U)\s+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


STOP_TERMS = K.COMMON_WORDS | K.NOISE_TERMS


def member(word: Column, words: frozenset) -> Column:
    """Whether a word is one of many; the list goes to the JVM once, not a literal at a time for each use."""
    sc = SparkContext.getOrCreate()
    held = sc.__dict__.setdefault("_textloom_lists", {})  # there, as this module travels with functions that name it
    if words not in held:
        made = sc._jvm.java.util.ArrayList()
        for w in sorted(words):
            made.add(w)
        held[words] = made
    return ClassicColumn(word._jc.isInCollection(held[words]))


def is_common(word: Column) -> Column:
    return member(word, K.COMMON_WORDS)


def is_noise(word: Column) -> Column:
    return member(word, K.NOISE_TERMS)


def is_stop(word: Column) -> Column:
    """Common or noise, in one test."""
    return member(word, STOP_TERMS)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case; hyphens, underscores and punctuation become blanks."""
    return squeeze(F.regexp_replace(F.translate(F.lower(text), "-_", "  "), r"(?U)[^\w\s]", " "))


def tokenize(text: Column) -> Column:
    """Words of the normalised text of two characters or more."""
    return F.filter(F.split(normalize(text), " "), lambda w: F.length(w) > 1)


def tokenize_simple(text: Column) -> Column:
    """As :func:`tokenize`, but underscores stay."""
    return F.filter(F.split(squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")), " "), lambda w: F.length(w) > 1)


def concept_tokens(text: Column) -> Column:
    """Words that queries and concepts are made of: no common words, no noise, two characters or more."""
    return F.filter(tokenize(text), lambda w: ~is_stop(w))


def chunk_words(text: Column) -> Column:
    """Words of a chunk: stop words stay, Greek letters go."""
    return tokenize(F.regexp_replace(text, "[\u0370-\u03ff\u1f00-\u1fff]", ""))


def base_sentences(text: Column) -> Column:
    """Sentences at . ! ? before a capital or digit; failing that, at . ! ? ;"""
    def cut(t):
        strict = F.split(t, SENTENCE_END)
        return F.when(F.size(strict) > 1, strict).otherwise(F.split(t, r"(?<=[.!?;])\s+"))

    # white space is single blanks by then, all of which a cut takes: there is nothing to trim, and Spark's trim of some
    # elements of a split drops their first digit
    return drop_empty(let(squeeze(text), cut))


def sentences(text: Column, min_words: int = 8, quotes: bool = False) -> Column:
    """Sentences with short ones merged into what follows; numbers, URLs and addresses are not cut.

    A break needs white space, so decimals and URLs inside a token are safe by themselves; a token that
    is a URL or an address keeps its final dot together with the next sentence.
    """
    ahead = r"(?=[A-Z\d\"'(])" if quotes else r"(?=[A-Z\d])"
    guarded = F.regexp_replace(squeeze(text), r"((?:https?://|[^\s@]+@[^\s@]+\.)\S*|\.{3,})([.!?]?)(\s)", "$1$2\u0001$3")
    raw = drop_empty(F.transform(F.split(guarded, r"(?<=[.!?])\s+" + ahead), lambda s: F.trim(F.translate(s, "\u0001", ""))))
    return merge_short(raw, min_words)


def merge_short(parts: Column, min_words: int = 8) -> Column:
    """Parts joined to the ones before while those have fewer than ``min_words`` words."""
    def add(acc, part):
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        merged = F.concat(head, F.array(F.concat_ws(" ", last, part)))
        return F.when(F.size(acc) == 0, F.array(part)).when(word_count(last) < min_words, merged).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def pack_by_words(parts: Column, limit: int) -> Column:
    """Consecutive parts joined while they have at most ``limit`` words together; a longer part stands alone."""
    def add(acc, part):
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        over = word_count(last) + word_count(part) > limit
        return F.when((F.size(acc) == 0) | over, F.concat(acc, F.array(part))).otherwise(
            F.concat(head, F.array(F.concat_ws(" ", last, part)))
        )

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words; the whole text if it has fewer, nothing if it has none."""
    def grams(w):
        long = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, n)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(long)

    return let(words, grams)


def indexable_ngrams(words: Column, max_n: int = 4, boundaries: bool = True, unigrams: bool = True, min_n: int = 2) -> Column:
    """array<struct<gram, size>>: runs of ``min_n`` to ``max_n`` words, every occurrence, whose first and last words are
    neither common nor noise, and with ``unigrams`` each distinct word of five characters or more that is neither."""
    def grams(marked):
        def of_size(n):
            at = F.sequence(F.lit(0), F.greatest(F.size(marked) - n, F.lit(0)))
            fits = lambda i: i + n <= F.size(marked)
            if boundaries:
                at = F.filter(at, lambda i: fits(i) & F.get(marked, i)["ok"] & F.get(marked, i + (n - 1))["ok"])
            else:
                at = F.filter(at, fits)
            return F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(marked, i + 1, n)["w"]).alias("gram"), F.lit(n).alias("size")))

        parts = [of_size(n) for n in range(min_n, max_n + 1)]
        if unigrams:
            single = F.array_distinct(F.filter(marked, lambda m: m["ok"] & (F.length(m["w"]) > 4)))
            parts.append(F.transform(single, lambda m: F.struct(m["w"].alias("gram"), F.lit(1).alias("size"))))
        return F.concat(*parts)

    # each word is tested once, however many runs it bounds
    return let(F.transform(words, lambda w: F.struct(w.alias("w"), (~is_stop(F.lower(w))).alias("ok"))), grams)


def strip_suffix(word: Column, suffixes: list[str]) -> Column:
    """The word without the first listed suffix that leaves three characters or more.

    One pattern with a branch for each suffix, in their order; only the branch that matches has text.
    """
    branches = "|".join(f"(.{{3,}}){s}" for s in suffixes)
    return F.regexp_replace(word, f"^(?:{branches})$", "".join(f"${i + 1}" for i in range(len(suffixes))))


def stem(word: Column) -> Column:
    return strip_suffix(word, STEM_SUFFIXES)


def stem_set(words: Column) -> Column:
    """Words and their stems by the shorter list that reranking uses."""
    return F.array_union(words, F.transform(words, lambda w: strip_suffix(w, RERANK_SUFFIXES)))


def is_toc_line(line: Column) -> Column:
    """Leaders, a number at the end, or a heading in capitals, as in tables of contents."""
    t = F.trim(line)
    return (t != "") & (t.rlike(r"\.{3,}|\.{2,}\s*\d+|\d+\s*$") | t.rlike(r"^[A-Z][A-Z\s&]{5,}$"))


def is_toc_text(text: Column) -> Column:
    return F.trim(text).rlike(r"\.{3,}|\.{2,}\s*\d+")


def _share(text: Column, test) -> Column:
    def ratio(lines):
        return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(F.size(F.filter(lines, test)) / F.greatest(F.size(lines), F.lit(1)))

    return let(drop_empty(F.transform(F.split(text, "\n"), F.trim)), ratio)


def toc_ratio(text: Column) -> Column:
    """The share of non-blank lines that look like a table of contents."""
    return _share(text, is_toc_line)


def noise_share(text: Column, noise: frozenset = K.NOISE_TERMS) -> Column:
    def ratio(w):
        return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(w, lambda x: member(x, noise))) / F.greatest(F.size(w), F.lit(1))
        )

    return let(split_words(F.lower(text)), ratio)


def contains_noise_terms(text: Column) -> Column:
    return noise_share(text, K.GENERAL_NOISE) > 0.4


def is_url_noise(text: Column, noise: frozenset = K.NOISE_TERMS) -> Column:
    return text.rlike(URL_NOISE) | (noise_share(text, noise) > 0.4)


def filter_url_lines(text: Column) -> Column:
    """The text without lines under 200 characters that have a URL and less than 70 % letters."""
    def bad(line):
        total = F.length(F.trim(line))
        letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
        return line.rlike(URL_NOISE) & (total < 200) & (total > 0) & (letters < 0.7 * total)

    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~bad(x)), "\n")


def is_reference_line(line: Column) -> Column:
    t = F.trim(line)
    return (t != "") & (t.rlike(REFERENCE_HEADING) | is_reference_entry(t))


def is_reference_entry(line: Column) -> Column:
    t = F.trim(line)
    return reduce(lambda a, b: a | b, (t.rlike(p) for p in REFERENCE_LINES))


def is_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def strip_references(text: Column, run: int = 5, scan_lines: int = 600, skip_blank: bool = True) -> Column:
    """The text before its first reference heading, or else before the last run of ``run`` reference lines.

    The run is looked for from the end, in the last ``scan_lines`` lines; blank lines do not break it.
    """
    def cut(lines):
        heading = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(REFERENCE_HEADING)), True)
        start = F.greatest(F.size(lines) - scan_lines, F.lit(0))
        marked = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("at"), F.trim(x).alias("t")))
        tail = F.reverse(F.slice(marked, start + 1, F.greatest(F.size(lines) - start, F.lit(0))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))

        def step(acc, m):
            grown = F.struct(
                (acc["n"] + 1).alias("n"), F.when(acc["n"] + 1 >= run, m["at"]).otherwise(F.lit(0)).alias("at")
            )
            blank = acc if skip_blank else F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
            broken = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
            return F.when(acc["at"] > 0, acc).when(m["t"] == "", blank).when(is_reference_entry(m["t"]), grown).otherwise(broken)

        found = F.aggregate(tail, zero, step)["at"]
        at = F.when(heading > 0, heading).otherwise(found)
        return F.when(at > 0, F.regexp_replace(F.array_join(F.slice(lines, 1, (at - 1).cast("int")), "\n"), r"\s+$", "")).otherwise(
            F.array_join(lines, "\n")
        )

    return let(F.split(text, "\n"), cut)


# ---- cleaning


def fix_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fix_quotes(text: Column) -> Column:
    """Typographic quotes, dashes, blanks and ellipses to ASCII; zero-width characters go."""
    text = F.translate(text, "\u201c\u201d\u2018\u2019\u2013\u2014\u00a0\u200b\u200c\u200d\ufeff", "\"\"''-- ")
    return F.replace(text, F.lit("\u2026"), F.lit("..."))


def fix_hyphenation(text: Column) -> Column:
    """Words that a line end cuts in two are joined."""
    return F.regexp_replace(text, "(?U)(?<=\\w)[-\u2010]\n(?=\\w)", "")


def unix_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(text, "\t", " "), "\r\n?", "\n"), " +", " ")


def strip_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def collapse_whitespace(text: Column) -> Column:
    return trim_all(F.regexp_replace(unix_whitespace(text), "\n{3,}", "\n\n"))


def trim_all(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Ligatures, quotes, hyphenation, white space, control characters and blank lines put right."""
    text = unix_whitespace(fix_hyphenation(fix_quotes(fix_ligatures(F.coalesce(text, F.lit(""))))))
    return trim_all(F.regexp_replace(strip_control_chars(text), "\n{3,}", "\n\n"))


# ---- document measures


def quality(text: Column) -> Column:
    """The share of letters and white space in the first 10,000 characters, to three digits."""
    sample = F.substring(text, 1, 10000)
    good = F.length(F.regexp_replace(sample, r"(?U)[^\p{L}\s]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.bround(good / F.greatest(F.length(sample), F.lit(1)), 3))


def structure(text: Column) -> Column:
    """Counts of lines, characters, words, paragraphs and URLs, and signs of code and of references."""
    code = reduce(lambda a, b: a + b, (F.contains(F.substring(text, 1, 10000), F.lit(m)).cast("int") for m in CODE_MARKS))
    refs = F.regexp_count(F.substring(text, 1, 30000), F.lit(r"(?i)\[\d+\]|\(\d{4}\)|et al\.|doi:|arxiv:"))
    return F.struct(
        F.size(F.split(text, "\n")).alias("line_count"),
        F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))).alias("non_empty_lines"),
        F.length(text).alias("char_count"),
        word_count(text).alias("word_count"),
        F.greatest(F.regexp_count(text, F.lit("\n\n")), F.lit(1)).alias("paragraph_count"),
        (code >= 2).alias("likely_contains_code"),
        F.regexp_count(text, F.lit(r"https?://\S+")).alias("url_count"),
        refs.alias("reference_indicators"),
        (refs > 3).alias("likely_has_references"),
    )


def _best(shares: list[tuple[str, Column]], least: float, otherwise: str) -> Column:
    """The first name with the greatest share, if that is large enough."""
    top = F.greatest(*[s for _, s in shares])
    out = F.lit(otherwise)
    for name, share in reversed(shares):
        out = F.when(share == top, F.lit(name)).otherwise(out)
    return F.when(top < least, F.lit(otherwise)).otherwise(out)


def _keyword_share(words: Column, keywords) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in sorted(keywords)]))) / F.lit(float(len(keywords)))


def detect_language(text: Column) -> Column:
    """Script shares for zh, ja, ko, ar and ru; else the Latin-script language with most indicator words."""
    latin = [x for x in K.LANGUAGE_WORDS if x not in ("zh", "ja", "ko", "ar", "ru")]
    sample = F.regexp_replace(
        F.lower(F.substring(text, 1, 5000)),
        r"[^a-z\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u0600-\u06ff\u0400-\u04ff\s]", "")

    def pick(s):
        total = F.greatest(F.length(s), F.lit(1))
        count = lambda chars: F.regexp_count(s, F.lit(f"[{chars}]"))
        han, kana, hangul = count(r"\u4e00-\u9fff"), count(r"\u3040-\u30ff"), count(r"\uac00-\ud7af")
        east = F.when(kana > han * 0.3, "ja").when(hangul > han * 0.3, "ko").otherwise("zh")
        words = F.array_distinct(F.regexp_extract_all(s, F.lit("[a-z]{2,}"), F.lit(0)))
        west = let(words, lambda w: _best([(x, _keyword_share(w, set(K.LANGUAGE_WORDS[x]))) for x in latin], 0.02, "en"))
        return (
            F.when((han + kana + hangul) / total > 0.2, east)
            .when(count(r"\u0600-\u06ff") / total > 0.1, "ar")
            .when(count(r"\u0400-\u04ff") / total > 0.1, "ru")
            .otherwise(west)
        )

    return let(sample, pick)


def _ascii_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))


def detect_domain(text: Column, domains: dict = K.DOMAINS, sample: int = 20000) -> Column:
    """The domain of whose keywords the start of the text has the largest share, if 3 % or more."""
    words = _ascii_words(F.substring(text, 1, sample))
    return let(words, lambda w: _best([(d, _keyword_share(w, set(k))) for d, k in domains.items()], 0.03, "unknown"))


def domain_overlap(text: Column, domain: str) -> Column:
    keywords = K.DOMAINS.get(domain)
    return _keyword_share(_ascii_words(text), set(keywords)) if keywords else F.lit(0.0)


def all_domains() -> list[str]:
    return sorted(K.DOMAINS)


def detect_title(text: Column, filename: Column | None = None) -> Column:
    """The file's name if it has over three characters, or else the first line that looks like a title."""
    lines = F.filter(F.transform(F.slice(F.split(trim_all(text), "\n"), 1, 10), trim_all), lambda x: x != "")

    def as_title(x):
        heading = trim_all(F.regexp_replace(x, "^#+", ""))
        words, size = word_count(x), F.length(x)
        fits = (size > 5) & (size < 100)
        capitals = fits & (x == F.upper(x)) & x.rlike(r"\p{L}") & (words > 1)
        plain = fits & x.rlike("^[A-Z]") & ~x.endswith(".") & words.between(2, 12)
        return (
            F.when(x.startswith("#") & (F.length(heading) > 2), heading).when(capitals, F.initcap(x)).when(plain, x)
        )

    found = F.filter(F.transform(lines, as_title), lambda x: x.isNotNull())
    head = F.substring(text, 1, 2000)
    patterns = (r"(?m)^#\s+(.+)$", r"(?im)^\s*(?:chapter|section|part)\s+1[:\s]+(.+)$", r"(?m)^\s*([A-Z][A-Z\s]{5,60})\s*$", r"(?m)^\s*([A-Z][^\n]{5,80})\s*$")
    extracted = [trim_all(F.regexp_extract(head, p, 1)) for p in patterns]
    fallback = F.coalesce(*[F.when(F.length(e).between(4, 99), e) for e in extracted], F.lit(""))
    title = F.coalesce(F.try_element_at(found, F.lit(1)), fallback)
    if filename is None:
        return title
    base = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = squeeze(F.translate(base, "-_", "  "))
    return F.when(filename.isNotNull() & (F.length(name) > 3), name).otherwise(title)


HEADINGS = (
    r"(?m)^\s*(?:\d+\.?\d*\.?\d*)\s+([A-Z][^\n]{3,60})",
    r"(?m)^\s*(?:Chapter|Section|Part|Lesson)\s+\d+[.:]\s*([A-Z][^\n]{3,60})",
    r"(?m)^\s*([A-Z][A-Z\s]{3,60})\s*$",
    r"(?m)^#\s+(.+)$",
    r"(?m)^##\s+(.+)$",
    r"(?m)^###\s+(.+)$",
)


def headings(text: Column, limit: int = 50) -> Column:
    """Distinct headings of the first 50,000 characters, by kind of heading, then position."""
    head = F.substring(text, 1, 50000)
    found = F.concat(*[F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in HEADINGS])
    tidy = F.filter(F.transform(found, squeeze), lambda x: F.length(x).between(3, 99))
    return F.slice(F.array_distinct(tidy), 1, limit)


def metadata(text: Column, filename: Column | None = None) -> Column:
    """Title, language, domain, headings and structure of a document in one struct."""
    return F.struct(
        detect_title(text, filename).alias("title"),
        detect_language(text).alias("language"),
        detect_domain(text, K.METADATA_DOMAINS).alias("domain"),
        headings(text).alias("headings"),
        structure(text).alias("structure"),
    )


# ---- concepts


def is_technical_term(word: Column) -> Column:
    ends = word.rlike(f".{{2,}}(?:{'|'.join(TECHNICAL_SUFFIXES)})$")
    consonants = F.length(word) - F.length(F.regexp_replace(word, "[bcdfghjklmnpqrstvwxyz]", ""))
    dense = (consonants / F.greatest(F.length(word), F.lit(1)) > 0.65) & (F.length(word) > 4)
    return (F.length(word) >= 3) & ~is_stop(word) & (ends | dense)


def strip_articles(term: Column) -> Column:
    """Without leading and trailing articles; a term of only articles keeps one."""
    term = squeeze(term)
    term = F.regexp_replace(term, r"(?i)^(?:(?:the|an|a) )+(?=\S)", "")
    return F.regexp_replace(term, r"(?i)(?<=\S)(?: (?:the|an|a))+$", "")


def normalize_concept(term: Column) -> Column:
    return strip_articles(F.regexp_replace(F.lower(F.trim(term)), r"(?U)[^\w\s-]", " "))


def singular(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("[sxz]es$"), cut(2))
        .when(word.endswith("s") & ~word.rlike("[su]s$"), cut(1))
        .otherwise(word)
    )


def concept_key(term: Column) -> Column:
    """What terms share that differ only in number, case or articles."""
    words = F.filter(split_words(F.lower(strip_articles(term))), lambda w: ~w.isin("a", "an", "the"))
    return F.concat_ws(" ", F.transform(words, singular))


def is_concept_noise(term: Column, general: bool = False) -> Column:
    """Whether a term says nothing: URLs, only common words or noise, bare numbers, one character."""
    common, noise = (K.GENERAL_WORDS, K.GENERAL_NOISE) if general else (K.COMMON_WORDS, K.NOISE_TERMS)
    words = split_words(F.lower(term))
    empty = F.size(F.filter(words, lambda w: ~member(w, common | noise))) == 0
    number = term.rlike(r"\d") & (F.size(words) <= 2) & ~term.rlike(r"\p{L}")
    return is_url_noise(term, noise) | empty | number | (F.length(F.trim(term)) < 2)
