"""Parsers, formats, chunkers, text functions, store, caches, metrics and streams."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import caches, metrics
from textloom.operators import chunk as C
from textloom.plans.config import Config
from textloom.plans.registry import Registry
from textloom.sources import formats, parsers
from textloom.sources.store import IndexStore, ProjectStore
from textloom.streaming import ingest as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: X.stem(F.lit("learning")), "learn"),
        (lambda: X.stem(F.lit("sing")), "sing"),
        (lambda: X.stem(F.lit("sitting")), "sit"),
        (lambda: X.stem(F.lit("station")), "sta"),
        (lambda: X.tokenize(F.lit("A big-Dog_x, élan!")), ["big", "dog", "élan"]),
        (lambda: X.tokenize(F.lit("")), []),
        (lambda: X.fix_hyphenation(F.lit("co-\nop")), "coop"),
        (lambda: X.clean_text(F.lit("\ufb01x\u201cq\u201d\r\n\r\n\r\n a\tb ")), 'fix"q"\n\n a b'),
        (lambda: X.base_sentences(F.lit("One. Two 3.5 x. three")), ["One.", "Two 3.5 x. three"]),
        (lambda: X.word_count(F.lit("  a  b ")), 2),
        (lambda: X.is_toc_line(F.lit("Intro ..... 4")), True),
        (lambda: X.singular(F.lit("cities")), "city"),
        (lambda: X.concept_key(F.lit("The Boxes")), "box"),
        (lambda: X.strip_articles(F.lit("the the cat a")), "cat"),
        (lambda: X.is_citation(F.lit("so (Smith et al., 2020)")), True),
        (lambda: X.ngrams(F.array(F.lit("a"), F.lit("b")), 3), ["a b"]),
        (lambda: X.detect_language(F.lit("le chat est dans la maison avec les enfants et une table")), "fr"),
        (lambda: X.detect_title(F.lit("# My Report\ntext")), "My Report"),
        (lambda: X.quality(F.lit("")), 0.0),
        (lambda: X.strip_references(F.lit("body\nReferences\n[1] Smith 2020")), "body"),
        (lambda: M.table_size(F.lit(5000)), 16384),
        (lambda: M.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))), 0.0),
        (lambda: M.euclidean(F.array(F.lit(3.0)), F.array(F.lit(0.0))), 3.0),
        (lambda: formats.from_extension(F.lit("http://x/a.PDF?q=1")), "pdf"),
        (lambda: formats.from_content_type(F.lit("text/html; charset=x")), "html"),
        (lambda: formats.from_bytes(F.lit(b"%PDF-1.4")), "pdf"),
        (lambda: formats.from_bytes(F.lit(b"{\"a\": 1}")), "json"),
        (lambda: formats.from_bytes(F.lit(b"<html><b>")), "html"),
        (lambda: formats.from_bytes(F.lit(b"<a><b>")), "xml"),
        (lambda: formats.from_bytes(F.lit(b"plain words")), "text"),
        (lambda: formats.from_bytes(F.lit(bytes(range(1, 30)))), "binary"),
        (lambda: formats.decode(F.lit(b"\xe9t\xe9")), "été"),
        (lambda: formats.decode(F.lit("été".encode())), "été"),
        (lambda: parsers.html_text(F.lit("<style>x</style><h2>T</h2><p>a&amp;b<br>c</p><script>1</script>")), "## T\na b\nc"),
        (lambda: parsers.markdown_text(F.lit("Title\n=====\n**b** [l](u) `c`\n```py\nx\n```\n* i")), "# Title\nb l c\n[Code py]\nx\n[/Code]\n- i"),
        (lambda: parsers.rst_text(F.lit("Head\n----\n:ref:`x` ``y``\n.. note:: z")), "## Head\nx y"),
        (lambda: parsers.xml_text(F.lit("<?p?><a>x<!--c--><b><![CDATA[y]]></b></a>")), "x\ny"),
        (lambda: parsers.code_structure(F.lit("import os\nclass A(B):\n    pass\ndef f(x):\n    pass\n"), "python")["class"], ["A"]),
    ],
)
def test_expressions(spark, column, want):
    assert value(spark, column()) == want


def test_document_parsers():
    assert parsers.json_document('{"a": {"b": [1, {"c": true}]}, "n": null}') == "a:\n  b:\n    - 1\n    Item 2:\n      c: true\nn: null"
    assert parsers.json_document("{bad") == "{bad"
    assert parsers.jsonl_document('{"a": 1}\nbad\n').splitlines() == ["Record 1:", "  a: 1", "Record 2: bad"]
    assert parsers.csv_document("a,b\n1,2\n3\n").splitlines()[2:] == ["a: 1, b: 2", "3"]
    assert "name: x" in parsers.toml_document('[p]\nname = "x"') and parsers.toml_document("[p\nk = 1") == "[p\nk: 1"
    assert "a: 1" in parsers.yaml_document("# c\na: 1\n")
    mail = parsers.email_document("From: a@b\nSubject: Hi\nContent-Type: text/html\n\n<p>Hello<br>you</p>")
    assert mail.startswith("From: a@b\nSubject: Hi") and "Hello" in mail and "<p>" not in mail


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    docx = archive(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>para</w:t></w:r></w:p>'
                   f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    xlsx = archive(xl__workbook_xml='<workbook><sheets><sheet name="S"/></sheets></workbook>', xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row><row><c><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.bin").write_bytes(xlsx)
    (tmp_path / "c.json").write_text('{"k": 1}')
    (tmp_path / "d.html").write_text("<h1>T</h1>x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "f.docx").write_bytes(b"PK broken")
    got = {r.path.rsplit("/", 1)[-1]: r for r in parsers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "# Top\npara\na | b" and got["c.json"].text == "k: 1" and got["d.html"].text == "# T\nx"
    assert got["b.bin"].format == "xlsx" and got["b.bin"].text == "Sheet: S\nh\nh: 5"
    assert got["e.pdf"].text is None and "no parser" in got["e.pdf"].error and "BadZipFile" in got["f.docx"].error
    assert tuple(got["c.json"].pages[0]) == (0, 4, 1)


def test_logs(spark):
    log = "2024-01-01 10:00:00 WARN disk low\n  detail\n\nplain\n[ERROR] boom"
    rows = parsers.log_entries(spark.createDataFrame([(1, log), (2, ""), (3, None)], "doc_id int, text string")).orderBy("doc_id", "entry").collect()
    assert [(r.doc_id, r.entry, r.level, r.message) for r in rows] == [(1, 1, "WARNING", "disk low\ndetail"), (1, 2, None, "plain"), (1, 3, "ERROR", "boom")]
    assert parsers.log_text(spark.createDataFrame(rows)).first().text.startswith("[2024-01-01 10:00:00] WARNING: disk low")


LONG = " ".join(f"Word{i} alpha beta gamma delta end." for i in range(400))


@pytest.mark.parametrize("strategy", ["recursive", "hierarchical", "semantic", "page"])
def test_chunkers(spark, strategy):
    docs = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "# Head\n" + LONG[:3000] + "\n\nINTRODUCTION\n" + LONG[3000:6000]), (5, "Short text.")], "doc_id long, text string")
    config = Config(chunk_overlap_sentences=0)
    rows = C.chunk(docs, config, strategy=strategy).collect()
    assert {r.doc_id for r in rows} >= {1, 4} and not {2, 3} & {r.doc_id for r in rows}
    limit = config.hierarchical_large if strategy == "hierarchical" else 180
    assert all(r.word_count <= limit for r in rows) and len({(r.doc_id, r.chunk_id) for r in rows}) == len(rows)
    mine = " ".join(r.text for r in sorted(rows, key=lambda r: r.idx) if r.doc_id == 1 and not r.chunk_id.startswith("large"))
    lost = len(LONG.split()) - len(mine.split())
    assert (0 <= lost < 120 if strategy == "semantic" else 0 <= lost < config.min_chunk_words + 80) and set(mine.split()) <= set(LONG.split())
    if strategy == "recursive":
        assert {r.section for r in rows if r.doc_id == 4} == {"Head", "INTRODUCTION"}
        over = C.chunk(docs, Config(chunk_overlap_sentences=2), strategy=strategy).where("doc_id = 1").orderBy("idx").collect()
        before = re.split(r"(?<=[.!?])\s+", over[0].original_text)
        assert over[1].text == " ".join(before[-2:]) + " " + over[1].original_text
    with pytest.raises(ValueError):
        C.chunk(docs, config, strategy="other")


def test_code_chunks_and_pages(spark):
    source = "import os\n\nclass Alpha:\n    def a(self):\n        return 1 + 2 + 3\n\ndef beta(x, y):\n    return x + y + os.sep\n"
    rows = list(C.code(source, Config(), "python"))
    assert [r[1] for r in rows] == ["header", "class:Alpha", "function:beta"]
    go = list(C.code("func (s *S) Run(a int) error { return nil }\n", Config(), "go"))
    assert go[-1][1] == "function:Run"
    pages = list(C.page("first page words\fsecond\npage 3\nthird", Config(min_chunk_words=1)))
    assert [p[0] for p in pages] == ["first page words", "second", "third"]
    texts = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk ll")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 12, 1), (1, 12, 99, 2)], "doc_id long, start int, end int, page int")
    chunks = spark.createDataFrame([(1, "chunk_0", 0, "aa bb cc dd", 0), (1, "chunk_1", 1, "ff gg hh ii", 0)], "doc_id long, chunk_id string, idx int, text string, page int")
    assert {r.chunk_id: r.page for r in C.assign_pages(chunks, spans, texts).collect()} == {"chunk_0": 1, "chunk_1": 2}


def test_fixed_chunks(spark):
    words = [f"w{i}" for i in range(25)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")
    rows = sorted(C.fixed_chunks(docs, 10).collect(), key=lambda r: r.idx)
    assert [r.words for r in rows] == [words[:10], words[10:20], words[20:]]


def test_store_and_projects(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=4)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id long, text string")
    chunks = spark.createDataFrame([(i, 0, ["a", "b"]) for i in range(10)], "doc_id long, idx int, words array<string>")
    assert not store.exists()
    store.save({"documents": docs, "chunks": chunks})
    assert store.exists() and store.size() > 0 and store.load("documents").exceptAll(docs).count() == 0
    store.delete(docs.where("doc_id in (1, 2, 3)"))
    assert [r.doc_id for r in store.documents().collect()] == [0, 4, 5, 6, 7, 8, 9] and store.load("chunks").count() == 7
    assert store.metadata().where("chunk_count = 1 and words = 2 and concept_count = 0").count() == 7
    store.backup(str(tmp_path / "copy"))
    store.clear()
    assert not store.exists()
    store.restore(str(tmp_path / "copy"))
    assert store.load("documents").count() == 7
    projects = ProjectStore(spark, str(tmp_path / "p"))
    projects.create("x", "X")
    projects.add("x", docs.limit(3))
    projects.add("x", docs.limit(3))
    projects.update("x", name="Y")
    assert projects.get("x")["name"] == "Y" and projects.get("y") is None and projects.members().count() == 3
    stats = projects.stats(docs.selectExpr("doc_id", "2L chunk_count", "1L concept_count")).first()
    assert (stats.documents, stats.chunks, stats.concepts) == (3, 6, 3)
    projects.remove("x", docs.limit(1))
    assert projects.members().count() == 2
    projects.delete("x")
    assert projects.list_projects().count() == 0 == projects.members().count()


def test_caches(spark):
    cache = caches.LRUCache(2)
    cache.put("a", 1)
    cache.put("b", 2)
    assert cache.get("a") == 1
    cache.put("c", 3)
    assert cache.get("b") is None and cache.keys() == ["a", "c"] and cache.get_or_compute("d", lambda: 4) == 4 and cache.stats()["hits"] == 1
    near = caches.ApproximateCache()
    near.put("what is a neural network", "A", 5)
    assert near.get("What is: a neural network?", 5) == "A" and near.get("bond yields", 5) is None and near.get("what is a neural network", 6) is None
    rows = spark.createDataFrame([(1, "what is a neural network"), (2, "bond"), (3, "What is a neural network?"), (4, None)], "query_id int, query string")
    for r in rows.where("query_id < 4").select("query", caches.fingerprint(F.col("query")).alias("f")).collect():
        assert tuple(r.f) == caches.ApproximateCache.print_of(r.query)
    assert [(r.query_a, r.query_b) for r in caches.near_queries(rows).collect()] == [(1, 3)]
    concepts = spark.createDataFrame([("a", 3.0, 1), ("b", 9.0, 2), ("c", 5.0, 3)], "label string, score double, rank int")
    links = spark.createDataFrame([("x", "a"), ("x", "z")], "term string, other string")
    pre = caches.Prefetcher(count=2)
    assert pre.predict_next(concepts) == ["b", "c"]
    pre.record_access("x")
    assert pre.predict_from_history(concepts, links, 4) == ["b", "c", "a", "z"]


def test_metrics_and_registry(spark):
    m = metrics.Metrics()
    for v in (1, 2, 3, 10):
        m.record("t", v)
    m.count("n", 2)
    with m.timer("clock"):
        pass
    assert (m.average("t"), m.median("t"), m.percentile("t", 50), m.total("t")) == (4, 2.5, 3, 16) and "n: 2" in m.summary()
    other = metrics.Metrics()
    other.merge(m)
    assert other.counters["n"] == 2
    rows = spark.createDataFrame([("t", float(v)) for v in (1, 2, 3, 10)] + [("t", None)], "name string, value double")
    r = metrics.summary(rows).first()
    assert (r.n, r.median, r.p95, r.total) == (4, 2.5, 10, 16)
    registry = Registry()
    registry.register("parser", "X", len)
    assert registry.get("parser", "x") is len and registry.names("parser") == ["x"]
    with pytest.raises(ValueError):
        registry.get("parser", "y")


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, LONG), (2, "x")], "doc_id long, text string").write.parquet(source)
    stream = S.stream_documents(spark, source, "doc_id long, text string")
    q = S.append_postings(stream, out, str(tmp_path / "cp"), Config()).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{out}/postings").where("gram = 'alpha'").count() > 3
    rng = random.Random(1)
    events = spark.createDataFrame([(f"2024-01-01 00:{rng.randint(0, 59):02d}:00", "a", 1.0, i % 3) for i in range(50)], "ts string, event_type string, value double, user_id int").withColumn("ts", F.to_timestamp("ts"))
    assert S.windowed_counts(events, "10 minutes").agg(F.sum("n")).first()[0] == 50
    assert S.windowed_counts(events, "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 100
    assert S.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == 50
