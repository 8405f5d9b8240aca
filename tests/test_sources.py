"""Readers, writers, the stream, and the archive as a whole, on files made here."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern.api import Archive, NotFound
from lectern.operators.filters import Facets, Request
from lectern.sources import readers as RD
from lectern.sources import sinks as SK
from lectern.streaming import ingest as ST

CHUNKS = [
    {"chunk_id": "c_0000", "document_id": "c", "title": "One", "author": "Madison", "date": "1787", "source_collection": "x", "text": "The charter of liberty under Article I, Section 8.", "word_count": 9, "issue_tags": ["a", "b"]},
    {"chunk_id": "c_0001", "document_id": "c", "text": "A treaty, a treaty and no charter.", "word_count": 7, "constitutional_clause_tags": ["I.8"]},
    {"chunk_id": "d_0000", "document_id": "d", "title": "Two", "author": "Jay", "text": "Madison and Hamilton wrote of liberty, of liberty.", "word_count": 8},
]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.json"
    path.write_text(json.dumps({"metadata": {}, "chunks": CHUNKS}))
    return str(path)


def test_corpus(spark, corpus):
    rows = RD.corpus_json(spark, corpus).orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1, 2] and rows[1].title == "" and rows[2].issue_tags == []


def test_archive_round_trip(spark, corpus, tmp_path):
    archive = Archive.of(RD.corpus_json(spark, corpus))
    archive.save(str(tmp_path / "a"))
    again = Archive.open(spark, str(tmp_path / "a"))
    for a in (archive, again):
        hits = a.search(Request("charter liberty", facets=Facets(collections=["X"]))).collect()
        assert [h.chunk_id for h in hits] == ["c_0000"] and "<mark>charter</mark>" in hits[0].snippet
        assert [h.chunk_id for h in a.search(Request("libertty", fuzzy=1)).orderBy("rank").collect()] == ["d_0000", "c_0000"]
        assert [r.key for r in a.citations_from("c_0000").collect()] == ["clause:I.8"]
    assert again.search_all_terms("charter liberty").count() == 1
    assert again.search_by("semantic", CHUNKS[1]["text"], 1).first().id == "c_0001"
    assert again.chunk("d_0000").count() == 1 and again.stats().first().chunks == 3
    with pytest.raises(NotFound):
        again.chunk("none")
    with pytest.raises(ValueError):
        again.search_by("combined", "x")
    with pytest.raises(ValueError):
        again.connections("x")
    assert again.filtered(["clauses"], clauses=["I.8"])["clauses"].first()["count"] == 1
    meta = next((tmp_path / "a" / "_meta.json").glob("part*"))
    (tmp_path / "a" / "_meta.json" / ".{}.crc".format(meta.name)).unlink(missing_ok=True)
    meta.write_text(json.dumps({"kind": "archive", "version": 999, "tables": []}))
    with pytest.raises(ValueError):
        RD.load_archive(spark, str(tmp_path / "a"))


def test_command_line(corpus, tmp_path, capsys, spark):
    cli.main(["build", corpus, str(tmp_path / "b")])
    cli.main(["search", str(tmp_path / "b"), "treaty"])
    cli.main(["analyse", str(tmp_path / "b"), "clauses"])
    assert "c_0001" in capsys.readouterr().out


def test_timeline(spark, tmp_path):
    events = [{"id": "s", "date": "1787-09-17", "phase": "convention", "title": "Signing", "summary": "", "actors": ["Madison"], "locations": ["Philadelphia"], "source_chunks": ["c_0001", "gone"]}, {"id": "a", "date": "1786-09-11", "phase": "debate", "title": "Annapolis", "summary": "", "actors": [], "locations": []}]
    (tmp_path / "t.json").write_text(json.dumps(events))
    df = RD.timeline_json(spark, str(tmp_path / "t.json"))
    assert [r.id for r in df.collect()] == ["a", "s"]
    archive = Archive.of(spark.createDataFrame([("c_0001", "c", "t", 0)], "chunk_id string, document_id string, text string, pos long").withColumn("issue_tags", F.lit(None)), events=df)
    assert [archive.timeline(text=q).count() for q in ("SIGNING", "madison", "paris")] == [1, 1, 0]
    assert archive.event_chunks("s").count() == 1
    with pytest.raises(NotFound):
        archive.event_chunks("zz")
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "x", "date": "1", "phase": "feast"}]))
    with pytest.raises(Exception, match="unknown phase"):
        RD.timeline_json(spark, str(tmp_path / "bad.json")).collect()


def test_manifest_and_raw_files(spark, tmp_path):
    m = {"collections": [{"collection_id": "k", "documents": [{"document_id": "d1", "source_format": "html"}, {"document_id": "d2", "source_format": "text"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    (tmp_path / "raw/k/d1").mkdir(parents=True)
    (tmp_path / "raw/k/d1/source.html").write_text("<p>x</p>")
    manifest = RD.manifest_json(spark, str(tmp_path / "m.json"))
    got = {r.document_id: r.status for r in RD.raw_files(spark, manifest, str(tmp_path / "raw")).collect()}
    assert got == {"d1": "read", "d2": "skipped_missing_raw"}


def test_text_files_and_posts(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "p.md").write_text('---\nslug: first\ntitle: "A post"\ndate: 2024-01-02\n---\nBody *text* here')
    (tmp_path / "q.md").write_text("no front matter")
    assert [tuple(r) for r in RD.text_files(spark, str(tmp_path)).collect()] == [("b", "two\nlines")]
    posts = RD.posts(spark, str(tmp_path)).collect()
    assert len(posts) == 1 and posts[0].title == "A post" and posts[0].excerpt == "Body text here"


def test_graph_and_vectors(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}], "links": [{"source": "a", "target": "b"}]}))
    nodes, edges = RD.node_link(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("b", "a")}
    np.arange(6, dtype="<f4").tofile(tmp_path / "v.bin")
    assert [r.embedding for r in RD.flat_vectors(spark, str(tmp_path / "v.bin"), ["x", "y"], 3).collect()] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(Exception, match="are no 2 vectors"):
        RD.flat_vectors(spark, str(tmp_path / "v.bin"), ["x", "y"], 4).collect()


def test_transcripts_and_cases(spark, tmp_path):
    (tmp_path / "t1.json").write_text(json.dumps({"term": "1955", "caseName": "A v. B", "caseTranscripts": [{"transcript": [{"speakerName": "Counsel", "textObjs": [{"text": "May it please"}, {"text": ""}]}, {"textObjs": [{"text": "the Court"}]}]}]}))
    (tmp_path / "t2.json").write_text("{bad")
    rows = RD.transcript_json(spark, f"{tmp_path}/*.json").where("text <> ''").collect()
    assert [(r.title, r.text) for r in rows] == [("A v. B (Oral Argument Transcript)", "[Counsel]: May it please\n\n[Unknown]: the Court")]
    (tmp_path / "c.csv").write_text("name,docket\nA,1\nB,\n")
    assert [tuple(r) for r in RD.cases_csv(spark, str(tmp_path / "c.csv"), ["name", "docket", "term"]).collect()] == [("A", "1", ""), ("B", "", "")]


def test_letter_metadata(spark):
    payload = json.dumps({"documents": [{"permalink": "https://x.org/documents/Adams/01-02", "title": "T", "authors": [{"name": "Adams"}, "Jay"], "date-from": "1787"}, {"id": "i2", "author": "One"}, {"title": "no id"}]})
    rows = RD.letter_metadata(spark.createDataFrame([(payload,)], "j string"), "j").orderBy("identifier").collect()
    assert [(r.identifier, r.title, r.authors, r.date_from) for r in rows] == [("Adams/01-02", "T", ["Adams", "Jay"], "1787"), ("i2", "i2", ["One"], "")]
    assert RD.letter_metadata(spark.createDataFrame([(json.dumps([{"id": "a"}]),)], "j string"), "j", primary_only=True).count() == 0


def test_pages(spark, tmp_path):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x")).alias("r")).first().r
    assert one(RD.alto_text, '<TextLine><String CONTENT="Hello"/><SP/><String CONTENT=","/><String CONTENT="you"/></TextLine>') == "Hello, you"
    assert one(RD.tei_text, "<body><p>One <i>two</i></p><head>Top</head></body>") == "Top\n\nOne two"
    assert one(lambda c: RD.container_text(c, 'class="op"'), '<div class="x">no</div><div class="op">A <b>b</b>\n c</div>') == "A b c"
    assert one(lambda c: RD.embedded_list(c, "resources", "array<struct<id:string>>"), 'var a = {"resources": [{"id": "r1"}], "x": 1}')[0].id == "r1"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("cases/a.json", "{}")
        z.writestr("other.txt", "no")
    files = spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))
    assert [r.member for r in RD.zip_members(files, "content", r"/?cases/.*\.js(on)?$").collect()] == ["cases/a.json"]
    lines = spark.createDataFrame([("d", "x\nHEAD\na\nSTART here\nb\nEND\nz")], "id string, t string")
    assert RD.line_range(lines, "id", "t", "^START", "^END", "^HEAD").first().text == "HEAD\na\nSTART here\nb"
    html = spark.createDataFrame([("d", '<h2 class="date">May 1787</h2>' + "word " * 25 + '<h2 class="date">1790</h2>few')], "id string, t string")
    assert [r.year for r in RD.dated_sections(html, "id", "t", 1786, 1789).collect()] == [1787]


def test_newest_and_fetch_states(spark):
    df = spark.createDataFrame([("f", 0, 1990, None, 1958), ("f", 1, None, 1990, None), ("g", 2, None, None, 1949)], "country string, pos int, year_updated int, year_revised int, year_enacted int")
    assert {r.country: r.pos for r in RD.newest_per_country(df).collect()} == {"f": 0, "g": 2}
    states = spark.createDataFrame([("a", "downloaded", None), ("b", "failed", "404")], "document_id string, status string, error string")
    assert "| b | 404 |" in SK.ingest_summary(states).first().value
    assert {r.k: r.status for r in RD.landing(spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("2",)], "k string"), "k").collect()} == {"1": "pending", "2": "cached"}


def test_opinions_and_lists(spark):
    df = spark.createDataFrame([(1, "", "<p>Cited &amp; so</p>", None), (2, "Plain", "x", "y"), (3, None, "", None)], "id int, plain_text string, html_with_citations string, html_lawbox string")
    assert [tuple(r) for r in RD.opinions(df, 5).collect()] == [(1, "Cited & so"), (2, "Plain")]
    world = spark.createDataFrame([("1", "Europe", "France", True, True, False, False), ("2", "Asia", "Japan", True, True, True, False)], "id string, region string, country string, public boolean, in_force boolean, is_draft boolean, is_historic boolean")
    assert [r.id for r in RD.in_force(world).collect()] == ["1"]


def test_writers(spark, corpus, tmp_path):
    df = RD.corpus_json(spark, corpus)
    SK.write_csv(SK.csv_rows(df), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert SK.write_jsonl(df, str(tmp_path / "jsonl")) == 3
    doc = json.loads(SK.corpus_document(df).first().value)
    assert doc["metadata"]["total_chunks"] == 3 and len(doc["chunks"]) == 3
    hits = spark.createDataFrame([(1, "c", 't "q"', "A, B", "1787", "x", 1.23456, ["k", "l"], "a <mark>b</mark>")], "rank int, chunk_id string, title string, author string, date string, source_collection string, score double, matched_terms array<string>, snippet string")
    assert SK.hits_csv(hits).first().line == 'c,"t ""q""","A, B",1787,x,1.2346,k l,a b'
    assert json.loads(SK.hits_json(hits, "q").first().value)["total"] == 1
    assert SK.hits_markdown(hits).first().section.startswith('## 1. t "q"')
    SK.write_dossiers(df.select("author", "chunk_id"), "author", str(tmp_path / "dos"))
    assert spark.read.json(str(tmp_path / "dos/dossiers")).count() == 3


def test_stream_replaces_documents(spark, tmp_path):
    src = tmp_path / "in"
    row = lambda i, n, at: (i, " ".join(f"w{k}" for k in range(n)), at)
    schema = "id string, text string, ingested_at long"
    store = ST.Ingest(spark, str(tmp_path / "store"))
    for k, batch in enumerate([[row("a", 400, 1), row("b", 100, 1)], [row("a", 90, 2)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        store.run(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "state")).awaitTermination()
    assert {(r.document_id, r.n_words) for r in store.chunks().collect()} == {("a", 90), ("b", 100)}
    assert store.documents().count() == 2 and store.postings().select("id").distinct().count() == 2
    assert [(r.documents, r.chunks_added) for r in store.updates().orderBy("batch").collect()] == [(2, 3), (1, 1)]


def test_late_documents_replace_nothing_newer(spark, tmp_path):
    src = tmp_path / "in"
    row = lambda i, n, at: (i, " ".join(f"w{k}" for k in range(n)), at)
    schema = "id string, text string, ingested_at long"
    store = ST.Ingest(spark, str(tmp_path / "store"))
    for batch in ([row("a", 400, 5), row("b", 100, 1), row("c", 90, None)], [row("a", 90, 2), row("b", 110, 1), row("c", 95, 0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        store.run(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "state")).awaitTermination()
    assert {(r.document_id, r.n_words) for r in store.chunks().collect()} == {("a", 320), ("a", 125), ("b", 110), ("c", 95)}
    assert {(r.id, r.ingested_at) for r in store.documents().collect()} == {("a", 5), ("b", 1), ("c", 0)}


def test_windows_of_several_batches(spark, tmp_path):
    """Rows are written as they change; one that comes after the watermark counts no more."""
    src, schema = tmp_path / "in", "ts timestamp, kind string, value double"
    at = lambda h, m: f"2024-01-01 {h:02}:{m:02}:00"
    for batch in ([(at(1, 0), "x", 1.0), (at(1, 30), "x", 2.0)], [(at(1, 45), "x", 4.0), (at(9, 0), "x", 8.0)], [(at(1, 50), "x", 16.0), (at(9, 1), "y", 32.0)]):
        df = spark.createDataFrame(batch, "ts string, kind string, value double").selectExpr("cast(ts as timestamp) as ts", "kind", "value")
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = ST.windowed_counts(spark.readStream.schema(schema).parquet(str(src)), "ts", "kind")
        got = ST.to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["start", "kind"])
    assert {(r.start.hour, r.kind, r.n, r.total) for r in got.collect()} == {(1, "x", 3, 7.0), (9, "x", 1, 8.0), (9, "y", 1, 32.0)}


def test_process_citations_and_snapshots(spark, tmp_path, capsys):
    texts = ["Article II was read, and Article III.", "Article II again.", None]
    df = spark.createDataFrame([(f"d_{k}", "d", t, k) for k, t in enumerate(texts)], "chunk_id string, document_id string, text string, pos long")
    from lectern import schemas
    from lectern.api import Archive

    missing = {c: t for c, t in schemas.CHUNK_FIELDS.items() if c not in df.columns}
    df = df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in missing.items()))
    events = spark.createDataFrame([("e1", "1787-05-25", "convention", "Opening", "Delegates meet.", [], [], ["d_0"], [])], schemas.EVENT)
    Archive.of(df, events).save(str(tmp_path / "a"))

    def said(*argv):
        cli.main([*argv])
        return capsys.readouterr().out

    a = str(tmp_path / "a")
    assert "Opening" in said("process", a, "list") and "Opening" in said("process", a, "find", "delegates") and "Opening" not in said("process", a, "get", "none")
    assert "Opening" in said("process", a, "phase", "convention")
    assert "clause:II" in said("citations", a) and "d_1" in said("citations", a, "to", "clause:II") and "clause:III" in said("citations", a, "from", "d_0") and "clause:II" in said("citations", a, "graph")
    with pytest.raises(SystemExit):
        cli.main(["process", a, "get"])
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("one")
    cli.snapshot(spark, str(tmp_path / "files")).write.parquet(str(tmp_path / "snap"))
    cli.main(["verify-snapshot", str(tmp_path / "files"), str(tmp_path / "snap")])
    (tmp_path / "files" / "x.txt").write_text("two")
    with pytest.raises(SystemExit):
        cli.main(["verify-snapshot", str(tmp_path / "files"), str(tmp_path / "snap")])


def test_combined_texts_in_files(spark, tmp_path):
    rows = [("g", k, f"{1800 - k}", f"t{k}", f"text {k}") for k in range(6)] + [("h", 9, None, None, "only")]
    sections = SK.combined_text(spark.createDataFrame(rows, "g string, id long, date string, title string, text string"), "g", "id", "date", "title", "text")
    assert {(r.group, r.id, r.occurrence) for r in sections.collect()} == {("g", k, 6 - k) for k in range(6)} | {("h", 9, 1)}
    SK.write_combined(sections, str(tmp_path / "out"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out" / "group=g").glob("part-*")))
    assert [line for line in whole.splitlines() if line.startswith("text")] == [f"text {k}" for k in (5, 4, 3, 2, 1, 0)]
