"""Queries that write a form of the archive to the shared folder, read it again and return what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import analytics as A
from lectern.operators import graphs as G
from lectern.operators import search as S
from lectern.plans import linking, reporting, searching
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks
from lectern.runtime import read_table, shared_folder
from lectern.sources import readers as RD
from lectern.sources import sinks as SK

R = Registry()
_WHOLE = ("document_id", "title", "author", "date", "source_collection", "source_url", "document_type", ISSUES, CLAUSES, "word_count", "text")
_TAGS = lambda c: f"array_to_string(list_transform(coalesce({c}, []), lambda t: t), '|')"
# line ends inside a quoted field come back as one character
_TEXT = "md5(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'))"
_DIGEST = lambda: F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"))


def file_csv(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "csv")
    rows = SK.csv_rows(chunks(s, d, *_WHOLE))
    SK.write_csv(rows, path)
    got = s.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return got.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("issue_tags", F.lit("")).alias("issues"), "word_count", _DIGEST().alias("digest"))


R.add("file_csv", file_csv, f"WITH {C} SELECT chunk_id, coalesce(title, '') AS title, coalesce(author, '') AS author, {_TAGS(ISSUES)} AS issues, word_count, {_TEXT} AS digest FROM c")


def file_jsonl(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "jsonl")
    rows = chunks(s, d, *_WHOLE)
    SK.write_jsonl(rows, path)
    got = s.read.schema(rows.schema).json(path)
    return got.select("chunk_id", "author", "date", F.size(A.tags_of(CLAUSES)).alias("clauses"), "word_count", F.md5("text").alias("digest"))


R.add("file_jsonl", file_jsonl, f"WITH {C} SELECT chunk_id, author, date, len(list_filter(coalesce({CLAUSES}, []), lambda t: t IS NOT NULL))::INTEGER AS clauses, word_count, md5(text) AS digest FROM c")


def file_archive(s: SparkSession, d: str) -> DataFrame:
    """The ranked search over an archive that was saved and opened again."""
    path = shared_folder(s, "archive")
    index = searching.index(s, d)
    SK.write_archive(s, path, {"chunks": chunks(s, d, "title", "text"), "postings": index.postings, "lengths": index.stats, "terms": index.terms})
    t = RD.load_archive(s, path)
    hits = S.top(S.PostingIndex(t["postings"], t["lengths"], t["terms"]).bm25_or([(x, 1.0) for x in searching.TERMS]).select("id", "score"), 10)
    return F.broadcast(hits).join(t["chunks"], F.col("id") == F.col("chunk_id")).select("id", "score", "title")


R.add("file_archive", file_archive, f"WITH hits AS ({searching.R.oracle['bm25_or_top10']}), {C} SELECT id, score, title FROM hits JOIN c ON chunk_id = id")


def file_graph(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "graph")
    SK.write_graph(*linking.graph(s, d), path)
    edges = s.read.schema(schemas.EDGE).json(f"{path}/edges")
    table = s.read.schema(schemas.EDGE).option("header", True).option("escape", '"').csv(f"{path}/edges_csv")
    count = lambda df, form: df.groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.countDistinct("source").alias("sources")).withColumn("form", F.lit(form))
    return count(edges, "json").unionByName(count(table, "csv"))


_COUNT = "SELECT type, count(*) AS n, sum(weight)::BIGINT AS weight, count(DISTINCT source) AS sources"
R.add("file_graph", file_graph, f"WITH g AS ({linking.R.oracle['graph_edges']}) {_COUNT}, 'json' AS form FROM g GROUP BY type UNION ALL {_COUNT}, 'csv' FROM g GROUP BY type")


def file_node_link(s: SparkSession, d: str) -> DataFrame:
    """The graph of tags (as many as there are kinds of tags) in node-link form."""
    path = shared_folder(s, "node_link")
    links = linking.tag_edges(s, d).select("source", "target", F.lit("together").alias("type"), "weight")
    nodes = links.select(F.col("source").alias("id")).union(links.select("target")).distinct().select("id", F.col("id").alias("label"), F.lit("tag").alias("type"))
    one = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "type"))).alias("nodes")).crossJoin(links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "type", "weight"))).alias("links")))
    one.coalesce(1).write.mode("overwrite").json(path)
    back, both = RD.node_link(s, path)
    return both.join(back.select(F.col("id").alias("source"), "label"), "source").select("source", "target", "weight", "label")


R.add("file_node_link", file_node_link, f"WITH {C}, {linking._PAIRS} SELECT source, target, weight, source AS label FROM (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e)")


def file_manifest(s: SparkSession, d: str) -> DataFrame:
    """The catalogue as the nested manifest, one file of all collections."""
    path = shared_folder(s, "manifest")
    table = read_table(s, d, "manifest")
    document = F.struct(*(c for c in table.columns if c != "collection_id"))
    nested = table.groupBy("collection_id").agg(F.array_sort(F.collect_list(document)).alias("documents"))
    nested.agg(F.array_sort(F.collect_list(F.struct("collection_id", "documents"))).alias("collections")).coalesce(1).write.mode("overwrite").json(path)
    return RD.manifest_json(s, path).select("collection_id", "document_id", "title", "author", "source_format")


R.add("file_manifest", file_manifest, "SELECT collection_id, document_id, title, author, source_format FROM manifest")


def file_bundle(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "bundle")
    matrix = reporting.R.queries["clause_issue_matrix"](s, d)
    SK.write_bundle({"matrix": matrix, "overview": reporting.R.queries["corpus_overview"](s, d)}, path)
    return s.read.schema(matrix.schema).json(f"{path}/matrix")


R.add("file_bundle", file_bundle, reporting.R.oracle["clause_issue_matrix"])


def file_bundles(s: SparkSession, d: str) -> DataFrame:
    """The combined texts of each source as folders of text: what is left of a source's sections, one after the other."""
    path = shared_folder(s, "bundles")
    documents = read_table(s, d, "documents").where("text is not null and source is not null")
    SK.write_combined(SK.combined_text(documents, "source", "doc_id", "date", "title", "text"), path)
    got = s.read.option("wholetext", True).text(path)
    heads = F.size(F.regexp_extract_all(F.col("value"), F.lit(r"(?m)^(=== .* ===)$"), F.lit(1)))
    return got.groupBy(F.col("group").cast("string").alias("source")).agg(F.sum(heads).cast("bigint").alias("sections"))


R.add("file_bundles", file_bundles, "SELECT source, count(*) AS sections FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")


def hit_rows(s: SparkSession, d: str) -> DataFrame:
    """The best hits with what their exports show; the beginning of the text stands for the snippet."""
    hits = S.top(searching.index(s, d).bm25_or([(t, 1.0) for t in searching.TERMS]), 10)
    c = chunks(s, d, "title", "author", "date", "source_collection", "text").withColumn("snippet", F.left("text", F.lit(60))).drop("text")
    ranked = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "matched_terms"))).alias("h")).select(F.posexplode("h").alias("at", "h"))  # ten rows
    return F.broadcast(ranked.select((F.col("at") + 1).alias("rank"), (-F.col("h.s")).alias("score"), "h.id", "h.matched_terms")).join(c, F.col("id") == F.col("chunk_id"))


_HIT = f"""hits AS ({searching.R.oracle['bm25_or_top10']}), {C}, m AS (SELECT (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS rank, score, c.*, text[:60] AS snippet FROM hits JOIN c ON chunk_id = id)"""
_QUOTED = lambda c: f"CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"
R.add(
    "hits_csv",
    lambda s, d: SK.hits_csv(hit_rows(s, d).withColumn("matched_terms", F.array().cast("array<string>"))),
    f"WITH {_HIT} SELECT rank, " + " || ',' || ".join([*map(_QUOTED, ("chunk_id", "title", "author", "date", "source_collection")), "printf('%.4f', score)", "''", _QUOTED("regexp_replace(snippet, '<[^>]*>', '', 'g')")]) + " AS line FROM m",
)
R.add(
    "hits_markdown",
    lambda s, d: SK.hits_markdown(hit_rows(s, d)),
    f"""WITH {_HIT} SELECT rank, '## ' || rank || '. ' || coalesce(title, '') || chr(10) || chr(10) || '*' || concat_ws(', ', nullif(author, ''), nullif(date, '')) || '*  ' || chr(10)
|| 'Collection: ' || coalesce(source_collection, '') || ' · Score: ' || printf('%.2f', score) || chr(10) || chr(10) || '> ' || coalesce(snippet, '') || chr(10) AS section FROM m""",
)
R.add(
    "hits_json",
    lambda s, d: SK.hits_json(hit_rows(s, d), "charter").select(F.from_json("value", "query string, total bigint, results array<struct<rank:int,score:double,chunk:struct<chunk_id:string,title:string>>>").alias("v")).select("v.query", "v.total", F.explode("v.results").alias("r")).select("query", "total", "r.rank", F.round("r.score", 6).alias("score"), "r.chunk.chunk_id", "r.chunk.title"),
    f"WITH {_HIT} SELECT 'charter' AS query, count(*) OVER () AS total, rank, score, chunk_id, title FROM m",
)
