"""Readers: from files of many shapes to tables with declared schemas."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schemas as S
from lectern.functions import text as X
from lectern.operators.tables import latest

VERSION = 2


# corpora ------------------------------------------------------------------------


def _defaults(df: DataFrame) -> DataFrame:
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    return df.select(*(F.coalesce(c, empty[t]).alias(c) if c in S.CHUNK_OPTIONAL else F.col(c) for c, t in df.dtypes))


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of corpus files {"metadata", "chunks"}: absent fields are empty, pos is the place in the file."""
    schema = f"chunks array<{S.struct(S.CHUNK_FIELDS)}>"
    chunks = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("chunks").alias("at", "c"))
    return _defaults(chunks.select(*(F.col(f"c.{f}") if f != "pos" else F.coalesce("c.pos", F.col("at")).cast("bigint").alias("pos") for f in S.CHUNK_FIELDS)))


def timeline_json(spark: SparkSession, path: str) -> DataFrame:
    """Events in order of date; unknown phases are refused when read."""
    df = spark.read.schema(S.EVENT).json(path, multiLine=True)
    known = F.when(F.col("phase").isin(*S.PHASES), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown phase: "), F.coalesce("phase", F.lit("null")))).cast("boolean"))
    return df.where(known).orderBy("date", "id")


def manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the nested manifest, with its collection."""
    docs = spark.read.schema(S.MANIFEST).json(path, multiLine=True).select(F.explode("collections").alias("c")).select("c.collection_id", F.explode("c.documents").alias("d"))
    return docs.select("collection_id", "d.*")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def text_files(spark: SparkSession, directory: str) -> DataFrame:
    """document_id (the file's stem), text of the .txt files of a directory."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(directory, wholetext=True)
    return df.select(stem(F.col("_metadata.file_path")).alias("document_id"), F.col("value").alias("text"))


def raw_files(spark: SparkSession, manifest: DataFrame, directory: str) -> DataFrame:
    """collection_id, document_id, text, status of each manifest document's raw file, ``skipped_missing_raw`` where there is none.

    Files are <directory>/<collection>/<document>/source.html or .txt.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "source.*").text(directory, wholetext=True)
    parts = F.split("_metadata.file_path", "/")
    named = files.select(F.element_at(parts, -3).alias("collection_id"), F.element_at(parts, -2).alias("document_id"), F.element_at(F.split(F.element_at(parts, -1), r"\."), -1).alias("extension"), F.col("value").alias("text"))
    wanted = manifest.select("collection_id", "document_id", F.when(F.col("source_format") == "html", "html").otherwise("txt").alias("extension"))
    joined = wanted.join(named, ["collection_id", "document_id", "extension"], "left")
    return joined.select("collection_id", "document_id", "text", F.when(F.col("text").isNull(), "skipped_missing_raw").otherwise("read").alias("status"))


def load_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive directory; an archive of another kind or version is refused."""
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/_meta.json").collect()))  # one short file
    if meta.get("kind") != "archive" or meta.get("version") != VERSION:
        raise ValueError(f"not an archive of version {VERSION}: {meta}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


# graphs and vectors ---------------------------------------------------------------


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes, and edges with every undirected link from both ends."""
    df = spark.read.schema(S.NODE_LINK).json(path, multiLine=True)
    nodes = df.select(F.explode("nodes").alias("n")).select("n.*")
    links = df.select(F.explode("links").alias("l")).select("l.source", "l.target", "l.type", F.coalesce("l.weight", F.lit(1)).cast("bigint").alias("weight"))
    return nodes, links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "type", "weight"))


def flat_vectors(spark: SparkSession, path: str, ids: Sequence[str], dim: int = 768) -> DataFrame:
    """id, embedding of a file of little-endian float32 rows; another size than ids x dim is refused."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                flat = np.frombuffer(content, "<f4")
                if flat.size != len(ids) * dim:
                    raise ValueError(f"{flat.size * 4} bytes are no {len(ids)} vectors of {dim}")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(flat.reshape(-1, dim)), pa.list_(pa.float32()))], ["id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "id string, embedding array<float>")


# transcripts and cases -------------------------------------------------------------


def transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """title, date, text of transcript files: one paragraph a piece of speech, files of bad JSON left out."""
    df = spark.read.schema(S.TRANSCRIPT).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    said = F.flatten(
        F.transform(
            F.flatten(F.transform("caseTranscripts", lambda t: t["transcript"])),
            lambda s: F.transform(F.filter(s["textObjs"], lambda o: F.coalesce(o["text"], F.lit("")) != ""), lambda o: F.concat(F.lit("["), F.coalesce(s["speakerName"], F.lit("Unknown")), F.lit("]: "), o["text"])),
        )
    )
    return df.select(F.concat(F.coalesce("caseName", F.lit("")), F.lit(" (Oral Argument Transcript)")).alias("title"), F.coalesce("term", F.lit("")).alias("date"), F.array_join(said, "\n\n").alias("text"))


def flatten_speech(rows: DataFrame) -> DataFrame:
    """transcript_id, text: a transcript's rows in order of speech as ``[speaker]: text`` paragraphs."""
    once = rows.where("text is not null and text <> ''").dropDuplicates(["seg_id"])
    ordered = F.array_sort(F.collect_list(F.struct("start", "seg_id", F.concat(F.lit("["), F.coalesce("speakername", F.lit("Unknown")), F.lit("]: "), "text").alias("s"))))
    return once.groupBy("transcript_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("text"))


def cases_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a CSV file with a header, null as empty."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty: the plain text of a page, else its other forms."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def opinions(df: DataFrame, most: int) -> DataFrame:
    return df.select("id", first_filled(F.col("plain_text"), X.strip_tags(F.col("html_with_citations")), X.strip_tags(F.col("html_lawbox"))).alias("text")).where("text is not null").orderBy("id").limit(most)


# metadata of letters ----------------------------------------------------------------

#: Other names of fields. Fixed values.
ALIASES = {
    "permalink": ("permalink", "url", "uri", "link"), "identifier": ("id", "identifier", "document-id", "document_id"), "title": ("title", "display-title", "document-title"),
    "project": ("project", "papers", "collection"), "date_from": ("date-from", "date_from", "date"), "date_to": ("date-to", "date_to"),
}
WRAPPERS = ("documents", "records", "items", "data")


def _json_field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$['{name}']")


def _strings(value: Column) -> Column:
    """A JSON string, list of strings or list of objects with a name, as an array."""
    listed = F.from_json(value, "array<string>")
    named = F.transform(listed, lambda v: F.when(F.startswith(v, F.lit("{")), F.coalesce(*(_json_field(v, k) for k in ("name", "value", "display")))).otherwise(v))
    one = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))
    return F.array_distinct(F.filter(F.when(F.startswith(value, F.lit("[")), named).otherwise(one), lambda v: v.isNotNull() & (v != "")))


def letter_metadata(payloads: DataFrame, json_col: str, primary_only: bool = False) -> DataFrame:
    """Records of metadata documents: a list, or an object with a list under one of some names; fields by their other names.

    Records without an identifier are dropped, with ``primary_only`` those without a date too.
    """
    c = F.col(json_col)
    inner = F.coalesce(*(_json_field(c, w) for w in WRAPPERS))
    items = F.from_json(F.when(F.startswith(F.ltrim(c), F.lit("[")), c).otherwise(inner), "array<string>")
    r = payloads.select(F.explode(items).alias("r"))
    pick = lambda f: F.coalesce(*(F.nullif(_json_field(F.col("r"), a), F.lit("")) for a in ALIASES[f]))
    from lectern.functions.records import permalink_id

    named = r.select(*(pick(f).alias(f) for f in ALIASES), _strings(F.coalesce(_json_field(F.col("r"), "authors"), _json_field(F.col("r"), "author"))).alias("authors"), _strings(F.coalesce(_json_field(F.col("r"), "recipients"), _json_field(F.col("r"), "recipient"))).alias("recipients"))
    out = named.withColumn("identifier", F.coalesce("identifier", F.nullif(permalink_id(F.col("permalink")), F.lit("")))).where("identifier is not null")
    empty = lambda f: F.coalesce(f, F.lit("")).alias(f)
    out = out.select("identifier", F.coalesce("title", "identifier").alias("title"), empty("permalink"), empty("project"), "authors", "recipients", empty("date_from"), empty("date_to"))
    return out.where("date_from <> ''") if primary_only else out


def newest_per_country(df: DataFrame) -> DataFrame:
    """One row a country: the newest of its years, the first of equals in the order of the list."""
    year = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in ("year_updated", "year_revised", "year_enacted")))
    return latest(df.withColumn("year", year), ["country"], F.desc("year"), F.col("pos"))


def in_force(df: DataFrame) -> DataFrame:
    return df.where("public and in_force and not is_draft and not is_historic").orderBy("region", "country", "id")


# marked-up pages --------------------------------------------------------------------


def alto_text(xml: Column) -> Column:
    """The words of a page of ALTO XML, punctuation drawn to the word before it; bad XML is empty."""
    words = F.regexp_extract_all(xml, F.lit(r'<String\b[^>]*\bCONTENT="([^"]*)"'), F.lit(1))
    return F.regexp_replace(X.unescape(F.array_join(words, " ")), r"\s+([,.;:!?])", "$1")


def tei_text(xml: Column) -> Column:
    """Heads, then paragraphs of a TEI volume, one paragraph each."""
    part = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    plain = F.transform(F.concat(part("head"), part("p")), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " ")))
    return F.regexp_replace(X.unescape(F.array_join(F.filter(plain, lambda s: s != ""), "\n\n")), r"[ \t]+([,.;:!?])", "$1")


def zip_members(df: DataFrame, content: str, pattern: str) -> DataFrame:
    """path, member, text of the members of archives whose name fits a pattern."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(path, m, z.read(m).decode("utf-8", "replace")) for m in sorted(z.namelist()) if re.search(pattern, m)]
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return df.select("path", F.col(content).alias("content")).mapInPandas(read, "path string, member string, text string")


def dated_sections(df: DataFrame, id_col: str, html: str, first: int, last: int, least_words: int = 20) -> DataFrame:
    """id, seq, year, text of the h2 sections of a page with a dated class in a range of years and enough words."""
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(html), "(?=<h2)")).alias("seq", "part"))
    year = F.regexp_extract("part", r'class="date"[^>]*>[^<]*?(1[5-9]\d\d)', 1).try_cast("int")
    text = X.strip_tags(F.col("part"))
    return parts.select("id", "seq", year.alias("year"), text.alias("text")).where(F.col("year").between(first, last) & (X.word_count(F.col("text")) >= least_words))


def line_range(df: DataFrame, id_col: str, text: str, start: str, end: str, header: str) -> DataFrame:
    """id, text: the lines from a start pattern (back to the header line before it) up to an end pattern."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("head", F.last(F.when(F.col("line").rlike(header), F.col("at")), ignorenulls=True).over(w))
    begin = marked.where(F.col("line").rlike(start)).groupBy("id").agg(F.min_by(F.coalesce("head", "at"), "at").alias("a"), F.min("at").alias("hit"))
    stop = marked.where(F.col("line").rlike(end)).select("id", F.col("at").alias("b"))
    bounds = begin.join(stop, "id", "left").groupBy("id", "a", "hit").agg(F.min(F.when(F.col("b") > F.col("hit"), F.col("b"))).alias("b"))
    kept = lines.join(bounds, "id").where("at >= a and (b is null or at < b)")
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))


def container_text(html: Column, marker: str) -> Column:
    """The text of the first div whose attributes fit a pattern, tags stripped, in single blanks."""
    inner = F.regexp_extract(html, rf"(?is)<div[^>]*{marker}[^>]*>(.*?)</div>", 1)
    return F.trim(F.regexp_replace(X.unescape(F.regexp_replace(inner, "<[^>]+>", " ")), r"\s+", " "))


def embedded_list(page: Column, name: str, schema: str) -> Column:
    """A JSON array of a page's script, by name; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(page, rf'(?s)"{name}"\s*:\s*(\[.*?\])', 1), F.lit("")), schema)


def posts(spark: SparkSession, directory: str, excerpt: int = 220) -> DataFrame:
    """slug, title, date, excerpt, body of Markdown files with front matter, newest first; those without slug or title left out."""
    df = spark.read.option("pathGlobFilter", "*.md").text(directory, wholetext=True)
    front = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n?", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n?", ""))
    pairs = F.filter(F.split(front, "\n"), lambda p: F.contains(p, F.lit(":")))
    key = lambda p: F.trim(F.substring_index(p, ":", 1))
    fields = F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p), F.trim(F.regexp_replace(F.regexp_replace(p, "^[^:]*:", ""), '"', "")))))
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"[#*_`>\[\]]", ""), r"\s+", " "))
    out = df.select(fields["slug"].alias("slug"), fields["title"].alias("title"), F.coalesce(fields["date"], F.lit("")).alias("date"), X.preview(plain, excerpt).alias("excerpt"), body.alias("body"))
    return out.where("slug is not null and title is not null").orderBy(F.desc("date"), "slug")


def candidates(df: DataFrame, id_col: str, title: str, tokens: Sequence[str], tried: DataFrame) -> DataFrame:
    """Rows whose id or title holds one of a name's tokens and that were not tried yet."""
    hay = F.lower(F.concat_ws(" ", F.col(id_col), F.col(title)))
    hit = F.exists(F.array(*(F.lit(t.lower()) for t in tokens)), lambda t: F.contains(hay, t))
    return df.where(hit).join(tried.select(F.col("id").alias(id_col)), id_col, "left_anti")


def landing(records: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """key, status of what a fetcher was asked for: ``cached`` where a file has landed, else ``pending``; fetching itself is not the engine's."""
    have = landed.select(key).distinct().withColumn("have", F.lit(True))
    return records.select(key).join(have, key, "left").select(key, F.when(F.col("have"), "cached").otherwise("pending").alias("status"))
