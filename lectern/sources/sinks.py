"""Writers: archives, JSON, CSV, Markdown, reports. Text forms are built as columns, so writing stays distributed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import records as R
from lectern.functions import text as X
from lectern.operators import tables as T
from lectern.operators import tables as T
from lectern.sources.readers import VERSION


def write_archive(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """A parquet directory a table, postings clustered by term, and a version that readers check."""
    for name, df in tables.items():
        (df.repartitionByRange("term").sortWithinPartitions("term") if "term" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(json.dumps({"kind": "archive", "version": VERSION, "tables": sorted(tables)}),)], "value string")
    meta.coalesce(1).write.mode("overwrite").text(f"{path}/_meta.json")


def corpus_document(df: DataFrame, skipped: list[str] | None = None) -> DataFrame:
    """One row: a corpus as a JSON document with counts. Meant for exports of a size that one file holds."""
    cols = [c for c in df.columns]
    return df.agg(
        F.to_json(F.struct(
            F.struct(F.count("*").alias("total_chunks"), F.countDistinct("document_id").alias("total_documents"), F.array(*map(F.lit, skipped or [])).cast("array<string>").alias("skipped")).alias("metadata"),
            F.array_sort(F.collect_list(F.struct(*cols))).alias("chunks"),
        )).alias("value")
    )


def csv_rows(df: DataFrame) -> DataFrame:
    """The twelve columns of the CSV export, tags joined by bars."""
    tags = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|").alias(c)
    return df.select("chunk_id", "document_id", "title", "author", "date", "source_collection", "source_url", "document_type", tags("issue_tags"), tags("constitutional_clause_tags"), "word_count", "text")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Lines of JSON with sorted keys; the number of them."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def quoted(c: Column) -> Column:
    """A CSV field, quoted where it must be."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def hits_csv(hits: DataFrame) -> DataFrame:
    """rank, line of search results: score to four digits, terms by blanks, tags out of the snippet."""
    fields = [F.col("chunk_id"), F.col("title"), F.col("author"), F.col("date"), F.col("source_collection"), F.format_string("%.4f", F.col("score")), F.array_join("matched_terms", " "), F.regexp_replace("snippet", "<[^>]*>", "")]
    return hits.select("rank", F.concat_ws(",", *(quoted(f) for f in fields)).alias("line"))


def hits_json(hits: DataFrame, query: str) -> DataFrame:
    """One row: query, total and the results with their chunks, in order."""
    chunk = F.struct("chunk_id", "title", "author", "date", "source_collection")
    row = F.struct("rank", F.col("score"), F.col("matched_terms"), F.col("snippet"), chunk.alias("chunk"))
    return hits.agg(F.to_json(F.struct(F.lit(query).alias("query"), F.count("*").alias("total"), F.array_sort(F.collect_list(row)).alias("results"))).alias("value"))


def hits_markdown(hits: DataFrame) -> DataFrame:
    """rank, section of search results in Markdown."""
    return hits.select(
        "rank",
        F.concat(
            F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n\n*"), F.concat_ws(", ", F.nullif("author", F.lit("")), F.nullif("date", F.lit(""))), F.lit("*  \n"),
            F.lit("Collection: "), F.coalesce("source_collection", F.lit("")), F.lit(" · Score: "), F.format_string("%.2f", F.col("score")), F.lit("\n\n> "), F.coalesce("snippet", F.lit("")), F.lit("\n"),
        ).alias("section"),
    )


def references(df: DataFrame) -> DataFrame:
    """chunk_id, key, bibtex, ris, plain, markdown of each chunk."""
    c = [F.col(x) for x in ("chunk_id", "title", "author", "date", "source_collection", "source_url")]
    return df.select(
        "chunk_id", R.citation_key(F.col("author"), F.col("date"), F.col("title"), F.col("chunk_id")).alias("key"), R.bibtex(*c).alias("bibtex"), R.ris(*c).alias("ris"), R.plain_reference(*c[1:]).alias("plain"),
        R.front_matter(*c, F.col("issue_tags"), F.col("constitutional_clause_tags"), F.col("text")).alias("markdown"),
    )


def client_rows(df: DataFrame) -> DataFrame:
    """The nine columns of the client's export, text in single blanks."""
    return df.select("chunk_id", "document_id", "title", "author", "date", "source_collection", F.array_join(F.coalesce("issue_tags", F.array().cast("array<string>")), "; ").alias("issues"), F.array_join(F.coalesce("constitutional_clause_tags", F.array().cast("array<string>")), "; ").alias("clauses"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def combined_text(df: DataFrame, group: str, id_col: str, date: str, title: str, text: str) -> DataFrame:
    """group, occurrence, id, words, section: a group's records in order of date and id under headings.

    A row a record with its number in the group, so that a group of any size is no single
    row; ``write_combined`` puts them into files.
    """
    section = F.concat(F.lit("=== "), F.coalesce(F.col(title), F.lit("")), F.lit(" ("), F.coalesce(F.col(date), F.lit("")), F.lit(") ===\n"), F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.coalesce(F.col(date), F.lit("")).alias("date"))
    places = T.numbered(rows, ["group"], F.col("date"), F.col("id")).select("id", "occurrence")  # no texts are put in order
    texts = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), X.word_count(F.col(text)).alias("words"), section.alias("section"))
    return texts.join(places, "id").select("group", "occurrence", "id", "words", "section")


def write_combined(sections: DataFrame, path: str) -> None:
    """A folder of text a group, its files and their lines in order; a great group is in several files."""
    ordered = sections.repartitionByRange("group", "occurrence").sortWithinPartitions("group", "occurrence")
    ordered.select("group", F.concat("section", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("group").text(path)


def ingest_summary(df: DataFrame) -> DataFrame:
    """One row: a Markdown summary of fetch states (document_id, status, error)."""
    counts = df.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.concat(F.lit("| "), "document_id", F.lit(" | "), F.coalesce("error", F.lit("")), F.lit(" |"))))).alias("failed"))
    listed = F.array_sort(F.collect_list(F.concat(F.lit("- "), "status", F.lit(": "), F.col("n").cast("string"))))
    return counts.agg(F.concat(F.lit("# Ingest\n\n"), F.array_join(listed, "\n"), F.lit("\n\n| document | error |\n|-|-|\n"), F.array_join(F.array_sort(F.flatten(F.collect_list("failed"))), "\n")).alias("value"))


def write_bundle(reports: dict[str, DataFrame], path: str) -> None:
    """A JSON directory an analysis."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_dossiers(df: DataFrame, key: str, path: str) -> None:
    """A directory of JSON a dossier, and an index as CSV."""
    slugged = df.withColumn("slug", X.slug(F.col(key), "none"))
    slugged.write.mode("overwrite").partitionBy("slug").json(f"{path}/dossiers")
    write_csv(slugged.select("slug", *(c for c, t in df.dtypes if not t.startswith(("array", "map", "struct")))), f"{path}/index")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    write_csv(edges, f"{path}/edges_csv")
