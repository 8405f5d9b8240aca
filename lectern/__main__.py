"""Command line: python -m lectern build CORPUS ARCHIVE | search ARCHIVE QUERY | suggest | fuzzy | stats | analyse | process | citations | validate | snapshot | verify-snapshot."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.api import ANALYSES, Archive
from lectern.functions.records import fnv1a64
from lectern.operators.filters import Facets, Request
from lectern.operators.tables import difference
from lectern.sources import readers


def snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """path, bytes, checksum of the files under a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return files.select("path", F.col("length").alias("bytes"), fnv1a64("content").alias("checksum")).orderBy("path")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"build": ("corpus", "archive"), "search": ("archive", "query"), "suggest": ("archive", "prefix"), "fuzzy": ("archive", "term"), "stats": ("archive",), "validate": ("archive",), "snapshot": ("directory",), "verify-snapshot": ("directory", "against")}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    sub.choices["search"].add_argument("--limit", type=int, default=25)
    sub.choices["search"].add_argument("--fuzzy", type=int, default=0)
    sub.choices["search"].add_argument("--collection", action="append", default=[])
    sub.choices["snapshot"].add_argument("--against")
    analyse = sub.add_parser("analyse")
    analyse.add_argument("archive")
    analyse.add_argument("name", choices=sorted(ANALYSES))
    process = sub.add_parser("process", help="the events: list, get ID, find TEXT, phase NAME")
    process.add_argument("archive")
    process.add_argument("what", choices=("list", "get", "find", "phase"))
    process.add_argument("value", nargs="?")
    cited = sub.add_parser("citations", help="top, to KEY, from CHUNK, graph")
    cited.add_argument("archive")
    cited.add_argument("what", nargs="?", default="top", choices=("top", "to", "from", "graph"))
    cited.add_argument("value", nargs="?")
    cited.add_argument("--limit", type=int, default=25)
    a = p.parse_args(argv)
    if a.command in ("process", "citations") and a.what in ("get", "find", "phase", "to", "from") and not a.value:
        p.error(f"{a.command} {a.what} needs a value")
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if a.command == "build":
        Archive.of(readers.corpus_json(spark, a.corpus)).save(a.archive)
        return
    if a.command == "snapshot":
        now = snapshot(spark, a.directory)
        (difference(now, spark.read.parquet(a.against)) if a.against else now).show(1000, truncate=False)
        return
    if a.command == "verify-snapshot":
        changed = difference(snapshot(spark, a.directory), spark.read.parquet(a.against))
        changed.show(1000, truncate=False)
        if changed.limit(1).count():
            raise SystemExit(1)
        return
    archive = Archive.open(spark, a.archive)
    events = {"list": archive.timeline, "get": lambda: archive.timeline().where(F.col("id") == a.value), "find": lambda: archive.timeline(text=a.value), "phase": lambda: archive.timeline(phase=a.value)}
    citations = {"top": lambda: archive.citations_top(a.limit), "to": lambda: archive.citations_to(a.value, a.limit), "from": lambda: archive.citations_from(a.value), "graph": lambda: archive.citation_graph(a.limit)[1]}
    answer = {
        "search": lambda: archive.search(Request(a.query, a.limit, a.fuzzy, facets=Facets(collections=a.collection))).orderBy("rank"),
        "suggest": lambda: archive.suggest(a.prefix),
        "fuzzy": lambda: archive.fuzzy(a.term),
        "stats": archive.stats,
        "process": lambda: events[a.what](),
        "citations": lambda: citations[a.what](),
        "validate": archive.validate,
        "analyse": lambda: archive.analysis(a.name),
    }
    answer[a.command]().show(200, truncate=False)


if __name__ == "__main__":
    main()
