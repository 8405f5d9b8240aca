"""Graphs as two tables: a property graph of the archive, co-occurrence, neighbourhoods, shortest paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.records import stable_id
from lectern.operators.analytics import tags_of
from lectern.runtime import cut


def property_graph(chunks: DataFrame, citations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, type) and edges (source, target, type, weight) of chunks, documents, collections, authors, tags and what is cited.

    A node met again keeps the label of its first chunk in archive order; an edge met
    again gains weight.
    """
    lit = lambda p, c: F.concat(F.lit(p), F.coalesce(c, F.lit("")))
    c = chunks.select(
        "pos", lit("chunk:", F.col("chunk_id")).alias("chunk"), lit("document:", F.col("document_id")).alias("document"), lit("collection:", F.col("source_collection")).alias("collection"),
        stable_id("author", F.coalesce("author", F.lit(""))).alias("who"), "title", "author", "source_collection",
        F.transform(tags_of("issue_tags"), lambda t: F.struct(stable_id("issue", t).alias("id"), t.alias("label"))).alias("issues"),
        F.transform(tags_of("constitutional_clause_tags"), lambda t: F.struct(stable_id("clause", t).alias("id"), t.alias("label"))).alias("clauses"), "chunk_id",
    )
    node = lambda i, label, kind: F.struct(i.alias("id"), F.coalesce(label, F.lit("")).alias("label"), F.lit(kind).alias("type"))
    fixed = F.array(node(F.col("chunk"), F.col("title"), "chunk"), node(F.col("document"), F.col("title"), "document"), node(F.col("collection"), F.col("source_collection"), "collection"), node(F.col("who"), F.col("author"), "author"))
    tags = F.concat(F.transform("issues", lambda t: node(t["id"], t["label"], "issue")), F.transform("clauses", lambda t: node(t["id"], t["label"], "clause")))
    nodes = c.select("pos", "chunk_id", F.explode(F.concat(fixed, tags)).alias("n")).select("pos", "chunk_id", "n.*")
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    joins = F.array(edge(F.col("chunk"), F.col("document"), "belongs_to_document"), edge(F.col("document"), F.col("collection"), "belongs_to_collection"), edge(F.col("document"), F.col("who"), "authored_by"))
    marks = F.concat(F.transform("issues", lambda t: edge(F.col("chunk"), t["id"], "has_issue")), F.transform("clauses", lambda t: edge(F.col("chunk"), t["id"], "mentions_clause")))
    edges = c.select(F.explode(F.concat(joins, marks)).alias("e")).select("e.*")
    if citations is not None:
        kind = F.when(F.col("kind") == "person", "person").otherwise("reference")
        cited = citations.select("id", stable_id(kind, F.col("target")).alias("ref"), "target", kind.alias("type")).distinct()
        at = cited.join(chunks.select(F.col("chunk_id").alias("id"), "pos"), "id")
        nodes = nodes.unionByName(at.select("pos", F.col("id").alias("chunk_id"), F.col("ref").alias("id"), F.col("target").alias("label"), "type"))
        edges = edges.unionByName(cited.select(F.concat(F.lit("chunk:"), "id").alias("source"), F.col("ref").alias("target"), F.lit("mentions").alias("type")))
    first = nodes.groupBy("id", "type").agg(F.min_by("label", F.struct("pos", "chunk_id")).alias("label")).select("id", "label", "type")
    return first, edges.groupBy("source", "target", "type").agg(F.count("*").alias("weight"))


def entity_co_occurrence(df: DataFrame, id_col: str, entities: Column, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of entities that share at least ``least`` texts; entities of one text are counted once.

    ``entities`` is an array column of names (a gazetteer's finds in place of a model's).
    """
    per = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(entities, lambda e: F.length(e) > 2))).alias("t"))
    pairs = per.select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("source"), b.alias("target")))))).alias("p")).select("p.*")
    edges = pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected edge table with every edge from both of its ends."""
    e = edges.select("source", "target")
    return e.union(e.select("target", "source")).where("source <> target").distinct()


def ego(edges: DataFrame, centre: str, depth: int = 2, most_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """node, distance of the nodes within ``depth`` steps, nearest first up to the cap; edges between nodes that were expanded.

    Level by level: the frontier is joined with the edges, and cut at the cap in order
    of name, so the result is small whatever the graph. An edge is listed when its smaller
    end was expanded.
    """
    depth, most_nodes = min(depth, 4), min(most_nodes, 500)
    spark = edges.sparkSession
    graph = cut(both_ways(edges))
    seen = {centre: 0}
    expanded: list[str] = []
    frontier = [centre]
    for level in range(1, depth + 1):
        if not frontier or len(seen) >= most_nodes:
            break
        expanded += frontier
        at = F.broadcast(spark.createDataFrame([(x,) for x in frontier], "source string"))  # at most the cap
        known = F.broadcast(spark.createDataFrame([(x,) for x in seen], "target string"))
        found = graph.join(at, "source").select("target").distinct().join(known, "target", "left_anti").orderBy("target").limit(most_nodes - len(seen)).collect()
        frontier = [r.target for r in found]
        seen.update(dict.fromkeys(frontier, level))
    nodes = spark.createDataFrame([*seen.items()], "node string, distance int")
    done = F.broadcast(spark.createDataFrame([(x,) for x in expanded], "source string"))
    return nodes, graph.join(done, "source").where("source < target").select("source", "target")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """step, node of a shortest path; of several the one that is first in order of its names; no rows if there is none.

    Breadth first: each round extends the reached nodes by one step and keeps the
    smallest parent of every new node; only node and parent are kept, no path arrays.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, node string")
    graph = cut(both_ways(edges))
    reached = spark.createDataFrame([(start, None, 0)], "node string, parent string, step int")
    frontier = reached
    for step in count(1):
        found = graph.join(frontier.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        frontier = cut(found.join(reached.select("node"), "node", "left_anti").select("node", "parent", F.lit(step).alias("step")))
        reached = cut(reached.unionByName(frontier))
        if frontier.where(F.col("node") == end).limit(1).count():
            path, at = [end], end
            while at != start:  # as many rows as the path has steps
                at = reached.where(F.col("node") == at).first().parent
                path.append(at)
            return spark.createDataFrame([*enumerate(reversed(path))], "step int, node string")
        if not frontier.limit(1).count():
            return spark.createDataFrame([], "step int, node string")


def strongest(edges: DataFrame, node: str, n: int) -> DataFrame:
    ends = edges.select("source", "target", "weight").union(edges.select("target", "source", "weight"))
    return ends.where(F.col("source") == node).orderBy(F.desc("weight"), "target").limit(n)
