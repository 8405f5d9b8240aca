"""The archive as one object: what its services answer, each as a DataFrame.

    archive = Archive.open(spark, path)        # or Archive.of(chunks), with events and links on request
    archive.search(Request("charter liberty", fuzzy=1))
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import citations as CI
from lectern.operators import filters as FL
from lectern.operators import graphs as G
from lectern.operators import search as S
from lectern.operators import tables as T
from lectern.operators import vectors as V
from lectern.operators.filters import Request
from lectern.runtime import keep
from lectern.sources import readers, sinks


class NotFound(LookupError):
    """What was asked for by its id is not in the archive."""


@dataclass
class Archive:
    chunks: DataFrame
    index: S.PostingIndex
    citations: DataFrame
    events: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None

    @staticmethod
    def of(chunks: DataFrame, events: DataFrame | None = None, edges: DataFrame | None = None, vectors: DataFrame | None = None) -> Archive:
        """An archive of chunks; a chunk delivered twice counts once. The index and the citations are derived."""
        columns = [c for c in chunks.columns if c in schemas.CHUNK_FIELDS]
        once = keep(A.once(chunks, "chunk_id", *columns, delivered="ingested_at" if "ingested_at" in chunks.columns else None))
        index = S.PostingIndex.build(once, "chunk_id", X.tokens_archive(F.col("text")), cached=True)
        return Archive(once, index, keep(CI.extract(once, "chunk_id", "text")), events, edges, vectors)

    def save(self, path: str) -> None:
        """chunks, postings, lengths and, where there are any, events and links; citations are derived again."""
        tables = {"chunks": self.chunks, "postings": self.index.postings, "lengths": self.index.stats, "terms": self.index.terms, "events": self.events, "edges": self.edges}
        sinks.write_archive(self.chunks.sparkSession, path, {n: df for n, df in tables.items() if df is not None})

    @staticmethod
    def open(spark: SparkSession, path: str) -> Archive:
        t = readers.load_archive(spark, path)
        return Archive(t["chunks"], S.PostingIndex(t["postings"], t["lengths"], t["terms"]), CI.extract(t["chunks"], "chunk_id", "text"), t.get("events"), t.get("edges"))

    # search
    def search(self, request: Request) -> DataFrame:
        """rank, chunk fields, score, matched_terms, snippet of the best hits; the filter acts before the limit."""
        r = request.capped()
        terms = X.archive_terms(r.query)
        asked = self.index.expand(terms, r.fuzzy)
        allowed = self.chunks.where(r.facets.column()).select(F.col("chunk_id").alias("id"))
        best = self.index.bm25_or(asked, allowed, r.min_score or None).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(r.limit)
        rows = F.broadcast(best).join(self.chunks, F.col("id") == F.col("chunk_id"))  # at most 200 rows
        cut = X.snippet(F.col("text"), [t for t, _ in asked], r.snippet)
        ranked = rows.withColumn("s", cut).withColumn("rank", F.row_number().over(S.Window.orderBy(F.desc("score"), "id")))
        return ranked.select("rank", "chunk_id", "document_id", "title", "author", "date", "source_collection", "score", "matched_terms", X.marked(F.col("s.text"), F.col("s.highlights")).alias("snippet"))

    def search_all_terms(self, query: str, limit: int = FL.LIMIT) -> DataFrame:
        return S.top(self.index.bm25_and(X.archive_terms(query)), min(limit, FL.MOST_HITS))

    def search_by(self, kind: str, query: str, limit: int = 50) -> DataFrame:
        """``fulltext`` (all terms), ``fuzzy`` (within two edits) or ``semantic`` (nearest vectors)."""
        engines = {
            "fulltext": lambda: self.search_all_terms(query, limit),
            "fuzzy": lambda: S.fuzzy_chunks(self.chunks, "chunk_id", "pos", X.tokens_archive(F.col("text")), query, 2).orderBy("distance", "id").limit(limit),
            "semantic": lambda: self.nearest(query, limit),
        }
        return S.dispatch(kind, engines)

    def nearest(self, query: str, k: int = 50) -> DataFrame:
        """By the vectors of the archive, or by the stand-in embedding of the texts."""
        vectors = self.vectors if self.vectors is not None else self.chunks.select("chunk_id", V.byte_embedding(F.col("text")).alias("embedding"))
        q = self.chunks.sparkSession.createDataFrame([(query,)], "q string").select(V.byte_embedding(F.col("q")).alias("v")).first().v
        return V.nearest(vectors, "chunk_id", "embedding", q, k)

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        return S.suggest(self.index.terms, prefix, limit)

    def fuzzy(self, term: str, distance: int = 2, limit: int = 10) -> DataFrame:
        if not term:
            raise ValueError("empty term")
        return S.fuzzy_terms(self.index.terms, term.lower(), min(distance, 3), min(limit, 50))

    def chunk(self, chunk_id: str) -> DataFrame:
        found = self.chunks.where(F.col("chunk_id") == chunk_id)
        if not found.limit(1).count():
            raise NotFound(chunk_id)
        return found

    # events
    def timeline(self, phase: str | None = None, date: str | None = None, text: str | None = None) -> DataFrame:
        df = self.events if self.events is not None else self.chunks.sparkSession.createDataFrame([], schemas.EVENT)
        if phase is not None:
            if phase not in schemas.PHASES:
                raise ValueError(f"unknown phase: {phase}")
            df = df.where(F.col("phase") == phase)
        if date:
            df = df.where(F.startswith("date", F.lit(date)))
        if text:
            df = df.where(FL.event_text(text))
        return df.orderBy("date", "id")

    def event_chunks(self, event_id: str) -> DataFrame:
        event = self.timeline().where(F.col("id") == event_id)
        if not event.limit(1).count():
            raise NotFound(event_id)
        ids = event.select(F.explode("source_chunks").alias("chunk_id")).distinct()
        return self.chunks.join(F.broadcast(ids), "chunk_id").orderBy("pos", "chunk_id")

    # citations and links
    def citations_top(self, n: int = 25) -> DataFrame:
        return CI.top_targets(self.citations, min(n, 500))

    def citations_to(self, key: str, n: int = 50) -> DataFrame:
        ids = CI.cited_by(self.citations, key).select(F.col("id").alias("chunk_id")).distinct()
        return self.chunks.join(ids, "chunk_id", "left_semi").orderBy("date", "chunk_id").limit(min(n, 500))

    def citations_from(self, chunk_id: str) -> DataFrame:
        return CI.outgoing(self.citations.where(F.col("id") == chunk_id))

    def citation_graph(self, n: int = 30) -> tuple[DataFrame, DataFrame]:
        return CI.co_citation(self.citations, min(max(n, 2), 200))

    def _links(self) -> DataFrame:
        if self.edges is None:
            raise ValueError("the archive has no graph")
        return self.edges

    def connections(self, node: str, n: int = 20) -> DataFrame:
        return G.strongest(self._links(), node, n)

    def ego(self, node: str, depth: int = 2, nodes: int = 100) -> tuple[DataFrame, DataFrame]:
        return G.ego(self._links(), node, depth, nodes)

    def path(self, start: str, end: str) -> DataFrame:
        return G.shortest_path(self._links(), start, end)

    # analyses
    def stats(self) -> DataFrame:
        terms = self.index.terms.count()
        n_events = 0 if self.events is None else self.events.count()
        counted = self.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("source_collection").alias("collections"), F.countDistinct("author").alias("authors"))
        return counted.select("*", F.lit(terms).alias("terms"), F.lit(n_events).alias("events"), F.lit(self.citations.count()).alias("citations"))

    def analysis(self, name: str) -> DataFrame:
        if name not in ANALYSES:
            raise NotFound(name)
        return ANALYSES[name](self.chunks)

    def filtered(self, names: Sequence[str], **facets) -> dict[str, DataFrame]:
        """Analyses of the chunks that fit exact facets and a range of dates."""
        start, end = facets.pop("start", None), facets.pop("end", None)
        df = self.chunks.where(FL.exact_facets(**facets) & FL.dates_between(start, end))
        return {n: ANALYSES[n](df) for n in names}

    def compare(self, a: str, b: str) -> DataFrame:
        return A.compare_authors(self.chunks, a, b)

    def validate(self) -> DataFrame:
        return T.validation(self.chunks)


ANALYSES = {
    "overview": A.overview,
    "clauses": lambda df: A.tag_analysis(df, A.CLAUSES, A.ISSUES, 30),
    "issues": lambda df: A.tag_analysis(df, A.ISSUES, A.CLAUSES, 20),
    "collections": lambda df: A.rollup_by(df, "source_collection"),
    "authors": lambda df: A.rollup_by(df, "author"),
    "documents": A.document_analysis,
    "matrix": lambda df: A.tag_matrix(df, A.CLAUSES, A.ISSUES),
    "author_matrix": lambda df: A.matrix(df, F.col("author"), A.tags_of(A.CLAUSES)),
    "words": lambda df: A.word_frequency(df, "text"),
    "sizes": lambda df: A.size_histogram(df, "word_count"),
    "temporal": A.temporal,
    "evolution": A.yearly_evolution,
    "network": lambda df: A.pair_network(df, A.tags_of(A.CLAUSES)),
    "influence": A.author_influence,
    "clusters": A.primary_clusters,
    "author_dossiers": A.author_dossiers,
    "collection_dossiers": A.collection_dossiers,
    "pairs": lambda df: A.chunk_similarity(df, 200),
}
