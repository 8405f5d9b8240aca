"""Predicates over chunks and events, as columns for ``where``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT, MOST_HITS, MOST_DISTANCE, SNIPPET, MOST_SNIPPET = 25, 200, 3, 240, 1024


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_of(c: Column, values: Sequence[str]) -> Column:
    """Equal to one of the values but for the case of A-Z."""
    return ascii_lower(c).isin(*{v.lower() for v in values})


def contains_any(c: Column, values: Sequence[str]) -> Column:
    low = F.lower(c)
    return reduce(or_, (F.contains(low, F.lit(v.lower())) for v in values))


def tags_overlap(tags: Column, values: Sequence[str]) -> Column:
    wanted = {v.lower() for v in values}
    return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(ascii_lower(t).isin(*wanted), F.lit(False)))


@dataclass(frozen=True)
class Facets:
    """A conjunction of facets; within a facet one value is enough, an empty facet asks nothing."""

    collections: Sequence[str] = ()
    document_types: Sequence[str] = ()
    authors: Sequence[str] = ()
    issues: Sequence[str] = ()
    clauses: Sequence[str] = ()
    date_prefix: str | None = None
    more: Sequence[Column] = field(default=())

    def column(self) -> Column:
        tests = list(self.more)
        if self.collections:
            tests.append(one_of(F.col("source_collection"), self.collections))
        if self.document_types:
            tests.append(one_of(F.col("document_type"), self.document_types))
        if self.authors:
            tests.append(contains_any(F.col("author"), self.authors))
        if self.issues:
            tests.append(tags_overlap(F.col("issue_tags"), self.issues))
        if self.clauses:
            tests.append(tags_overlap(F.col("constitutional_clause_tags"), self.clauses))
        if self.date_prefix:
            tests.append(F.startswith(F.col("date"), F.lit(self.date_prefix)))
        return reduce(and_, tests, F.lit(True))


@dataclass(frozen=True)
class Request:
    """A search request with the caps of the service."""

    query: str
    limit: int = LIMIT
    fuzzy: int = 0
    snippet: int = SNIPPET
    min_score: float = 0.0
    facets: Facets = Facets()

    def capped(self) -> Request:
        if not self.query.strip():
            raise ValueError("empty query")
        return Request(self.query, min(self.limit, MOST_HITS), min(self.fuzzy, MOST_DISTANCE), min(self.snippet, MOST_SNIPPET), self.min_score, self.facets)


def exact_facets(collections: Sequence[str] = (), authors: Sequence[str] = (), clauses: Sequence[str] = (), issues: Sequence[str] = ()) -> Column:
    """Facets of the analyses: the collection is the chunk id's first part, values are compared exactly."""
    tests = []
    if collections:
        tests.append(F.substring_index("chunk_id", "_", 1).isin(*collections))
    if authors:
        tests.append(F.col("author").isin(*authors))
    if clauses:
        tests.append(F.arrays_overlap("constitutional_clause_tags", F.array(*map(F.lit, clauses))))
    if issues:
        tests.append(F.arrays_overlap("issue_tags", F.array(*map(F.lit, issues))))
    return reduce(and_, tests, F.lit(True))


def dates_between(start: str | None, end: str | None) -> Column:
    """Inclusive, as strings."""
    tests = ([F.col("date") >= start] if start else []) + ([F.col("date") <= end] if end else [])
    return reduce(and_, tests, F.lit(True))


def event_text(query: str) -> Column:
    """A piece of text in the title, the summary, an actor or a location, whatever its case."""
    low = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(low))
    any_of = lambda name: F.exists(F.col(name), has)
    return has(F.col("title")) | has(F.col("summary")) | any_of("actors") | any_of("locations")


def country_meta(region: str | None, term: str = "") -> Column:
    found = F.contains(F.lower("country"), F.lit(term.lower())) | F.contains(F.lower("country_id"), F.lit(term.lower()))
    return found & (F.lit(True) if region is None else F.col("region") == region)
