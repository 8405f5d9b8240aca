"""Tags by keyword taxonomies that the caller gives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clauses that need two of their keywords.
TWO_KEYWORDS = ("I.8", "II.1", "III.1")


def keyword_tags(text: Column, taxonomy: Mapping[str, Sequence[str]], least: Mapping[str, int] | None = None, seeds: Column | None = None, ordered: bool = False) -> Column:
    """Tags whose keywords stand in the text, after the seeds, each once.

    The taxonomy is part of the expression: it is a small list of the caller, and the
    text is read once. ``ordered`` sorts the tags.
    """
    low = F.lower(text)
    found = [
        F.when(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w)))) >= (least or {}).get(tag, 1), F.lit(tag))
        for tag, words in taxonomy.items()
        if words
    ]
    tags = F.filter(F.array(*found), lambda t: t.isNotNull()) if found else F.array().cast("array<string>")
    if seeds is not None:
        tags = F.concat(F.filter(F.coalesce(seeds, F.array().cast("array<string>")), lambda t: t.isNotNull()), tags)
    tags = F.array_distinct(tags)
    return F.array_sort(tags) if ordered else tags


def clause_tags(text: Column, taxonomy: Mapping[str, Sequence[str]], seeds: Column | None = None) -> Column:
    """With two keywords asked of the broad clauses."""
    return keyword_tags(text, taxonomy, dict.fromkeys(TWO_KEYWORDS, 2), seeds)
