"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.analytics import once
from lectern.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: A chunk delivered twice counts once.
C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)"
CLAUSES, ISSUES = "constitutional_clause_tags", "issue_tags"


def chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chunks with the columns needed; those with texts are not shuffled to count each once.

    Texts in fewer files than half the tasks that may run at a time are spread over them,
    for each is tokenised or searched; an archive of any size is in more.
    """
    table = read_table(spark, d, "chunks")
    if "text" not in cols:
        return once(table, "chunk_id", *cols)
    rows = once(table, "chunk_id", *cols, delivered="ingested_at")
    at_a_time = spark.sparkContext.defaultParallelism
    return rows.repartition(at_a_time) if 2 * table.rdd.getNumPartitions() <= at_a_time else rows


def joined(c: Column | str, by: str = "|") -> Column:
    """An array as text, for results that any engine can compare."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, by)


def sql_list(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_tokens_archive(text: str) -> str:
    # the compatibility characters that occur in the tables are spelt out, for DuckDB has no NFKC
    plain = f"lower(replace(replace(coalesce({text}, ''), 'ſ', 's'), 'ﬁ', 'fi'))"
    return f"list_filter(regexp_split_to_array({plain}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({sql_list(X.STOP_ARCHIVE)}))"


def sql_tokens_all(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9'']+')"


def sql_tags(c: str) -> str:
    return f"list_filter(coalesce({c}, []), lambda t: t IS NOT NULL)"


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        assert name not in self.queries, name
        self.queries[name] = query
        if sql is not None:
            self.oracle[name] = sql
