"""Keeping tables in order: latest rows, first seen, recency lists, upserts, differences, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import cut


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first in the order given."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, replaced by new ones of the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and those new ones whose key is new."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def recency(df: DataFrame, owner: str, item: str, at: str, n: int) -> DataFrame:
    """owner, item, at, rank: the last use of each item, the n newest of an owner."""
    last = df.groupBy(owner, item).agg(F.max(at).alias(at))
    w = Window.partitionBy(owner).orderBy(F.desc(at), item)
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def numbered(df: DataFrame, group: Sequence[str], *order: Column) -> DataFrame:
    """The occurrence number of each row in its group, from 1.

    Rows are put in order by a range shuffle, numbered in each part of a group, and a
    part begins after the rows of the parts before it, so a group of any size is spread
    over tasks.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    own = [*group, "__part"]
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*own).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*(F.col(c).alias(f"__{c}") for c in own), "__before")
    inside = ranged.withColumn("__r", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    met = inside.join(before, F.expr(" and ".join(f"`{c}` <=> `__{c}`" for c in own)))
    return met.withColumn("occurrence", (F.col("__r") + F.col("__before")).cast("int")).select(*df.columns, "occurrence")


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, as often as it lacks them, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def validation(df: DataFrame) -> DataFrame:
    """One row of counts of an archive of chunks as delivered: ids, documents, authors, empty texts, wrong word counts, repeated ids."""
    from lectern.functions.text import word_count

    return df.agg(
        F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("source_collection").alias("collections"),
        F.countDistinct("author").alias("authors"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_text"), (F.count("chunk_id") - F.countDistinct("chunk_id")).alias("repeated_ids"),
        F.count_if(F.col("word_count").isNull()).alias("no_word_count"), F.count_if(F.col("word_count") != word_count(F.col("text"))).alias("wrong_word_count"),
        F.count_if(~F.coalesce(F.col("source_url"), F.lit("")).rlike("^https?://")).alias("bad_url"),
    )


def unique_in_order(c: Column) -> Column:
    """An array without repeats, nulls and empty strings, in order of first occurrence."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def missing_fields(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))
