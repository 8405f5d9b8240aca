"""Items that appear together: stripes, merged by key, with log-likelihood ratios.

Every task keeps an associative array (stripe) of neighbour counts per item and
sends the summed entries on when the arrays grow past a bound; the entries are
merged by item and neighbour after one shuffle. A hot item is many entries of one
stripe, spread over the neighbours, never one unbounded array.

Defined results: a record counts once whatever the number of its deliveries (its
tags are those of the first delivery in order of the arrays); a null id is no
record; null and blank tags do not count; an item counts once in a record. Records
without items count in the number of records. Empty input gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import keep

#: Entries that one task holds in its stripes before it sends them on.
STRIPE_ENTRIES = 500_000


def item_of(tag: Column) -> Column:
    """Lower-cased, without white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(tag, r"[\s\p{Z}_\-]+", ""))


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: dict[str, Counter] = defaultdict(Counter)
    entries = 0

    def flush() -> pa.RecordBatch:
        rows = [(a, b, n) for a, stripe in stripes.items() for b, n in stripe.items()]
        stripes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["item", "neighbour", "n"])

    for batch in batches:
        for items in batch.column(0).to_pylist():
            items.sort()
            for i, a in enumerate(items):
                # an item's own entry is the number of records that hold it
                stripe = stripes[a]
                entries -= len(stripe)
                stripe.update(items[i:])
                entries += len(stripe)
            if entries > STRIPE_ENTRIES:
                yield flush()
                entries = 0
    if stripes:
        yield flush()


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def co_occurrence(df: DataFrame, id_col: str, tag_cols: Sequence[str]) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n_records, lift, llr for every pair found together.

    ``lift`` is n_ab over what chance would give; ``llr`` is the log-likelihood ratio
    (G2) of the two-by-two table.
    """
    for c in (id_col, *tag_cols):
        if not re.fullmatch(r"[A-Za-z_]\w*", c):
            raise ValueError(f"not a column name: {c}")
    tags = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in tag_cols))
    items = F.array_distinct(F.filter(F.transform(tags, item_of), lambda x: x.isNotNull() & (x != "")))
    records = keep(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), items.alias("items")).groupBy("id").agg(F.min("items").alias("items")))
    entries = keep(records.where(F.size("items") > 0).select("items").mapInArrow(_stripes, "item string, neighbour string, n bigint").groupBy("item", "neighbour").agg(F.sum("n").alias("n")))
    single = entries.where("item = neighbour").select("item", "n")
    total = records.count()
    pairs = (
        entries.where("item < neighbour")
        .select(F.col("item").alias("item_a"), F.col("neighbour").alias("item_b"), F.col("n").alias("n_ab"))
        .join(single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n_records", F.lit(total).cast("bigint"))
    )
    k11, k12, k21 = F.col("n_ab").cast("double"), (F.col("n_a") - F.col("n_ab")).cast("double"), (F.col("n_b") - F.col("n_ab")).cast("double")
    k22 = (F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_ab")).cast("double")
    n = F.col("n_records").cast("double")
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    margins = _xlogx(k11 + k12) + _xlogx(k21 + k22) + _xlogx(k11 + k21) + _xlogx(k12 + k22)
    return pairs.select(
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        "n_records",
        (k11 * n / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))).alias("lift"),
        F.greatest(F.lit(0.0), 2.0 * (cells + _xlogx(n) - margins)).alias("llr"),
    )


def significant_pairs(df: DataFrame, id_col: str, tag_cols: Sequence[str], *, least: int = 4, least_share: float = 0.001, least_lift: float = 2.0) -> DataFrame:
    """The pairs in at least ``least`` records and ``least_share`` of all, ``least_lift`` times as often as chance."""
    pairs = co_occurrence(df, id_col, tag_cols)
    # decimals on both sides, so that no bound is missed by the rounding of a fraction
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    bound = lambda x: F.lit(Decimal(str(x)))
    shared = whole("n_ab") >= whole("n_records") * bound(least_share)
    often = whole("n_ab") * whole("n_records") >= whole("n_a") * whole("n_b") * bound(least_lift)
    return pairs.where((F.col("n_ab") >= least) & shared & often)
