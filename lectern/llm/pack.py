"""Filling containers of fixed capacity, with the sources mixed in fixed proportions.

Documents are measured in tokens; one that alone exceeds the capacity is cut into
pieces of exactly the capacity and a rest, any other stays whole. Items are put in
order of source and size by a range shuffle (ids and sizes, no texts), and each run of
that order is dealt out in turn to shards of a bounded number of tokens. So every shard
holds every source in its proportion and in all sizes, also one with a third of all rows.

Inside a shard each source is a queue with a deficit. Every container (window) adds
capacity times the source's share of all tokens to its deficit; the source with the
largest deficit gives the largest of its items that fits, and what it gives is taken
off. Pieces of exactly the capacity are items like any other: they are charged to
their source and come when it is its turn. ``mixture`` reports how far the sources of
each run of windows are from their shares. Once little room is left, the item that fits best is taken whatever its source,
and the overdraft is carried to the next windows. Containers that stay below
``close_at`` are not closed: their items and the shard's deficits are carried to a
second round, in which the leftovers of many shards are packed together.

Defined results: each piece of each document with an id is in exactly one container;
null and empty texts take no room and share the container 0 of their shard; a null
source is a source of its own; a null id is left out; a doc_id that occurs twice is
two items.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import count_tokens
from lectern.runtime import keep, small_side

#: Tokens of a container.
CAPACITY = 2048
#: Tokens in a shard, where each item counts as ITEM_WEIGHT more (so empty items are bounded too).
SHARD_TOKENS = 4_000_000
ITEM_WEIGHT = 64
#: Containers of a shard are numbered from shard * SPAN.
SPAN = 1 << 20
#: Room below which the best-fitting item of any source is taken.
LITTLE = 0.3
BROADCAST_ROWS = 100_000


class Queues:
    """The items of a shard by source and size."""

    def __init__(self, capacity: int, close_at: float, deficits: dict[str, float], shares: dict[str, float]):
        self.capacity, self.close_at = capacity, close_at
        self.deficits, self.shares = defaultdict(float, deficits), shares
        self.by: dict[str, dict[int, list]] = defaultdict(lambda: defaultdict(list))  # source -> size -> items
        self.sizes: dict[str, list[int]] = defaultdict(list)
        self.holders: dict[int, set[str]] = defaultdict(set)  # size -> sources that hold such items
        self.all_sizes: list[int] = []

    def add(self, source: str, size: int, item) -> None:
        if not self.by[source][size]:
            insort(self.sizes[source], size)
            if not self.holders[size]:
                insort(self.all_sizes, size)
            self.holders[size].add(source)
        self.by[source][size].append(item)

    def take(self, source: str, size: int):
        items = self.by[source][size]
        item = items.pop()
        if not items:
            self.sizes[source].remove(size)
            self.holders[size].discard(source)
            if not self.holders[size]:
                self.all_sizes.remove(size)
            if not self.sizes[source]:
                del self.sizes[source]
        self.deficits[source] -= size
        return item

    def largest(self, sizes: list[int], room: int) -> int | None:
        at = bisect_right(sizes, room)
        return sizes[at - 1] if at else None

    def window(self) -> tuple[list, int]:
        """The items of one container and the room left."""
        room, out = self.capacity, []
        for s in self.sizes:
            self.deficits[s] += self.capacity * self.shares.get(s, 0.0)
        while self.all_sizes and room:
            best = self.largest(self.all_sizes, room)
            if best is None:
                break
            if room <= LITTLE * self.capacity:
                source = max(self.holders[best], key=lambda s: (self.deficits[s], s))
                size = best
            else:
                source, size = None, 0
                for s in sorted(self.sizes, key=lambda s: (-self.deficits[s], s)):
                    if (fit := self.largest(self.sizes[s], room)) is not None:
                        source, size = s, fit
                        break
            out.append(self.take(source, size))
            room -= size
        return out, room


def _pack(pdf: pd.DataFrame, capacity: int, close_at: float, last: bool) -> pd.DataFrame:
    """Rows of items of one shard (and deficits carried to it) to rows with a container, or carried on."""
    shard = int(pdf["shard"].iloc[0])
    carried, items = pdf[pdf["kind"] == "deficit"], pdf[pdf["kind"] == "item"]
    deficits = carried.groupby("source")["deficit"].sum().to_dict()
    shares = dict(zip(pdf["source"], pdf["share"]))
    q = Queues(capacity, close_at, deficits, shares)
    ids, pieces, sources, sizes = items["id"].tolist(), items["piece_no"].tolist(), items["source"].tolist(), items["n_tokens"].tolist()
    rows, base, number = [], shard * SPAN, 1
    for k, (s, n) in enumerate(zip(sources, sizes)):
        if n == 0:
            rows.append((k, base))
        else:
            q.add(s, n, k)
    rest = []
    while q.all_sizes:
        got, room = q.window()
        if not last and room > (1 - close_at) * capacity:
            rest += got
            for k in got:
                q.deficits[sources[k]] += sizes[k]
        else:
            rows += [(k, base + number) for k in got]
            number += 1
    rows += [(k, -1) for k in rest]
    out = pd.DataFrame(
        [("item", ids[k], pieces[k], sources[k], sizes[k], shares[sources[k]], c, shard, 0.0) for k, c in rows]
        + ([] if last or not rest else [("deficit", None, 0, s, 0, shares.get(s, 0.0), -1, shard, d) for s, d in q.deficits.items() if d]),
        columns=["kind", "id", "piece_no", "source", "n_tokens", "share", "container_no", "shard", "deficit"],
    )
    return out


_SCHEMA = "kind string, id bigint, piece_no bigint, source string, n_tokens bigint, share double, container_no bigint, shard bigint, deficit double"


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, capacity: int = CAPACITY, close_at: float = 0.98, fan_in: int = 256) -> DataFrame:
    """id, piece_no, source, n_tokens, container_no of every piece of every document."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("src")).where("id is not null")
    # a null source gets a name that no feed has
    sized = count_tokens(src, "text", path, "id", "src").withColumn("source", F.coalesce("src", F.lit("\u0000"))).drop("src")
    counted = keep(sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)))).select(
        "id", F.col("piece").cast("bigint").alias("piece_no"), "source", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("bigint").alias("n_tokens")
    ))
    per_source = keep(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items")))
    tokens, items = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("items"), F.lit(0))).first()
    shards = max(1, round((tokens + ITEM_WEIGHT * items) / SHARD_TOKENS))
    shares = per_source.select("source", (F.col("tokens") / F.lit(float(max(tokens, 1)))).alias("share"))
    first = (
        counted.join(small_side(shares, BROADCAST_ROWS), "source")
        .repartitionByRange("source", "n_tokens", "id", "piece_no")
        .sortWithinPartitions("source", "n_tokens", "id", "piece_no")
        .withColumn("at", F.monotonically_increasing_id())
        # the number in the partition, from a start of the partition's own
        .withColumn("shard", F.pmod(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.pmod(F.xxhash64(F.shiftright("at", 33)), F.lit(shards)), F.lit(shards)))
        .select(F.lit("item").alias("kind"), "id", "piece_no", "source", "n_tokens", "share", F.lit(-1).cast("bigint").alias("container_no"), F.col("shard").cast("bigint"), F.lit(0.0).alias("deficit"))
    )
    packed = keep(first.groupBy("shard").applyInPandas(lambda pdf: _pack(pdf, capacity, close_at, False), _SCHEMA))
    carried = packed.where("container_no < 0").withColumn("shard", F.lit(shards).cast("bigint") + F.floor(F.col("shard") / fan_in))
    second = carried.groupBy("shard").applyInPandas(lambda pdf: _pack(pdf, capacity, close_at, True), _SCHEMA)
    done = packed.where("kind = 'item' and container_no >= 0").unionByName(second.where("kind = 'item'"))
    return done.select("id", F.col("piece_no").cast("int"), F.when(F.col("source") != "\u0000", F.col("source")).alias("source"), F.col("n_tokens").cast("int"), "container_no")


def mixture(packed: DataFrame, every: int = 150, capacity: int = CAPACITY) -> DataFrame:
    """shard, block, containers, fill, l1 of each ``every`` windows of a shard: the part of the room in use, and the sum over sources of the distance between share of the block and share of all tokens."""
    used = packed.where("n_tokens > 0").select(F.coalesce("source", F.lit("\u0000")).alias("source"), "n_tokens", "container_no")
    placed = used.withColumn("shard", F.expr(f"container_no div {SPAN}")).withColumn("block", F.expr(f"(container_no % {SPAN} - 1) div {every}"))
    per = placed.groupBy("shard", "block", "source").agg(F.sum("n_tokens").alias("given"))
    blocks = placed.groupBy("shard", "block").agg(F.countDistinct("container_no").alias("containers"), F.sum("n_tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row a source
    shares = per.groupBy("source").agg(F.sum("given").alias("tokens")).select("source", (F.col("tokens") / total).alias("share"))
    # a source that gives nothing to a block is as far off as its share: 1 less the shares of those that give
    met = per.join(shares, "source").join(blocks, ["shard", "block"])
    far = met.groupBy("shard", "block", "containers", "tokens").agg(F.sum(F.abs(F.col("given") / F.col("tokens") - F.col("share"))).alias("off"), F.sum("share").alias("met"))
    return far.select("shard", "block", "containers", (F.col("tokens") / (F.col("containers") * F.lit(capacity))).alias("fill"), (F.col("off") + 1 - F.col("met")).alias("l1"))
