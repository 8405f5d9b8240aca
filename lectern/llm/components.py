"""Connected components: union-find inside partitions, then rounds of star contraction.

A first pass runs union-find over the edges of each partition and sends on a forest
in place of the edges (at most one edge a node, so a dense group shrinks before any
shuffle). The rounds that follow join every node to the smallest neighbour it knows
(large star, then small star) until nothing moves; their number grows with the
logarithm of the longest chain. Each round is checkpointed in the shared folder.
No component is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import cut

#: Nodes whose parents one task holds before it sends its forest on.
FOREST_NODES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(n, find(n)) for n in parent if find(n) != n]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_NODES:
            yield flush()
    if parent:
        yield flush()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of an edge table (src, dst strings); root is the smallest node of the component.

    Edges with a null end and edges from a node to itself join nothing. An empty
    table gives no rows.
    """
    edges = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src is not null and dst is not null and src <> dst")
    star = cut(edges.mapInArrow(_forest, "src string, dst string").distinct())
    before = None
    for _ in range(max_rounds):
        both = star.union(star.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        lowest = down.groupBy("src").agg(F.min("dst").alias("least"))
        star = cut(down.join(lowest, "src").select(F.when(F.col("dst") == F.col("least"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still move after {max_rounds} rounds")
    return star.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(star.select(F.col("dst"), F.col("dst")).distinct())
