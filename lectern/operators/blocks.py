"""A stated set of queries against all rows, in blocks.

Queries and rows are packed into rows of many vectors each, and every block of the one
meets every block of the other in one job, whatever the number of either: nothing is
collected, and a task holds two blocks at a time. What a pair of blocks gives is cut
down there (the best of each query, or sums), so no row leaves for every two vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block.
DENSE, SPARSE = 2_000, 512

_DENSE = "ids array<bigint>, data binary"
_SPARSE = "ids array<string>, groups array<string>, ptr array<int>, terms array<bigint>, weights array<double>"


def _pack_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DENSE):
            part = batch.slice(at, DENSE)
            data = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], ["ids", "data"])


def dense(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Blocks of the vectors of a table; null vectors are left out."""
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(_pack_dense, _DENSE)


def _pack_sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SPARSE.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, SPARSE):
            part = batch.slice(at, SPARSE)
            terms, weights = part.column(2), part.column(3)
            ptr = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            values = [part.column(0).to_pylist()], [part.column(1).to_pylist()], [ptr], [terms.flatten().to_numpy()], [weights.flatten().to_numpy()]
            types = pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(t)) for v, t in zip(values, types)], names)


def sparse(df: DataFrame, group: str | None = None) -> DataFrame:
    """Blocks of the texts of an (id, term, weight) table; ``group`` is a column that holds for the whole text."""
    own = F.lit(None).cast("string") if group is None else F.any_value(F.col(group))
    pairs = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w"))))
    per = df.groupBy(F.col("id").cast("string").alias("id")).agg(own.alias("g"), pairs.alias("p"))
    return per.select("id", "g", F.col("p.t").alias("t"), F.col("p.w").alias("w")).mapInArrow(_pack_sparse, _SPARSE)


def _dense_scores(row: dict) -> tuple[np.ndarray, np.ndarray, None, np.ndarray]:
    q, r = (np.array(row[c].as_py(), np.int64) for c in ("q_ids", "ids"))
    a, b = (np.frombuffer(row[c].as_py(), np.float64).reshape(len(n), -1) for c, n in (("q_data", q), ("data", r)))
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} dimensions")
    return q, r, None, a @ b.T


def _sparse_scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q, r, g = (np.array(row[c].as_py(), object) for c in ("q_ids", "ids", "groups"))
    q_ptr, ptr, q_terms, terms, q_weights, weights = (row[c].values.to_numpy(zero_copy_only=False) for c in ("q_ptr", "ptr", "q_terms", "terms", "q_weights", "weights"))
    known, place = np.unique(q_terms, return_inverse=True)
    scores = np.zeros((len(q), len(r)))
    if not len(known):
        return q, r, g, scores
    wide = np.zeros((len(known), len(q)))
    np.add.at(wide, (place, np.repeat(np.arange(len(q)), np.diff(q_ptr))), q_weights)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    hit = known[at] == terms
    text = np.repeat(np.arange(len(r)), np.diff(ptr))[hit]
    at, weights = at[hit], weights[hit]
    # as many entries at a time as keep the gathered rows small, whole texts together
    step = max(1, 4_000_000 // len(q))
    start = 0
    while start < len(at):
        end = min(start + step, len(at))
        if end < len(at):
            low = int(np.searchsorted(text, text[end]))
            end = low if low > start else int(np.searchsorted(text, text[end], side="right"))
        owners, first = np.unique(text[start:end], return_index=True)
        scores[:, owners] = np.add.reduceat(wide[at[start:end]] * weights[start:end, None], first, axis=0).T
        start = end
    return q, r, g, scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, groups: np.ndarray | None = None, per_group: int | None = None, above: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best of each row, ties by id; with at most ``per_group`` of one group; only those above a score."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    if per_group is None and k < scores.shape[1]:
        least = np.partition(scores, -k, axis=1)[:, -k]
        wanted = scores >= least[:, None]
    else:
        wanted = np.ones(scores.shape, bool)
    if above is not None:
        wanted &= scores > above
    rows, cols = np.nonzero(wanted)
    sort = np.lexsort((rank[cols], -scores[rows, cols], rows))
    rows, cols = rows[sort], cols[sort]
    if per_group is not None and len(rows):
        _, code = np.unique(np.array([str(g) for g in groups], object), return_inverse=True)
        keep = _numbers(rows * (code.max() + 1) + code[cols]) < per_group
        rows, cols = rows[keep], cols[keep]
    keep = _numbers(rows) < k
    return rows[keep], cols[keep]


def _numbers(keys: np.ndarray) -> np.ndarray:
    """The number of each entry among those with its key, from 0, in the order they come."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    numbers = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty(len(s), np.int64)
    out[order] = numbers
    return out


def against(queries: DataFrame, rows: DataFrame, give: Callable, schema: str, is_dense: bool) -> DataFrame:
    """``give(query ids, row ids, groups, scores)`` as columns of ``schema``, for every two blocks."""
    scored = _dense_scores if is_dense else _sparse_scores
    own = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "groups"))
    types = [c.split() for c in schema.split(", ")]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = give(*scored({n: batch.column(n)[i] for n in batch.schema.names}))
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(columns, types)], [n for n, _ in types])

    return own.crossJoin(rows).mapInArrow(met, schema)
