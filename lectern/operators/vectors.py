"""Dense and sparse vectors: nearest neighbours, TF-IDF, similarity of two corpora."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.blocks import against, best_of, dense, sparse


def dot(a: Column, b: Column) -> Column:
    """In double precision; vectors of different lengths give 0."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def checked(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has the index's dimension; any other raises when it is read."""
    return df.where(F.when(F.size(vector) == dim, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))).cast("boolean")))


def nearest(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """id, score of the k best: scores in the JVM, then the k largest of each task, then of all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col(vector), q) if metric == "cosine" else dot(F.col(vector), q)
    return df.select(F.col(id_col).alias("id"), F.round(score, 5).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def nearest_to_each(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """query_id, id, score, rank of the k largest inner products for each of a stated set of queries (rows like those of ``df``); ties by id."""

    def best(q, r, _, scores):
        scores = np.round(scores, digits)
        i, j = best_of(scores, r, k)
        return q[i], r[j], scores[i, j]

    met = against(dense(queries, id_col, vector), dense(df, id_col, vector), best, "query_id bigint, id bigint, score double", True)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class CellIndex:
    """Dense vectors by cell, for approximate search: centres are fitted on a bounded sample, every vector is in the cell of its nearest centre.

    A query looks into its ``probes`` nearest cells; queries and vectors meet by an
    equi-join on the cell, and a cell's pairs are scored in blocks. Tests measure the
    recall against all vectors.
    """

    #: Vectors that the centres are fitted on, at most.
    SAMPLE = 20_000

    def __init__(self, df: DataFrame, id_col: str, vector: str, *, cells: int = 64, rounds: int = 8, seed: int = 7):
        rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
        # in order of a hash, so that the sample is the same at every run
        sample = [r.v for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(self.SAMPLE).select("v").collect()]
        self.centres = _centres(np.array(sample, np.float64), cells, rounds) if sample else np.empty((0, 0))
        self.rows, self.cells = rows, self._placed(rows, 1)

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """id, v, cell for the nearest cells of each row."""
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _units(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.reshape(-1).astype(np.int32))], ["id", "v", "cell"])

        return rows.mapInArrow(place, "id bigint, v array<float>, cell int")

    def nearest(self, queries: DataFrame, k: int, *, probes: int = 16, digits: int = 5) -> DataFrame:
        """query_id, id, score, rank of the k largest cosines among the probed cells of each query (id, v)."""
        asked = self._placed(queries.select(F.col("id").cast("bigint").alias("id"), "v"), probes)
        pack = lambda df, p: df.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.collect_list("id").alias(f"{p}ids"), F.collect_list("v").alias(f"{p}vs")).drop("part")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    q, qv, r, rv = (batch.column(c)[row].as_py() for c in ("q_ids", "q_vs", "ids", "vs"))
                    scores = np.round(_units(np.array(qv, np.float64)) @ _units(np.array(rv, np.float64)).T, digits)
                    q, r = np.array(q), np.array(r)
                    i, j = best_of(scores, r, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(r[j]), pa.array(scores[i, j])], ["query_id", "id", "score"])

        met = pack(asked, "q_").join(pack(self.cells, ""), "cell").select("q_ids", "q_vs", "ids", "vs").mapInArrow(score, "query_id bigint, id bigint, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _units(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _centres(v: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centres by k-means on angles; an empty cell keeps its centre."""
    v = _units(v)
    centres = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres[filled] = _units(sums[filled])
    return centres


@F.pandas_udf(T.ArrayType(T.FloatType()))
def byte_embedding(s: pd.Series) -> pd.Series:
    """A stand-in for a model: bytes / 255 summed at their place modulo 384, of length 1; nothing gives the first axis. One pass over the bytes of a batch."""
    data = [(t or "").encode() for t in s]
    sizes = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(np.arange(len(data)), sizes) * 384 + (np.arange(len(flat)) - starts) % 384
    out = np.bincount(at, flat / 255, len(data) * 384).reshape(len(data), 384)
    n = np.sqrt((out * out).sum(axis=1))
    out[n == 0, 0] = n[n == 0] = 1.0
    return pd.Series(list((out / n[:, None]).astype(np.float32)), index=s.index, dtype=object)


def rerank(df: DataFrame, order: str, k: int) -> DataFrame:
    """1 / rank in the order given; meant for a result's few rows."""
    return df.orderBy(order).limit(k).withColumn("score", 1.0 / F.row_number().over(Window.orderBy(order)))


def prompt(rows: DataFrame, id_col: str, text_col: str, order: str, question: str) -> DataFrame:
    """One row: the contexts of a few hits, then the question."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("["), F.col(id_col), F.lit("]\n"), F.coalesce(F.col(text_col), F.lit(""))).alias("s"))))
    return rows.agg(F.concat(F.array_join(F.transform(parts, lambda x: x["s"]), "\n\n"), F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


# sparse -------------------------------------------------------------------------


def term_counts(df: DataFrame, id_col: str, tokens: Column, *keep: str) -> DataFrame:
    """id, term, n (how often it stands in the text), all (tokens of the text): one row an id, counts are added before the shuffle."""
    src = df.select(F.col(id_col).alias("id"), *keep, F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    return src.select("id", *keep, F.size("t").alias("all"), F.explode_outer("t").alias("term")).where("term is not null").groupBy("id", *keep, "term", "all").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, n_docs: int, most: int | None = 50_000) -> DataFrame:
    """term, df, idf of the counts of texts: the most frequent terms, idf = ln((1 + N) / (1 + df)) + 1."""
    counted = counts.groupBy("term").agg(F.count("*").alias("df"))
    if most is not None:
        counted = counted.orderBy(F.desc("df"), "term").limit(most)
    return counted.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, top_terms: int | None = 192, *keep: str) -> DataFrame:
    """id, term, weight: counts over all of a text's tokens times idf, the heaviest terms, then of length 1, to 8 digits.

    After the join with the vocabulary one shuffle by id: a text's terms are ranked and
    measured in its row.
    """
    weighted = counts.join(vocab.select("term", "idf"), "term").withColumn("w", F.col("n") / F.col("all") * F.col("idf"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("w", 12)).alias("r"), F.col("term").alias("term"), F.col("w").alias("w"))))
    per = weighted.groupBy("id", *keep).agg(ranked.alias("t"))
    if top_terms is not None:
        per = per.withColumn("t", F.slice("t", 1, top_terms))
    length = F.sqrt(F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    rows = per.withColumn("length", length).select("id", *keep, "length", F.explode("t").alias("x"))
    return rows.select("id", *keep, "x.term", F.round(F.when(F.col("length") > 0, F.col("x.w") / F.col("length")).otherwise(0.0), 8).alias("weight"))


def best_matches(queries: DataFrame, rows: DataFrame, k: int, *, digits: int = 5, group: str | None = None, per_group: int | None = None) -> DataFrame:
    """id_a, id_b, score > 0, rank of the k most similar rows of each text of a stated query set; both are (id, term, weight).

    With ``per_group`` at most so many of one group (a column of ``rows``); the group is a column of the result.
    """

    def best(q, r, g, scores):
        scores = np.round(scores, digits)
        i, j = best_of(scores, r, k, g, per_group, 0.0)
        return q[i], r[j], g[j], scores[i, j]

    met = against(sparse(queries), sparse(rows, group), best, "id_a string, id_b string, grp string, score double", False)
    order = [F.desc("score"), F.col("id_b")]
    if per_group is not None:
        met = met.withColumn("r", F.row_number().over(Window.partitionBy("id_a", "grp").orderBy(*order))).where(F.col("r") <= per_group).drop("r")
    out = met.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(*order))).where(F.col("rank") <= k)
    return out.drop("grp") if group is None else out.withColumnRenamed("grp", group)


def similarity_summary(queries: DataFrame, rows: DataFrame, digits: int = 5) -> DataFrame:
    """id_a, n, best, mean over the scores > 0 of each query; a pair of blocks gives sums, no pairs."""

    def sums(q, r, _, scores):
        scores = np.round(scores, digits)
        n = (scores > 0).sum(axis=1)
        some = n > 0
        return q[some], n[some], scores.max(axis=1, initial=0.0)[some], np.where(scores > 0, scores, 0.0).sum(axis=1)[some]

    met = against(sparse(queries), sparse(rows), sums, "id_a string, n bigint, best double, total double", False)
    return met.groupBy("id_a").agg(F.sum("n").alias("n"), F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean"))
