"""Queries of the operators that prepare text, with the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.cut_off import cut_shares, cut_texts
from lectern.llm.near_copies import NearCopies
from lectern.llm.pack import mixture, pack_documents
from lectern.llm.scans import Scans
from lectern.llm.speaker_turns import speaker_turns
from lectern.llm.spellings import attribute_records
from lectern.llm.split import split_long
from lectern.llm.together import co_occurrence, significant_pairs
from lectern.llm.tokens import encode, vocabulary
from lectern.operators.analytics import once
from lectern.runtime import read_table

TAGS = ("issue_tags", "constitutional_clause_tags")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = NearCopies(read_table(spark, d, "chunks")).pairs()
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearCopies(read_table(spark, d, "chunks")).groups().withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    turns = speaker_turns(read_table(spark, d, "casetranscripts"), read_table(spark, d, "speakers"), with_text=False)
    return turns.select("transcript_id", "turn_no", "speaker_id", "first_seg_id", "last_seg_id")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(read_table(spark, d, "casetranscripts"), read_table(spark, d, "speakers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return significant_pairs(read_table(spark, d, "chunks"), "chunk_id", TAGS).select("item_a", "item_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = co_occurrence(read_table(spark, d, "chunks"), "chunk_id", TAGS)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), "author")
    documents = read_table(spark, d, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_id"), "author")
    register = read_table(spark, d, "delegates").select(F.col("id").alias("entry_id"), "name", "kind")
    return attribute_records(chunks.unionByName(documents), register).withColumnRenamed("entry_id", "delegate_id")


def _scans(spark: SparkSession, d: str) -> Scans:
    return Scans(once(read_table(spark, d, "chunks"), "chunk_id", "document_id", "title", "text", delivered="ingested_at"), unique=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).damage().withColumnRenamed("id", "chunk_id")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired().withColumnRenamed("id", "chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = once(read_table(spark, d, "chunks"), "chunk_id", "document_id", "text", delivered="ingested_at")
    return split_long(chunks, unique=True).select(F.col("id").alias("chunk_id"), F.col("parent").alias("document_id"), "piece_no", "pieces", "first_word", "n_words", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 0").select("chunk_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(read_table(spark, d, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode(read_table(spark, d, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"), offsets=True)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(read_table(spark, d, "documents"), vocabulary("byte_bpe_50k")).withColumnRenamed("id", "doc_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    report = mixture(pack_documents(read_table(spark, d, "documents"), vocabulary("byte_bpe_50k")))
    return report.select("shard", "block", "containers", F.round("fill", 4).alias("fill"), F.round("l1", 4).alias("l1"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(read_table(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(read_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_shares(read_table(spark, d, "documents")).withColumn("share", F.round("share", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_turns, p3_found, p3_pairs, p4_found, p5_found, p5_repaired, p6_found, p6_pieces, p7_ids, p7_offsets, p8_containers, p8_mixture, p9_found, p9_reasons, p9_shares)
}

_ITEMS = r"""
WITH d AS (
  SELECT chunk_id, min(issue_tags) AS i, min(constitutional_clause_tags) AS c FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id
), t AS (
  SELECT DISTINCT chunk_id, lower(regexp_replace(tag, '[\s_\-]+', '', 'g')) AS item
  FROM (SELECT chunk_id, unnest(list_concat(coalesce(i, []), coalesce(c, []))) AS tag FROM d)
  WHERE tag IS NOT NULL
), s AS (SELECT * FROM t WHERE item <> ''
), n AS (SELECT item, count(*) AS n FROM s GROUP BY item
), p AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM s a JOIN s b ON a.chunk_id = b.chunk_id AND a.item < b.item GROUP BY 1, 2
), k AS (SELECT count(*) AS n_records FROM d
), x AS (
  SELECT p.*, na.n AS n_a, nb.n AS n_b, k.n_records FROM p JOIN n na ON na.item = item_a JOIN n nb ON nb.item = item_b, k
)
"""
_L = "CASE WHEN {0} > 0 THEN ({0})::DOUBLE * ln(({0})::DOUBLE) ELSE 0 END"
_LLR = (
    "greatest(0.0, 2.0 * ("
    + " + ".join(_L.format(c) for c in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n_records - n_a - n_b + n_ab)", "n_records"))
    + "".join(" - " + _L.format(c) for c in ("n_a", "(n_records - n_a)", "n_b", "(n_records - n_b)"))
    + "))"
)

ORACLE: dict[str, str] = {
    "p1_found": r"""
WITH c AS (
  SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id
), w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c
), s AS (
  SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id
), b AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM b JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE 2 * k >= p.n + q.n - k""",
    "p3_found": _ITEMS + "SELECT item_a, item_b FROM x WHERE n_ab >= 4 AND 1000 * n_ab >= n_records AND n_ab * n_records >= 2 * n_a * n_b",
    "p3_pairs": _ITEMS + f"SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n_records / (n_a::DOUBLE * n_b), 6) AS lift, round({_LLR}, 4) AS llr FROM x",
    "p6_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND len(regexp_extract_all(text, '[^\s\p{Z}]+')) > 650",
}
