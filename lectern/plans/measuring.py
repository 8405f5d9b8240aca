"""Queries of vectors, term weights, ranks, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import vectors as V
from lectern.operators.analytics import tags_of
from lectern.plans.common import CLAUSES, ISSUES, C, Registry, chunks, joined, sql_list, sql_tags, sql_tokens_all
from lectern.runtime import cut, read_table, shared_folder
from lectern.streaming import ingest as ST

R = Registry()

# dense vectors
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def query_vector(s: SparkSession, d: str) -> list[float]:
    return list(read_table(s, d, "embeddings").where("vec_id = 3").first().embedding)


R.add("cosine_knn", lambda s, d: V.nearest(read_table(s, d, "embeddings"), "vec_id", "embedding", query_vector(s, d), 50), f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id AS id, round({_DOT('embedding', 'q')} / (sqrt({_DOT('embedding', 'embedding')}) * sqrt({_DOT('q', 'q')})), 5) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 50")
R.add("inner_product_knn", lambda s, d: V.nearest(read_table(s, d, "embeddings"), "vec_id", "embedding", query_vector(s, d), 20, "dot"), f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id AS id, round({_DOT('embedding', 'q')}, 5) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20")


def nearest_to_hundredth(s: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100, its ten nearest of all vectors."""
    df = V.checked(read_table(s, d, "embeddings"), "embedding", len(query_vector(s, d)))
    return V.nearest_to_each(df, "vec_id", "embedding", df.where("vec_id % 100 = 0"), 10)


def nearest_by_cells(s: SparkSession, d: str) -> DataFrame:
    """The same queries over an index of cells: approximate, so there is no SQL; recall is measured in the tests."""
    df = read_table(s, d, "embeddings")
    return V.CellIndex(df, "vec_id", "embedding").nearest(df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


R.add("nearest_by_cells", nearest_by_cells)
R.add("nearest_to_hundredth", nearest_to_hundredth, f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_DOT('a.embedding', 'b.embedding')}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT query_id, id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM s) WHERE rank <= 10")
R.add("unit_vectors", lambda s, d: read_table(s, d, "embeddings").select("vec_id", F.round(V.norm(V.normalised(F.col("embedding"))), 6).alias("norm"), F.size("embedding").alias("dim")), "SELECT vec_id, CASE WHEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm, len(embedding)::INTEGER AS dim FROM embeddings")
R.add("text_embeddings", lambda s, d: read_table(s, d, "documents").select("doc_id", V.byte_embedding(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 4).alias("norm")), "SELECT doc_id, 384::INTEGER AS dim, 1.0::DOUBLE AS norm FROM documents")
R.add("reranked", lambda s, d: V.rerank(read_table(s, d, "embeddings").select("vec_id"), "vec_id", 10).select("vec_id", F.round("score", 6).alias("score")), "SELECT vec_id, round(1.0::DOUBLE / row_number() OVER (ORDER BY vec_id), 6) AS score FROM embeddings ORDER BY vec_id LIMIT 10")
R.add("prompt", lambda s, d: V.prompt(chunks(s, d, "pos", "text").orderBy("pos", "chunk_id").limit(3), "chunk_id", "text", "pos", "What was decided?"), f"WITH {C}, t AS (SELECT * FROM c ORDER BY pos, chunk_id LIMIT 3) SELECT string_agg('[' || chunk_id || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Question: What was decided?' AS prompt FROM t")

# term weights
_TERMS = "list_filter({t}, lambda t: len(t) > 2 AND t NOT IN ({w}))"
#: What the vectors of an archive read, and what texts compared with those of another archive read: tags too.
TITLED = lambda: F.concat_ws(" ", "title", "text")
TAGGED = lambda: F.concat_ws(" ", "title", "text", F.array_join(tags_of(CLAUSES), " "), F.array_join(tags_of(ISSUES), " "))
_TITLED = "concat_ws(' ', title, text)"
_TAGGED = f"concat_ws(' ', title, text, array_to_string({sql_tags(CLAUSES)}, ' '), array_to_string({sql_tags(ISSUES)}, ' '))"


def counts(s: SparkSession, d: str, text) -> DataFrame:
    """Term counts of all chunks, kept in the shared folder for the plans that read them several times."""
    return cut(V.term_counts(chunks(s, d, "title", "text", "source_collection", "document_id", CLAUSES, ISSUES), "chunk_id", X.tokens_script(text()), "source_collection", "document_id"))


def _n(s: SparkSession, d: str) -> int:
    return chunks(s, d).count()


def _voc(text: str) -> str:
    terms = _TERMS.format(t=sql_tokens_all(text), w=sql_list(X.STOP_SCRIPT))
    return f"""WITH {C}, n AS (SELECT count(*) AS n FROM c), t AS (SELECT chunk_id AS id, source_collection, document_id, unnest({terms}) AS term FROM c), v AS (SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term),
i AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT * FROM v ORDER BY df DESC, term LIMIT 50000), n),
f AS (SELECT id, source_collection, document_id, term, count(*) AS k FROM t GROUP BY ALL), w AS (SELECT *, k / total * idf AS w FROM (SELECT *, sum(k) OVER (PARTITION BY id) AS total FROM f) JOIN i USING (term))"""


_VOC, _VOC_TAGGED = _voc(_TITLED), _voc(_TAGGED)
R.add("tfidf_vocabulary", lambda s, d: V.vocabulary(counts(s, d, TITLED), _n(s, d)).select("term", "df", F.round("idf", 6).alias("idf")), _VOC + " SELECT term, df, round(idf, 6) AS idf FROM i")


def vectors(s: SparkSession, d: str, top: int) -> DataFrame:
    c = counts(s, d, TITLED)
    return V.tfidf(c, V.vocabulary(c, _n(s, d)), top)


def _heaviest(top: int) -> str:
    return f"{_VOC}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, term) AS r FROM w), k AS (SELECT * FROM r WHERE r <= {top}) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS weight FROM k"


# the operator keeps 192 terms; of 20 the effect on the lengths shows
R.add("tfidf_vectors", lambda s, d: vectors(s, d, 192), _heaviest(192))
R.add("tfidf_vectors_20", lambda s, d: vectors(s, d, 20), _heaviest(20))
_LEFT, _RIGHT = "source_collection = 'court_records'", "source_collection = 'correspondence'"
_CROSS = _VOC_TAGGED + f""", x AS (SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS w FROM w WHERE {_LEFT}), y AS (SELECT id, document_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS w FROM w WHERE {_RIGHT}),
s AS (SELECT x.id AS id_a, y.id AS id_b, y.document_id, round(sum(x.w * y.w), 5) AS score FROM x JOIN y USING (term) GROUP BY ALL)"""


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of two collections over the vocabulary of all."""
    c = counts(s, d, TAGGED)
    voc = cut(V.vocabulary(c, _n(s, d)))
    of = lambda where: V.tfidf(c.where(where), voc, None, "document_id")
    return of(_LEFT), of(_RIGHT)


R.add("tfidf_cross_top", lambda s, d: V.best_matches(*sides(s, d), 25), _CROSS + " SELECT id_a, id_b, score, rank FROM (SELECT id_a, id_b, score, (row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b))::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 25")
R.add("tfidf_cross_diverse", lambda s, d: V.best_matches(*sides(s, d), 5, group="document_id", per_group=1).select("id_a", "id_b", "document_id", "score", "rank"), _CROSS + ", g AS (SELECT *, row_number() OVER (PARTITION BY id_a, document_id ORDER BY score DESC, id_b) AS k FROM s WHERE score > 0) SELECT id_a, id_b, document_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b))::INTEGER AS rank FROM g WHERE k = 1) WHERE rank <= 5")
R.add("tfidf_cross_summary", lambda s, d: V.similarity_summary(*sides(s, d)).select("id_a", "n", "best", F.round("mean", 4).alias("mean")), _CROSS + " SELECT id_a, count(*) AS n, max(score) AS best, round(avg(score), 4) AS mean FROM s WHERE score > 0 GROUP BY id_a")
R.add("top_terms", lambda s, d: counts(s, d, TITLED).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "term"))).where("rank <= 5").groupBy("id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])).alias("terms")), _VOC + ", r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY k DESC, term) AS r FROM f) SELECT id, string_agg(term, '|' ORDER BY r) AS terms FROM r WHERE r <= 5 GROUP BY id")

# streams: the events as they lie in their folder, taken in until nothing is left


def _files(s: SparkSession, d: str, table: str, schema) -> DataFrame:
    """A stream over a table's files, be it one file or a folder of them."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    folder = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = s.readStream.schema(schema)
    return reader.parquet(f"{d}/{table}.parquet") if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)


def event_stream(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d, "events", read_table(s, d, "events").schema)


def _ran(s: SparkSession, stream: DataFrame, name: str, *keys: str) -> DataFrame:
    folder = shared_folder(s, name)
    return ST.to_files(stream, f"{folder}/out", f"{folder}/state", keys)


R.add("stream_counts", lambda s, d: _ran(s, event_stream(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "counts", "event_type"), "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
R.add("stream_windows", lambda s, d: _ran(s, ST.windowed_counts(event_stream(s, d), "ts", "event_type").withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz")), "windows", "start", "event_type"), "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
R.add("stream_mean", lambda s, d: _ran(s, ST.running_mean(event_stream(s, d), "user_id", "value").withColumn("mean", F.round("mean", 4)), "mean", "user_id"), "SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY user_id")


def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """Documents taken in as a stream, then the chunks of the latest delivery of each."""
    schema = read_table(s, d, "documents").schema
    stream = _files(s, d, "documents", schema)
    folder = shared_folder(s, "ingest")
    store = ST.Ingest(s, f"{folder}/tables")
    store.run(stream.select("id", "text", "ingested_at", "doc_id"), f"{folder}/state").awaitTermination()
    return store.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("n_words").alias("words"))


R.add("stream_ingest", stream_ingest, r"""WITH l AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1), w AS (SELECT id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> ''))::INTEGER AS n FROM l), s AS (SELECT id, n, unnest(CASE WHEN n >= 80 THEN range(0, n - 79, 275) ELSE [] END) AS st FROM w)
SELECT id AS document_id, count(*) AS chunks, sum(least(320, n - st))::BIGINT AS words FROM s GROUP BY id""")  # fmt: skip
