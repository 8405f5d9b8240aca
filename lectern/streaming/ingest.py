"""Documents that arrive: chunked, indexed and written batch by batch, each document replacing its earlier self."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as X
from lectern.operators import chunking
from lectern.operators.search import PostingIndex
from lectern.operators.tables import latest


def chunk_batch(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """chunks and postings of a batch of documents."""
    pieces = chunking.windows(documents, id_col, text_col, "library").select(chunking.chunk_name(F.col("id").cast("string"), F.col("seq")).alias("chunk_id"), F.col("id").alias("document_id"), "seq", "n_words", "text")
    return pieces, PostingIndex.build(pieces, "chunk_id", X.tokens_library(F.col("text"))).postings


class Ingest:
    """Tables of documents, chunks and postings in a directory, fed by a stream.

    A batch writes its rows into folders named after the batch, so a batch that is
    repeated after a failure overwrites what it wrote; readers take the latest delivery
    of each document (by its time, of equal times that of the later batch, a null time
    first), and recovery is reading the tables again. A document that arrives late does
    not replace a newer one.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", text_col: str = "text"):
        self.spark, self.path, self.id_col, self.text_col = spark, path, id_col, text_col
        self.events: list[tuple[int, int, int]] = []

    def write_batch(self, batch: DataFrame, number: int) -> None:
        batch = latest(batch, [self.id_col], F.desc_nulls_last("ingested_at")).persist()
        chunks, postings = chunk_batch(batch, self.id_col, self.text_col)
        for name, df in (("documents", batch), ("chunks", chunks), ("postings", postings)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        written = self.spark.read.parquet(f"{self.path}/chunks/batch={number}").count()
        self.events.append((number, batch.count(), written))
        batch.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what is there and stop."""
        return stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        """The batch of the latest delivery of each document: ids and times alone are shuffled."""
        rows = self.spark.read.parquet(f"{self.path}/documents").select(self.id_col, F.struct("ingested_at", "batch").alias("at"))
        return rows.groupBy(self.id_col).agg(F.max("at")["batch"].alias("batch"))

    def documents(self) -> DataFrame:
        """The latest delivery of each document."""
        return self.spark.read.parquet(f"{self.path}/documents").join(self.current(), [self.id_col, "batch"])

    def chunks(self) -> DataFrame:
        """Chunks of the latest deliveries."""
        now = self.current().withColumnRenamed(self.id_col, "document_id")
        return self.spark.read.parquet(f"{self.path}/chunks").join(now, ["document_id", "batch"])

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").join(self.chunks().select(F.col("chunk_id").alias("id"), "batch"), ["id", "batch"])

    def updates(self) -> DataFrame:
        """batch, documents, chunks_added of the batches this object has written."""
        return self.spark.createDataFrame(self.events, "batch int, documents int, chunks_added int")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, key, n, total of values, with a watermark for rows that come late."""
    per = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("start"), key, "n", "total")


def running_mean(stream: DataFrame, key: str, value: Callable[[], object] | str) -> DataFrame:
    """key, n, mean so far: kept as state between batches."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.avg(value if isinstance(value, str) else value()).alias("mean"))


def to_files(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation over what is there and read its result: the last row of each key.

    In update mode a batch writes only the rows it has changed, so state that the
    watermark has passed is given up and nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    return latest(rows, keys, F.desc("batch")).drop("batch")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a batch that can be taken up again."""
    return wanted.join(done.select(key), key, "left_anti")
