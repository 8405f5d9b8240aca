"""What operators share: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``directory`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; set one only where none is set.

    A folder of this machine is only ever chosen for a local master. On a cluster
    without the setting the caller has to name a shared folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lectern-checkpoint-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one query, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept in memory and on disk for reuse inside one query; lost parts are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: Bytes of a side of a join that is broadcast, at most.
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by their length, anything else 8."""
    of = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c)}
    parts = []
    for c, t in df.dtypes:
        long = of[t](F.col(c)) if t in of else F.octet_length(F.to_json(F.struct(c))) if t.startswith(("array", "map", "struct")) else F.lit(0)
        parts.append(F.coalesce(long, F.lit(0)) + 16)
    return sum(parts, F.lit(24)).cast("bigint")


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has no more than ``rows`` rows and about ``size`` bytes; looks at no more rows than that."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return seen.n <= rows and seen.bytes <= size


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes were counted to be few, else as it is.

    Beyond that the join stays a shuffle join that adaptive execution may split at skewed
    keys, so the size of ``df`` never decides whether it runs.
    """
    return F.broadcast(df) if at_most(df, rows) else df
