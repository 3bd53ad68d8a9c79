"""Tables in the shared folder, and run-partitioned history with a manifest.

``scratch`` deletes, at its end, the tables that were written within it.  Iterations cut their lineage by writing to the folder that ``spark.checkpoint.dir`` names, which
all executors share: the result is computed once and outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
READER_VERSION = 1


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local session without one gets a fresh temporary folder, a cluster a folder of its warehouse.

    A cluster with neither a checkpoint folder nor a warehouse beyond the local disk is refused: executors would not see each other's files.
    """
    base = spark.conf.get(_KEY, None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
            if base.startswith(("file:", "/")):
                raise ValueError(f"on a cluster, {_KEY} must name a folder that all executors share")
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


#: The paths that each open scratch has handed out, innermost last; every thread has its own, so that queries may run at once.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


def new_path(spark: SparkSession, name: str, *, outlives: bool = False) -> str:
    """A path in the shared folder that nothing else uses; it belongs to the innermost scratch, or to the one around it if it ``outlives`` that."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _scratches.get()[:-1] if outlives else _scratches.get()
    if owners:
        owners[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what was written inside, but for what outlives it; nothing that is read later may depend on the rest."""
    made: list[str] = []
    token = _scratches.set((*_scratches.get(), made))
    try:
        yield
    finally:
        _scratches.reset(token)
        for path in made:  # through Hadoop's file systems, which wrote them, whatever the scheme
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, *, outlives: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, safe from lost executors."""
    path = new_path(df.sparkSession, name, outlives=outlives)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, name: str, first: int) -> DataFrame:
    """``rows`` numbered from ``first`` without gaps and without a sort: by partition, each behind those before it."""
    placed = materialize(rows.withColumn("mid", F.monotonically_increasing_id()), "numbered")
    part, at = F.call_function("shiftright", F.col("mid"), F.lit(33)), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each task that wrote
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(*rows.columns, (F.lit(first) + F.col("offset") + at).alias(name))


def append_run(df: DataFrame, folder: str, run_id: int) -> None:
    """Append a run's rows under ``folder``; the manifest row, written last, is what makes the run visible."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{folder}/rows")
    one = df.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(READER_VERSION).alias("min_reader"))
    one.write.mode("append").parquet(f"{folder}/manifest")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of committed runs; fails if a run needs a newer reader."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    if not manifest.where(F.col("min_reader") > READER_VERSION).isEmpty():
        raise ValueError("the store needs a newer reader")
    return spark.read.parquet(f"{folder}/rows").join(manifest.select("run_id").distinct(), "run_id", "left_semi")
