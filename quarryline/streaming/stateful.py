"""Structured Streaming over the event table, and the batch twins of its stateful operators.

Streams read the folder of a table with an explicit schema and end when all of it is read
(``availableNow``), so that they can be tested; a trigger on time makes the same plans run on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, *, files: str = "events.parquet", files_a_batch: int | None = None) -> DataFrame:
    """The events as a stream with event time; watermarks need a timestamp with a zone.

    ``files_a_batch`` bounds the files that a micro-batch takes, where a stream has many.
    """
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", files)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events and their value for each type and window of event time."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """A user's events with less than ``gap`` between them are one session."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that there is, into a Parquet table of the shared folder, and read it.

    Every micro-batch overwrites a folder of its own number, so that a batch that is tried again leaves its rows once, and
    a reader never sees a table half replaced.  The table is all of these (append), or the last one (complete).
    """
    spark = stream.sparkSession
    base = new_path(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        write_batch(batch, f"{base}/table", number)

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_batches(spark, stream, f"{base}/table", last_only=mode == "complete")


def write_batch(batch: DataFrame, table: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{table}/batch={number}")


def read_batches(spark: SparkSession, like: DataFrame, table: str, *, last_only: bool) -> DataFrame:
    """The rows of all batches of a table, or of its last one; none if it has none."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(table)
    except AnalysisException:  # no batch was written
        return spark.createDataFrame([], like.schema)
    if last_only:
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
