"""Incremental upkeep by streams: snapshot differences, patched tables, append-only logs.

* ``snapshot_changes`` keeps each path's last fingerprint, and an event-time timer for the scan that should see it next;
* ``PatchedTable`` merges micro-batches of patches into a bucketed table and publishes each version by its manifest;
* ``append_log`` drops what was logged already.

``staged`` puts frames into a folder one after the other, as a source of several micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..store import new_path

c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The path of the rows that say that a scan is complete.
COMPLETE = ""


def staged(frames: Sequence[DataFrame], *, files_a_batch: int = 1) -> DataFrame:
    """The frames as a stream that takes one after the other; each is written as one file."""
    spark = frames[0].sparkSession
    folder = new_path(spark, "staged")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def staged_by_time(events: DataFrame, *, rows_a_batch: int = 1_000_000) -> DataFrame:
    """``events`` as a stream in order of ``ts``, in micro-batches of about ``rows_a_batch`` rows, so that a watermark ends state on the way; those without a time come first.

    Events of one time are never parted, so none comes after a later one.
    """
    batches = -(-events.count() // rows_a_batch)
    if batches < 2:
        return staged([events])
    cuts = events.agg(F.percentile_approx("ts", F.array(*(F.lit(i / batches) for i in range(1, batches))), F.lit(100 * batches)).alias("cuts"))
    nth = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("ts"))), F.lit(0))
    folder = new_path(events.sparkSession, "by-time")
    placed = events.join(F.broadcast(cuts)).withColumn("nth", F.when(F.col("ts").isNull(), 0).otherwise(nth)).drop("cuts")  # one row
    placed.repartition(batches, "nth").write.partitionBy("nth").parquet(folder)
    read = events.sparkSession.read.schema(T.StructType([*events.schema.fields, T.StructField("nth", T.IntegerType())])).parquet(folder)
    return staged([read.where(F.col("nth") == i).drop("nth") for i in range(batches)])


# -- changes between full scans


class _Tracker(StatefulProcessor):
    """One path: its fingerprint and the scan that saw it last; a timer at the next scan ends it."""

    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "fingerprint string, scan long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        if path == COMPLETE:
            return
        seen = {}
        for r in sorted((r for b in rows for r in zip(b["scan"], b["seq"], b["fingerprint"], strict=True)), key=lambda r: r[:2]):
            seen[int(r[0])] = r[2]  # the last one of a scan
        last = self.last.get() if self.last.exists() else None
        out = []
        for scan, fingerprint in seen.items():
            if last is not None and scan > last[1] + self.period:
                out.append((path, last[1] + self.period, "deleted"))
                last = None
            if last is None:
                out.append((path, scan, "added"))
            elif fingerprint != last[0]:
                out.append((path, scan, "modified"))
            last = (fingerprint, scan)
        self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last[1] + self.period) * 1000)
        yield pd.DataFrame(out, columns=["path", "scan", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        missed = self.last.get()[1] + self.period
        self.last.clear()
        yield pd.DataFrame([(key[0], missed, "deleted")], columns=["path", "scan", "change"])

    def close(self) -> None:
        pass


def snapshot_changes(scans: DataFrame, *, period: int, late: str) -> DataFrame:
    """(path, scan, change) of a stream of scans(path, scan, seq, fingerprint): added, modified or deleted; a path that is seen unchanged gives nothing.

    ``scan`` is the second at which a full scan was taken, one every ``period`` seconds; ``seq`` orders what a scan says twice of a path.  A path that the next scan doesn't
    see is deleted, and its state with it: a timer tells, once rows or a completion mark (path ``COMPLETE``) of more than ``late`` after that scan have come.
    """
    scans.sparkSession.conf.set(_PROVIDER, _ROCKS)
    timed = scans.withColumn("at", F.timestamp_seconds("scan")).withWatermark("at", late)
    return timed.groupBy("path").transformWithStateInPandas(_Tracker(period), "path string, scan long, change string", "Append", "EventTime")


# -- patched tables


def folded(patches: DataFrame) -> DataFrame:
    """What patches(path, seq, kind, complexity, loc) of each path come to: the last of each kind (parsed, broken, deleted), whatever their number."""
    def last(kind, *more):
        return F.max(F.when(c("kind") == kind, F.struct("seq", *more)))

    parsed, broken, deleted = last("parsed", "complexity", "loc"), last("broken"), last("deleted")
    g = patches.where("path is not null").groupBy("path").agg(parsed.alias("parsed"), broken.alias("broken"), deleted.alias("deleted"))
    gone = F.coalesce("deleted.seq", F.lit(-1))
    return g.select(
        "path",
        c("deleted").isNotNull().alias("was_deleted"),
        F.when(c("parsed.seq") > gone, c("parsed")).alias("parsed"),
        ((c("broken.seq") > gone) & (c("broken.seq") > F.coalesce("parsed.seq", F.lit(-1)))).alias("is_broken"),
    )


def patched(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current(path, loc, complexity, coupling, impact, level, syntax_error)`` after folded changes.

    A parsed file gets new facts and keeps its coupling; one that doesn't parse keeps what it had, marked; a deleted one goes, and comes back without coupling.
    """
    old = current.join(changes.select("path"), "path", "left_anti")
    j = changes.join(current, "path", "left")
    coupling = F.when(c("was_deleted"), 0.0).otherwise(F.coalesce("coupling", F.lit(0.0)))
    complexity = F.greatest(F.lit(1.0), c("parsed.complexity"))
    impact = F.round(complexity * 0.5 + coupling * 1.5, 2)
    fresh = c("parsed").isNotNull()
    kept = ~c("was_deleted")
    broken = F.coalesce("is_broken", F.lit(False))

    def of(new, name):
        return F.when(fresh, new).when(kept, c(name)).alias(name)

    level = F.when(impact >= 10, "HIGH").when(impact >= 5, "MEDIUM").otherwise("LOW")
    touched = j.where(fresh | broken).select(
        "path", of(c("parsed.loc"), "loc"), of(complexity, "complexity"), of(coupling, "coupling"), of(impact, "impact"), of(level, "level"), broken.alias("syntax_error")
    )
    return old.unionByName(touched)


class PatchedTable:
    """A table of files in buckets, patched by micro-batches.

    A batch rewrites the buckets of its dirty paths and nothing else.  A version is visible once its manifest, the last thing that is
    written, says in which version's folder each bucket lies; a batch that is tried again finds its version published, or writes over what it left.
    """

    def __init__(self, base: DataFrame, *, buckets: int = 16):
        self.spark, self.schema, self.buckets = base.sparkSession, base.schema, buckets
        self.folder = new_path(self.spark, "patched")
        self._write(base, -1, list(range(buckets)), {})

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, version: int, dirty: list[int], before: dict[int, int]) -> None:
        rows.select("*", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows-{version}")
        at = before | dict.fromkeys(dirty, version)
        manifest = self.spark.createDataFrame(sorted(at.items()), "bucket int, version long").coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.folder}/manifest/batch={version}")

    def versions(self) -> dict[int, int]:
        """The version that holds each bucket now."""
        rows = self.spark.read.schema("bucket int, version long, batch long").json(f"{self.folder}/manifest")
        last = rows.agg(F.max("batch")).first()[0]
        return {r.bucket: r.version for r in rows.where(c("batch") == last).collect()}

    def published(self) -> int:
        return self.spark.read.schema("bucket int, version long, batch long").json(f"{self.folder}/manifest").agg(F.max("batch")).first()[0]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the version that is published, or of some buckets."""
        out = self.spark.createDataFrame([], self.schema)
        at = self.versions()
        for version in sorted({at[b] for b in at if buckets is None or b in buckets}):
            wanted = [b for b, v in at.items() if v == version and (buckets is None or b in buckets)]
            try:
                rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/rows-{version}")
            except AnalysisException:  # a version without any row
                continue
            out = out.unionByName(rows.where(c("bucket").isin(wanted)).drop("bucket"))
        return out

    def patch(self, batch: DataFrame, number: int) -> None:
        """Merge the patches of a micro-batch; the same number again changes nothing."""
        if number <= self.published():
            return
        path = f"{self.folder}/folded-{number}"
        folded(batch).select("*", self._bucket()).write.mode("overwrite").parquet(path)
        changes = self.spark.read.parquet(path)
        dirty = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # no more than there are buckets
        self._write(patched(self.read(dirty), changes.drop("bucket")), number, dirty, self.versions())


def run_patches(stream: DataFrame, table: PatchedTable) -> DataFrame:
    """Patch ``table`` by all that a stream has, and read it."""
    where = new_path(stream.sparkSession, "patch-checkpoint")
    query = stream.writeStream.foreachBatch(table.patch).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


# -- logs


def append_log(entries: DataFrame, *, key: str = "correlation", late: str = "1 day") -> DataFrame:
    """Log entries(at, key, ...) without those whose key was logged before.

    Keys are kept for as long as their entries could still be repeated: a repetition that comes more than ``late`` behind is dropped for its age.
    """
    return entries.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
