"""Runs of an analysis kept over time: several tables to a run under one commit, ids that stay, history, pruning.

Every table of a run is a folder of its own, ``<table>/run=<n>``; a run is visible once its commit row is written, which is the last thing that happens.  A run that
failed leaves folders that nobody reads and that its next attempt writes over.

Files keep their ids from run to run: known paths bring theirs, new ones are numbered behind the greatest id so far, by partition, with one offset for each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_path, numbered

c = F.col
TABLES = {
    "ids": "path string, file_id long",
    "files": "file_id long, size long, fingerprint string",
    "metrics": "file_id long, name string, value double",
    "dependencies": "file_id long, target string",
    "evaluations": "rule string, status string, violations long",
    "violations": "rule string, file_id long, value double",
    "entity_history": "file_id long, action string",
}
_COMMITS = "run long, previous long, files long"


class RunHistory:
    def __init__(self, spark: SparkSession, *, keep: int = 5, folder: str | None = None):
        self.spark, self.keep = spark, keep
        self.folder = folder or new_path(spark, "runs")

    def commits(self) -> DataFrame:
        """(run, previous, files) of every committed run, pruned ones included."""
        try:
            return self.spark.read.schema(_COMMITS).json(f"{self.folder}/commits")
        except AnalysisException:  # none yet
            return self.spark.createDataFrame([], _COMMITS)

    def runs(self) -> list[int]:
        """The runs that are kept, oldest first."""
        return sorted(r.run for r in self.commits().orderBy(F.desc("run")).limit(self.keep).collect())

    def read(self, table: str, runs: list[int] | None = None) -> DataFrame:
        """The rows of a table with their run, of runs that are committed and kept; ids are kept whatever is pruned."""
        committed = [r.run for r in self.commits().select("run").collect()] if table == "ids" else self.runs()
        wanted = [n for n in committed if runs is None or n in runs]
        try:
            rows = self.spark.read.schema(TABLES[table] + ", run long").parquet(f"{self.folder}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[table] + ", run long")
        return rows.where(c("run").isin(wanted))

    def _write(self, table: str, run: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/run={run}")
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{table}/run={run}")

    def persist(self, run: int, files: DataFrame, metrics: DataFrame, dependencies: DataFrame, rules: list[tuple[str, str, float]]) -> None:
        """Add a run of files(path, size), metrics(path, name, value) and dependencies(path, target), with what the rules (name, metric, most) find in it.

        A run that is committed stays as it is.
        """
        commits = {r.run: r for r in self.commits().collect()}
        if run in commits:
            return
        previous = max((n for n in commits if n < run), default=None)
        known = self.read("ids").select("path", "file_id")
        new = numbered(files.select("path").where("path is not null").distinct().join(known, "path", "left_anti"), "file_id", (known.agg(F.max("file_id")).first()[0] or 0) + 1)
        ids = known.unionByName(self._write("ids", run, new))

        def with_id(rows: DataFrame) -> DataFrame:
            return rows.join(ids, "path").drop("path")

        named = self._write("metrics", run, with_id(metrics).select("file_id", "name", "value"))
        deps = self._write("dependencies", run, with_id(dependencies).select("file_id", "target").distinct())
        # what a file is: its size, its metrics and its dependencies, each in order
        measures = named.groupBy("file_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", c("value").cast("string")))).alias("m"))
        targets = deps.groupBy("file_id").agg(F.bit_xor(F.xxhash64("target")).alias("d"))
        whole = with_id(files.select("path", "size")).join(measures, "file_id", "left").join(targets, "file_id", "left")
        digest = F.sha2(F.concat_ws("|", c("size").cast("string"), F.array_join("m", ";"), F.coalesce("d", F.lit(0)).cast("string")), 256)
        now = self._write("files", run, whole.select("file_id", "size", digest.alias("fingerprint")))
        limits = self.spark.createDataFrame(rules, "rule string, name string, most double")
        found = self._write("violations", run, named.join(F.broadcast(limits), "name").where("value > most").select("rule", "file_id", "value"))  # a row for each rule
        counted = limits.join(found.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left")
        self._write("evaluations", run, counted.select("rule", F.when(c("n") > 0, "FAILED").otherwise("PASSED").alias("status"), F.coalesce("n", F.lit(0)).alias("violations")))
        before = self.read("files", [previous] if previous is not None else []).select("file_id", c("fingerprint").alias("was"))
        both = now.select("file_id", "fingerprint").join(before, "file_id", "full")
        action = F.when(c("was").isNull(), "added").when(c("fingerprint").isNull(), "removed").when(c("was") != c("fingerprint"), "modified")
        self._write("entity_history", run, both.select("file_id", action.alias("action")).where("action is not null"))
        commit = self.spark.createDataFrame([(run, previous, now.count())], _COMMITS).coalesce(1)
        commit.write.mode("overwrite").json(f"{self.folder}/commits/of={run}")
        self._prune()

    def _prune(self) -> None:
        """Delete the tables of runs beyond the newest ``keep``; their commits and ids stay."""
        kept = set(self.runs())
        for run in [r.run for r in self.commits().select("run").collect() if r.run not in kept]:
            for table in TABLES:
                if table != "ids":
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/run={run}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
