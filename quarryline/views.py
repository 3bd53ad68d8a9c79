"""Analytic views: the given tables seen as software evidence.

Orders are commits, their lines the files that they touch, customers authors, parts files, suppliers
modules of a dependency graph, years analysis runs.  Each view is a method of ``Views`` and, under the same name in
``SQL``, a text for DuckDB.  Views are plans over the whole tables: nothing is sampled, and nothing runs here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL: dict[str, str] = {
    # in order of dependency
    "touches": """
  SELECT DISTINCT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, o_orderpriority AS subject, l_partkey AS path
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "churn": """
  SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (subject = '1-URGENT') AS fixes
  FROM touches GROUP BY path""",
    "modules": """
  SELECT l.path, p.p_brand AS package, l.complexity, l.coupling, l.loc, coalesce(c.commits, 0) AS commits, coalesce(c.authors, 0) AS authors, coalesce(c.fixes, 0) AS fixes
  FROM (SELECT l_partkey AS path, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS complexity, CAST(count(DISTINCT l_linenumber) AS DOUBLE) AS coupling,
               CAST(sum(l_quantity) AS BIGINT) AS loc FROM lineitem GROUP BY l_partkey) l
  JOIN part p ON p.p_partkey = l.path LEFT JOIN churn c ON c.path = l.path""",
    "links": """
  SELECT src, dst, count(*) AS weight
  FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst FROM lineitem) s
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst""",
    "edges": """
  SELECT src, dst, count(*) AS weight
  FROM (SELECT l_suppkey AS src, p_size AS size, lead(l_suppkey) OVER w AS dst, lead(p_size) OVER w AS next_size FROM lineitem JOIN part ON p_partkey = l_partkey
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) s
  WHERE dst IS NOT NULL AND size = next_size GROUP BY src, dst""",
    "nodes": """
  SELECT l_suppkey AS id, round(avg(l_quantity), 6) AS complexity, count(*) AS loc, s_nationkey AS domain, min(n_regionkey) AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_suppkey, s_nationkey""",
    "run_files": """
  SELECT year(o_orderdate) AS run_id, p_brand AS path, p_type AS layer, l_suppkey AS dep, l_orderkey AS commit_id, l_extendedprice AS price
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "run_metrics": """
  SELECT run_id, path, name, value FROM (
    SELECT run_id, path, CAST(count(DISTINCT commit_id) AS DOUBLE) AS complexity, CAST(count(DISTINCT dep) AS DOUBLE) AS coupling, round(sum(price) / 100000, 4) AS hotspot_score
    FROM run_files GROUP BY run_id, path) m
  CROSS JOIN LATERAL (VALUES ('complexity', complexity), ('coupling', coupling), ('hotspot_score', hotspot_score)) AS t(name, value)""",
    "paths": """
  SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path, html FROM pages""",
    "calls": """
  SELECT l_orderkey AS caller, p_type AS name, l_linenumber AS argc FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "signatures": """
  SELECT p_type AS name, min(p_size) % 3 + 1 AS min_args, min(p_size) % 3 + 1 + max(p_size) % 4 AS max_args, count(*) AS declarations FROM part GROUP BY p_type""",
    "snapshots": """
  SELECT run_id, count(DISTINCT path) AS modules, round(avg(value) FILTER (name = 'complexity'), 4) AS mean_complexity,
         round(avg(value) FILTER (name = 'coupling'), 4) AS mean_coupling, round(avg(value) FILTER (name = 'hotspot_score'), 4) AS health
  FROM run_metrics GROUP BY run_id""",
    "steps": """
  SELECT user_id, event_id, event_type AS state, lead(event_type) OVER w AS next_state, ts, lead(ts) OVER w AS next_ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "rated": """
  SELECT d.doc_id, l.quality, l.toxic, length(d.text) AS size, d.lang, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


#: Sizes of files are broadcast for so many keys from 0 on, in lists of 64 neighbouring keys: some 80 MB at most.
_LISTED, _NEAR_BITS = 1 << 23, 6


def with_sizes(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """``lines`` joined with parts(p_partkey, p_size) of their ``l_partkey``; lines whose part stands in a list without gaps and repetitions are not shuffled, all others are joined."""
    key, at = F.col("p_partkey"), F.col("l_partkey")
    near = lambda k: F.shiftright(k, _NEAR_BITS).alias("near")
    place = lambda k: k.bitwiseAND(F.lit((1 << _NEAR_BITS) - 1)).cast("int")
    lists = parts.where((key >= 0) & (key < _LISTED)).groupBy(near(key)).agg(F.sort_array(F.collect_list(F.struct(place(key).alias("i"), F.col("p_size").alias("size")))).alias("x"))
    lists = lists.where(F.col("x")["i"] == F.sequence(F.lit(0), F.lit((1 << _NEAR_BITS) - 1))).select("near", F.col("x")["size"].alias("sizes"))
    looked = lines.select("*", near(at)).join(F.broadcast(lists), "near", "left")  # bounded by the range of keys
    looked = looked.select(*lines.columns, F.get("sizes", place(at)).alias("p_size"))
    rest = looked.where("p_size is null").drop("p_size").join(parts.hint("merge"), key == at).select(*lines.columns, "p_size")  # parts are more than their compressed file tells: never broadcast whole
    return looked.where("p_size is not null").unionByName(rest)


class Views:
    """DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def within(self, first: int, last: int) -> Views:
        """The same views over the runs of ``first`` to ``last`` only; the range of dates reaches the scan of orders."""
        return _Within(self.spark, self.sf_dir, first, last)

    @cached_property
    def touches(self) -> DataFrame:
        """(commit_id, author, ts, subject, path): a commit touches each of its files once."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))
        commits = self.table("orders").select(
            F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject")
        )
        return lines.distinct().join(commits, "commit_id").select("commit_id", "author", "ts", "subject", "path")

    @cached_property
    def churn(self) -> DataFrame:
        """(path, commits, authors, fixes); urgent orders are fixes."""
        return self.touches.groupBy("path").agg(
            F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.count_if(F.col("subject") == "1-URGENT").alias("fixes")
        )

    @cached_property
    def modules(self) -> DataFrame:
        """One row for each file: (path, package, complexity, coupling, loc, commits, authors, fixes)."""
        size = self.table("lineitem").groupBy(F.col("l_partkey").alias("path")).agg(
            F.countDistinct("l_suppkey").cast("double").alias("complexity"),
            F.countDistinct("l_linenumber").cast("double").alias("coupling"),
            F.sum("l_quantity").cast("long").alias("loc"),
        )
        named = self.table("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("package"))
        return size.join(named, "path").join(self.churn, "path", "left").select(
            "path", "package", "complexity", "coupling", "loc", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "authors", "fixes"))
        )

    @cached_property
    def links(self) -> DataFrame:
        """(src, dst, weight): how often one module's line directly follows another's in a commit."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        steps = self.table("lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
        return steps.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))

    @cached_property
    def edges(self) -> DataFrame:
        """The dependency graph, whole and sparse: lines that directly follow each other in a commit and touch files of one size; a module may depend on itself."""
        lines = with_sizes(self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), self.table("part").select("p_partkey", "p_size"))
        # lines that differ in quantity alone are of one module and file, so that their order among themselves changes nothing: quantities need not be shuffled
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        steps = lines.select(F.col("l_suppkey").alias("src"), F.col("p_size").alias("size"), F.lead("l_suppkey").over(order).alias("dst"), F.lead("p_size").over(order).alias("next_size"))
        return steps.where("dst is not null and size = next_size").groupBy("src", "dst").agg(F.count("*").alias("weight"))

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, complexity, loc, domain, region) of every module of the graph."""
        sized = self.table("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_quantity"), 6).alias("complexity"), F.count("*").alias("loc"))
        where = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        where = where.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("domain"), F.col("n_regionkey").alias("region"))
        return sized.join(where, "id")

    @cached_property
    def run_files(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(self.table("part"), F.col("p_partkey") == F.col("l_partkey"))
        return lines.select(
            F.year("o_orderdate").alias("run_id"),
            F.col("p_brand").alias("path"),
            F.col("p_type").alias("layer"),
            F.col("l_suppkey").alias("dep"),
            F.col("l_orderkey").alias("commit_id"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def run_metrics(self) -> DataFrame:
        """(run_id, path, name, value): three metrics of every package in every yearly run."""
        wide = self.run_files.groupBy("run_id", "path").agg(
            F.countDistinct("commit_id").cast("double").alias("complexity"),
            F.countDistinct("dep").cast("double").alias("coupling"),
            F.round(F.sum("price") / 100000, 4).alias("hotspot_score"),
        )
        return wide.unpivot(["run_id", "path"], ["complexity", "coupling", "hotspot_score"], "name", "value")

    @cached_property
    def paths(self) -> DataFrame:
        """(page_id, url, path, html): urls without scheme, query and fragment are the paths."""
        bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
        return self.table("pages").select("page_id", "url", bare.alias("path"), "html")

    @cached_property
    def calls(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("part"), F.col("p_partkey") == F.col("l_partkey"))
        return lines.select(F.col("l_orderkey").alias("caller"), F.col("p_type").alias("name"), F.col("l_linenumber").alias("argc"))

    @cached_property
    def signatures(self) -> DataFrame:
        low = F.min("p_size") % 3 + 1
        return self.table("part").groupBy(F.col("p_type").alias("name")).agg(
            low.alias("min_args"), (low + F.max("p_size") % 4).alias("max_args"), F.count("*").alias("declarations")
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        def mean(name):
            return F.round(F.avg(F.when(F.col("name") == name, F.col("value"))), 4)

        return self.run_metrics.groupBy("run_id").agg(
            F.countDistinct("path").alias("modules"), mean("complexity").alias("mean_complexity"), mean("coupling").alias("mean_coupling"), mean("hotspot_score").alias("health")
        )

    @cached_property
    def steps(self) -> DataFrame:
        """Every event of a user with the one after it."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(
            "user_id", "event_id", F.col("event_type").alias("state"), F.lead("event_type").over(order).alias("next_state"), "ts", F.lead("ts").over(order).alias("next_ts")
        )

    @cached_property
    def rated(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", F.length("text").alias("size"), "lang", "source")
        return docs.join(self.table("labels"), "doc_id").select("doc_id", "quality", "toxic", "size", "lang", "source")


class _Within(Views):
    def __init__(self, spark: SparkSession, sf_dir: str, first: int, last: int):
        super().__init__(spark, sf_dir)
        self.first, self.last = first, last

    def table(self, name: str) -> DataFrame:
        whole = super().table(name)
        if name != "orders":
            return whole
        start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (self.first, self.last + 1))
        return whole.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
