"""Queries over sources: facts of source text, stored runs, and their like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import operator
from ..store import new_path
from ..views import Views

c = F.col


@operator("src_store", "SELECT run_id, path, name, value FROM run_metrics WHERE run_id = 1999")
def src_store(v: Views) -> DataFrame:
    """Runs appended to the store, read back for one key: the partition filter prunes all other runs' files."""
    folder = new_path(v.spark, "store")
    v.run_metrics.write.partitionBy("run_id").parquet(folder)
    return v.spark.read.parquet(folder).where("run_id = 1999").select(c("run_id").cast("int"), "path", "name", "value")


@operator("src_pagelinks", r"""
SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) AS target FROM pages""")
def src_pagelinks(v: Views) -> DataFrame:
    """Edges from pages to what they refer to."""
    return v.table("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)))).alias("target"))


@operator("src_multi", r"""
SELECT 'page' AS kind, path AS id FROM paths UNION SELECT 'host', split_part(path, '/', 1) FROM paths UNION SELECT 'lang', split_part(path, '/', 2) FROM paths""")
def src_multi(v: Views) -> DataFrame:
    parts = F.split("path", "/")
    kinds = F.array(F.struct(F.lit("page").alias("kind"), c("path").alias("id")), F.struct(F.lit("host").alias("kind"), parts[0].alias("id")), F.struct(F.lit("lang").alias("kind"), F.get(parts, F.lit(1)).alias("id")))
    return v.paths.select(F.inline(kinds)).dropDuplicates(["kind", "id"])


@operator("snk_snapshot", "SELECT run_id, count(*) AS rows, round(sum(value), 2) AS total FROM run_metrics GROUP BY run_id")
def snk_snapshot(v: Views) -> DataFrame:
    """Each run exported as JSON lines, read back and summed."""
    folder = new_path(v.spark, "snapshot")
    v.run_metrics.select("run_id", F.to_json(F.struct("path", "name", "value")).alias("value")).write.partitionBy("run_id").text(folder)
    back = v.spark.read.text(folder).select("run_id", F.from_json("value", "path string, name string, value double").alias("m"))
    return back.groupBy("run_id").agg(F.count("*").alias("rows"), F.round(F.sum("m.value"), 2).alias("total"))


@operator("snk_replace", "SELECT path, run_id, value FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, name) AS k FROM run_metrics WHERE name <> 'hotspot_score') s WHERE k = 1")
def snk_replace(v: Views) -> DataFrame:
    """The last row of each key, by a grouped maximum."""
    m = v.run_metrics.where("name <> 'hotspot_score'").groupBy("path").agg(F.min(F.struct((-c("run_id")).alias("r"), "name", "value")).alias("m"))
    return m.select("path", (-c("m.r")).alias("run_id"), "m.value")
