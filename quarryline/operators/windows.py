"""Ranking, trends, drift and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import formulas as M
from ..functions.queries import _EFFORT, _IMPACT
from ..plans.risk import global_rank
from ..store import materialize
from ..views import Views

c = F.col


def value_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, upto, total): how many rows of a key have each value, have it or less, and are there.

    Rows are counted by value before the window, so a key's window holds its different values, not its rows.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    upto = F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(key, value, "n", upto.alias("upto"), F.sum("n").over(whole).alias("total"))


@operator("win_pctrank", "SELECT package, path, round(100 * cume_dist() OVER (PARTITION BY package ORDER BY complexity), 6) AS pct FROM modules")
def win_pctrank(v: Views) -> DataFrame:
    """The share of values up to one's own, in each package."""
    rows = materialize(v.modules.select("package", "path", "complexity"), "modules")
    j = rows.join(value_ranks(rows, "package", "complexity"), ["package", "complexity"])
    return j.select("package", "path", F.round(100 * (c("upto") / c("total")), 6).alias("pct"))


@operator("win_rank", "SELECT package, path, row_number() OVER (PARTITION BY package ORDER BY complexity DESC, coupling DESC, path) AS position FROM modules")
def win_rank(v: Views) -> DataFrame:
    """Ranked by ranges over all packages, and counted from the first of each, so that no package is sorted in one task."""
    ranked = global_rank(v.modules.select("package", "path", "complexity", "coupling"), c("package"), F.desc("complexity"), F.desc("coupling"), c("path"))
    first = ranked.groupBy("package").agg(F.min("rank").alias("first"))
    return ranked.join(first, "package").select("package", "path", (c("rank") - c("first") + 1).cast("long").alias("position"))


def trends(metrics: DataFrame, runs: DataFrame, depth: int) -> DataFrame:
    """(path, name, velocity, direction) over the last ``depth`` runs: values carried forward, 0 before the first."""
    last = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(depth)
    keys = metrics.join(F.broadcast(last), "run_id", "left_semi").select("path", "name").distinct()  # depth rows
    grid = keys.join(F.broadcast(last)).join(metrics, ["path", "name", "run_id"], "left")
    order = Window.partitionBy("path", "name").orderBy("run_id")
    filled = grid.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    step = filled.withColumn("step", c("value") - F.lag("value").over(order)).groupBy("path", "name").agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("velocity"))
    way = F.when(c("velocity") > 0.01, "rising").when(c("velocity") < -0.01, "falling").otherwise("flat")
    return step.select("path", "name", F.round("velocity", 4).alias("velocity"), way.alias("direction"))


_TREND = """
WITH last_runs AS (SELECT DISTINCT run_id FROM run_metrics ORDER BY run_id DESC LIMIT 4),
grid AS (SELECT k.path, k.name, r.run_id, m.value FROM (SELECT DISTINCT path, name FROM run_metrics WHERE run_id IN (SELECT run_id FROM last_runs)) k CROSS JOIN last_runs r LEFT JOIN run_metrics m ON m.path = k.path AND m.name = k.name AND m.run_id = r.run_id),
filled AS (SELECT path, name, run_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY path, name ORDER BY run_id ROWS UNBOUNDED PRECEDING), 0.0) AS value FROM grid),
s AS (SELECT path, name, coalesce(avg(step), 0.0) AS velocity FROM (SELECT path, name, value - lag(value) OVER (PARTITION BY path, name ORDER BY run_id) AS step FROM filled) x GROUP BY path, name)
SELECT path, name, round(velocity, 4) AS velocity, CASE WHEN velocity > 0.01 THEN 'rising' WHEN velocity < -0.01 THEN 'falling' ELSE 'flat' END AS direction FROM s"""


@operator("win_trend", _TREND)
def win_trend(v: Views) -> DataFrame:
    metrics = materialize(v.run_metrics, "run-metrics")  # read once, used three times
    return trends(metrics, metrics, 4)


@operator("api_trend", _TREND.replace("SELECT path, name, round", "SELECT path || '/' || name AS metric, round").replace("FROM s\"", "FROM s") + " WHERE velocity > 0.01")
def api_trend(v: Views) -> DataFrame:
    t = win_trend(v).where("direction = 'rising'")
    return t.select(F.concat_ws("/", "path", "name").alias("metric"), "velocity", "direction")


@operator("win_history", "SELECT path, array_to_string(list(CAST(CAST(value AS BIGINT) AS VARCHAR) ORDER BY run_id), ',') AS history FROM run_metrics WHERE name = 'complexity' GROUP BY path")
def win_history(v: Views) -> DataFrame:
    rows = v.run_metrics.where("name = 'complexity'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("run_id", c("value").cast("long").alias("value")))).alias("h"))
    return rows.select("path", F.array_join(F.transform("h", lambda x: x["value"].cast("string")), ",").alias("history"))


@operator("win_drift", """
SELECT run_id, round(health - lag(health) OVER w, 4) AS health_delta, round(mean_complexity - lag(mean_complexity) OVER w, 4) AS complexity_delta,
  CASE WHEN lag(health) OVER w IS NULL THEN 'FIRST' WHEN health > lag(health) OVER w THEN 'DEGRADED' WHEN health < lag(health) OVER w THEN 'IMPROVED' ELSE 'STABLE' END AS status
FROM snapshots WINDOW w AS (ORDER BY run_id)""")
def win_drift(v: Views) -> DataFrame:
    """One row for each run: a window over them all is as small as their number."""
    order = Window.orderBy("run_id")
    h = F.lag("health").over(order)
    status = F.when(h.isNull(), "FIRST").when(c("health") > h, "DEGRADED").when(c("health") < h, "IMPROVED").otherwise("STABLE")
    return v.snapshots.select(
        "run_id", F.round(c("health") - h, 4).alias("health_delta"), F.round(c("mean_complexity") - F.lag("mean_complexity").over(order), 4).alias("complexity_delta"), status.alias("status")
    )


@operator("win_median", "SELECT package, list_sort(list(complexity))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM modules GROUP BY package")
def win_median(v: Views) -> DataFrame:
    """The upper median: the first value that half of a package's files and one more reach."""
    ranks = value_ranks(v.modules, "package", "complexity").where(c("upto") >= F.floor(c("total") / 2) + 1)
    return ranks.groupBy("package").agg(F.min("complexity").alias("median"))


@operator("win_latest", "SELECT max(run_id) AS run_id, arg_max(modules, run_id) AS modules FROM snapshots")
def win_latest(v: Views) -> DataFrame:
    return v.snapshots.agg(F.max("run_id").alias("run_id"), F.max_by("modules", "run_id").alias("modules"))


@operator("win_offset", "SELECT path, run_id, value FROM run_metrics WHERE name = 'complexity' AND run_id >= (SELECT run_id FROM snapshots ORDER BY run_id DESC LIMIT 1 OFFSET 4)")
def win_offset(v: Views) -> DataFrame:
    """What is not older than the fifth newest run."""
    fifth = v.snapshots.select("run_id").orderBy(F.desc("run_id")).limit(5).agg(F.min("run_id").alias("oldest"))
    return v.run_metrics.where("name = 'complexity'").join(F.broadcast(fifth), c("run_id") >= c("oldest")).select("path", "run_id", "value")  # one row


_RANGES = "SELECT user_id AS key, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + CAST(floor(value * value) AS BIGINT) AS fin, event_id AS id FROM events WHERE event_type = 'signup'"


def class_ranges(v: Views, kind: str) -> DataFrame:
    """Events of a type open ranges of seconds, from a point to more than a day."""
    start = F.unix_seconds(c("ts").cast("timestamp"))
    return v.table("events").where(c("event_type") == kind).select(c("user_id").alias("key"), start.alias("start"), (start + F.floor(c("value") * c("value"))).alias("end"), c("event_id").alias("id"))


@operator("win_nested", f"""
SELECT e.user_id, e.event_id, list(r.id ORDER BY r.start, r.fin, r.id)[1] AS outer_id FROM events e JOIN ({_RANGES}) r ON r.key = e.user_id AND epoch_us(e.ts) // 1000000 BETWEEN r.start AND r.fin GROUP BY 1, 2""")
def win_nested(v: Views) -> DataFrame:
    """The first range that each event lies in: ranges of any width, found by bins."""
    from .intervals import enclosing

    points = v.table("events").select(c("user_id").alias("key"), F.unix_seconds(c("ts").cast("timestamp")).alias("at"), c("user_id"), "event_id")
    return points.join(enclosing(points, class_ranges(v, "signup")), ["key", "at"]).select("user_id", "event_id", c("id").alias("outer_id"))


@operator("top_hotspot", f"SELECT path, round({_IMPACT}, 4) AS impact FROM modules ORDER BY round({_IMPACT}, 4) DESC, path LIMIT 10")
def top_hotspot(v: Views) -> DataFrame:
    from ..functions.queries import _impact

    return v.modules.select("path", F.round(_impact(), 4).alias("impact")).orderBy(F.desc("impact"), "path").limit(10)


@operator("top_roi", f"SELECT path, round((0.6*coupling + 0.4*complexity) * loc / ({_EFFORT}) * 10, 2) AS roi FROM modules ORDER BY roi DESC, path LIMIT 10")
def top_roi(v: Views) -> DataFrame:
    return v.modules.select("path", M.roi(c("complexity"), c("coupling"), c("loc"), c("loc")).alias("roi")).where("roi > 0").orderBy(F.desc("roi"), "path").limit(10)


@operator("top_reco", "SELECT path, complexity, fixes FROM modules ORDER BY complexity DESC, CASE WHEN fixes >= 8 THEN 0 WHEN fixes >= 4 THEN 1 ELSE 2 END, path LIMIT 20")
def top_reco(v: Views) -> DataFrame:
    rank = F.when(c("fixes") >= 8, 0).when(c("fixes") >= 4, 1).otherwise(2)
    return v.modules.select("path", "complexity", "fixes").orderBy(F.desc("complexity"), rank, "path").limit(20)


@operator("top_priority", """
SELECT path, loc, CASE WHEN k = 1 THEN a END AS alternative1, CASE WHEN k = 1 THEN b END AS alternative2 FROM (
  SELECT path, loc, row_number() OVER w AS k, lead(path, 1) OVER w AS a, lead(path, 2) OVER w AS b FROM (SELECT * FROM modules ORDER BY loc DESC, path LIMIT 10) t WINDOW w AS (ORDER BY loc DESC, path)) s""")
def top_priority(v: Views) -> DataFrame:
    """Ten rows; the first names two alternatives."""
    top = v.modules.select("path", "loc").orderBy(F.desc("loc"), "path").limit(10)
    order = Window.orderBy(F.desc("loc"), "path")
    k = F.row_number().over(order)
    return top.select("path", "loc", *(F.when(k == 1, F.lead("path", n).over(order)).alias(f"alternative{n}") for n in (1, 2)))


@operator("top_issues", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 25")
def top_issues(v: Views) -> DataFrame:
    return v.table("orders").orderBy(F.when(c("o_orderstatus") == "P", 0).otherwise(1), F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@operator("top_modules", f"""
SELECT path, zone, distance FROM (SELECT path, round(abs(a + i - 1), 3) AS distance, CASE WHEN round(abs(a + i - 1), 3) <= 0.35 THEN 'MAIN_SEQUENCE' WHEN a + i < 1 THEN 'PAIN' ELSE 'USELESSNESS' END AS zone
  FROM (SELECT path, round(CAST(fixes AS DOUBLE) / greatest(commits, 1), 2) AS a, round(coupling / (coupling + complexity), 3) AS i FROM modules) s) t
ORDER BY CASE WHEN zone = 'PAIN' THEN 0 ELSE 1 END, distance DESC, path LIMIT 20""")
def top_modules(v: Views) -> DataFrame:
    s = v.modules.select("path", F.round(c("fixes") / F.greatest(c("commits"), F.lit(1)), 2).alias("a"), F.round(c("coupling") / (c("coupling") + c("complexity")), 3).alias("i"))
    s = s.select("path", M.zone(c("a"), c("i")).alias("zone"), M.main_sequence_distance(c("a"), c("i")).alias("distance"))
    return s.orderBy(F.when(c("zone") == "PAIN", 0).otherwise(1), F.desc("distance"), "path").limit(20)


@operator("top_hubs", """
(SELECT 'hub' AS kind, path, coupling FROM modules WHERE coupling > 8 ORDER BY coupling DESC, path LIMIT 10) UNION ALL (SELECT 'leaf', path, coupling FROM modules WHERE coupling <= 8 ORDER BY coupling, path LIMIT 10)""")
def top_hubs(v: Views) -> DataFrame:
    m = v.modules.select("path", "coupling")
    hubs = m.where("coupling > 8").orderBy(F.desc("coupling"), "path").limit(10).select(F.lit("hub").alias("kind"), "path", "coupling")
    return hubs.unionByName(m.where("coupling <= 8").orderBy("coupling", "path").limit(10).select(F.lit("leaf").alias("kind"), "path", "coupling"))


@operator("top_delta", "SELECT path, run_id, delta FROM (SELECT path, run_id, value - lag(value) OVER (PARTITION BY path ORDER BY run_id) AS delta FROM run_metrics WHERE name = 'complexity') d WHERE delta IS NOT NULL ORDER BY delta DESC, path, run_id LIMIT 20")
def top_delta(v: Views) -> DataFrame:
    order = Window.partitionBy("path").orderBy("run_id")
    d = v.run_metrics.where("name = 'complexity'").select("path", "run_id", (c("value") - F.lag("value").over(order)).alias("delta")).where("delta is not null")
    return d.orderBy(F.desc("delta"), "path", "run_id").limit(20)
