"""Aggregations: churn, coupling, clusters, health scores, agreement and gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import formulas as M
from ..store import materialize
from ..views import Views

c = F.col


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ca, ce): distinct modules that depend on a node, and that it depends on."""
    ca = edges.groupBy(c("dst").alias("id")).agg(F.countDistinct("src").alias("ca"))
    ce = edges.groupBy(c("src").alias("id")).agg(F.countDistinct("dst").alias("ce"))
    return nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").select("id", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


@operator("agg_churn", "SELECT path, commits, authors, fixes FROM churn")
def agg_churn(v: Views) -> DataFrame:
    return v.churn.select("path", "commits", "authors", "fixes")


@operator("agg_freq", "SELECT path, commits FROM churn ORDER BY commits DESC, path LIMIT 20")
def agg_freq(v: Views) -> DataFrame:
    return v.churn.select("path", "commits").orderBy(F.desc("commits"), "path").limit(20)


_PAIRS = """
  SELECT a.path AS f1, b.path AS f2, count(*) AS joint FROM touches a JOIN touches b ON a.commit_id = b.commit_id AND a.path <> b.path
  WHERE a.commit_id IN (SELECT commit_id FROM touches GROUP BY commit_id HAVING count(*) <= 100) GROUP BY a.path, b.path"""


def _written(touches: DataFrame) -> DataFrame:
    if getattr(touches, "_written", False):
        return touches
    out = materialize(touches.select("commit_id", "path"), "touches")
    out._written = True
    return out


def _shares(touches: DataFrame, share_rows: int) -> int:
    """Parts of at most about ``share_rows`` rows, whatever the size of the table: what a task sorts and counts does not grow with it."""
    return max(int(touches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-touches.count() // share_rows))


def co_changes(touches: DataFrame, most_files: int = 100, *, share_rows: int = 500_000) -> DataFrame:
    """(f1, f2, joint) for every ordered pair of files that change together; commits of more files than ``most_files`` say nothing."""
    touches = _written(touches)
    shares = _shares(touches, share_rows)
    size = F.count("*").over(Window.partitionBy("commit_id"))
    small = touches.select("commit_id", "path").repartition(shares, "commit_id").withColumn("n", size).where(c("n") <= most_files)
    other = small.select("commit_id", c("path").alias("f2"))
    # each pair once, then both ways: half the join and half the shuffle
    pairs = small.select("commit_id", c("path").alias("f1")).join(other, "commit_id").where("f1 < f2").select("f1", "f2")
    once = pairs.repartition(shares, "f1", "f2").groupBy("f1", "f2").agg(F.count("*").alias("joint"))
    ways = F.explode(F.array(F.struct(c("f1").alias("f1"), c("f2").alias("f2")), F.struct(c("f2").alias("f1"), c("f1").alias("f2"))))
    return once.select(ways.alias("w"), "joint").select("w.f1", "w.f2", "joint")


def co_change_ratios(touches: DataFrame, *, share_rows: int = 500_000) -> DataFrame:
    """(f1, f2, ratio): co-changes over the commits of ``f1``."""
    touches = _written(touches)
    n = touches.groupBy(c("path").alias("f1")).agg(F.count("*").alias("commits"))
    pairs = co_changes(touches, share_rows=share_rows).repartition(_shares(touches, share_rows), "f1")
    return pairs.join(n, "f1").select("f1", "f2", (c("joint") / F.greatest(F.lit(1.0), c("commits"))).alias("ratio"))


def omitted(touches: DataFrame, *, least_ratio: float = 0.5) -> DataFrame:
    """(commit_id, f1, f2, ratio): partners that change with a touched file in ``least_ratio`` of its commits or more, and are missing from this one.

    Few pairs reach the ratio, so these are counted first and sent to the commits of their file.
    """
    touches = _written(touches)
    partners = materialize(co_change_ratios(touches).where(c("ratio") >= least_ratio), "partners")
    due = touches.select("commit_id", c("path").alias("f1")).join(partners, "f1")
    return due.join(touches.select("commit_id", c("path").alias("f2")), ["commit_id", "f2"], "left_anti").select("commit_id", "f1", "f2", F.round("ratio", 3).alias("ratio"))


@operator("joi_cochange", f"SELECT f1, f2, joint FROM ({_PAIRS}) p WHERE joint >= 2")
def joi_cochange(v: Views) -> DataFrame:
    return co_changes(v.touches).where("joint >= 2")


@operator("agg_cochange", f"SELECT f1, f2, round(joint / greatest(1.0, commits), 3) AS ratio FROM ({_PAIRS}) p JOIN churn ON churn.path = p.f1")
def agg_cochange(v: Views) -> DataFrame:
    return co_change_ratios(v.touches).select("f1", "f2", F.round("ratio", 3).alias("ratio"))


@operator("joi_omitted", f"""
WITH r AS (SELECT f1, f2, joint / greatest(1.0, commits) AS ratio FROM ({_PAIRS}) p JOIN churn ON churn.path = p.f1 WHERE joint / greatest(1.0, commits) >= 0.1)
SELECT t.commit_id, t.path AS f1, r.f2, round(r.ratio, 3) AS ratio FROM touches t JOIN r ON r.f1 = t.path
WHERE NOT EXISTS (SELECT 1 FROM touches u WHERE u.commit_id = t.commit_id AND u.path = r.f2)""")
def joi_omitted(v: Views) -> DataFrame:
    """Files here have so many commits that no two change together in half of them: the query asks for a tenth."""
    return omitted(v.touches, least_ratio=0.1)


@operator("agg_coupling", """
SELECT n.id, coalesce(i.ca, 0) AS ca, coalesce(o.ce, 0) AS ce FROM nodes n
LEFT JOIN (SELECT dst, count(DISTINCT src) AS ca FROM links GROUP BY dst) i ON i.dst = n.id
LEFT JOIN (SELECT src, count(DISTINCT dst) AS ce FROM links GROUP BY src) o ON o.src = n.id""")
def agg_coupling(v: Views) -> DataFrame:
    return coupling(v.nodes, v.links)


@operator("agg_mkr", """
SELECT o_custkey, coalesce(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 1.0) AS kill_rate FROM orders GROUP BY o_custkey""")
def agg_mkr(v: Views) -> DataFrame:
    killed, able = F.count_if(c("o_orderstatus") == "F"), F.count_if(c("o_orderstatus") != "P")
    return v.table("orders").groupBy("o_custkey").agg(F.coalesce(F.when(able > 0, killed / able), F.lit(1.0)).alias("kill_rate"))


@operator("agg_feedback", "SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def agg_feedback(v: Views) -> DataFrame:
    return v.table("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"))


_HEALTH = "round(greatest(0.0, 100 - 0.5*avg(complexity) - 3*(count(*) FILTER (complexity > 25.6))), 1)"


def clusters(nodes: DataFrame, edges: DataFrame, *, high: float) -> DataFrame:
    """One row for each domain of nodes(id, domain, complexity): size, complexity, modules of more than ``high``, weight of its inner edges, health and level.

    Its members are the rows of ``nodes``: no list of them is gathered.
    """
    many = F.count_if(c("complexity") > high)
    s = nodes.groupBy("domain").agg(
        F.count("*").alias("modules"), F.round(F.sum("complexity"), 4).alias("complexity"), many.alias("high"), F.round(F.avg("complexity"), 1).alias("mean")
    )
    of = nodes.select("id", "domain")
    inner = edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "domain"), "dst").where("a = domain").groupBy("domain").agg(F.sum("weight").alias("internal"))
    # halves go up, whatever the binary form of the mean's tenths makes of them
    health = F.round(M.clamp(100 - (15 * c("high") + 1.5 * c("mean")) + 1e-9, 0, 100), 1)
    level = F.when(c("high") > 0, "HIGH").when(c("mean") >= 8, "MED").otherwise("LOW")
    return s.join(inner, "domain", "left").select(
        "domain", "modules", "complexity", "high", "mean", F.coalesce("internal", F.lit(0)).alias("internal"), health.alias("health"), level.alias("level")
    )


@operator("agg_cluster", """
WITH s AS (SELECT domain, count(*) AS modules, round(sum(complexity), 4) AS complexity, count(*) FILTER (complexity > 26) AS high, round(avg(complexity), 1) AS mean FROM nodes GROUP BY domain),
i AS (SELECT a.domain AS of_domain, CAST(sum(weight) AS BIGINT) AS internal FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.domain = b.domain GROUP BY 1)
SELECT domain, modules, complexity, high, mean, coalesce(internal, 0) AS internal, round(least(100.0, greatest(0.0, 100 - (15 * high + 1.5 * mean) + 1e-9)), 1) AS health,
  CASE WHEN high > 0 THEN 'HIGH' WHEN mean >= 8 THEN 'MED' ELSE 'LOW' END AS level FROM s LEFT JOIN i ON of_domain = domain""")
def agg_cluster(v: Views) -> DataFrame:
    return clusters(v.nodes, v.edges, high=26.0)


@operator("agg_clusteredge", """
SELECT a.domain AS src_domain, b.domain AS dst_domain, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS links, a.domain = b.domain AS internal
FROM links JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1, 2, 5""")
def agg_clusteredge(v: Views) -> DataFrame:
    of = v.nodes.select("id", "domain")
    j = v.links.join(of.toDF("src", "src_domain"), "src").join(of.toDF("dst", "dst_domain"), "dst")
    return j.groupBy("src_domain", "dst_domain").agg(F.sum("weight").alias("weight"), F.count("*").alias("links")).withColumn("internal", c("src_domain") == c("dst_domain"))


@operator("agg_multilevel", "SELECT region, domain, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc FROM nodes GROUP BY ROLLUP (region, domain)")
def agg_multilevel(v: Views) -> DataFrame:
    return v.nodes.rollup("region", "domain").agg(F.count("*").alias("modules"), F.sum("loc").alias("loc"))


@operator("agg_anticollapse", """
SELECT id, CASE WHEN (SELECT count(DISTINCT region) FROM nodes) > 1 THEN CAST(region AS VARCHAR) WHEN (SELECT count(*) FROM nodes) <= 60 THEN CAST(id AS VARCHAR) ELSE 'n' || CAST(domain % 4 AS VARCHAR) END AS cluster FROM nodes""")
def agg_anticollapse(v: Views) -> DataFrame:
    """Clusters by region; where there is but one, single modules, or prefixes when those are many."""
    size = v.nodes.agg(F.countDistinct("region").alias("regions"), F.count("*").alias("n"))
    cluster = F.when(c("regions") > 1, c("region").cast("string")).when(c("n") <= 60, c("id").cast("string")).otherwise(F.concat(F.lit("n"), (c("domain") % 4).cast("string")))
    return v.nodes.join(F.broadcast(size)).select("id", cluster.alias("cluster"))  # one row


_MOD = """SELECT path, round(CAST(fixes AS DOUBLE) / greatest(commits, 1), 2) AS a, round(coupling / (coupling + complexity), 3) AS i FROM modules"""


@operator("agg_modularity", f"""
SELECT round(avg(i), 3) AS instability, round(avg(d), 3) AS distance, count(*) FILTER (z = 'PAIN') AS pain, count(*) FILTER (z = 'USELESSNESS') AS useless, count(*) FILTER (z = 'MAIN_SEQUENCE') AS main,
  CASE WHEN 100*(1 - avg(d)) >= 85 THEN 'A' WHEN 100*(1 - avg(d)) >= 60 THEN 'B' ELSE 'C' END AS grade
FROM (SELECT i, round(abs(a + i - 1), 3) AS d, CASE WHEN round(abs(a + i - 1), 3) <= 0.35 THEN 'MAIN_SEQUENCE' WHEN a + i < 1 THEN 'PAIN' ELSE 'USELESSNESS' END AS z FROM ({_MOD}) m) s""")
def agg_modularity(v: Views) -> DataFrame:
    s = v.modules.select(F.round(c("fixes") / F.greatest(c("commits"), F.lit(1)), 2).alias("a"), F.round(c("coupling") / (c("coupling") + c("complexity")), 3).alias("i"))
    s = s.select("i", M.main_sequence_distance(c("a"), c("i")).alias("d"), M.zone(c("a"), c("i")).alias("z"))
    score = 100 * (1 - F.avg("d"))
    return s.agg(
        F.round(F.avg("i"), 3).alias("instability"),
        F.round(F.avg("d"), 3).alias("distance"),
        *(F.count_if(c("z") == z).alias(n) for z, n in (("PAIN", "pain"), ("USELESSNESS", "useless"), ("MAIN_SEQUENCE", "main"))),
        F.when(score >= 85, "A").when(score >= 60, "B").otherwise("C").alias("grade"),
    )


@operator("agg_health", """
SELECT run_id, round(least(greatest(100*(0.4*greatest(0.0, 1 - 0.8*cycles) + 0.4*greatest(0.0, 1 - density/3) + 0.2*greatest(0.0, 1 - 5*high/n)), 0.0), 100.0), 1) AS health FROM (
  SELECT run_id, CAST(count(*) FILTER (name = 'coupling' AND value >= 100) > 20 AS INTEGER) AS cycles,
    1000.0 * (count(*) FILTER (name = 'complexity' AND value > 320)) / sum(CASE WHEN name = 'complexity' THEN value END) AS density,
    least(count(*) FILTER (name = 'hotspot_score' AND value > 120), ceil(0.15 * count(DISTINCT path))) AS high, CAST(count(DISTINCT path) AS DOUBLE) AS n FROM run_metrics GROUP BY run_id) s""")
def agg_health(v: Views) -> DataFrame:
    """0.4 cycles + 0.4 compliance + 0.2 distribution of each run."""
    def over(name, top):
        return F.count_if((c("name") == name) & (c("value") > top))

    n = F.countDistinct("path")
    s = v.run_metrics.groupBy("run_id").agg(
        (F.count_if((c("name") == "coupling") & (c("value") >= 100)) > 20).cast("int").alias("cycles"),
        (1000.0 * over("complexity", 320) / F.sum(F.when(c("name") == "complexity", c("value")))).alias("density"),
        F.least(over("hotspot_score", 120), F.ceil(0.15 * n)).alias("high"),
        n.cast("double").alias("n"),
    )
    zero = F.lit(0.0)
    whole = 0.4 * F.greatest(zero, 1 - 0.8 * c("cycles")) + 0.4 * F.greatest(zero, 1 - c("density") / 3) + 0.2 * F.greatest(zero, 1 - 5 * c("high") / c("n"))
    return s.select("run_id", F.round(M.clamp(100 * whole, 0, 100), 1).alias("health"))


@operator("agg_health_ci", "SELECT package, greatest(0, 100 - 10*(count(*) FILTER (complexity >= 28)) - 3*(count(*) FILTER (complexity >= 27 AND complexity < 28))) AS health FROM modules GROUP BY package")
def agg_health_ci(v: Views) -> DataFrame:
    high, medium = F.count_if(c("complexity") >= 28), F.count_if((c("complexity") >= 27) & (c("complexity") < 28))
    return v.modules.groupBy("package").agg(F.greatest(F.lit(0), 100 - 10 * high - 3 * medium).alias("health"))


@operator("agg_health_brief", "SELECT package, greatest(40, 100 - 8*(count(*) FILTER (complexity >= 28))) AS health FROM modules GROUP BY package")
def agg_health_brief(v: Views) -> DataFrame:
    return v.modules.groupBy("package").agg(F.greatest(F.lit(40), 100 - 8 * F.count_if(c("complexity") >= 28)).alias("health"))


@operator("agg_health_api", "SELECT package, round(100 * (0.8 + 0.2*greatest(0.0, 1 - 5*(count(*) FILTER (complexity >= 28))/CAST(count(*) AS DOUBLE))), 1) AS health FROM modules GROUP BY package")
def agg_health_api(v: Views) -> DataFrame:
    share = F.count_if(c("complexity") >= 28) / F.count("*").cast("double")
    return v.modules.groupBy("package").agg(F.round(100 * (0.8 + 0.2 * F.greatest(F.lit(0.0), 1 - 5 * share)), 1).alias("health"))


@operator("agg_stability", """
SELECT p.run_id + 1 AS run_id, round(count(q.dep) / CAST(count(*) AS DOUBLE), 6) AS stability
FROM (SELECT DISTINCT run_id, path, dep FROM run_files) p LEFT JOIN (SELECT DISTINCT run_id, path, dep FROM run_files) q ON q.run_id = p.run_id + 1 AND q.path = p.path AND q.dep = p.dep
WHERE p.run_id < (SELECT max(run_id) FROM run_files) GROUP BY p.run_id""")
def agg_stability(v: Views) -> DataFrame:
    """How much of a run's dependencies the next one still has; one shuffle on (path, dep), no self join."""
    deps = v.run_files.select("path", "dep", "run_id").distinct()
    order = Window.partitionBy("path", "dep").orderBy("run_id")
    stays = deps.withColumn("stays", F.coalesce(F.lead("run_id").over(order) == c("run_id") + 1, F.lit(False)))
    last = v.table("orders").agg(F.year(F.max("o_orderdate")).alias("last"))
    s = stays.groupBy("run_id").agg(F.round(F.count_if("stays") / F.count("*"), 6).alias("stability"))
    return s.join(F.broadcast(last), c("run_id") < c("last")).select((c("run_id") + 1).alias("run_id"), "stability")  # one row


def hotspots(metrics: DataFrame, *, limit: float, cutoffs: tuple[float, float, float] = (15.0, 10.0, 5.0)) -> DataFrame:
    """(path, score, severity) of metrics(run_id, path, name, value): twice the runs, three for each violation of ``limit``, five for each rising metric."""

    def rise(name):
        value = F.when(c("name") == name, c("value"))
        run = F.when(c("name") == name, c("run_id"))
        return F.max_by(value, run) - F.min_by(value, run)

    s = metrics.groupBy("path").agg(
        F.countDistinct("run_id").alias("n"), F.count_if((c("name") == "complexity") & (c("value") > limit)).alias("v"), rise("complexity").alias("cx"), rise("coupling").alias("cp")
    )
    score = 2 * c("n") + 3 * c("v") + F.when(c("cx") > 0, 5).otherwise(0) + F.when(c("cp") > 0, 5).otherwise(0)
    critical, high, medium = cutoffs
    severity = F.when(c("score") >= critical, "CRITICAL").when(c("score") >= high, "HIGH").when(c("score") >= medium, "MEDIUM").otherwise("LOW")
    return s.select("path", score.alias("score")).select("path", "score", severity.alias("severity"))


@operator("agg_hotspot", """
SELECT path, score, CASE WHEN score >= 15 THEN 'CRITICAL' WHEN score >= 10 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (
  SELECT path, 2*n + 3*v + CASE WHEN cx > 0 THEN 5 ELSE 0 END + CASE WHEN cp > 0 THEN 5 ELSE 0 END AS score FROM (
  SELECT path, count(DISTINCT run_id) AS n, count(*) FILTER (name = 'complexity' AND value > 300) AS v,
    arg_max(value, run_id) FILTER (name = 'complexity') - arg_min(value, run_id) FILTER (name = 'complexity') AS cx,
    arg_max(value, run_id) FILTER (name = 'coupling') - arg_min(value, run_id) FILTER (name = 'coupling') AS cp FROM run_metrics GROUP BY path) s) t""")
def agg_hotspot(v: Views) -> DataFrame:
    return hotspots(v.run_metrics, limit=300)


@operator("agg_entropy", """
SELECT source, round(avg(n) * avg(s) * count(*) / (avg(f) + 0.1), 4) AS entropy FROM (
  SELECT source, length(text) / 1000.0 AS n, len(string_split(text, chr(10))) AS s, len(regexp_extract_all(text, '#')) / CAST(greatest(length(text), 1) AS DOUBLE) AS f FROM documents) d GROUP BY source""")
def agg_entropy(v: Views) -> DataFrame:
    d = v.table("documents").select(
        "source", (F.length("text") / 1000.0).alias("n"), F.size(F.split("text", "\n")).alias("s"), (F.regexp_count("text", F.lit("#")) / F.greatest(F.length("text"), F.lit(1))).alias("f")
    )
    return d.groupBy("source").agg(F.round(F.avg("n") * F.avg("s") * F.count("*") / (F.avg("f") + 0.1), 4).alias("entropy"))


@operator("agg_averages", "SELECT package, round(avg(complexity), 4) AS complexity, round(avg(coupling), 4) AS coupling, round(avg(complexity) - avg(coupling), 4) AS delta FROM modules GROUP BY package")
def agg_averages(v: Views) -> DataFrame:
    x, y = F.avg("complexity"), F.avg("coupling")
    return v.modules.groupBy("package").agg(F.round(x, 4).alias("complexity"), F.round(y, 4).alias("coupling"), F.round(x - y, 4).alias("delta"))


@operator("agg_snapshot", "SELECT run_id, modules, round(mean_complexity, 2) AS mean_complexity, round(mean_coupling, 2) AS mean_coupling FROM snapshots")
def agg_snapshot(v: Views) -> DataFrame:
    return v.snapshots.select("run_id", "modules", F.round("mean_complexity", 2).alias("mean_complexity"), F.round("mean_coupling", 2).alias("mean_coupling"))


def confusion(rows: DataFrame, predicted, actual, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1), with 0 for a division by 0."""
    n = rows.groupBy(*keys).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    p = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    r = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0)
    return n.select(*keys, "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 3).alias("f1"))


_F1 = """round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE)/(tp + fp) ELSE 0.0 END, 3) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fn) ELSE 0.0 END, 3) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0*(CAST(tp AS DOUBLE)/(tp + fp))*(CAST(tp AS DOUBLE)/(tp + fn))/((CAST(tp AS DOUBLE)/(tp + fp)) + (CAST(tp AS DOUBLE)/(tp + fn))) ELSE 0.0 END, 3) AS f1"""


@operator("agg_confusion", f"""
SELECT lang, tp, fp, fn, {_F1} FROM (
  SELECT lang, count(*) FILTER (size > 1500 AND quality = 1) AS tp, count(*) FILTER (size > 1500 AND quality = 0) AS fp, count(*) FILTER (size <= 1500 AND quality = 1) AS fn FROM rated GROUP BY lang) s""")
def agg_confusion(v: Views) -> DataFrame:
    return confusion(v.rated, c("size") > 1500, c("quality") == 1, "lang")


@operator("agg_threshold", f"""
SELECT arg_max(t, f1 * 100000 + t / 1000.0) AS threshold, max(f1) AS f1 FROM (SELECT t, {_F1} FROM (
  SELECT t, count(*) FILTER (size > t AND quality = 1) AS tp, count(*) FILTER (size > t AND quality = 0) AS fp, count(*) FILTER (size <= t AND quality = 1) AS fn
  FROM rated, (VALUES (250), (500), (750), (1000), (1500), (2000), (3000), (4000)) x(t) GROUP BY t) s) q""")
def agg_threshold(v: Views) -> DataFrame:
    """The best of eight thresholds, the larger of equals; each row is counted at each, in one pass."""
    tops = F.array(*(F.lit(t) for t in (250, 500, 750, 1000, 1500, 2000, 3000, 4000)))
    each = v.rated.select("size", "quality", F.explode(tops).alias("t"))
    return confusion(each, c("size") > c("t"), c("quality") == 1, "t").agg(F.max_by("t", F.struct("f1", "t")).alias("threshold"), F.max("f1").alias("f1"))


@operator("agg_gate", """
SELECT package, len(r) = 0 AS passed, array_to_string(r, ';') AS reasons FROM (
  SELECT package, list_filter([CASE WHEN avg(complexity) > 26 THEN 'complexity' END, CASE WHEN max(coupling) > 11 THEN 'coupling' END, CASE WHEN sum(fixes) > 500 THEN 'fixes' END, CASE WHEN min(loc) < 200 THEN 'size' END], lambda x: x IS NOT NULL) AS r
  FROM modules GROUP BY package) s""")
def agg_gate(v: Views) -> DataFrame:
    checks = ((F.avg("complexity") > 26, "complexity"), (F.max("coupling") > 11, "coupling"), (F.sum("fixes") > 500, "fixes"), (F.min("loc") < 200, "size"))
    s = v.modules.groupBy("package").agg(F.array_compact(F.array(*(F.when(k, n) for k, n in checks))).alias("r"))
    return s.select("package", (F.size("r") == 0).alias("passed"), F.array_join("r", ";").alias("reasons"))


@operator("agg_policysum", "SELECT o_orderpriority AS severity, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY o_orderpriority")
def agg_policysum(v: Views) -> DataFrame:
    return v.table("orders").groupBy(c("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "O").alias("open"))


@operator("agg_completeness", """
SELECT count(*) AS discovered, count(l.doc_id) AS parsed, round(100.0 * count(l.doc_id) / count(*), 2) AS pct, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def agg_completeness(v: Views) -> DataFrame:
    marked = v.table("labels").select("doc_id").distinct().withColumn("parsed", F.lit(1))
    j = v.table("documents").select("doc_id").join(marked, "doc_id", "left")
    return j.agg(F.count("*").alias("discovered"), F.count("parsed").alias("parsed"), F.round(100.0 * F.count("parsed") / F.count("*"), 2).alias("pct"), F.count_if(c("parsed").isNull()).alias("missing"))


@operator("agg_confidence", """
SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'UNKNOWN' WHEN bool_and(value < 90) THEN 'HIGH' WHEN bool_or(event_type = 'signup') THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM events GROUP BY user_id""")
def agg_confidence(v: Views) -> DataFrame:
    unknown, high, medium = F.bool_or((c("event_type") == "error") & (c("value") > 100)), F.bool_and(c("value") < 90), F.bool_or(c("event_type") == "signup")
    return v.table("events").groupBy("user_id").agg(F.when(unknown, "UNKNOWN").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW").alias("tier"))


@operator("agg_limits", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS limitations FROM events WHERE value > 20 GROUP BY user_id")
def agg_limits(v: Views) -> DataFrame:
    return v.table("events").where("value > 20").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("limitations"))


@operator("agg_evcoverage", "SELECT user_id, round(100 * (1 - CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*)), 4) AS coverage FROM events GROUP BY user_id")
def agg_evcoverage(v: Views) -> DataFrame:
    return v.table("events").groupBy("user_id").agg(F.round(100 * (1 - F.count_if(c("event_type") == "error") / F.count("*")), 4).alias("coverage"))


@operator("agg_journal", """
SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS useful, round(coalesce(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE)/nullif(count(*), 0), 1.0), 6) AS accuracy FROM orders GROUP BY o_custkey""")
def agg_journal(v: Views) -> DataFrame:
    useful = F.count_if(c("o_orderstatus") == "F")
    return v.table("orders").groupBy("o_custkey").agg(F.count("*").alias("total"), useful.alias("useful"), F.round(useful / F.count("*"), 6).alias("accuracy"))


@operator("agg_issues", "SELECT o_orderpriority AS pillar, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_issues(v: Views) -> DataFrame:
    return v.table("orders").groupBy(c("o_orderpriority").alias("pillar"), c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@operator("agg_progress", "SELECT o_custkey, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS progress FROM orders GROUP BY o_custkey")
def agg_progress(v: Views) -> DataFrame:
    return v.table("orders").groupBy("o_custkey").agg(F.round(100.0 * F.count_if(c("o_orderstatus") == "F") / F.count("*"), 1).alias("progress"))


@operator("agg_agreement", "SELECT lang, round(avg(CAST((size > 1500) = (quality = 1) AS DOUBLE)), 6) AS agreement FROM rated GROUP BY lang")
def agg_agreement(v: Views) -> DataFrame:
    return v.rated.groupBy("lang").agg(F.round(F.avg(((c("size") > 1500) == (c("quality") == 1)).cast("double")), 6).alias("agreement"))


def _log_gamma(x):
    """The logarithm of the gamma function for x > 0: Stirling's series eight further on, brought back by the recurrence."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    back = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def t_test_p_value(t, df, *, steps: int = 2000):
    """The two-sided p-value of Student's t: its density from 0 to abs(t), integrated by Simpson's rule as an aggregate over a sequence."""
    h = F.abs(t) / steps
    density = lambda i: F.pow(1 + F.pow(i * h, 2) / df, -(df + 1) / 2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda a, i: a + F.when(i % 2 == 1, 4.0).otherwise(2.0) * density(i))
    area = (total + density(F.lit(0)) + density(F.lit(steps))) * h / 3
    scale = F.exp(_log_gamma((df + 1) / 2) - _log_gamma(df / 2)) / F.sqrt(df * math.pi)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * scale * area))


def spearman(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, rho, p_value): rank correlation of two columns within each key, ties at their mean rank; null where either is constant.

    Rows are counted by their pair of values first; both ranks are windows over those counts, so that nothing is joined.
    """
    pairs = rows.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(key, x, y).agg(F.count("*").alias("n"))

    def rank(value):
        below = F.sum("n").over(Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
        return below - (F.sum("n").over(Window.partitionBy(key, value)) - 1) / 2.0

    g = pairs.withColumn("rx", rank(x)).withColumn("ry", rank(y)).withColumn("w", c("n").cast("double"))
    # ranks of n rows have the mean (n + 1) / 2 whatever the ties
    dx, dy = c("rx") - (c("total") + 1) / 2, c("ry") - (c("total") + 1) / 2
    g = g.withColumn("total", F.sum("w").over(Window.partitionBy(key)))
    m = g.groupBy(key).agg(F.max("total").alias("n"), F.sum(c("w") * dx * dy).alias("xy"), F.sum(c("w") * dx * dx).alias("xx"), F.sum(c("w") * dy * dy).alias("yy"))
    rho = F.try_divide(c("xy"), F.sqrt(c("xx") * c("yy")))
    m = m.select(key, "n", rho.alias("rho"))
    df = c("n") - 2
    t = c("rho") * F.sqrt(df / (1 - c("rho") * c("rho")))
    p = F.when(c("rho").isNull(), None).when(df <= 0, F.when(F.abs("rho") >= 1 - 1e-12, 0.0).otherwise(1.0)).when(F.abs("rho") >= 1 - 1e-12, 0.0).otherwise(t_test_p_value(t, df))
    return m.select(key, "rho", p.alias("p_value"))


@operator("agg_spearman", """
WITH r AS (SELECT package, rank() OVER (PARTITION BY package ORDER BY complexity) + (count(*) OVER (PARTITION BY package, complexity) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY package ORDER BY loc) + (count(*) OVER (PARTITION BY package, loc) - 1) / 2.0 AS ry FROM modules),
s AS (SELECT package, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM r GROUP BY package),
t AS (SELECT *, n - 2 AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM s WHERE n > 2 AND abs(rho) < 1 - 1e-12),
p AS (SELECT package, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * t / 10000 / 2 * (1 + (1 + t * t / df) ** (-(df + 1) / 2.0) + list_sum(list_transform(range(1, 10000), lambda i: 2 * (1 + (i * t / 10000) ** 2 / df) ** (-(df + 1) / 2.0)))) AS area FROM t)
SELECT s.package, round(rho, 6) AS rho, round(CASE WHEN rho IS NULL THEN NULL WHEN abs(rho) >= 1 - 1e-12 THEN 0.0 WHEN n <= 2 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - 2 * area)) END, 5) AS p_value FROM s LEFT JOIN p ON p.package = s.package""")
def agg_spearman(v: Views) -> DataFrame:
    """Rank correlation of complexity and size within each package, with the p-value of its t test."""
    return spearman(v.modules, "package", "complexity", "loc").select("package", F.round("rho", 6).alias("rho"), F.round("p_value", 5).alias("p_value"))


@operator("agg_sample", """
SELECT quality, toxic, doc_id FROM (SELECT quality, toxic, doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM rated) s WHERE k <= 6""")
def agg_sample(v: Views) -> DataFrame:
    """Six documents of each tier, by hash: partial top lists first, so no tier is sorted whole in one task."""
    key = F.struct(F.sha2(c("doc_id").cast("string").cast("binary"), 256).alias("h"), "doc_id")
    salted = v.rated.select("quality", "toxic", key.alias("k"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))

    def first_six(df, *by):
        order = Window.partitionBy(*by).orderBy("k")
        return df.withColumn("n", F.row_number().over(order)).where("n <= 6").drop("n")

    return first_six(first_six(salted, "quality", "toxic", "salt"), "quality", "toxic").select("quality", "toxic", "k.doc_id")


def two_level_digest(rows: DataFrame, key: str, order: str, line, *, block: int = 1000) -> DataFrame:
    """(key, digest): lines in order of a whole number, digested by blocks of ``block`` numbers and then over these digests, so that no key's rows meet in one task."""
    of = rows.select(key, F.floor(c(order) / block).alias("block"), F.struct(c(order).alias("at"), line.alias("line")).alias("x"))
    blocks = of.groupBy(key, "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    blocks = blocks.select(key, F.struct("block", F.sha2(F.array_join("x.line", "").cast("binary"), 256).alias("digest")).alias("x"))
    whole = blocks.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select(key, F.sha2(F.array_join("x.digest", "").cast("binary"), 256).alias("digest"))


@operator("agg_hash", """
SELECT source, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM (
  SELECT source, doc_id // 1000 AS block, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text) || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2) b GROUP BY source""")
def agg_hash(v: Views) -> DataFrame:
    """A digest of every source's documents in order of id, over blocks of a thousand ids."""
    d = v.table("documents").select("source", "doc_id", F.sha2(c("text").cast("binary"), 256).alias("h"))
    return two_level_digest(d, "source", "doc_id", F.concat(c("doc_id").cast("string"), F.lit(":"), c("h"), F.lit("\n")))
