"""Rule evaluation, detectors, and run history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions.text import glob
from ..store import append_run, materialize, new_path, read_runs
from ..views import Views
from .aggregates import coupling
from .graph import _CYCLES, cycles

c = F.col

#: A rule plugin turns metrics and a limit into violations (rule, path, run_id, value).
PLUGINS: dict[str, Callable[[DataFrame, str, float], DataFrame]] = {}


def plugin(kind: str):
    def keep(f):
        PLUGINS[kind] = f
        return f

    return keep


@plugin("max-metric")
def _above(metrics: DataFrame, name: str, limit: float) -> DataFrame:
    return metrics.where((c("name") == name) & (c("value") > limit)).select(F.lit(f"max-{name}").alias("rule"), "path", "run_id", "value")


@plugin("min-metric")
def _below(metrics: DataFrame, name: str, limit: float) -> DataFrame:
    return metrics.where((c("name") == name) & (c("value") < limit)).select(F.lit(f"min-{name}").alias("rule"), "path", "run_id", "value")


def evaluate(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Violations of (kind, metric, limit) rules; kinds without a plugin are skipped."""
    plans = [PLUGINS[k](metrics, name, limit) for k, name, limit in rules if k in PLUGINS]
    if not plans:
        return metrics.select(F.lit("").alias("rule"), "path", "run_id", "value").limit(0)
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


PACK = [("max-metric", "complexity", 300.0), ("max-metric", "coupling", 99.0), ("min-metric", "hotspot_score", 10.0), ("unknown-kind", "complexity", 1.0)]
_VIOL = """SELECT 'max-complexity' AS rule, path, run_id, value FROM run_metrics WHERE name = 'complexity' AND value > 300 UNION ALL
  SELECT 'max-coupling', path, run_id, value FROM run_metrics WHERE name = 'coupling' AND value > 99 UNION ALL
  SELECT 'min-hotspot_score', path, run_id, value FROM run_metrics WHERE name = 'hotspot_score' AND value < 10"""


@operator("rul_complexity", "SELECT path, run_id, value FROM run_metrics WHERE name = 'complexity' AND value > 300")
def rul_complexity(v: Views) -> DataFrame:
    return _above(v.run_metrics, "complexity", 300.0).drop("rule")


@operator("rul_coupling", "SELECT path, run_id, value FROM run_metrics WHERE name = 'coupling' AND value > 99")
def rul_coupling(v: Views) -> DataFrame:
    return _above(v.run_metrics, "coupling", 99.0).drop("rule")


@operator("rul_dispatch", _VIOL)
def rul_dispatch(v: Views) -> DataFrame:
    return evaluate(v.run_metrics, PACK)


def statuses(metrics: DataFrame, rules: list[tuple], disabled: frozenset[str] = frozenset()) -> DataFrame:
    """(run_id, rule, status, violations) of every rule in every run: SKIPPED if disabled, ERROR if no plugin knows its kind, else FAILED or PASSED."""
    named = [(f"{k[:3]}-{n}", k in PLUGINS) for k, n, _ in rules]
    every = metrics.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(ok).alias("known")) for n, ok in named))).alias("r"))
    live = [r for r in rules if f"{r[0][:3]}-{r[1]}" not in disabled]
    n = evaluate(metrics, live).groupBy("run_id", "rule").agg(F.count("*").alias("violations"))
    j = every.select("run_id", "r.rule", "r.known").join(n, ["run_id", "rule"], "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    status = F.when(c("rule").isin(*disabled), "SKIPPED").when(~c("known"), "ERROR").when(c("violations") > 0, "FAILED").otherwise("PASSED")
    return j.select("run_id", "rule", status.alias("status"), "violations")


@operator("rul_evalstatus", f"""
WITH viol AS ({_VIOL}) SELECT r.run_id, k.rule, coalesce(k.fixed, CASE WHEN count(x.path) > 0 THEN 'FAILED' ELSE 'PASSED' END) AS status, count(x.path) AS violations
FROM (SELECT DISTINCT run_id FROM run_metrics) r CROSS JOIN (VALUES ('max-complexity', NULL), ('max-coupling', NULL), ('min-hotspot_score', 'SKIPPED'), ('unk-complexity', 'ERROR')) k(rule, fixed)
LEFT JOIN viol x ON x.run_id = r.run_id AND x.rule = k.rule AND k.fixed IS NULL GROUP BY r.run_id, k.rule, k.fixed""")
def rul_evalstatus(v: Views) -> DataFrame:
    metrics = materialize(v.run_metrics, "run-metrics")  # read once, asked by every rule
    return statuses(metrics, PACK, frozenset({"min-hotspot_score"}))


@operator("rul_layer", "SELECT DISTINCT run_id, path, layer FROM run_files WHERE layer LIKE 'ECO%' AND dep % 10 = 7")
def rul_layer(v: Views) -> DataFrame:
    """Files of a layer that depend on modules of another: patterns on both ends."""
    dep = F.concat(F.lit("module/"), c("dep").cast("string"))
    return v.run_files.where(glob(c("layer"), "ECO*") & glob(dep, "module/*7")).select("run_id", "path", "layer").distinct()


#: The policy's default limits: complexity of a module, and modules that depend on it.
MAX_COMPLEXITY, MAX_COUPLING = 12.0, 8
_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def policy(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, target, severity, rank) of nodes(id, name, complexity) and edges(src, dst), to be sorted by (rank, target).

    A rule has an id, a type, a severity, maybe ``enabled``, and a threshold or the patterns of both ends. Names are matched
    without regard to case. Rules of unknown types, severities or without what their type needs are refused.
    """
    plans = []
    for r in rules:
        kind, severity = r.get("type"), r.get("severity", "MEDIUM")
        if not r.get("id") or severity not in _RANK or kind not in ("MAX_COMPLEXITY", "MAX_COUPLING", "FORBIDDEN_DEPENDENCY"):
            raise ValueError(f"no valid rule: {r}")
        if kind == "FORBIDDEN_DEPENDENCY" and not (r.get("source") and r.get("target")):
            raise ValueError(f"a forbidden dependency needs a source and a target: {r}")
        if not r.get("enabled", True):
            continue
        if kind == "MAX_COMPLEXITY":
            hit = nodes.where(c("complexity") > r.get("threshold", MAX_COMPLEXITY)).select(c("name").alias("target"))
        elif kind == "MAX_COUPLING":
            many = edges.groupBy(c("dst").alias("id")).agg(F.countDistinct("src").alias("ca")).where(c("ca") > r.get("threshold", MAX_COUPLING))
            hit = nodes.join(many, "id", "left_semi").select(c("name").alias("target"))
        else:
            # each end is matched once for each module, not for each edge
            ends = [nodes.where(c("name").rlike("(?i)" + r[x])).select(c("id").alias(e), c("name").alias(n)) for x, e, n in (("source", "src", "a"), ("target", "dst", "b"))]
            hit = edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").select(F.concat_ws("->", "a", "b").alias("target"))
        plans.append(hit.select(F.lit(r["id"]).alias("rule"), "target", F.lit(severity).alias("severity"), F.lit(_RANK[severity]).alias("rank")))
    none = nodes.select(F.lit("").alias("rule"), c("name").alias("target"), F.lit("").alias("severity"), F.lit(9).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, plans) if plans else none


_NAMED = "SELECT id, 'r' || CAST(region AS VARCHAR) || '/d' || CAST(domain AS VARCHAR) || '/s' || CAST(id AS VARCHAR) AS name, complexity FROM nodes"


@operator("rul_policy", f"""
WITH n AS ({_NAMED})
SELECT 'POL-COMPLEXITY' AS rule, name AS target, 'MEDIUM' AS severity, 1 AS rank FROM n WHERE complexity > 26 UNION ALL
SELECT 'POL-COUPLING', name, 'HIGH', 0 FROM n JOIN (SELECT dst FROM edges GROUP BY dst HAVING count(DISTINCT src) > 8) e ON e.dst = n.id UNION ALL
SELECT 'POL-LAYERS', a.name || '->' || b.name, 'HIGH', 0 FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.name LIKE 'r0/%' AND b.name LIKE 'r1/%'""")
def rul_policy(v: Views) -> DataFrame:
    name = F.concat(F.lit("r"), c("region").cast("string"), F.lit("/d"), c("domain").cast("string"), F.lit("/s"), c("id").cast("string"))
    rules = [
        {"id": "POL-COMPLEXITY", "type": "MAX_COMPLEXITY", "threshold": 26.0},
        {"id": "POL-COUPLING", "type": "MAX_COUPLING", "severity": "HIGH"},
        {"id": "POL-LAYERS", "type": "FORBIDDEN_DEPENDENCY", "source": "^R0/", "target": "^R1/", "severity": "HIGH"},
        {"id": "POL-OFF", "type": "MAX_COUPLING", "threshold": 0, "enabled": False},
    ]
    return policy(v.nodes.select("id", name.alias("name"), "complexity"), v.edges, rules)


def antipatterns(
    modules: DataFrame, edges: DataFrame, *, god_loc: float = 100, god_complexity: float = 14.0, god_coupling: int = 5, envy: int = 4, shotgun: int = 6, severe: int = 10, brain: float = 18.0, longest_cycle: int = 4
) -> DataFrame:
    """(id, pattern, severity) of modules(id, loc, complexity, abstract) and their edges; a cycle is told at its smallest module."""
    k = coupling(modules, edges).join(modules.select("id", "loc", "complexity", "abstract"), "id")
    god = ((c("loc") >= god_loc) | (c("complexity") >= god_complexity)) & (c("ca") + c("ce") >= god_coupling)

    def found(when, pattern, severity):
        return F.when(when, F.struct(F.lit(pattern).alias("pattern"), severity.alias("severity")))

    checks = [
        F.coalesce(found(god, "GOD_OBJECT", F.lit("HIGH")), found(~god & (c("ce") >= envy) & (c("ce") > 2 * c("ca")), "FEATURE_ENVY", F.lit("MEDIUM"))),
        found(c("ca") >= shotgun, "SHOTGUN_SURGERY", F.when(c("ca") >= severe, "HIGH").otherwise("MEDIUM")),
        found(c("abstract") & (c("ca") == 0) & (c("ce") == 0), "DEAD_ABSTRACTION", F.lit("LOW")),
        found(c("complexity") >= brain, "BRAIN_METHOD", F.lit("HIGH")),
    ]
    single = k.select("id", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("id", "x.pattern", "x.severity")
    rings = cycles(edges, longest_cycle).select(c("cycle")[0].alias("id"), F.lit("CIRCULAR_DEPENDENCY").alias("pattern"), F.lit("HIGH").alias("severity")).distinct()
    return single.unionByName(rings)


@operator("det_antipattern", _CYCLES + """,
k AS (SELECT n.id, n.loc, n.complexity, n.domain % 5 = 0 AS abstract, coalesce(i.ca, 0) AS ca, coalesce(o.ce, 0) AS ce FROM nodes n
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS ca FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(DISTINCT dst) AS ce FROM edges GROUP BY src) o ON o.src = n.id)
SELECT id, 'GOD_OBJECT' AS pattern, 'HIGH' AS severity FROM k WHERE (loc >= 650 OR complexity >= 26) AND ca + ce >= 5
UNION ALL SELECT id, 'FEATURE_ENVY', 'MEDIUM' FROM k WHERE NOT ((loc >= 650 OR complexity >= 26) AND ca + ce >= 5) AND ce >= 4 AND ce > 2 * ca
UNION ALL SELECT id, 'SHOTGUN_SURGERY', CASE WHEN ca >= 10 THEN 'HIGH' ELSE 'MEDIUM' END FROM k WHERE ca >= 6
UNION ALL SELECT id, 'DEAD_ABSTRACTION', 'LOW' FROM k WHERE abstract AND ca = 0 AND ce = 0
UNION ALL SELECT id, 'BRAIN_METHOD', 'HIGH' FROM k WHERE complexity >= 26.2
UNION ALL SELECT DISTINCT cycle[1], 'CIRCULAR_DEPENDENCY', 'HIGH' FROM cyc""")
def det_antipattern(v: Views) -> DataFrame:
    """Modules here have some 600 lines and a mean quantity of 25 as complexity: the query asks for what stands out of that."""
    modules = v.nodes.select("id", "loc", "complexity", (c("domain") % 5 == 0).alias("abstract"))
    return antipatterns(modules, v.edges, god_loc=650, god_complexity=26.0, brain=26.2)


@operator("det_assumption", r"""
SELECT doc_id, n AS hits, round(greatest(0.0, 1 - 5e-2 * n), 4) AS integrity FROM (SELECT doc_id, len(regexp_extract_all(text, 'localhost|127\.0\.0\.1')) + len(regexp_extract_all(text, '[A-Z]:\\')) + len(regexp_extract_all(text, ':[0-9]{4,5}\b')) AS n FROM documents) d""")
def det_assumption(v: Views) -> DataFrame:
    n = sum((F.regexp_count("text", F.lit(p)) for p in (r"localhost|127\.0\.0\.1", r"[A-Z]:\\", r":[0-9]{4,5}\b")), F.lit(0))
    d = v.table("documents").select("doc_id", n.cast("long").alias("hits"))
    return d.select("doc_id", "hits", F.round(F.greatest(F.lit(0.0), 1 - 0.05 * c("hits")), 4).alias("integrity"))


@operator("det_failspace", """
SELECT s.name, s.declarations, count(c.caller) AS called, count(c.caller) FILTER (c.argc = s.min_args) AS low_boundary, count(c.caller) FILTER (c.argc = s.max_args) AS high_boundary FROM signatures s LEFT JOIN calls c ON c.name = s.name GROUP BY 1, 2""")
def det_failspace(v: Views) -> DataFrame:
    """Which boundary cases of a signature calls have tried; calls are counted by name and number first."""
    n = v.calls.groupBy("name", "argc").agg(F.count("*").alias("n"))
    j = v.signatures.join(n, "name", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return j.groupBy("name", "declarations").agg(
        total(c("n")).alias("called"), total(F.when(c("argc") == c("min_args"), c("n"))).alias("low_boundary"), total(F.when(c("argc") == c("max_args"), c("n"))).alias("high_boundary")
    )


@operator("det_safety", """
SELECT package, bool_and(complexity < 30) AND max(fixes) < 16 AS ready, array_to_string(list_filter([CASE WHEN NOT bool_and(complexity < 30) THEN 'HOTSPOT' END, CASE WHEN max(fixes) >= 16 THEN 'REGRESSION' END], lambda x: x IS NOT NULL), ',') AS reasons FROM modules GROUP BY package""")
def det_safety(v: Views) -> DataFrame:
    calm, quiet = F.bool_and(c("complexity") < 30), F.max("fixes") < 16
    return v.modules.groupBy("package").agg((calm & quiet).alias("ready"), F.array_join(F.array_compact(F.array(F.when(~calm, "HOTSPOT"), F.when(~quiet, "REGRESSION"))), ",").alias("reasons"))


@operator("det_evidence", """
SELECT path, 'complexity' AS kind, complexity AS value FROM modules UNION ALL SELECT path, 'coupling', coupling FROM modules UNION ALL SELECT path, 'churn', CAST(commits AS DOUBLE) FROM modules UNION ALL SELECT path, 'size', CAST(loc AS DOUBLE) FROM modules""")
def det_evidence(v: Views) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), c(x).cast("double").alias("value")) for k, x in (("complexity", "complexity"), ("coupling", "coupling"), ("churn", "commits"), ("size", "loc"))))
    return v.modules.select("path", F.inline(rows))


@operator("det_reco", """
SELECT m.path, CASE WHEN p.p_size < 5 THEN 'DO_NOT_RECOMMEND' WHEN m.fixes >= 8 THEN 'PROTECT' WHEN m.complexity >= 27 THEN 'REFACTOR' WHEN m.coupling >= 9 THEN 'INVESTIGATE' ELSE 'DEFER' END AS action FROM modules m JOIN part p ON p.p_partkey = m.path""")
def det_reco(v: Views) -> DataFrame:
    size = v.table("part").select(c("p_partkey").alias("path"), "p_size")
    action = F.when(c("p_size") < 5, "DO_NOT_RECOMMEND").when(c("fixes") >= 8, "PROTECT").when(c("complexity") >= 27, "REFACTOR").when(c("coupling") >= 9, "INVESTIGATE").otherwise("DEFER")
    return v.modules.join(size, "path").select("path", action.alias("action"))


@operator("det_issues", "SELECT path FROM modules WHERE complexity >= 27 AND path NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def det_issues(v: Views) -> DataFrame:
    tracked = v.table("orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("path")).distinct()
    return v.modules.where("complexity >= 27").select("path").join(tracked, "path", "left_anti")


_HIST = """
SELECT run_id, path || ':' || CAST(dep AS VARCHAR) AS entity, action FROM (
  SELECT run_id, path, dep, CASE WHEN lag(run_id) OVER w IS NULL OR lag(run_id) OVER w < run_id - 1 THEN 'added' END AS action FROM (SELECT DISTINCT run_id, path, dep FROM run_files) d WINDOW w AS (PARTITION BY path, dep ORDER BY run_id)
  UNION ALL SELECT run_id + 1, path, dep, CASE WHEN nxt IS NULL OR nxt > run_id + 1 THEN 'removed' END FROM (
    SELECT run_id, path, dep, lead(run_id) OVER (PARTITION BY path, dep ORDER BY run_id) AS nxt FROM (SELECT DISTINCT run_id, path, dep FROM run_files) d2) e WHERE run_id < (SELECT max(run_id) FROM run_files)) h
WHERE action IS NOT NULL"""


def entity_history(deps: DataFrame, last_run: DataFrame) -> DataFrame:
    """(run_id, entity, action): when each dependency came and went; one window, no self join of runs."""
    order = Window.partitionBy("path", "dep").orderBy("run_id")
    d = deps.select("run_id", "path", "dep").distinct().withColumns({"before": F.lag("run_id").over(order), "after": F.lead("run_id").over(order)})
    d = d.join(F.broadcast(last_run))  # one row
    added = F.when(c("before").isNull() | (c("before") < c("run_id") - 1), F.struct(c("run_id").alias("run_id"), F.lit("added").alias("action")))
    gone = (c("run_id") < c("last")) & (c("after").isNull() | (c("after") > c("run_id") + 1))
    removed = F.when(gone, F.struct((c("run_id") + 1).alias("run_id"), F.lit("removed").alias("action")))
    entity = F.concat_ws(":", c("path"), c("dep").cast("string"))
    return d.select(entity.alias("entity"), F.explode(F.array_compact(F.array(added, removed))).alias("e")).select("e.run_id", "entity", "e.action")


@operator("det_history", _HIST)
def det_history(v: Views) -> DataFrame:
    return entity_history(v.run_files, v.table("orders").agg(F.year(F.max("o_orderdate")).alias("last")))


@operator("det_verify", """
SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus <> 'P' AND n >= 2 AND q > 20 AS verified FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def det_verify(v: Views) -> DataFrame:
    n = v.table("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    ok = (c("o_totalprice") > 1000) & (c("o_orderstatus") != "P") & (c("n") >= 2) & (c("q") > 20)
    return v.table("orders").join(n, "o_orderkey").select("o_orderkey", ok.alias("verified"))


@operator("api_dash", "SELECT run_id, count(DISTINCT path) AS files, count(*) FILTER (name = 'complexity' AND value > 300) AS violations FROM run_metrics GROUP BY run_id")
def api_dash(v: Views) -> DataFrame:
    return v.run_metrics.groupBy("run_id").agg(F.countDistinct("path").alias("files"), F.count_if((c("name") == "complexity") & (c("value") > 300)).alias("violations"))


@operator("api_summary", "SELECT count(*) AS modules, round(avg(complexity), 4) AS complexity, CAST(sum(loc) AS BIGINT) AS loc, count(DISTINCT package) AS packages, CAST(sum(fixes) AS BIGINT) AS fixes FROM modules")
def api_summary(v: Views) -> DataFrame:
    return v.modules.agg(F.count("*").alias("modules"), F.round(F.avg("complexity"), 4).alias("complexity"), F.sum("loc").alias("loc"), F.countDistinct("package").alias("packages"), F.sum("fixes").alias("fixes"))


@operator("api_history", f"SELECT run_id, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'removed') AS removed FROM ({_HIST}) h GROUP BY run_id")
def api_history(v: Views) -> DataFrame:
    return det_history(v).groupBy("run_id").agg(F.count_if(c("action") == "added").alias("added"), F.count_if(c("action") == "removed").alias("removed"))


@operator("api_repo", "SELECT package, count(*) AS files FROM modules GROUP BY package")
def api_repo(v: Views) -> DataFrame:
    return v.modules.groupBy("package").agg(F.count("*").alias("files"))


@operator("prv_chain", "SELECT author, count(*) AS evidence, array_to_string(list_transform(list_sort(list_distinct(list(subject))), lambda x: x), ',') AS kinds FROM touches GROUP BY author")
def prv_chain(v: Views) -> DataFrame:
    return v.touches.groupBy("author").agg(F.count("*").alias("evidence"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("kinds"))


@operator("tel_timer", "SELECT user_id, round(sum(value), 4) AS total, count(*) AS stages, round(max(value), 4) AS slowest FROM events GROUP BY user_id")
def tel_timer(v: Views) -> DataFrame:
    return v.table("events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("stages"), F.round(F.max("value"), 4).alias("slowest"))


def latest_feedback(given: DataFrame) -> DataFrame:
    """(path, accurate): the newest verdict on each path of given(path, accurate, at)."""
    return given.groupBy("path").agg(F.max_by("accurate", "at").alias("accurate"))


@operator("api_feedback", """
SELECT l_partkey AS path, arg_max(l_returnflag = 'A', l_orderkey * 100 + l_linenumber) AS accurate FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey""")
def api_feedback(v: Views) -> DataFrame:
    """Verdicts (lines that came back) are appended to a store in two batches, and the newest of each file is read from it."""
    folder = new_path(v.spark, "feedback")
    given = v.table("lineitem").where("l_returnflag <> 'N'").select(c("l_partkey").alias("path"), (c("l_returnflag") == "A").alias("accurate"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("at"))
    for batch in (0, 1):
        append_run(given.where(c("at") % 2 == batch), folder, batch)
    return latest_feedback(read_runs(v.spark, folder))
