"""Streaming queries; the SQL says what the whole stream amounts to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import operator
from ..views import Views
from . import incremental, stateful

c = F.col
_MICROS = "epoch_us(ts)"


def _utc(ts):
    return F.unix_micros(ts.cast("timestamp"))


def _ended(v: Views, wait: str) -> DataFrame:
    """The events, and a last one without a type ``wait`` after them all, which closes the windows that are still open."""
    events = v.table("events").select("event_id", "user_id", "event_type", "value", c("ts").cast("timestamp").alias("ts"))
    end = events.agg((F.max("ts") + F.expr(f"interval {wait}")).alias("ts")).where("ts is not null")
    return incremental.staged_by_time(events.unionByName(end, allowMissingColumns=True))


@operator("stm_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stm_tumbling(v: Views) -> DataFrame:
    """Daily counts by type, as a stream over event time: a day is put out once, when the watermark has passed it, and its state goes."""
    out = stateful.run_to_table(stateful.tumbling(_ended(v, "3 days"), "1 day"), "append")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@operator("stm_loop", """
SELECT user_id, min(us) // 1000000 AS start, count(*) AS n FROM (
  SELECT user_id, us, sum(CASE WHEN p IS NULL OR us - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) a) b GROUP BY user_id, s""")
def stm_loop(v: Views) -> DataFrame:
    """Debouncing: a user's events are taken together until two hours pass without one."""
    out = stateful.run_to_table(stateful.sessions(_ended(v, "1 day"), "2 hours"), "append")
    return out.select("user_id", F.unix_seconds("start").alias("start"), "n")


_CHANGES = """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS scan, arg_max(event_type, event_id) AS fingerprint FROM events GROUP BY 1, 2),
n AS (SELECT *, lag(scan) OVER w AS before, lag(fingerprint) OVER w AS old, lead(scan) OVER w AS after, max(scan) OVER () AS newest FROM s WINDOW w AS (PARTITION BY path ORDER BY scan))
SELECT path, scan, 'added' AS change FROM n WHERE before IS NULL OR before < scan - 86400
UNION ALL SELECT path, scan, 'modified' FROM n WHERE before = scan - 86400 AND old <> fingerprint
UNION ALL SELECT path, scan + 86400, 'deleted' FROM n WHERE (after IS NULL OR after > scan + 86400) AND scan < newest"""

_DAY = 86400


def _observations(v: Views) -> DataFrame:
    """Days are full scans; a user with an event on a day is a file that the scan sees, with the type of its last event as content."""
    return v.table("events").select(c("user_id").cast("string").alias("path"), F.unix_seconds(F.date_trunc("day", c("ts").cast("timestamp"))).alias("scan"), c("event_id").alias("seq"), c("event_type").alias("fingerprint"))


@operator("stm_changes_stream", _CHANGES)
def stm_changes_stream(v: Views) -> DataFrame:
    """Files added, modified and deleted from scan to scan, as a stream of three micro-batches: state by path, and timers that end it."""
    seen = _observations(v)
    middle = seen.agg(F.min("scan").alias("a"), F.max("scan").alias("z")).first()
    if middle.a is None:
        return v.spark.createDataFrame([], "path string, scan long, change string")
    third = (middle.z - middle.a) // (3 * _DAY) * _DAY
    cuts = [middle.a + third, middle.a + 2 * third]
    done = v.spark.range(1).select(F.lit(incremental.COMPLETE).alias("path"), F.lit(middle.z + _DAY // 2 + 1).alias("scan"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("fingerprint"))
    parts = [seen.where(c("scan") <= cuts[0]), seen.where((c("scan") > cuts[0]) & (c("scan") <= cuts[1])), seen.where(c("scan") > cuts[1]).unionByName(done)]
    return stateful.run_to_table(incremental.snapshot_changes(incremental.staged(parts), period=_DAY, late="12 hours"), "append")


@operator("stm_changes", _CHANGES)
def stm_changes(v: Views) -> DataFrame:
    """The batch twin of the change stream: a path's neighbouring scans by lag and lead."""
    s = _observations(v).groupBy("path", "scan").agg(F.max_by("fingerprint", "seq").alias("fingerprint"))
    w = Window.partitionBy("path").orderBy("scan")
    s = s.select("*", F.lag("scan").over(w).alias("before"), F.lag("fingerprint").over(w).alias("old"), F.lead("scan").over(w).alias("after"))
    newest = _observations(v).agg(F.max("scan").alias("newest"))
    s = s.join(F.broadcast(newest))  # one row
    found = F.array_compact(
        F.array(
            F.when(c("before").isNull() | (c("before") < c("scan") - _DAY), F.struct("scan", F.lit("added").alias("change"))),
            F.when((c("before") == c("scan") - _DAY) & (c("old") != c("fingerprint")), F.struct("scan", F.lit("modified").alias("change"))),
            F.when((c("after").isNull() | (c("after") > c("scan") + _DAY)) & (c("scan") < c("newest")), F.struct((c("scan") + _DAY).alias("scan"), F.lit("deleted").alias("change"))),
        )
    )
    return s.select("path", F.explode(found).alias("x")).select("path", "x.scan", "x.change")


@operator("stm_mtime", """
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'deleted' WHEN a.n <> b.n OR abs(a.s - b.s) > 0.0001 THEN 'modified' ELSE 'same' END AS change
FROM (SELECT user_id, count(*) AS n, sum(value) AS s FROM events WHERE day(ts) <= 15 GROUP BY user_id) a FULL JOIN (SELECT user_id, count(*) AS n, sum(value) AS s FROM events WHERE day(ts) > 15 GROUP BY user_id) b ON a.user_id = b.user_id""")
def stm_mtime(v: Views) -> DataFrame:
    """Two states of every entity compared; both come from one pass."""
    early = F.dayofmonth("ts") <= 15
    n = [F.count_if(early), F.count_if(~early)]
    s = [F.coalesce(F.sum(F.when(k, c("value"))), F.lit(0.0)) for k in (early, ~early)]
    g = v.table("events").groupBy("user_id").agg(n[0].alias("a"), n[1].alias("b"), s[0].alias("x"), s[1].alias("y"))
    change = F.when(c("a") == 0, "added").when(c("b") == 0, "deleted").when((c("a") != c("b")) | (F.abs(c("x") - c("y")) > 1e-4), "modified").otherwise("same")
    return g.select("user_id", change.alias("change"))


@operator("stm_patch", """
WITH base AS (SELECT user_id AS path, 1.0 + count(*) AS complexity, CAST(count(DISTINCT event_type) AS DOUBLE) AS coupling, CAST(sum(length(props)) AS BIGINT) AS loc FROM events WHERE day(ts) < 8 GROUP BY user_id),
p AS (SELECT user_id AS path, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'error' THEN 'broken' ELSE 'parsed' END AS kind, 1 + floor(value / 10) AS complexity, CAST(length(props) AS BIGINT) AS loc FROM events WHERE day(ts) >= 8),
l AS (SELECT path, coalesce(max(seq) FILTER (kind = 'deleted'), -1) AS gone, coalesce(max(seq) FILTER (kind = 'parsed'), -1) AS good, coalesce(max(seq) FILTER (kind = 'broken'), -1) AS bad,
  arg_max(complexity, seq) FILTER (kind = 'parsed') AS complexity, arg_max(loc, seq) FILTER (kind = 'parsed') AS loc FROM p GROUP BY path),
j AS (SELECT coalesce(l.path, b.path) AS path, l.path IS NOT NULL AS dirty, good > gone AS fresh, bad > gone AND bad > good AS broken, gone >= 0 AS was_deleted, l.complexity AS c1, l.loc AS l1, b.complexity AS c0, b.loc AS l0, b.coupling AS k0
  FROM l FULL JOIN base b ON b.path = l.path),
r AS (SELECT path, coalesce(broken, false) AS syntax_error, CASE WHEN fresh THEN l1 WHEN NOT coalesce(was_deleted, false) THEN l0 END AS loc, CASE WHEN fresh THEN c1 WHEN NOT coalesce(was_deleted, false) THEN c0 END AS complexity,
  CASE WHEN fresh THEN CASE WHEN was_deleted THEN 0.0 ELSE coalesce(k0, 0.0) END WHEN NOT coalesce(was_deleted, false) THEN k0 END AS coupling FROM j WHERE NOT dirty OR fresh OR broken)
SELECT CAST(path AS VARCHAR) AS path, loc, complexity, coupling, round(complexity * 0.5 + coupling * 1.5, 2) AS impact,
  CASE WHEN complexity * 0.5 + coupling * 1.5 >= 10 THEN 'HIGH' WHEN complexity * 0.5 + coupling * 1.5 >= 5 THEN 'MEDIUM' WHEN complexity IS NOT NULL THEN 'LOW' END AS level, syntax_error FROM r""")
def stm_patch(v: Views) -> DataFrame:
    """The first week's events are an analysis, those of later days patches: purchases delete a file, errors are files that don't parse; four micro-batches merge them."""
    events = v.table("events").withColumn("path", c("user_id").cast("string")).withColumn("day", F.dayofmonth("ts"))
    coupling = F.countDistinct("event_type").cast("double")
    base = events.where("day < 8").groupBy("path").agg(F.sum(F.length("props")).alias("loc"), (F.lit(1.0) + F.count("*")).alias("complexity"), coupling.alias("coupling"))
    impact = F.round(c("complexity") * 0.5 + c("coupling") * 1.5, 2)
    level = F.when(impact >= 10, "HIGH").when(impact >= 5, "MEDIUM").otherwise("LOW")
    base = base.select("*", impact.alias("impact"), level.alias("level"), F.lit(False).alias("syntax_error"))
    kind = F.when(c("event_type") == "purchase", "deleted").when(c("event_type") == "error", "broken").otherwise("parsed")
    patches = events.where("day >= 8").select("path", c("event_id").alias("seq"), kind.alias("kind"), (1.0 + F.floor(c("value") / 10)).alias("complexity"), F.length("props").cast("long").alias("loc"), "day")
    parts = [patches.where(c("day").between(a, b)).drop("day") for a, b in ((8, 13), (14, 19), (20, 25), (26, 31))]
    return incremental.run_patches(incremental.staged(parts), incremental.PatchedTable(base))


def rate_limit(requests: DataFrame, *, limit: int = 20, micros: int = 1_000_000) -> DataFrame:
    """(client, request, n, limited) of requests(client, at, request): a window of ``micros`` begins with a client's first request after the last window, and takes ``limit`` of them.

    A client's requests pass in order of time, then id; what is kept of it meanwhile is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, start, n = None, 0, 0
        for b in batches:
            counts = []
            for client, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if client != who or at - start >= micros or not n:
                    who, start, n = client, at, 0
                n += 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["client", "request", "n"])

    rows = requests.select("client", "at", "request")
    schema = T.StructType([rows.schema["client"], rows.schema["request"], T.StructField("n", T.LongType())])
    passed = rows.repartition("client").sortWithinPartitions("client", "at", "request").mapInArrow(run, schema)
    return passed.withColumn("limited", c("n") > limit)


@operator("stm_ratelimit", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, event_id, k, start, n) AS (SELECT user_id, event_id, k, us, 1 FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us - r.start < 14400000000 THEN r.start ELSE e.us END, CASE WHEN e.us - r.start < 14400000000 THEN r.n + 1 ELSE 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, CAST(n AS BIGINT) AS n, n > 2 AS limited FROM r""")
def stm_ratelimit(v: Views) -> DataFrame:
    """Users make a few events a day: the query allows two in four hours."""
    asked = v.table("events").select(c("user_id").alias("client"), _utc(c("ts")).alias("at"), c("event_id").alias("request"))
    out = rate_limit(asked, limit=2, micros=4 * 3_600_000_000)
    return out.select(c("client").alias("user_id"), c("request").alias("event_id"), "n", "limited")


_ALLOWED = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"))


@operator("stm_lifecycle", """
SELECT user_id, event_id, state, next_state FROM steps WHERE next_state IS NOT NULL AND (state, next_state) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view'))""")
def stm_lifecycle(v: Views) -> DataFrame:
    """Transitions that the life cycle does not allow."""
    allowed = v.spark.createDataFrame(_ALLOWED, "state string, next_state string")
    return v.steps.where("next_state is not null").join(F.broadcast(allowed), ["state", "next_state"], "left_anti").select("user_id", "event_id", "state", "next_state")


@operator("stm_gate", "SELECT DISTINCT md5(event_type || ':' || CAST(user_id AS VARCHAR)) AS key FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = e.event_type AND f.user_id = e.user_id AND day(f.ts) < 10)")
def stm_gate(v: Views) -> DataFrame:
    """Inputs that no earlier run has seen: only their keys are kept."""
    keyed = v.table("events").select(F.md5(F.concat_ws(":", "event_type", c("user_id").cast("string")).cast("binary")).alias("key"), "ts")
    return keyed.groupBy("key").agg(F.min(F.dayofmonth("ts")).alias("first")).where("first >= 10").select("key")


@operator("stm_poll", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS polls FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) a) b""")
def stm_poll(v: Views) -> DataFrame:
    """Polls counted anew after half an hour without one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = v.table("events").select("user_id", "event_id", "ts", F.lag("ts").over(order).alias("p"))
    new = c("p").isNull() | (_utc(c("ts")) - _utc(c("p")) > 1800000000)
    e = e.withColumn("s", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id", "s").orderBy("ts", "event_id")).cast("long").alias("polls"))


@operator("stm_events", """
SELECT 'run-' || CAST(event_id AS VARCHAR) AS correlation, event_type AS type, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value >= 100 THEN 'COMPLETED' ELSE 'STARTED' END AS action, user_id AS target, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at FROM events""")
def stm_events(v: Views) -> DataFrame:
    """An append-only log fed twice with part of the events: what comes again, soon or late, adds nothing."""
    action = F.when(c("event_type") == "error", "ERROR").when(c("value") >= 100, "COMPLETED").otherwise("STARTED")
    entries = v.table("events").select(
        F.concat(F.lit("run-"), c("event_id").cast("string")).alias("correlation"), c("event_type").alias("type"), action.alias("action"), c("user_id").alias("target"), c("ts").cast("timestamp").alias("at"), F.dayofmonth("ts").alias("day")
    )
    first, then = entries.where("day <= 15").drop("day"), entries.where("day > 15").drop("day")
    again = [entries.where("day in (2, 15)").drop("day"), entries.where("day between 28 and 31").drop("day")]
    log = incremental.append_log(incremental.staged([first, then.unionByName(again[0]), again[1]]))
    return stateful.run_to_table(log, "append").withColumn("at", F.unix_seconds("at"))


def pruned_cache(saved: DataFrame, runs: DataFrame, *, keep_runs: int = 5) -> DataFrame:
    """(stage, version, input_hash, output): what each key of saved(stage, version, input_hash, output, created) was saved as last, without what is older than the ``keep_runs``-th newest of runs(run).

    With fewer runs nothing is pruned.
    """
    last = saved.groupBy("stage", "version", "input_hash").agg(F.max(F.struct("created", "output")).alias("x"))
    oldest = runs.select("run").distinct().orderBy(F.desc("run")).limit(keep_runs).agg(F.when(F.count("*") == keep_runs, F.min("run")).alias("oldest"))  # one row
    fresh = last.join(F.broadcast(oldest)).where(c("oldest").isNull() | (c("x.created") >= c("oldest")))
    return fresh.select("stage", "version", "input_hash", "x.output")


@operator("stm_cache", """
SELECT event_type AS stage, user_id % 2 AS version, md5(CAST(user_id AS VARCHAR)) AS input_hash, list(event_id ORDER BY ts DESC, event_id DESC)[1] AS output FROM events GROUP BY 1, 2, user_id
HAVING max(CAST(ts AS DATE)) >= (SELECT min(d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 5) x)""")
def stm_cache(v: Views) -> DataFrame:
    """Days are runs; a user's event of a type saves the output of that stage for the user."""
    events = v.table("events")
    saved = events.select(
        c("event_type").alias("stage"), (c("user_id") % 2).alias("version"), F.md5(c("user_id").cast("string").cast("binary")).alias("input_hash"), c("event_id").alias("output"), c("ts").alias("created")
    )
    return pruned_cache(saved, events.select(F.date_trunc("day", "ts").alias("run")))


@operator("agg_transitions", "SELECT state, next_state, count(*) AS weight FROM steps WHERE next_state IS NOT NULL GROUP BY 1, 2")
def agg_transitions(v: Views) -> DataFrame:
    return v.steps.where("next_state is not null").groupBy("state", "next_state").agg(F.count("*").alias("weight"))
