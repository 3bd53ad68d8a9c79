"""The flagship plan: churn, impact, rank and percentile make a risk tier for every file.

Ranks over all files need a global order.  It is made without gathering all rows in one task: rows are
range-partitioned by the sort key, ranked within each partition, and offset by the partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions.queries import _IMPACT, _impact
from ..store import materialize
from ..views import Views

c = F.col


def global_rank(rows: DataFrame, *order, name: str = "rank", first_of: str | None = None) -> DataFrame:
    """``rows`` with their 1-based position in ``order``, by range partitions; and, as ``first``, the position of the first row with the same ``first_of``, which leads the order.

    Only values at the ends of a partition may go on in the next, so two rows for each partition tell where these began.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offset = size.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row for each partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.withColumn("__k", within).join(F.broadcast(offset), "__part").withColumn(name, c("__k") + c("__before")).drop("__k", "__before")
    if first_of is None:
        return placed.drop("__part")
    placed = placed.withColumn("__first", F.min(name).over(Window.partitionBy("__part", first_of)))
    ends = placed.groupBy("__part").agg(*(f(F.struct(name, first_of, "__first")).alias(k) for k, f in (("a", F.min), ("z", F.max))))
    ends = ends.select(F.explode(F.array("a", "z")).alias("e")).groupBy(c(f"e.{first_of}").alias("__value")).agg(F.min("e.__first").alias("__began"))
    placed = placed.join(F.broadcast(ends), c(first_of).eqNullSafe(c("__value")), "left")
    return placed.withColumn("first", F.least("__first", "__began")).drop("__part", "__first", "__value", "__began")


def cutoff(start: float, by_fix: float, shift: float, low: float, high: float, fixes, accurate):
    """A percentile that falls with every fix and with a verdict that was accurate, and rises with one that was not, within bounds."""
    moved = start - by_fix * fixes + F.when(accurate, -shift).when(~accurate, shift).otherwise(0.0)
    return F.least(F.lit(high), F.greatest(F.lit(low), moved))


def tier(impact, pct, position, n, fixes, accurate):
    """HIGH and MEDIUM need a floor of impact, a percentile, and a place among a share of all files (one at least)."""
    one = F.lit(1)
    is_high = (impact >= 10) & (pct >= cutoff(90.0, 5.0, 5.0, 75.0, 95.0, fixes, accurate)) & (position <= F.greatest(one, F.ceil(0.15 * n)))
    is_medium = (impact >= 3) & (pct >= cutoff(65.0, 3.0, 3.0, 50.0, 80.0, fixes, accurate)) & (position <= F.greatest(one, F.ceil(0.45 * n)))
    return F.when(is_high, "HIGH").when(is_medium, "MEDIUM").otherwise("LOW")


def risk_tiers(modules: DataFrame) -> DataFrame:
    """(path, impact, position, pct, tier) of modules(path, complexity, impact), and fixes and accurate (the last verdict on the file, or null) if there are such columns."""
    more = [F.col(x) if x in modules.columns else none.alias(x) for x, none in (("fixes", F.lit(0)), ("accurate", F.lit(None).cast("boolean")))]
    rows = modules.select("path", "complexity", F.round("impact", 4).alias("impact"), *more)
    ranked = global_rank(rows, F.desc("impact"), F.desc("complexity"), c("path"), name="position", first_of="impact")
    # the percentile counts all files of at most this impact: those from the first of equals on
    total = ranked.agg(F.count("*").alias("n"))
    j = ranked.join(F.broadcast(total))  # one row
    pct = 100.0 * (c("n") - c("first") + 1) / c("n")
    return j.select("path", "impact", "position", F.round(pct, 6).alias("pct"), tier(c("impact"), pct, c("position"), c("n"), c("fixes"), c("accurate")).alias("tier"))


_TIERS = f"""
WITH verdicts AS (SELECT l_partkey AS file, CASE arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS accurate FROM lineitem GROUP BY l_partkey),
i AS (SELECT path, complexity, fixes, accurate, round({_IMPACT}, 4) AS impact FROM modules LEFT JOIN verdicts ON file = path),
r AS (SELECT path, impact, least(95.0, greatest(75.0, 90.0 - 5.0*fixes + CASE WHEN accurate THEN -5.0 WHEN NOT accurate THEN 5.0 ELSE 0.0 END)) AS high_p,
  least(80.0, greatest(50.0, 65.0 - 3.0*fixes + CASE WHEN accurate THEN -3.0 WHEN NOT accurate THEN 3.0 ELSE 0.0 END)) AS medium_p, row_number() OVER (ORDER BY impact DESC, complexity DESC, path) AS position, 100.0 * count(*) OVER (ORDER BY impact RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS pct, count(*) OVER () AS n FROM i)
SELECT path, impact, position, round(pct, 6) AS pct, CASE WHEN impact >= 10 AND pct >= high_p AND position <= greatest(1, ceil(0.15*n)) THEN 'HIGH' WHEN impact >= 3 AND pct >= medium_p AND position <= greatest(1, ceil(0.45*n)) THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM r"""


@operator("risk_tiers", _TIERS)
def risk_tiers_query(v: Views) -> DataFrame:
    """Tiers with cutoffs that move with fixes and with the last verdict on each file (here: how its last line came back)."""
    last = F.max_by("l_returnflag", c("l_orderkey") * 100 + c("l_linenumber"))
    verdicts = v.table("lineitem").groupBy(c("l_partkey").alias("path")).agg(F.when(last == "A", True).when(last == "R", False).alias("accurate"))
    return risk_tiers(v.modules.withColumn("impact", _impact()).join(verdicts, "path", "left"))


@operator("win_tier", f"SELECT tier, count(*) AS files, round(min(impact), 4) AS least FROM ({_TIERS}) t GROUP BY tier")
def win_tier(v: Views) -> DataFrame:
    return risk_tiers_query(v).groupBy("tier").agg(F.count("*").alias("files"), F.round(F.min("impact"), 4).alias("least"))
