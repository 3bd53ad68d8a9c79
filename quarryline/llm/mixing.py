"""Operator 10, mixing sources to target weights by entropy balancing.

Each document i of size s_i (words) and source g gets a rate r_i, the expected number of copies.
The rates lie as close as possible to one copy each, in relative entropy

    minimise  sum_i (r_i log r_i - r_i + 1)
    subject to  sum_{i in g} r_i s_i = target_g  and  r_i <= cap,

whose solution tilts the rates exponentially, ``r_i = min(cap, exp(lambda_g s_i / mean_g))``.  The
multipliers maximise the concave dual, and are found by safeguarded Newton steps: each
iteration is one Spark job that sums value and slope of every source's
constraint over a table of (source, size, number of documents), which is grouped once, so a
source with a third of all rows is no larger than its number of different sizes.
The multipliers themselves stay a table, written to the shared folder after each step.

Rates become copies by error diffusion.  The documents of a source are dealt into blocks by a hash of id and
text, and more equal rows than a block holds also by their number, so that no block grows with its source.  Within a block documents go from long to short, and each takes
the whole number next to its rate, above or below, that brings the words taken so far closest to
the words due so far; so a block misses its share by about half its shortest documents' size.  Reruns give the same
copies, since nothing depends on the order of rows.

Targets: sources in order of code points, null last, weigh ``weights`` in turn, and share
``share`` of all words; none gets more than ``cap`` times its own words, and what is
beyond goes to the others by weight, until none is above.

Defined results: a document without words has rate 1 and takes nothing; a source without
words has target 0; if all sources are at the cap, the words that are left are given to none; repeated rows are documents of
their own (equal rows get copies in either order); an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import unused
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 60
_CLOSE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``, one row for each source.

    The excess over the cap is reshared by weight in closed form: with sources in order
    of size over weight, those whose cap is below the level that the rest then
    gets are full.  The sums over sources run as windows over one row for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*(F.lit(float(w)) for w in weights))
    ranked = total.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(ring, (F.col("place") % len(weights) + 1).cast("int")))
    # fill sources in order of the level, words for each unit of weight, at which they reach their cap
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    due = F.sum("source_size").over(everyone) * F.lit(float(share))
    ranked = ranked.withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
    ranked = ranked.withColumn("weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.greatest((due - F.col("full_before")) / F.col("weight_left"), F.lit(0.0)))
    ranked = ranked.withColumn("is_full", F.col("source_size") * cap <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("is_full"), F.struct("place_by_level", "level"))).over(everyone)["level"]
    ranked = ranked.withColumn("place_by_level", F.row_number().over(by_level)).withColumn("common", level)
    target = F.when(F.col("is_full"), F.col("source_size") * cap).otherwise(F.col("common") * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, scale, tilt): the multipliers of the dual, by Newton steps kept within brackets."""
    spark = sizes.sparkSession
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = materialize(counts, "mix-sizes")
    state = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = state.join(targets, state.source.eqNullSafe(targets.source)).select(state.source, "scale", "source_size", "target")
    # at its cap a source takes all rates at the cap: no finite multiplier, and none is needed
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    zero = F.col("target") <= 0
    state = state.select("source", "scale", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (full | zero).alias("done"), full.alias("full"))
    state = materialize(state, "mix-tilts")
    for _ in range(_STEPS):
        if state.where("not done").isEmpty():
            break
        at = counts.join(state.where("not done").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        x = F.col("size") / F.col("scale")
        power = F.col("tilt") * x
        inside = power < float(np.log(cap))
        rate = F.when(inside, F.exp(power)).otherwise(F.lit(float(cap)))
        sums = at.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("value"),
            F.sum(F.when(inside, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        now = state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        # the log of the value is closer to a line than the value, so Newton steps go on it
        step = F.col("tilt") - F.log(F.col("value") / F.col("target")) * F.col("value") / F.greatest("slope", F.lit(1e-300))
        now = now.withColumns({"low": low, "high": high, "step": step, "gap": F.abs(gap) / F.col("target")})
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("low") + 1 + F.abs("low"), F.col("high") - 1 - F.abs("high"))
        good = F.coalesce(F.col("step") > F.col("low"), F.lit(True)) & F.coalesce(F.col("step") < F.col("high"), F.lit(True)) & (F.abs(F.col("step") - F.col("tilt")) < 8)
        close = (F.col("gap") < _CLOSE) | F.coalesce(F.col("high") - F.col("low") < 1e-13 * (1 + F.abs("high")), F.lit(False))
        move = ~F.col("done") & ~close
        now = now.select(
            "source", "scale", "target",
            F.when(move, F.when(good, F.col("step")).otherwise(middle)).otherwise(F.col("tilt")).alias("tilt"),
            "low", "high", (F.col("done") | close).alias("done"), "full",
        )
        state = materialize(now, "mix-tilts")
    return state.select("source", "scale", "tilt", "full", "target")


def _diffuse(table: pa.Table) -> pa.Table:
    """Whole copies of a block's documents, from long to short."""
    size, rate, key = (table.column(c).to_numpy() for c in ("size", "rate", "tie"))
    by = np.lexsort((key, -size))
    due = taken = 0.0
    copies = np.zeros(len(by), np.int64)
    for i in by:
        s, r = float(size[i]), float(rate[i])
        due += s * r
        low = np.floor(r + 1e-9)
        up = s and abs(due - taken - (low + 1) * s) < abs(due - taken - low * s) and r - low > 1e-9
        copies[i] = low + bool(up)
        taken += copies[i] * s
    return table.select(["row"]).append_column("copies", pa.array(copies))


def _number(rows: DataFrame) -> DataFrame:
    """``rows(source, tie, row)`` with a number from 0 among those of one source and tie.

    ``row`` holds its partition in its high bits; rows are numbered within a partition, after the counts of those before.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("source", "tie").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.groupBy("source", "tie", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    upto = upto.select(F.col("source").alias("s"), F.col("tie").alias("t"), F.col("part").alias("p"), "before")
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "tie", "part").orderBy("row")) - 1)
    met = inside.join(upto, F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t")) & (F.col("part") == F.col("p")))
    return met.select("row", (F.col("before") + F.col("k")).alias("number"))


def mix(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    share: float = 1.0,
    block_rows: int = 2000,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, tie) for every row of ``docs``; see the module's text."""
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), F.xxhash64(F.col(id_column), F.col(text_column)).alias("tie")
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    targets = materialize(source_targets(rows, weights=weights, cap=cap, share=share), "mix-targets")
    tilt = tilts(rows, targets, cap)
    blocks = rows.groupBy("source").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    of = blocks.join(targets.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")))
    of = of.join(tilt.select(F.col("source").alias("s2"), "scale", "tilt", "full"), F.col("source").eqNullSafe(F.col("s2")), "left")
    of = materialize(of.select(F.col("source").alias("of"), "blocks", "source_size", "target", "scale", "tilt", "full"), "mix-of")
    x = F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * x)))
    rated = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    often = materialize(rows.groupBy("source", "tie").count().where(F.col("count") > block_rows).select(F.col("source").alias("of_source"), F.col("tie").alias("of_tie")), "mix-often")
    if often.isEmpty():
        rated = rated.withColumn("block", F.pmod("tie", "blocks"))
    else:
        same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("tie") == F.col("of_tie"))
        numbered = _number(rows.join(often, same).select("source", "tie", "row")).select(F.col("row").alias("of_row"), "number")
        rated = rated.join(numbered, F.col("row") == F.col("of_row"), "left")
        block = F.pmod(F.col("tie") + F.coalesce(F.floor(F.col("number") / block_rows), F.lit(0)), F.col("blocks"))
        rated = rated.withColumn("block", block).drop("of_row", "number")
    copies = rated.groupBy("source", "block").applyInArrow(lambda t: _diffuse(t.select(["row", "size", "rate", "tie"])), "row long, copies long")
    out = rated.join(copies, "row")
    return out.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "rate", "copies", "tie")


def repeat_rows(docs: DataFrame, mixed: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (of the same documents) takes it.

    Rows meet by a hash of id and text; rows that repeat both are told apart by number.
    """
    tie, no, copies, copy = (unused(x, docs) for x in ("tie", "no", "copies", "copy"))
    by_tie = Window.partitionBy(tie).orderBy(F.lit(0))
    rows = docs.withColumn(tie, F.xxhash64(F.col(id_column), F.col(text_column))).withColumn(no, F.row_number().over(by_tie))
    taken = mixed.select(F.col("tie").alias(tie), F.col("copies").alias(copies)).withColumn(no, F.row_number().over(by_tie))
    met = rows.join(taken.where(F.col(copies) > 0), [tie, no])
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
