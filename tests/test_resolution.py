"""Interval joins, near names, import resolution, lineage and test prediction against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph, intervals, joins


def random_ranges(rng, n):
    out = []
    for i in range(n):
        start = rng.randint(-50, 400)
        out.append((rng.choice("ab"), start, start + rng.choice([-1, 0, 0, 1, 3, 7, 8, 20, 63, 64, 200, 1000]), i))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_and_points(spark, seed):
    rng = random.Random(seed)
    ranges = random_ranges(rng, 150) + [("a", 5, 9, 5), ("c", 0, 10, 900)]
    points = [(rng.choice("abd"), rng.randint(-60, 1500)) for _ in range(120)] + [("a", 7)] * 3
    r, p = spark.createDataFrame(ranges, "key string, start long, end long, id long"), spark.createDataFrame(points, "key string, at long")
    hit = {x for x in ranges if any(k == x[0] and x[1] <= at <= x[2] for k, at in points)}
    assert sorted(map(tuple, intervals.touched(r, p).collect())) == sorted(hit)
    want = set()
    for k, at in set(points):
        over = sorted(x[1:] for x in ranges if x[0] == k and x[1] <= at <= x[2])
        if over:
            want.add((k, at, *over[0]))
    got = [tuple(x) for x in intervals.enclosing(p, r).collect()]
    assert set(got) == want and len(got) == len(want)


def test_ranges_touch_three_bins_at_most(spark):
    r = spark.createDataFrame([(i, s, s + w) for i, (s, w) in enumerate(itertools.product((0, 1, 5, -7, 10**6), (0, 1, 2, 3, 1000, 10**9)))], "id long, start long, end long")
    assert intervals.binned(r).groupBy("id").count().agg(F.max("count")).first()[0] <= 3


def test_no_points_or_ranges(spark):
    r, p = spark.createDataFrame([], "key string, start long, end long, id long"), spark.createDataFrame([("a", 1)], "key string, at long")
    assert intervals.touched(r, p).count() == intervals.enclosing(p, r).count() == 0
    one = spark.createDataFrame([("a", 1, 2, 3)], "key string, start long, end long, id long")
    assert intervals.touched(one, p.limit(0)).count() == intervals.enclosing(p.limit(0), one).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near_words():
    rng = random.Random(8)
    base = ["a", "ab", "", "é", "ééa", "load", "laod", "loader", "parse_file", "pares_file", "x" * 31, "x" * 33, "y" * 34]
    base += ["".join(rng.choice("abc") for _ in range(n)) for n in (5, 6, 12, 29, 30, 31, 32, 33, 34, 35, 36, 60, 200)]
    out = set(base)
    for w in base:
        for _ in range(4):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(x))
                kind = rng.random()
                x[at : at + (kind < 0.6)] = rng.choice("abcd") if kind > 0.3 else ""
            out.add("".join(x))
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_no_near_name_is_missed(spark, edits):
    words = near_words()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {tuple(r) for r in joins.within_edits(df, df.withColumnRenamed("w", "v"), edits=edits).collect()}
    want = {(a, b, d) for a in words for b in words if a != b and abs(len(a) - len(b)) <= edits and (d := distance(a, b)) <= edits}
    assert got == want and len(want) > 50


FILES = ["pkg/core/engine.py", "pkg/core.py", "pkg/util/io.py", "other/util/io.py", "app.py", "tests/app.py", "x/core/engine.py", "pkg/core/engine_test.py", "xapp/y.txt"]
NAMES = ["pkg.core.engine", "pkg.core.engine.run", "pkg.core.other", "util.io", "io", "app", "core.engine", "engine", "ngine", "nothing", "core", "y", "t", "pkg.util.io.read", "util", ".", "a..b"]


def resolved(importer, name, files, inside):
    mods = {}
    for f in files:
        mods.setdefault(f.removesuffix(".py").replace("/", "."), f)
    parts = name.split(".")
    for i in range(len(parts), 0, -1):
        if (m := ".".join(parts[:i])) in mods:
            if mods[m] != importer:
                return mods[m]
            break
    for f in files:
        base = f.removesuffix(".py").replace("/", ".")
        if base == name or base.endswith("." + name) or inside and name.replace(".", "/") in f:
            return f if f != importer else None
    return None


@pytest.mark.parametrize("inside", [True, False])
def test_imports_as_by_a_scan(spark, inside):
    pairs = [(f, n) for f in [*FILES, "new.py"] for n in NAMES]
    imports = spark.createDataFrame(pairs + pairs[:5], "importer string, name string")
    files = spark.createDataFrame([(f, i) for i, f in enumerate(FILES)], "path string, rank long")
    got = {tuple(r) for r in joins.resolve_imports(imports, files, inside=inside).collect()}
    assert got == {(f, n, t) for f, n in pairs if (t := resolved(f, n, FILES, inside))}


def test_lineage_of_branching_histories(spark):
    rng = random.Random(2)
    parent = {i: rng.choice([None, *range(i)]) if i % 9 else None for i in range(60)} | {i: i - 1 for i in range(100, 140)} | {100: 999, 200: 3, 201: 3, 202: 3}
    runs = spark.createDataFrame(list(parent.items()), "run_id long, previous_run_id long")
    for depth in (1, 2, 5, 16):
        want = set()
        for i in parent:
            at = parent[i]
            for d in range(1, depth + 1):
                if at is None or at not in parent:
                    break
                want.add((i, d, at))
                at = parent[at]
        got = [tuple(r) for r in graph.ancestors(runs, depth).collect()]
        assert set(got) == want and len(got) == len(want)


def test_tests_that_changes_reach(spark):
    rng = random.Random(6)
    calls = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(45)} | {(100, 101), (101, 102), (102, 100), (103, 100)}
    changed = {(rng.choice([0, 1, 63, 64, 70, 130]), rng.randint(0, 40)) for _ in range(12)} | {(5, 102)}
    tests = {1, 7, 9, 20, 33, 103, 500}
    want = set()
    for change in {k for k, _ in changed}:
        seen = {i for k, i in changed if k == change}
        while more := {a for a, b in calls if b in seen} - seen:
            seen |= more
        want |= {(change, a) for a, b in calls if a in tests and b in seen}
    frame = spark.createDataFrame
    got = graph.predicted_tests(frame(sorted(calls), "src long, dst long"), frame(sorted(changed), "change long, id long"), frame([(t,) for t in tests], "test long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 3


def test_imports_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(name):
        made.add(1)
        return name

    names = [("a.py", "b"), ("a.py", "x.c"), ("b.py", "c.d"), ("c.py", "q")]
    imports = spark.createDataFrame(names, "importer string, name string").select("importer", F.udf(seen)("name").alias("name"))
    files = spark.createDataFrame([("a.py", 1), ("b.py", 2), ("x/c.py", 3)], "path string, rank long")
    assert sorted(map(tuple, joins.resolve_imports(imports, files).collect())) == [("a.py", "b", "b.py"), ("a.py", "x.c", "x/c.py")]
    assert made.value == len(names)
