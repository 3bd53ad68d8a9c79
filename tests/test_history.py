"""Persisted runs, rank correlation and domains against brute force."""

import math
import random

import pytest

from quarryline import store
from quarryline.operators import aggregates, projections
from quarryline.sources import history

RULES = [("max-n", "n", 5.0), ("max-m", "m", 0.0)]


def batch(spark, files, deps=()):
    frame = spark.createDataFrame
    return (
        frame([(p, s) for p, s, _ in files], "path string, size long"),
        frame([(p, "n", n) for p, _, n in files], "path string, name string, value double"),
        frame(list(deps), "path string, target string"),
    )


def actions(h, run):
    ids = {r.file_id: r.path for r in h.read("ids").collect()}
    return {(ids[r.file_id], r.action) for r in h.read("entity_history", [run]).collect()}


def test_ids_stay_and_history_tells_what_changed(spark):
    h = history.RunHistory(spark, keep=2)
    assert h.runs() == [] and h.read("files").count() == 0
    h.persist(1, *batch(spark, [("a", 1, 2.0), ("b", 1, 9.0), ("c", 1, 1.0)], [("a", "x"), ("a", "x"), ("b", "y")]), RULES)
    first = {r.path: r.file_id for r in h.read("ids").collect()}
    assert sorted(first.values()) == [1, 2, 3] and actions(h, 1) == {(p, "added") for p in "abc"}
    assert {(r.rule, r.status, r.violations) for r in h.read("evaluations").collect()} == {("max-n", "FAILED", 1), ("max-m", "PASSED", 0)}
    assert h.read("dependencies").count() == 2
    # a changes its dependencies, b its metric, c goes, d comes
    h.persist(2, *batch(spark, [("a", 1, 2.0), ("b", 1, 3.0), ("d", 4, 1.0)], [("a", "z"), ("b", "y")]), RULES)
    second = {r.path: r.file_id for r in h.read("ids").collect()}
    assert second == first | {"d": 4} and actions(h, 2) == {("a", "modified"), ("b", "modified"), ("c", "removed"), ("d", "added")}
    h.persist(2, *batch(spark, [("zzz", 1, 1.0)]), RULES)  # committed already
    assert "zzz" not in {r.path for r in h.read("ids").collect()}
    # c is back, under its old id, and compared with the run before
    h.persist(3, *batch(spark, [("a", 1, 2.0), ("c", 1, 1.0), ("e", 1, 1.0)], [("a", "z")]), RULES)
    third = {r.path: r.file_id for r in h.read("ids").collect()}
    assert third == second | {"e": 5} and actions(h, 3) == {("b", "removed"), ("c", "added"), ("d", "removed"), ("e", "added")}
    # the oldest run is pruned, its commit and ids stay
    assert h.runs() == [2, 3] and {r.run for r in h.commits().collect()} == {1, 2, 3}
    assert h.read("files", [1]).count() == 0 and {r.run for r in h.read("files").collect()} == {2, 3}


def test_a_run_that_fails_leaves_nothing_visible(spark, monkeypatch):
    h = history.RunHistory(spark)
    h.persist(1, *batch(spark, [("a", 1, 2.0)]), RULES)
    write = history.RunHistory._write

    def dies(self, table, run, rows):
        if table == "evaluations":
            raise RuntimeError("lost")
        return write(self, table, run, rows)

    monkeypatch.setattr(history.RunHistory, "_write", dies)
    with pytest.raises(RuntimeError):
        h.persist(2, *batch(spark, [("a", 5, 2.0), ("lost", 1, 9.0)]), RULES)
    assert h.runs() == [1] and h.read("files").count() == 1 and {r.path for r in h.read("ids").collect()} == {"a"}
    monkeypatch.setattr(history.RunHistory, "_write", write)
    h.persist(2, *batch(spark, [("a", 5, 2.0), ("found", 1, 9.0)]), RULES)
    assert {r.path: r.file_id for r in h.read("ids").collect()} == {"a": 1, "found": 2} and actions(h, 2) == {("a", "modified"), ("found", "added")}


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).repartition(7)
    got = store.numbered(df, "no", 5)
    assert sorted(r.no for r in got.collect()) == list(range(5, 1005)) and got.columns == ["id", "no"]
    assert store.numbered(df.limit(0), "no", 1).count() == 0


def ranks(v):
    order = sorted(v)
    return [order.index(x) + 1 + (order.count(x) - 1) / 2 for x in v]


def p_by_hand(t, df):
    """The two-sided p-value by the trapezoid of a fine grid."""
    n = 20_000
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = [(1 + (i * abs(t) / n) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
    return max(0.0, min(1.0, 1 - 2 * scale * (sum(f) - (f[0] + f[-1]) / 2) * abs(t) / n))


def test_rank_correlation_and_its_p_value(spark):
    rng = random.Random(4)
    groups = {"noise": [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(40)], "near": [(i, i + rng.randint(-8, 8)) for i in range(60)], "pair": [(1, 2), (2, 3)], "same": [(3, i) for i in range(5)]}
    groups |= {"exact": [(i, -i) for i in range(9)], "one": [(1, 1)], "ties": [(1, 1), (1, 1), (2, 3), (2, 2), (5, 1)], "wide": [(rng.random(), rng.random()) for _ in range(700)]}
    rows = [(k, float(a), float(b)) for k, v in groups.items() for a, b in v] + [("noise", None, 1.0)]
    got = {r.k: (r.rho, r.p_value) for r in aggregates.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    for k, v in groups.items():
        rx, ry = ranks([a for a, _ in v]), ranks([b for _, b in v])
        n, m = len(v), (len(v) + 1) / 2
        xy, xx, yy = (sum((a - m) * (b - m) for a, b in zip(p, q, strict=True)) for p, q in ((rx, ry), (rx, rx), (ry, ry)))
        if not xx * yy:
            assert got[k] == (None, None)
            continue
        rho = xy / math.sqrt(xx * yy)
        p = 0.0 if abs(rho) > 1 - 1e-12 else p_by_hand(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
        assert abs(got[k][0] - rho) < 1e-9 and abs(got[k][1] - p) < 1e-6, k


def test_domains(spark):
    def found(paths, *depths):
        return [tuple(r)[1:] for r in projections.domains(spark.createDataFrame([(p,) for p in paths], "path string"), *depths).collect()]

    assert found(["src/core/engine.py", "src/core/sub/parser.py", "src/interfaces/cli.py", "main.py", "SRC/x.py"], 1, 2) == [("core", "core"), ("core", "core/sub"), ("interfaces", "interfaces"), ("(root)", "(root)"), ("SRC", "SRC")]
    # a directory that all share goes, unless a file lies beside it
    assert found(["tool/a/x.py", "./tool/b/c/y.py", "tool/z.py"], 1, 3) == [("a", "a"), ("b", "b/c"), ("(root)", "(root)")]
    assert found(["tool/a/x.py", "z.py"], 1) == [("tool",), ("(root)",)]
    assert found(["", "a/b/c"], 1) == [("(root)",), ("a",)] and found([], 1) == []
