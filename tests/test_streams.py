"""Streams that keep something up to date, over several micro-batches, deletes and repetitions."""

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import incremental, stateful

SCANS = "path string, scan long, seq long, fingerprint string"


def frames(spark, rows, schema):
    return [spark.createDataFrame(r, schema) for r in rows]


def test_changes_from_scan_to_scan(spark):
    # a stays (touched only), b changes, c goes and comes back, d goes at the last scan, e comes late, f is seen twice in a scan
    batches = [
        [("a", 10, 1, "x"), ("b", 10, 1, "x"), ("c", 10, 1, "x"), ("d", 10, 1, "x"), ("a", 20, 2, "x")],
        [("b", 20, 2, "y"), ("d", 20, 2, "x"), ("f", 20, 2, "p"), ("f", 20, 3, "q")],
        [("a", 30, 3, "x"), ("b", 30, 3, "y"), ("c", 30, 3, "x"), ("d", 30, 3, "x"), ("f", 30, 3, "q")],
        [("a", 40, 4, "x"), ("b", 40, 4, "z"), ("c", 40, 4, "x"), ("e", 40, 4, "x"), (incremental.COMPLETE, 46, 0, "")],
    ]
    changes = incremental.snapshot_changes(incremental.staged(frames(spark, batches, SCANS)), period=10, late="5 seconds")
    got = sorted(map(tuple, stateful.run_to_table(changes, "append").collect()))
    assert got == [
        ("a", 10, "added"), ("b", 10, "added"), ("b", 20, "modified"), ("b", 40, "modified"), ("c", 10, "added"), ("c", 20, "deleted"), ("c", 30, "added"),
        ("d", 10, "added"), ("d", 40, "deleted"), ("e", 40, "added"), ("f", 20, "added"), ("f", 40, "deleted"),
    ]


PATCHES = "path string, seq long, kind string, complexity double, loc long"
FILES = "path string, loc long, complexity double, coupling double, impact double, level string, syntax_error boolean"
BASE = [(p, 10, 2.0, 3.0, 5.5, "MEDIUM", False) for p in "abcdefgh"]


def by_hand(patches):
    """Patch after patch."""
    table = {r[0]: dict(zip(("loc", "complexity", "coupling", "impact", "level", "syntax_error"), r[1:], strict=True)) for r in BASE}
    for path, _, kind, complexity, loc in sorted((p for p in patches if p[0] is not None), key=lambda p: p[1]):
        if kind == "deleted":
            table.pop(path, None)
        elif kind == "broken":
            table.setdefault(path, dict.fromkeys(("loc", "complexity", "coupling", "impact", "level")))["syntax_error"] = True
        else:
            coupling = (table.get(path) or {}).get("coupling") or 0.0
            x = max(1.0, complexity)
            impact = round(x * 0.5 + coupling * 1.5, 2)
            table[path] = {"loc": loc, "complexity": x, "coupling": coupling, "impact": impact, "level": "HIGH" if impact >= 10 else "MEDIUM" if impact >= 5 else "LOW", "syntax_error": False}
    return {(p, *r.values()) for p, r in table.items()}


BATCHES = [
    [("a", 1, "parsed", 20.0, 5), ("b", 2, "deleted", None, None), ("c", 3, "broken", None, None), ("new", 4, "parsed", 0.5, 1), (None, 5, "parsed", 1.0, 1)],
    [("b", 6, "parsed", 4.0, 7), ("c", 7, "parsed", 3.0, 2), ("d", 8, "parsed", 9.0, 2), ("d", 9, "deleted", None, None), ("ghost", 10, "broken", None, None), ("e", 11, "parsed", 5.0, 5), ("e", 12, "broken", None, None)],
    [("d", 13, "broken", None, None), ("ghost", 14, "parsed", 2.0, 2), ("f", 15, "deleted", None, None), ("f", 16, "parsed", 6.0, 6), ("nobody", 17, "deleted", None, None)],
    [],
]


def test_patches_in_several_batches(spark):
    table = incremental.PatchedTable(spark.createDataFrame(BASE, FILES), buckets=4)
    got = incremental.run_patches(incremental.staged(frames(spark, BATCHES, PATCHES)), table)
    assert set(map(tuple, got.collect())) == by_hand([p for b in BATCHES for p in b]) and got.count() == len(by_hand([p for b in BATCHES for p in b]))


def test_a_patch_tried_again_and_one_that_fails(spark, monkeypatch):
    table = incremental.PatchedTable(spark.createDataFrame(BASE, FILES), buckets=3)
    first, second = frames(spark, BATCHES[:2], PATCHES)
    table.patch(first, 0)
    table.patch(second, 0)  # the same number: it was merged
    assert set(map(tuple, table.read().collect())) == by_hand(BATCHES[0])
    # a batch that dies before its manifest is written leaves what readers see as it was
    write = incremental.PatchedTable._write

    def dies(self, rows, version, dirty, before):
        rows.select("*", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows-{version}")
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental.PatchedTable, "_write", dies)
    with pytest.raises(RuntimeError):
        table.patch(second, 1)
    assert set(map(tuple, table.read().collect())) == by_hand(BATCHES[0])
    monkeypatch.setattr(incremental.PatchedTable, "_write", write)
    table.patch(second, 1)
    assert set(map(tuple, table.read().collect())) == by_hand([p for b in BATCHES[:2] for p in b])


def test_only_dirty_buckets_are_rewritten(spark):
    table = incremental.PatchedTable(spark.createDataFrame(BASE, FILES), buckets=8)
    table.patch(spark.createDataFrame([("a", 1, "parsed", 20.0, 5)], PATCHES), 0)
    assert sorted(table.versions().values()) == [-1] * 7 + [0]


def test_an_empty_table_is_patched(spark):
    table = incremental.PatchedTable(spark.createDataFrame([], FILES), buckets=2)
    assert table.read().count() == 0
    table.patch(spark.createDataFrame([("a", 1, "parsed", 20.0, 5)], PATCHES), 0)
    assert [tuple(r) for r in table.read().collect()] == [("a", 5, 20.0, 0.0, 10.0, "HIGH", False)]
    table.patch(spark.createDataFrame([("a", 2, "deleted", None, None)], PATCHES), 1)
    assert table.read().count() == 0


def test_a_log_takes_nothing_twice(spark):
    schema = "correlation string, at timestamp, action string"
    day = "2024-01-{:02d} 00:00:00".format

    def entries(*rows):
        return spark.createDataFrame([(k, day(d), "x") for k, d in rows], "correlation string, at string, action string").withColumn("at", F.to_timestamp("at"))

    batches = [entries(("a", 1), ("b", 1), ("a", 1)), entries(("b", 1), ("c", 2), ("d", 2)), entries(("d", 2), ("e", 5)), entries(("a", 1), ("c", 2), ("e", 5), ("f", 6))]
    got = stateful.run_to_table(incremental.append_log(incremental.staged(batches)), "append")
    assert got.schema.simpleString() == f"struct<{schema.replace(' ', ':').replace(',:', ',')}>"
    assert sorted(r.correlation for r in got.collect()) == ["a", "b", "c", "d", "e", "f"]


def test_sessions_of_bounded_batches(spark):
    """Events out of order in their table come in order of time, in batches of a bounded number, none of them late, each once."""
    rows = [(i, i % 7, (i * 7919) % 3000 * 60) for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts").repartition(5)
    end = spark.createDataFrame([(10**7,)], "s long").selectExpr("timestamp_seconds(s) AS ts")
    stream = incremental.staged_by_time(events.unionByName(end, allowMissingColumns=True), rows_a_batch=400)
    got = stateful.run_to_table(stateful.sessions(stream, "5 minutes"), "append")
    want = []
    for user in range(7):
        times = sorted(s for _, u, s in rows if u == user)
        for s in times:
            if want and want[-1][0] == user and s - want[-1][2] < 300:
                want[-1][2:] = [s, want[-1][3] + 1]
            else:
                want.append([user, s, s, 1])
    assert sorted(tuple(r) for r in got.select("user_id", F.unix_seconds("start"), "n").collect()) == sorted((u, a, n) for u, a, _, n in want)
