"""Small graphs and tables with known results, and properties."""

import hashlib
import hmac
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline import store, views
from quarryline.functions import classify, formulas, text
from quarryline.operators import aggregates, graph, joins, projections, rules, windows
from quarryline.plans import risk
from quarryline.sources.gitlog import parse_log
from quarryline.streaming import queries as stream_queries
from quarryline.streaming import stateful


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, ids, complexity=2.0):
    return spark.createDataFrame([(i, complexity) for i in ids], "id string, complexity double")


LINE = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]


def test_traversal_of_a_line(spark):
    e, c = edges(spark, *LINE), spark.createDataFrame([("C",)], "id string")
    assert {(r.id, r.depth) for r in graph.reach(e, c, 5).collect()} == {("D", 1), ("E", 2)}
    assert {(r.id, r.depth) for r in graph.reach(graph.reverse(e), c, 5).collect()} == {("B", 1), ("A", 2)}
    path = graph.shortest_paths(e, spark.createDataFrame([("A",)], "id string"), 5).where("id = 'E'").first()
    assert path.path == list("ABCDE")
    blast = {r.id: r for r in graph.blast(nodes(spark, "ABCDE"), e, 5).collect()}
    assert blast["C"].score == 7.07 and blast["C"].total == 4


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([("a", "b"), ("b", "c"), ("a", "c")], {}),
        ([("a", "b"), ("b", "a")], {"a->b": 3.0}),
        ([("x", "y"), ("y", "z"), ("z", "x")], {"x->y->z": 6.75}),
        ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], {"a->b": 3.0, "c->d": 3.0}),
    ],
)
def test_cycles_and_components(spark, pairs, want):
    e = edges(spark, *pairs)
    ids = {x for p in pairs for x in p}
    found = graph.cycle_severity(graph.cycles(e, 4), nodes(spark, ids, 1.0))
    assert {r.cycle_id: r.severity for r in found.collect()} == want
    assert {r.id for r in graph.strong_components(e).collect()} == {x for k in want for x in k.split("->")}


def test_closure_reaches_everything(spark):
    e = edges(spark, *LINE, ("E", "C"))
    assert {r.id for r in graph.closure(e, spark.createDataFrame([("B",)], "id string")).collect()} == set("BCDE")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
def test_strong_components_by_brute_force(spark, pairs):
    ids = {x for p in pairs for x in p}
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            for i in ids:
                if a in reach[i]:
                    reach[i].add(b)
    want = {(i, min(j for j in ids if j in reach[i] and i in reach[j])) for i in ids if (i, i) in pairs or any(j != i and j in reach[i] and i in reach[j] for j in ids)}
    got = graph.strong_components(spark.createDataFrame(pairs, "src int, dst int")).collect()
    assert {(r.id, r.component) for r in got} == want


def test_formulas(spark):
    one = spark.range(1)
    c = lambda x: F.lit(float(x))
    r = one.select(
        formulas.effort(c(10), c(6), c(100)).alias("effort"),
        formulas.roi(c(10), c(6), c(8), c(100)).alias("roi"),
        formulas.reduction_percent(c(10)).alias("reduction"),
        formulas.instability(c(1), c(2)).alias("instability"),
        F.round(formulas.churn_multiplier(F.lit(4), F.lit(2), F.lit(3)), 2).alias("churn"),
        formulas.churn_multiplier(F.lit(0), F.lit(2), F.lit(3)).alias("still"),
        formulas.risk_profile(c(10), c(5), F.lit(None).cast("double")).alias("unknown"),
        formulas.sigmoid(c(1000)).alias("sigmoid"),
    ).first()
    assert (r.effort, r.roi, r.reduction, r.instability, r.churn, r.still) == (45.0, 13.51, 60.0, 0.667, 1.45, 1.0)
    assert r.unknown == 0.45 * 40 + 0.30 * 50 + 0.25 * 80 and r.sigmoid < 1


def test_hmac_and_glob(spark):
    r = spark.range(1).select(text.hmac_sha256(F.lit("name"), "k" * 80).alias("h"), text.glob(F.lit("src/a.py"), "src/*.p?").alias("g"), text.at_least_version(F.lit("1.10"), "1.9").alias("v")).first()
    assert r.h == hmac.new(b"k" * 80, b"name", hashlib.sha256).hexdigest() and r.g and r.v


def test_longest_prefix(spark):
    imports = spark.createDataFrame([("m", "a.b.c"), ("m", "x.y"), ("a.b", "a.b.z")], "importer string, name string")
    modules = spark.createDataFrame([("a",), ("a.b",)], "module string")
    got = joins.longest_prefix(imports, modules, separator=".").collect()
    assert {(r.importer, r.target) for r in got} == {("m", "a.b")}  # a module is no import of itself


def test_trend_carries_forward(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    m = spark.createDataFrame([(1, "math", "complexity", 5.0), (2, "math", "complexity", 8.0), (2, "utils", "complexity", 2.0)], "run_id int, path string, name string, value double")
    assert {(r.path, r.velocity, r.direction) for r in windows.trends(m, runs, 5).collect()} == {("math", 3.0, "rising"), ("utils", 2.0, "rising")}


def test_run_diff(spark):
    a = spark.createDataFrame([("p", "x", 1.0), ("q", "x", 2.0)], "path string, name string, value double")
    b = spark.createDataFrame([("p", "x", 3.0), ("r", "x", 4.0)], "path string, name string, value double")
    got = {(r.path, r.kind, r.delta) for r in joins.run_diff(a, b).collect()}
    assert got == {("p", "increased", 2.0), ("q", "removed", -2.0), ("r", "added", 4.0)}


def test_unknown_rules_are_skipped(spark):
    m = spark.createDataFrame([(1, "p", "complexity", 20.0)], "run_id int, path string, name string, value double")
    assert [r.rule for r in rules.evaluate(m, [("nonsense", "complexity", 1.0), ("max-metric", "complexity", 15.0)]).collect()] == ["max-complexity"]
    assert rules.evaluate(m, [("nonsense", "complexity", 1.0)]).count() == 0


def test_mass_commits_make_no_pairs(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "commit_id int, path int")
    assert {(r.f1, r.f2, r.joint) for r in aggregates.co_changes(t, most_files=2).collect()} == {(1, 2, 1), (2, 1, 1)}


def test_log_headers_carry_forward(spark):
    rows = [(1, 0, "COMMIT:h|a|fix"), (1, 1, "x.py"), (1, 2, "y.py"), (2, 0, "COMMIT:i|b|feat"), (2, 1, "x.py")]
    got = parse_log(spark.createDataFrame(rows, "part int, no int, line string"), part="part", order=["no"]).collect()
    assert {(r.header, r.path) for r in got} == {("h|a|fix", "x.py"), ("h|a|fix", "y.py"), ("i|b|feat", "x.py")}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_global_rank_does_not_depend_on_partitions(spark, parts):
    rows = spark.range(200).select(F.pmod(F.xxhash64("id"), F.lit(13)).alias("x"), "id").repartition(parts)
    got = risk.global_rank(rows, F.desc("x"), F.col("id")).orderBy("rank").collect()
    assert [(r.x, r.id) for r in got] == sorted(((r.x, r.id) for r in got), key=lambda t: (-t[0], t[1])) and [r["rank"] for r in got] == list(range(1, 201))


def test_tiers_are_capped_and_follow_impact(spark):
    m = spark.range(100).select(F.col("id").alias("path"), F.lit(1.0).alias("complexity"), (F.col("id") * 1.0).alias("impact"))
    got = {r.path: r.tier for r in risk.risk_tiers(m).collect()}
    assert sum(t == "HIGH" for t in got.values()) <= 15 and got[99] == "HIGH" and got[0] == "LOW"


def test_store_shows_committed_runs_only(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    store.append_run(spark.range(3), folder, 1)
    spark.range(5).withColumn("run_id", F.lit(2)).write.mode("append").partitionBy("run_id").parquet(f"{folder}/rows")
    assert store.read_runs(spark, folder).count() == 3


def test_first_match_order(spark):
    df = spark.createDataFrame([("a_b",), ("abcdefg",), ("abc",)], "n string")
    assert [r.p for r in df.select(classify.name_prefix(F.col("n")).alias("p")).collect()] == ["a", "abcd", "abc"]


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_levels_of_a_long_chain(spark):
    nodes = spark.range(62)
    got = {r.id: r.level for r in graph.topological_levels(nodes, edge_table(spark, [(i, i + 1) for i in range(60)] + [(0, 60), (3, 50)])).collect()}
    assert got == {**{i: i for i in range(61)}, 61: 0}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(nodes, edge_table(spark, [(1, 2), (2, 3), (3, 1)]))


def test_self_loops_are_components_and_cycles(spark):
    edges = edge_table(spark, [(1, 1), (1, 2), (2, 3), (3, 2), (4, 5), (7, 7)])
    assert sorted((r.id, r.component) for r in graph.strong_components(edges).collect()) == [(1, 1), (2, 2), (3, 2), (7, 7)]
    assert sorted(r.cycle for r in graph.cycles(edges, 3).collect()) == [[1], [2, 3], [7]]
    assert sorted(map(tuple, graph.within_components(edges).collect())) == [(1, 1), (2, 3), (3, 2), (7, 7)]
    assert graph.strong_components(edge_table(spark, [(1, 2)])).count() == 0


@pytest.mark.parametrize(("longest", "want"), [(1, 0), (2, 1), (3, 2), (5, 3)])
def test_cycles_up_to_a_length(spark, longest, want):
    edges = edge_table(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (5, 1)])
    assert graph.cycles(edges, longest).count() == want


def test_reach_keeps_the_least_depth(spark):
    edges = edge_table(spark, [(1, 2), (2, 3), (1, 3), (3, 1)])
    got = {(r.start, r.id): r.depth for r in graph.reach(edges, spark.range(1, 2), 5).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (1, 1): 2}


@pytest.mark.parametrize("pattern", ["x[ab]", "a[b", "a]b", "[!ab]x", "x.y", "a^b", "a\\b", "*.py", "src/?/*", "[a-c]x", "[]]x", "a+b(c)", "[!]x", "a[^b]"])
def test_glob_is_that_of_the_shell(spark, pattern):
    from fnmatch import fnmatchcase

    texts = ["xa", "xb", "xc", "a[b", "a]b", "ab", "cx", "ax", "x.y", "xzy", "a^b", "a\\b", "m.py", "m.pyc", "src/a/b/c", "src/ab/c", "bx", "]x", "a+b(c)", "aab(c)", "[!]x", "!x", "line\nend.py", "a^", "ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").where(text.glob(F.col("t"), pattern)).collect()
    assert {r.t for r in got} == {t for t in texts if fnmatchcase(t, pattern)}


def test_versions_of_any_form(spark):
    order = ["x", "1", "1.2", "1.9", "1.10.alpha", "1.10rc1", "1.10", "1.10.1", "2.0", "12345678901234567890"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").orderBy(F.rand(1))
    got = [r.v for r in rows.orderBy(text.version_key(F.col("v"))).collect()]
    assert got[0] == "x" and got.index("1.2") < got.index("1.9") < got.index("1.10rc1") < got.index("1.10") < got.index("2.0")
    assert {r.v for r in rows.where(text.at_least_version(F.col("v"), "1.10")).collect()} == {"1.10", "1.10.1", "1.10.alpha", "2.0", "12345678901234567890"}


def test_fix_words(spark):
    subjects = {"revert change": True, "Fix it": True, "patch notes": False, "prefix fixture debug": False, "hotfix: x": True, "fixes all": False, "a bug": True}
    rows = spark.createDataFrame(list(subjects.items()), "s string, want boolean")
    assert rows.where(classify.is_fix_words(F.col("s")) != F.col("want")).count() == 0


def test_antipatterns_by_the_default_limits(spark):
    modules = spark.createDataFrame([(1, 120, 15.0, False), *((i, 10, 1.0, False) for i in range(2, 9)), (9, 5, 1.0, True), (10, 5, 18.0, False)], "id long, loc long, complexity double, abstract boolean")
    edges = edge_table(spark, [(1, i) for i in range(2, 8)] + [(8, i) for i in (2, 3, 4, 5)] + [(10, 2), (2, 10)])
    got = {(r.id, r.pattern, r.severity) for r in rules.antipatterns(modules, edges).collect()}
    assert got == {(1, "GOD_OBJECT", "HIGH"), (8, "FEATURE_ENVY", "MEDIUM"), (9, "DEAD_ABSTRACTION", "LOW"), (10, "BRAIN_METHOD", "HIGH"), (2, "CIRCULAR_DEPENDENCY", "HIGH")}


def test_policy_rules(spark):
    nodes = spark.createDataFrame([(1, "app/controllers/user.py", 18.0), (2, "app/Repositories/db.py", 2.0), (3, "app/util.py", 1.0)], "id long, name string, complexity double")
    edges = edge_table(spark, [(1, 2), (2, 3), *((i, 3) for i in range(10, 18))])
    forbidden = {"id": "f", "type": "FORBIDDEN_DEPENDENCY", "source": "controllers?/", "target": "repositories?/", "severity": "HIGH"}
    got = rules.policy(nodes, edges, [forbidden, {"id": "x", "type": "MAX_COMPLEXITY"}, {"id": "c", "type": "MAX_COUPLING"}, {"id": "off", "type": "MAX_COUPLING", "threshold": 0, "enabled": False}])
    assert [(r.rule, r.target) for r in got.orderBy("rank", "target", "rule").collect()] == [("f", "app/controllers/user.py->app/Repositories/db.py"), ("x", "app/controllers/user.py"), ("c", "app/util.py")]
    assert rules.policy(nodes, edges, []).count() == 0
    for wrong in ({"id": "x", "type": "NONSENSE"}, {"type": "MAX_COUPLING"}, {"id": "x", "type": "FORBIDDEN_DEPENDENCY", "source": "a"}, {"id": "x", "type": "MAX_COUPLING", "severity": "?"}):
        with pytest.raises(ValueError):
            rules.policy(nodes, edges, [wrong])


def test_rule_statuses(spark):
    m = spark.createDataFrame([(1, "p", "complexity", 20.0), (2, "p", "complexity", 3.0)], "run_id int, path string, name string, value double")
    pack = [("max-metric", "complexity", 15.0), ("min-metric", "complexity", 1.0), ("nonsense", "complexity", 1.0)]
    got = {(r.run_id, r.rule): (r.status, r.violations) for r in rules.statuses(m, pack, frozenset({"min-complexity"})).collect()}
    assert got == {(1, "max-complexity"): ("FAILED", 1), (2, "max-complexity"): ("PASSED", 0), **{(i, "min-complexity"): ("SKIPPED", 0) for i in (1, 2)}, **{(i, "non-complexity"): ("ERROR", 0) for i in (1, 2)}}


def test_cutoffs_move_with_fixes_and_verdicts(spark):
    rows = spark.createDataFrame([(0, None), (2, None), (9, None), (0, True), (0, False), (1, False)], "fixes int, accurate boolean")
    got = [tuple(r) for r in rows.select(*(risk.cutoff(*x, F.col("fixes"), F.col("accurate")) for x in ((90.0, 5.0, 5.0, 75.0, 95.0), (65.0, 3.0, 3.0, 50.0, 80.0)))).collect()]
    assert got == [(90.0, 65.0), (80.0, 59.0), (75.0, 50.0), (85.0, 62.0), (95.0, 68.0), (90.0, 65.0)]


def test_impact_severity(spark):
    rows = spark.createDataFrame([(15.0, 0), (0.0, 9), (14.9, 8), (5.0, 0), (0.0, 3), (4.9, 2)], "score double, total long")
    assert [r.s for r in rows.select(graph.impact_severity(F.col("score"), F.col("total")).alias("s")).collect()] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "LOW"]


def test_omitted_partners_by_the_default_ratio(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 9)], "commit_id int, path int")
    assert [tuple(r) for r in aggregates.omitted(t).collect()] == [(3, 1, 2, 0.667)]


def test_run_changes(spark):
    files = spark.createDataFrame([(1, "a.py", "x"), (2, "a.py", "x"), (2, "a.py", "db"), (2, "db.py", "x")], "run_id int, path string, dep string")
    metrics = spark.createDataFrame([(1, "a.py", "size", 100.0), (2, "a.py", "size", 150.0), (1, "a.py", "n", 1.0), (2, "a.py", "n", 1.0)], "run_id int, path string, name string, value double")
    bad = spark.createDataFrame([(1, "max-n", "a.py")], "run_id int, rule string, path string")
    got = {tuple(r) for r in joins.run_changes(files, metrics, bad, 1, 2).collect()}
    assert got == {("dependency", "a.py->db", "added", 1.0), ("dependency", "db.py->x", "added", 1.0), ("file", "db.py", "added", 1.0), ("violation", "max-n:a.py", "removed", -1.0), ("metric", "a.py:size", "increased", 50.0)}


def test_streams_of_several_batches_keep_their_state(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").limit(300)
    rows = events.collect()
    for i in range(3):  # one file after another, in order of time
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], events.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/part{i}")
        for f in (tmp_path / "in" / f"part{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
    counts = {(str(r.start), r.event_type): r.n for r in stateful.run_to_table(stateful.tumbling(stateful.event_stream(spark, f"file://{tmp_path}/in", files="*.parquet", files_a_batch=1), "1 day")).collect()}
    assert sum(counts.values()) == 300


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    for number in (0, 1, 1):
        stateful.write_batch(spark.range(3), table, number)
    like = spark.range(1)
    assert stateful.read_batches(spark, like, table, last_only=False).count() == 6 and stateful.read_batches(spark, like, table, last_only=True).count() == 3
    assert stateful.read_batches(spark, like, f"{table}-none", last_only=True).count() == 0


def test_scratch_deletes_all_but_what_outlives_it(spark):
    with store.scratch(spark):
        kept = store.materialize(spark.range(5), "kept", outlives=True)
        gone = store.materialize(spark.range(5), "gone")
        assert gone.count() == 5
        path = gone.inputFiles()[0]
    assert kept.count() == 5 and not os.path.exists(path.removeprefix("file://"))


def test_two_level_digest_does_not_depend_on_partitions(spark):
    rows = spark.range(2500).select(F.lit("s").alias("k"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    got = {aggregates.two_level_digest(rows.repartition(n), "k", "id", F.col("h")).first().digest for n in (1, 5)}
    lines = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2500)]
    blocks = [hashlib.sha256("".join(lines[i : i + 1000]).encode()).hexdigest() for i in (0, 1000, 2000)]
    assert got == {hashlib.sha256("".join(blocks).encode()).hexdigest()}


def test_calls_are_resolved_by_import_evidence(spark):
    definitions = spark.createDataFrame([("a.py", "run"), ("b/run.py", "run"), ("c/tool.py", "run"), ("c/tool.py", "save"), ("d/x.py", "load"), ("e/x.py", "load")], "file string, name string")
    calls = spark.createDataFrame([("a.py", "run"), ("m.py", "run"), ("m.py", "save"), ("m.py", "load"), ("m.py", "unknown"), ("n.py", "load"), ("n.py", "save")], "file string, name string")
    imports = spark.createDataFrame([("m.py", "c.tool"), ("n.py", "e.x.load")], "file string, import string")
    got = {tuple(r) for r in joins.resolve_calls(calls, definitions, imports).collect()}
    assert got == {("a.py", "run", "a.py"), ("m.py", "run", "c/tool.py"), ("m.py", "save", "c/tool.py"), ("n.py", "load", "d/x.py")}  # the name itself is imported: the first file that has it


def test_intents_are_substrings(spark):
    intents = spark.createDataFrame([(1, "fix the PARSER now"), (2, "a b c"), (3, "arse")], "intent int, text string")
    paths = spark.createDataFrame([(1, "src/MyParsers.py"), (2, "x"), (3, "now.py")], "path int, name string")
    assert {tuple(r) for r in projections.intent_targets(intents, paths).collect()} == {(1, 1), (3, 1)}


def test_rate_limit_windows_begin_with_a_request(spark):
    times = {"a": [0, 400, 900, 1000, 1100, 2600], "b": [50]}
    rows = [(k, t * 1000, i) for k, x in times.items() for i, t in enumerate(x)]
    got = sorted((r.client, r.request, r.n, r.limited) for r in stream_queries.rate_limit(spark.createDataFrame(rows, "client string, at long, request long").repartition(3), limit=2).collect())
    assert got == [("a", 0, 1, False), ("a", 1, 2, False), ("a", 2, 3, True), ("a", 3, 1, False), ("a", 4, 2, False), ("a", 5, 1, False), ("b", 0, 1, False)]


def test_cache_keeps_the_newest_runs(spark):
    saved = spark.createDataFrame([("s", 1, "h", "old", 1), ("s", 1, "h", "new", 7), ("s", 1, "i", "gone", 2), ("t", 1, "h", "kept", 3)], "stage string, version int, input_hash string, output string, created int")
    runs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "run int")
    assert sorted(r.output for r in stream_queries.pruned_cache(saved, runs).collect()) == ["kept", "new"]
    assert sorted(r.output for r in stream_queries.pruned_cache(saved, runs.limit(2)).collect()) == ["gone", "kept", "new"]


def test_masks_keep_length_and_lines(spark):
    source = 'a "b\\" c # d\n"x" <!-- two\nlines --> y " z'
    got = spark.createDataFrame([(source,), (None,), ("",)], "t string").select(text.masked(F.col("t"), r'"[^"\n]*"|<!--[^>]*-->', r'[^"<]+').alias("m")).collect()
    assert [r.m for r in got] == ['a      c # d\n    ' + " " * 8 + "\n" + " " * 9 + ' y " z', None, ""]


def test_feedback_keeps_the_newest_verdict(spark):
    given = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, True, 5)], "path int, accurate boolean, at int")
    assert {tuple(r) for r in rules.latest_feedback(given).collect()} == {(1, False), (2, True)}


def test_marks_are_numbered_in_order(spark):
    """What lies in one part of a graph shares rows of 64 marks: as many rows as each part has blocks, however many parts there are."""
    size, parts = 64, 20
    numbers = graph.mark_numbers(spark.range(size * parts).repartition(7))
    assert [r.no for r in numbers.orderBy("mark").collect()] == list(range(size * parts))
    edges = spark.range(size * parts).selectExpr("id AS src", f"id - id % {size} + (id + 1) % {size} AS dst")
    assert [level.count() for level in graph.marked(edges, numbers, 2)] == [size * parts] * 2


def test_pairs_of_reach_are_not_shuffled(spark):
    r = random.Random(8)
    size = 150  # three blocks of marks
    pairs = {(r.randrange(size), r.randrange(size)) for _ in range(200)}
    want = {}
    for start in range(0, size, 2):
        seen, level = set(), {start}
        for depth in (1, 2, 3):
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(start, x): depth for x in level}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.reach(edge_table(spark, sorted(pairs)), spark.range(0, size, 2).selectExpr("cast(id as int) AS id"), 3)
        rows = [tuple(x) for x in found.select("start", "id", "depth").collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == len(want) and {(a, b): d for a, b, d in rows} == want
    assert 0 < plan.index("Generate") < plan.index("Exchange")  # from the top: all exchanges lie below


def test_sizes_of_parts_by_lists_and_by_joins(spark, sf_dir):
    """Gaps, repetitions, nulls and keys beyond the lists give what a join gives; of the given tables, some parts stand in lists."""
    r, end = random.Random(1), views._LISTED
    listed = [(k, r.randint(1, 3)) for k in range(1, 400) if k != 130] + [(end - 64 + i, i) for i in range(64)] + [(64000 + i, None if i == 7 else 1) for i in range(64)]
    parts = spark.createDataFrame([*listed, (70, 2), (300, None), (-5, 1), (-64, 2), (end + 3, 1), (None, 1)], "p_partkey long, p_size int")
    keys = [k for k, _ in listed] + [70, 300, -5, -64, end + 3, None, 130, 9999, end + 4, -6, 0]
    lines = spark.createDataFrame([(i, i % 7, k, i % 11) for i, k in enumerate(keys * 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    got = views.with_sizes(lines, parts)
    want = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*got.columns)
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # small as they are, parts are not broadcast whole
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in views.Views(spark, sf_dir).edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tests_of_a_domain(spark):
    nodes = [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 5), (6, 0), (7, 5), (7, 0), (8, 5), (9, None), (1, 0)]
    edges = [(1, 1), (1, 2), (4, 1), (4, 4), (99, 3), (4, 1), (5, 6), (9, 7), (6, 7), (8, 99)]
    tests = {i for i, d in nodes if d is not None and d % 5 == 0}
    want = {(a, b) for a, b in edges if b in tests} | {(a, b) for a, x in nodes for b, y in nodes if a != b and x is not None and x == y and y % 5 == 0}
    e, n = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "id long, domain int")
    for shares in (1, 3):
        got = [tuple(r) for r in joins.tests_of(e, n, F.col("domain") % 5 == 0, shares=shares).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_co_changes_in_parts_of_bounded_size(spark):
    """Parts grow in number with the table, and what they find does not hang on them."""
    t = spark.range(600).selectExpr("id % 60 AS commit_id", "id * id % 7 + id DIV 60 AS path").distinct()
    few = sorted(map(tuple, aggregates.co_changes(t).collect()))
    many = aggregates.co_changes(t, share_rows=10)
    assert few and sorted(map(tuple, many.collect())) == few
    assert many.rdd.getNumPartitions() >= t.count() // 10
    assert aggregates.co_change_ratios(t, share_rows=10).rdd.getNumPartitions() >= t.count() // 10
    assert aggregates.co_changes(t.where("false")).count() == 0
