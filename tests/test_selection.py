"""Categories, roles, test selection and constraints against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import selection as S
from quarryline.views import Views


def test_categories(spark):
    want = {
        "src/tests/a.py": "TEST_CODE", "test_a.py": "TEST_CODE", "x/a_test.py": "TEST_CODE", "_test.py": "PRODUCTION_CODE", "x/myconftest.py": "TEST_CODE", "Fixtures/x.bin": "TEST_CODE", "latest/a.py": "PRODUCTION_CODE",
        "a/Setup.py": "CONFIGURATION", ".gitignore": "CONFIGURATION", "a/requirements-dev.txt": "CONFIGURATION", "poetry.lock": "CONFIGURATION", "requirements/x.py": "PRODUCTION_CODE",
        "docs/a.py": "DOCUMENTATION", "a.MD": "DOCUMENTATION", "a/LICENSE-MIT": "DOCUMENTATION", "readme/a.py": "PRODUCTION_CODE", "a\\doc\\b.py": "DOCUMENTATION",
        "a_pb2.py": "GENERATED", "x/vendor/y.py": "GENERATED", "vendor/y.py": "PRODUCTION_CODE", "a.min.js": "GENERATED",
        "scripts/a.py": "TOOLING", "src/scripts/a.py": "PRODUCTION_CODE", "srcs/scripts/a.py": "TOOLING", "a/bin": "TOOLING", " tools/x ": "TOOLING",
        "a.tsx": "PRODUCTION_CODE", "a.bin": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN",
    }
    rows = spark.createDataFrame(list(want.items()), "path string, want string").select("path", "want", S.file_category(F.col("path")).alias("got")).collect()
    assert [(r.path, r.got) for r in rows] == [(r.path, r.want) for r in rows]


def test_roles(spark):
    want = [
        ("tests/__init__.py", False, "PACKAGE_INITIALIZER"), ("./core/../tests/a.py", True, "TEST"), ("core/test_a.py", None, "TEST"), ("a_test.py", False, "TEST"), ("core/a.py", True, "PUBLIC_MODULE"),
        ("core/experimental/a.py", False, "EXPERIMENTAL"), ("cli.py", False, "CLI"), ("web.py", None, "SERVER"), ("tool.py", False, "MCP_TOOL"), ("core\\a.py", False, "CORE_ENGINE"), ("scratch/a.py", False, "SCRIPT"),
        ("lib/a.py", False, "INTERNAL"), ("", True, "INTERNAL"), (None, True, "INTERNAL"),
    ]
    role = S.file_role(F.col("path"), F.col("public"), commands=("cli.py",), servers=("web.py",), tools=("tool.py",))
    rows = spark.createDataFrame(want, "path string, public boolean, want string").select("path", "want", role.alias("got")).collect()
    assert [(r.path, r.got) for r in rows] == [(r.path, r.want) for r in rows]


def wanted_tests(affected, tests, imports):
    out = {}
    for t in tests:
        base = os.path.splitext(os.path.basename(t))[0]
        for a in affected:
            b = os.path.splitext(os.path.basename(a))[0]
            if b == "__init__":
                b = os.path.basename(os.path.dirname(a)) or "init"
            ids = {a, b} | ({a[:-3].replace("/", ".")} if a.endswith(".py") else set())
            names = imports.get(t, ())
            rank = 9
            if t == a:
                rank = 0
            elif base in (f"test_{b}", f"{b}_test") or base.startswith(f"test_{b}_") or f"_{b}_" in base or base.endswith(f"_{b}"):
                rank = 1
            elif any(n == i or ("." in i and n.startswith(i + ".")) for n in names for i in ids):
                rank = 2
            out[t] = min(out.get(t, 9), rank)
    return {t: ("self", "name", "import")[r] for t, r in out.items() if r < 9}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_affected_tests(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "a_b", "_b", "test", "x.y", "__init__", "c_"]
    path = lambda: "/".join([*(rng.choice(words) for _ in range(rng.randint(0, 2))), rng.choice(words) + rng.choice([".py", ".py", ".js", ""])])
    affected = sorted({path() for _ in range(6)})
    tests = sorted({"t/" + "_".join(rng.choice([*words, "test"]) for _ in range(rng.randint(1, 4))) + rng.choice([".py", ".js"]) for _ in range(60)} | {affected[0]})
    imports = {t: [".".join(rng.choice(["a", "b", "x", "y", "__init__", "a_b", "q"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))] for t in tests}
    asked = [(t, n) for t, ns in imports.items() for n in ns] + [(tests[1], None), (None, "a"), ("other.py", "a")]
    rows = S.affected_tests(
        spark.createDataFrame([(a,) for a in [*affected, affected[0], None]], "path string"), spark.createDataFrame([(t, 1) for t in [*tests, tests[0], None]], "path string, reason int"), spark.createDataFrame(asked, "path string, name string")
    ).collect()
    assert len({r.test for r in rows}) == len(rows)
    assert {r.test: r.reason for r in rows} == wanted_tests(affected, tests, imports)


def wanted_hits(constraints, files):
    out = set()
    for key, text in constraints:
        low = (text or "").lower()
        found = re.findall(r"(?:do not (?:modify|touch|change|break)|forbidden:?|never touch)\s+([a-z0-9_\-./]+)", low)
        if re.search("do not|forbidden|never", low):
            found += re.findall(r"[a-z0-9_\-.]+(?:/[a-z0-9_\-.]+)+", low)
        for t in {x.strip("/.,; ") for x in found}:
            if len(t) < 3 or t in ("any", "the", "all", "api"):
                continue
            for k, p in files:
                if k != key or p is None:
                    continue
                m = p.replace("\\", "/").lower().strip("./ ")
                parts = m.split("/")
                if t == m or m.endswith("/" + t) or ("/" in t and t in m) or ("/" not in t and (t in parts or any(x.startswith(t + ".") for x in parts) or t in parts[-1])):
                    out.add((key, p, t))
    return out


def test_boundaries(spark):
    constraints = [
        (1, "Do NOT modify core/engine.py, and never touch the API"), (1, "forbidden: engine"), (1, "Forbidden   /lib/deep/. thanks"), (2, "do not change util; see a/b for more"), (2, "Prefer small changes to core/engine.py"),
        (3, None), (3, ""), (4, "never touch ab"), (4, "do not touch any"), (5, "do not break ./x/y.py; do not break x/y.py"), (None, "do not touch engine"), (6, "forbidden: abc"), (6, "forbidden: abc"),
    ]
    paths = ["core/engine.py", "x/core/engine.py", "engine/a.py", "my_engine.py", "engine.d/x", "lib/deep/q.py", "a\\LIB\\deep", "util", "util/x.py", "autil/x.py", "a/b", "za/bz", "ab", "abc", "x/y.py", "./x/y.py/", "", None, "é/engine"]
    files = [(k, p) for k in (1, 2, 3, 4, 5, 6, None) for p in paths] + [(1, "core/engine.py")]
    rows = S.boundary_hits(spark.createDataFrame(constraints, "key long, text string"), spark.createDataFrame([(*f, 0) for f in files], "key long, path string, target int")).collect()
    got = [tuple(r) for r in rows]
    assert len(got) == len(set(got)) and set(got) == wanted_hits([x for x in constraints if x[0] is not None], files)
    assert got


def test_boundaries_of_few_and_many_targets(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    constraints = [(k, " ".join(f"never touch {word()}{r.choice(['', '/' + word()])}," for _ in range(r.randint(0, 9)))) for k in range(12)]
    files = [(k, "/".join(word() for _ in range(r.randint(1, 4)))) for k in range(12) for _ in range(20)]
    a, b = spark.createDataFrame(constraints, "key long, text string"), spark.createDataFrame(files, "key long, path string")
    want = wanted_hits(constraints, files)
    assert want
    for few in (0, 4, 64):
        got = [tuple(x) for x in S.boundary_hits(a, b, few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # paths are not cut into pieces where all targets are few
    assert "gram" not in S.boundary_hits(a, b)._jdf.queryExecution().optimizedPlan().toString()


def test_boundaries_send_no_table_through_the_driver(spark, sf_dir):
    few = spark.createDataFrame([(k, "never touch abc, never touch abd") for k in range(5)], "key long, text string")
    files = spark.createDataFrame([(k % 5, f"x/{p}/{k}") for k in range(20) for p in ("abc", "abde")], "key long, path string")
    for df in (S.boundary_hits(few, files), S.boundary_hits(few, files, few=1), S.prj_boundaries(Views(spark, sf_dir))):
        assert df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nothing_selected(spark):
    none = spark.createDataFrame([], "key long, path string, text string, name string")
    assert S.boundary_hits(none, none).count() == S.affected_tests(none, none, none).count() == 0
