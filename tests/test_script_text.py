"""Facts of script source and the resolution of specifiers against brute force."""

import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.sources import polyglot
from quarryline.sources import script_queries as Q
from quarryline.sources import script_text as S
from quarryline.views import Views

PROBED = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
SOURCES = {
    "a/all.js": """import one from 'one';
import { two,
  deux } from "./two";
import * as three from '../three';
import './four.css';
const five = require('five'), six = require( "./six.js" );
export { seven } from "./seven";
export * from 'eight';
const nine = () => import('./nine');
import type { x } from 'ten';
// import no from 'no1'; require('no2')
/* import no from 'no3';
   require("no4") */
const url = "http://x/*y"; import eleven from 'eleven'; /* after a string */
const t = `// import in from 'template'`;
import {été} from 'twelve';
""",
    "a/branches.ts": """if (a) { for (const x of y) while (z) { try { f() } catch (e) {} } }
switch (k) { case 1: break; case 'if (x)': break }
const s = a ? b : c, t = a?.b ?? c, u = "x ? y : z", w = 'while \\' if', v = `for ${if_} ?`;
// if (no) for
/* while
 case */
const notif = ifs, r = iff;
class Thing extends Other { }
export default async function load(a) { }
const arrow = async (a, b) => a, second = (x) => x, none = 3; let plain = (x) => x;
export class $Dollar {}
""",
    "empty.jsx": "",
    "null.tsx": None,
    "open.mjs": "const a = \"unclosed; // gone\nif (x) {} // it's\nimport b from 'b'\r\n\r\n  \t\r\nconst c = 'don\\'t' /* open if\n",
    "no.py": "import os",
    "Upper.CJS": "x = 1 / 2 / 3; y = /re'g/; if (x) y = \"a\\\\\"; if (z) {}\n",
    "comment.js": "/**/ // only\n/* if */",
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = S.script_facts(spark.createDataFrame(list(SOURCES.items()), "path string, text string")).collect()
    assert len(rows) == len(SOURCES) - 1
    return {r.path: r for r in rows}


def test_specifiers(facts):
    assert facts["a/all.js"].specifiers == sorted("one ./two ../three ./four.css five ./six.js ./seven eight ./nine ten eleven template twelve".split())
    assert facts["open.mjs"].specifiers == ["b"]
    assert facts["empty.jsx"].specifiers == facts["null.tsx"].specifiers == facts["comment.js"].specifiers == []


def test_counts_and_names(facts):
    f = facts["a/branches.ts"]
    assert (f.language, f.loc, f.complexity) == ("typescript", 8, 1 + 4 + 3 + 1)
    assert f.classes == ["$Dollar", "Thing"] and f.functions == ["arrow", "load", "plain"]
    assert (facts["null.tsx"].loc, facts["null.tsx"].complexity, facts["comment.js"].loc, facts["comment.js"].complexity) == (0, 1, 0, 1)
    assert facts["Upper.CJS"].language == "javascript" and facts["Upper.CJS"].complexity == 3  # a quote that is never closed opens nothing


def test_a_very_long_string_and_text(spark):
    text = "const a = '" + "x\\'" * 200_000 + "';\n" + "if (a) { b(\"if\") } // if\n" * 20_000 + "import z from './z'"
    row = S.script_facts(spark.createDataFrame([("long.js", text)], "path string, text string")).first()
    assert (row.complexity, row.loc, row.specifiers) == (20_001, 20_002, ["./z"])


def expected(path, specifier, files):
    spec = specifier.strip(" ")
    if not spec.startswith("."):
        return spec, False
    at = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)).replace("\\", "/")
    for probe in [at, *(at + e for e in PROBED), *(f"{at}/index{e}" for e in PROBED)]:
        if probe in files:
            return probe, True
    over = [f for f in files if any(f.endswith(at + e) for e in ["", *PROBED])]
    return (min(over), True) if over else (at, False)


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "index", "ab", "x.y", "ba"]
    files = {"/".join([*(rng.choice(names) for _ in range(rng.randint(0, 3))), rng.choice(names) + rng.choice([*PROBED, "", ".css"])]) for _ in range(80)}
    pieces = [".", "..", "a", "b", "index", "ab", "x.y", "b.js", "a.ts", ""]
    asks = [(p, rng.choice(["./", "../", ".", "", "../../", " ./"]) + "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))) for p in sorted(files) for _ in range(12)]
    rows = S.resolve_specifiers(
        spark.createDataFrame([*asks, *asks[:9], (None, "./a"), ("a.js", None)], "path string, specifier string"), spark.createDataFrame([(f, 1) for f in [*files, *sorted(files)[:5], None]], "path string, target int")
    ).collect()
    got = {(r.path, r.specifier): (r.target, r.found) for r in rows}
    assert len(rows) == len(got) and set(got) == set(asks)
    assert got == {a: expected(*a, files) for a in set(asks)}
    assert len({found for _, found in got.values()}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert S.script_facts(none).count() == S.tested_files(none).count() == 0
    asks = spark.createDataFrame([("a.js", "./b"), ("a.js", "lib")], "path string, specifier string")
    assert {tuple(r) for r in S.resolve_specifiers(asks, none).collect()} == {("a.js", "./b", "b", False), ("a.js", "lib", "lib", False)}
    assert S.resolve_specifiers(asks.limit(0), asks).count() == 0


def test_tested_files(spark):
    paths = ["src/a.js", "lib/a.js", "src/a.test.js", "tests/b.ts", "b.ts", "x/C.spec.ts", "y/c.ts", "lone.test.js", "test/only.js", None]
    got = {tuple(r) for r in S.tested_files(spark.createDataFrame([(p,) for p in paths + paths[:2]], "path string")).collect()}
    assert got == {("src/a.test.js", "lib/a.js"), ("tests/b.ts", "b.ts"), ("x/C.spec.ts", "y/c.ts")}


POLYGLOT = {
    "a.py": "import os, sys as system\nfrom .near import x\nfrom a.b import (\n  c,\n)\n# import no\nclass K:\n  async def m(self):\n    with a and b: pass\n",
    "broken.py": "from a.b import (\nimport os\nfrom " + "long." * 60 + "z import no\nasync def f(:\nclass K\nif x && y: assert z\n",
    "m.TS": "import type { a } from 'x';\nexport * from \"./y\"\nrequire('z')\nif (a && b) {} else if (c ?? d) {}\nconst f = async (a) => a, g = 1; function h() {}\nclass C {}\n// if\nconst t = a ? b : c;",
    "w\\s.go": 'package tools\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\nimport y "os"\n\ntype S[T any] struct {}\ntype R interface {}\nfunc (s *S[T]) Run(a int) int {\n  go f()\n  defer g()\n  if a > 0 || b { return 1 }\n}\nfunc Top[T any](x T) {}\n',
    "nopackage.go": "func main() {\x00}\n",
    "blank.go": " \n\t\n",
    "note.txt": "if for while\r\nimport x",
    "null.js": None,
}


def test_polyglot(spark):
    rows = polyglot.polyglot_facts(spark.createDataFrame(list(POLYGLOT.items()), "path string, text string")).collect()
    got = {r.path: (r.language, r.loc, r.complexity, r.imports, r.functions, r.classes, r.package) for r in rows}
    assert len(rows) == len(got) == len(POLYGLOT)
    assert got == {
        "a.py": ("python", 9, 3, [".near", "a.b", "os", "sys"], ["m"], ["K"], None),
        "broken.py": ("python", 6, 4, ["a.b", "long." * 60 + "z", "os"], ["f"], ["K"], None),
        "m.TS": ("typescript", 8, 1 + 3 + 1 + 1 + 1 + 1, ["./y", "x", "z"], ["f", "h"], ["C"], None),
        "w/s.go": ("go", 16, 1 + 1 + 1 + 1 + 1, ["fmt", "net/http", "os"], ["Run", "Top"], ["R", "S"], "tools"),
        "nopackage.go": ("go", 1, 1, [], ["main"], [], "main"),
        "blank.go": ("go", 2, 1, [], [], [], None),
        "note.txt": ("unknown", 2, 1, [], [], [], None),
        "null.js": ("javascript", 0, 1, [], [], [], None),
    }


def test_polyglot_of_nothing(spark):
    assert polyglot.polyglot_facts(spark.createDataFrame([], "path string, text string")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_imports_are_read_from_each_text_once(spark, sf_dir, monkeypatch):
    written = {}
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: written.setdefault(name, plan_of(df)) and write(df, name))
    Q.src_jsgraph(Views(spark, sf_dir))
    assert written["script-imports"].count(S.REQUIRE) == 1


def test_paths_whose_dots_stand_first_and_others(spark):
    rng = random.Random(3)
    parts = ["..", ".", "a", "b.c", "...", "", ".a", "a.."]
    rows = [("/".join(rng.choice(parts[:4]) for _ in range(rng.randint(0, 3))), rng.choice(["", "./", "../", "../../", "../" * 4]) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for _ in range(600)]
    got = spark.createDataFrame(rows, "f string, r string").select("f", "r", S.joined_path(F.col("f"), F.col("r")).alias("p"), S.folder_of(F.col("r")).alias("d")).collect()
    for x in got:
        # no path is absolute
        assert x.p == posixpath.normpath(posixpath.join(".", *(y for y in f"{x.f}/{x.r}".split("/") if y))), x
        assert x.d == re.sub(r"/?[^/]*\Z", "", x.r, count=1), x


def test_branches_and_lines_are_counted_in_few_passes(spark):
    assert len(polyglot._BRANCHES["script"]) == 2 and len(polyglot._BRANCHES["go"]) == 1
    apart = {
        "script": (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcatch\b", r"\bcase\b", "&&", r"\|\|", r"\?\?", r"(?<![?.:\w])\?(?![?.:\w])"),
        "go": (r"\bif\b", r"\bfor\b", r"\bcase\b", r"\bselect\b", r"\bdefer\b", r"\bgo\b", "&&", r"\|\|"),
    }
    rng = random.Random(4)
    pieces = "if else for while catch case select defer go x &&& || | ??? ? .? ?: \r\n \n \r \x0b \x85 \u2028 é".split(" ") + [" ", " ", "\n", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    text = F.col("t")
    for kind, patterns in apart.items():
        for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", polyglot._branches(kind, text).alias("n"), polyglot.line_count(text).alias("lines")).collect():
            assert r.n == 1 + sum(len(re.findall(p, r.t)) for p in patterns), r
            assert r.lines == len(r.t.splitlines()), r
