"""The failure space of Python source against the standard library's parser."""

import ast
import random

import pytest

from quarryline.sources import failure_space as S

ODD = (None, "")


def _guarded(f):
    for s in f.body[:5]:
        if isinstance(s, (ast.Assert, ast.Raise)):
            return True
        if isinstance(s, ast.If) and any(isinstance(x, (ast.Compare, ast.Not)) or (isinstance(x, ast.Name) and x.id == "isinstance") or (isinstance(x, ast.Constant) and x.value is None) for x in ast.walk(s.test)):
            return True
    return False


def _calls(node, expecting, out):
    if isinstance(node, ast.With) and any(isinstance(i.context_expr, ast.Call) and getattr(i.context_expr.func, "attr", getattr(i.context_expr.func, "id", "")) in ("assertRaises", "assertRaisesRegex", "fails") for i in node.items):
        expecting = True
    if isinstance(node, ast.Call):
        name = getattr(node.func, "id", getattr(node.func, "attr", None))
        args = [*node.args, *(k.value for k in node.keywords)]
        odd = any((isinstance(a, ast.Constant) and (a.value is None or a.value == "")) or (isinstance(a, ast.List) and not a.elts) or (isinstance(a, ast.Dict) and not a.keys) for a in args)
        if name:
            out[name] = out.get(name, False) or odd or expecting
    for x in ast.iter_child_nodes(node):
        _calls(x, expecting, out)


def wanted(files, tests, changed=None):
    called, out = {}, set()
    for t in tests.values():
        _calls(ast.parse(t), False, called)
    for path, text in files.items():
        for f in ast.walk(ast.parse(text)):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and not (f.name.startswith("__") and f.name.endswith("__")):
                if changed is None or any(p == path and f.lineno <= n <= f.end_lineno for p, n in changed):
                    out.add((path, f.name, f.lineno, f.name not in called, not _guarded(f) and not called.get(f.name, False)))
    return out


BODIES = [
    "return a", "assert a, 'no'\nreturn a", "if a:\n    return b\nreturn a", "if a is None:\n    return b", "if not a:\n    return b", "if isinstance(a, int): return b", "raise ValueError(a)",
    "if a:\n    raise ValueError(b == a)", "x = 1\nx = 2\nx = 3\nx = 4\nx = 5\nassert x", "x = 1\nx = 2\nx = 3\nx = 4\nassert x", "for x in a:\n    assert x", "if (a and\n        b == 'a: b'):\n    return 1",
    "def inner(c):\n    assert c\n    return c\nreturn inner(a)", "if a: return b == a\nelif b == 1:\n    return 2", "try:\n    x = 1\nexcept ValueError:\n    raise\nreturn x", "if d[1:2] == a:\n    pass",
]
CALLS = [
    "{f}(1)", "x = {f}(None)", "{f}(g(None))", "g({f}(1), None)", "{f}(a=[], b=2)", "{f}(1,\n      '')", "{f}('None')", "# {f}(None)", "y = '{f}(None)'", "{f}({{}})", "{f}([1], {{2: None}})", "obj.{f}(1, b=\"\")", "{f}(x, [None])",
    "with self.assertRaises(ValueError):\n    {f}(1)", "with self.assertRaises(ValueError): {f}(1)", "with open(p) as h:\n    {f}(1)", "with self.assertRaisesRegex(\n        ValueError, 'x') as e, h:\n    if 1:\n        {f}(1)\n{g}(2)",
    "with self.assertRaises(E):\n    with open({f}(2)) as h:\n        pass\n{g}(x=1, *y)", "{f}([], )", "{f}(None if x else 1)", "{f}(not None)", "if {f}: pass", "def {f}(a=None):\n    pass", "{f}('''''')",
]


def _indent(text, by):
    return "\n".join("    " * by + line for line in text.split("\n"))


@pytest.mark.parametrize("seed", range(2))
def test_against_the_parser(spark, seed):
    r = random.Random(seed)
    names = [f"f{i}" for i in range(40)] + ["__init__", "helper"]
    files, tests = {}, {}
    for i in range(12):
        mine = r.sample(names, 5)
        text = "".join(f"{r.choice(['', 'async ', '@cached' + chr(10)])}def {n}(a, b=None):\n{_indent(r.choice(BODIES), 1)}\n\n" for n in mine[:3])
        text += "class K:\n" + "".join(f"    def {n}(self,\n            a):\n{_indent(r.choice(BODIES), 2)}\n" for n in mine[3:])
        files[f"pkg/m{i}.py"] = text + ("def short(a): assert a\n" if i == 0 else "def brief(a): return a\n" if i == 1 else "")
    for i in range(6):
        lines = [r.choice(CALLS).format(f=r.choice(names[:30]), g=r.choice(names[:30])) for _ in range(8)]
        tests[f"tests/test_{i}.py"] = "def test(self):\n" + "\n".join(_indent(x, 1) for x in lines) + "\n"
    noise = {"pkg/testing.py": "def f1(a):\n    return a\n", "pkg/a.txt": "def f2(): pass", "docs/test_x.py": "f3(None)\n", "tests/helper.py": "f4(None)\n"}
    rows = [*files.items(), *tests.items(), *noise.items(), ("pkg/none.py", None), (None, "def q(): pass"), ("pkg/empty.py", "")]
    sources = spark.createDataFrame(rows, "path string, text string").repartition(3)
    # helper functions of the test folder are no targets, nor are they tests: ``helper.py`` has no name of one, and its path says nothing of tests
    extra = {"tests/helper.py"}
    got = {tuple(x) for x in S.failure_space(sources).select("path", "name", "line", "untested", "unguarded").collect() if x.path not in extra}
    assert got == wanted(files, tests)
    changed = [(p, r.randrange(1, 12)) for p in files for _ in range(2)]
    lines = spark.createDataFrame([*changed, (None, 1), ("pkg/m0.py", None)], "path string, line int")
    got = S.failure_space(sources, lines).collect()
    assert {(x.path, x.name, x.line, x.untested, x.unguarded) for x in got} == wanted(files, tests, changed)
    assert all(x.residual == x.untested + x.unguarded for x in got)


def test_empty(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert S.failure_space(none).collect() == []
    alone = spark.createDataFrame([("a.py", "def f(x):\n    return x\n")], "path string, text string")
    assert [tuple(x) for x in S.failure_space(alone).collect()] == [("a.py", "f", 1, True, True, 2)]


def test_joins_are_not_planned_as_broadcasts(spark):
    # files pack well in a table, so that Spark took large ones for small and sent them through the driver
    from quarryline.sources import failure_space as S

    files = spark.createDataFrame([("pkg/a.py", "def f(a):\n    return a\n"), ("tests/test_a.py", "def test():\n    f(None)\n")], "path string, text string")
    marks = spark.createDataFrame([("pkg/a.py", 2)], "path string, line int")
    out = S.failure_space(files, marks)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("pkg/a.py", "f", 1, False, False, 0)]
