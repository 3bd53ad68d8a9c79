"""Facts of Python source against the standard library's parser."""

import ast

import pytest

from quarryline.sources import python_text as P

SOURCES = {
    1: '''"""A module: if and for in words # no comment"""
import os, sys as system
from . import near
from .pkg.deep import (
    one,
    two,
)
from a.b import c

__all__ = ["run", "if x:"]
LIMIT: int = 3  # for while if


@decorated(1)
class Thing(Base, Other):
    """Text with ' and " and # marks"""

    kind = 'if "for" while'

    def method(self, a, b=1, *args, c=2, **more):
        if a and b or c:
            return [x for x in range(a) if x]
        elif b:
            with open("f") as f, open("g"):
                assert f, "no (bracket"
        else:
            return {k: v for k, v in more.items()}
        return a if b else (
            c
            if a
            else b
        )

    async def wait(self):
        async for x in self.rows():
            await x.done()
        async with self.lock:
            pass


def outer(n):
    def inner(m):
        while m:
            m -= 1
        return m

    try:
        value = inner(n)
    except ValueError:
        value = 0
    except (TypeError, KeyError) as e:
        raise e
    finally:
        print("done")
    match value:
        case 1:
            return "one"
        case [x, y] if x:
            return call(x)(y)
    return \\
        value


def one_liner(x): return x
''',
    2: "def broken(:\n    (\n",
    3: "",
    4: None,
    5: "x = 'unclosed bracket ('\ny = {'a': [1, 2]}\n\n\nclass Empty:\n    pass\n",
    7: """def spread(
    a: Dict[str, int],
    b=(1, 2),  # two, three
    *rest: Tuple[int, ...],
    c: Callable[[int, str], bool] = lambda x, y: x,
    d={"k": [1, 2]},
    **more,
) -> Dict[str, int]:
    if a:
        return b


class Wide(
    Base[int, str],
    Other,
    metaclass=Meta,
):
    def short(self) -> Tuple[int, int]: return self

    def deep(self, f=lambda: (1, 2), /):
        class Inner: kind = 1
        def again(): pass
        for x in f():
            def last(q): return q
        return x


async def typed(a: "x, y" = ",", *, key=None): return [a, key]
x = 1
""",
    6: "def f(a):\r\n    if a:\r\n        return g(a)\r\n    return h.i(a)\r\n",
}


def expected(text):
    tree = ast.parse(text or "")
    out = set()

    def count(node, kind):
        walked = list(ast.walk(node))
        n = lambda *t: sum(isinstance(x, t) for x in walked)
        return {
            "if": n(ast.If), "for": n(ast.For, ast.AsyncFor), "while": n(ast.While), "excepthandler": n(ast.ExceptHandler), "with": n(ast.With, ast.AsyncWith),
            "assert": n(ast.Assert), "ifexp": n(ast.IfExp), "comprehension": n(ast.comprehension), "match_case": n(ast.match_case), "operands": sum(len(x.values) - 1 for x in walked if isinstance(x, ast.BoolOp)),
        }

    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.add(("function", x.name, len(x.args.posonlyargs) + len(x.args.args) + len(x.args.kwonlyargs), len(x.body), x.lineno, tuple(count(x, 0).items())))
        elif isinstance(x, ast.ClassDef):
            out.add(("class", x.name, len(x.bases), len(x.body), x.lineno, tuple(count(x, 0).items())))
        elif isinstance(x, ast.Import):
            out |= {("import", a.name, 0) for a in x.names}
        elif isinstance(x, ast.ImportFrom):
            out.add(("import", x.module or "", 0))
    out.add(("module", "", 0, len(tree.body), 0, tuple(count(tree, 0).items())))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = P.python_facts(spark.createDataFrame(list(SOURCES.items()), "path long, text string")).collect()
    names = ("if", "for", "while", "excepthandler", "with", "assert", "ifexp", "comprehension", "match_case")
    out = {}
    for r in rows:
        counts = tuple({**{k: r[f"n_{k}"] for k in names}, "operands": r.boolean_operands}.items())
        # docstrings are blanks to the reader, statements to the parser: compared where there are none
        out.setdefault(r.path, set()).add((r.kind, r.name, r.args, r.statements, r.lineno, counts) if r.kind in ("function", "class", "module") else (r.kind, r.name, r.args))
    return out


@pytest.mark.parametrize("path", [5, 6, 3, 4, 7])
def test_facts_equal_the_parser(found, path):
    assert found[path] == expected(SOURCES[path])


def test_facts_of_a_module_with_everything(found):
    def strip(rows):  # docstrings count as statements for the parser only
        return {r[:3] + r[5:] if len(r) > 3 else r for r in rows if r[0] != "exports"}

    got, want = strip(found[1]), strip(expected(SOURCES[1]))
    assert got == want
    assert ("exports", "__all__", 0) in found[1]
    statements = {r[1]: r[3] for r in found[1] if r[0] == "function"}
    assert statements == {r[1]: r[3] for r in expected(SOURCES[1]) if r[0] == "function"}


def test_errors_and_large_files(spark, found, monkeypatch):
    assert found[2] == {("error", "", 0)}
    monkeypatch.setattr(P, "MAX_BYTES", 10)
    assert P.python_facts(spark.createDataFrame([(1, "x = 1\ny = 2\nz = 3\n")], "path long, text string")).count() == 0


def test_calls(spark):
    source = "def f(a):\n    if (a): return g(a.b(1))\n    return print(lambda x: h(x)) and not (a)\n"
    r = P.python_facts(spark.createDataFrame([(1, source)], "path long, text string")).where("kind = 'function'").first()
    assert sorted(r.calls) == ["b", "g", "h", "print"]


def test_digest_ignores_layout_and_comments(spark):
    a = "x = 1  # one\n\n\ndef f():\n    return 'a # b'\n"
    rows = [(1, a), (2, "x = 1\ndef f():\n    return   'a # b'  # two\n"), (3, a.replace("a #", "b #")), (4, a.replace("x = 1", "x = 2"))]
    got = {r.path: r.digest for r in P.layout_free_digest(spark.createDataFrame(rows, "path long, text string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_blocks_of_a_long_file(spark):
    source = "".join(f"def f{i}(a):\n  if a:\n    def g{i}(): return a\n  return {i}\n" for i in range(6_000)) + "class Last:\n" + "".join(f"  def m{i}(self): pass\n" for i in range(3_000))
    rows = P.python_facts(spark.createDataFrame([(1, source)], "path long, text string")).where("kind in ('function', 'class')").select("kind", "name", "args", "lineno", "statements", "n_if").collect()
    assert len(rows) == 15_001
    by_name = {r["name"]: tuple(r) for r in rows}
    assert by_name["f5999"] == ("function", "f5999", 1, 4 * 5999 + 1, 2, 1) and by_name["g17"] == ("function", "g17", 0, 4 * 17 + 3, 1, 0)
    assert by_name["Last"] == ("class", "Last", 0, 24_001, 3_000, 0) and by_name["m2999"][4] == 1


def test_facts_of_files_are_not_shuffled(spark):
    source = "def f(a):\n    return g(\n        a and b,\n        [x\n         for x in a])\n"
    facts = P.python_facts(spark.createDataFrame([(1, source), (2, "x = 1\n")], "path long, text string"))
    assert "Exchange" not in facts._jdf.queryExecution().executedPlan().toString()
    row = facts.where("kind = 'function'").first()
    assert (row.statements, row.n_for, row.n_comprehension, row.n_boolop, row.calls) == (1, 0, 1, 1, ["g"])
    only = P.python_facts(spark.createDataFrame([(1, source)], "path long, text string"), "module").collect()
    assert [r.kind for r in only] == ["module"]
