"""Checks of source text: each kind, and what looks like it."""

from quarryline.sources import python_checks as C

GOOD_AND_BAD = '''import io
from abc import ABC, abstractmethod

def reads(p):
    a = open(p)
    b = open(p, "rb"), open(os.path.join(p, "x"), mode="wb"), open(p, encoding="utf-8"), f.open(p), reopen(p)
    c = io.open(
        p, "w",  # encoding=no
    )
    d = "open(p)"  # open(p)
    return open(p, "r", **{"encoding": 1})

def parts(p, x):
    a = p.split("/")
    b = p.split("/", 1), p.split(",")
    c = p + "/" + x
    d = f"{p}/{x}", f"http://{p}", f"{p}\\n", f"a/b", "/" * 3
    e = '/' + x
    return p.split('\\\\')

def errors():
    try:
        reads(1)
    except (ValueError,
            TypeError):
        pass
    except KeyError: pass
    except OSError:
        "said"
        ...
    except Exception as e:
        raise e

def stub(a):
    """Only text."""

async def later(): ...

class Base(ABC):
    def may(self):
        pass

    class Inner:
        def may_not(self):
            pass

class Plain:
    @abstractmethod
    @other
    def free(self):
        pass

    @other
    def bound(self):
        # text
        pass
'''
WANT = {
    (5, "MissingFileEncoding"), (7, "MissingFileEncoding"), (11, "MissingFileEncoding"),
    (14, "HardcodedPathSeparators"), (16, "HardcodedPathSeparators"), (17, "HardcodedPathSeparators"), (18, "HardcodedPathSeparators"), (19, "HardcodedPathSeparators"),
    (24, "SilentErrorHandling"), (27, "SilentErrorHandling"), (28, "SilentErrorHandling"),
    (34, "FunctionStub"), (37, "FunctionStub"), (44, "FunctionStub"), (54, "FunctionStub"),
}


def test_each_check(spark):
    rows = C.source_checks(spark.createDataFrame([(1, GOOD_AND_BAD), (2, "def broken(:\n (\n"), (3, ""), (4, None), (5, "x = 1\n")], "path long, text string")).collect()
    assert {(r.line, r.rule) for r in rows if r.path == 1} == WANT and len([r for r in rows if r.path == 1]) == len(WANT)
    assert [tuple(r) for r in rows if r.path != 1] == [(2, 0, "SyntaxError")]


def test_long_text_and_nothing(spark):
    text = "x = '" + "a" * 300_000 + "'\n" + "def f(): pass\n" * 3_000 + "y = open(z)"
    rows = C.source_checks(spark.createDataFrame([(1, text)], "path long, text string")).groupBy("rule").count().collect()
    assert {tuple(r) for r in rows} == {("FunctionStub", 3_000), ("MissingFileEncoding", 1)}
    assert C.source_checks(spark.createDataFrame([], "path long, text string")).count() == 0


def test_checks_neither_shuffle_nor_broadcast(spark):
    # tables of files pack well, so that joins of them were planned as broadcasts through the driver
    rows = C.source_checks(spark.createDataFrame([(1, GOOD_AND_BAD)], "path long, text string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
