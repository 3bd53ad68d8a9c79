"""What tests leave out: functions that no test calls, and those of which neither a guard nor a test tries the odd cases.

Test files are cut into tokens, each within its row. A token's bracket is the last one opened one level further out, so that every call knows its own arguments, however calls are
nested. Facts of calls are grouped by name before they meet functions.

What this takes for granted: what ``python_text`` does; an argument within brackets of its own (``f((None))``) is not looked at; a bare string is no statement; functions are told apart by
path and name, and tested by name alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import python_text as P
from .script_text import joined_path

c = F.col

# How a path shows that a file holds no production code or may hold tests, and what expects an error.
NO_TARGET = r"test|runner|scratch/|validation/"
TEST_FOLDERS, TEST_NAMES = ("tests", "scratch"), r"(test|fuzz|run)[^/]*\.py$"
EXPECTS = r"\b(assertRaises|assertRaisesRegex|fails)\s*\("
FIRST_STATEMENTS = 5
_GUARD = r"^(assert|raise)\b|^if\b.*(\b(None|isinstance|not|in|is)\b|[<>]|[=!]=)"
# what is not a blank: strings, comments, words and other characters, but for the ends of continued lines
_TOKENS = re.compile(rf"{P._STRING}|{P._COMMENT}|\w+|[^\s\\]", re.ASCII)
_NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)
_EMPTY = frozenset(('""', "''", '"' * 6, "'" * 6))
_WORDS = frozenset(P._WORDS)


def guarded_functions(sources: DataFrame, changed_lines: DataFrame | None = None) -> DataFrame:
    """(path, name, line, guarded) of the functions of production code; with changed_lines(path, line) only those that hold one.

    A guard is an assertion, a raise or an ``if`` that compares, negates or asks for a type, among a function's own first statements.
    Functions whose names begin and end with two underscores are left out.
    """
    norm = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    own = sources.where(F.endswith(c("path"), F.lit(".py")) & ~norm.rlike(NO_TARGET))
    text = c("text")
    b = P.masked_blocks(own, r"(?:async\s+)?def\s").where("no >= 0").withColumns({"said": P.first_statement(text), "code": P.first_line(text)})
    b = b.withColumn("name", F.regexp_extract("said", P._HEAD, 2)).where(c("code").rlike(P._HEAD) & ~c("name").rlike("^__.*__$"))
    later = F.split(F.regexp_replace("text", r"^[^\n]*\n?", ""), "\n")
    own_level = lambda x: (F.length(x) - F.length(F.ltrim(x)) == c("body")) & ~P.first_line(x).rlike(r"^((elif|else|except|finally)\b|$)")
    early = F.slice(F.filter(later, own_level), 1, FIRST_STATEMENTS)
    found = F.exists(early, lambda x: F.regexp_replace(P.first_statement(x), r":[^:\])}]*$", ":").rlike(_GUARD))
    inline = P.signature(F.regexp_replace("said", P._HEAD, ""), F.lit(False))["inline"] > 0
    one_line = inline & F.regexp_extract("code", r"\)[^()]*?:\s*(.*)$", 1).rlike(_GUARD)
    # blank lines behind a block are none of it
    filled = c("no") + F.regexp_count(F.rtrim(text, F.lit(" \r\n")), F.lit(r"[\r\n]"))
    out = b.select("path", "name", c("no").alias("first"), filled.alias("filled"), (F.coalesce(found, F.lit(False)) | one_line).alias("guarded"))
    if changed_lines is not None:
        # both are as large as the files: packed tables must not be taken for small and broadcast
        marks = changed_lines.select("path", (c("line") - 1).alias("at")).dropna().groupBy("path").agg(F.collect_set("at").alias("marks")).hint("merge")
        out = out.join(marks, "path").where(F.exists("marks", lambda x: x.between(c("first"), c("filled"))))
    return out.groupBy("path", "name").agg(F.max("first").cast("int").alias("first"), F.max_by("guarded", "first").alias("guarded")).select("path", "name", (c("first") + 1).alias("line"), "guarded")


def _call_facts(text: str, found: dict[str, bool]) -> None:
    """Add the names that ``text`` calls to ``found``, and whether an argument of a call is None or empty: one that its bracket, the last one opened a level further out, holds alone."""
    tokens = [x for x in _TOKENS.findall(text) if x[0] != "#"]
    tokens += ["", ""]
    callee: dict[int, str | None] = {}  # of the last bracket of each level
    depth, before2, before = 0, "", ""
    for i, x in enumerate(tokens[:-2]):
        after = tokens[i + 1]
        if before in ("(", ",", "=") and (((x == "None" or x in _EMPTY) and after in (",", ")")) or ((x + after) in ("[]", "{}") and tokens[i + 2] in (",", ")"))):
            name = callee.get(depth)
            if name:
                found[name] = True
        if x in ("(", "[", "{"):
            depth += 1
            name = before if x == "(" and before2 not in ("def", "class") and _NAME.match(before) and before not in _WORDS else None
            callee[depth] = name
            if name:
                found.setdefault(name, False)
        elif x in (")", "]", "}"):
            depth -= 1
        before2, before = before, x


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, bool] = {}
        for text in b.column(0):
            _call_facts(text.as_py(), found)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.bool_())], names=["name", "tried"])


def tried_calls(tests: DataFrame) -> DataFrame:
    """(name, tried) of every name that tests(path, text) call; ``tried`` if one call passes None, an empty string, list or dict, or expects an error."""
    fit = tests.where(F.octet_length("text") <= P.MAX_BYTES)
    calls = fit.select("text").mapInArrow(_calls, "name string, tried boolean")
    text = c("text")
    blocks = P.masked_blocks(tests, r"with\b").where("no >= 0").where(P.first_line(text).rlike(r"^with\b") & P.first_statement(text).rlike(EXPECTS))
    names = F.regexp_extract_all(F.regexp_replace("text", r"\b(?:def|class)\s+\w+", ""), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    expected = blocks.select(F.explode(F.array_except(names, F.lit(P._WORDS))).alias("name"), F.lit(True).alias("tried"))
    return calls.unionByName(expected).groupBy("name").agg(F.bool_or("tried").alias("tried"))


def failure_space(sources: DataFrame, changed_lines: DataFrame | None = None) -> DataFrame:
    """(path, name, line, untested, unguarded, residual) of every function of ``sources(path, text)`` that is to be tested.

    ``untested``: no test calls the name; ``unguarded``: it has no guard, and no test tries an odd case; ``residual`` counts the two.  Tests are files of a test
    folder whose own name says so.  Null paths or texts have no functions; paths must be distinct.
    """
    known = sources.select("path", "text").dropna()
    functions = guarded_functions(known, changed_lines)
    norm = F.lower(joined_path(F.lit(""), F.replace("path", F.lit("\\"), F.lit("/"))))
    called = tried_calls(known.where(F.split(norm, "/")[0].isin(*TEST_FOLDERS) & norm.rlike(TEST_NAMES)))
    out = functions.join(called.hint("merge"), "name", "left").withColumns({"untested": c("tried").isNull(), "unguarded": ~c("guarded") & ~F.coalesce("tried", F.lit(False))})
    return out.select("path", "name", "line", "untested", "unguarded", (c("untested").cast("int") + c("unguarded").cast("int")).alias("residual"))
