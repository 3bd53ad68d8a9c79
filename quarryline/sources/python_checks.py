"""Checks of Python source: text that has no balance, files opened without an encoding, fixed path separators, errors passed over, and stubs.

A block is empty if no statement within it does something.  Calls and separators are found among a text's pieces, of which a letter for each
finding and all line feeds are kept.  All of it happens within a file's row.

What this takes for granted: what ``python_text`` does; an ``open`` within another one's arguments is not looked at; the line of a separator is the one that it is on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import python_text as P

c = F.col

_STRING = P._STRING
_LITERAL = rf"(?:\b[A-Za-z]{{1,2}})?(?:{_STRING})"
_BRACKETED = rf"(?:[^()\"'#]|{_STRING}|{P._COMMENT})*+"
for _ in range(4):  # brackets within brackets
    _BRACKETED = rf"(?:[^()\"'#]|{_STRING}|{P._COMMENT}|\({_BRACKETED}\))*+"
_OPEN = rf"(?<![\w.])(?:io\.)?open\s*\({_BRACKETED}\)"
_SEPARATOR = r"""(?:"/"|'/'|"\\\\"|'\\\\')"""
_SPLIT = rf"\.\s*split\s*\(\s*{_SEPARATOR}\s*,?\s*\)"
_ADDED = rf"\+\s*{_SEPARATOR}(?!\s*[*%.\[])|(?<![*%\w)\]\s])\s*{_SEPARATOR}\s*\+"
_PIECE = rf"(?:{_OPEN})|(?:{_SPLIT})|(?:{_ADDED})|(?:{_LITERAL})|(?:{P._COMMENT})|\w+|(?s:.)"
#: Statements that do nothing.
_IDLE = r"^(pass|\.\.\.|None|True|False|[0-9.]+)?(\s*;\s*(pass|\.\.\.)?)*$"
_EMPTY_ABOVE = r"^(?:async\s+)?def\s|^except\b"


def _without_encoding(call: Column) -> Column:
    """Whether the text of an ``open`` call names no encoding and no binary mode."""
    strings = F.regexp_extract_all(call, F.lit(rf"{_STRING}|{P._COMMENT}|[^\"'#]+|(?s:.)"), F.lit(0))
    told = lambda x: F.when(x.rlike("^#"), "").when(~x.rlike("^[\"'].*") | (F.length(x) < 2), x).when(x.rlike("[bB]"), "'B'").otherwise("'T'")
    args = F.regexp_replace(F.array_join(F.transform(strings, told), ""), r"^[^(]*\(|\)$", "")
    for _ in range(6):
        args = F.regexp_replace(args, r"[(\[{][^()\[\]{}]*[)\]}]", "_")
    parts = F.transform(F.split(args, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    by_name = F.exists(parts, lambda x: x.rlike(r"^mode ?= ?'[BT]'$"))
    binary = F.exists(parts, lambda x: x.rlike(r"^mode ?= ?'B'$")) | (~by_name & (F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")) == "'B'"))
    return ~binary & ~F.exists(parts, lambda x: x.rlike(r"^encoding ?="))


def _joins_by_separator(literal: Column) -> Column:
    """Whether a formatted string has a separator at an end of one of its fixed parts."""
    body = F.regexp_replace(F.regexp_replace(literal, r"""^[A-Za-z]+("{3}|'{3}|["'])|("{3}|'{3}|["'])$""", ""), r"\\\\", "/")
    body = F.regexp_replace(F.regexp_replace(body, r"\\.", "x"), r"\{\{|\}\}", "x")
    parts = F.split(body, r"\{[^{}]*\}")
    fixed = F.exists(parts, lambda x: x.rlike(r"^/|/$|^\s*/\s*$") & ~x.rlike("https?://"))
    return literal.rlike("^(?i:f|rf|fr)[\"']") & (F.size(parts) > 1) & fixed


def _piece_findings(sources: DataFrame) -> DataFrame:
    """(path, line, rule) of files whose brackets balance, and line 0 of those whose do not."""
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))

    def mark(x: Column) -> Column:
        """The letter of what a piece is found to be, and its line feeds."""
        found = F.when(x.rlike(r"^(?:io\.)?open\s*\("), F.when(_without_encoding(x), "E").otherwise("")).when(x.rlike(rf"^(?:{_SPLIT}|{_ADDED})$") | _joins_by_separator(x), "S").otherwise("")
        return F.concat(F.when(x.rlike(r"[\"']|^(?:io\.)?open\s*\("), found).otherwise(""), F.regexp_replace(x, r"[^\n]+", ""))

    marks = F.when(c("text").isNotNull() & (F.octet_length("text") <= P.MAX_BYTES), F.array_join(F.transform(pieces, mark), ""))
    files = P.masked_blocks(sources.select(F.struct("path", marks.alias("marks")).alias("path"), "text"), None)
    wrong = (c("least") < 0) | (c("last") != 0)
    at = files.select("path.path", F.posexplode(F.split(F.when(wrong, "!").otherwise(F.coalesce("path.marks", F.lit(""))), "\n")).alias("no", "letters"))
    each = at.where("letters <> ''").select("path", "no", F.explode(F.split("letters", "")).alias("letter"))
    rule = F.when(c("letter") == "!", "SyntaxError").when(c("letter") == "E", "MissingFileEncoding").otherwise("HardcodedPathSeparators")
    return each.select("path", F.when(c("letter") == "!", 0).otherwise(c("no") + 1).cast("int").alias("line"), rule.alias("rule"))


def _empty_blocks(sources: DataFrame) -> DataFrame:
    """Handlers and functions whose blocks do nothing; abstract and overloaded functions, and those of abstract classes, may."""
    heads = P.masked_blocks(sources, r"(?:async\s+)?def\s|except\b", r"class[ \x0b]").where("no >= 0 and least >= 0 and last = 0")
    heads = heads.where(P.first_line(c("text")).rlike(_EMPTY_ABOVE)).withColumn("said", P.first_statement(c("text")))
    later = F.split(F.regexp_replace("text", r"^[^\n]*\n?", ""), "\n")
    acts = F.exists(later, lambda x: ~P.first_line(x).rlike(_IDLE))
    empty = heads.where(c("said").rlike(r":\s*((pass|\.\.\.)\s*)?$") & ~acts)
    free = F.exists(F.split(F.coalesce("above", F.lit("")), "\n"), lambda x: P.first_line(x).rlike(r"^@([\w.]+\.)?(abstractmethod|overload)$"))
    abstract = P.first_statement(F.coalesce("around", F.lit(""))).rlike(r"[(,]\s*ABC\s*[,)]")
    handler = c("said").rlike(r"^except\b")
    return empty.where(handler | (~free & ~abstract)).select("path", (c("no") + 1).alias("line"), F.when(handler, "SilentErrorHandling").otherwise("FunctionStub").alias("rule"))


def source_checks(sources: DataFrame) -> DataFrame:
    """(path, line, rule) of ``sources(path, text)``; a file whose brackets don't balance has one row, of line 0 and rule SyntaxError.  Texts of null are empty; paths must be distinct."""
    return _piece_findings(sources).unionByName(_empty_blocks(sources))
