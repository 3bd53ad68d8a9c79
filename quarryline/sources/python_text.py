"""Facts of Python source text, by DataFrame expressions over its lines.

A file's text is masked (strings and comments become blanks of the same length) and cut into the blocks of its definitions (``blocks``), within its
row: a block ends before the next statement that is indented no deeper.  Facts are expressions over the texts of blocks, so that no lines are shuffled or joined.  ``source_lines`` and ``block_ends`` give
the lines themselves, by windows.  Source text is read, never run.

What this takes for granted: a boolean expression is counted for each kind of connective in a line; files of unbalanced brackets are errors and have no other facts; files beyond MAX_BYTES have none at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .blocks import statement_blocks

c = F.col
MAX_BYTES = 1 << 20
_COMMENT = r"#[^\n]*"
_STRING = r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''|" + r'"(?:[^"\n\\]|\\.)*+"|' + r"'(?:[^'\n\\]|\\.)*+'"
_PLAIN = r"""[^"'#]+"""
_WORDS = "and as assert async await case class def elif else except finally for from if import in is lambda match not or raise return try while with yield".split()
#: Statements that a line begins with.
_STARTS = {"if": r"^(if|elif)\b", "for": r"^(async\s+)?for\b", "while": r"^while\b", "excepthandler": r"^except\b", "with": r"^(async\s+)?with\b", "assert": r"^assert\b", "match_case": r"^case\b.*:$"}
_COUNTED = ("if", "for", "while", "excepthandler", "with", "assert", "ifexp", "boolop", "comprehension", "match_case")


def masked_source(text: Column) -> Column:
    """``text`` with strings and comments as blanks."""
    return X.masked(text, f"{_STRING}|{_COMMENT}", _PLAIN)


def source_lines(sources: DataFrame) -> DataFrame:
    """(path, no, statement, code, indent, starts, ends_at, ...counts, calls) of every line.

    ``starts`` where a statement begins, ``statement`` is the number of the one that a line belongs to, ``ends_at`` the depth of brackets after it.
    """
    fit = sources.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES).select("path", F.coalesce("text", F.lit("")).alias("text"))
    joined = F.regexp_replace(masked_source(c("text")), r"\\\n", "  ")
    lines = fit.select("path", F.posexplode(F.split(joined, "\n")).alias("no", "line"))
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    change = F.regexp_count("line", F.lit(r"[(\[{]")) - F.regexp_count("line", F.lit(r"[)\]}]"))
    lines = lines.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    code = F.trim(F.regexp_replace("line", r"[\t\r\f]", " "))
    lines = lines.withColumn("code", code).withColumn("indent", F.length("line") - F.length(F.ltrim(F.regexp_replace("line", r"[\t\r\f]", " "))))
    starts = (c("depth") == 0) & (c("code") != "")
    count = lambda pattern: F.regexp_count("code", F.lit(pattern))
    begins = {k: F.when(starts & c("code").rlike(p), 1).otherwise(0) for k, p in _STARTS.items()}
    counts = begins | {
        "ifexp": count(r"\belse\b(?!\s*:)"),
        "comprehension": count(r"\bfor\b") - begins["for"],
        "boolop": c("code").rlike(r"\band\b").cast("int") + c("code").rlike(r"\bor\b").cast("int"),
    }
    called = F.regexp_extract_all(F.regexp_replace("code", r"^(async\s+)?(def|class)\s+\w+", ""), F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return lines.select(
        "path", "no", F.sum(starts.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("statement"), "code", "indent", starts.alias("starts"), (c("depth") + c("change")).alias("ends_at"),
        *(counts[k].cast("int").alias(f"n_{k}") for k in _COUNTED), count(r"\b(and|or)\b").cast("int").alias("boolean_operands"),
        F.filter(called, lambda x: ~x.isin(*_WORDS)).alias("calls"),
    )


_HEAD = r"^(?:async\s+)?(def|class)\s+(\w+)"


def signature(text: Column, of_class: Column) -> Column:
    """(args, inline) of the text after a definition's name: its parameters or bases, and whether a statement follows the colon on its line.

    Commas within inner brackets and between a lambda's parameters separate nothing; stars, ``/`` and a class's keywords are no arguments.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[()\[\]{},:]|[^()\[\]{},:]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("args"), F.lit("").alias("said"), F.lit(False).alias("listed"), F.lit(False).alias("shut"), F.lit(False).alias("over"), F.lit(False).alias("inline"))

    def step(a: Column, x: Column) -> Column:
        opens, closes, over = x.isin("(", "[", "{"), x.isin(")", "]", "}"), a["over"]
        outer = (a["depth"] == 1) & a["listed"] & ~a["shut"]
        ends = outer & (closes | ((x == ",") & ~a["said"].rlike(r"\blambda\b[^:]*$")))
        said = F.trim(a["said"])
        counts = ends & ~said.rlike(r"^(\*.*|/|)$") & ~(of_class & said.rlike(r"^\w+\s*=(?!=)"))
        return F.struct(
            (a["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            (a["args"] + counts.cast("int")).alias("args"),
            F.when(ends, "").when(outer & ~opens, F.concat(a["said"], x)).when(outer, F.concat(a["said"], F.lit("()"))).otherwise(a["said"]).alias("said"),
            (a["listed"] | ((a["depth"] == 0) & (x == "("))).alias("listed"),
            (a["shut"] | (outer & closes)).alias("shut"),
            (over | ((a["depth"] == 0) & (x == ":"))).alias("over"),
            (a["inline"] | (over & (F.trim(x) != ""))).alias("inline"),
        )

    return F.aggregate(tokens, start, step, lambda a: F.struct(a["args"].alias("args"), a["inline"].cast("int").alias("inline")))


def block_ends(lines: DataFrame, head: str) -> DataFrame:
    """(path, no, statement, indent, body, end, after, said) of every statement whose first line matches ``head``.

    ``end`` is the first line after its block, null for the file's last ones, ``body`` the indent of the next statement, ``after`` the number of the file's lines, ``said`` its text over all its lines.
    """
    order = Window.partitionBy("path").orderBy("no")
    statements = lines.where("starts").select("path", "no", "statement", "indent", "code", F.lag("indent").over(order).alias("above"), F.lead("indent").over(order).alias("body"))
    heads = statements.where(c("code").rlike(head))
    back = statements.where("indent <= above").select("path", "no", F.explode(F.sequence("indent", "above")).alias("indent"), F.lit(True).alias("closes"))
    both = back.unionByName(heads.select("path", "no", "indent", "statement", "body", F.lit(False).alias("closes")), allowMissingColumns=True)
    # from the last line up; a statement comes before what its own line closes
    below = Window.partitionBy("path", "indent").orderBy(F.desc("no"), "closes").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.withColumn("end", F.last(F.when(c("closes"), c("no")), ignorenulls=True).over(below)).where("not closes").drop("closes")
    said = lines.join(heads.select("path", "statement"), ["path", "statement"], "left_semi").where("code <> ''")
    said = said.groupBy("path", "statement").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "code"))), lambda x: x["code"]), " ").alias("said"))
    last = lines.groupBy("path").agg((F.max("no") + 1).alias("after"))
    return ends.join(said, ["path", "statement"]).join(last, "path")


def block_ranges(lines: DataFrame) -> DataFrame:
    """(path, kind, name, args, inline, first, end, body) of every definition; ``end`` is the first line after its block, ``body`` the indent of its first statement."""
    found = block_ends(lines, _HEAD)
    is_class = F.regexp_extract("said", _HEAD, 1) == "class"
    found = found.withColumn("s", signature(F.regexp_replace("said", _HEAD, ""), is_class))
    return found.select("path", F.when(is_class, "class").otherwise("function").alias("kind"), F.regexp_extract("said", _HEAD, 2).alias("name"), "s.args", "s.inline", c("no").alias("first"), F.coalesce("end", "after").alias("end"), "body")


#: White space within a line of a block's text, and the beginning of a physical line of it.
_W = r"[ \x0B]"
_LINE = r"(?<![^\n\r])"
_LATER = r"(?:elif|else|except|finally|case)\b"
_IMPORT, _FROM, _EXPORTS = r"^import\s", r"^from\s.*\simport\b", r"^__all__\s*(:[^=]+)?\+?="
_KINDS = {"import": r"(?:import|from)\s", "function": r"(?:async\s+)?def\s", "class": r"(?:async\s+)?class\s", "exports": r"__all__"}


def masked_blocks(sources: DataFrame, heads: str | None, around: str | None = None) -> DataFrame:
    """``statement_blocks`` of the files that are no longer than MAX_BYTES, masked and with continued lines as one; texts of null are empty."""
    fit = sources.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES).select("path", F.coalesce("text", F.lit("")).alias("text"))
    return statement_blocks(fit.select("path", F.regexp_replace(masked_source(c("text")), r"\\\n", "  ").alias("text")), heads, around)


def first_statement(text: Column) -> Column:
    """The code of a block's first statement, over all its lines."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"^[^\n]*", 0), r"(?<! ) *+\r[ \r]*", " "))


def first_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^[^\n\r]*", 0))


def _begun(text: Column, pattern: str) -> Column:
    """The number of a block's statements that begin with ``pattern``, and end so where it ends with ``$``."""
    inner = pattern.removeprefix("^").replace(r"\s", _W)
    inner = inner.removesuffix("$") + rf"{_W}*(?=[\n\r]|\z)" if inner.endswith("$") else inner
    return F.regexp_count(text, F.lit(f"(?dm)^{_W}*(?:{inner.replace('.*', '[^' + chr(92) + 'n' + chr(92) + 'r]*')})"))


def _counts(text: Column) -> dict[str, Column]:
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    begins = {k: _begun(text, p) for k, p in _STARTS.items()}
    more = {
        "ifexp": count(rf"\belse\b(?!{_W}*:)"),
        "comprehension": count(r"\bfor\b") - begins["for"],
        "boolop": count(r"\band\b[^\n\r]*") + count(r"\bor\b[^\n\r]*"),  # once in a line
    }
    return {f"n_{k}": (begins | more)[k] for k in _COUNTED} | {"boolean_operands": count(r"\b(?:and|or)\b")}


def _calls(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"{_LINE}({_W}*)(?:async{_W}+)?(?:def|class){_W}+\w+", "$1")
    return F.filter(F.regexp_extract_all(bare, F.lit(rf"([A-Za-z_]\w*){_W}*\("), F.lit(1)), lambda x: ~x.isin(*_WORDS))


def python_facts(sources: DataFrame, *kinds: str) -> DataFrame:
    """(path, kind, name, args, lineno, statements, n_..., boolean_operands, calls) of ``sources(path, text)``.

    Kinds: module, import, function, class, exports (a module that says what it exports), error; only those in ``kinds``, where some are given.  Counts are of a row's whole block.
    """
    asked = [p for k, p in _KINDS.items() if not kinds or k in kinds]
    b = masked_blocks(sources, "|".join(asked) or None)
    text, whole = c("text"), c("no") < 0
    wrong = (c("least") < 0) | (c("last") != 0)
    b = b.where(whole | ~wrong).withColumn("said", F.when(~whole, first_statement(text))).withColumn("code", F.when(~whole, first_line(text)))
    head, definition = c("code"), c("code").rlike(_HEAD)
    kind = F.when(whole, F.when(wrong, "error").otherwise("module")).when(definition, F.when(F.regexp_extract("said", _HEAD, 1) == "class", "class").otherwise("function"))
    kind = kind.when(head.rlike(_IMPORT) | head.rlike(_FROM), "import").when((c("indent") == 0) & head.rlike(_EXPORTS), "exports")
    b = b.withColumn("kind", kind).where(c("kind").isin(*kinds) if kinds else c("kind").isNotNull())
    block = c("kind").isin("module", "function", "class")
    plain = F.transform(F.split(F.regexp_extract(head, r"^import\s+(.*)$", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+\w+", "")))
    names = F.when(head.rlike(_IMPORT), plain).otherwise(F.array(F.regexp_extract(head, r"^from\s+\.*(\S*)\s+import", 1)))
    if not kinds or "import" in kinds:
        b = b.withColumn("imported", F.explode(F.when(c("kind") == "import", names).otherwise(F.array(F.lit("")))))
    else:
        b = b.withColumn("imported", F.lit(""))
    name = F.when(c("kind").isin("function", "class"), F.regexp_extract("said", _HEAD, 2)).when(c("kind") == "exports", "__all__").otherwise(c("imported"))
    s = F.when(c("kind").isin("function", "class"), signature(F.regexp_replace("said", _HEAD, ""), c("kind") == "class"))
    # a line feed and the body's indent before anything that is no later part of a statement
    direct = F.regexp_count("text", F.concat(F.lit("(?<=\n) {"), c("body").cast("string"), F.lit(rf"}}(?![ \n\r]|\z|{_LATER})")))
    top = F.regexp_count("text", F.lit(rf"(?dm)^(?!{_LATER})[^ \n]"))
    statements = F.when(c("kind") == "module", top).when(block, F.coalesce(direct, F.lit(0)) + s["inline"]).otherwise(0)
    counts = [F.when(block, x).otherwise(0).cast("int").alias(k) for k, x in _counts(text).items()]
    calls = F.when(block, _calls(text)).otherwise(F.array().cast("array<string>"))
    lineno = F.when(c("kind") == "module", 0).when(c("kind") == "error", 1).otherwise(c("no") + 1)
    return b.select("path", "kind", name.alias("name"), F.coalesce(s["args"], F.lit(0)).alias("args"), lineno.alias("lineno"), statements.cast("int").alias("statements"), *counts, calls.alias("calls"))


def layout_free_digest(sources: DataFrame) -> DataFrame:
    """(path, digest) of a file's code without comments, blank lines and the width of blanks; strings count."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?:{_STRING})|(?:{_COMMENT})|(?:{_PLAIN})|(?s:.)"), F.lit(0))
    bare = F.array_join(F.filter(pieces, lambda x: ~x.rlike(f"^{_COMMENT}$")), "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"(?<=\S)[ \t]+", " "))), lambda x: F.trim(x) != "")
    return sources.select("path", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))


#: The complexity definitions, which disagree on purpose; each is of a function or a module.
_COMPLEXITY = {
    "block": ("if for while excepthandler with boolop comprehension assert", False),
    "module": ("if for while excepthandler with", False),
    "poly": ("if for while excepthandler ifexp", True),
    "mccabe": ("if for while excepthandler with ifexp assert match_case", True),
    "watch": ("if for while excepthandler with assert", True),
    "patch": ("if for while excepthandler", True),
}


def complexity(kind: str) -> Column:
    """1, and one for each node that the definition counts, and for each further operand of a boolean expression where it says so."""
    names, operands = _COMPLEXITY[kind]
    out = F.lit(1)
    for x in names.split():
        out = out + F.col(f"n_{x}")
    return out + F.col("boolean_operands") if operands else out
