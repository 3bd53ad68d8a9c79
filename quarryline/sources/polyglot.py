"""Facts of source text in several languages, by one record for each file: the language follows from the extension.

Scripts and Go are read by patterns over the whole text; Python by ``python_text``, and by patterns where its brackets don't balance.
Texts of null are empty, NULs are left out, files of one path are read each by itself but for Python, whose paths must be distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from . import python_text as P
from .script_text import LINE_END, SCRIPT_LANGUAGES

c = F.col

# Extensions, and the patterns of each language.
LANGUAGES = SCRIPT_LANGUAGES | {".py": "python", ".go": "go"}
_NAMES = {
    "script": {
        "imports": (
            r"""(?U)(?:import|export)\s+(?:(?:type\s+)?[\w\s{},*]+from\s+)?['"]([^'"]+)['"]""",
            r"""(?U)require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
            r"""(?U)import\s*\(\s*['"]([^'"]+)['"]\s*\)""",
        ),
        "functions": (r"(?U)function\s*([A-Za-z0-9_$]+)\s*\(", r"(?U)(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z0-9_$]+)\s*=>"),
        "classes": (r"(?U)class\s+([A-Za-z0-9_$]+)",),
    },
    "go": {
        "imports": (r"""(?U)import\s+(?:[a-zA-Z0-9_.]+\s+)?["']([^"']+)["']""",),
        "functions": (r"(?U)func\s+(?:\([A-Za-z0-9_*\s,\[\]]+\)\s+)?([A-Za-z0-9_]+)(?:\[[^\]]+\])?\s*\(",),
        "classes": (r"(?U)type\s+([A-Za-z0-9_]+)(?:\[[^\]]+\])?\s+(?:struct|interface)",),
    },
    "broken": {
        "imports": (),  # by _IMPORT: what is imported from a module is no module
        "functions": (r"(?U)(?:async\s+)?def\s+([a-zA-Z0-9_]+)\s*\(",),
        "classes": (r"(?U)class\s+([a-zA-Z0-9_]+)",),
    },
    "python": {  # of masked text
        "imports": (r"(?md)^\s*from\s+(\.*[\w.]*)\s+import\b",),
        "functions": (r"(?md)^\s*(?:async\s+)?def\s+(\w+)",),
        "classes": (r"(?md)^\s*class\s+(\w+)",),
    },
}
_BRANCHES = {
    # what excludes each other is looked for at once, where its first letter stands
    "script": (r"(?=[ifwc&|?])(?:\b(?:if|for|while|catch|case)\b|&&|\|\||\?\?|(?<![?.:\w])\?(?![?.:\w]))", r"\belse\s+if\b"),
    "go": (r"(?=[ifcsdg&|])(?:\b(?:if|for|case|select|defer|go)\b|&&|\|\|)",),
    "broken": (r"\b(?:if|elif|for|while|except|with|assert|case)\b|&&|\|\|",),
}
_IMPORT = r"(?U)(from\s+[a-zA-Z0-9_.]+\s+import|import\s+[a-zA-Z0-9_.]+)"
_GO_BLOCK, _QUOTED = r"(?s)import\s*\((.*?)\)", r"""["']([^"']+)["']"""
_END = LINE_END.split("|")[1]
_OTHER_END = _END.replace("\n", "")
_PACKAGE = r"(?md)^\s*package\s+([a-zA-Z0-9_]+)"


def line_count(text: Column) -> Column:
    """Lines by any line end; what follows the last one counts if there is something."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))  # most texts have no other ends
    ends = F.when(text.rlike(_OTHER_END), F.regexp_count(text, F.lit(LINE_END))).otherwise(feeds)
    ended = (text == "") | F.right(text, F.lit(1)).rlike(_END)
    return (ends + 1 - ended.cast("int")).cast("long")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _names(kind: str, what: str, text: Column, more: Column | None = None) -> Column:
    found = [_all(text, p) for p in _NAMES[kind][what]] + ([] if more is None else [more])
    return F.sort_array(F.array_distinct(F.filter(F.concat(*found), lambda x: x != "")))


def _branches(kind: str, text: Column) -> Column:
    return 1 + sum((F.regexp_count(text, F.lit("(?U)" + p)) for p in _BRANCHES[kind]), F.lit(0))


def _by_patterns(files: DataFrame, kind: str, more: Column | None = None, package: Column | None = None) -> DataFrame:
    text = c("text")
    package = F.lit(None).cast("string") if package is None else package
    return files.select("path", "language", "loc", _branches(kind, text).cast("long").alias("complexity"), _names(kind, "imports", text, more).alias("imports"), _names(kind, "functions", text).alias("functions"), _names(kind, "classes", text).alias("classes"), package.alias("package"))


def _python(files: DataFrame) -> DataFrame:
    """Sound files by their statements, others by patterns."""
    facts = P.python_facts(files.select("path", "text"), "module", "error").select("path", "kind", P.complexity("mccabe").cast("long").alias("complexity"))
    read = files.join(facts, "path", "left")
    sound = read.where("kind = 'module'").withColumn("code", F.regexp_replace(P.masked_source(c("text")), r"\\\n", "  "))
    plain = F.flatten(F.transform(_all(c("code"), r"(?md)^\s*import\s+([^\n;]+)"), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(y, r"\s+as\s+\w+", "")))))
    code = c("code")
    out = sound.select("path", "language", "loc", "complexity", _names("python", "imports", code, plain).alias("imports"), _names("python", "functions", code).alias("functions"), _names("python", "classes", code).alias("classes"), F.lit(None).cast("string").alias("package"))
    named = F.transform(_all(c("text"), _IMPORT), lambda x: F.regexp_extract(x, r"(?U)^(?:from|import)\s+([a-zA-Z0-9_.]+)", 1))
    return out.unionByName(_by_patterns(read.where("kind is null or kind = 'error'"), "broken", named))


def polyglot_facts(sources: DataFrame) -> DataFrame:
    """(path, language, loc, complexity, imports, functions, classes, package) of sources(path, text); lists are sorted and free of repetitions.

    Blank files, and those of other languages, have complexity 1 and no names; Go files without a package clause are of ``main``.
    """
    path = F.trim(F.replace("path", F.lit("\\"), F.lit("/")))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\0"), F.lit(""))
    language = K.first_match([(F.endswith(F.lower("path"), F.lit(ext)), name) for ext, name in LANGUAGES.items()], "unknown")
    files = sources.select(path.alias("path"), text.alias("text")).select("path", F.coalesce(language, F.lit("unknown")).alias("language"), "text", line_count(c("text")).alias("loc"))
    filled = c("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    none = F.array().cast("array<string>")
    rest = files.where((c("language") == "unknown") | ~filled)
    rest = rest.select("path", "language", "loc", F.lit(1).cast("long").alias("complexity"), none.alias("imports"), none.alias("functions"), none.alias("classes"), F.lit(None).cast("string").alias("package"))
    of = lambda *names: files.where(c("language").isin(*names) & filled)
    blocks = F.flatten(F.transform(_all(c("text"), _GO_BLOCK), lambda x: _all(x, _QUOTED)))
    package = F.regexp_extract("text", _PACKAGE, 1)
    go = _by_patterns(of("go"), "go", blocks, F.when(package == "", "main").otherwise(package))
    return _by_patterns(of("javascript", "typescript"), "script").unionByName(go).unionByName(_python(of("python"))).unionByName(rest)
