"""Facts of JavaScript and TypeScript source text, and where its imports lead.

Text is read in stages: comments become blanks, specifiers are taken while strings still stand, then strings become blanks
and branches are counted.  All of it is Column expressions over a file's text; specifiers are resolved by equi-joins with
all forms that a file's path may have, never by comparing every specifier with every file.

Texts of null are empty; files of one path are read each by itself; paths are relative, with forward slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..store import materialize

c = F.col

# Extensions, and the patterns by which imports, branches and definitions are known.
SCRIPT_LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
PROBED = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
IMPORT = r"""(?U)(?:import\s+(?:[\w*\s{},]*\s+from\s+)?|import\s*\(\s*)['"]([^'"]+)['"]"""
EXPORT = r"""(?U)export\s+(?:[\w*\s{},]*\s+from\s+)['"]([^'"]+)['"]"""
REQUIRE = r"""(?U)require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
BRANCH = r"(?U)\b(if|for|while|catch|switch|case)\b"
TERNARY = r"(?<!\?)\?(?![.?:])"
CLASS = r"(?U)\bclass\s+([A-Za-z0-9_$]+)"
FUNCTION = r"(?U)\bfunction\s+([A-Za-z0-9_$]+)"
ARROW = r"(?U)(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"

_COMMENT = r"//[^\r\n]*|/\*(?s:.*?)\*/"
# possessive groups: Java matches them in a loop, whatever the length of a string
_STRING = "|".join(rf"{q}(?:[^{q}\\]|\\[^\n])*+{q}" for q in "\"'`")
_PLAIN = "[^/\"'`]+"
_DOTTED = r"(?:^|/)\.{0,2}(?:/|\z)"  # an empty part of a path, or one of dots
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def without_comments(text: Column) -> Column:
    """``text`` with comments as blanks; what looks like a comment inside a string or a template stays."""
    return X.masked(text, _COMMENT, f"{_PLAIN}|{_STRING}")


def without_strings(code: Column) -> Column:
    return X.masked(code, _STRING, f"{_PLAIN}|{_COMMENT}")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def is_script_test(path: Column) -> Column:
    return F.lower(K.base_name(path)).rlike(r"\.(test|spec)\.(js|ts)$") | path.rlike("(^|/)(tests|test|__tests__)/")


def script_facts(sources: DataFrame) -> DataFrame:
    """(path, language, is_test, loc, complexity, specifiers, classes, functions) of the script files among sources(path, text).

    ``loc`` counts lines that hold more than blanks and comments.  The three lists are sorted and free of repetitions.
    """
    path = F.lower("path")
    language = K.first_match([(F.endswith(path, F.lit(ext)), name) for ext, name in SCRIPT_LANGUAGES.items()], "")
    files = sources.select("path", language.alias("language"), without_comments(F.coalesce("text", F.lit(""))).alias("code")).where("language <> ''")
    files = files.withColumn("bare", without_strings(c("code")))
    filled = F.filter(F.split("code", LINE_END), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    branches = F.regexp_count("bare", F.lit(BRANCH)) + F.regexp_count("bare", F.lit(TERNARY))
    listed = lambda *patterns: F.sort_array(F.array_distinct(F.concat(*(_all(c("code"), p) for p in patterns))))
    return files.select(
        "path", "language", is_script_test(c("path")).alias("is_test"), F.size(filled).cast("long").alias("loc"), (1 + branches).cast("long").alias("complexity"),
        listed(IMPORT, EXPORT, REQUIRE).alias("specifiers"), listed(CLASS).alias("classes"), listed(FUNCTION, ARROW).alias("functions"),
    )


def _walked(folder: Column, relative: Column) -> Column:
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(relative, "/")), lambda x: ~x.isin("", "."))
    back = lambda before, x: (x == "..") & (F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("..")) != "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda before, x: F.when(back(before, x), F.slice(before, F.lit(1), F.size(before) - 1)).otherwise(F.concat(before, F.array(x))))
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def joined_path(folder: Column, relative: Column) -> Column:
    """``relative`` seen from ``folder``, without ``.`` and with each ``..`` taken back as far as there is something before it.

    Where all dots stand first, they are counted and cut off ``folder``; only other paths are walked part by part.
    """
    dots = F.regexp_extract(relative, r"^(?:\.\.?/)*+", 0)
    rest = F.substring(relative, F.length(dots) + 1, F.length(relative))
    ups = F.length(dots) - F.length(F.replace(dots, F.lit(".."), F.lit(".")))
    depth = F.when(folder == "", 0).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1)
    before = F.when(ups < depth, F.concat(F.call_function("substring_index", folder, F.lit("/"), depth - ups), F.lit("/"))).otherwise(F.repeat(F.lit("../"), ups - depth))
    plain = ((folder == "") | ~folder.rlike(_DOTTED)) & ~rest.rlike(_DOTTED)
    return F.when(plain, F.concat(before, rest)).otherwise(_walked(folder, relative))


def folder_of(path: Column) -> Column:
    """All before the last slash, nothing where there is none."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def _keys(file: Column) -> Column:
    """What a specifier's path may be, for it to mean ``file``: rank 0 the file itself, then without its extension, then the folder whose index it is."""
    keys = [F.struct(F.lit(0).alias("rank"), file.alias("at"))]
    for n, ext in enumerate(PROBED):
        for rank, end in ((n + 1, ext), (n + 1 + len(PROBED), f"/index{ext}")):
            keys.append(F.struct(F.lit(rank).alias("rank"), F.when(F.endswith(file, F.lit(end)), _without(file, end)).alias("at")))
    return F.filter(F.array(*keys), lambda x: x["at"].isNotNull())


def _without(text: Column, end: str) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - len(end))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target, found) of every row of imports(path, specifier) among files(path).

    A specifier that begins with a dot is a path from its file's folder: the file of that path, else with an extension, else the index file in the
    folder of that name, in the order of ``PROBED``; else the least path that ends with it, with an extension or without.  ``found`` tells whether
    there is any; where there is none the target is the path itself.  Other specifiers are their own targets.  Nulls are no specifiers.

    Files, not specifiers, are taken apart: each becomes one row for each form that leaves something out, and, where paths asked for are no such form,
    one for each of its endings, with and without extension, that is as long as one of them.
    """
    spec = F.trim("specifier")
    asks = imports.select("path", "specifier").dropna()
    asks = asks.withColumn("at", F.when(F.startswith(spec, F.lit(".")), F.replace(joined_path(folder_of(c("path")), spec), F.lit("\\"), F.lit("/"))))
    asks = materialize(asks, "script-imports")
    files = files.select(c("path").alias("file")).dropna().distinct()
    keys = files.select("file", F.explode(_keys(c("file"))).alias("k")).select("file", "k.rank", "k.at")
    exact = keys.groupBy("at").agg(F.min_by("file", "rank").alias("target"))
    wanted = materialize(asks.select("at").dropna().distinct().join(exact, "at", "left"), "script-targets")
    tails = wanted.where("target is null").select("at", F.xxhash64("at").alias("hash"), F.length("at").alias("size"))
    sizes = tails.select("size").distinct()  # at most as many as the longest path has letters
    stem = K.first_match([(F.endswith("file", F.lit(ext)), _without(c("file"), ext)) for ext in PROBED], F.lit(None).cast("string"))
    bases = files.select("file", F.explode(F.array("file", stem)).alias("base")).where("length(base) > 0")
    endings = bases.select("file", "base", F.explode(F.sequence(F.lit(1), F.length("base"))).alias("size")).join(F.broadcast(sizes), "size")
    endings = endings.select("file", "size", F.right("base", c("size")).alias("ending")).select("file", "size", "ending", F.xxhash64("ending").alias("hash"))
    ended = endings.join(tails, ["hash", "size"]).where("ending = at").groupBy("at").agg(F.min("file").alias("target"))
    known = asks.join(wanted.where("target is not null").unionByName(ended), "at", "left")
    return known.select("path", "specifier", F.coalesce("target", "at", spec).alias("target"), c("target").isNotNull().alias("found"))


def resolve_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """What ``resolved`` says of the distinct imports."""
    return resolved(imports, files).distinct()


def tested_files(files: DataFrame) -> DataFrame:
    """(test, target) of files(path): a test and the least path of another file of its name without ``.test`` or ``.spec``; tests without such a file have no row."""
    named = files.select("path", F.lower(K.base_name(c("path"))).alias("name")).dropna()
    tests = named.where(is_script_test(c("path"))).select(c("path").alias("test"), F.regexp_replace("name", r"\.test|\.spec", "").alias("name"))
    # the two least of a name are enough, since a test leaves out itself alone
    least = named.groupBy("name").agg(F.min("path").alias("first"))
    second = named.join(least, "name").where("path <> first").groupBy("name").agg(F.min("path").alias("second"))
    of = tests.distinct().join(least, "name").join(second, "name", "left")
    return of.select("test", F.when(c("first") != c("test"), c("first")).otherwise(c("second")).alias("target")).dropna()
