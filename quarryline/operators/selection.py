"""What a file is by its path, which tests a change asks for, and which changed files a written constraint forbids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import classify as K
from ..sources.script_queries import _ASKS, _FILES, script_files
from ..sources.script_text import joined_path
from ..store import materialize
from ..views import Views

c = F.col

# How paths tell what a file is, and how a text forbids something; all in lower case.
CATEGORIES = (
    ("TEST_CODE", r"(^|/)(tests?|fixtures|testing)(/|$)|(^|/)test_[^/]+\.py$|[^/]_test\.py$|conftest\.py$"),
    ("CONFIGURATION", r"(^|/)(setup\.py|setup\.cfg|pyproject\.toml|tox\.ini|makefile|gemfile|conf\.py|\.coveragerc|dockerfile|vagrantfile|\.git[^/]*|requirements[^/]*|[^/]*\.lock)$"),
    ("DOCUMENTATION", r"(^|/)(docs?|documentation)(/|$)|\.(md|rst|txt|adoc)$|(license|readme)[^/]*$"),
    ("GENERATED", r"(_pb2\.py|_pb2_grpc\.py|\.min\.js|\.min\.css)$|/(migrations|vendor|node_modules)/"),
    ("TOOLING", r"^(?!src/)(.*/)?(extras|scripts|tools|scratch|bin)(/|$)"),
    ("PRODUCTION_CODE", r"\.(py|js|ts|jsx|tsx)$"),
)
FORBIDS = r"(?:do not (?:modify|touch|change|break)|forbidden:?|never touch)\s+([a-z0-9_\-./]+)"
NEGATIVE, PATH_TOKEN = "do not|forbidden|never", r"([a-z0-9_\-.]+(?:/[a-z0-9_\-.]+)+)"
NO_TARGETS = ("any", "the", "all", "api")


def file_category(path: Column) -> Column:
    """One of ``CATEGORIES``, the first that fits; ``UNKNOWN`` where none does or there is no path."""
    norm = F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))))
    return K.first_match([(norm.rlike(pattern), name) for name, pattern in CATEGORIES], "UNKNOWN")


def file_role(path: Column, public: Column, *, commands: tuple[str, ...] = (), servers: tuple[str, ...] = (), tools: tuple[str, ...] = (), core: str = "core/", experiments: tuple[str, ...] = ("experimental",), scripts: str = "scratch/") -> Column:
    """A file's role by ordered rules; ``public`` tells whether it says what it exports, the rest are a project's own paths and prefixes.  Without a path it is ``INTERNAL``."""
    p = joined_path(F.lit(""), F.replace(path, F.lit("\\"), F.lit("/")))
    one_of = lambda paths: p.isin(*paths) if paths else F.lit(False)
    rules = [
        (F.endswith(p, F.lit("__init__.py")), "PACKAGE_INITIALIZER"),
        (p.rlike(r"tests/|^test_|_test\.py$|/test_"), "TEST"),
        (F.coalesce(public, F.lit(False)), "PUBLIC_MODULE"),
        (F.exists(F.array(*(F.lit(x) for x in experiments)), lambda x: F.contains(p, x)), "EXPERIMENTAL"),
        (one_of(commands), "CLI"),
        (one_of(servers), "SERVER"),
        (one_of(tools), "MCP_TOOL"),
        (F.startswith(p, F.lit(core)), "CORE_ENGINE"),
        (F.startswith(p, F.lit(scripts)), "SCRIPT"),
    ]
    return F.when(F.coalesce(path, F.lit("")) == "", "INTERNAL").otherwise(K.first_match(rules, "INTERNAL"))


# -- tests of a change


def _stem(path: str) -> Column:
    """A path's last part without its extension; leading dots begin none."""
    base = K.base_name(c(path))
    bare = F.regexp_extract(base, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(bare != "", bare).otherwise(base)


def affected_tests(affected: DataFrame, tests: DataFrame, imports: DataFrame) -> DataFrame:
    """(test, reason) of tests(path) that affected(path) asks for, given imports(path, name) of tests; ``reason`` is self, name or import, the first that holds.

    A name fits if a file's own name is all of the test's before ``_test``, or stands after an underscore and before another or the end; an
    ``__init__`` goes by its folder.  An import fits if it is a file's path, name or dotted name, or begins with a dotted one.  All that a test could
    ask for is listed under it, so that both are equi-joins.  Paths of null are none.
    """
    files = affected.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).dropna().distinct()
    known = tests.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).dropna().distinct()
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    stem = F.when(_stem("path") == "__init__", F.when(folder != "", folder).otherwise("init")).otherwise(_stem("path"))
    dotted = F.when(F.endswith("path", F.lit(".py")), F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")))
    files = materialize(files.select("path", stem.alias("stem"), dotted.alias("dotted")), "affected-files")
    itself = known.join(files, "path", "left_semi").select(c("path").alias("test"), F.lit(0).alias("rank"))

    parts = known.select("path", F.split(_stem("path"), "_").alias("p"))
    n = F.size("p")
    within = parts.where(n > 1).select("path", "p", F.explode(F.sequence(F.lit(2), n)).alias("i")).select("path", "p", "i", F.explode(F.sequence(F.lit(1), n - c("i") + 1)).alias("k"))
    within = within.select("path", F.array_join(F.slice("p", c("i"), c("k")), "_").alias("stem"))
    before = parts.where((n > 1) & (F.try_element_at("p", F.lit(-1)) == "test")).select("path", F.array_join(F.slice("p", F.lit(1), n - 1), "_").alias("stem"))
    stems = files.select("stem").where("stem <> ''").distinct()
    named = within.unionByName(before).join(stems, "stem", "left_semi").select(c("path").alias("test"), F.lit(1).alias("rank"))

    asked = imports.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "name").dropna().distinct().join(known, "path", "left_semi")
    cut = F.split("name", r"\.")
    keys = asked.select("path", cut.alias("p"), F.explode(F.sequence(F.lit(1), F.size(cut))).alias("k"))
    keys = keys.select("path", F.array_join(F.slice("p", F.lit(1), c("k")), ".").alias("key"), (c("k") == F.size("p")).alias("whole"))
    ids = files.select(F.explode(F.array_compact(F.array("path", "stem", "dotted"))).alias("key")).distinct()
    imported = keys.where(c("whole") | F.contains("key", F.lit("."))).join(ids, "key", "left_semi").select(c("path").alias("test"), F.lit(2).alias("rank"))
    first = itself.unionByName(named).unionByName(imported).groupBy("test").agg(F.min("rank").alias("rank"))
    return first.select("test", F.element_at(F.array(F.lit("self"), F.lit("name"), F.lit("import")), c("rank") + 1).alias("reason"))


# -- constraints


def forbidden_targets(text: Column) -> Column:
    """The distinct targets that a constraint forbids: what follows its negative phrases, and all paths in a text with a negative word."""
    low = F.lower(text)
    paths = F.when(low.rlike(NEGATIVE), F.regexp_extract_all(low, F.lit(PATH_TOKEN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.concat(F.regexp_extract_all(low, F.lit(FORBIDS), F.lit(1)), paths), lambda x: F.regexp_replace(x, "^[/.,; ]+|[/.,; ]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~x.isin(*NO_TARGETS)))


def boundary_hits(constraints: DataFrame, files: DataFrame, *, few: int = 64) -> DataFrame:
    """(key, path, target): the files(key, path) that constraints(key, text) of their key forbid, each once.

    A target fits a path that it is or that ends with it after a slash; with a slash in it, one that holds it; without, one that has
    it as a part, as a part's beginning before a dot, or within its last part.  The targets of a key go as one list to each of its files.  Of keys with more than ``few`` targets
    a path is listed under its pieces of three letters, a target under its first three, since all fits hold the target; what meets is verified.
    """
    # explode alone would ask first whether there is any, and read every text twice for that
    targets = constraints.select("key", F.explode_outer(forbidden_targets(c("text"))).alias("target")).dropna().distinct()
    targets = materialize(targets.withColumn("n", F.count("*").over(Window.partitionBy("key"))), "targets")
    norm = F.regexp_replace(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "^[./ ]+|[./ ]+$", "")
    f = files.select("key", "path").dropna()

    def hit(t: Column) -> Column:
        p = c("norm")
        parts = F.split(p, "/")
        single = F.array_contains(parts, t) | F.exists(parts, lambda x: F.startswith(x, F.concat(t, F.lit(".")))) | F.contains(K.base_name(p), t)
        return (p == t) | F.endswith(p, F.concat(F.lit("/"), t)) | F.when(F.contains(t, F.lit("/")), F.contains(p, t)).otherwise(single)

    # targets are as many as constraints, however small their compressed file: by its size Spark would broadcast them through the driver
    lists = targets.where(c("n") <= few).groupBy("key").agg(F.collect_list("target").alias("targets"))
    near = f.join(lists.hint("merge"), "key").withColumn("norm", norm)
    found = near.select("key", "path", F.explode_outer(F.filter("targets", hit)).alias("target")).dropna().distinct()
    many = targets.where(c("n") > few).select("key", "target", F.substring("target", 1, 3).alias("gram"))
    if many.isEmpty():
        return found
    f = f.distinct().join(many.select("key").distinct().hint("merge"), "key", "left_semi").withColumn("norm", norm).where("length(norm) >= 3")
    grams = f.select("key", "path", "norm", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("norm") - 2), lambda i: F.substr(c("norm"), i, F.lit(3))))).alias("gram"))
    return found.unionByName(grams.join(many.hint("merge"), ["key", "gram"]).where(hit(c("target"))).select("key", "path", "target"))


# -- queries

_FOLDERS = ("src", "tests", "docs", "scripts", "src/migrations", "vendor/lib", "app/testing", "lib/tools", "src/scripts", "core", "experimental", "scratch")
_BEFORE = ("m", "test_m", "t", "conftest.py#", "Setup.py#", "README", "notes.md#", "g", "v", "w", "yarn.lock#", "b", "__init__.py#")
_AFTER = (".py", ".py", "_test.py", "", "", "", "", "_pb2.py", ".min.js", ".ts", "", ".bin", "")


def _list_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_PATHS = f"(SELECT p_partkey, p_partkey % 7 = 0 AS public, {_list_sql(_FOLDERS)}[p_size % 12 + 1] || '/' || regexp_replace({_list_sql(_BEFORE)}[p_partkey % 13 + 1] || CAST(p_partkey AS VARCHAR) || {_list_sql(_AFTER)}[p_partkey % 13 + 1], '#.*$', '') AS path FROM part)"


def _paths(v: Views) -> DataFrame:
    """(p_partkey, public, path): every part as a file in one of twelve folders, named in one of thirteen ways."""
    pick = lambda values, at: F.element_at(F.array(*(F.lit(x) for x in values)), (at + 1).cast("int"))
    way = c("p_partkey") % 13
    name = F.regexp_replace(F.concat(pick(_BEFORE, way), c("p_partkey").cast("string"), pick(_AFTER, way)), "#.*$", "")
    return v.table("part").select("p_partkey", (c("p_partkey") % 7 == 0).alias("public"), F.concat(pick(_FOLDERS, c("p_size") % 12), F.lit("/"), name).alias("path"))


@operator("prj_filecategory", f"""
SELECT p_partkey, CASE WHEN regexp_matches(p, '(^|/)(tests?|fixtures|testing)(/|$)') OR regexp_matches(p, '(^|/)test_[^/]+\\.py$') OR regexp_matches(p, '[^/]+_test\\.py$') OR p LIKE '%conftest.py' THEN 'TEST_CODE'
  WHEN base = 'setup.py' OR base LIKE '%.lock' THEN 'CONFIGURATION' WHEN regexp_matches(p, '(^|/)(docs?|documentation)(/|$)') OR p LIKE '%.md' OR base LIKE '%readme%' THEN 'DOCUMENTATION'
  WHEN p LIKE '%_pb2.py' OR p LIKE '%.min.js' OR p LIKE '%/migrations/%' OR p LIKE '%/vendor/%' THEN 'GENERATED'
  WHEN regexp_matches(p, '(^|/)(extras|scripts|tools|scratch|bin)(/|$)') AND NOT p LIKE 'src/%' THEN 'TOOLING' WHEN p LIKE '%.py' OR p LIKE '%.ts' THEN 'PRODUCTION_CODE' ELSE 'UNKNOWN' END AS category
FROM (SELECT p_partkey, lower(path) AS p, string_split(lower(path), '/')[-1] AS base FROM {_PATHS} x) s""")
def prj_filecategory(v: Views) -> DataFrame:
    return _paths(v).select("p_partkey", file_category(c("path")).alias("category"))


@operator("prj_filerole", f"""
SELECT p_partkey, CASE WHEN path LIKE '%__init__.py' THEN 'PACKAGE_INITIALIZER' WHEN contains(path, 'tests/') OR contains(path, '/test_') OR path LIKE '%\\_test.py' ESCAPE '\\' THEN 'TEST' WHEN public THEN 'PUBLIC_MODULE'
  WHEN contains(path, 'experimental') THEN 'EXPERIMENTAL' WHEN path = 'src/README5' THEN 'CLI' WHEN path LIKE 'core/%' THEN 'CORE_ENGINE' WHEN path LIKE 'scratch/%' THEN 'SCRIPT' ELSE 'INTERNAL' END AS role FROM {_PATHS} x""")
def prj_filerole(v: Views) -> DataFrame:
    return _paths(v).select("p_partkey", file_role(c("path"), c("public"), commands=("src/README5",)).alias("role"))


@operator("joi_testselect", f"""
WITH a AS (SELECT DISTINCT path FROM touches WHERE ts >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 20 DAY),
t AS (SELECT p_partkey AS k, 'tests/' || ['test_mod_', 'mod_', 'unit_mod_', 'check'][p_partkey % 4 + 1] || CAST(p_partkey AS VARCHAR) || ['', '_test', '_flow', ''][p_partkey % 4 + 1] || '.py' AS test FROM part WHERE p_partkey % 3 = 0),
i AS (SELECT DISTINCT l_partkey AS k FROM {_ASKS} l JOIN a ON a.path = nxt WHERE l_suppkey % 4 <> 0)
SELECT test, CASE WHEN k % 4 <> 3 AND k IN (SELECT path FROM a) THEN 'name' ELSE 'import' END AS reason FROM t WHERE (k % 4 <> 3 AND k IN (SELECT path FROM a)) OR k IN (SELECT k FROM i)""")
def joi_testselect(v: Views) -> DataFrame:
    """Tests of the files of the last twenty days; a test is named after a part, and imports what its lines ask for."""
    last = v.table("orders").agg(F.max("o_orderdate").alias("last"))
    recent = v.touches.join(F.broadcast(last), c("ts") >= c("last") - F.expr("INTERVAL 20 DAYS")).select("path").distinct()  # one row
    key, way = c("p_partkey").cast("string"), (c("p_partkey") % 4 + 1).cast("int")
    pick = lambda *values: F.element_at(F.array(*(F.lit(x) for x in values)), way)
    tests = v.table("part").where("p_partkey % 3 = 0").select(c("p_partkey").alias("k"), F.concat(F.lit("tests/"), pick("test_mod_", "mod_", "unit_mod_", "check"), key, pick("", "_test", "_flow", ""), F.lit(".py")).alias("path"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # the few lines of one order
    asks = v.table("lineitem").select(c("l_partkey").alias("k"), c("l_suppkey").alias("supp"), c("l_linenumber").alias("line"), F.lead("l_partkey").over(order).alias("next")).dropna()
    name = F.concat(F.when(c("supp") % 4 == 0, "other").otherwise("pkg"), F.lit(".mod_"), c("next").cast("string"), F.when(c("line") % 2 == 0, ".run").otherwise(""))
    imports = asks.select("k", name.alias("name")).distinct().join(tests, "k").select("path", "name")
    return affected_tests(recent.select(F.concat(F.lit("pkg/mod_"), c("path").cast("string"), F.lit(".py")).alias("path")), tests, imports)


@operator("prj_boundaries", f"""
SELECT DISTINCT l_orderkey AS key, a.path, CASE WHEN l_orderkey % 3 = 0 THEN 'brand' || b ELSE 'brand' || b || '/m' || m END AS target
FROM lineitem JOIN {_FILES} a ON a.p_partkey = l_partkey JOIN (SELECT o_orderkey, CAST(11 + o_custkey % 15 AS VARCHAR) AS b, CAST(o_custkey % 10 AS VARCHAR) AS m FROM orders) o ON o_orderkey = l_orderkey
WHERE (l_orderkey % 3 = 0 AND lower(a.brand) = 'brand' || b) OR (l_orderkey % 3 = 1 AND contains(lower(a.path), 'brand' || b || '/m' || m))""")
def prj_boundaries(v: Views) -> DataFrame:
    """Files of orders that the orders' own constraints forbid: by a part of the path, by a piece with a slash; the third kind forbids nothing."""
    brand, m = (11 + c("o_custkey") % 15).cast("string"), (c("o_custkey") % 10).cast("string")
    text = (
        F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("Please do not modify Brand"), brand, F.lit(". Never touch the api!")))
        .when(c("o_orderkey") % 3 == 1, F.concat(F.lit("Forbidden: Brand"), brand, F.lit("/m"), m, F.lit(", and any other.")))
        .otherwise(F.concat(F.lit("Prefer small changes to src/Brand"), brand))
    )
    # parts grow with the tables, their paths are longer than their file tells
    files = v.table("lineitem").select(c("l_orderkey").alias("key"), c("l_partkey").alias("part")).join(script_files(v).hint("merge"), "part")
    return boundary_hits(v.table("orders").select(c("o_orderkey").alias("key"), text.alias("text")), files.select("key", "path"))
