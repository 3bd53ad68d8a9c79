"""Joins: prefix resolution, call resolution, run differences, range and anti joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import classify as K
from ..functions.text import glob
from ..store import materialize
from ..views import Views

c = F.col


def longest_prefix(imports: DataFrame, modules: DataFrame, *, separator: str = "/") -> DataFrame:
    """(importer, target) of ``imports(importer, name)`` in ``modules(module)``: the longest prefix that is a module.

    Every prefix of a name is a row, so it is an equi-join whatever the number of modules; an importer itself is no target.
    """
    parts = F.split("name", re.escape(separator))
    each = imports.select("importer", "name", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
    each = each.select("importer", "name", "n", F.array_join(F.slice("p", F.lit(1), c("n")), separator).alias("module"))
    best = each.join(modules, "module").groupBy("importer", "name").agg(F.max_by("module", "n").alias("target"))
    return best.where("importer <> target").select("importer", "target").distinct()


def first_suffix(names: DataFrame, modules: DataFrame, *, separator: str = ".") -> DataFrame:
    """(name, rank, target) of the distinct names(name): the first of modules(module, rank, target) that is the name or ends with it after a separator.

    Each module is listed under all its suffixes, the first under each being kept, so that the search is an equi-join.
    """
    parts = F.split("module", re.escape(separator))
    each = modules.select("rank", "target", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    each = each.select("rank", "target", F.array_join(F.slice("p", c("i"), F.size("p")), separator).alias("name"))
    listed = each.groupBy("name").agg(F.min(F.struct("rank", "target")).alias("first"))
    return names.select("name").distinct().join(listed, "name").select("name", "first.rank", "first.target")


def first_within(names: DataFrame, paths: DataFrame, *, gram: int = 4) -> DataFrame:
    """(name, rank, target) of the distinct names(name): the first of paths(path, rank, target) that the name is anywhere in.

    A path is listed under its substrings of ``gram`` letters, a name looks under the one of its own that the fewest paths have (shorter
    names under themselves), and what it finds is verified.
    """
    def grams(name: str, most: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - most + 1, F.lit(1))), lambda i: F.substr(c(name), i, most))
        return F.array_distinct(each)

    asked = names.select("name").where("name <> ''").distinct().withColumn("gram", F.explode(grams("name", F.least(F.length("name"), F.lit(gram)))))
    sizes = range(1, gram + 1)
    listed = paths.select("path", "rank", "target", F.explode(F.array_distinct(F.concat(*(grams("path", F.lit(n)) for n in sizes)))).alias("gram"))
    wanted = asked.select("gram").distinct()
    counted = materialize(listed.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    rarest = asked.join(counted, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("name", "g.gram")
    found = listed.join(rarest, "gram").where(F.contains("path", c("name")))
    return found.groupBy("name").agg(F.min(F.struct("rank", "target")).alias("first")).select("name", "first.rank", "first.target")


def resolve_imports(imports: DataFrame, files: DataFrame, *, inside: bool = True) -> DataFrame:
    """(importer, name, target) of imports(importer, name), dotted, among files(path, rank): paths with .py or without, in scan order ``rank``.

    The longest dotted prefix of a name that is a file's module is its target.  Where there is none, or it is the importer itself, it is the
    first file whose module is the name, ends with it after a dot or, if ``inside``, whose path holds the name with slashes; and nothing if that is the importer.
    """
    module = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    modules = materialize(files.select("path", "rank", module.alias("module")), "import-modules")
    names = materialize(imports.select("importer", "name").distinct(), "import-names")  # made once: it is asked six times
    at = modules.groupBy("module").agg(F.min_by("path", "rank").alias("target"))
    parts = F.split("name", r"\.")
    each = names.select("name").distinct().select("name", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    each = each.select("name", "n", F.array_join(F.slice("p", F.lit(1), c("n")), ".").alias("module"))
    longest = each.join(at, "module").groupBy("name").agg(F.max_by("target", "n").alias("target"))
    known = names.join(longest, "name", "left")
    done = known.where(c("target").isNotNull() & (c("target") != c("importer")))
    rest = known.where(c("target").isNull() | (c("target") == c("importer"))).select("importer", "name")
    found = first_suffix(rest, modules.select("module", "rank", c("path").alias("target")))
    if inside:
        asked = rest.select(F.replace("name", F.lit("."), F.lit("/")).alias("slashed"), "name").distinct()
        within = first_within(asked.select(c("slashed").alias("name")), modules.select("path", "rank", c("path").alias("target")))
        within = asked.join(within.withColumnRenamed("name", "slashed"), "slashed").select("name", "rank", "target")
        found = found.unionByName(within).groupBy("name").agg(F.min(F.struct("rank", "target")).alias("first")).select("name", "first.target")
    fallback = rest.join(found.select("name", "target"), "name").where(c("target") != c("importer"))
    return done.select("importer", "name", "target").unionByName(fallback.select("importer", "name", "target"))


#: Parts are source files: lib/<brand>/<words of the name>.py, in order of their keys; a part imports what the next line of an order has, by the last two, three or all parts of its module.
PART_FILES = """
  SELECT 'lib/' || lower(replace(p_brand, '#', '_')) || '/' || replace(p_name, ' ', '/') || '.py' AS path, min(p_partkey) AS rank FROM part GROUP BY 1"""
PART_IMPORTS = """
  SELECT DISTINCT importer, CASE size % 4 WHEN 0 THEN 'lib.' || brand || '.' || replace(next_name, ' ', '.') WHEN 1 THEN 'lib.' || brand || '.' || replace(next_name, ' ', '.') || '.run' WHEN 2 THEN replace(next_name, ' ', '.') ELSE substr(replace(next_name, ' ', '.'), 3) END AS name
  FROM (SELECT 'lib/' || lower(replace(p_brand, '#', '_')) || '/' || replace(p_name, ' ', '/') || '.py' AS importer, p_size AS size, lower(replace(lead(p_brand) OVER w, '#', '_')) AS brand, lead(p_name) OVER w AS next_name
        FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) s WHERE next_name IS NOT NULL"""


def part_files(v: Views) -> DataFrame:
    return v.table("part").groupBy(_part_path("p_brand", "p_name").alias("path")).agg(F.min("p_partkey").alias("rank"))


def _part_path(brand: str, name: str) -> Column:
    return F.concat(F.lit("lib/"), F.lower(F.replace(brand, F.lit("#"), F.lit("_"))), F.lit("/"), F.replace(name, F.lit(" "), F.lit("/")), F.lit(".py"))


def part_imports(v: Views) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # lines carry a number for each path, so that no text is sorted or shuffled with them
    parts = v.table("part").select("p_partkey", "p_brand", "p_name", (c("p_size") % 4).alias("kind"), F.min("p_partkey").over(Window.partitionBy("p_brand", "p_name")).alias("file"))
    parts = materialize(parts, "part-files")
    lines = v.table("lineitem").join(parts.select("p_partkey", "file", "kind"), c("p_partkey") == c("l_partkey"))
    lines = lines.select("file", "kind", F.lead("file").over(order).alias("next")).where("next is not null").distinct()
    named = parts.select("file", "p_brand", "p_name").distinct()
    lines = lines.join(named.select("file", _part_path("p_brand", "p_name").alias("importer")), "file").join(named.withColumnRenamed("file", "next"), "next")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    whole = F.concat(F.lit("lib."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("."), dotted)
    kind = c("kind")
    name = F.when(kind == 0, whole).when(kind == 1, F.concat(whole, F.lit(".run"))).when(kind == 2, dotted).otherwise(F.substr(dotted, F.lit(3)))
    return lines.select("importer", name.alias("name")).distinct()


_IMPORT_SQL = """
WITH f AS (SELECT path, rank, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM (%s) x), i AS (%s),
p AS (SELECT DISTINCT i.name, list(f.path ORDER BY len(string_split(f.module, '.')) DESC, f.rank)[1] AS target FROM (SELECT DISTINCT name FROM i) i JOIN f ON i.name = f.module OR starts_with(i.name, f.module || '.') GROUP BY i.name),
b AS (SELECT i.name, arg_min(f.path, f.rank) AS target FROM (SELECT DISTINCT name FROM i) i JOIN f ON f.module = i.name OR ends_with(f.module, '.' || i.name)%s GROUP BY i.name)
SELECT i.importer, i.name, CASE WHEN p.target <> i.importer THEN p.target ELSE b.target END AS target FROM i LEFT JOIN p USING (name) LEFT JOIN b USING (name) WHERE CASE WHEN p.target <> i.importer THEN p.target ELSE b.target END <> i.importer"""


@operator("joi_import", _IMPORT_SQL % (PART_FILES, PART_IMPORTS, " OR contains(f.path, replace(i.name, '.', '/'))"))
def joi_import(v: Views) -> DataFrame:
    """Imports by the longest prefix that is a module, then by the first file in scan order that ends with the name or holds it."""
    return resolve_imports(part_imports(v), part_files(v))


@operator("joi_import_exact", _IMPORT_SQL % (PART_FILES, PART_IMPORTS, ""))
def joi_import_exact(v: Views) -> DataFrame:
    """The same without names that stand anywhere in a path."""
    return resolve_imports(part_imports(v), part_files(v), inside=False)


@operator("joi_import_suffix", """
WITH f AS (SELECT path, row_number() OVER (ORDER BY path) AS rank, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM (%s) x), i AS (%s)
SELECT i.importer, i.name, b.target FROM i JOIN (SELECT n.name, arg_min(f.path, f.rank) AS target FROM (SELECT DISTINCT name FROM i) n JOIN f ON f.module = n.name OR ends_with(f.module, '.' || n.name) GROUP BY n.name) b USING (name)""" % (PART_FILES, PART_IMPORTS))
def joi_import_suffix(v: Views) -> DataFrame:
    """The first module by path that a name ends with; names begin at dots."""
    files = part_files(v)
    module = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    names = materialize(part_imports(v), "imports")
    found = first_suffix(names, files.select(module.alias("module"), c("path").alias("rank"), c("path").alias("target")))
    return names.join(found, "name").select("importer", "name", "target")


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, target) of the distinct calls(file, name): where definitions(file, name) has what a call means.

    A definition in the caller's own file comes first.  Else it is the first file, by name, that defines the name and that
    one of the caller's imports(file, import) speaks for: the import is the name, or ends with it; is the file's base name or module,
    or something inside of it; or holds a base name of more than three letters.  Other calls have no row.
    """
    calls, definitions = calls.select("file", "name").distinct(), definitions.select("file", "name").distinct()
    local = calls.join(definitions, ["file", "name"], "left_semi").select("file", "name", c("file").alias("target"))
    bare = F.regexp_replace("target", r"\.py$", "")
    module, base = F.replace(bare, F.lit("/"), F.lit(".")), F.element_at(F.split(bare, "/"), -1)
    candidates = definitions.select(c("file").alias("target"), "name", module.alias("module"), base.alias("base"))
    rest = calls.join(local, ["file", "name"], "left_anti").join(candidates, "name")
    i = c("import")
    speaks = (
        (i == c("name")) | F.endswith(i, F.concat(F.lit("."), "name")) | (i == c("base")) | F.startswith(i, F.concat("base", F.lit(".")))
        | (i == c("module")) | F.startswith(i, F.concat("module", F.lit("."))) | ((F.length("base") > 3) & F.contains(i, c("base")))
    )
    found = rest.join(imports.select("file", "import").distinct(), "file").where(speaks).groupBy("file", "name").agg(F.min("target").alias("target"))
    return local.unionByName(found)


@operator("joi_call", """
WITH l AS (SELECT l_orderkey AS k, lower(replace(p_brand, '#', '_')) AS brand, p_type AS type, p_size AS size, lead(lower(replace(p_brand, '#', '_'))) OVER w AS next_brand, lead(p_type) OVER w AS next_type, lead(p_size) OVER w AS next_size
  FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
d AS (SELECT DISTINCT 'lib/' || lower(replace(p_brand, '#', '_')) || '.py' AS file, p_type AS name, 'lib.' || lower(replace(p_brand, '#', '_')) AS module, lower(replace(p_brand, '#', '_')) AS base FROM part WHERE p_size <= 3),
x AS (SELECT DISTINCT 'lib/' || brand || '.py' AS file, next_type AS name FROM l WHERE next_type IS NOT NULL),
m AS (SELECT DISTINCT 'lib/' || brand || '.py' AS file, 'lib.' || next_brand AS import FROM l WHERE size = next_size AND size <= 10),
r AS (SELECT x.file, x.name, min(d.file) AS target FROM x JOIN d ON d.name = x.name JOIN m ON m.file = x.file
  WHERE (m.import = d.name OR m.import LIKE '%.' || d.name OR m.import = d.base OR starts_with(m.import, d.base || '.') OR m.import = d.module OR starts_with(m.import, d.module || '.') OR (length(d.base) > 3 AND contains(m.import, d.base)))
  AND NOT EXISTS (SELECT 1 FROM d o WHERE o.file = x.file AND o.name = x.name) GROUP BY 1, 2)
SELECT file, name, target FROM r UNION ALL SELECT x.file, x.name, x.file FROM x WHERE EXISTS (SELECT 1 FROM d o WHERE o.file = x.file AND o.name = x.name)""")
def joi_call(v: Views) -> DataFrame:
    """Packages are files, part types the names that they define and call; lines of files of one size that follow each other are imports."""
    file = lambda brand: F.concat(F.lit("lib/"), F.lower(F.replace(brand, F.lit("#"), F.lit("_"))), F.lit(".py"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = v.table("part")
    lines = v.table("lineitem").join(parts, c("p_partkey") == c("l_partkey"))
    after = F.lead(F.struct("p_brand", "p_type", "p_size")).over(order)
    lines = lines.select("p_brand", "p_size", after.alias("after")).where("after is not null").groupBy("p_brand", "p_size", "after").count()
    lines = materialize(lines.select(file(c("p_brand")).alias("file"), "p_size", "after"), "call-lines")
    calls = lines.select("file", c("after.p_type").alias("name"))
    imported = F.concat(F.lit("lib."), F.lower(F.replace("after.p_brand", F.lit("#"), F.lit("_"))))
    imports = lines.where("p_size = after.p_size and p_size <= 10").select("file", imported.alias("import"))
    return resolve_calls(calls, parts.where("p_size <= 3").select(file(c("p_brand")).alias("file"), c("p_type").alias("name")), imports)


@operator("joi_callers", """
SELECT a.dst AS callee, count(DISTINCT b.dst) AS downstream FROM links a JOIN links b ON b.src = a.dst AND b.dst <> a.dst GROUP BY a.dst""")
def joi_callers(v: Views) -> DataFrame:
    called = v.links.select(c("dst").alias("callee")).distinct()
    down = v.links.where("src <> dst").groupBy(c("src").alias("callee")).agg(F.countDistinct("dst").alias("downstream"))
    return called.join(down, "callee")


@operator("joi_delta", """
SELECT b.path, b.name, b.value - coalesce(a.value, 0.0) AS delta, a.value IS NULL AS is_new,
  CASE WHEN a.value IS NULL THEN 'NEW' WHEN b.value > a.value THEN 'WORSE' WHEN b.value < a.value THEN 'BETTER' ELSE 'SAME' END AS status
FROM run_metrics b LEFT JOIN run_metrics a ON a.path = b.path AND a.name = b.name AND a.run_id = 1999 WHERE b.run_id = 2000 AND b.name <> 'hotspot_score'""")
def joi_delta(v: Views) -> DataFrame:
    m = v.within(1999, 2000).run_metrics.where("name <> 'hotspot_score'")
    base = m.where("run_id = 1999").select("path", "name", c("value").alias("old"))
    j = m.where("run_id = 2000").join(base, ["path", "name"], "left")
    status = F.when(c("old").isNull(), "NEW").when(c("value") > c("old"), "WORSE").when(c("value") < c("old"), "BETTER").otherwise("SAME")
    return j.select("path", "name", (c("value") - F.coalesce("old", F.lit(0.0))).alias("delta"), c("old").isNull().alias("is_new"), status.alias("status"))


def run_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, kind, delta) between two runs' (path, name, value); what is missing counts as 0."""
    j = old.withColumnRenamed("value", "a").join(new.withColumnRenamed("value", "b"), ["path", "name"], "full_outer")
    kind = F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").when(c("b") > c("a"), "increased").when(c("b") < c("a"), "decreased").otherwise("same")
    return j.select("path", "name", kind.alias("kind"), F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4).alias("delta"))


def run_changes(files: DataFrame, metrics: DataFrame, violations: DataFrame, old: int, new: int) -> DataFrame:
    """(what, name, kind, delta): all that differs between two runs, in one pass over both.

    Files and dependencies of files(run_id, path, dep), metrics(run_id, path, name, value), and violations(run_id, rule, path)
    are added or removed; what is missing counts as 0.
    """
    one = F.lit(1.0).alias("value")
    each = [
        files.select("run_id", F.lit("file").alias("what"), c("path").cast("string").alias("name"), one),
        files.select("run_id", F.lit("dependency"), F.concat_ws("->", c("path").cast("string"), c("dep").cast("string")), one),
        violations.select("run_id", F.lit("violation"), F.concat_ws(":", "rule", c("path").cast("string")), one),
        metrics.select("run_id", F.lit("metric"), F.concat_ws(":", c("path").cast("string"), "name"), "value"),
    ]
    rows = each[0].union(each[1]).union(each[2]).union(each[3])
    a, b = (F.max(F.when(c("run_id") == r, c("value"))).alias(n) for r, n in ((old, "a"), (new, "b")))
    kind = F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").when(c("b") > c("a"), "increased").when(c("b") < c("a"), "decreased")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4)
    both = rows.where(c("run_id").isin(old, new)).groupBy("what", "name").agg(a, b)
    return both.select("what", "name", kind.alias("kind"), delta.alias("delta")).where("kind is not null")


@operator("joi_rundiff", """
WITH f AS (SELECT DISTINCT run_id, path, dep FROM run_files WHERE run_id IN (2000, 2001)), m AS (SELECT * FROM run_metrics WHERE run_id IN (2000, 2001)),
r AS (SELECT DISTINCT run_id, 'file' AS what, path AS name, 1e0 AS value FROM f UNION ALL SELECT run_id, 'dependency', path || '->' || CAST(dep AS VARCHAR), 1e0 FROM f
  UNION ALL SELECT run_id, 'violation', 'max-complexity:' || path, 1e0 FROM m WHERE name = 'complexity' AND value > 300 UNION ALL SELECT run_id, 'metric', path || ':' || name, value FROM m),
d AS (SELECT coalesce(a.what, b.what) AS what, coalesce(a.name, b.name) AS name, a.value AS x, b.value AS y
  FROM (SELECT * FROM r WHERE run_id = 2000) a FULL JOIN (SELECT * FROM r WHERE run_id = 2001) b ON a.what = b.what AND a.name = b.name)
SELECT what, name, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN y > x THEN 'increased' ELSE 'decreased' END AS kind, round(coalesce(y, 0) - coalesce(x, 0), 4) AS delta
FROM d WHERE x IS DISTINCT FROM y""")
def joi_rundiff(v: Views) -> DataFrame:
    """Files, dependencies, metrics and violations of one run against those of the run before."""
    two = v.within(2000, 2001)
    over = two.run_metrics.where("name = 'complexity' and value > 300").select("run_id", F.lit("max-complexity").alias("rule"), "path")
    return run_changes(two.run_files, two.run_metrics, over, 2000, 2001)


@operator("joi_modeldiff", """
SELECT count(*) FILTER (a.path IS NULL OR b.path IS NULL) AS changed_nodes, (SELECT count(*) FROM (
    (SELECT DISTINCT path, dep FROM run_files WHERE run_id = 2000 EXCEPT SELECT DISTINCT path, dep FROM run_files WHERE run_id = 2001) UNION ALL
    (SELECT DISTINCT path, dep FROM run_files WHERE run_id = 2001 EXCEPT SELECT DISTINCT path, dep FROM run_files WHERE run_id = 2000)) e) AS changed_edges,
  round(1e-1 * sum(abs(coalesce(b.n, 0) - coalesce(a.n, 0))), 4) AS size_change
FROM (SELECT path, count(*) AS n FROM run_files WHERE run_id = 2000 GROUP BY path) a FULL JOIN (SELECT path, count(*) AS n FROM run_files WHERE run_id = 2001 GROUP BY path) b ON a.path = b.path""")
def joi_modeldiff(v: Views) -> DataFrame:
    r = v.within(2000, 2001).run_files
    n = [F.count_if(c("run_id") == y) for y in (2000, 2001)]
    nodes = r.groupBy("path").agg(n[0].alias("a"), n[1].alias("b")).agg(
        F.count_if((c("a") == 0) | (c("b") == 0)).alias("changed_nodes"), F.round(0.1 * F.sum(F.abs(c("b") - c("a"))), 4).alias("size_change")
    )
    edges = r.groupBy("path", "dep").agg(F.countDistinct("run_id").alias("runs")).agg(F.count_if(c("runs") == 1).alias("changed_edges"))
    return nodes.join(edges).select("changed_nodes", "changed_edges", "size_change")  # one row with one row


@operator("joi_viol", """
SELECT r.rule, m.path, m.run_id, m.value, r.top FROM run_metrics m JOIN (VALUES ('max-complexity', 'complexity', 300e0), ('max-coupling', 'coupling', 99e0)) r(rule, name, top) ON r.name = m.name WHERE m.value > r.top""")
def joi_viol(v: Views) -> DataFrame:
    rules = v.spark.createDataFrame([("max-complexity", "complexity", 300.0), ("max-coupling", "coupling", 99.0)], "rule string, name string, top double")
    return v.run_metrics.join(F.broadcast(rules), "name").where("value > top").select("rule", "path", "run_id", "value", "top")  # rules are a constant


@operator("joi_reco", """
SELECT p.p_partkey, coalesce(c.fixes, 0) AS fixes, coalesce(m.package, 'none') AS package FROM part p LEFT JOIN churn c ON c.path = p.p_partkey LEFT JOIN modules m ON m.path = p.p_partkey AND m.complexity > 25""")
def joi_reco(v: Views) -> DataFrame:
    m = v.modules.where("complexity > 25").select(c("path").alias("p_partkey"), "package")
    n = v.churn.select(c("path").alias("p_partkey"), "fixes")
    j = v.table("part").select("p_partkey").join(n, "p_partkey", "left").join(m, "p_partkey", "left")
    return j.select("p_partkey", F.coalesce("fixes", F.lit(0)).alias("fixes"), F.coalesce("package", F.lit("none")).alias("package"))


@operator("joi_brief", """
SELECT path, package, complexity FROM modules JOIN part ON p_partkey = path WHERE p_size > 10 ORDER BY complexity DESC, path LIMIT 5""")
def joi_brief(v: Views) -> DataFrame:
    big = v.table("part").where("p_size > 10").select(c("p_partkey").alias("path"))
    return v.modules.join(big, "path").select("path", "package", "complexity").orderBy(F.desc("complexity"), "path").limit(5)


@operator("joi_lineage", "SELECT l_orderkey, l_linenumber, l_partkey, c_nationkey, n_regionkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def joi_lineage(v: Views) -> DataFrame:
    j = v.table("lineitem").join(v.table("orders"), c("o_orderkey") == c("l_orderkey")).join(v.table("customer"), c("c_custkey") == c("o_custkey"))
    return j.join(v.table("nation"), c("n_nationkey") == c("c_nationkey")).select("l_orderkey", "l_linenumber", "l_partkey", "c_nationkey", "n_regionkey")


@operator("joi_chain", """
SELECT c_custkey, count(DISTINCT o_orderkey) AS facts, count(l_partkey) AS interpretations, round(coalesce(sum(l_extendedprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def joi_chain(v: Views) -> DataFrame:
    """Lines are summed for each order, orders for each customer: every level before its join."""
    lines = v.table("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("n"), F.sum("l_extendedprice").alias("s"))
    orders = v.table("orders").join(lines, "o_orderkey", "left").groupBy(c("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("interpretations"), F.sum("s").alias("total")
    )
    j = v.table("customer").select("c_custkey").join(orders, "c_custkey", "left")
    return j.select("c_custkey", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("facts", "interpretations")), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@operator("joi_lookup", """
SELECT p.page_id, coalesce(a.first_id, b.first_id) AS found, a.first_id IS NOT NULL AS exact FROM paths p
LEFT JOIN (SELECT path, min(page_id) AS first_id FROM paths WHERE page_id % 2 = 0 GROUP BY path) a ON a.path = p.path
LEFT JOIN (SELECT string_split(path, '/')[-1] AS leaf, min(page_id) AS first_id FROM paths WHERE page_id % 2 = 0 GROUP BY 1) b ON b.leaf = string_split(p.path, '/')[-1]""")
def joi_lookup(v: Views) -> DataFrame:
    """By the whole path, else by its last part."""
    known = v.paths.where(c("page_id") % 2 == 0)
    a = known.groupBy("path").agg(F.min("page_id").alias("whole"))
    b = known.groupBy(K.base_name(c("path")).alias("leaf")).agg(F.min("page_id").alias("last"))
    j = v.paths.withColumn("leaf", K.base_name(c("path"))).join(a, "path", "left").join(b, "leaf", "left")
    return j.select("page_id", F.coalesce("whole", "last").alias("found"), c("whole").isNotNull().alias("exact"))


@operator("joi_mkr", """
SELECT p.path, coalesce(k.kill_rate, 1.0) AS kill_rate FROM modules p LEFT JOIN (SELECT o_custkey, round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE)/count(*), 6) AS kill_rate FROM orders GROUP BY o_custkey) k ON k.o_custkey = p.path""")
def joi_mkr(v: Views) -> DataFrame:
    k = v.table("orders").groupBy(c("o_custkey").alias("path")).agg(F.round(F.count_if(c("o_orderstatus") == "F") / F.count("*"), 6).alias("kill_rate"))
    return v.modules.select("path").join(k, "path", "left").select("path", F.coalesce("kill_rate", F.lit(1.0)).alias("kill_rate"))


@operator("joi_contract", "SELECT c.caller, c.name, c.argc FROM calls c JOIN signatures s ON s.name = c.name WHERE NOT (c.argc BETWEEN s.min_args AND s.max_args)")
def joi_contract(v: Views) -> DataFrame:
    return v.calls.join(v.signatures, "name").where(~c("argc").between(c("min_args"), c("max_args"))).select("caller", "name", "argc")


@operator("joi_testmap", """
SELECT DISTINCT e.src AS tested, t.id AS test FROM edges e JOIN nodes t ON t.id = e.dst AND t.domain % 5 = 0 UNION SELECT n.id, m.id FROM nodes n JOIN nodes m ON m.domain = n.domain AND m.id <> n.id AND m.domain % 5 = 0""")
def joi_testmap(v: Views) -> DataFrame:
    return tests_of(v.edges, v.nodes.select("id", "domain"), c("domain") % 5 == 0)


def tests_of(edges: DataFrame, nodes: DataFrame, is_test: Column, *, shares: int = 64) -> DataFrame:
    """(tested, test): the tests among nodes(id, domain) that a node depends on by edges(src, dst), and those of its domain; itself only if it depends on itself.

    Pairs of a domain are as many as their number asks for: a domain is cut into ``shares`` of its nodes, each of which meets its tests by itself, and no pair is
    made twice, so that none is held to be told from others.
    """
    # a node has one domain; of one that is listed in several, a pair counts in the least that both have
    nodes = nodes.where("domain is not null").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("domain", is_test.alias("is_test")))).alias("d"))
    nodes = materialize(nodes.where("id is not null"), "test-nodes")
    tests = nodes.select(c("id").alias("test"), F.transform(F.filter("d", lambda x: x["is_test"]), lambda x: x["domain"]).alias("of")).where(F.size("of") > 0)
    tested = nodes.select(c("id").alias("tested"), F.transform("d", lambda x: x["domain"]).alias("domains"))
    left = tested.withColumn("domain", F.explode("domains")).withColumn("share", F.pmod(F.xxhash64("tested"), F.lit(shares)))
    right = tests.withColumn("domain", F.explode("of")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    least = (F.size("domains") == 1) | (F.array_min(F.array_intersect("domains", "of")) == c("domain"))
    named = left.join(right, ["domain", "share"]).where((c("tested") != c("test")) & least).select("tested", "test")
    linked = edges.select(c("src").alias("tested"), c("dst").alias("test")).distinct().join(tests, "test").join(tested, "tested", "left")
    apart = (c("tested") == c("test")) | ~F.coalesce(F.arrays_overlap("domains", "of"), F.lit(False))
    return linked.where(apart).select("tested", "test").unionByName(named)


def layer_violations(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``files(path, dep, ...)`` with each (rule, source, target) whose shell patterns match both ends; rules are few, so they are conditions of one pass."""
    hit = F.array_compact(F.array(*(F.when(glob(c("path"), source) & glob(c("dep"), target), rule) for rule, source, target in rules)))
    return files.withColumn("rule", F.explode(hit))


@operator("joi_layer", """
SELECT run_id, path, rule, dep, count(*) AS n FROM (SELECT run_id, layer || '/' || path AS path, 'module/' || CAST(dep AS VARCHAR) AS dep FROM run_files) f
JOIN (VALUES ('economy', 'ECO%', 'module/%7'), ('small', 'SMALL%/Brand#1_', 'module/%3')) r(rule, source, target) ON path LIKE source AND dep LIKE target GROUP BY 1, 2, 3, 4""")
def joi_layer(v: Views) -> DataFrame:
    files = v.run_files.select("run_id", F.concat_ws("/", "layer", "path").alias("path"), F.concat(F.lit("module/"), c("dep").cast("string")).alias("dep"))
    hits = layer_violations(files, [("economy", "ECO*", "module/*7"), ("small", "SMALL*/Brand#1?", "module/*3")])
    return hits.groupBy("run_id", "path", "rule", "dep").agg(F.count("*").alias("n"))


def forbidden(edges: DataFrame, names: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, src, dst): the edges(src, dst) whose ends' names(id, name) both match a rule's patterns, without regard to case.

    Names are matched once each, not for every edge.
    """
    def matching(at: int, end: str) -> DataFrame:
        hit = F.array_compact(F.array(*(F.when(c("name").rlike("(?i)" + r[at]), r[0]) for r in rules)))
        return names.select(c("id").alias(end), hit.alias(f"{end}_rules")).where(F.size(f"{end}_rules") > 0)

    ends = edges.select("src", "dst").distinct().join(matching(1, "src"), "src").join(matching(2, "dst"), "dst")
    return ends.select(F.explode(F.array_intersect("src_rules", "dst_rules")).alias("rule"), "src", "dst")


@operator("joi_forbidden", """
WITH n AS (SELECT id, 'r' || CAST(region AS VARCHAR) || '/d' || CAST(domain AS VARCHAR) || '/s' || CAST(id AS VARCHAR) AS name FROM nodes)
SELECT rule, src, dst FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst JOIN (VALUES ('down', '^r[01]/', '^r[34]/'), ('into', '.', '/d7/')) r(rule, source, target) ON regexp_matches(a.name, source) AND regexp_matches(b.name, target)""")
def joi_forbidden(v: Views) -> DataFrame:
    name = F.concat(F.lit("r"), c("region").cast("string"), F.lit("/d"), c("domain").cast("string"), F.lit("/s"), c("id").cast("string"))
    return forbidden(v.edges, v.nodes.select("id", name.alias("name")), [("down", "^R[01]/", "^R[34]/"), ("into", ".", "/D7/")])


#: Beyond so many letters a word is keyed by its pieces, whose number does not grow with it.
_DELETABLE = 32


def _neighbourhood(word: Column, edits: int) -> Column:
    """A word without up to ``edits`` of its letters, all ways: two words within so many edits have one of these in common."""
    def shorter(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array(F.lit("")))

    every = F.array(word)
    for _ in range(edits):
        every = F.array_distinct(F.concat(every, F.flatten(F.transform(every, shorter))))
    return every


def _pieces(word: Column, length: Column, edits: int, shifts: range) -> Column:
    """A word of ``length`` letters in edits + 1 pieces of even length; ``shifts`` moves where they are looked for."""
    n = edits + 1
    out = []
    for i in range(n):
        start, size = F.floor(length * i / n).cast("int"), (F.floor(length * (i + 1) / n) - F.floor(length * i / n)).cast("int")
        out += [F.concat_ws(":", length.cast("string"), F.lit(str(i)), F.substr(word, start + 1 + s, size)) for s in shifts]
    return F.array(*out)


def within_edits(words: DataFrame, known: DataFrame, *, edits: int = 2) -> DataFrame:
    """(w, v, distance) of words(w) and other known(v) that are at most ``edits`` apart; none is missed, and no two are compared that share no key.

    Words of up to 32 letters are keyed by what is left of them without some letters.  Longer ones have at least one of their edits + 1 pieces in common with any
    neighbour, moved by as many places; both kinds of keys are made where lengths are near that limit.
    """
    def keyed(df: DataFrame, name: str, long_keys: Column) -> DataFrame:
        short = F.when(F.length(name) <= _DELETABLE + edits, F.transform(_neighbourhood(c(name), edits), lambda x: F.xxhash64(x, F.lit("short")))).otherwise(F.array().cast("array<bigint>"))
        long = F.when(F.length(name) > _DELETABLE - edits, F.transform(long_keys, lambda x: F.xxhash64(x, F.lit("long")))).otherwise(F.array().cast("array<bigint>"))
        return df.select(name).distinct().withColumn("key", F.explode(F.array_distinct(F.concat(short, long))))

    asked = F.flatten(F.array(*(_pieces(c("w"), F.length("w") + d, edits, range(-edits, edits + 1)) for d in range(-edits, edits + 1))))
    pairs = keyed(words, "w", asked).join(keyed(known, "v", _pieces(c("v"), F.length("v"), edits, range(1))), "key").where("w <> v").select("w", "v").distinct()
    return pairs.withColumn("distance", F.levenshtein("w", "v", edits)).where("distance >= 0")


@operator("joi_typo", """
WITH w AS (SELECT * FROM (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) a WHERE regexp_full_match(w, '[!-~]+'))
SELECT item_id, w, arg_min(v, CAST(d AS VARCHAR) || v) AS fix, min(d) AS distance FROM (
  SELECT q.item_id, q.w, k.v, levenshtein(q.w, k.v) AS d FROM w q JOIN (SELECT DISTINCT w AS v FROM w) k ON abs(length(k.v) - length(q.w)) <= 2 AND k.v <> q.w) s
WHERE d <= 2 AND 4 * d <= greatest(length(w), length(v)) GROUP BY item_id, w""")
def joi_typo(v: Views) -> DataFrame:
    """The nearest other known word of those in ASCII, at most two edits and a quarter of the letters away."""
    words = v.table("benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).where(c("w").rlike("^[!-~]+$")).distinct()
    near = within_edits(words.select("w"), words.select(c("w").alias("v"))).where(4 * c("distance") <= F.greatest(F.length("w"), F.length("v")))
    best = near.groupBy("w").agg(F.min_by("v", F.struct("distance", "v")).alias("fix"), F.min("distance").cast("long").alias("distance"))
    return words.join(best, "w").select("item_id", "w", "fix", "distance")


@operator("joi_regression", r"""
SELECT DISTINCT p.page_id FROM paths p JOIN (SELECT DISTINCT sha256(m) AS h FROM (SELECT unnest([path, lower(path), './' || path, string_split(path, '/')[-1]]) AS m FROM paths WHERE page_id % 3 = 0) f) k
ON k.h IN (sha256(p.path), sha256(string_split(p.path, '/')[-1]))""")
def joi_regression(v: Views) -> DataFrame:
    """Pages whose path, or its last part, is a way to write the path of a fixed one."""
    def digest(x):
        return F.sha2(x.cast("binary"), 256)

    path = c("path")
    ways = F.array(path, F.lower(path), F.concat(F.lit("./"), path), K.base_name(path))
    fixed = v.paths.where(c("page_id") % 3 == 0).select(F.explode(ways).alias("m")).select(digest(c("m")).alias("h")).distinct()
    asked = v.paths.select("page_id", F.explode(F.array(digest(path), digest(K.base_name(path)))).alias("h"))
    return asked.join(fixed, "h", "left_semi").select("page_id").distinct()


@operator("joi_lineoverlap", """
WITH r AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + CAST(floor(value * value) AS BIGINT) AS fin, event_id AS id FROM events WHERE event_type = 'view'),
p AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type = 'purchase')
SELECT key AS user_id, id AS event_id FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.key = r.key AND p.at BETWEEN r.start AND r.fin)""")
def joi_lineoverlap(v: Views) -> DataFrame:
    """Functions, of any length, that hold a changed line: here ranges of views that hold a purchase."""
    from .intervals import touched
    from .windows import class_ranges

    changed = v.table("events").where("event_type = 'purchase'").select(c("user_id").alias("key"), F.unix_seconds(c("ts").cast("timestamp")).alias("at"))
    return touched(class_ranges(v, "view"), changed).select(c("key").alias("user_id"), c("id").alias("event_id"))


@operator("joi_blockdiff", """
SELECT coalesce(a.path, b.path) AS path, coalesce(a.layer, b.layer) AS block, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT path, layer, count(*) AS n FROM run_files WHERE run_id = 1995 GROUP BY 1, 2) a FULL JOIN (SELECT path, layer, count(*) AS n FROM run_files WHERE run_id = 1996 GROUP BY 1, 2) b ON a.path = b.path AND a.layer = b.layer""")
def joi_blockdiff(v: Views) -> DataFrame:
    # both runs in one pass
    n = [F.count_if(c("run_id") == year) for year in (1995, 1996)]
    return v.within(1995, 1996).run_files.groupBy("path", c("layer").alias("block")).agg((n[1] - n[0]).alias("delta"))


def part_calls(v: Views) -> DataFrame:
    """(src, dst) of parts: one calls the other where their lines follow each other in an order and they are of one size."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = v.table("lineitem").join(v.table("part").select("p_partkey", "p_size"), c("p_partkey") == c("l_partkey"))
    steps = lines.select(c("l_partkey").alias("src"), c("p_size").alias("size"), F.lead("l_partkey").over(order).alias("dst"), F.lead("p_size").over(order).alias("next_size"))
    return steps.where("dst is not null and size = next_size").select("src", "dst").distinct()


PART_CALLS = """
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, p_size AS size, lead(l_partkey) OVER w AS dst, lead(p_size) OVER w AS next_size FROM lineitem JOIN part ON p_partkey = l_partkey
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) s WHERE dst IS NOT NULL AND size = next_size"""


@operator("joi_testpredict", f"""
WITH RECURSIVE called AS ({PART_CALLS}),
affected(change, id) AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT), p_partkey FROM part UNION SELECT a.change, k.src FROM affected a JOIN called k ON k.dst = a.id)
SELECT DISTINCT 'Brand#' || CAST(change AS VARCHAR) AS change, k.src AS test FROM affected a JOIN called k ON k.dst = a.id JOIN part ON p_partkey = k.src AND p_type = 'PROMO'""")
def joi_testpredict(v: Views) -> DataFrame:
    """Brands are change sets, promoted parts tests: those that call what a change affects, through however many callers."""
    from .graph import predicted_tests

    part = v.table("part")
    number = F.substring("p_brand", 7, 10).cast("long")
    out = predicted_tests(part_calls(v), part.select(number.alias("change"), c("p_partkey").alias("id")), part.where("p_type = 'PROMO'").select(c("p_partkey").alias("test")))
    return out.select(F.concat(F.lit("Brand#"), c("change").cast("string")).alias("change"), "test")
