"""Queries over script source that Spark writes from the tables: a part is a file, the lines of orders say what it imports.

A supplier is a Go file of its nation's package, with the libraries and functions that its lines ask for.
A line imports the part of its order's next line, in one of seven forms by its number, under one of five kinds of specifier by its supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..store import materialize
from ..views import Views
from . import polyglot
from . import script_text as S

c = F.col
_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")

_FILES = """(SELECT p_partkey, replace(p_brand, '#', '') AS brand, 'src/' || replace(p_brand, '#', '') || '/m' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN '/index' ELSE '' END
  || ['.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs'][p_partkey % 6 + 1] AS path FROM part)"""
_ASKS = "(SELECT l_partkey, l_suppkey, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem)"


def _path(part: Column, brand: Column) -> Column:
    ext = F.element_at(F.array(*(F.lit(x) for x in _EXTENSIONS)), (part % 6 + 1).cast("int"))
    return F.concat(F.lit("src/"), brand, F.lit("/m"), part.cast("string"), F.when(part % 4 == 0, "/index").otherwise(""), ext)


def script_files(v: Views) -> DataFrame:
    """(part, brand, path) of every part."""
    files = v.table("part").select(c("p_partkey").alias("part"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"))
    return files.withColumn("path", _path(c("part"), c("brand")))


def script_sources(v: Views) -> DataFrame:
    """(path, text) of every part."""
    files = materialize(script_files(v), "script-files")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # the few lines of one order
    asks = v.table("lineitem").select(c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), c("l_linenumber").alias("form"), F.lead("l_partkey").over(order).alias("next")).dropna()
    # lines go to their parts before their code is written
    lines = asks.join(files.select(c("part").alias("next"), c("brand").alias("b")), "next").repartition("part")
    up, key = F.when(c("part") % 4 == 0, "../../").otherwise("../"), c("next").cast("string")
    kind = c("supp") % 5
    spec = F.when(kind == 0, F.concat(F.lit("lib"), (c("next") % 10).cast("string")))
    spec = spec.when(kind == 1, F.concat(up, "b", F.lit("/m"), key)).when(kind == 2, F.concat(up, F.lit("."), F.substring(_path(c("next"), c("b")), 4, 1 << 20)))
    spec = spec.when(kind == 3, F.concat(F.lit("../"), up, "b", F.lit("/m"), key)).when(kind == 4, F.concat(F.lit("./"), up, "b", F.lit("/gone"), key))
    forms = {
        1: ('import a, { b as c } from "', '";\n'),
        2: ("import {\n  x,\n  y,\n} from '", "';\n"),
        3: ('const z = require( "', '" );\n'),
        4: ("export * from '", "';\n"),
        5: ('// import q from "', '"\n'),
        6: ('/* const r = require("', '")\n if */ if (a ?? b) { f("for (;;) // x", a ? b : c); }\n'),
    }
    before, after = F.lit("const late = async (k) => import('"), F.lit("'); // while\n")
    for n, (first, last) in forms.items():
        before, after = F.when(c("form") == n, first).otherwise(before), F.when(c("form") == n, last).otherwise(after)
    lines = lines.select("part", F.struct("form", "next", "supp", F.concat(before, spec, after).alias("code")).alias("x"))
    texts = lines.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("x"))["code"], "").alias("text"))
    return files.join(texts, "part", "left").select("path", "text")


@operator("src_jsgraph", f"""
SELECT DISTINCT a.path, CASE l_suppkey % 5 WHEN 0 THEN 'lib' || CAST(nxt % 10 AS VARCHAR) WHEN 4 THEN 'src/' || b.brand || '/gone' || CAST(nxt AS VARCHAR)
  WHEN 3 THEN CASE WHEN nxt % 4 = 0 THEN b.brand || '/m' || CAST(nxt AS VARCHAR) ELSE b.path END ELSE b.path END AS target,
  l_suppkey % 5 IN (1, 2) OR (l_suppkey % 5 = 3 AND nxt % 4 <> 0) AS found
FROM {_ASKS} l JOIN {_FILES} a ON a.p_partkey = l_partkey JOIN {_FILES} b ON b.p_partkey = nxt WHERE l_linenumber NOT IN (5, 6)""")
def src_jsgraph(v: Views) -> DataFrame:
    """Edges between files by all forms of import; what comments import is none, specifiers without a file are kept as they are."""
    # explode alone would ask first whether there is any, and read every text twice for that
    imports = S.script_facts(script_sources(v)).select("path", F.explode_outer("specifiers").alias("specifier"))
    return S.resolved(imports, script_files(v)).select("path", "target", "found").distinct()


@operator("src_scripts", f"""
SELECT a.path, CASE WHEN p_partkey % 6 IN (1, 3) THEN 'typescript' ELSE 'javascript' END AS language, CAST(coalesce(sum(CASE l_linenumber WHEN 2 THEN 4 WHEN 5 THEN 0 ELSE 1 END) FILTER (nxt IS NOT NULL), 0) AS BIGINT) AS loc,
  1 + 2 * count(*) FILTER (l_linenumber = 6 AND nxt IS NOT NULL) AS complexity, CASE WHEN count(*) FILTER (l_linenumber = 7 AND nxt IS NOT NULL) > 0 THEN 'late' ELSE '' END AS functions
FROM {_FILES} a LEFT JOIN {_ASKS} l ON a.p_partkey = l_partkey GROUP BY a.path, p_partkey""")
def src_scripts(v: Views) -> DataFrame:
    """Lines, branches and functions of every file; words in comments and strings are no branches."""
    return S.script_facts(script_sources(v)).select("path", "language", "loc", "complexity", F.array_join("functions", ",").alias("functions"))


def go_sources(v: Views) -> DataFrame:
    """(path, text) of every supplier."""
    key, package = c("s_suppkey").cast("string"), F.concat(F.lit("n"), c("s_nationkey").cast("string"))
    # at most twenty libraries and a function for each line number, whatever the number of lines
    asked = v.table("lineitem").groupBy("l_suppkey").agg(F.collect_set(c("l_partkey") % 20).alias("libs"), F.collect_set("l_linenumber").alias("runs"))
    lib = lambda x: F.concat(F.lit('\t"lib/p'), x.cast("string"), F.lit('"\n'))
    run = lambda x: F.concat(F.lit("Run"), x.cast("string"), F.lit("(a int) int {\n\tif a > "), x.cast("string"), F.lit(" && a < 9 { return 1 }\n\treturn 0\n}\n"))
    asked = asked.select("l_suppkey", F.sort_array(F.transform("libs", lib)).alias("libs"), F.sort_array(F.transform("runs", run)).alias("runs"))
    rows = v.table("supplier").join(asked, c("s_suppkey") == c("l_suppkey"), "left")
    none = F.array().cast("array<string>")
    runs = F.transform(F.coalesce("runs", none), lambda x: F.concat(F.lit("func (s *S"), key, F.lit(") "), x))
    text = F.concat(
        F.lit("package "), package, F.lit("\n\nimport (\n"), F.array_join(F.coalesce("libs", none), ""), F.lit(")\n\ntype S"), key, F.lit(" struct {}\n"), F.array_join(runs, "")
    )
    return rows.select(F.concat(F.lit("go/"), package, F.lit("/s"), key, F.lit(".go")).alias("path"), text.alias("text"))


@operator("src_polyglot", f"""
SELECT a.path, CASE WHEN a.p_partkey % 6 IN (1, 3) THEN 'typescript' ELSE 'javascript' END AS language, CAST(coalesce(sum(CASE l_linenumber WHEN 2 THEN 4 WHEN 6 THEN 2 ELSE 1 END) FILTER (nxt IS NOT NULL), 0) AS BIGINT) AS loc,
  CAST(1 + coalesce(sum(CASE l_linenumber WHEN 6 THEN 5 WHEN 7 THEN 1 ELSE 0 END) FILTER (nxt IS NOT NULL), 0) AS BIGINT) AS complexity,
  count(DISTINCT CASE l_suppkey % 5 WHEN 0 THEN 'lib' || CAST(nxt % 10 AS VARCHAR) ELSE CAST(l_suppkey % 5 AS VARCHAR) || ':' || CAST(nxt AS VARCHAR) END) FILTER (nxt IS NOT NULL) AS imports,
  CASE WHEN count(*) FILTER (l_linenumber = 7 AND nxt IS NOT NULL) > 0 THEN 'late' ELSE '' END AS functions, NULL AS package
FROM {_FILES} a LEFT JOIN {_ASKS} l ON a.p_partkey = l_partkey GROUP BY a.path, a.p_partkey
UNION ALL SELECT 'go/n' || CAST(s_nationkey AS VARCHAR) || '/s' || CAST(s_suppkey AS VARCHAR) || '.go', 'go', 6 + count(DISTINCT l_partkey % 20) + 4 * count(DISTINCT l_linenumber), 1 + 2 * count(DISTINCT l_linenumber), count(DISTINCT l_partkey % 20),
  coalesce(array_to_string(list_sort(list(DISTINCT 'Run' || CAST(l_linenumber AS VARCHAR)) FILTER (l_linenumber IS NOT NULL)), ','), ''), 'n' || CAST(s_nationkey AS VARCHAR)
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey""")
def src_polyglot(v: Views) -> DataFrame:
    """One record for each file of three languages, by patterns over the text as it stands: here comments and strings count."""
    sources = materialize(script_sources(v).unionByName(go_sources(v)), "polyglot-sources")  # read once for each language
    facts = polyglot.polyglot_facts(sources)
    return facts.select("path", "language", "loc", "complexity", F.size("imports").cast("long").alias("imports"), F.array_join("functions", ",").alias("functions"), "package")
