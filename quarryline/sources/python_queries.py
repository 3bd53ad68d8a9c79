"""Queries over Python source that Spark writes from the tables: an order is a module, its lines are functions.

Since the text follows from the tables, SQL can say what parsing must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions.queries import _hmac_sql
from ..store import materialize
from ..views import Views
from . import failure_space as failures
from . import python_checks
from . import python_text as P

c = F.col
_S = "CAST({} AS VARCHAR)"


def py_sources(v: Views) -> DataFrame:
    """(path, text): the module of every order that has lines."""
    def code(x):
        n, s = x["l_linenumber"] % 4, x["l_suppkey"].cast("string")
        head = F.concat(F.lit("def f"), x["l_partkey"].cast("string"), F.lit("_"), x["l_linenumber"].cast("string"), F.lit("(a, b=1"), F.when(x["l_suppkey"] % 5 == 0, ", c=2").otherwise(""), F.lit("):\n"))
        return F.concat(
            head,
            F.when(n >= 1, F.concat(F.lit("    if a > "), x["q"], F.lit(" and b:\n        return g"), s, F.lit("(a)\n"))).otherwise(""),
            F.when(n >= 2, F.lit("    for x in range(3):\n        assert x\n")).otherwise(""),
            F.when(n == 3, F.lit("    while b:\n        b = helper.step(b)\n")).otherwise(""),
            F.concat(F.lit("    return a if b else "), x["q"], F.lit("\n")),
        )

    # numbers are shuffled, not the text
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int").cast("string").alias("q"))
    lines = v.table("lineitem").select(c("l_orderkey").alias("path"), line.alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("x"))
    cust = v.table("orders").select(c("o_orderkey").alias("path"), c("o_custkey").alias("k"))
    top = F.concat(F.lit("import m"), (c("k") % 100).cast("string"), F.lit("\nfrom pkg.m"), (c("k") % 7).cast("string"), F.lit(" import h\n"), F.when(c("k") % 3 == 0, F.lit('__all__ = ["f"]\n')).otherwise(""))
    return cust.join(lines, "path").select("path", F.concat(top, F.array_join(F.transform("x", code), "")).alias("text"))


def facts(v: Views, *kinds: str) -> DataFrame:
    return P.python_facts(py_sources(v), *kinds)


_NAME = "'f' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)"
_M = "l_linenumber % 4"
_LINES = "(SELECT l.* FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"


@operator("src_pyfile", f"SELECT l_orderkey AS path, {_NAME} AS name, CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 2 END AS args, count(*) AS n FROM {_LINES} x GROUP BY 1, 2, 3")
def src_pyfile(v: Views) -> DataFrame:
    return facts(v, "function").groupBy("path", "name", "args").agg(F.count("*").alias("n"))


@operator("src_pydir", "SELECT o_orderkey AS path, count(*) AS functions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def src_pydir(v: Views) -> DataFrame:
    return facts(v, "function").groupBy("path").agg(F.count("*").alias("functions"))


@operator("src_calls", f"""
SELECT callee, count(*) AS calls FROM (SELECT 'g' || CAST(l_suppkey AS VARCHAR) AS callee FROM {_LINES} x WHERE {_M} >= 1 UNION ALL SELECT 'range' FROM {_LINES} y WHERE {_M} >= 2 UNION ALL SELECT 'step' FROM {_LINES} z WHERE {_M} = 3) s GROUP BY callee""")
def src_calls(v: Views) -> DataFrame:
    return facts(v, "function").select(F.explode("calls").alias("callee")).groupBy("callee").agg(F.count("*").alias("calls"))


@operator("src_pygraph", f"""
SELECT l_orderkey AS path, 'IMPORTS' AS edge, 'm' || CAST(o_custkey % 100 AS VARCHAR) AS target FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) a ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, 'IMPORTS', 'pkg.m' || CAST(o_custkey % 7 AS VARCHAR) FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) b ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT l_orderkey, 'CONTAINS', {_NAME} FROM {_LINES} x""")
def src_pygraph(v: Views) -> DataFrame:
    edge = F.when(c("kind") == "import", "IMPORTS").otherwise("CONTAINS")
    return facts(v, "import", "function", "class").select("path", edge.alias("edge"), c("name").alias("target")).dropDuplicates()


_FN = f"CASE WHEN {_M} >= 1 THEN 1 ELSE 0 END", f"CASE WHEN {_M} >= 2 THEN 1 ELSE 0 END", f"CASE WHEN {_M} = 3 THEN 1 ELSE 0 END"
_RULES = {
    "block": f"2*({_FN[0]}) + 2*({_FN[1]}) + ({_FN[2]})",
    "module": f"({_FN[0]}) + ({_FN[1]}) + ({_FN[2]})",
    "poly": f"2*({_FN[0]}) + ({_FN[1]}) + ({_FN[2]}) + 1",
    "mccabe": f"2*({_FN[0]}) + 2*({_FN[1]}) + ({_FN[2]}) + 1",
    "watch": f"2*({_FN[0]}) + 2*({_FN[1]}) + ({_FN[2]})",
    "patch": f"2*({_FN[0]}) + ({_FN[1]}) + ({_FN[2]})",
}


@operator("src_agentfacts", f"SELECT l_orderkey AS path, CAST(max(1 + {_RULES['mccabe']}) AS INTEGER) AS most, CAST(1 + sum({_RULES['mccabe']}) AS INTEGER) AS whole FROM {_LINES} x GROUP BY l_orderkey")
def src_agentfacts(v: Views) -> DataFrame:
    f = facts(v, "function", "module").withColumn("x", P.complexity("mccabe"))
    return f.groupBy("path").agg(F.max(F.when(c("kind") == "function", c("x"))).alias("most"), F.max(F.when(c("kind") == "module", c("x"))).alias("whole"))


@operator("cpx_maxblock", f"SELECT l_orderkey AS path, CAST(max(1 + {_RULES['block']}) AS INTEGER) AS complexity FROM {_LINES} x GROUP BY l_orderkey")
def cpx_maxblock(v: Views) -> DataFrame:
    return facts(v, "function").groupBy("path").agg(F.max(P.complexity("block")).alias("complexity"))


@operator("cpx_blocks", f"SELECT l_orderkey AS path, {_NAME} AS name, CAST(max(1 + {_RULES['block']}) AS INTEGER) AS complexity FROM {_LINES} x GROUP BY 1, 2")
def cpx_blocks(v: Views) -> DataFrame:
    return facts(v, "function").groupBy("path", "name").agg(F.max(P.complexity("block")).alias("complexity"))


def _module(kind: str):
    sql = f"SELECT l_orderkey AS path, CAST(1 + sum({_RULES[kind]}) AS INTEGER) AS complexity FROM {_LINES} x GROUP BY l_orderkey"

    def query(v: Views) -> DataFrame:
        return facts(v, "module").select("path", P.complexity(kind).alias("complexity"))

    return sql, query


for _kind in ("module", "poly", "mccabe", "watch", "patch"):
    _sql, _query = _module(_kind)
    operator(f"cpx_{_kind}", _sql)(_query)


@operator("cpx_sentinel", f"SELECT l_orderkey AS path, CAST(sum(1 + {_RULES['block']}) AS BIGINT) AS complexity FROM {_LINES} x GROUP BY l_orderkey")
def cpx_sentinel(v: Views) -> DataFrame:
    return facts(v, "function").groupBy("path").agg(F.sum(P.complexity("block")).alias("complexity"))


@operator("prj_exports", "SELECT o_orderkey AS path FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def prj_exports(v: Views) -> DataFrame:
    return facts(v, "exports").select("path").distinct()


@operator("det_bloat", f"SELECT l_orderkey AS path, {_NAME} AS name FROM {_LINES} x WHERE {_M} = 0")
def det_bloat(v: Views) -> DataFrame:
    """Functions of one statement without a branch, which only pass a value through."""
    return facts(v, "function").where("statements = 1 and n_if + n_for + n_while = 0").select("path", "name")


@operator("det_assertions", f"SELECT l_orderkey AS path, count(*) FILTER ({_M} >= 2) AS asserts, count(*) FILTER ({_M} = 3) AS loops, 0 AS errors FROM {_LINES} x GROUP BY l_orderkey")
def det_assertions(v: Views) -> DataFrame:
    f = facts(v, "function", "module", "error").groupBy("path").agg(
        F.coalesce(F.sum(F.when(c("kind") == "function", c("n_assert"))), F.lit(0)).alias("asserts"),
        F.coalesce(F.sum(F.when(c("kind") == "function", c("n_while"))), F.lit(0)).alias("loops"),
        F.count_if(c("kind") == "error").cast("int").alias("errors"),
    )
    return f


@operator("det_future", f"""
SELECT name, count(DISTINCT args) AS signatures, count(DISTINCT path) AS modules FROM (SELECT l_orderkey AS path, {_NAME} AS name, CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 2 END AS args FROM {_LINES} x) s GROUP BY name HAVING count(DISTINCT args) > 1""")
def det_future(v: Views) -> DataFrame:
    """Functions whose signature differs between modules."""
    f = facts(v, "function").groupBy("name").agg(F.countDistinct("args").alias("signatures"), F.countDistinct("path").alias("modules"))
    return f.where("signatures > 1")


_CODE = """
SELECT l_orderkey AS path, string_agg('def f' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '(a, b=1' || CASE WHEN l_suppkey % 5 = 0 THEN ', c=2' ELSE '' END || '):' || chr(10)
  || CASE WHEN l_linenumber % 4 >= 1 THEN '    if a > ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' and b:' || chr(10) || '        return g' || CAST(l_suppkey AS VARCHAR) || '(a)' || chr(10) ELSE '' END
  || CASE WHEN l_linenumber % 4 >= 2 THEN '    for x in range(3):' || chr(10) || '        assert x' || chr(10) ELSE '' END
  || CASE WHEN l_linenumber % 4 = 3 THEN '    while b:' || chr(10) || '        b = helper.step(b)' || chr(10) ELSE '' END
  || '    return a if b else ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS code FROM lineitem GROUP BY l_orderkey"""


@operator("agg_semhash", f"""
SELECT o_custkey, sha256(string_agg(sha256('import m' || CAST(o_custkey % 100 AS VARCHAR) || chr(10) || 'from pkg.m' || CAST(o_custkey % 7 AS VARCHAR) || ' import h' || chr(10)
  || CASE WHEN o_custkey % 3 = 0 THEN '__all__ = ["f"]' || chr(10) ELSE '' END || code), chr(10) ORDER BY o_orderkey)) AS digest FROM orders JOIN ({_CODE}) k ON path = o_orderkey GROUP BY o_custkey""")
def agg_semhash(v: Views) -> DataFrame:
    """A digest of the code of each customer's modules; layout and comments do not count."""
    of = P.layout_free_digest(py_sources(v)).join(v.table("orders").select(c("o_orderkey").alias("path"), "o_custkey"), "path")
    rows = of.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("path", "digest"))).alias("r"))
    return rows.select("o_custkey", F.sha2(F.array_join(F.transform("r", lambda x: x["digest"]), "\n").cast("binary"), 256).alias("digest"))


# the rest of the stored and exported forms


@operator("src_ledger", "SELECT user_id, count(*) AS records, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def src_ledger(v: Views) -> DataFrame:
    """Events written as JSON lines, and read back with a schema."""
    from ..store import new_path

    folder = new_path(v.spark, "ledger")
    v.table("events").select("event_id", "user_id", "value").write.json(folder)
    back = v.spark.read.schema("event_id long, user_id long, value double").json(folder)
    return back.groupBy("user_id").agg(F.count("*").alias("records"), F.round(F.sum("value"), 2).alias("total"))


@operator("src_covjson", "SELECT path, round(100.0 * fixes / commits, 2) AS pct FROM churn")
def src_covjson(v: Views) -> DataFrame:
    """Coverage reports as JSON, one for each file, parsed by path."""
    report = F.to_json(F.struct(F.struct(F.round(100.0 * c("fixes") / c("commits"), 2).alias("percent_covered")).alias("summary")))
    return v.churn.select("path", report.alias("j")).select("path", F.get_json_object("j", "$.summary.percent_covered").cast("double").alias("pct"))


@operator("src_covxml", "SELECT path, round(CAST(fixes AS DOUBLE) / commits, 4) * 100 AS pct FROM churn")
def src_covxml(v: Views) -> DataFrame:
    xml = F.concat(F.lit('<class line-rate="'), F.round(c("fixes") / c("commits"), 4).cast("string"), F.lit('"/>'))
    return v.churn.select("path", (F.xpath_double(xml, F.lit("/class/@line-rate")) * 100).alias("pct"))


_RUNS = (1995, 1996, 1997)


@operator("snk_persist", """
WITH f AS (SELECT year(o_orderdate) AS run, l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS size, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS commits, list_sort(list(DISTINCT l_suppkey)) AS deps
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1, 2),
h AS (SELECT coalesce(n.run, o.run + 1) AS run, coalesce(n.path, o.path) AS path, n.size, n.commits, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.size <> o.size OR n.commits <> o.commits OR n.deps <> o.deps THEN 'modified' END AS action
  FROM f n FULL JOIN f o ON o.path = n.path AND o.run = n.run - 1)
SELECT run, CAST(path AS VARCHAR) AS path, action, size, commits > 6 AS violates FROM h WHERE run BETWEEN 1996 AND 1997 AND action IS NOT NULL""")
def snk_persist(v: Views) -> DataFrame:
    """Three runs persisted, the newest two kept: what became of every file, and whether it breaks a rule."""
    from .history import RunHistory

    history = RunHistory(v.spark, keep=2)
    for run in _RUNS:
        lines = v.within(run, run).table("orders").join(v.table("lineitem"), c("o_orderkey") == c("l_orderkey"))
        lines = materialize(lines.select(c("l_partkey").cast("string").alias("path"), "l_quantity", "l_orderkey", c("l_suppkey").cast("string").alias("target")), "run-lines")
        files = lines.groupBy("path").agg(F.sum("l_quantity").cast("long").alias("size"), F.countDistinct("l_orderkey").cast("double").alias("value"))
        metrics = files.select("path", F.lit("commits").alias("name"), "value")
        history.persist(run, files.select("path", "size"), metrics, lines.select("path", "target"), [("max-commits", "commits", 6.0), ("max-lines", "lines", 0.0)])
    ids = history.read("ids").select("path", "file_id")
    broken = history.read("violations").select("run", "file_id", F.lit(True).alias("breaks"))
    sizes = history.read("files").select("run", "file_id", "size")
    found = history.read("entity_history").join(sizes, ["run", "file_id"], "left").join(broken, ["run", "file_id"], "left").join(ids, "file_id")
    return found.select("run", "path", "action", "size", F.when(c("size").isNotNull(), c("breaks").isNotNull()).alias("violates"))


@operator("snk_context", "SELECT package, count(*) AS files, CAST(sum(fixes) AS BIGINT) AS fixes FROM modules GROUP BY package")
def snk_context(v: Views) -> DataFrame:
    from ..store import new_path

    folder = new_path(v.spark, "context")
    v.modules.write.json(folder)
    back = v.spark.read.schema("package string, fixes long").json(folder)
    return back.groupBy("package").agg(F.count("*").alias("files"), F.sum("fixes").alias("fixes"))


@operator("snk_md", """
SELECT '| ' || CAST(path AS VARCHAR) || ' | ' || package || ' |' || CASE WHEN complexity > 28 THEN ' !' ELSE '' END AS line FROM (SELECT * FROM modules ORDER BY complexity DESC, path LIMIT 15) t""")
def snk_md(v: Views) -> DataFrame:
    """The rows of a dossier: the fifteen most complex files."""
    top = v.modules.orderBy(F.desc("complexity"), "path").limit(15)
    return top.select(F.concat(F.lit("| "), c("path").cast("string"), F.lit(" | "), c("package"), F.lit(" |"), F.when(c("complexity") > 28, " !").otherwise("")).alias("line"))


@operator("agg_modelhash", """
SELECT domain, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM (
  SELECT domain, id // 1000 AS block, sha256(string_agg(CAST(id AS VARCHAR) || ':' || CAST(loc AS VARCHAR) || ',', '' ORDER BY id)) AS digest FROM nodes GROUP BY 1, 2) b GROUP BY domain""")
def agg_modelhash(v: Views) -> DataFrame:
    from ..operators.aggregates import two_level_digest

    return two_level_digest(v.nodes, "domain", "id", F.concat(c("id").cast("string"), F.lit(":"), c("loc").cast("string"), F.lit(",")))


@operator("jsn_canon", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}' AS canonical FROM events""")
def jsn_canon(v: Views) -> DataFrame:
    """JSON with keys in order and no blanks."""
    return v.table("events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), c("event_type").alias("type"))).alias("canonical"))


@operator("win_lineage", """
WITH RECURSIVE o AS (SELECT o_orderkey AS run_id, o_custkey AS who, o_orderdate AS ts, date_trunc('month', o_orderdate) AS month FROM orders),
m AS (SELECT who, month, arg_max(run_id, struct_pack(ts, run_id)) AS last FROM o GROUP BY 1, 2),
q AS (SELECT who, month, lag(last) OVER (PARTITION BY who ORDER BY month) AS previous FROM m),
h AS (SELECT o.run_id, q.previous FROM o JOIN q ON q.who = o.who AND q.month = o.month),
r(run_id, depth, ancestor) AS (SELECT run_id, 1, previous FROM h WHERE previous IS NOT NULL UNION ALL SELECT r.run_id, r.depth + 1, h.previous FROM r JOIN h ON h.run_id = r.ancestor WHERE h.previous IS NOT NULL AND r.depth < 5)
SELECT run_id, depth, ancestor FROM r""")
def win_lineage(v: Views) -> DataFrame:
    """Five runs back along previous runs.  Orders are runs: those of a customer's month follow the last one of that customer's month before, so that histories branch."""
    from ..operators.graph import ancestors

    o = v.table("orders").select(c("o_orderkey").alias("run_id"), c("o_custkey").alias("who"), c("o_orderdate").alias("ts"), F.trunc("o_orderdate", "month").alias("month"))
    last = o.groupBy("who", "month").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("last"))
    before = last.select("who", "month", F.lag("last").over(Window.partitionBy("who").orderBy("month")).alias("previous_run_id"))
    return ancestors(o.join(before, ["who", "month"]).select("run_id", "previous_run_id"), 5)


@operator("mat_action", """
SELECT path, CASE WHEN loc < 300 THEN 'DEFER' WHEN fixes >= 8 AND coupling >= 8 THEN 'PROTECT' WHEN complexity >= 27 THEN 'REFACTOR' WHEN fixes >= 5 THEN 'INVESTIGATE' ELSE 'DEFER' END AS action FROM modules""")
def mat_action(v: Views) -> DataFrame:
    a = F.when(c("loc") < 300, "DEFER").when((c("fixes") >= 8) & (c("coupling") >= 8), "PROTECT").when(c("complexity") >= 27, "REFACTOR").when(c("fixes") >= 5, "INVESTIGATE").otherwise("DEFER")
    return v.modules.select("path", a.alias("action"))


@operator("mat_abstract", "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN round(p_size / 50.0, 2) WHEN contains(p_name, 'ring') THEN 0.7 ELSE 0.1 END AS abstractness FROM part")
def mat_abstract(v: Views) -> DataFrame:
    a = F.when(c("p_type") == "STANDARD", F.round(c("p_size") / 50.0, 2)).when(F.contains("p_name", F.lit("ring")), 0.7).otherwise(0.1)
    return v.table("part").select("p_partkey", a.alias("abstractness"))


@operator("arr_mutations", """
SELECT p_partkey, unnest(CASE p_size % 3 WHEN 0 THEN [0, 1, -1, 2147483647] WHEN 1 THEN [0, 1] ELSE [p_size, p_size + 1, p_size - 1] END) AS boundary FROM part""")
def arr_mutations(v: Views) -> DataFrame:
    """Boundary values for each class of parameter."""
    s = c("p_size")
    values = F.when(s % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(-1), F.lit(2147483647))).when(s % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(s, s + 1, s - 1))
    return v.table("part").select("p_partkey", F.explode(values).alias("boundary"))


@operator("rul_pack", "SELECT rule, count(*) AS n FROM (SELECT 'max-complexity' AS rule FROM run_metrics WHERE name = 'complexity' AND value > 300 UNION ALL SELECT 'max-coupling' FROM run_metrics WHERE name = 'coupling' AND value > 99 UNION ALL SELECT 'min-hotspot_score' FROM run_metrics WHERE name = 'hotspot_score' AND value < 10) s GROUP BY rule")
def rul_pack(v: Views) -> DataFrame:
    from ..operators.rules import PACK, evaluate

    return evaluate(v.run_metrics, PACK).groupBy("rule").agg(F.count("*").alias("n"))


@operator("api_metrics", "SELECT path, count(*) AS metrics, round(max(value), 4) AS largest FROM run_metrics GROUP BY path")
def api_metrics(v: Views) -> DataFrame:
    return v.run_metrics.groupBy("path").agg(F.count("*").alias("metrics"), F.round(F.max("value"), 4).alias("largest"))


@operator("api_rules", "SELECT name AS metric, min(value) AS least, max(value) AS most FROM run_metrics GROUP BY name")
def api_rules(v: Views) -> DataFrame:
    return v.run_metrics.groupBy(c("name").alias("metric")).agg(F.min("value").alias("least"), F.max("value").alias("most"))


@operator("str_unscramble", f"SELECT c_custkey, min(c_name) OVER (PARTITION BY left({_hmac_sql('c_name', 'salt')}, 8)) AS name FROM customer")
def str_unscramble(v: Views) -> DataFrame:
    """Names scrambled and found again through the inverse table; names of one token get the first of them."""
    from ..functions.text import scramble

    names = v.table("customer").select("c_custkey", "c_name", scramble(c("c_name"), "salt", "SYM").alias("token"))
    inverse = names.groupBy("token").agg(F.min("c_name").alias("name"))
    return names.select("c_custkey", "token").join(inverse, "token").select("c_custkey", "name")


# Each line of an order is a piece of its file, in one of seven forms: text, its lines, the rule that it breaks and where.
_FORMS = (
    ("def f(p):\n    return open(p)\n", 2, "MissingFileEncoding", 1),
    ('def g(p):\n    return open(p, "rb"), p.split(",")\n', 2, None, 0),
    ('def h(p, x):\n    return p + "/" + x\n', 2, "HardcodedPathSeparators", 1),
    ("def i(p):\n    try:\n        return p\n    except KeyError:\n        pass\n", 5, "SilentErrorHandling", 3),
    ("def j(p):\n    # open(p)\n    pass\n", 3, "FunctionStub", 0),
    ('def k(p):\n    return f"{p}/x", "open(p)"\n', 2, "HardcodedPathSeparators", 1),
    ("class C(ABC):\n    def m(self):\n        pass\n", 3, None, 0),
)


def checked_sources(v: Views) -> DataFrame:
    """(path, text): the file of every order that has lines; the files of some customers are never finished."""
    forms = F.array(*(F.lit(text) for text, *_ in _FORMS))
    lines = v.table("lineitem").select(c("l_orderkey").alias("path"), "l_linenumber").groupBy("path").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    orders = v.table("orders").select(c("o_orderkey").alias("path"), F.when(c("o_custkey") % 11 == 0, "x = (\n").otherwise("").alias("rest"))
    return orders.join(lines, "path").select("path", F.concat(F.array_join(F.transform("x", lambda x: F.element_at(forms, (x - 1) % 7 + 1)), ""), "rest").alias("text"))


def _pick_sql(at: int) -> str:
    values = ("NULL" if f[at] is None else f"'{f[at]}'" if isinstance(f[at], str) else str(f[at]) for f in _FORMS)
    return f"[{', '.join(values)}][(l_linenumber - 1) % 7 + 1]"


@operator("det_source_checks", f"""
SELECT l_orderkey AS path, CAST(1 + above + off AS INTEGER) AS line, rule FROM (
  SELECT l_orderkey, {_pick_sql(2)} AS rule, {_pick_sql(3)} AS off, coalesce(sum({_pick_sql(1)}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 11 <> 0) s WHERE rule IS NOT NULL
UNION ALL SELECT DISTINCT o_orderkey, 0, 'SyntaxError' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 11 = 0""")
def det_source_checks(v: Views) -> DataFrame:
    """All findings of the five checks, with their lines."""
    return python_checks.source_checks(checked_sources(v))


_TRIED = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber % 6 IN (1, 2, 3)"


def tested_sources(v: Views) -> DataFrame:
    """(path, text): every part is a file of one function, every order a test file whose lines call the functions of their parts in six ways."""
    part, text = c("p_partkey").cast("string"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    bodies = ("    assert a\n    return a\n", "    if a is None:\n        raise ValueError('a')\n    return a\n", "    if a:\n        return b\n    return a\n", "    a = 1\n" * 5 + "    raise ValueError(a)\n", "    return f'{a}'\n")
    body = F.element_at(F.array(*(F.lit(x) for x in bodies)), (c("p_size") % 5 + 1).cast("int"))
    path = text("pkg/", F.replace("p_brand", F.lit("#"), F.lit("")), "/m", part, ".py")
    files = v.table("part").select(path.alias("path"), text("def f", part, "(a, b=1):\n", body).alias("text"))
    name, way = text("f", c("l_partkey").cast("string")), c("l_linenumber") % 6
    ways = {0: text("    ", name, "(1, b='x')\n"), 1: text("    ", name, "(None)\n"), 2: text("    with self.assertRaises(ValueError):\n        ", name, "(2)\n"), 3: text("    ", name, "(1, b={})\n"), 4: text("    # ", name, "(None)\n"), 5: text("    g(", name, "(3), [])\n")}
    code = F.lit("")
    for n, said in ways.items():
        code = F.when(way == n, said).otherwise(code)
    lines = v.table("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", code.alias("code")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    tests = lines.select(text("tests/test_", c("l_orderkey").cast("string"), ".py").alias("path"), text("def test(self):\n", F.array_join(F.transform("x", lambda x: x["code"]), ""), "    pass\n").alias("text"))
    return files.unionByName(tests)


@operator("det_residual", f"""
SELECT replace(p_brand, '#', '') AS package, count(*) AS functions, count(*) FILTER (NOT tested) AS untested, count(*) FILTER (NOT guarded AND NOT tried) AS unguarded,
  count(*) FILTER (NOT tested) + count(*) FILTER (NOT guarded AND NOT tried) AS residual
FROM (SELECT p_brand, p_size % 5 IN (0, 1) AS guarded, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 6 <> 4) AS tested, p_partkey IN ({_TRIED}) AS tried FROM part) s GROUP BY 1""")
def det_residual(v: Views) -> DataFrame:
    """Functions of every package that no test calls, and those whose odd cases nothing tries."""
    found = failures.failure_space(tested_sources(v))
    sums = [F.count_if("untested").alias("untested"), F.count_if("unguarded").alias("unguarded"), F.sum("residual").alias("residual")]
    return found.groupBy(F.split("path", "/")[1].alias("package")).agg(F.count("*").alias("functions"), *sums)


@operator("det_uncovered", f"""
SELECT 'f' || CAST(p_partkey AS VARCHAR) AS name, NOT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 6 <> 4) AS untested, NOT (p_size % 5 IN (0, 1) OR p_partkey IN ({_TRIED})) AS unguarded
FROM part WHERE p_partkey % 3 = 0""")
def det_uncovered(v: Views) -> DataFrame:
    """The same of single functions, of those alone whose second line has changed: of every third part."""
    sources = tested_sources(v)
    number = F.regexp_extract("path", r"^pkg/.*/m(\d+)\.py$", 1)
    changed = sources.where((number != "") & (number.try_cast("long") % 3 == 0)).select("path", F.lit(2).alias("line"))
    return failures.failure_space(sources, changed).select("name", "untested", "unguarded")
