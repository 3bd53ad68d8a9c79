"""Projections, filters and ordered classifications over paths and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import operator
from ..functions import classify as K
from ..views import Views

c = F.col


@operator("prj_normpath", r"""
SELECT page_id, regexp_replace(regexp_replace(trim(replace(url, '\', '/')), '^[./]+', ''), '/+$', '') AS norm FROM pages""")
def prj_normpath(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", K.normalize_path(c("url")).alias("norm"))


@operator("prj_modname", r"SELECT page_id, replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module, string_split(path, '/')[-1] AS base FROM paths")
def prj_modname(v: Views) -> DataFrame:
    return v.paths.select("page_id", K.module_name(c("path")).alias("module"), K.base_name(c("path")).alias("base"))


@operator("prj_role", """
SELECT path, CASE WHEN package = 'Brand#1' THEN 'ENTRY_POINT' WHEN coupling >= 10 AND complexity >= 20 THEN 'HUB' WHEN authors >= 25 THEN 'SHARED'
  WHEN fixes >= 8 THEN 'FRAGILE' WHEN loc < 400 THEN 'LEAF' ELSE 'INTERNAL' END AS role FROM modules""")
def prj_role(v: Views) -> DataFrame:
    rules = [
        (c("package") == "Brand#1", "ENTRY_POINT"),
        ((c("coupling") >= 10) & (c("complexity") >= 20), "HUB"),
        (c("authors") >= 25, "SHARED"),
        (c("fixes") >= 8, "FRAGILE"),
        (c("loc") < 400, "LEAF"),
    ]
    return v.modules.select("path", K.first_match(rules, "INTERNAL").alias("role"))


@operator("prj_strategy", """
WITH s(role, level, strategy) AS (VALUES ('HOT', 'HIGH', 'FREEZE'), ('HOT', '*', 'REVIEW'), ('*', 'HIGH', 'REFACTOR')),
m AS (SELECT path, CASE WHEN fixes >= 6 THEN 'HOT' ELSE 'COLD' END AS role, CASE WHEN complexity >= 26 THEN 'HIGH' ELSE 'LOW' END AS level FROM modules)
SELECT m.path, coalesce(a.strategy, b.strategy, d.strategy, 'SAFE_EDIT') AS strategy FROM m
LEFT JOIN s a ON a.role = m.role AND a.level = m.level LEFT JOIN s b ON b.role = m.role AND b.level = '*' LEFT JOIN s d ON d.role = '*' AND d.level = m.level""")
def prj_strategy(v: Views) -> DataFrame:
    """A lookup by (role, level) with wildcards, exact matches first; the table is a constant."""
    table = v.spark.createDataFrame([("HOT", "HIGH", "FREEZE"), ("HOT", "*", "REVIEW"), ("*", "HIGH", "REFACTOR")], "role string, level string, strategy string")
    m = v.modules.select("path", F.when(c("fixes") >= 6, "HOT").otherwise("COLD").alias("r"), F.when(c("complexity") >= 26, "HIGH").otherwise("LOW").alias("l"))
    for i, (role, level) in enumerate(((c("r"), c("l")), (c("r"), F.lit("*")), (F.lit("*"), c("l")))):
        some = table.withColumnRenamed("strategy", f"s{i}")
        m = m.join(F.broadcast(some), (role == some.role) & (level == some.level), "left").drop("role", "level")
    return m.select("path", F.coalesce("s0", "s1", "s2", F.lit("SAFE_EDIT")).alias("strategy"))


@operator("prj_category", """
SELECT page_id, CASE WHEN regexp_matches(path, '^m[.]') THEN 'MOBILE' WHEN regexp_matches(path, '/en/') THEN 'ENGLISH' WHEN regexp_matches(path, '[.]org/') THEN 'ORG'
  WHEN regexp_matches(path, '[.]net/') THEN 'NET' WHEN regexp_matches(path, '/[0-9]+$') THEN 'NUMBERED' ELSE 'UNKNOWN' END AS category FROM paths""")
def prj_category(v: Views) -> DataFrame:
    rules = [(c("path").rlike(p), name) for p, name in (("^m[.]", "MOBILE"), ("/en/", "ENGLISH"), ("[.]org/", "ORG"), ("[.]net/", "NET"), ("/[0-9]+$", "NUMBERED"))]
    return v.paths.select("page_id", K.first_match(rules, "UNKNOWN").alias("category"))


@operator("prj_lang", """
SELECT page_id, CASE WHEN url LIKE '%.py' THEN 'python' WHEN url LIKE '%.js' OR url LIKE '%.jsx' THEN 'javascript' WHEN url LIKE '%.ts' OR url LIKE '%.tsx' THEN 'typescript'
  WHEN url LIKE '%.go' THEN 'go' ELSE 'unknown' END AS language FROM pages""")
def prj_lang(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", K.language_of(c("url")).alias("language"))


@operator("prj_istest", r"""
SELECT page_id, (regexp_matches(path, '(^|/)tests?/') OR regexp_matches(string_split(path, '/')[-1], '^test_|_test\.')) AND NOT contains(path, 'fixtures/') AS is_test FROM paths""")
def prj_istest(v: Views) -> DataFrame:
    return v.paths.select("page_id", K.is_test(c("path")).alias("is_test"))


@operator("prj_prune", "SELECT page_id FROM paths WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', '.git', 'venv', 'dist', 'build', '__pycache__'])")
def prj_prune(v: Views) -> DataFrame:
    return v.paths.where(~K.is_pruned(c("path"))).select("page_id")


def intent_targets(intents: DataFrame, paths: DataFrame, *, least: int = 4) -> DataFrame:
    """(intent, path): the paths(path, name) whose name holds a word of intents(intent, text), of ``least`` letters or more, anywhere and in any case.

    Words are listed under their first ``least`` letters, names under all their stretches of that many, and what meets is verified: a name of n letters is n rows at most.
    """
    words = intents.select("intent", F.explode(F.split("text", r"\s+")).alias("w")).where(F.length("w") >= least).select("intent", F.lower("w").alias("w")).distinct()
    asked = words.select("w", F.substring("w", 1, least).alias("gram")).distinct()
    name = paths.where(F.length("name") >= least).select("path", F.lower("name").alias("name"))
    starts = F.sequence(F.lit(1), F.length("name") - least + 1)
    grams = name.select("path", "name", F.explode(F.array_distinct(F.transform(starts, lambda at: F.substr("name", at, F.lit(least))))).alias("gram"))
    found = grams.join(asked, "gram").where(F.contains("name", c("w"))).select("w", "path").distinct()
    return words.join(found, "w").select("intent", "path").distinct()


@operator("prj_intent", r"""
SELECT DISTINCT q.item_id, p.page_id FROM (SELECT DISTINCT item_id, lower(w) AS w FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) x WHERE length(w) > 3) q
JOIN paths p ON contains(lower(p.path), q.w)""")
def prj_intent(v: Views) -> DataFrame:
    """Items as intents: the pages whose path holds one of an item's words."""
    found = intent_targets(v.table("benchmark").select(c("item_id").alias("intent"), "text"), v.paths.select(c("page_id").alias("path"), c("path").alias("name")))
    return found.select(c("intent").alias("item_id"), c("path").alias("page_id"))


def domains(files: DataFrame, *depths: int) -> DataFrame:
    """``files(path)`` with domain1, domain2 ... for each depth: directories of a path without what says nothing of its domain.

    That is a source root such as ``src`` with two segments or more below it, or else the top directory that all paths share, if none lies beside it: one aggregate
    over first segments finds it.  A file right there is ``(root)``.
    """
    parts = F.filter(F.split(K.normalize_path(c("path")), "/"), lambda s: s != "")
    p = files.withColumn("parts", parts)
    top = F.get("parts", F.lit(0))
    shared = p.agg(F.when((F.min(F.size("parts")) > 1) & (F.min(top) == F.max(top)), F.min(top)).alias("shared"))  # one row
    p = p.join(F.broadcast(shared))
    wrapped = F.lower(top).isin(*K.SOURCE_ROOTS) & (F.size("parts") > 2)
    rest = F.when(wrapped | ((top == c("shared")) & (F.size("parts") > 1)), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(c("parts"))
    p = p.withColumn("parts", rest)

    def at(depth: int):
        return F.when(F.size("parts") <= 1, "(root)").otherwise(F.array_join(F.slice("parts", F.lit(1), F.least(F.lit(depth), F.size("parts") - 1)), "/"))

    return p.select(*files.columns, *(at(d).alias(f"domain{d}") for d in depths))


_SITES = "SELECT 'site' AS kind, 'site/' || path AS path FROM paths"
_SOURCES = "SELECT DISTINCT 'source' AS kind, 'Lib/' || lower(replace(p_brand, '#', '_')) || '/' || replace(p_name, ' ', '/') || '.py' AS path FROM part UNION ALL SELECT DISTINCT 'source', lower(replace(p_brand, '#', '_')) || '.py' FROM part"


@operator("prj_domain", f"""
WITH s AS (SELECT kind, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM ({_SITES} UNION ALL {_SOURCES}) x),
k AS (SELECT kind, CASE WHEN min(len(p)) > 1 AND min(p[1]) = max(p[1]) THEN min(p[1]) END AS shared FROM s GROUP BY kind),
r AS (SELECT s.kind, path, CASE WHEN lower(p[1]) IN ('src', 'lib', 'app', 'pkg', 'packages') AND len(p) > 2 OR p[1] = shared AND len(p) > 1 THEN p[2:] ELSE p END AS p FROM s JOIN k ON k.kind = s.kind)
SELECT kind, path, CASE WHEN len(p) <= 1 THEN '(root)' ELSE p[1] END AS domain1, CASE WHEN len(p) <= 1 THEN '(root)' ELSE array_to_string(p[1:least(2, len(p) - 1)], '/') END AS domain2 FROM r""")
def prj_domain(v: Views) -> DataFrame:
    """Pages below one directory, and source files of which some lie in the root."""
    sites = v.paths.select(F.lit("site").alias("kind"), F.concat(F.lit("site/"), "path").alias("path"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    inner = F.concat(F.lit("Lib/"), brand, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py"))
    sources = v.table("part").select(F.explode(F.array(inner, F.concat(brand, F.lit(".py")))).alias("path")).distinct().select(F.lit("source").alias("kind"), "path")
    return domains(sites, 1, 2).unionByName(domains(sources, 1, 2))


@operator("prj_prefix", """
SELECT s_suppkey, CASE WHEN contains(n, '_') THEN split_part(n, '_', 1) WHEN contains(n, '-') THEN split_part(n, '-', 1) WHEN length(n) >= 6 THEN substr(n, 1, 4) ELSE n END AS prefix
FROM (SELECT s_suppkey, s_name AS n FROM supplier) s""")
def prj_prefix(v: Views) -> DataFrame:
    return v.table("supplier").select("s_suppkey", K.name_prefix(c("s_name")).alias("prefix"))


@operator("prj_sevlevel", """
SELECT o_orderkey, CASE s WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, CASE s WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS rank
FROM (SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS s FROM orders) o""")
def prj_sevlevel(v: Views) -> DataFrame:
    s = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    return v.table("orders").select("o_orderkey", K.sarif_level(s).alias("level"), K.severity_rank(s).alias("rank"))


@operator("prj_traversal", r"SELECT page_id, regexp_matches(url, '(^|[/\\])\.\.([/\\]|$)') OR regexp_matches(url, '[;&|`$<>]') AS unsafe FROM pages")
def prj_traversal(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", K.has_traversal(c("url")).alias("unsafe"))


@operator("prj_boundary", """
SELECT DISTINCT t.commit_id, t.path FROM touches t JOIN (
  SELECT o_orderkey, CAST(unnest(regexp_extract_all(CAST(o_custkey AS VARCHAR), '[0-9]{3}')) AS BIGINT) AS forbidden FROM orders) f ON f.o_orderkey = t.commit_id AND f.forbidden = t.path""")
def prj_boundary(v: Views) -> DataFrame:
    """Files of a commit that its own constraint text forbids."""
    text = F.col("o_custkey").cast("string")
    forbidden = v.table("orders").select(c("o_orderkey").alias("commit_id"), F.explode(F.regexp_extract_all(text, F.lit("([0-9]{3})"))).alias("path"))
    forbidden = forbidden.select("commit_id", c("path").cast("long").alias("path")).distinct()
    return v.touches.join(forbidden, ["commit_id", "path"]).select("commit_id", "path").distinct()


@operator("prj_translate", """
SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'Simplify the widget' WHEN contains(p_name, 'bolt') THEN 'Tighten the bolt' WHEN contains(p_name, 'ring') THEN 'Check the ring' ELSE 'Review' END AS advice FROM part""")
def prj_translate(v: Views) -> DataFrame:
    rules = [(F.contains("p_name", F.lit(k)), t) for k, t in (("widget", "Simplify the widget"), ("bolt", "Tighten the bolt"), ("ring", "Check the ring"))]
    return v.table("part").select("p_partkey", K.first_match(rules, "Review").alias("advice"))


@operator("flt_archived", "SELECT path, name, value FROM run_metrics WHERE run_id NOT IN (SELECT run_id FROM snapshots WHERE run_id < 1998)")
def flt_archived(v: Views) -> DataFrame:
    archived = v.snapshots.where("run_id < 1998").select("run_id")
    return v.run_metrics.join(archived, "run_id", "left_anti").select("path", "name", "value")


@operator("flt_bugsubject", r"""
SELECT commit_id, author, regexp_matches(lower(subject), '\b(fix|bug|hotfix|revert)\b') AS by_words,
  regexp_matches(lower(subject), 'fix|bug|issue|hotfix|patch') AND NOT regexp_matches(lower(subject), 'docs|readme|typo') AS by_content
FROM (SELECT DISTINCT commit_id, author, CASE author % 5 WHEN 0 THEN 'Fix prefix bug' WHEN 1 THEN 'typo fix' WHEN 2 THEN 'Revert issue 4' WHEN 3 THEN 'debugging' ELSE subject END AS subject FROM touches) t""")
def flt_bugsubject(v: Views) -> DataFrame:
    a = c("author") % 5
    subject = F.when(a == 0, "Fix prefix bug").when(a == 1, "typo fix").when(a == 2, "Revert issue 4").when(a == 3, "debugging").otherwise(c("subject"))
    t = v.touches.select("commit_id", "author", subject.alias("subject")).distinct()
    return t.select("commit_id", "author", K.is_fix_words(c("subject")).alias("by_words"), K.is_fix_contains(c("subject")).alias("by_content"))


@operator("flt_scale", "SELECT commit_id, count(*) AS files FROM touches GROUP BY commit_id HAVING count(*) <= 100")
def flt_scale(v: Views) -> DataFrame:
    return v.touches.groupBy("commit_id").agg(F.count("*").alias("files")).where("files <= 100")


# set operations


def _in_two_runs(v: Views, first: int, second: int) -> DataFrame:
    """(path, dep, a, b): the dependencies of two runs that follow each other, and which of the two has each; one pass over those runs."""
    in_run = [F.max(c("run_id") == run).alias(name) for run, name in ((first, "a"), (second, "b"))]
    return v.within(first, second).run_files.groupBy("path", "dep").agg(*in_run)


@operator("set_diff", "SELECT path, dep FROM run_files WHERE run_id = 1996 EXCEPT SELECT path, dep FROM run_files WHERE run_id = 1995")
def set_diff(v: Views) -> DataFrame:
    return _in_two_runs(v, 1995, 1996).where("b and not a").select("path", "dep")


@operator("set_intersect", "SELECT path, dep FROM run_files WHERE run_id = 1996 INTERSECT SELECT path, dep FROM run_files WHERE run_id = 1997")
def set_intersect(v: Views) -> DataFrame:
    return _in_two_runs(v, 1996, 1997).where("a and b").select("path", "dep")


@operator("set_union", "SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def set_union(v: Views) -> DataFrame:
    return v.edges.select(c("src").alias("id")).union(v.edges.select("dst")).distinct()


@operator("set_member", """
SELECT commit_id, path FROM touches WHERE path IN (SELECT path FROM churn WHERE fixes >= 8) AND path NOT IN (SELECT path FROM modules WHERE coupling < 7)""")
def set_member(v: Views) -> DataFrame:
    protected, hubs = v.churn.where("fixes >= 8").select("path"), v.modules.where("coupling < 7").select("path")
    return v.touches.join(protected, "path", "left_semi").join(hubs, "path", "left_anti").select("commit_id", "path")


@operator("src_discover", """
SELECT path FROM paths WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', '.git', 'venv', 'dist', 'build', '__pycache__']) AND regexp_matches(path, '/[0-9]+$') ORDER BY path""")
def src_discover(v: Views) -> DataFrame:
    return v.paths.where(~K.is_pruned(c("path")) & c("path").rlike("/[0-9]+$")).select("path").orderBy("path")


@operator("src_tree", """
SELECT array_to_string(string_split(path, '/')[1:d], '/') AS node, d AS depth, count(*) AS files
FROM paths, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS d) t GROUP BY 1, 2""")
def src_tree(v: Views) -> DataFrame:
    parts = F.split("path", "/")
    each = v.paths.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d"))
    return each.groupBy(F.array_join(F.slice("p", F.lit(1), c("d")), "/").alias("node"), c("d").cast("long").alias("depth")).agg(F.count("*").alias("files"))


@operator("src_monorepo", """
SELECT dir, CASE WHEN list_contains(l, '825') THEN 'first' WHEN list_contains(l, '25') THEN 'second' WHEN len(l) >= 2 THEN 'many' ELSE 'one' END AS manifest
FROM (SELECT array_to_string(string_split(path, '/')[1:-2], '/') AS dir, list_distinct(list(string_split(path, '/')[-1])) AS l FROM paths GROUP BY 1) s""")
def src_monorepo(v: Views) -> DataFrame:
    parts = F.split("path", "/")
    leaf = K.base_name(c("path"))
    # flags of each directory, not the list of its files
    dirs = v.paths.groupBy(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir")).agg(
        F.max(leaf == "825").alias("first"), F.max(leaf == "25").alias("second"), (F.min(leaf) != F.max(leaf)).alias("many")
    )
    rules = [(c(x), x) for x in ("first", "second", "many")]
    return dirs.select("dir", K.first_match(rules, "one").alias("manifest"))


@operator("src_gitlog", """
SELECT commit_id, CAST(author AS VARCHAR) || '|' || subject AS header, CAST(path AS VARCHAR) AS path FROM touches""")
def src_gitlog(v: Views) -> DataFrame:
    """A log of header lines followed by file lines, read back by carrying each header forward."""
    from ..sources.gitlog import parse_log

    t = v.touches
    heads = t.select("commit_id", F.lit("").alias("k"), F.concat(F.lit("COMMIT:"), c("author").cast("string"), F.lit("|"), c("subject")).alias("line")).distinct()
    lines = heads.unionByName(t.select("commit_id", c("path").cast("string").alias("k"), c("path").cast("string").alias("line")))
    return parse_log(lines, part="commit_id", order=["k"])


@operator("src_buglog", "SELECT path, count(*) AS fixes FROM touches WHERE regexp_matches(lower(subject), 'urgent|high') GROUP BY path")
def src_buglog(v: Views) -> DataFrame:
    return v.touches.where(F.lower("subject").rlike("urgent|high")).groupBy("path").agg(F.count("*").alias("fixes"))


@operator("src_covpick", """
SELECT path, arg_min(pct, prio) AS pct, min(prio) AS prio FROM (
  SELECT path, round(100.0 * fixes / commits, 2) AS pct, 0 AS prio FROM churn WHERE fixes >= 3
  UNION ALL SELECT path, round(100.0 * authors / commits, 2), 1 FROM churn WHERE authors < commits
  UNION ALL SELECT path, 0.0, 2 FROM churn) s GROUP BY path""")
def src_covpick(v: Views) -> DataFrame:
    ch = v.churn
    json_, xml = ch.where("fixes >= 3").select("path", F.round(100.0 * c("fixes") / c("commits"), 2).alias("pct"), F.lit(0).alias("prio")), ch.where("authors < commits").select("path", F.round(100.0 * c("authors") / c("commits"), 2).alias("pct"), F.lit(1).alias("prio"))
    every = json_.unionByName(xml).unionByName(ch.select("path", F.lit(0.0).alias("pct"), F.lit(2).alias("prio")))
    return every.groupBy("path").agg(F.min_by("pct", "prio").alias("pct"), F.min("prio").alias("prio"))


@operator("snk_upsert", "SELECT path, name, value FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY run_id DESC) AS k FROM run_metrics) s WHERE k = 1")
def snk_upsert(v: Views) -> DataFrame:
    order = Window.partitionBy("path", "name").orderBy(F.desc("run_id"))
    return v.run_metrics.withColumn("k", F.row_number().over(order)).where("k = 1").select("path", "name", "value")


@operator("snk_sarif", """
SELECT DISTINCT substr(sha256(rule || ':' || path || ':' || CAST(run_id AS VARCHAR)), 1, 16) AS fingerprint, rule, level FROM (
  SELECT 'complexity' AS rule, path, run_id, 'error' AS level FROM run_metrics WHERE name = 'complexity' AND value > 300
  UNION ALL SELECT 'coupling', path, run_id, 'warning' FROM run_metrics WHERE name = 'coupling' AND value > 90
  UNION ALL SELECT 'hotspot', path, run_id, 'note' FROM run_metrics WHERE name = 'hotspot_score' AND value > 100) f""")
def snk_sarif(v: Views) -> DataFrame:
    m = v.run_metrics
    kinds = (("complexity", "complexity", 300, "error"), ("coupling", "coupling", 90, "warning"), ("hotspot", "hotspot_score", 100, "note"))
    rule = F.coalesce(*(F.when((c("name") == n) & (c("value") > top), F.struct(F.lit(r).alias("rule"), F.lit(lv).alias("level"))) for r, n, top, lv in kinds))
    f = m.select("path", "run_id", rule.alias("f")).where("f is not null").select("path", "run_id", "f.*")
    return f.select(K.fingerprint(c("rule"), c("path"), c("run_id").cast("string")).alias("fingerprint"), "rule", "level").dropDuplicates()


@operator("snk_gha", """
SELECT event_id, '::' || event_type || ' file=' || CAST(user_id AS VARCHAR) || '::' || replace(replace(replace(props, '%', '%25'), ':', '%3A'), ',', '%2C') AS line FROM events""")
def snk_gha(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.concat(F.lit("::"), c("event_type"), F.lit(" file="), c("user_id").cast("string"), F.lit("::"), K.escape_annotation(c("props"))).alias("line"))


@operator("snk_batch", """
SELECT 'file' AS kind, path AS key, CAST(count(*) AS DOUBLE) AS value FROM run_files GROUP BY path
UNION ALL SELECT 'dependency', CAST(dep AS VARCHAR), CAST(count(DISTINCT path) AS DOUBLE) FROM run_files GROUP BY dep
UNION ALL SELECT 'layer', layer, CAST(count(DISTINCT commit_id) AS DOUBLE) FROM run_files GROUP BY layer""")
def snk_batch(v: Views) -> DataFrame:
    r = v.run_files
    files = r.groupBy(c("path").alias("key")).agg(F.count("*").cast("double").alias("value")).withColumn("kind", F.lit("file"))
    deps = r.groupBy(c("dep").cast("string").alias("key")).agg(F.countDistinct("path").cast("double").alias("value")).withColumn("kind", F.lit("dependency"))
    layers = r.groupBy(c("layer").alias("key")).agg(F.countDistinct("commit_id").cast("double").alias("value")).withColumn("kind", F.lit("layer"))
    return files.unionByName(deps).unionByName(layers).select("kind", "key", "value")
