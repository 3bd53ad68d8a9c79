"""Queries of the scalar functions, over the views that carry their arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import operator
from ..views import Views
from . import classify as K
from . import formulas as M
from . import text as X

c = F.col
_CHURN = "CASE WHEN commits > 0 THEN least(greatest(1.0 + 0.10*ln(1+commits) + 0.20*ln(1+fixes) + 0.05*ln(1+authors), 1.0), 2.0) ELSE 1.0 END"
_IMPACT = f"complexity * ln(exp(1.0) + coupling) * (CASE WHEN path % 7 = 0 THEN 2.0 ELSE 1.0 END) * ({_CHURN})"
_EFFORT = "CASE WHEN complexity = 0 AND coupling = 0 THEN 1.0 ELSE greatest(1.0, least(round(greatest(5.0, 3*complexity + 2.5*coupling)), CAST(loc AS DOUBLE))) END"


def _impact():
    return M.impact(c("complexity"), c("coupling"), c("path") % 7 == 0, M.churn_multiplier(c("commits"), c("fixes"), c("authors")))


@operator("mat_churnmult", f"SELECT path, round({_CHURN}, 6) AS churn_mult FROM modules")
def mat_churnmult(v: Views) -> DataFrame:
    return v.modules.select("path", F.round(M.churn_multiplier(c("commits"), c("fixes"), c("authors")), 6).alias("churn_mult"))


@operator("mat_impact", f"SELECT path, round({_IMPACT}, 4) AS impact FROM modules")
def mat_impact(v: Views) -> DataFrame:
    return v.modules.select("path", F.round(_impact(), 4).alias("impact"))


@operator("mat_sigmoid", f"""
SELECT path, round(1/(1+exp(-least(greatest(-1.0 + 0.1*({_IMPACT}) + 0.5*(1 - CAST(fixes AS DOUBLE)/greatest(commits, 1)), -20.0), 20.0))), 6) AS p_defect FROM modules""")
def mat_sigmoid(v: Views) -> DataFrame:
    rate = c("fixes").cast("double") / F.greatest(c("commits"), F.lit(1))
    return v.modules.select("path", F.round(M.defect_probability(_impact(), rate), 6).alias("p_defect"))


@operator("mat_diffconf", """
SELECT path, run_id, round(0.9 / (1 + 0.1*abs(delta)), 6) AS confidence FROM (
  SELECT path, run_id, value - lag(value) OVER (PARTITION BY path ORDER BY run_id) AS delta FROM run_metrics WHERE name = 'complexity') d
WHERE delta IS NOT NULL""")
def mat_diffconf(v: Views) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("run_id")
    d = v.run_metrics.where("name = 'complexity'").withColumn("delta", c("value") - F.lag("value").over(order)).where("delta is not null")
    return d.select("path", "run_id", F.round(M.diff_confidence(F.lit(0.9), c("delta")), 6).alias("confidence"))


@operator("mat_riskprofile", """
SELECT path, round(45e-2*least(4*complexity, 100.0) + 30e-2*least(10*coupling, 100.0)
  + 25e-2*coalesce(CASE WHEN fixes > 0 THEN least(greatest(100 - 100e0*fixes/commits, 0.0), 100.0) END, 80.0), 5) AS risk FROM modules""")
def mat_riskprofile(v: Views) -> DataFrame:
    coverage = F.when(c("fixes") > 0, 100.0 * c("fixes") / c("commits"))
    return v.modules.select("path", F.round(M.risk_profile(c("complexity"), c("coupling"), coverage), 5).alias("risk"))


@operator("mat_priority", """
SELECT path, CASE WHEN w >= 75 THEN 'CRITICAL' WHEN w >= 50 THEN 'HIGH' WHEN w >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM (SELECT path, complexity * 2 * (CASE WHEN fixes > 4 THEN 1.2 WHEN fixes < 2 THEN 0.8 ELSE 1.0 END) AS w FROM modules) s""")
def mat_priority(v: Views) -> DataFrame:
    kind = F.when(c("fixes") > 4, "high").when(c("fixes") < 2, "low").otherwise("normal")
    return v.modules.select("path", M.priority(c("complexity") * 2, kind).alias("priority"))


@operator("mat_instability", """
SELECT id, CASE WHEN ca + ce > 0 THEN round(ce / CAST(ca + ce AS DOUBLE), 3) ELSE 0.0 END AS instability FROM (
  SELECT n.id, coalesce(i.ca, 0) AS ca, coalesce(o.ce, 0) AS ce FROM nodes n
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS ca FROM edges GROUP BY dst) i ON i.dst = n.id
  LEFT JOIN (SELECT src, count(DISTINCT dst) AS ce FROM edges GROUP BY src) o ON o.src = n.id) s""")
def mat_instability(v: Views) -> DataFrame:
    from ..operators.aggregates import coupling

    return coupling(v.nodes, v.edges).select("id", M.instability(c("ca"), c("ce")).alias("instability"))




@operator("mat_distance", """
SELECT path, round(abs(a + i - 1), 3) AS distance,
  CASE WHEN round(abs(a + i - 1), 3) <= 0.35 THEN 'MAIN_SEQUENCE' WHEN a + i < 1 THEN 'PAIN' ELSE 'USELESSNESS' END AS zone
FROM (SELECT path, round(CAST(fixes AS DOUBLE) / greatest(commits, 1), 2) AS a, round(coupling / (coupling + complexity), 3) AS i FROM modules) s""")
def mat_distance(v: Views) -> DataFrame:
    s = v.modules.select("path", F.round(c("fixes") / F.greatest(c("commits"), F.lit(1)), 2).alias("a"), F.round(c("coupling") / (c("coupling") + c("complexity")), 3).alias("i"))
    return s.select("path", M.main_sequence_distance(c("a"), c("i")).alias("distance"), M.zone(c("a"), c("i")).alias("zone"))


@operator("mat_effort", f"SELECT path, {_EFFORT} AS effort FROM modules")
def mat_effort(v: Views) -> DataFrame:
    return v.modules.select("path", M.effort(c("complexity"), c("coupling"), c("loc")).alias("effort"))


@operator("mat_roi", f"""
SELECT path, round((0.6*coupling + 0.4*complexity) * loc / ({_EFFORT}) * 10, 2) AS roi,
  round(CASE WHEN complexity > 4 THEN least(75.0, (complexity - 4)/complexity*100) ELSE 0.0 END, 1) AS reduction FROM modules""")
def mat_roi(v: Views) -> DataFrame:
    return v.modules.select("path", M.roi(c("complexity"), c("coupling"), c("loc"), c("loc")).alias("roi"), M.reduction_percent(c("complexity")).alias("reduction"))


@operator("mat_costred", """
SELECT path, round(least(greatest(100*(1 - 10/greatest(1.0, complexity*coupling)), 0.0), 75.0), 1) AS reduction FROM modules""")
def mat_costred(v: Views) -> DataFrame:
    return v.modules.select("path", M.cost_reduction(c("complexity"), c("coupling")).alias("reduction"))


@operator("mat_outcome", """
SELECT path, run_id, round(actual, 2) AS actual, round(actual - 10, 2) AS variance, abs(actual - 10) <= 15 AS accurate FROM (
  SELECT path, run_id, CASE WHEN before > 0 THEN least(greatest((before - value)/before*100, -100.0), 100.0) ELSE 0.0 END AS actual FROM (
    SELECT path, run_id, value, lag(value) OVER (PARTITION BY path ORDER BY run_id) AS before FROM run_metrics WHERE name = 'hotspot_score') a
  WHERE before IS NOT NULL) b""")
def mat_outcome(v: Views) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("run_id")
    d = v.run_metrics.where("name = 'hotspot_score'").withColumn("before", F.lag("value").over(order)).where("before is not null")
    return d.select("path", "run_id", M.outcome(c("before"), c("value"), F.lit(10.0)).alias("o")).select("path", "run_id", "o.*")


@operator("mat_prodscore", "SELECT doc_id, CAST(quality AS DOUBLE) * toxic * size AS score FROM rated")
def mat_prodscore(v: Views) -> DataFrame:
    return v.rated.select("doc_id", M.product_score(c("quality").cast("double"), c("toxic"), c("size")).alias("score"))


@operator("mat_dynrisk", """
SELECT path, round(r, 4) AS risk, CASE WHEN r >= 70 THEN 'HIGH' WHEN r >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM (SELECT path, least(100.0, 10*complexity*(1 + 0.1*coupling)) AS r FROM modules) s""")
def mat_dynrisk(v: Views) -> DataFrame:
    r = M.dynamic_risk(c("complexity"), c("coupling"))
    return v.modules.select("path", F.round(r, 4).alias("risk"), F.when(r >= 70, "HIGH").when(r >= 30, "MEDIUM").otherwise("LOW").alias("tier"))


@operator("mat_watchimpact", """
SELECT path, 0.5*complexity + 1.5*coupling AS impact, CASE WHEN 0.5*complexity + 1.5*coupling >= 10 THEN 'HIGH' WHEN 0.5*complexity + 1.5*coupling >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM modules""")
def mat_watchimpact(v: Views) -> DataFrame:
    i = M.watch_impact(c("complexity"), c("coupling"))
    return v.modules.select("path", i.alias("impact"), F.when(i >= 10, "HIGH").when(i >= 5, "MEDIUM").otherwise("LOW").alias("level"))


@operator("mat_recconf", "SELECT path, least(greatest(50 + 0.25*complexity + 0.25*coupling + 10*least(2, fixes), 50.0), 95.0) AS confidence FROM modules")
def mat_recconf(v: Views) -> DataFrame:
    return v.modules.select("path", M.recommendation_confidence(c("complexity"), c("coupling"), c("fixes")).alias("confidence"))


@operator("mat_healthband", """
SELECT run_id, CASE WHEN health >= 85 THEN 'EXCELLENT' WHEN health >= 60 THEN 'GOOD' WHEN health >= 30 THEN 'FAIR' ELSE 'POOR' END AS band FROM snapshots""")
def mat_healthband(v: Views) -> DataFrame:
    return v.snapshots.select("run_id", M.health_band(c("health")).alias("band"))


@operator("mat_conseq", """
SELECT path, round((1 + authors) * ln(exp(1.0) + coupling) * complexity * (CASE fixes % 4 WHEN 0 THEN 3.5 WHEN 1 THEN 1.8 WHEN 2 THEN 0.5 ELSE 1.0 END) * 0.9, 3) AS consequence FROM modules""")
def mat_conseq(v: Views) -> DataFrame:
    goal = F.element_at(F.array(*(F.lit(x) for x in ("primary", "related", "distant", "none"))), (c("fixes") % 4 + 1).cast("int"))
    return v.modules.select("path", M.consequence(c("authors"), c("coupling"), c("complexity"), goal, F.lit(0.9)).alias("consequence"))


@operator("mat_pledge", """
SELECT a.path, b.value <= a.value AND d.value <= e.value AS kept FROM run_metrics a
JOIN run_metrics b ON b.path = a.path AND b.run_id = a.run_id + 1 AND b.name = 'complexity'
JOIN run_metrics d ON d.path = a.path AND d.run_id = a.run_id + 1 AND d.name = 'coupling'
JOIN run_metrics e ON e.path = a.path AND e.run_id = a.run_id AND e.name = 'coupling'
WHERE a.name = 'complexity'""")
def mat_pledge(v: Views) -> DataFrame:
    wide = v.run_metrics.groupBy("run_id", "path").pivot("name", ["complexity", "coupling"]).agg(F.first("value"))
    after = wide.select((c("run_id") - 1).alias("run_id"), "path", c("complexity").alias("complexity_after"), c("coupling").alias("coupling_after"))
    return wide.join(after, ["run_id", "path"]).select("path", ((c("complexity_after") <= c("complexity")) & (c("coupling_after") <= c("coupling"))).alias("kept"))


_HEX = "substr(sha256(CAST(page_id AS VARCHAR)), {}, 6)"


def _lum(col: str) -> str:
    ch = lambda i: f"(SELECT CASE WHEN x <= 0.03928 THEN x/12.92 ELSE pow((x + 0.055)/1.055, 2.4) END FROM (SELECT CAST('0x' || substr({col}, {i}, 2) AS INTEGER)/255.0 AS x))"
    return f"(0.2126*{ch(1)} + 0.7152*{ch(3)} + 0.0722*{ch(5)})"


@operator("mat_luminance", f"""
SELECT page_id, round((greatest(x, y) + 0.05)/(least(x, y) + 0.05), 4) AS contrast FROM (
  SELECT page_id, {_lum('a')} AS x, {_lum('b')} AS y FROM (SELECT page_id, {_HEX.format(1)} AS a, {_HEX.format(7)} AS b FROM pages) p) q""")
def mat_luminance(v: Views) -> DataFrame:
    h = F.sha2(c("page_id").cast("string").cast("binary"), 256)
    return v.table("pages").select("page_id", F.round(M.contrast_ratio(F.substring(h, 1, 6), F.substring(h, 7, 6)), 4).alias("contrast"))


# strings, hashes, arrays


@operator("str_fingerprint", "SELECT page_id, substr(sha256(upper(path) || ':' || lower(url)), 1, 16) AS fingerprint FROM paths")
def str_fingerprint(v: Views) -> DataFrame:
    return v.paths.select("page_id", K.fingerprint(F.upper("path"), F.lower("url")).alias("fingerprint"))


@operator("str_evidenceid", "SELECT page_id, 'ev-' || substr(sha256('page:' || path || ':' || CAST(page_id AS VARCHAR)), 1, 14) AS evidence_id FROM paths")
def str_evidenceid(v: Views) -> DataFrame:
    return v.paths.select("page_id", F.concat(F.lit("ev-"), K.fingerprint(F.lit("page"), c("path"), c("page_id").cast("string"), length=14)).alias("evidence_id"))


@operator("str_snapid", "SELECT run_id, 'snap_' || CAST(run_id AS VARCHAR) || '_' || substr(sha256(CAST(run_id AS VARCHAR) || ':' || CAST(modules AS VARCHAR)), 1, 8) AS snapshot_id FROM snapshots")
def str_snapid(v: Views) -> DataFrame:
    run = c("run_id").cast("string")
    return v.snapshots.select("run_id", F.concat(F.lit("snap_"), run, F.lit("_"), K.fingerprint(run, c("modules").cast("string"), length=8)).alias("snapshot_id"))


@operator("str_escape", "SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS escaped FROM documents")
def str_escape(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.sha2(K.escape_annotation(c("text")).cast("binary"), 256).alias("escaped"))


@operator("str_uri", "SELECT page_id, regexp_replace(url, '^(https?:)?//', '') AS uri FROM pages")
def str_uri(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.regexp_replace("url", "^(https?:)?//", "").alias("uri"))


@operator("str_loc", r"""
SELECT doc_id, len(s) AS physical, len(list_filter(s, lambda x: trim(x) <> '')) AS filled, len(list_filter(s, lambda x: trim(x) LIKE '#%')) AS comments
FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d""")
def str_loc(v: Views) -> DataFrame:
    n = X.line_counts(c("text"))
    return v.table("documents").select("doc_id", n.alias("n")).select("doc_id", "n.*")


_HIDDEN, _PLAIN = r'"[^"\n]*"|<!--[^>]*-->', r'[^"<]+'


@operator("str_mask", rf"""
SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '(?:{_HIDDEN})|(?:{_PLAIN})|(?s:.)'), lambda x: CASE WHEN regexp_full_match(x, '{_HIDDEN}') THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END), '')) AS masked, length(html) AS size FROM pages""")
def str_mask(v: Views) -> DataFrame:
    """Strings and comments as blanks; lengths and line feeds stay."""
    hidden = X.masked(c("html"), _HIDDEN, _PLAIN)
    return v.table("pages").select("page_id", F.md5(hidden.cast("binary")).alias("masked"), F.length(hidden).cast("long").alias("size"))


@operator("str_glob", "SELECT page_id, regexp_matches(path, '^.*[.]example[.]com/..?/.*$') AS matches FROM paths")
def str_glob(v: Views) -> DataFrame:
    return v.paths.select("page_id", (X.glob(c("path"), "*.example.com/??/*") | X.glob(c("path"), "*.example.com/?/*")).alias("matches"))


@operator("str_version", """
SELECT page_id, list_transform(string_split(CAST(page_id % 3 AS VARCHAR) || '.' || CAST(page_id % 11 AS VARCHAR), '.'), lambda x: CAST(x AS INTEGER)) >= [1, 4] AS readable FROM pages""")
def str_version(v: Views) -> DataFrame:
    version = F.concat((c("page_id") % 3).cast("string"), F.lit("."), (c("page_id") % 11).cast("string"))
    return v.table("pages").select("page_id", X.at_least_version(version, "1.4").alias("readable"))


@operator("str_mutate", """
SELECT page_id, sha256(m) AS digest FROM (
  SELECT DISTINCT page_id, unnest([path, lower(path), upper(path), './' || path, '/' || path, replace(path, '/', '\\'), path || '/', string_split(path, '/')[-1]]) AS m FROM paths) s""")
def str_mutate(v: Views) -> DataFrame:
    return v.paths.select("page_id", F.explode(X.path_mutations(c("path"))).alias("m")).distinct().select("page_id", F.sha2(c("m").cast("binary"), 256).alias("digest"))


@operator("str_attrchain", "SELECT page_id, string_split(path, '.')[1] AS base, array_to_string(string_split(path, '.')[2:], '.') AS attrs FROM paths")
def str_attrchain(v: Views) -> DataFrame:
    parts = F.split("path", r"\.")
    return v.paths.select("page_id", parts[0].alias("base"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".").alias("attrs"))


def _hmac_sql(text: str, key: str) -> str:
    inner, outer = ("".join(f"{x ^ pad:02x}" for x in key.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


@operator("str_scramble", f"""
SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9_]{{9,}}') THEN '$SYM_' || left({_hmac_sql("x", "salt")}, 8) ELSE x END), '') AS scrambled FROM benchmark""")
def str_scramble(v: Views) -> DataFrame:
    """Whole words of nine letters or more stand for secret names, and become keyed tokens."""
    return v.table("benchmark").select("item_id", X.scramble_words(c("text"), lambda w: w.rlike("^[A-Za-z0-9_]{9,}$"), "salt").alias("scrambled"))


@operator("str_sigrender", """
SELECT l_orderkey AS caller, array_to_string(list_sort(list_distinct(list(p_type)))[1:20], ', ') AS signature FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def str_sigrender(v: Views) -> DataFrame:
    return v.calls.groupBy("caller").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 20), ", ").alias("signature"))


@operator("arr_sortset", "SELECT commit_id, array_to_string(list_transform(list_sort(list_distinct(list(path))), lambda x: CAST(x AS VARCHAR)), ',') AS files FROM touches GROUP BY commit_id")
def arr_sortset(v: Views) -> DataFrame:
    return v.touches.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"))


@operator("map_pivot", """
SELECT run_id, path, max(value) FILTER (name = 'complexity') AS complexity, max(value) FILTER (name = 'coupling') AS coupling, max(value) FILTER (name = 'hotspot_score') AS hotspot_score
FROM run_metrics GROUP BY run_id, path""")
def map_pivot(v: Views) -> DataFrame:
    return v.run_metrics.groupBy("run_id", "path").pivot("name", ["complexity", "coupling", "hotspot_score"]).agg(F.max("value"))


@operator("jsn_predcfg", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_predcfg(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@operator("dat_window", "SELECT path, count(*) AS commits FROM touches WHERE ts >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY GROUP BY path")
def dat_window(v: Views) -> DataFrame:
    anchor = v.table("orders").agg(F.max("o_orderdate").alias("anchor"))
    recent = v.touches.join(F.broadcast(anchor), c("ts") >= c("anchor") - F.expr("INTERVAL 180 DAYS"))  # one row
    return recent.groupBy("path").agg(F.count("*").alias("commits"))


# complexity by keywords


@operator("cpx_jsproxy", r"""
SELECT page_id, 1 + len(regexp_extract_all(m, '\b(if|for|while|case|catch)\b')) + len(regexp_extract_all(m, '\?')) AS complexity
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '"[^"\n]*"', '""', 'g'), '<!--[^>]*-->', '', 'g') AS m FROM pages) s""")
def cpx_jsproxy(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", X.script_complexity(c("html")).alias("complexity"))


@operator("src_pagetags", r"""
SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS imports, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS definitions FROM pages""")
def src_pagetags(v: Views) -> DataFrame:
    return v.table("pages").select(
        "page_id",
        F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("imports"),
        F.regexp_count("html", F.lit("<[a-zA-Z][^>]*>")).cast("long").alias("definitions"),
    )
