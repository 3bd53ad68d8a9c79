"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, lang_id, lm_score, mixing, quality, repair, token_records, topk, toxicity, url_filter, whitening
from .store import crc32_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = lm_score.score_documents(docs, crc32_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, embedding, e FROM v WHERE vec_id % 100 = 0) AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = crc32_mod("doc_id", 4) != 2
    model = lang_id.train(docs.where(learned), id_column="doc_id", text_column="text", lang_column="lang")
    out = lang_id.identify(docs, model, keep=["doc_id", (~learned).alias("held_out")])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.inline(F.array(*planted)))
    return chat_format.digest(chat_format.expand(turns.unionByName(planted)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), shown AS (
  SELECT *, '<turn>' || replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\o'), '</turn>', '\c'), chr(10), '\n') || chr(10)
         || replace(replace(replace(text, '\', '\\'), '<turn>', '\o'), '</turn>', '\c') || '</turn>' || chr(10) AS f
  FROM t
), o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(f)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc32_mod("doc_id", 3) != 1))
    out = quality.score(docs, model, keep=["doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path)
    return token_records.read_records(spark, manifest)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc32_mod("doc_id", 4) != 2))
    out = toxicity.score(docs, model, keep=["doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# The rules of the query, and its words for hosts and paths that no rule knows.
OP11_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
OP11_WORDS = ("bets", "betting", "casino", "escorts", "jackpot", "pills", "porn", "viagra", "warez", "xxx")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.site_rule(verdict, site) for verdict, site in OP11_RULES] + [url_filter.pattern_rule("block", f"^{w}^") for w in OP11_WORDS]
    out = url_filter.judge(_table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern")


OP11_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), u AS (
  SELECT row_number() OVER () AS k, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b
), r(verdict, rule) AS (
  VALUES {", ".join(f"('{v}', '{s}')" for v, s in OP11_RULES)}
), w(word) AS (
  VALUES {", ".join(f"('{x}')" for x in OP11_WORDS)}
), s AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY k
), p AS (
  SELECT k, list('^' || word || '^' ORDER BY length(word) DESC, word)[1] AS pattern
  FROM u JOIN w ON regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)')
  GROUP BY k
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(s.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM u LEFT JOIN s USING (k) LEFT JOIN p USING (k)
"""


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the twelfth query, by a checksum of conversation and turn."""
    n = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(n == 4, "user").otherwise(role).alias("role"),
        F.when(n == 1, "").when(n == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(n == 3, 2).when(n == 0, 0).otherwise(1).alias("times"),
    )
    return rows.where("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.repair(damaged(turns), null_text=" "), turns.select("conv_id"))


OP12_SQL = r"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS UBIGINT))),
                         lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * CAST(3988292384 AS UBIGINT)))),
             CAST(4294967295 AS UBIGINT)) % 20 AS n
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, unnest(range(CASE n WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS t(i)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS times
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), rows_ AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM placed
), priced AS (
  -- costs of keeping, by initial, and of another role; a row that must go can do neither
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay FROM rows_
), togo(g, k, h) AS (
  -- costs to go by state: nothing, system, user, assistant
  SELECT DISTINCT g, m + 1, CAST([0, 6, 3, 0] AS BIGINT[]) FROM priced
  UNION ALL
  SELECT g, k, CAST([least(r[1], 3 + r[3], 6 + r[4]), least(r[2], 3 + r[3], 6 + r[4]), least(r[3], 3 + r[4]), least(r[4], 3 + r[3])] AS BIGINT[])
  FROM (
    SELECT p.g, p.k, [least(4 + h[1], stay + CASE initial WHEN 's' THEN h[2] WHEN 'u' THEN h[3] ELSE 1000000000 END, 3 + stay + h[3]),
                      least(4 + h[2], stay + CASE initial WHEN 'u' THEN h[3] ELSE 1000000000 END, 3 + stay + h[3]),
                      least(4 + h[3], stay + CASE initial WHEN 'a' THEN h[4] ELSE 1000000000 END, 3 + stay + h[4]),
                      least(4 + h[4], stay + CASE initial WHEN 'u' THEN h[3] ELSE 1000000000 END, 3 + stay + h[3])] AS r
    FROM togo t JOIN priced p ON p.g = t.g AND p.k = t.k - 1
  ) x
), path(g, i, k, state, edit, role, text) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST(1 AS BIGINT), 1, '', '', '' FROM priced
  UNION ALL
  SELECT g, i + 1, CASE WHEN letter = 'I' THEN k ELSE k + 1 END, CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND initial = 's' THEN 2 ELSE after END, letter,
         CASE WHEN letter IN ('K', 'D') THEN role WHEN after = 3 THEN 'user' ELSE 'assistant' END, CASE WHEN letter = 'I' THEN '' ELSE text END
  FROM (
    SELECT f.g, f.i, f.k, f.state, p.initial, p.role, p.text, [3, 3, 4, 3][f.state] AS after,
           CASE WHEN p.g IS NOT NULL AND t.h[f.state] = 4 + n.h[f.state] THEN 'D'
                WHEN t.h[f.state] = 3 + t.h[[3, 3, 4, 3][f.state]] THEN 'I'
                WHEN p.initial = 's' AND f.state = 1 AND t.h[f.state] = p.stay + n.h[2] OR p.initial = ['u', 'u', 'a', 'u'][f.state] AND t.h[f.state] = p.stay + n.h[[3, 3, 4, 3][f.state]] THEN 'K'
                WHEN p.g IS NOT NULL THEN 'R' END AS letter
    FROM path f JOIN togo t ON t.g = f.g AND t.k = f.k LEFT JOIN priced p ON p.g = f.g AND p.k = f.k LEFT JOIN togo n ON n.g = f.g AND n.k = f.k + 1
  ) x WHERE letter IS NOT NULL
), edited AS (
  SELECT g, string_agg(edit, '' ORDER BY i) AS audit, string_agg(role || ':' || text, chr(10) ORDER BY i) FILTER (edit <> 'D') AS repaired FROM path WHERE i > 0 GROUP BY g
), counted AS (
  SELECT any_value(conv_id) AS conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM priced GROUP BY g
), told AS (
  SELECT c.*, t.h[1] AS cost, e.audit, e.repaired FROM counted c JOIN togo t ON t.g = c.g AND t.k = 1 JOIN edited e ON e.g = c.g
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_top_k": op2_top_k,
    "op3_lang_id": op3_lang_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_records": op8_token_records,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_url_filter": op11_url_filter,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {"op2_top_k": OP2_SQL, "op5_chat_format": OP5_SQL, "op11_url_filter": OP11_SQL, "op12_repair": OP12_SQL}
