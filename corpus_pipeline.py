"""A training-corpus pipeline made of the llm operators; each stage reads what the one before wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame.  All but the last return the columns of
``docs``, whatever they are besides doc_id, text, lang and source.

* language: documents without any letter (null texts as well), and those in which the network finds no
  language at ``MIN_LANGUAGE_SCORE`` or more, go;
* near_duplicates: of each component of the Jaccard join the document of the smallest id stays, one without an id only
  if there is no other; rows that share an id and a text are copies, those that share an id alone are not; documents without words stay, all of them;
* decontamination: documents that hold an item of ``benchmark`` go, whatever their ids;
* mixing: each document is repeated as often as the mix to target weights takes it, maybe not at all;
* token_records: token ids are written as binary records in order of id, and read back.

Stages that drop documents tell rows apart by id and a 64-bit hash of the text, so that null and repeated ids are no
special case.  A stage handles an empty table by returning an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, filters, jaccard_join, lang_id, mixing, token_records
from quarryline.llm.queries import tokenizer_path
from quarryline.llm.store import materialize, scratch

MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.train(docs, id_column="doc_id", text_column="text", lang_column="lang")
    lang, score = filters.unused("found_lang", docs), filters.unused("found_score", docs)
    found = lang_id.identify(docs, model, pred_column=lang, score_column=score)
    kept = found.where((F.col(lang) != lang_id.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that orders rows by id, those without one last, and tells texts of one id apart; and the key's name."""
    key = filters.unused("row_key", docs)
    none = F.col("doc_id").isNull()
    return docs.withColumn(key, F.struct(none.alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    found = jaccard_join.near_duplicates(rows, id_column=key)
    by_key = found.groupBy(key).agg(F.count("*").alias("rows"), F.max(F.col("component_id") == F.col(key)).alias("stays"), F.max("n_shingles").alias("n_shingles"))
    by_key = materialize(by_key, "pipeline-near-keys")
    kept = filters.drop_ids(rows, by_key.where("not stays").select(key), id_column=key)
    repeated = by_key.where("stays and rows > 1 and n_shingles > 0").select(key)
    kept = kept if repeated.isEmpty() else filters.keep_one(kept, repeated, id_column=key)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=key)
    kept = filters.drop_ids(rows, materialize(leaks.select(key).distinct(), "pipeline-leaks"), id_column=key)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, mixing.mix(docs))


def token_records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.read_records(spark, token_records.write_records(docs, tokenizer=tokenizer_path))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token_records", token_records_stage),
]

#: The network, the sketches and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
