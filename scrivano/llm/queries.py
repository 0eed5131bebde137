"""The thin queries over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_schema, compact_windows, decontam_sw, es_mixing, golomb_dedup, pst_lm, quality_fm, simhash_vp, token_orc, toxicity_automata
from .common import join_small, materialize, table
from .labelled import remainder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query(EXACT_SQL)
def op6_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_digest(token_orc.tokens_table(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0))


@query(es_mixing.ORACLE_SQL)
def op9_es_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(chat_schema.ORACLE_SQL)
def op10_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return chat_schema.digest(chat_schema.parse(materialize(chat_schema.format_rows(turns), "chats")))


@query()
def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    out = quality_fm.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op3_automata_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_automata.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    out = toxicity_automata.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op5_vp_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.simhash_components(table(spark, sf_dir, "documents"), bits=4, words=4)


@query()
def op2_pst_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst_lm.pst_scores(table(spark, sf_dir, "documents"))


@query()
def op7_sw_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_sw.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(compact_windows.passages(table(spark, sf_dir, "documents")), "found")
    named = materialize(compact_windows.classes(found), "named")
    return join_small(found, named, ["doc_id"], "left", named.count(), 32).select(*found.columns, F.coalesce("class_id", "doc_id").alias("class_id"))
