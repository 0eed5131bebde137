"""A corpus pipeline of five stages over documents; each stage's rows are written and read as the next one's.

The quality stage learns from the labels of the rows that op1 learns from, near-duplicates and contaminated documents go, the
mix repeats documents by its epochs and selection, and the last stage writes token ids as ORC and returns their digest. A
document that the mix takes twice or three times is so many rows, with its id; token offsets then count each.

Nulls, ties, repeats: as the stages' operators say. Of rows alike in id in one near-duplicate group one stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm import decontam_sw, es_mixing, quality_fm, simhash_vp, token_orc
from scrivano.llm.common import drop_path, materialize, recording, table
from scrivano.llm.labelled import remainder
from scrivano.llm.queries import tokenizer_path

#: SQL cannot express the classifier, the tree search and the alignment.
ORACLE_SQL = None


#: By session and input, the tables of the stage that ran last.
_BEFORE: dict[tuple[int, str], list[str]] = {}


def stage(first: bool = False):
    """A stage's own tables go when the next stage begins: its rows have been written by then. Those of the last stage stay."""

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            run = id(spark), sf_dir
            for path in _BEFORE.pop(run, []) if not first else []:
                drop_path(spark, path)
            _BEFORE[run] = []
            with recording(_BEFORE[run]):
                return f(spark, docs, sf_dir)

        return run_stage

    return wrap


@stage(first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more; labels are read with the documents that are there."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality_fm.score(docs, model, name="quality_score__").filter("quality_score__ >= 0.3").select(*docs.columns)


@stage()
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike by 0.8 or more in five-word shingles."""
    return simhash_vp.keep_one(docs, words=5)


@stage()
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam_sw.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return es_mixing.mixed_rows(docs)


@stage()
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC; their digest, read back."""
    return token_orc.token_digest(token_orc.tokens_table(docs, tokenizer_path(), end_id=0))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
