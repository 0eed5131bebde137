"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % m


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label, text of at most `rows` labelled documents whose id passes learn (over doc_id), chosen by a hash of the id.

    The chosen ids are at most `rows`, so they are broadcast to the scan of docs. A document with several labels takes the
    largest; null labels are left out.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().filter(learn)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.join(F.broadcast(own), "doc_id").select("label", "text")
