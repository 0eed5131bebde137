"""Caps, duplicates and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import agreed_separator_removal, has_latin, punctuation_subtype
from .splits import RANK_TRAIN_FIRST, rank_of, split_of


def drop_overlength(df: DataFrame, most: int = 380) -> DataFrame:
    return df.filter((F.length("source") <= most) & (F.length("target") <= most))


def dedupe_pairs(df: DataFrame) -> DataFrame:
    """One row for each (source, target): high confidence first, then agreement, then the training side, then input order
    (row_id). By a combining aggregate, so a pair with many copies is no load on one task."""
    order = F.struct((~F.col("high_confidence_error")).alias("a"), (~F.col("both_annotators_agree")).alias("b"), F.coalesce(rank_of(F.col("split"), RANK_TRAIN_FIRST), F.lit(9)).alias("c"), F.col("row_id").alias("d"))
    rest = [c for c in df.columns if c not in ("source", "target")]
    best = df.groupBy("source", "target").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select("source", "target", "r.*").select(*df.columns)


def drop_source_leakage(df: DataFrame) -> DataFrame:
    """A source in several splits stays in the first of train, val, test."""
    r = rank_of(F.col("split"), RANK_TRAIN_FIRST)
    least = df.groupBy("source").agg(F.min(r).alias("least__"))
    return df.join(least, "source").filter(r == F.col("least__")).drop("least__").select(*df.columns)


def enforce_pages(df: DataFrame) -> DataFrame:
    """A page in several splits goes to the first of train, val, test."""
    least = df.groupBy("page_id").agg(F.min(rank_of(F.col("split"), RANK_TRAIN_FIRST)).alias("least__"))
    return df.join(least, "page_id").withColumn("split", split_of(F.col("least__"), RANK_TRAIN_FIRST)).drop("least__").select(*df.columns)


def apply_fixes(pairs: DataFrame, most: int = 380) -> DataFrame:
    """pairs (with identical): cap, duplicates, leakage, pages, duplicates again."""
    t = dedupe_pairs(drop_overlength(pairs, most))
    return dedupe_pairs(enforce_pages(drop_source_leakage(t)))


def drop_latin(df: DataFrame) -> DataFrame:
    return df.filter(~(has_latin(F.col("source")) | has_latin(F.col("target"))))


def drop_agreed_separator_removals(df: DataFrame, profile) -> DataFrame:
    return df.filter(~agreed_separator_removal(F.col("both_annotators_agree"), F.col("source"), F.col("target"), profile))


def drop_punctuation_only(df: DataFrame, profile) -> DataFrame:
    only = (F.col("diff_category") == "punctuation_only") & (punctuation_subtype(F.col("source"), F.col("target"), profile) != "tsheg_within")
    return df.filter(~only)


def duplicates_and_leakage(df: DataFrame) -> DataFrame:
    """One row: rows, distinct pairs, pairs with copies, copies, sources and targets in several splits."""
    pairs = df.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique_pairs"), F.count_if(F.col("n") > 1).alias("n_duplicate_pair_keys"), (F.sum("n") - F.count(F.lit(1))).alias("n_extra_duplicate_rows"))

    def several(c):
        return df.groupBy(c).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"n_{c}s_multi_split"))

    return pairs.crossJoin(several("source")).crossJoin(several("target"))  # one row each


def overlap_types(df: DataFrame) -> DataFrame:
    """Sources by the set of splits they are in, if several."""
    t = df.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("split")), "/").alias("splits"))
    return t.filter(F.contains("splits", F.lit("/"))).groupBy("splits").agg(F.count(F.lit(1)).alias("n"))


def page_violations(df: DataFrame) -> DataFrame:
    return df.groupBy("page_id").agg(F.countDistinct("split").alias("n")).filter("n > 1")
