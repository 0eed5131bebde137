"""What a training run reads of the exported pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def load(differing: DataFrame, identical: DataFrame, split: str, most_chars: int | None = None, drop_categories: tuple[str, ...] = (), category: str = "diff_category") -> DataFrame:
    """Rows of a split from both tables, no longer than most_chars on either side; the named categories are left out of training
    only. Rows of `identical` have the category "identical"."""
    same = identical.withColumn(category, F.lit("identical"))
    t = differing.unionByName(same, allowMissingColumns=True).filter(F.col("split") == split)
    if most_chars is not None:
        t = t.filter((F.length("source") <= most_chars) & (F.length("target") <= most_chars))
    if split == "train" and drop_categories:
        t = t.filter(F.col(category).isNull() | ~F.col(category).isin(*drop_categories))
    return t


def composition(rows: DataFrame, category: str = "diff_category") -> DataFrame:
    """Rows and share of each category; the share of "identical" is the identical ratio. One row a category, so its window is small."""
    t = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
