"""Correction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profile import TIBETAN, ScriptProfile
from ..functions.text import cer, metric_syllables
from ..functions.udfs import token_scores


def prf(df: DataFrame, keys: list[str], predicted, target) -> DataFrame:
    """keys (unique) with precision, recall and f1 of two token arrays: place by place, classes weighted by gold support, the
    shorter padded with empty tokens. Two empty arrays give nulls."""
    return df.select(*keys, token_scores(predicted, target).alias("m")).select(*keys, "m.precision", "m.recall", "m.f1")


def evaluate(predictions: DataFrame, category: str, keys: list[str], profile: ScriptProfile = TIBETAN, predicted: str = "prediction", target: str = "target") -> DataFrame:
    """Means by category and overall (category "overall"), most frequent first after the total."""
    scores = prf(predictions, [*keys, category], metric_syllables(F.col(predicted), profile), metric_syllables(F.col(target), profile))
    t = scores.rollup(category).agg(F.grouping(category).alias("g"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n"))
    return t.withColumn(category, F.when(F.col("g") == 1, "overall").otherwise(F.col(category))).orderBy(F.desc("g"), F.desc("n"), category).drop("g")


def error_rates(predictions: DataFrame, predicted: str = "prediction", target: str = "target") -> DataFrame:
    return predictions.withColumn("cer", cer(F.col(predicted), F.col(target)))
