"""Audit of distinct targets by an outside judge, with a cache that grows."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct targets that the cache (t, v) lacks."""
    return targets.select(F.col("target").alias("t")).distinct().join(cache.select("t"), "t", "left_anti")


def retried(call: Callable, texts: list[str], tries: int = 5, wait: float = 1.0, most: float = 30.0) -> list[str] | None:
    for k in range(tries):
        try:
            return call(texts)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(min(most, wait * 2**k))
    return None


def ask(call: Callable, texts: list[str], **options) -> list[str]:
    """A verdict for each text; a reply of another length is asked again in halves, a single text without reply is ERR."""
    got = retried(call, texts, **options)
    if got is not None and len(got) == len(texts):
        return got
    if len(texts) == 1:
        return ["ERR"]
    half = len(texts) // 2
    return ask(call, texts[:half], **options) + ask(call, texts[half:], **options)


def judged(texts: DataFrame, client: Callable[[], Callable], size: int = 50, **options) -> DataFrame:
    """t, v for texts (t); client makes the judge inside the worker."""

    def run(batches):
        call = client()
        for pdf in batches:
            own = pdf["t"].tolist()
            v = [x for k in range(0, len(own), size) for x in ask(call, own[k : k + size], **options)]
            yield pd.DataFrame({"t": own, "v": v})

    return texts.select("t").mapInPandas(run, "t string, v string")


def with_verdicts(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    return pairs.join(cache.groupBy(F.col("t").alias("target")).agg(F.max("v").alias("v")), "target", "left").withColumn("verdict", F.coalesce("v", F.lit("ERR"))).drop("v")


def flag_rates(checked: DataFrame, by: str) -> DataFrame:
    return checked.groupBy(by).agg(F.avg((F.col("verdict") == "YES").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
