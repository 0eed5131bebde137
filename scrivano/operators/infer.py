"""Correction of texts by a pluggable corrector."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profile import TIBETAN, ScriptProfile
from ..functions.text import collapse_repeats


def chunks(line: str, p: ScriptProfile = TIBETAN) -> list[str]:
    """Parts between terminators, and the runs of terminators."""
    return [x for x in re.split(f"([{p.terminators}]+)", line) if x]


def correct_line(line: str, fix: Callable[[str], str], p: ScriptProfile = TIBETAN) -> str:
    parts, out = chunks(line, p), []
    for i, x in enumerate(parts):
        if re.match(f"[{p.terminators}]", x) or not x.strip():
            out.append(x)
            continue
        y = fix(x)
        if i + 1 < len(parts) and re.match(f"[{p.terminators}]", parts[i + 1]):
            y = re.sub(f"[{p.terminators}]+$", "", y)
        out.append(y)
    return "".join(out)


def correct(df: DataFrame, corrector: Callable[[], Callable[[str], str]], column: str = "text", profile: ScriptProfile = TIBETAN) -> DataFrame:
    """df with prediction: lines and chunks corrected one by one, repeats collapsed. corrector makes the model in the worker."""
    at, schema = df.columns.index(column), df.schema

    def run(batches):
        fix = corrector()
        for pdf in batches:
            done = [None if t is None else "\n".join(correct_line(x, fix, profile) for x in t.split("\n")) for t in pdf.iloc[:, at]]
            yield pdf.assign(prediction=pd.Series(done, index=pdf.index, dtype=object))

    out = df.mapInPandas(run, type(schema)([*schema.fields]).add("prediction", "string"))
    return out.withColumn("prediction", collapse_repeats(F.col("prediction"), profile))
