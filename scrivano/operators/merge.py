"""Real and synthetic pairs into one set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import corruption as C
from ..functions import text as X
from ..functions.profile import TIBETAN, WS, ScriptProfile
from .rank import sample


def merge_reason(structure: bool = True):
    """Why a real pair is not merged, first match; null if it is."""
    s, t = F.col("source"), F.col("target")
    r = F.when(s.isNull() | t.isNull(), "null").when(s == t, "identical").when(F.col("diff_category").isin("large_rewrite", "multi_edit", "punctuation_only"), "category")
    r = r.when(~(X.is_script(s) & X.is_script(t)), "script").when(t.rlike("[\\u0F83\\u0F82\\u0F84-\\u0F87\\u0F88-\\u0F8B]"), "mantra").when(s.rlike("[\\u0F20-\\u0F33]") | t.rlike("[\\u0F20-\\u0F33]"), "digits").when(s.rlike("[◌×]") | t.rlike("[◌×]"), "placeholder")
    return r.when(~F.forall(X.syllables(sub_terminators(t)), C.well_formed), "structure") if structure else r


def sub_terminators(x, p: ScriptProfile = TIBETAN):
    return X.sub(x, f"[{p.terminators}]|{WS}", "་" if p is TIBETAN else " ")


def row_ids(pairs: DataFrame) -> DataFrame:
    short = F.substring(F.md5(F.concat_ws(":", F.col("page_id"), F.col("segment_idx").cast("string"))), 1, 12)
    return pairs.withColumn("doc_id", F.col("page_id")).withColumn("source_sentence_id", F.concat(F.lit("real:"), short))


def merge(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Kept real pairs and synthetic pairs in one schema; a synthetic pair counts its one corruption."""
    r = row_ids(real.withColumn("why__", merge_reason()).filter("why__ is null").drop("why__"))
    r = r.select("source", "target", F.col("diff_category").alias("corruption_types"), F.lit(1).alias("n_corruptions"), F.lit("real").alias("source_corpus"), "doc_id", "source_sentence_id")
    s = synthetic.withColumn("corruption_types", F.col("corruption_type")).withColumn("n_corruptions", F.lit(1)).drop("corruption_type")
    return r.unionByName(s, allowMissingColumns=True)


def upper_median_length(df: DataFrame) -> DataFrame:
    """By source the element at n // 2 of the sorted target lengths; lengths are few, so counts of them are ranked."""
    from pyspark.sql import Window

    n = df.groupBy("source_corpus", F.length("target").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source_corpus")
    t = n.withColumn("upto", F.sum("n").over(w.orderBy("len"))).withColumn("total", F.sum("n").over(w))
    return t.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("source_corpus").agg(F.min("len").alias("median_len"))


def real_set(differing: DataFrame, identical: DataFrame, flagged: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Differing pairs of kept categories whose target is not flagged (target, verdict incorrect or YES), with n
    identical pairs of middle length."""
    bad = flagged.filter(F.lower("verdict").isin("incorrect", "yes")).select("target").distinct()
    d = differing.filter(~F.col("diff_category").isin("large_rewrite", "multi_edit", "punctuation_only") & X.is_script(F.col("source")) & X.is_script(F.col("target"))).join(bad, "target", "left_anti").withColumn("pair_type", F.lit("differing"))
    t = F.col("target")
    i = identical.filter(X.is_script(t) & ~t.rlike("[\\u0F20-\\u0F33]") & F.length(t).between(10, 200))
    return d.unionByName(sample(i, n, t, seed).withColumn("pair_type", F.lit("identical")), allowMissingColumns=True)


def convention_map(targets: DataFrame, p: ScriptProfile = TIBETAN) -> DataFrame:
    """syllable, plain of syllables with an anusvara whose spelt-out form is a syllable of the targets too, or that end in ཌ."""
    seen = targets.select(F.explode(X.syllables(sub_terminators(F.col("target"), p), p)).alias("syllable")).distinct()
    spelt = seen.withColumn("plain", F.when(F.contains("syllable", F.lit("ཾ")), F.replace("syllable", F.lit("ཾ"), F.lit("མ"))).when(F.contains("syllable", F.lit("ཌ")), F.replace("syllable", F.lit("ཌ"), F.lit("གས"))))
    known = spelt.filter("plain is not null").join(seen.withColumnRenamed("syllable", "plain"), "plain", "left_semi")
    return known.unionByName(spelt.filter(F.contains("syllable", F.lit("ཌ")))).distinct().select("syllable", "plain")


def normalize_conventions(df: DataFrame, mapping: DataFrame, column: str = "target", key: str = "row_id") -> DataFrame:
    """df with the column in plain spelling, by a join on syllables; key is unique."""
    t = df.select(key, F.posexplode(F.split(column, "་", -1)).alias("pos", "syllable")).join(mapping, "syllable", "left")
    t = t.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("plain", "syllable").alias("s")))), lambda x: x["s"]), "་").alias("plain__"))
    return df.join(t, key).withColumn(column, F.col("plain__")).drop("plain__")


def synthesize(sentences: DataFrame, n: int, seed: int = 42, homophones=None, verbs=None, p: ScriptProfile = TIBETAN, check=None) -> DataFrame:
    """sentence, source_corpus -> source, target, corruption_type, source_corpus, source_sentence_id, reject_reason (null for the
    kept); at most n kept of each corpus, in hash order."""
    from pyspark.sql import Window

    own = sentences.select("source_corpus", F.col("sentence").alias("target")).distinct()
    own = own.withColumn("syl", F.filter(X.syllables_all(F.col("target"), p), lambda x: x != "")).filter(F.size("syl") >= 2)
    t = own.withColumn("c", C.corrupt(F.col("syl"), seed, F.col("target"), homophones, verbs))
    joint = "་" if p is TIBETAN else " "
    t = t.withColumn("source", F.array_join("c.syllables", joint))
    fine = F.forall(F.array_except("c.syllables", "syl"), lambda x: (x == "") | (check or C.well_formed)(x))
    why = F.when(F.size("c.syllables") == 0, "no_change").when(F.col("source") == F.array_join("syl", joint), "identical").when(~fine, "malformed")
    t = t.select("source", "target", F.col("c.type").alias("corruption_type"), "source_corpus", F.concat_ws(":", "source_corpus", F.substring(F.md5("target"), 1, 12)).alias("source_sentence_id"), why.alias("reject_reason"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col("target")), "target"
    gone, part = F.col("reject_reason").isNotNull(), F.pmod(F.xxhash64("target"), F.lit(256))
    for share in (part, F.when(gone, part)):  # the first n of parts of a corpus, then of those of all parts
        w = Window.partitionBy("source_corpus", gone, share).orderBy(*order)
        t = t.withColumn("k", F.row_number().over(w)).filter(gone | (F.col("k") <= n)).drop("k")
    return t
