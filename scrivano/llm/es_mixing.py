"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u in (0, 1) from a hash of its id and gets the key -ln(u) / weight, weight being its quality; taking
documents by ascending key is weighted sampling without replacement. A source's target is reached by complete epochs of
all its documents and then a fraction: the documents whose prefix sums of words, in key order, stay within the rest.

No source is sorted in one task. Keys fall in buckets by their distribution function, a mixture over the weights that there
are, so buckets are even whatever the weights; word sums of buckets are summed up by source, and only the one bucket of each
source that the budget cuts is sorted. Its documents are taken while the middle of
their span of words is within the budget, so the mix ends at most half a document from its target.

Targets are min(level * weight, cap * size) with the level at which they share all words: what resharing the excess by
weight comes to. This is computed over one row a source.

Nulls, ties, repeats: a null text has size 0; a null source is a source, the last; a null id draws as the text "null"; equal
keys are ordered by id and size; repeated rows count each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Marks of layout and shouting; documents made of them weigh less.
MARKS = r"[!|%$&*#]"


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.05, by the share of marks."""
    n = F.length(text)
    marks = n - F.length(F.regexp_replace(text, MARKS, ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * marks / n)).otherwise(F.lit(1.0))


def uniform(id_col: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size. Adds weight and target. One row a source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("top", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("top") / F.col("weight") >= F.col("level"), F.struct((F.col("top") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(all_rows)["level"]
    return t.withColumn("water", level).select("source", "source_size", "weight", F.least(F.col("water") * F.col("weight"), F.col("top")).alias("target"))


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, weight: Column | None = None, bucket_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, selected, taken for every row, with the columns of keep.

    weight: a positive column; by default quality_weight of the text. bucket_rows: about the rows that are sorted together.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = quality_weight(text) if weight is None else weight
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(uniform(F.col(id_col).cast("long"), seed)) / given).alias("key"), F.floor(F.log2(given) * 2).cast("int").alias("octave"), *keep)
    words = materialize(words, "sizes")
    # weights by half octaves: a few rows, and no more than doubles have
    octaves = words.groupBy("octave").agg(F.count(F.lit(1)).alias("n")).dropna().orderBy("octave").collect()
    rows = sum(r["n"] for r in octaves)
    buckets = max(16, rows // bucket_rows)
    below = F.lit(0.0)
    for r in octaves:
        below = below + F.lit(r["n"] / rows) * (F.lit(1.0) - F.exp(-F.col("key") * F.lit(2.0 ** (r["octave"] / 2 + 0.25))))
    words = words.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(below * buckets))).drop("octave")
    sums = words.groupBy("source", "bucket").agg(F.sum("size").alias("m"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("m").alias("source_size")), cap, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("m").over(upto) - F.col("m"))
    plan = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = materialize(plan.select("source", "bucket", "source_size", "target", "epochs", (F.col("rest") - F.col("before")).alias("budget"), "m"), "plan")
    # (source, bucket) is never null after coalescing, so the join is a plain equi-join
    named = (F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "bucket")
    right = plan.select(*named, "source_size", "target", "epochs", "budget", "m")
    left = words.select(*words.columns, *named[:2])
    joined = join_small(left, right, ["none", "src", "bucket"], "inner", plan.count(), 256).drop("none", "src")
    cut = (F.col("budget") > 0) & (F.col("budget") < F.col("m"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = joined.filter(cut).withColumn("selected", F.sum("size").over(inside) - F.col("size") / 2 <= F.col("budget"))
    full = joined.filter(~cut).withColumn("selected", F.col("budget") >= F.col("m"))
    out = full.unionByName(part)
    taken = F.col("epochs") * F.col("size") + F.when(F.col("selected"), F.col("size")).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("selected") & (F.col("size") > 0)).alias("selected"), taken.cast("long").alias("taken"), *keep)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: once an epoch, and once more if selected."""
    taken = mix(docs.withColumn("row__", F.struct(*docs.columns)), keep=("row__",), **options)
    times = (F.col("epochs") + F.col("selected").cast("long")).cast("int")
    return taken.select(F.explode(F.array_repeat("row__", times)).alias("r")).select("r.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (CASE WHEN length(coalesce(text, '')) > 0 THEN greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[!|%$&*#]', '', 'g')))::DOUBLE / length(text)::DOUBLE) ELSE 1.0::DOUBLE END) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE) AS level FROM w),
l AS (SELECT arg_min(level, top / weight) AS water FROM f WHERE top / weight >= level),
t AS (SELECT source, source_size, least(water * weight, top) AS target FROM f, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 <= e.target - e.epochs * e.source_size AS selected
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN selected THEN size ELSE 0 END)::BIGINT AS taken FROM p
"""
