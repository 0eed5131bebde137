"""Annotation pages to clean pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs
from ..functions.profile import TIBETAN, ScriptProfile
from .splits import assign_splits
from .stored import stored

PAIR_COLUMNS = ["page_id", "segment_idx", "source", "target", "both_annotators_agree", "split", "high_confidence_error", "batch_name", "source_role", "has_brackets"]


def page_id():
    return F.concat_ws("/", F.coalesce("batch_name", F.lit("")), F.coalesce("image_id", F.lit("")))


def once(**columns):
    """Columns computed once, as a generator of one row: filters and Arrow functions above it do not compute them anew."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def unpivot(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each annotator's reading of a page."""
    both = F.array(*[F.struct(F.lit(r).alias("source_role"), F.col(f"{r}_transcript").alias("source_text")) for r in ("annotator_a", "annotator_b")])
    return pages.select(*keep, F.col("final_reviewer_transcript").alias("target_text"), F.explode(both).alias("r")).select(*keep, "target_text", "r.*")


def page_pairs(pages: DataFrame, require_diff: bool = True) -> DataFrame:
    """Whole-page pairs in long form."""
    t = unpivot(pages, "batch_name", "task_id", "image_id", "state").withColumn("source", X.null_marker(F.col("source_text"))).withColumn("target", X.null_marker(F.col("target_text"))).drop("source_text", "target_text")
    t = t.dropna(subset=["source", "target"]).withColumn("identical", F.col("source") == F.col("target")).withColumn("source_chars", F.length("source")).withColumn("target_chars", F.length("target"))
    return t.filter(~F.col("identical")) if require_diff else t


def sentence_pairs(pages: DataFrame, profile: ScriptProfile = TIBETAN) -> DataFrame:
    """Greedily aligned sentences of page pairs."""
    t = page_pairs(pages, require_diff=False)
    t = t.withColumn("a", udfs.greedy_align(X.segments_tight(F.col("source"), profile), X.segments_tight(F.col("target"), profile)))
    out = t.select("batch_name", "task_id", "image_id", "source_role", F.explode("a").alias("s")).select("batch_name", "task_id", "image_id", "source_role", "s.*")
    return out.withColumn("identical", F.col("source") == F.col("target"))


def edge_reason(profile: ScriptProfile, min_chars: int, min_ratio: float | None, ratio=None):
    """Why an aligned pair goes, first match; null if it stays."""
    r = F.when(~F.col("target").rlike(f"[{profile.terminators}]\\z"), "no_terminator").when((F.length("source") < min_chars) | (F.length("target") < min_chars), "short")
    return r if min_ratio is None else r.when(ratio < min_ratio, "low_ratio")


def align_pages(pages: DataFrame, profile: ScriptProfile = TIBETAN, nfc=udfs.nfc) -> DataFrame:
    """row_id, page_id, batch_name, source_role, has_brackets, segment_idx, source, target: each annotator's text cut at the
    reviewer's sentences. segment_idx counts the sentences that are left after cleaning."""
    t = pages.withColumn("row_id", F.monotonically_increasing_id()) if "row_id" not in pages.columns else pages
    t = unpivot(t.withColumn("page_id", page_id()), "row_id", "page_id", "batch_name")
    keep = ["row_id", "page_id", "batch_name", "source_role", "has_brackets"]
    t = t.select(*keep[:-1], once(source_text=X.null_marker(F.col("source_text")), target_text=X.null_marker(F.col("target_text"))))
    t = t.withColumn("has_brackets", X.has_brackets(F.col("source_text")) | X.has_brackets(F.col("target_text")))
    t = t.withColumn("s", X.normalize(X.strip_brackets(F.col("source_text")), profile, nfc)).withColumn("t", X.normalize(X.strip_brackets(F.col("target_text")), profile, nfc))
    t = t.select(*keep, once(gold=X.segments(F.col("t"), profile), own=X.flatten_layout(F.col("s"))))  # texts that are null have no sentences
    t = t.withColumn("own", udfs.boundary_transfer("gold", "own"))

    def clean(a):
        return F.filter(F.transform(a, lambda x: F.coalesce(X.normalize(X.strip_leading_debris(x, profile), profile), F.lit(""))), lambda x: x != "")

    t = t.withColumn("gold", clean(F.col("gold"))).withColumn("own", clean(F.col("own")))
    both = F.transform(F.col("gold"), lambda g, i: F.struct(i.alias("segment_idx"), F.coalesce(F.get("own", i), F.lit("")).alias("source"), g.alias("target")))
    return t.select(*keep, F.explode(F.filter(both, lambda x: x["source"] != "")).alias("p")).select(*keep, "p.*")


def clean_pairs(aligned: DataFrame, profile: ScriptProfile = TIBETAN) -> DataFrame:
    """Pair-level cleaning, with drop_reason where a pair goes."""
    t = aligned.withColumn("p", F.struct(X.strip_leading_debris(X.strip_ornaments(F.col("source")), profile).alias("source"), X.strip_leading_debris(X.strip_ornaments(F.col("target")), profile).alias("target")))
    t = t.withColumn("p", X.strip_leading_syllable(F.col("p.source"), F.col("p.target"), profile))
    t = t.withColumn("p", X.strip_leading_marks(F.col("p.source"), F.col("p.target")))
    rest = [c for c in aligned.columns if c not in ("source", "target")]
    t = t.select(*rest, once(source=F.coalesce(X.normalize(F.col("p.source"), profile), F.lit("")), target=F.coalesce(X.normalize(F.col("p.target"), profile), F.lit(""))))
    s, g = F.col("source"), F.col("target")
    why = F.when((s == "") | (g == ""), "empty")
    if profile is TIBETAN:
        why = why.when(X.has_latin(s) & X.has_latin(g), "latin_both").when(X.has_latin(s) | X.has_latin(g), "latin_one").when(X.has_foreign_punct(s) | X.has_foreign_punct(g), "foreign_punct")
    return t.withColumn("drop_reason", why.when(X.has_leading_digits(s) | X.has_leading_digits(g), "leading_digits"))


def agreement(pairs: DataFrame, by: str = "row_id") -> DataFrame:
    """Whether both annotators read a segment alike; by the input row, as pages may repeat."""
    w = Window.partitionBy(by, "segment_idx")
    a = F.max(F.when(F.col("source_role") == "annotator_a", F.col("source"))).over(w)
    b = F.max(F.when(F.col("source_role") == "annotator_b", F.col("source"))).over(w)
    t = pairs.withColumn("both_annotators_agree", F.coalesce(a == b, F.lit(False))).withColumn("identical", F.col("source") == F.col("target"))
    return t.withColumn("high_confidence_error", F.col("both_annotators_agree") & ~F.col("identical"))


def process(pages: DataFrame, profile: ScriptProfile = TIBETAN, min_chars: int = 8, min_ratio: float = 0.55, seed: int = 42, ratios=(0.9, 0.05, 0.05)) -> DataFrame:
    """The whole flow: align, filter, clean, flag, split. The dear similarity is computed after the cheap
    filters; the pairs are stored once, as the splits need the pages that are left."""
    t = align_pages(pages, profile).withColumn("drop_reason", edge_reason(profile, min_chars, None)).filter("drop_reason is null")
    t = t.withColumn("similarity", udfs.similarity("source", "target")).filter(F.col("similarity") >= min_ratio)
    t = stored(agreement(clean_pairs(t.drop("drop_reason"), profile).filter("drop_reason is null").drop("drop_reason", "similarity")), "pairs")
    return t.join(assign_splits(t, seed=seed, ratios=ratios), "page_id")


def categorize(pairs: DataFrame, profile: ScriptProfile = TIBETAN) -> DataFrame:
    s, g = F.col("source"), F.col("target")
    both = F.transform(F.array(X.differences(s, g)), lambda d: F.struct(X.classify(s, g, profile, d).alias("diff_category"), d["distance"].alias("edit_distance")))[0]
    return pairs.withColumn("class__", both).select("*", "class__.*").drop("class__")


def similarity_gate(pairs: DataFrame, least: float = 0.55) -> DataFrame:
    """Pairs at least so alike, with their ratio; identical is derived anew."""
    t = pairs.withColumn("ratio", udfs.similarity("source", "target"))
    return t.filter(F.col("ratio") >= least).withColumn("identical", F.col("source") == F.col("target"))
