"""Queries over pairs: classes, curation, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.profile import LATIN
from ..operators import curate, lexicon, metrics, pairs as P, rank, report, training
from ..registry import query
from ..sources import tables
from .fixtures import CLASS_SQL, PAIRS_SQL, edits, one_byte, pairs, table

ONE = "one AS (SELECT 1) "


@query(PAIRS_SQL + CLASS_SQL + ONE + "SELECT diff_category, count(*) AS n, sum(edit_distance)::BIGINT AS sum_distance, avg(edit_distance) AS avg_distance FROM classified GROUP BY 1")
def diff_category_counts(spark, sf_dir):
    t = P.categorize(pairs(spark, sf_dir).filter(~F.col("identical")), LATIN)
    return t.groupBy("diff_category").agg(F.count(F.lit(1)).alias("n"), F.sum("edit_distance").alias("sum_distance"), F.avg("edit_distance").alias("avg_distance"))


@query(PAIRS_SQL + ONE + "SELECT page_id, segment_idx, source_role, source, target, both_annotators_agree, high_confidence_error, has_brackets FROM pairs")
def annotator_agreement(spark, sf_dir):
    return pairs(spark, sf_dir).select("page_id", "segment_idx", "source_role", "source", "target", "both_annotators_agree", "high_confidence_error", "has_brackets")


@query(PAIRS_SQL + "r AS (SELECT CASE WHEN NOT regexp_matches(target, '[.!?]$') THEN 'no_terminator' WHEN length(source) < 15 OR length(target) < 15 THEN 'short' END AS drop_reason FROM pairs) SELECT drop_reason, count(*) AS n FROM r GROUP BY 1")
def edge_filter_counters(spark, sf_dir):
    t = pairs(spark, sf_dir).withColumn("drop_reason", P.edge_reason(LATIN, 15, None))
    return t.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


_DEDUPED = "deduped AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY high_confidence_error DESC, both_annotators_agree DESC, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, row_id) = 1), "


@query(PAIRS_SQL + _DEDUPED + ONE + "SELECT row_id, source, target, split FROM deduped")
def dedupe_exact_pairs(spark, sf_dir):
    return curate.dedupe_pairs(pairs(spark, sf_dir)).select("row_id", "source", "target", "split")


@query(PAIRS_SQL + "k AS (SELECT *, min(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) OVER (PARTITION BY source) AS least FROM pairs) SELECT row_id, source, split FROM k WHERE least = CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END")
def drop_source_leakage(spark, sf_dir):
    return curate.drop_source_leakage(pairs(spark, sf_dir)).select("row_id", "source", "split")


@query(PAIRS_SQL + "k AS (SELECT *, min(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) OVER (PARTITION BY page_id) AS least FROM pairs) SELECT row_id, page_id, CASE least WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM k")
def enforce_page_integrity(spark, sf_dir):
    return curate.enforce_pages(pairs(spark, sf_dir)).select("row_id", "page_id", "split")


_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


@query(
    PAIRS_SQL
    + f"""
capped AS (SELECT * FROM pairs WHERE length(source) <= 120 AND length(target) <= 120),
d1 AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY high_confidence_error DESC, both_annotators_agree DESC, {_RANK}, row_id) = 1),
d2 AS (SELECT * FROM (SELECT *, min({_RANK}) OVER (PARTITION BY source) AS least FROM d1) WHERE least = {_RANK}),
d3 AS (SELECT * REPLACE (CASE min({_RANK}) OVER (PARTITION BY page_id) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split) FROM d2),
d4 AS (SELECT * FROM d3 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY high_confidence_error DESC, both_annotators_agree DESC, {_RANK}, row_id) = 1)
SELECT row_id, page_id, source, target, split, identical FROM d4"""
)
def apply_fixes(spark, sf_dir):
    return curate.apply_fixes(pairs(spark, sf_dir), 120).select("row_id", "page_id", "source", "target", "split", "identical")


@query(
    PAIRS_SQL
    + """
a AS (SELECT count(*) AS n FROM pairs GROUP BY source, target), s AS (SELECT count(DISTINCT split) AS n FROM pairs GROUP BY source), t AS (SELECT count(DISTINCT split) AS n FROM pairs GROUP BY target)
SELECT (SELECT sum(n) FROM a)::BIGINT AS n_rows, (SELECT count(*) FROM a) AS n_unique_pairs, (SELECT count(*) FROM a WHERE n > 1) AS n_duplicate_pair_keys, (SELECT sum(n) - count(*) FROM a)::BIGINT AS n_extra_duplicate_rows,
  (SELECT count(*) FROM s WHERE n > 1) AS n_sources_multi_split, (SELECT count(*) FROM t WHERE n > 1) AS n_targets_multi_split"""
)
def duplicates_and_leakage(spark, sf_dir):
    return curate.duplicates_and_leakage(pairs(spark, sf_dir))


@query(PAIRS_SQL + "s AS (SELECT string_agg(DISTINCT split, '/' ORDER BY split) AS splits FROM pairs GROUP BY source HAVING count(DISTINCT split) > 1) SELECT splits, count(*) AS n FROM s GROUP BY 1")
def overlap_types(spark, sf_dir):
    return curate.overlap_types(pairs(spark, sf_dir))


@query(PAIRS_SQL + ONE + "SELECT page_id, count(DISTINCT split) AS n FROM pairs GROUP BY 1 HAVING count(DISTINCT split) > 1")
def page_violations(spark, sf_dir):
    return curate.page_violations(pairs(spark, sf_dir))


@query(
    PAIRS_SQL
    + "l AS (SELECT 'source' AS side, length(source) AS len FROM pairs UNION ALL SELECT 'target', length(target) FROM pairs) SELECT side, count(*) AS n, round_even(avg(len), 1) AS mean, trunc(quantile_cont(len::DOUBLE, 0.5))::INTEGER AS p50, trunc(quantile_cont(len::DOUBLE, 0.9))::INTEGER AS p90, trunc(quantile_cont(len::DOUBLE, 0.95))::INTEGER AS p95, trunc(quantile_cont(len::DOUBLE, 0.99))::INTEGER AS p99, max(len)::INTEGER AS max FROM l GROUP BY side"
)
def length_stats(spark, sf_dir):
    return report.length_stats(pairs(spark, sf_dir), "source", "target")


@query(PAIRS_SQL + ONE + "SELECT count_if(length(source) > 100)::BIGINT AS n_source, count_if(length(target) > 100)::BIGINT AS n_target, count_if(length(source) > 100 OR length(target) > 100)::BIGINT AS n_either, count(*) AS n FROM pairs")
def overlength_counts(spark, sf_dir):
    return report.overlength(pairs(spark, sf_dir), 100)


@query(PAIRS_SQL + ONE + "SELECT CASE WHEN grouping(batch_name) = 1 THEN 'total' ELSE batch_name END AS batch_name, count(*) AS n, count_if(identical)::BIGINT AS n_identical, round_even(avg(length(source)), 1) AS mean_chars FROM pairs GROUP BY ROLLUP (batch_name)")
def batch_totals(spark, sf_dir):
    return report.batch_totals(pairs(spark, sf_dir).withColumn("source_chars", F.length("source")))


@query(
    PAIRS_SQL + CLASS_SQL + "names AS (SELECT unnest(['punctuation_only', 'whitespace_only', 'single_char_substitution', 'single_char_insert_delete', 'syllable_level', 'multi_edit', 'large_rewrite']) AS diff_category), c AS (SELECT diff_category, count(*) AS n FROM classified GROUP BY 1) SELECT diff_category, coalesce(n, 0) AS n, round_even(100 * coalesce(n, 0) / sum(n) OVER (), 2) AS pct FROM names LEFT JOIN c USING (diff_category)"
)
def category_histogram(spark, sf_dir):
    t = P.categorize(pairs(spark, sf_dir).filter(~F.col("identical")), LATIN)
    return report.histogram(t, "diff_category", X.CATEGORIES)


@query(
    r"""WITH x AS (SELECT page_id, html, length(html) - length(replace(html, '(', '')) AS o, length(html) - length(replace(html, ')', '')) AS c FROM pages)
SELECT page_id, regexp_matches(html, '[A-Za-z]') AS has_latin, regexp_matches(html, '[()（）༼༽]') AS has_brackets, len(regexp_extract_all(html, '[A-Za-zＡ-Ｚａ-ｚ\x{FF3B}-\x{FF40}]+'))::INTEGER AS n_runs,
  length(regexp_replace(html, '[()（）༼༽]', '', 'g'))::INTEGER AS stripped_chars, regexp_matches(html, '^[0-9]') AS leading_digits FROM x"""
)
def artifact_flags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", X.has_latin(h).alias("has_latin"), X.has_brackets(h).alias("has_brackets"), F.size(X.latin_runs(h)).alias("n_runs"), F.length(X.strip_brackets(h)).alias("stripped_chars"), X.has_leading_digits(h).alias("leading_digits"))


_NEAR = (
    "q AS (SELECT source, "
    + one_byte("source")
    + " AS q, count(*) AS n FROM pairs WHERE split = 'test' GROUP BY 1), b AS (SELECT DISTINCT "
    + one_byte("source")
    + " AS b, length(source) AS m FROM pairs WHERE split = 'train'), d AS (SELECT source, n, coalesce((SELECT min(levenshtein(q, b)) FROM b WHERE m BETWEEN length(q) - 5 AND length(q) + 5 AND levenshtein(q, b) <= 5), 999)::INTEGER AS distance FROM q) "
)


@query(PAIRS_SQL + _NEAR + "SELECT source, distance FROM d")
def nearest_train_source(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return lexicon.nearest(t.filter("split = 'test'"), t.filter("split = 'train'"))


@query(PAIRS_SQL + _NEAR + "SELECT w AS within, coalesce(sum(n) FILTER (distance <= w), 0)::BIGINT AS n_rows, count(*) FILTER (distance <= w) AS n_texts FROM d, (VALUES (1), (2), (3), (5)) v(w) GROUP BY w")
def neighbour_counts(spark, sf_dir):
    t = pairs(spark, sf_dir)
    q = t.filter("split = 'test'")
    return lexicon.neighbour_counts(q, lexicon.nearest(q, t.filter("split = 'train'")))


@query(PAIRS_SQL + "g AS (SELECT page_id, segment_idx, target, min(source) FILTER (source_role = 'annotator_a') AS a, min(source) FILTER (source_role = 'annotator_b') AS b FROM pairs GROUP BY 1, 2, 3) SELECT count(*) AS n_both, count(*) FILTER (a = b) AS n_equal FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
def role_agreement(spark, sf_dir):
    return lexicon.role_agreement(pairs(spark, sf_dir))


_PRF_SQL = (
    PAIRS_SQL
    + """
w AS (SELECT row_id, batch_name, list_filter(string_split(source, ' '), lambda x: x <> '') AS p, list_filter(string_split(target, ' '), lambda x: x <> '') AS t FROM pairs),
x AS (SELECT row_id, batch_name, greatest(len(p), len(t)) AS n, unnest(range(1, greatest(len(p), len(t)) + 1)) AS i, p, t FROM w),
y AS (SELECT row_id, batch_name, n, coalesce(p[i], '') AS p, coalesce(t[i], '') AS t FROM x),
z AS (SELECT row_id, batch_name, n, t AS token, 1 AS sup, 0 AS pred, (p = t)::INT AS tp FROM y UNION ALL SELECT row_id, batch_name, n, p, 0, 1, 0 FROM y),
k AS (SELECT row_id, batch_name, n, token, sum(sup) AS sup, sum(pred) AS pred, sum(tp) AS tp FROM z GROUP BY 1, 2, 3, 4),
m AS (SELECT row_id, batch_name, sum(CASE WHEN pred > 0 THEN sup::DOUBLE / n * tp / pred ELSE 0 END) AS precision, sum(tp)::DOUBLE / max(n) AS recall, sum(sup::DOUBLE / n * 2 * tp / (sup + pred)) AS f1 FROM k GROUP BY 1, 2)
"""
)


@query(_PRF_SQL + "SELECT row_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m")
def syllable_prf(spark, sf_dir):
    t = pairs(spark, sf_dir)
    out = metrics.prf(t, ["row_id"], X.metric_syllables(F.col("source"), LATIN), X.metric_syllables(F.col("target"), LATIN))
    return out.select("row_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_PRF_SQL + "SELECT CASE WHEN grouping(batch_name) = 1 THEN 'overall' ELSE batch_name END AS batch_name, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, count(*) AS n FROM m GROUP BY ROLLUP (batch_name)")
def noop_baseline(spark, sf_dir):
    out = metrics.evaluate(pairs(spark, sf_dir), "batch_name", ["row_id"], LATIN, predicted="source")
    return out.select("batch_name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "n")


@query(PAIRS_SQL + ONE + f"SELECT row_id, {edits('source', 'target')} / nullif(length(target), 0)::DOUBLE AS cer FROM pairs")
def character_error_rate(spark, sf_dir):
    return metrics.error_rates(pairs(spark, sf_dir), "source").select("row_id", "cer")


@query(PAIRS_SQL + CLASS_SQL + "b AS (SELECT CASE WHEN edit_distance <= 0 THEN '0' WHEN edit_distance <= 2 THEN edit_distance::VARCHAR WHEN edit_distance <= 5 THEN '3-5' WHEN edit_distance <= 10 THEN '6-10' WHEN edit_distance <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM classified) SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def distance_buckets(spark, sf_dir):
    t = P.categorize(pairs(spark, sf_dir).filter(~F.col("identical")), LATIN)
    return t.groupBy(X.bucket(F.col("edit_distance")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH x AS (SELECT 'text' AS column_name, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) SELECT column_name, count_if(v IS NULL OR trim(v) = '')::BIGINT AS n_empty, count(DISTINCT v) FILTER (trim(v) <> '') AS n_distinct, round_even(avg(length(v)) FILTER (trim(v) <> ''), 1) AS mean_len, min(length(v)) FILTER (trim(v) <> '')::INTEGER AS min_len, max(length(v)) FILTER (trim(v) <> '')::INTEGER AS max_len FROM x GROUP BY 1"
)
def column_profile(spark, sf_dir):
    return report.profile(table(spark, sf_dir, "documents"), "text", "lang", "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_sources(spark, sf_dir):
    return report.top(table(spark, sf_dir, "documents"), "source", 5)


@query()
def substitution_table(spark, sf_dir):
    return report.substitutions(pairs(spark, sf_dir))


@query()
def similarity_gate(spark, sf_dir):
    return report.similarity_histogram(P.similarity_gate(pairs(spark, sf_dir), 0.97))


@query()
def near_cutoff_drops(spark, sf_dir):
    """The likest of the pairs below the gate."""
    t = P.similarity_gate(pairs(spark, sf_dir), 0.0).filter("ratio < 0.55")
    return t.orderBy(F.desc("ratio"), "row_id").limit(15).select("row_id", "source", "target", "ratio")


def pages(spark, sf_dir):
    """Documents as annotation pages: the second annotator swaps two letters throughout."""
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(F.col("doc_id").alias("row_id"), F.col("source").alias("batch_name"), F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").cast("string").alias("task_id"), F.lit("done").alias("state"), F.regexp_replace(t, "qu", "q").alias("annotator_a_transcript"), F.translate(t, "y", "i").alias("annotator_b_transcript"), t.alias("final_reviewer_transcript"))


@query()
def process_pages(spark, sf_dir):
    """The flow from pages to clean pairs with splits and classes."""
    return P.categorize(P.process(pages(spark, sf_dir), LATIN), LATIN).select(*P.PAIR_COLUMNS, "diff_category", "edit_distance")


@query()
def greedy_sentence_pairs(spark, sf_dir):
    return P.sentence_pairs(pages(spark, sf_dir), LATIN)


@query(
    r"""WITH p AS (SELECT doc_id, source AS batch_name, text, regexp_replace(text, 'qu', 'q', 'g') AS a, translate(text, 'y', 'i') AS b FROM documents),
l AS (SELECT batch_name, doc_id::VARCHAR AS image_id, 'annotator_a' AS source_role, a AS source, text AS target FROM p UNION ALL SELECT batch_name, doc_id::VARCHAR, 'annotator_b', b, text FROM p)
SELECT batch_name, image_id, source_role, length(source)::INTEGER AS source_chars, length(target)::INTEGER AS target_chars FROM l WHERE source <> target AND lower(trim(source)) NOT IN ('', 'nan', 'none', 'null')"""
)
def page_pairs(spark, sf_dir):
    return P.page_pairs(pages(spark, sf_dir)).select("batch_name", "image_id", "source_role", "source_chars", "target_chars")


_EXPORTED = "e AS (SELECT 'sentence' AS level, identical, batch_name, source, target FROM pairs UNION ALL SELECT 'page', s = text, batch_name, s, text FROM (SELECT source AS batch_name, text, regexp_replace(text, 'qu', 'q', 'g') AS s FROM documents) UNION ALL SELECT 'page', s = text, batch_name, s, text FROM (SELECT source AS batch_name, text, translate(text, 'y', 'i') AS s FROM documents)) "


@query(PAIRS_SQL + _EXPORTED + "SELECT CASE WHEN identical THEN 'identical' ELSE 'differing' END || '_' || level AS name, count(*) AS n, sum(length(source))::BIGINT AS source_chars, sum(length(target))::BIGINT AS target_chars FROM e WHERE level = 'sentence' OR lower(trim(source)) NOT IN ('', 'nan', 'none', 'null') GROUP BY 1")
def exported_tables(spark, sf_dir):
    """The four tables that an export writes, summed up."""
    out = None
    for name, t in tables.export_tables(pairs(spark, sf_dir), P.page_pairs(pages(spark, sf_dir), require_diff=False)).items():
        own = t.select(F.lit(name).alias("name"), "source", "target")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("source_chars"), F.sum(F.length("target")).alias("target_chars"))


_LOADED = "loaded AS (SELECT row_id, source, target, diff_category FROM classified WHERE split = 'train' AND length(source) <= 60 AND length(target) <= 60 AND diff_category <> 'multi_edit' UNION ALL SELECT row_id, source, target, 'identical' FROM pairs WHERE identical AND split = 'train' AND length(source) <= 60 AND length(target) <= 60) "


def _loaded(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return training.load(P.categorize(t.filter("not identical"), LATIN), t.filter("identical"), "train", 60, ("multi_edit",))


@query(PAIRS_SQL + CLASS_SQL + _LOADED + "SELECT * FROM loaded")
def training_rows(spark, sf_dir):
    return _loaded(spark, sf_dir).select("row_id", "source", "target", "diff_category")


@query(PAIRS_SQL + CLASS_SQL + _LOADED + "SELECT diff_category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM loaded GROUP BY 1")
def training_composition(spark, sf_dir):
    return training.composition(_loaded(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(PAIRS_SQL + ONE + "SELECT count(DISTINCT target) AS n_targets, round(count(DISTINCT target) / count(*), 9) AS ratio, round(count(*) / count(DISTINCT target), 9) AS rows_per_target FROM pairs")
def target_diversity(spark, sf_dir):
    t = report.diversity(pairs(spark, sf_dir), "target")
    return t.select("n_targets", F.round("ratio", 9).alias("ratio"), F.round("rows_per_target", 9).alias("rows_per_target"))


@query(PAIRS_SQL + ONE + "SELECT row_id, source FROM pairs WHERE NOT identical ORDER BY row_id LIMIT 40 OFFSET 10")
def first_examples(spark, sf_dir):
    return rank.first(pairs(spark, sf_dir).filter("not identical"), 40, "row_id", skip=10).select("row_id", "source")
