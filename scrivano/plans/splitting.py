"""Queries over splits, sampling, lexicons, merging, verdicts and Tibetan literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import corruption as C
from ..functions import text as X
from ..functions import udfs
from ..functions.profile import LATIN
from ..operators import infer, lexicon, merge, pairs as P, rank, report, splits, verdict
from ..registry import query
from ..streaming.flows import event_windows, sessions
from .fixtures import CLASS_SQL, PAIRS_SQL, pairs, table

ONE = "one AS (SELECT 1) "


def _ranked(seed: int, source: str = "pages0", name: str = "ranked") -> str:
    return f"{name} AS (SELECT page_id, row_number() OVER (ORDER BY md5('{seed}:' || page_id), page_id) - 1 AS r, count(*) OVER () AS n FROM {source}), "


_PAGES = "pages0 AS (SELECT DISTINCT page_id FROM pairs), "


@query(PAIRS_SQL + _PAGES + _ranked(42) + ONE + "SELECT page_id, CASE WHEN r < floor(n * 0.9::DOUBLE) THEN 'train' WHEN r < floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked")
def assign_splits(spark, sf_dir):
    return splits.assign_splits(pairs(spark, sf_dir))


@query(PAIRS_SQL + _PAGES + _ranked(42) + ONE + "SELECT page_id, CASE WHEN r < round_even(n * 0.05::DOUBLE, 0) THEN 'val' WHEN r < 2 * round_even(n * 0.05::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM ranked")
def assign_val_first(spark, sf_dir):
    return splits.assign_val_first(pairs(spark, sf_dir))


_PREV = "prev AS (SELECT md5(concat(source, chr(0), target)) AS key, min(CASE WHEN doc_id % 20 < 2 THEN 0 WHEN doc_id % 20 < 4 THEN 1 ELSE 2 END) AS inh FROM pairs WHERE doc_id % 3 = 0 GROUP BY 1), "


def _previous(t):
    d = F.col("doc_id")
    return t.filter("doc_id % 3 = 0").select("source", "target", F.when(d % 20 < 2, "test").when(d % 20 < 4, "val").otherwise("train").alias("split"))


@query(
    PAIRS_SQL
    + _PREV
    + "k AS (SELECT p.row_id, p.page_id, v.inh FROM pairs p LEFT JOIN prev v ON v.key = md5(concat(p.source, chr(0), p.target))), f AS (SELECT page_id, min(inh) AS inh FROM k GROUP BY 1), free AS (SELECT page_id FROM f WHERE inh IS NULL), "
    + _ranked(42, "free")
    + """z AS (SELECT f.page_id, CASE WHEN inh IS NOT NULL THEN inh WHEN r < floor(n * 0.9::DOUBLE) THEN 2 WHEN r < floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 1 ELSE 0 END AS s FROM f LEFT JOIN ranked USING (page_id))
SELECT k.row_id, k.page_id, ['test', 'val', 'train'][z.s + 1] AS split, coalesce(k.inh <> z.s, false) AS moved FROM k JOIN z USING (page_id)"""
)
def resplit_pages(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return splits.resplit_pages(t, _previous(t)).select("row_id", "page_id", "split", "moved")


@query(
    PAIRS_SQL
    + CLASS_SQL
    + _PREV
    + "k AS (SELECT p.*, v.inh, p.diff_category IN ('syllable_level', 'single_char_substitution', 'single_char_insert_delete') AS is_real FROM classified p LEFT JOIN prev v ON v.key = md5(concat(p.source, chr(0), p.target))), free AS (SELECT DISTINCT page_id FROM k WHERE is_real AND inh IS NULL), "
    + _ranked(42, "free")
    + """one AS (SELECT 1) SELECT k.row_id, CASE WHEN NOT is_real THEN split WHEN inh IS NOT NULL THEN ['test', 'val', 'train'][inh + 1] WHEN r < round_even(n * 0.05::DOUBLE, 0) THEN 'val' WHEN r < 2 * round_even(n * 0.05::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM k LEFT JOIN ranked USING (page_id)"""
)
def resplit_pairs(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return splits.resplit_pairs(P.categorize(t.filter("not identical"), LATIN), _previous(t), keep=("row_id",)).select("row_id", "split")


@query(
    PAIRS_SQL
    + "k AS (SELECT page_id, split, md5(concat(source, chr(0), target)) AS key FROM pairs), a AS (SELECT page_id FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1), t AS (SELECT DISTINCT key FROM k WHERE split = 'train'), v AS (SELECT DISTINCT key FROM k WHERE split = 'val'), e AS (SELECT DISTINCT key FROM k WHERE split = 'test') SELECT (SELECT count(*) FROM a) AS pages_in_several, (SELECT count(*) FROM t JOIN e USING (key)) AS train_and_test, (SELECT count(*) FROM t JOIN v USING (key)) AS train_and_val"
)
def verify_splits(spark, sf_dir):
    return splits.verify(pairs(spark, sf_dir))


def _merged(spark, sf_dir):
    t = P.categorize(pairs(spark, sf_dir).filter("not identical"), LATIN)
    real = F.col("doc_id") % 2 == 0
    return t.select("row_id", "source", "target", F.concat_ws("|", "diff_category", "source_role").alias("corruption_types"), (F.col("edit_distance") - 1).alias("n_corruptions"), F.when(real, "real").otherwise("synth").alias("source_corpus"), F.col("page_id").alias("doc_id"), F.concat_ws(":", "page_id", F.col("segment_idx").cast("string")).alias("source_sentence_id"))


_DERIVED = """merged AS (SELECT row_id, target, diff_category || '|' || source_role AS corruption_types, edit_distance - 1 AS n_corruptions, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'synth' END AS source_corpus, page_id, page_id || ':' || segment_idx AS sid FROM classified),
dens AS (SELECT *, round_even(n_corruptions / greatest(length(target), 1)::DOUBLE, 5) AS density, string_split(corruption_types, '|')[1] AS error_type, CASE WHEN source_corpus = 'real' THEN 'real:' || page_id ELSE sid END AS grp FROM merged),
cuts AS (SELECT quantile_cont(density, 1/3::DOUBLE) AS lo, quantile_cont(density, 2/3::DOUBLE) AS mi FROM dens WHERE density > 0),
derived AS (SELECT dens.*, CASE WHEN density <= 0 THEN 'clean' WHEN density <= lo THEN 'low' WHEN density <= mi THEN 'mid' ELSE 'high' END AS density_bin FROM dens, cuts),
"""


@query(PAIRS_SQL + CLASS_SQL + _DERIVED + ONE + 'SELECT row_id, density, error_type, density_bin, grp AS "group" FROM derived')
def derive_density(spark, sf_dir):
    return splits.derive(_merged(spark, sf_dir), ("row_id", "source_corpus")).select("row_id", "density", "error_type", "density_bin", "group")


@query(PAIRS_SQL + CLASS_SQL + _DERIVED + ONE + "SELECT source_corpus, density_bin, count(*) AS n, count(*) < 30 AS thin FROM derived GROUP BY 1, 2")
def density_crosstab(spark, sf_dir):
    return splits.crosstab(splits.derive(_merged(spark, sf_dir), ("row_id", "source_corpus")), "density_bin")


@query(PAIRS_SQL + CLASS_SQL + _DERIVED + ONE + "SELECT source_corpus, median(density) FILTER (density > 0) AS median, avg(density) FILTER (density > 0) AS mean, count(*) AS n FROM derived GROUP BY 1")
def density_by_source(spark, sf_dir):
    return report.density_by_source(splits.derive(_merged(spark, sf_dir), ("row_id", "source_corpus")))


@query(
    PAIRS_SQL
    + CLASS_SQL
    + _DERIVED
    + """g AS (SELECT grp, arg_min(source_corpus, row_id) AS sc, arg_min(source_corpus || '|' || density_bin || '|' || error_type, row_id) AS cell FROM derived GROUP BY 1),
s1 AS (SELECT grp, CASE WHEN count(*) OVER (PARTITION BY cell) < 20 THEN sc ELSE cell END AS st FROM g), s2 AS (SELECT grp, CASE WHEN count(*) OVER (PARTITION BY st) < 40 THEN 'ALL' ELSE st END AS st FROM s1),
h AS (SELECT grp, row_number() OVER (PARTITION BY st ORDER BY md5('42:' || grp), grp) <= round_even(count(*) OVER (PARTITION BY st) * 0.1::DOUBLE, 0) AS held FROM s2),
q AS (SELECT grp, row_number() OVER (ORDER BY md5('43:' || grp), grp) - 1 < ceil(count(*) OVER () * 0.5::DOUBLE) AS is_test FROM h WHERE held)
SELECT derived.row_id, derived.grp AS "group", CASE WHEN q.grp IS NULL THEN 'train' WHEN is_test THEN 'test' ELSE 'val' END AS split FROM derived LEFT JOIN q ON q.grp = derived.grp"""
)
def stratified_split(spark, sf_dir):
    return splits.stratified_split(splits.derive(_merged(spark, sf_dir), ("row_id", "source_corpus"))).select("row_id", "group", "split")


@query(PAIRS_SQL + ONE + "SELECT row_id, source, target FROM pairs WHERE identical ORDER BY md5('42:' || row_id), row_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return rank.sample(pairs(spark, sf_dir).filter("identical"), 50, F.col("row_id")).select("row_id", "source", "target")


@query(PAIRS_SQL + CLASS_SQL + ONE + "SELECT row_id, diff_category FROM classified QUALIFY row_number() OVER (PARTITION BY diff_category ORDER BY md5('42:' || row_id), row_id) <= 5")
def sample_by_category(spark, sf_dir):
    t = P.categorize(pairs(spark, sf_dir).filter("not identical"), LATIN)
    return rank.sample_by(t, "diff_category", 5, F.col("row_id")).select("row_id", "diff_category")


@query(PAIRS_SQL + "v AS (SELECT DISTINCT target FROM pairs) SELECT target, (SELECT count(*) FROM v) AS total FROM v ORDER BY md5('42:' || target), target LIMIT 30")
def reservoir_of_distinct(spark, sf_dir):
    return rank.distinct_sample(pairs(spark, sf_dir), "target", 30)


@query(PAIRS_SQL + "d AS (SELECT * FROM pairs WHERE NOT identical), i AS (SELECT * FROM pairs WHERE identical ORDER BY md5('42:' || row_id), row_id LIMIT (SELECT round_even(count(*) * 0.1::DOUBLE / 0.9::DOUBLE, 0)::BIGINT FROM d)) SELECT row_id, identical FROM d UNION ALL SELECT row_id, identical FROM i")
def training_mix(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return rank.with_identical(t.filter("not identical"), t.filter("identical"), 0.1, F.col("row_id")).select("row_id", "identical")


@query("WITH f AS (SELECT DISTINCT p_partkey % 50 AS ipa, p_name || ' ' || p_partkey % 11 AS syllable FROM part) SELECT DISTINCT l.syllable AS a, r.syllable AS b FROM f l JOIN f r USING (ipa) WHERE l.syllable <> r.syllable AND levenshtein(l.syllable, r.syllable) <= 2")
def homophone_edges(spark, sf_dir):
    t = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("ipa"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 11).cast("string")).alias("syllable"))
    return lexicon.homophone_edges(t)


@query(
    "WITH f AS (SELECT p_brand || ' ' || p_name AS lemma, p_name || p_partkey AS form, p_type || p_partkey % 5 AS tag, p_size % 3 AS ipa FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY form, tag) AS k FROM f) SELECT a.lemma, a.form AS form_a, a.tag AS tag_a, b.form AS form_b, b.tag AS tag_b, a.ipa FROM r a JOIN r b ON a.lemma = b.lemma AND a.ipa = b.ipa WHERE a.k < b.k AND a.form <> b.form AND a.tag <> b.tag"
)
def verb_homophone_pairs(spark, sf_dir):
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    return lexicon.verb_pairs(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("lemma"), name.alias("form"), F.concat("p_type", (F.col("p_partkey") % 5).cast("string")).alias("tag"), (F.col("p_size") % 3).alias("ipa")))


@query(
    PAIRS_SQL
    + "dic AS (SELECT DISTINCT unnest(string_split(target, ' ')) AS word FROM gold WHERE doc_id % 2 = 0), own AS (SELECT doc_id * 1000 + segment_idx AS k, target FROM gold), w AS (SELECT DISTINCT k, unnest(string_split(target, ' ')) AS word FROM own) SELECT k, target FROM own WHERE k NOT IN (SELECT k FROM w WHERE word <> '' AND word NOT IN (SELECT word FROM dic))"
)
def dictionary_filter(spark, sf_dir):
    from .fixtures import gold

    g = gold(spark, sf_dir)
    words = g.filter("doc_id % 2 = 0").select(F.explode(F.split("target", " ")).alias("word")).distinct()
    own = g.select((F.col("doc_id") * 1000 + F.col("segment_idx")).alias("k"), "target")
    return lexicon.in_dictionary(own, words, X.syllables(F.col("target"), LATIN), "k")


@query(PAIRS_SQL + "cache AS (SELECT DISTINCT target AS t FROM gold WHERE doc_id % 2 = 0) SELECT DISTINCT target AS t FROM pairs WHERE target NOT IN (SELECT t FROM cache)")
def verdicts_pending(spark, sf_dir):
    t = pairs(spark, sf_dir)
    return verdict.pending(t, t.filter("doc_id % 2 = 0").select(F.col("target").alias("t")).distinct())


@query(
    PAIRS_SQL
    + "c AS (SELECT target AS t, max(CASE WHEN length(target) % 2 = 0 THEN 'YES' ELSE 'NO' END) AS v FROM gold WHERE doc_id % 5 <> 0 GROUP BY 1) SELECT batch_name, avg((coalesce(v, 'ERR') = 'YES')::INT) AS rate, count(*) AS n FROM pairs LEFT JOIN c ON c.t = pairs.target GROUP BY 1"
)
def verdict_rates(spark, sf_dir):
    t = pairs(spark, sf_dir)
    cache = t.filter("doc_id % 5 <> 0").select(F.col("target").alias("t"), F.when(F.length("target") % 2 == 0, "YES").otherwise("NO").alias("v")).distinct()
    return verdict.flag_rates(verdict.with_verdicts(t, cache), "batch_name")


@query(PAIRS_SQL + ONE + "SELECT row_id, 'real:' || substr(md5(page_id || ':' || segment_idx), 1, 12) AS source_sentence_id FROM pairs")
def stable_row_ids(spark, sf_dir):
    return merge.row_ids(pairs(spark, sf_dir)).select("row_id", "source_sentence_id")


@query(PAIRS_SQL + "n AS (SELECT batch_name AS source_corpus, length(target) AS len, row_number() OVER (PARTITION BY batch_name ORDER BY length(target)) - 1 AS k, count(*) OVER (PARTITION BY batch_name) AS n FROM pairs) SELECT source_corpus, len::INTEGER AS median_len FROM n WHERE k = n // 2")
def upper_median_length(spark, sf_dir):
    return merge.upper_median_length(pairs(spark, sf_dir).withColumnRenamed("batch_name", "source_corpus"))


def _synth(spark, sf_dir):
    t = pairs(spark, sf_dir).select(F.col("batch_name").alias("source_corpus"), F.col("target").alias("sentence"))
    return merge.synthesize(t, 100, 42, p=LATIN, check=lambda x: x.rlike("^[!-~\\u00c0-\\u00ff]+$"))


@query()
def synthetic_pairs(spark, sf_dir):
    return _synth(spark, sf_dir).filter("reject_reason is null").drop("reject_reason")


@query()
def synthesis_rejects(spark, sf_dir):
    t = _synth(spark, sf_dir)
    return t.groupBy("corruption_type", "reject_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "corruption_type", "reject_reason").limit(15)


@query()
def corrected_texts(spark, sf_dir):
    """Texts through a stand-in corrector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infer.correct(docs, lambda: lambda s: s.replace("zq", ""), "text", LATIN).select("doc_id", "prediction")


@query()
def edit_operations(spark, sf_dir):
    t = pairs(spark, sf_dir).filter("not identical")
    e = t.select("row_id", udfs.char_edits("source", "target").alias("e"), udfs.inline_diff("source", "target").alias("diff"))
    return e.select("row_id", "e.*", "diff")


_LITERALS = [
    ("normalize", "ཐུག །", "ཐུག།"),
    ("normalize", "ནི་ གཉེན", "ནི་གཉེན"),
    ("normalize", "འདིའི ལུང", "འདིའི་ལུང"),
    ("normalize", "༸ ཀ་་ཁ", "༧་ཀ་ཁ"),
    ("normalize", "ཀ་།", "ཀ།"),
    ("segments", "ཀཁ། གང།། ཅཆ", "ཀཁ།|གང།|ཅཆ"),
    ("debris", "ོ། སྲིད་པ", "སྲིད་པ"),
    ("brackets", "༼ཀ༽(ཁ)", "ཀཁ"),
    ("ornaments", "༄༅ཀ༒", "ཀ"),
    ("latin", "ཀabcཁ", "ཀཁ"),
    ("syllables", "ཀ་ཁ་།", "ཀ|ཁ|།"),
    ("well_formed", "བཀྲ", "true"),
    ("well_formed", "ཱུབ", "false"),
    ("well_formed", "ྲབ", "false"),
    ("repeats", "ཀ་ཀ་ཀ་ཁ", "ཀ་ཁ"),
    ("class", "ཀ་ཁ|ཀཁ", "punctuation_only"),
    ("class", "བཀྲ་ཤིས|བཀྲ་ཤེས", "single_char_substitution"),
    ("class", "བཀྲ་ཤིས|བཀྲ་ཤི", "single_char_insert_delete"),
    ("subtype", "ཀ་ཁ|ཀཁ", "tsheg_within"),
    ("subtype", "ཀ་ཁ།|ཀ་ཁ", "terminal_shad_only"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{a}', '{b}')" for o, a, b in _LITERALS) + ") v(op, input, output)")
def tibetan_literals(spark, sf_dir):
    x = F.col("input")
    s, t = (F.get(F.split(x, "\\|"), F.lit(i)) for i in (0, 1))  # a class has an Arrow function, which is evaluated for all rows
    out = F.lit(None).cast("string")
    for op, value in {
        "normalize": X.normalize(x), "segments": F.array_join(X.segments(x), "|"), "debris": X.strip_leading_debris(x), "brackets": X.strip_brackets(x), "ornaments": X.strip_ornaments(x), "latin": X.strip_latin(x),
        "syllables": F.array_join(X.syllables(x), "|"), "well_formed": C.well_formed(x).cast("string"), "repeats": X.collapse_repeats(x), "class": X.classify(s, t), "subtype": X.punctuation_subtype(s, t),
    }.items():
        out = F.when(F.col("op") == op, value).otherwise(out)
    return spark.createDataFrame([(o, a) for o, a, _ in _LITERALS], "op string, input string").select("op", "input", out.alias("output"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows_hourly(spark, sf_dir):
    """Extension: tumbling windows."""
    return event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf_dir):
    """Extension: sessions by a gap of half an hour."""
    return sessions(table(spark, sf_dir, "events"))
