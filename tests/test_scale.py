"""Steps that grew faster than their input."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scrivano.functions import text as X
from scrivano.functions import udfs
from scrivano.functions.profile import LATIN, TIBETAN
from scrivano.operators import pairs
from scrivano.plans import fixtures

SF = "/root/testdata/sf0.001"


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_move_no_rows(spark):
    assert "Exchange" not in plan_of(fixtures.pairs(spark, SF))


def test_segments_equal_cutting_first(spark):
    rng = random.Random(5)

    def normal(x, tibetan):
        x = re.sub(f"\\s+([{terms}])", "\\1", " ".join(x.split()))
        if tibetan:
            for pattern, to in (("(?<=[་༌])\\s+", ""), ("(?<=[ༀ-༊༒-࿿])\\s+(?=[ༀ-༊༒-࿿])", "་"), ("[་༌]{2,}", "་"), (f"[་༌]+(?=[{terms}])", "")):
                x = re.sub(pattern, to, x)
        return x.strip()

    for profile, terms, letters in ((LATIN, ".!?", "ab1. !?\n\t "), (TIBETAN, "།-༑", "ཀཁ་༌ །༎\n\t")):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 18))) for _ in range(400)]
        got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", X.segments(F.col("x"), profile, 2).alias("s"), X.segments_tight(F.col("x"), profile, 2).alias("t")).collect()
        for r in got:
            found = re.findall(f"[^{terms}]+[{terms}]?", re.sub("\r\n?|\n", "", r.x))
            whole = [normal(x, profile is TIBETAN) for x in found]
            assert r.s == [x for x in whole if len(x) >= 2 and re.sub(f"[{terms}]|\\s", "", x)], repr(r.x)
            bare = ["".join(x.split()) for x in found if re.sub(f"[{terms}]", "", x).strip()]
            assert r.t == [x for x in bare if len(x) >= 2], repr(r.x)


def test_edit_distance_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abü") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    two = [(rng.choice(words), rng.choice(words)) for _ in range(300)]
    for r in spark.createDataFrame([*two, (None, "a")], "s string, t string").withColumn("d", X.edit_distance(F.col("s"), F.col("t"))).collect():
        assert r.d == (None if r.s is None else brute_edits(r.s, r.t))
    for a, b in two:
        assert udfs.edits(a, b) == brute_edits(a, b)


def test_long_sentences_are_classified_in_time(spark):
    """Pages without a full stop are one sentence; the time for its class went with its length squared."""
    long = "lorem " * 30_000
    far = long[:50_000].replace("r", "q").replace("m", "")
    rows = [(1, long[:90_000] + "x" + long[90_001:], long), (2, long[:50_000], far)]
    began = time.time()
    got = {r.k: (r.diff_category, r.edit_distance) for r in pairs.categorize(spark.createDataFrame(rows, "k int, source string, target string"), LATIN).collect()}
    assert got == {1: ("single_char_substitution", 1), 2: ("large_rewrite", long[:50_000].count("r") + long[:50_000].count("m"))}
    assert time.time() - began < 40


def test_split_queries_read_pairs_once(spark, tmp_path, monkeypatch):
    """Bins, strata and inherited splits need the pairs several times; they are computed once and then read."""
    from scrivano.plans import splitting

    for name in ("derive_density", "density_crosstab", "density_by_source", "stratified_split", "resplit_pairs"):
        plan = plan_of(getattr(splitting, name)(spark, SF))
        assert "documents.parquet" not in plan and "ArrowEvalPython" not in plan, name


def test_ranks_in_groups(spark):
    from pyspark.sql import Window
    from scrivano.operators import rank

    t = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("g"))
    w = Window.partitionBy("g")
    want = t.withColumn("r", F.row_number().over(w.orderBy(rank.hashed(F.col("key"), 7), "key")) - 1).withColumn("total", F.count("key").over(w))
    got = rank.global_rank(t, "key", 7, "r", ("g",))
    assert {(x.key, x.r, x.total) for x in got.collect()} == {(x.key, x.r, x.total) for x in want.collect()}


def test_near_matcher_equals_difflib():
    from difflib import SequenceMatcher

    rng = random.Random(8)

    def changed(s):
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(0, len(s))
            s = rng.choice((s[:p] + "q" + s[p + 1 :], s[:p] + s[p + 1 :], s[:p] + "zq" + s[p:]))
        return s

    for _ in range(1500):
        letters = rng.choice(("ab", "abcdefgh ", "etaoin shrdlucmfwyp "))
        a = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 3, 10, 77, 150, 199, 230))))
        a = (a[:7] * 40)[: rng.randint(1, 260)] if rng.random() < 0.2 else a
        b = changed(a) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(60))
        for junk in (True, False):
            want, got = SequenceMatcher(None, a, b, autojunk=junk), udfs.Near(a, b, autojunk=junk)
            assert want.get_matching_blocks() == got.get_matching_blocks() and want.get_opcodes() == got.get_opcodes() and want.ratio() == got.ratio()


def test_near_texts_are_not_left_to_difflib(monkeypatch):
    from difflib import SequenceMatcher

    s = "the quick brown fox jumps over the lazy dog and does not come back before the night falls"
    monkeypatch.setattr(SequenceMatcher, "set_seq2", None)  # where letters are counted
    for t in (s, s[:30] + "x" + s[31:], s[:50] + s[51:], s[:10] + "zq" + s[10:]):
        assert udfs.ratio(s, t) > 0.9
    assert udfs.greedy([s], [s, s[::-1]])[0]["similarity"] == 1.0


def test_process_reads_pages_once(spark):
    from scrivano.plans import curation

    plan = plan_of(curation.process_pages(spark, SF))
    assert "documents.parquet" not in plan and "boundary_transfer" not in plan


def test_scores_of_a_long_text_in_time(spark):
    """A page of many different words: words were counted anew for each class."""
    from scrivano.operators import metrics

    words = [str(i) for i in range(30_000)]
    t = spark.createDataFrame([(1, words, [*words[1:], "x"]), (2, ["a", "b"], ["a", "a", "c"]), (3, [], [])], "k int, p array<string>, t array<string>")
    began = time.time()
    got = {r.k: (r.precision, r.recall, r.f1) for r in metrics.prf(t, ["k"], F.col("p"), F.col("t")).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[3] == (None, None, None) and got[2] == pytest.approx((2 / 3, 1 / 3, 4 / 9))
    assert time.time() - began < 20


def test_changed_chars_are_those_that_differ(spark):
    rng = random.Random(9)
    t = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    for r in spark.createDataFrame(t, "a string, b string").select("a", "b", udfs.changed_chars("a", "b").alias("c")).collect():
        assert [tuple(x) for x in r.c] == [x for x in udfs.aligned(r.a, r.b) if x[0] != x[1]]


def test_popular_known_words_are_not_moved(spark):
    from scrivano.operators import lexicon

    t = spark.createDataFrame([(1, "a b"), (2, "a x"), (3, "a a"), (4, ""), (5, "b  c"), (6, "y y")], "k int, target string")
    words = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "word string")
    for popular in (1, 3, 100_000):
        got = lexicon.in_dictionary(t, words, X.syllables(F.col("target"), LATIN), "k", popular)
        assert sorted(r.k for r in got.collect()) == [1, 3, 4, 5]
    assert plan_of(got).count("BroadcastExchange") >= 1 and "words-" in plan_of(got)


def test_nearest_equals_brute_force(spark):
    from scrivano.operators import lexicon

    rng = random.Random(11)
    base = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 24))) for _ in range(60)} | {"lorem " * 300}
    asked = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 24))) for _ in range(60)} | {"lorem " * 200 + "x" + "lorem " * 100, "zzzz" * 9} | set(list(base)[:5])
    q, b = (spark.createDataFrame([(x,) for x in t], "source string") for t in (asked, base))
    for most in (2, 5):
        got = {r.source: r.distance for r in lexicon.nearest(q, b, most).collect()}
        want = {x: min((d for y in base if abs(len(x) - len(y)) <= most and (d := brute_edits(x, y)) <= most), default=999) for x in asked}
        assert got == want


def test_an_edit_changes_two_bits_at_most():
    rng = random.Random(12)
    for _ in range(500):
        a = "".join(rng.choice("abcü ") for _ in range(rng.randint(1, 20)))
        p = rng.randrange(len(a))
        for b, most in ((a[:p] + "x" + a[p + 1 :], 2), (a[:p] + a[p + 1 :], 1), (a[:p] + "c" + a[p:], 1)):
            assert ((udfs.letter_bits(a) ^ udfs.letter_bits(b)) & ((1 << 64) - 1)).bit_count() <= most


def test_synthesis_ranks_a_corpus_in_parts(spark):
    from scrivano.operators import merge

    t = spark.createDataFrame([("c", f"ab{i} cd{i} ef{i}") for i in range(2000)] + [("d", "xy zw")], "source_corpus string, sentence string")
    few, all_ = (merge.synthesize(t, n, 42, p=LATIN, check=lambda x: x.rlike("^[ -~]+$")) for n in (30, 10_000))
    assert plan_of(few).count("Window [") == 2
    key = F.xxhash64(F.lit(42), F.lit("order"), F.col("target"))
    want = [r.target for r in all_.filter("reject_reason is null and source_corpus = 'c'").orderBy(key, "target").limit(30).collect()]
    assert sorted(want) == sorted(r.target for r in few.filter("reject_reason is null and source_corpus = 'c'").collect())
    assert few.filter("reject_reason is not null").count() == all_.filter("reject_reason is not null").count()
