"""The engine without its llm part."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scrivano import registry
from scrivano.functions import corruption as C
from scrivano.functions import text as X
from scrivano.functions import udfs
from scrivano.operators import infer, lexicon, pairs, training, verdict
from scrivano.plans import curation, splitting
from scrivano.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "events"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


CHECKED = ["diff_category_counts", "apply_fixes", "duplicates_and_leakage", "assign_splits", "resplit_pages", "derive_density", "training_mix", "homophone_edges", "verb_homophone_pairs", "dictionary_filter", "verdict_rates", "upper_median_length", "tibetan_literals", "event_windows_hourly", "syllable_prf", "nearest_train_source", "neighbour_counts", "artifact_flags", "exported_tables", "training_rows", "training_composition", "target_diversity", "first_examples"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = [cols.index(c) for c in sorted(cols)]
    data = [tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in want.fetchall()]
    assert rows(got) == sorted(data, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_alignment_and_transfer():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab་ ") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("ab་ ") for _ in range(rng.randint(0, 12)))
        al = udfs.aligned(a, b)
        assert "".join(x for x, _ in al) == a and "".join(y for _, y in al) == b
        cut = sorted(rng.randint(0, len(a)) for _ in range(2))
        gold = [a[: cut[0]], a[cut[0] : cut[1]], a[cut[1] :]]
        assert "".join(udfs.transferred(gold, b)) == b
        assert udfs.transferred(gold, a) == gold


def model(x):
    """The normal form step by step, with Python's regular expressions."""
    if x is None:
        return None
    x = " ".join(x.translate({0x0F38: 0x0F27, 0x0F85: 0x0F23}).split())
    for pattern, to in (("\\s+(?=[།-༑])", ""), ("(?<=[་༌])\\s+", ""), ("(?<=[ༀ-༊༒-࿿])\\s+(?=[ༀ-༊༒-࿿])", "་"), ("[་༌]{2,}", "་"), ("[་༌]+(?=[།-༑])", "")):
        x = re.sub(pattern, to, x)
    return x.strip() or None


def test_normalize_equals_model(spark):
    rng = random.Random(3)
    texts = [("".join(rng.choice("ཀཁ་༌ །༎\n\t༸") for _ in range(rng.randint(0, 15))),) for _ in range(300)] + [(None,), ("",)]
    for r in spark.createDataFrame(texts, "x string").withColumn("n", X.normalize(F.col("x"))).collect():
        assert r.n == model(r.x), repr(r.x)


def test_corruption_is_stable_and_small(spark):
    t = spark.createDataFrame([(i, ["ཀཁག", "ངཅ", "ཆཇཉ", "ཏ"]) for i in range(200)] + [(900, []), (901, [""])], "id long, a array<string>")
    t = t.withColumn("c", C.corrupt(F.col("a"), 7, F.col("id")))
    one, two = (rows(t.select("id", "c.type", F.array_join("c.syllables", "|").alias("s"))) for _ in range(2))
    assert one == two and len({r[2] for r in one}) == len(C.TYPES)


def test_sources(spark, tmp_path):
    a = tmp_path / "batch1.csv"
    a.write_text('task_id,image_id,annotator_a_transcript,annotator_b_transcript,final_reviewer_transcript\n1,i1,"x\ny",x,x\n', "utf-8")
    b = tmp_path / "batch2.csv"
    b.write_text("task_id,file_number,annotator_a_response,annotator_b_response,final_reviewer_response\n2,f2,p,q,p\n", "utf-8")
    got = {r.task_id: r for r in tables.load_batches(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got["1"].annotator_a_transcript == "x\ny" and got["1"].batch_name == "batch1" and got["2"].image_id == "f2" and got["2"].final_reviewer_transcript == "p"
    with pytest.raises(FileNotFoundError):
        tables.load_batches(spark, f"file://{tmp_path}/none*.csv")
    for folder, name, data in (("news", "a.txt", "ཀ".encode("utf-16")), ("news", "b.txt", b"\xef\xbb\xbfb"), ("__skip", "c.txt", b"c"), ("other", "d.txt", b"\xff\xff\xfe")):
        (tmp_path / "tree" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / folder / name).write_bytes(data)
    tree = {r.path.rsplit("/", 1)[-1]: r for r in tables.read_text_tree(spark, f"file://{tmp_path}/tree").collect()}
    assert set(tree) == {"a.txt", "b.txt", "d.txt"} and tree["a.txt"].text == "ཀ" and tree["b.txt"].text == "b" and not tree["d.txt"].readable
    tables.write_csv(spark.createDataFrame([("s", "t")], "source string, target string"), f"file://{tmp_path}/out_train", ["target", "source", "extra"])
    back = tables.read_csv(spark, f"file://{tmp_path}/out_train")
    assert back.columns[:3] == ["target", "source", "extra"]
    assert tables.read_pairs_tsv(spark, f"file://{tmp_path}/no.tsv").count() == 0
    with pytest.raises(ValueError):
        tables.unify(spark.createDataFrame([(1,)], "z int"))


def test_texts_within_some_edits_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(120)] + ["", "a", "ab"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            up, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
        return row[-1]

    t = spark.createDataFrame([(x,) for x in set(texts)], "a string")
    for most in (2, 5):
        got = {(r.a, r.b, r.distance) for r in lexicon.within(t, t.withColumnRenamed("a", "b"), most).collect()}
        assert got == {(a, b, edits(a, b)) for a in set(texts) for b in set(texts) if edits(a, b) <= most}


def test_training_load_and_exports(spark, tmp_path):
    schema = "source string, target string, split string, diff_category string"
    diff = spark.createDataFrame([("a", "b", "train", "x"), ("a", "c", "train", "y"), ("a", "d", "val", "y"), ("long text", "d", "train", "x"), ("e", "f", "train", None)], schema)
    same = spark.createDataFrame([("g", "g", "train"), ("h", "h", "val")], "source string, target string, split string")
    assert rows(training.load(diff, same, "train", 4, ("y",)).select("source", "target", "diff_category")) == sorted([("x", "a", "b"), (None, "e", "f"), ("identical", "g", "g")], key=repr)
    assert training.load(diff, same, "val", 4, ("y",)).count() == 2 and training.load(diff, same, "none").count() == 0
    tables.export_pairs(diff, same, f"file://{tmp_path}", {"differing_sentence": "old_name"})
    counts = {n: tables.read_csv(spark, f"file://{tmp_path}/{n}").count() for n in ("differing_sentence", "old_name", "identical_page")}
    assert counts == {"differing_sentence": 5, "old_name": 5, "identical_page": 2}


def test_verdicts_bisect_and_retry():
    calls = []

    def judge(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("again")
        return ["YES"] * (len(texts) if len(texts) < 3 else 1)

    assert verdict.ask(judge, ["a"] * 5, wait=0.0) == ["YES"] * 5


def test_judged_and_cache(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",)], "t string")
    assert rows(verdict.judged(texts, lambda: lambda x: ["NO"] * len(x))) == [("a", "NO"), ("b", "NO")]


def test_corrector(spark):
    df = spark.createDataFrame([("ab. cd.\nef",), (None,)], "text string")
    from scrivano.functions.profile import LATIN

    got = [r.prediction for r in infer.correct(df, lambda: str.upper, "text", LATIN).collect()]
    assert got == ["AB. CD.\nEF", None]


def test_process_pages(spark):
    t = curation.process_pages(spark, SF)
    assert t.columns == [*pairs.PAIR_COLUMNS, "diff_category", "edit_distance"]
    got = t.collect()
    assert got and all(r.source_role in ("annotator_a", "annotator_b") for r in got)
    splits = {}
    for r in got:
        assert splits.setdefault(r.page_id, r.split) == r.split
        assert not r.high_confidence_error or (r.both_annotators_agree and r.source != r.target)


def test_synthesis(spark):
    t = splitting._synth(spark, SF)
    kept = t.filter("reject_reason is null")
    assert kept.filter("source = target").count() == 0 and kept.groupBy("source_corpus").count().agg(F.max("count")).first()[0] <= 100
