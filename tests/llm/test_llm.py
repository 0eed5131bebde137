"""Operators against brute force on small tables, with nulls, ties, empty and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scrivano.llm import chat_schema, compact_windows, decontam_sw, es_mixing, golomb_dedup, pst_lm, quality_fm, simhash_vp, token_orc, toxicity_automata
from scrivano.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    texts += [texts[3], texts[3] + " ", texts[3].replace(" ", "\n"), "", None, " \t\n", texts[5][: len(texts[5]) // 2] + " zz " + texts[5][len(texts[5]) // 2 :], "x" * 5000]
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4}", None, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "lone text", None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (golomb_dedup.rice_decode(golomb_dedup.rice_encode(x)) == x).all()


def test_exact_dedup(docs, rows, spark):
    got = golomb_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), 2**63 if i is None else i))
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for sha, v in by_sha.items():
        own = [r for r in got if r.text_sha256 == sha]
        keep = min(v)[1]
        assert len(own) == len(v) and sum(r.kept for r in own) == 1
        assert all(r.group_size == len(v) and r.keep_id == (None if keep == 2**63 else keep) for r in own)
    assert golomb_dedup.exact_dedup(empty(spark)).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, rows, spark):
    got = simhash_vp.simhash_components(docs).collect()
    fp = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fp)
    label = list(range(len(fp)))
    for _ in fp:
        for a in range(len(fp)):
            for b in range(len(fp)):
                if (fp[a][1] ^ fp[b][1]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), g in zip(fp, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, 10**9))
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(g)) for (i, _), g in zip(fp, label, strict=True))
    assert simhash_vp.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [3, 4, 7, 8])
def test_vp_forest_finds_every_link(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**63, 150, dtype=np.uint64)
    more = [b ^ sum((np.uint64(1) << np.uint64(j) for j in set(rng.integers(0, 64, rng.integers(1, 7)).tolist())), np.uint64(0)) for b in x[:40] for _ in range(4)]
    x = np.unique(np.concatenate([x, np.array(more, np.uint64)]))
    home, visits, off = simhash_vp.vp_tree(5, bits // 4)
    leaves = defaultdict(list)
    for k, f in enumerate(x):
        for b in range(4):
            v = int(f >> np.uint64(16 * b)) & 0xFFFF
            leaves[b, home[v]].append((k, True))
            for leaf in visits[off[v] : off[v + 1]]:
                leaves[b, leaf].append((k, False))

    def classes(links):
        up = list(range(len(x)))

        def root(a):
            while up[a] != a:
                a = up[a]
            return a

        for a, b in links:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(a) for a in range(len(x))]

    found = []
    for own in leaves.values():
        k = np.array([a for a, _ in own])
        u, v = simhash_vp.leaf_links(x[k].view(np.int64), np.array([h for _, h in own]), bits)
        found += zip(k[u].tolist(), k[v].tolist(), strict=True)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    assert classes(found) == classes(zip(*(z.tolist() for z in np.nonzero(near)), strict=True))


def test_keep_one(docs, rows, spark):
    got = simhash_vp.keep_one(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and {60, 61, 62}.isdisjoint(ids) and 3 in ids and 0 in ids and got.filter("doc_id is null").count() == 1
    assert simhash_vp.keep_one(empty(spark)).count() == 0


def test_keep_one_finds_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for g in range(300):
        t = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        u = list(t)
        for _ in range(rng.randint(1, max(1, len(t) // 55))):
            u[rng.randrange(len(u))] = "changed"
        rows += [(2 * g, " ".join(t)), (2 * g + 1, " ".join(u))]
        a, b = (set(zip(*[x[k:] for k in range(5)])) for x in (t, u))
        pairs.append(len(a & b) / len(a | b))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash_vp.keep_one(d).collect()}
    assert all(2 * g in kept for g in range(300))
    alike = [g for g, j in enumerate(pairs) if j >= 0.8]
    assert len(alike) > 150 and sum(2 * g + 1 not in kept for g in alike) >= 0.93 * len(alike)
    assert all(2 * g + 1 in kept for g, j in enumerate(pairs) if j < 0.8)


def test_keep_one_finds_every_pair(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(4000)]
    line = [rng.choice(words) for _ in range(12)]
    texts = []
    for _ in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(20, 90))] + line
        texts.append(t)
        for _ in range(2):
            u = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // 45))):
                u[rng.randrange(len(u))] = f"new{rng.random()}"
            texts.append(u)
    texts += [["a", "b"], ["a", "b"], ["a", "c"], line * 40 + ["x"], line * 40 + ["y", "z", "q", "r", "s", "t", "o", "p"]]
    sets = [set(zip(*[x[k:] for k in range(5)])) or {tuple(x)} for x in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = [new if x == old else x for x in up]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash_vp.keep_one(d).collect()) == sorted(set(up))


def test_keep_one_verifies_only_what_sketches_leave(spark, monkeypatch):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for edits in [15] * 100 + [4] * 30:  # similarities of about 0.6 and 0.87
        t = [rng.choice(words) for _ in range(300)]
        u = list(t)
        for k in range(edits):
            u[k * (300 // edits) + rng.randrange(5)] = f"new{rng.random()}"
        texts += [" ".join(t), " ".join(u)]
    sets = [simhash_vp.shingle_set(t.encode(), 5) for t in texts] + [simhash_vp.shingle_set(b"a b", 5), np.zeros(0, np.uint64)]
    tried, write = [], simhash_vp.materialize

    def written(df, name):
        out = write(df, name)
        if name == "candidates":
            tried.append(out.filter("u <> v").count())
        return out

    monkeypatch.setattr(simhash_vp, "materialize", written)
    kept = {r.doc_id for r in simhash_vp.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(200)) | set(range(200, 260, 2))
    assert sum(tried) <= 45, tried  # of 130 pairs
    for x in sets[:40] + sets[-2:]:
        for y in sets[:60] + sets[200:] + [sets[0][::3]]:
            assert simhash_vp.sketches_differ(simhash_vp.set_sketch(x), simhash_vp.set_sketch(y)) <= len(np.setxor1d(x, y))


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json"))


def test_tokens(docs, rows, spark):
    from tokenizers import Tokenizer

    path = tokenizer()
    tok = Tokenizer.from_file(path)
    got = {r.start: r for r in token_orc.token_digest(token_orc.tokens_table(docs, path)).collect()}
    at = 0
    same = sorted(((-1 if i is None else i), t or "") for i, t, *_ in rows)
    for i, t in same:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        r = got[at]
        assert (r.doc_id, r.n_tokens, r.ids_crc32) == (None if i < 0 else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_orc.tokens_table(empty(spark), path).count() == 0


def test_piecewise_encoding_equals_whole():
    from tokenizers import Tokenizer

    path = tokenizer()
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "!", "é", "<|endoftext|>", " ", "　", "12", "\x1c", "x.", " I'll", ",", '."', "word,", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    assert token_orc.encode_texts(texts, path) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_new_pieces_share_calls_of_the_model():
    path = tokenizer()
    token_orc.encode_texts(["x"], path)
    pieces = token_orc.worker_cache("tokenizers")[path].pieces
    rng, model, calls = random.Random(5), pieces.model, []

    class Counted:
        def tokenize(self, x):
            calls.append(x)
            return model.tokenize(x)

    words = ["".join(rng.choice("abdeghilnorstuéñü") for _ in range(12)) for _ in range(3000)]
    pieces.model = Counted()
    try:
        got = token_orc.encode_texts([" ".join(words[k : k + 100]) for k in range(0, 3000, 100)] * 2, path)
    finally:
        pieces.model = model
    assert got[:30] == got[30:] and 0 < len(calls) <= 100, len(calls)


@pytest.mark.parametrize("ignore_merges", [False, True])
def test_cutting_in_arrays_equals_whole(tmp_path, monkeypatch, ignore_merges):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = ignore_merges  # such a model takes a piece that it knows as it is, so only piece by piece
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    tok = Tokenizer.from_file(path)
    assert (token_orc.Encoder(path).pieces.call == 1) == ignore_merges
    monkeypatch.setattr(token_orc, "MEMO", 50)  # so that pieces are forgotten all the time
    monkeypatch.setattr(token_orc, "TOGETHER", 400)
    rng = random.Random(3)
    plain = ["a", "the", " ", "  ", "\n", " \n", "\n ", "'s", "'", "l", "'ll", "'ve", "'re", "'v", "'d", "e", "S", "'M", "é", "ÿ", "Ā", "ɏ", "×", "÷", "€", "…", "‐", "12", "x.", ",", "!!", "word"]
    odd = [*plain, "\0", "\t", "\r\n", "<|endoftext|>", "\u00a0", "\u00aa", "\u00ad", "\u00b2", "\u0250", "\u20ad", "\u3000", "漢", "न", "😀"]
    texts = ["".join(rng.choice(odd if k % 7 == 0 else plain) for _ in range(rng.randint(0, 16))) for k in range(3000)]
    assert token_orc.encode_texts([*texts, None], path) == [*(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts), b""]


def test_orc_has_bloom_filters_and_lookups_skip_row_groups(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    d = spark.range(6000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(d.coalesce(1), where, tokenizer(), stride=1000)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    groups = 0
    for f in tmp_path.glob("t/*.orc"):
        path = jvm.org.apache.hadoop.fs.Path(f"file://{f}")
        reader = jvm.org.apache.orc.OrcFile.createReader(path, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for stripe in range(reader.getStripes().size()):
            kinds = [str(x.getKind()) for x in rows.readStripeFooter(reader.getStripes().get(stripe)).getStreamsList()]
            assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
            groups += -(-reader.getStripes().get(stripe).getNumberOfRows() // 1000)
    assert groups >= 6
    some = {r.doc_id: r for r in token_orc.lookup(spark, where, [4, 6000]).collect()}
    every = {r.doc_id: r for r in token_orc.read_tokens(spark, where).collect()}
    assert set(some) == {4, 6000} and all(every[k] == v for k, v in some.items()) and some[6000].start > some[4].start
    # of an id between those that are there, row groups whose range has it are skipped by the Bloom filter alone
    scan = spark.read.orc(where).filter("doc_id = 4001").select("doc_id")
    assert scan.collect() == []
    plan = scan._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert read < 1000, read


def test_mix_takes_targets(docs, rows, spark):
    got = es_mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6
    for s, (target, size) in targets.items():
        own = [r for r in got if r.source == s]
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own)
    assert es_mixing.mix(empty(spark)).count() == 0
    again = es_mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mix_buckets_are_even_for_small_weights(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 0.01).otherwise(20.0).alias("w"))
    seen = []
    wrapped = es_mixing.join_small

    def spy(left, *rest):
        seen.append(left.groupBy("bucket").count().agg(F.max("count"), F.count(F.lit(1))).first())
        return wrapped(left, *rest)

    es_mixing.join_small = spy
    try:
        es_mixing.mix(d, weight=F.col("w"))
    finally:
        es_mixing.join_small = wrapped
    assert seen[0][0] <= 2 * 20_000 / 20 and seen[0][1] >= 15


def test_mixed_rows_repeat_documents(docs):
    rows = es_mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() > 0


def test_chat_round_trip(spark):
    bad = [(1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 0, "user", "a\\b<c#d:e\n"), (2, 0, "a:b#<", ""), (3, 5, None, None), (3, 5, None, None), (None, None, "assistant", "x")]
    df = spark.createDataFrame(bad, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_schema.parse(materialize(chat_schema.format_rows(df), "t")).collect()}
    assert [(t.role, t.text, t.loss_text) for t in got[1].turns] == [("user", "a\\b<c#d:e\n", None), ("assistant", bad[0][3], bad[0][3])]
    assert [(t.role, t.text) for t in got[2].turns] == [("a:b#<", "")]
    assert len(got[3].turns) == 2 and got[None].turns[0].loss_text == "x"
    for r in got.values():
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
    assert chat_schema.format_rows(df.limit(0)).count() == 0


def test_rows_of_several_layouts_in_one_table(spark):
    schema = "conv_id long, turn long, role string, text string, conversation_id long, position int, speaker string, content string, thread struct<id:long,index:long>, message struct<role:string,content:string>, text2 string"
    rows = [
        (1, 0, "user", "a", None, None, None, None, None, None, "x"), (1, 1, "assistant", None, None, None, None, None, None, None, "x"),
        (None, None, None, None, 2, 1, "assistant", "c", None, None, None), (None, None, None, None, 2, 0, None, "b", None, None, "x"),
        (None, None, None, None, None, None, None, None, (3, 0), ("user", "d"), "x"), (None, None, None, None, None, None, None, None, (3, 1), ("assistant", "e"), "x"), (None,) * 11,
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_schema.parse(materialize(chat_schema.format_rows(df), "mixed")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "")], 2: [("", "b"), ("assistant", "c")], 3: [("user", "d"), ("assistant", "e")], None: [("", "")]}
    with pytest.raises(ValueError):
        chat_schema.format_rows(df.select("conv_id", "text"))


def test_layouts(spark):
    rows = [('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":3}',), ('{"prompt":"p","response":"r"}',), ('{"instruction":"i","input":"j","output":"o"}',), ('{"conversations":[{"from":"human","value":"h"}]}',), ("no json",), (None,)]
    got = chat_schema.canonical_turns(spark.createDataFrame(rows, "payload string")).collect()
    assert [r.layout for r in got] == ["messages", "prompt_response", "instruction_input", "share", "unknown", "unknown"]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "i\nj"), ("assistant", "o")]
    assert got[4].turns is None


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)), 4)
    idx, x = np.array([1, 4, 7]), np.array([0.5, 2.0, -1.0])
    brute = 0.3 + m.w[idx] @ x + sum(m.v[idx[a]] @ m.v[idx[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert np.isclose(m.logits(idx, x, np.array([0]))[0], brute)


def labelled(spark):
    rng = random.Random(4)
    words = ["tree", "house", "river", "stone", "cloud", "green", "walk"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = " ".join(rng.choice(words) for _ in range(40))
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split()) + " wretched"
        rows.append((i, t, "en", "s", len(t), 0.0))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame([*rows, (None, None, None, None, None, None)], SCHEMA), spark.createDataFrame([*labels, (None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [quality_fm, toxicity_automata])
def test_scores_beside_clashing_columns(spark, op):
    d, labels = labelled(spark)
    model = op.train(d, labels.withColumn("text", F.lit("other")).withColumn("score", F.lit(1)), F.lit(True))
    out = op.score(d, model, name="mine")
    assert out.columns == [*d.columns, "mine"]
    want = {r.doc_id: r.score for r in op.score(d, model).collect()}
    rows = out.collect()
    assert all(r.mine == want[r.doc_id] for r in rows) and {r.score for r in rows} == {0.0, None}
    assert op.score(d.limit(0), op.train(d.limit(0), labels, F.lit(True))).count() == 0
    long = spark.createDataFrame([(1, "wretched " * 300_000), (1, "wretched " * 300_000)], "doc_id long, text string")
    a, b = (r.score for r in op.score(long, model).collect())
    assert a == b and 0 <= a <= 1


def test_quality_learns(spark):
    d, labels = labelled(spark)
    model = quality_fm.train(d, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality_fm.score(d, model).collect()}
    assert all((got[i] < 0.3) == (i % 4 == 0) for i in range(0, 240, 5)) and 0 <= got[None] <= 1
    none = quality_fm.train(d, labels.limit(0), F.lit(True))
    assert quality_fm.score(d, none).agg(F.avg("score")).first()[0] == pytest.approx(0.5)


def test_toxicity_learns(spark):
    d, labels = labelled(spark)
    model = toxicity_automata.train(d, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity_automata.score(d, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(1, 240, 3)) and got[None] < 0.7
    none = toxicity_automata.train(d, labels.limit(0), F.lit(True))
    assert toxicity_automata.score(d.limit(2), none).first().score == pytest.approx(0.5)


def test_toxicity_counts_misspellings_absent_from_the_sample(spark):
    d, labels = labelled(spark)
    model = toxicity_automata.train(d, labels, F.lit(True))
    texts = spark.createDataFrame([(1, "tree wretchid house"), (2, "tree wretched house"), (3, "tree river house")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity_automata.score(texts, model).collect()}
    assert got[3] < 0.3 and 0.5 < got[1] < got[2]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = ["abcab", "bca", "abcabcabc", "ccbaab"]
    m = toxicity_automata.Machine(terms, [])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        near = [edits(w, t) for t in terms if edits(w, t) <= toxicity_automata.edits_allowed(t)]
        got = m.match(w)
        assert (got is None) == (not near)
        if got:
            assert (got[0] == toxicity_automata.EXACT) == (w in terms)


def test_quotation_counts_less():
    words = 'they said "you idiot" yesterday'.split()
    assert toxicity_automata.context(words, 3) < toxicity_automata.context("well you idiot there".split(), 2)


def test_language_model(docs, rows, spark):
    got = pst_lm.pst_scores(docs).collect()
    train = [t or "" for i, t, *_ in rows if zlib.crc32(str("null" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert pst_lm.pst_scores(empty(spark)).count() == 0


def test_language_model_scores_do_not_depend_on_blocks(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = [(i, f"alpha beta gamma x{i}") for i in ids[:40]]
    schema = "doc_id long, text string"
    rows_of = spark.sparkContext.parallelize
    one = spark.createDataFrame(rows_of([*train, (held, "alpha beta gamma")], 1), schema)
    apart = spark.createDataFrame(rows_of(train, 1).union(rows_of([(held, "alpha beta gamma")], 1)), schema)
    a, b = ({r.doc_id: r.score for r in pst_lm.pst_scores(d).collect()} for d in (one, apart))
    assert a == pytest.approx(b)


def suffix_tree(texts, depth=2):
    """A function of (context, token), None being the end and False the beginning, by counts in dictionaries."""
    docs = [[False, *t.encode().lower().split(), None] for t in texts]
    c = Counter(x for d in docs for x in d[1:])
    n_all, kinds = sum(c.values()), len(c)
    pairs, ctxs = Counter(), Counter()
    for d in docs:
        for i in range(1, len(d)):
            for k in range(1, min(i, depth) + 1):
                pairs[tuple(d[i - k : i]), d[i]] += 1
                ctxs[tuple(d[i - k : i])] += 1
    following = defaultdict(list)
    for (ctx, x), n in pairs.items():
        if n >= 2:
            following[ctx].append((x, n))
    states = {}

    def share(ctx, x):
        if not ctx:
            return c[x] / n_all
        if ctx in states and pairs[ctx, x] >= 2:
            return pairs[ctx, x] / ctxs[ctx]
        return share(ctx[1:], x)

    def added(x, unit):  # the operator adds its terms as integers
        return sum(np.rint(np.array(x) * unit)) / unit

    for ctx in sorted(following, key=len):
        up = [share(ctx[1:], x) for x, _ in following[ctx]]
        n = [m for _, m in following[ctx]]
        total = ctxs[ctx]
        unseen, below = max(1 - sum(n) / total, 1e-12), max(1 - added(up, pst_lm.SHARE_UNIT), 1e-12)
        gain = 2 * added([m * np.log(m / total / u) for m, u in zip(n, up, strict=True)], pst_lm.GAIN_UNIT) + 2 * total * unseen * np.log(unseen / below)
        if gain > 3.84 * len(n) + 10:
            states[ctx] = 1 - sum(m - 0.5 for m in n) / (total + 6)

    def p(ctx, x):
        if not ctx:
            return ((c[x] - 0.7) if c[x] else 0.7 * kinds + 1) / (n_all + 1)
        if ctx not in states:
            return p(ctx[1:], x)
        return states[ctx] * p(ctx[1:], x) + ((pairs[ctx, x] - 0.5) / (ctxs[ctx] + 6) if pairs[ctx, x] >= 2 else 0)

    return p, c, states


def test_language_model_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "tree", "falls", "in", "a", "wood"]
    texts = []
    for i in range(300):
        t = [rng.choice(words), rng.choice(words)]
        while rng.random() < 0.93:
            known = [words.index(x) for x in t[-2:] if x in words]
            t.append(words[(sum(known) + known[0] + 1) % 6] if len(known) == 2 and rng.random() < 0.7 else rng.choice(words))
            if rng.random() < 0.05:
                t.append(f"rare{rng.randint(0, 40)}")
        texts.append(" ".join(t))
    texts[7], texts[9] = "", None
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(300)]
    p, c, states = suffix_tree([t or "" for t, h in zip(texts, held, strict=True) if not h])
    assert len(states) > 10 and max(map(len, states)) == 2
    for ctx in [(), ("falls".encode(),), *list(states)[:20], *list(states)[-20:]]:
        assert sum(p(ctx, x) for x in [*c, b"unknown"]) == pytest.approx(1.0)
    scores = []
    for parts in (1, 16):
        d = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), parts), "doc_id long, text string")
        scores.append({r.doc_id: r for r in pst_lm.pst_scores(d).collect()})
    for i, t in enumerate(texts):
        seq = [False, *(t or "").encode().lower().split(), None]
        want = sum(np.log10(p(tuple(seq[max(0, k - 2) : k]), seq[k])) for k in range(1, len(seq)))
        assert scores[0][i].score == pytest.approx(want, rel=1e-9)
        assert scores[0][i].score == pytest.approx(scores[1][i].score, rel=1e-12) and scores[0][i].held_out == held[i]
    assert sum(r.score for r in scores[0].values() if r.held_out) > sum(r.base_score for r in scores[0].values() if r.held_out)


def test_passages(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    shared = prose(70)
    texts = [prose(200) for _ in range(12)]
    texts[1][40:40] = shared
    texts[7][10:10] = shared
    edited = list(shared)
    edited[35] = "other"
    texts[9][100:100] = edited
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, ""), (51, None), (52, "a b")], "doc_id long, text string").repartition(3)
    got = compact_windows.passages(d).collect()
    assert {1, 7, 9} == {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert all(r.similarity >= 0.65 for r in got)
    exact = [r for r in got if {r.doc_id, r.other_doc_id} == {1, 7}]
    assert exact and max(r.last_word - r.first_word for r in exact) >= 65
    assert compact_windows.passages(d.limit(0)).count() == 0


def test_compact_windows_cover_every_run():
    texts = [b" ".join(b"t%d" % random.Random(k).randint(0, 40) for k in range(j, j + 120)) for j in (0, 7)]
    e, text = compact_windows.block_elements(texts)
    sig, own, at, first, last = compact_windows._block_windows(e, text, len(texts), 20, 3)
    for i in (0, 1):
        x = e[text == i]
        assert sorted(s for a, b in zip(first[own == i], last[own == i], strict=True) for s in range(a, b + 1)) == sorted(3 * list(range(len(x) - 19)))
        assert all(a <= c < b + 20 for a, b, c in zip(first[own == i], last[own == i], at[own == i], strict=True))


def brute_passages(texts, words=50, least=0.8):
    """Pairs of texts with a passage, by the verification of every offset group that has common elements."""
    known = compact_windows._Hashes()
    e = [compact_windows.elements((t or "").encode().lower(), known) for t in texts]
    out = set()
    for i in range(len(e)):
        for j in range(i):
            p, q = np.nonzero(e[i][:, None] == e[j][None, :]) if len(e[i]) and len(e[j]) else ((), ())
            groups = set(((np.array(p, np.int64) - np.array(q, np.int64)) // compact_windows.STEP).tolist())
            if any(compact_windows.verified((i, 0, 0, e[i]), (j, 0, 0, e[j]), g, words - 4, least) for g in groups):
                out.add((j, i))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_passages_of_edited_chains_equal_brute_force(spark, parts):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    line = prose(9)  # short, in all texts
    texts = []
    for _ in range(30):
        a = prose(60)
        b = [*a[:20], "edited", *a[21:]]
        c = [*b[:45], "too", *b[46:]]
        texts += [" ".join([*prose(60), *line, *prose(30), *x, *prose(60)]) for x in (a, b, c)]
    texts += ["", None, "a b", " ".join(line * 20), texts[0], texts[0]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    d = spark.createDataFrame(spark.sparkContext.parallelize([(i, texts[i]) for i in order], parts), "doc_id long, text string")
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in compact_windows.passages(d).collect()}
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in got:
        up[root(x)] = root(y)
    want = brute_passages(texts)
    assert got <= want and len(want) > 60
    found = sum(root(x) == root(y) for x, y in want)
    assert found >= len(want) - 1
    chains = [(3 * g + k, 3 * g + k + 1) for g in range(1, 30) for k in (0, 1)]
    assert set(chains) <= want and sum(x in got for x in chains) >= len(chains) - 1


@pytest.mark.parametrize("parts", [1, 7])
def test_passages_try_all_that_meet_in_a_signature(spark, parts):
    rng = random.Random(17)
    words = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(58)]
        for _ in range(8):
            own = list(base)
            for k in rng.sample(range(58), 3):
                own[k] = f"own{rng.random()}"
            twin = list(own)
            twin[rng.choice([3, 54])] = f"own{rng.random()}"
            texts += [" ".join(own), " ".join(twin)]
    rng.shuffle(texts)
    d = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), parts), "doc_id long, text string")
    rows = compact_windows.passages(d)
    got = {r.doc_id: r.class_id for r in compact_windows.classes(rows).collect()}
    e, own = compact_windows.block_elements([t.encode().lower() for t in texts])
    sig, text, *_ = compact_windows._block_windows(e, own, len(texts), 46, 6)
    met = {(a, b) for s in np.unique(sig) for a in text[sig == s].tolist() for b in text[sig == s].tolist() if a < b}
    want = brute_passages(texts) & met
    assert len(want) > 60 and all(got[a] == got[b] for a, b in want)
    assert {(min(r.doc_id, r.other_doc_id), max(r.doc_id, r.other_doc_id)) for r in rows.collect()} <= brute_passages(texts)


def test_sketches_rule_out_most_that_a_line_brings_together_and_no_passage(spark, monkeypatch):
    rng = random.Random(29)
    words = [f"v{i}" for i in range(3000)]
    line = [rng.choice(words) for _ in range(14)]  # shorter than a passage, in all texts
    texts = [" ".join([rng.choice(words) for _ in range(60)] + line + [rng.choice(words) for _ in range(60)]) for _ in range(120)]
    for k in range(0, 40, 2):  # passages that differ in a word or two about the line
        own = texts[k].split()
        own[50] = "edited"
        own[rng.choice([100, 110])] = "too"
        texts[k + 1] = " ".join(own)
    d = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 8), "doc_id long, text string")
    asked, across = [], compact_windows._across
    monkeypatch.setattr(compact_windows, "_across", lambda blocks, links, *more: across(blocks, asked.append(links.count()) or links, *more))
    rows = compact_windows.passages(d)
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in rows.collect()}
    assert got <= brute_passages(texts) and sum((k, k + 1) in got for k in range(0, 40, 2)) >= 19
    assert asked[1] < 400, asked  # of thousands that meet in a signature


def test_bytes_rule_out_what_a_long_line_brings_together_and_no_passage(spark, monkeypatch):
    rng = random.Random(31)
    words = [f"v{i}" for i in range(3000)]
    line = [rng.choice(words) for _ in range(34)]  # shorter than a passage, longer than a sketch's piece, in all texts
    texts = [" ".join([rng.choice(words) for _ in range(60)] + line + [rng.choice(words) for _ in range(60)]) for _ in range(120)]
    for k in range(0, 40, 2):
        own = texts[k].split()
        own[50] = "edited"
        own[rng.choice([100, 110])] = "too"
        texts[k + 1] = " ".join(own)
    d = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 8), "doc_id long, text string")
    asked, across = [], compact_windows._across
    monkeypatch.setattr(compact_windows, "_across", lambda blocks, links, *more: across(blocks, asked.append(links.count()) or links, *more))
    got = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in compact_windows.passages(d).collect()}
    assert got <= brute_passages(texts) and sum((k, k + 1) in got for k in range(0, 40, 2)) >= 19
    assert asked[1] < 200, asked  # of thousands that sketches alone leave


def test_what_may_verify_leaves_sketches_and_bytes_leave():
    rng = random.Random(37)
    base = [rng.choice(range(3000)) for _ in range(260)]
    texts = []
    for edits in (0, 1, 2, 4, 8, 20):
        for cut in (0, 7, 150):
            own = [*base[cut:]]
            for k in rng.sample(range(len(own)), edits):
                own[k : k + rng.choice([0, 1])] = [rng.choice(range(3000))]
            texts.append(" ".join(map(str, own)).encode())
    e, own = compact_windows.block_elements(texts)
    offset = np.searchsorted(own, np.arange(len(texts) + 1))
    _, text, at, _, _ = compact_windows._block_windows(e, own, len(texts), 46, 6)
    about = compact_windows.abouts(e, offset, text, at, 46)
    asking, answering = compact_windows.sketches(about, 46)
    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(at)), np.arange(len(at))))
    some = np.random.default_rng(1).choice(len(x), 20_000, replace=False)
    x, y = x[some], y[some]
    want = compact_windows.may_verify(e, offset, text, at, x, y, 46, 0.8)
    assert 200 < want.sum() < len(want)
    left = compact_windows.bytes_meet(about[x], about[y], 46, 0.8)
    assert not (want & ~compact_windows.sketches_meet(asking, answering, 46, 0.8)[x, y]).any()
    assert not (want & ~left).any() and (left & ~want).sum() < 0.02 * len(want)


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(13)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        best = max(map(max, h))
        score, first, last = decontam_sw.align(np.array(a), np.array(b))
        assert score == best
        if score:  # the part alone gives the score
            assert decontam_sw.align(np.array(a), np.array(b[first : last + 1]))[0] == best


def test_decontamination_reports_each_copy(spark):
    rng = random.Random(3)
    words = [f"u{i}" for i in range(900)]
    item, short = [rng.choice(words) for _ in range(20)], ["only", "two"]
    gap = [rng.choice(words) for _ in range(300)]
    texts = [[*gap, *item, *gap, *item, *item, "changed", *item[1:], *gap], [*short, *gap, *short], gap, item, item]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in decontam_sw.find(d, b).collect())
    one = [(300, 319), (620, 639), (640, 659), (661, 679)]
    assert [x for x in got if x[0] == 0] == [(0, i, *x) for i in (0, 2) for x in one]
    assert [x for x in got if x[0] == 1] == [(1, 1, 0, 1), (1, 1, 302, 303)]
    assert [x[:2] for x in got if x[0] > 1] == [(3, 0), (3, 2), (4, 0), (4, 2)]
    assert [r.doc_id for r in decontam_sw.decontaminate(d, b).collect()] == [2]


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"u{i}" for i in range(2000)]
    items = [[rng.choice(words) for _ in range(30)] for _ in range(5)]
    texts = [[rng.choice(words) for _ in range(150)] for _ in range(20)]
    texts[4][50:50] = items[0]
    edited = [w if k % 6 else "changed" for k, w in enumerate(items[1])]
    texts[8][20:20] = edited[:15] + ["more"] + edited[15:]
    texts[11][0:0] = items[2][:6]  # a few common words are no copy
    d = spark.createDataFrame([(i, " ".join(t).upper() if i == 4 else " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (None, " ".join(items[3]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam_sw.find(d, b).collect()}
    assert set(got) == {(4, 0), (8, 1), (None, 3)} and got[4, 0].score == 1.0
    assert (got[4, 0].first_word, got[4, 0].last_word) == (50, 79)
    assert decontam_sw.decontaminate(d, b).count() == d.count() - 3
    assert decontam_sw.find(d, b.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
