"""SimHash near-duplicates by vantage-point trees.

A 64-bit fingerprint is cut into 4 blocks of 16 bits: two fingerprints within R bits are within floor(R / 4) in one block at
least. For each block a vantage-point tree over the 2^16 block values splits the space by Hamming distance to vantage
points; its leaves are the shards. A fingerprint lives in one leaf a block and visits the leaves whose boundary its ball
overlaps, by the triangle inequality; of two sides only one visits. (Trees over all 64 bits prune next to nothing: distances
between unlike texts crowd within 32 +- 4, and a ball of radius 4 crosses almost every boundary.) In a leaf all 64 bits
are compared, so links are exact, and only a spanning forest of them is given out. Leaves with more than `leaf_rows`
members are dealt in chunk pairs over tasks, so no task holds more than twice that.

Distinct fingerprints stand for their documents; components are built over fingerprints in a distributed way.

Nulls, ties, repeats: null and empty texts have fingerprint zero and link like any other; equal texts share a fingerprint;
null ids count only if their component has no other id, component_id is then null; repeated rows each get a row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, join_small, materialize, recording, release, utf8, worker_cache
from .components import components

BLOCKS, SPACE_BITS = 4, 16


def fingerprints(text: bytes, words: int = 4, seed: int = 42, second: bool = False) -> list[bytes]:
    """8 bytes, most significant first: a bit is set if it is set in over half of the shingles' XXH64. With second, also one of
    the hashes mixed anew."""
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return [bytes(8)] * (1 + second)
    return [_majority(h), _majority(_mixed(h.astype(np.uint64)).astype(">u8"))] if second else [_majority(h)]


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle; of the whole sequence if there are fewer words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, ">u8")
    s = b" ".join(w)
    digest = xxhash.xxh64_digest
    if len(w) <= words:
        return np.frombuffer(digest(s, seed), ">u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.append(0, ends[:-words]).tolist()
    return np.frombuffer(b"".join([digest(s[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]), ">u8")


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _majority(h: np.ndarray) -> bytes:
    rows = h.view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for k in range(0, len(rows), 255):
        count += np.add.reduce(np.unpackbits(rows[k : k + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(rows)).tobytes()


def _fingerprinter(words: int, second: bool):
    def run(batches):
        for batch in batches:
            prints = [fingerprints(t, words, second=second) for t in utf8(batch.column("text"))]
            cols = [pa.array(np.frombuffer(b"".join([p[k] for p in prints]), ">i8").astype(np.int64)) for k in range(1 + second)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), cols[0], cols[-1]], ["doc_id", "key", "fp", "check"])

    return run


def vp_tree(levels: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home leaf of every block value; and, grouped by value, the leaves it visits with their offsets."""
    pairs = []
    home = np.zeros(1 << SPACE_BITS, np.int32)
    rng = np.random.default_rng(7)

    def grow(leaf: int, level: int, own: np.ndarray, guests: np.ndarray) -> None:
        if level == levels or len(own) <= 1:
            home[own] = leaf << (levels - level)
            pairs.append((guests, np.full(len(guests), leaf << (levels - level), np.int32)))
            return
        vantage = own[rng.integers(len(own))]
        d, g = np.bitwise_count(own ^ vantage).astype(int), np.bitwise_count(guests ^ vantage).astype(int)
        cuts = np.unique(d)[:-1]
        if not len(cuts):
            cuts = d[:1]
        t = cuts[np.argmin([abs(2 * np.count_nonzero(d <= c) - len(d)) for c in cuts])]
        inside, outside = own[d <= t], own[d > t]
        grow(2 * leaf, level + 1, inside, np.concatenate([guests[g <= t + radius], outside[d[d > t] <= t + radius]]))
        grow(2 * leaf + 1, level + 1, outside, guests[g > t - radius])

    grow(0, 0, np.arange(1 << SPACE_BITS, dtype=np.uint16), np.zeros(0, np.uint16))
    value, leaf = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(value, kind="stable")
    return home, leaf[order], np.append(0, np.cumsum(np.bincount(value, minlength=1 << SPACE_BITS)))


def _dealer(levels: int, radius: int):
    def deal(batches):
        cache = worker_cache("vp_trees")
        if (levels, radius) not in cache:
            cache[levels, radius] = vp_tree(levels, radius)
        home, visits, off = cache[levels, radius]
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for b in range(BLOCKS):
                value = (fp.view(np.uint64) >> np.uint64(16 * b)).astype(np.uint16).astype(np.int64)
                n = off[value + 1] - off[value]
                at = np.repeat(off[value] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                leaf = np.concatenate([home[value], visits[at]])
                cols = [pa.array(np.concatenate([x, np.repeat(x, n)])) for x in (batch.column(c).to_numpy() for c in ("node", "fp", "check"))]
                yield pa.RecordBatch.from_arrays([pa.array((b << levels) | leaf.astype(np.int32), pa.int32()), *cols, pa.array(np.arange(len(leaf)) < len(fp))], ["shard", "node", "fp", "check", "home"])

    return deal


def leaf_links(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that link, as a spanning forest: every pair within bits, one of it at home, ends up connected."""
    x = fp.view(np.uint64)
    own = np.flatnonzero(home)
    every = np.arange(len(x))
    linked = np.zeros(len(x), bool)
    step = max(1, 2_000_000 // max(1, len(x)))
    for k in range(0, len(own), step):
        rows = own[k : k + step]
        close = np.bitwise_count(x[rows][:, None] ^ x[every][None, :]) <= bits
        hit = np.count_nonzero(close, axis=1) > 1  # each is near itself
        linked[rows[hit]] = True
        linked |= close[hit].any(axis=0)
    left = np.flatnonzero(linked)
    us, vs = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            c = queue.pop()
            close = np.bitwise_count(x[left] ^ x[c]) <= bits
            if close.any():
                found = left[close]
                us.append(np.full(len(found), c))
                vs.append(found)
                queue += found.tolist()
                left = left[~close]
    return (np.concatenate(us), np.concatenate(vs)) if us else (own[:0], own[:0])


def nearest_links(x: np.ndarray, y: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose two fingerprints differ by most bits together, as a minimum spanning forest: each is linked through its
    nearest, so that links are the likeliest to be verified."""

    def apart(rows, cols):
        return np.bitwise_count(x[rows] ^ x[cols]) + np.bitwise_count(y[rows] ^ y[cols])

    own = np.flatnonzero(home)
    every = np.arange(len(x))
    linked = np.zeros(len(x), bool)
    step = max(1, 2_000_000 // max(1, len(x)))
    for k in range(0, len(own), step):
        rows = own[k : k + step]
        close = apart(rows[:, None], every[None, :]) <= most
        hit = np.count_nonzero(close, axis=1) > 1
        linked[rows[hit]] = True
        linked |= close[hit].any(axis=0)
    left = np.flatnonzero(linked)
    us, vs = [], []
    best, via = np.full(len(left), 255, np.uint8), np.zeros(len(left), np.int64)
    while len(left):
        k = int(best.argmin())
        c = left[k]
        if best[k] <= most:
            us.append(via[k])
            vs.append(c)
        left, best, via = np.delete(left, k), np.delete(best, k), np.delete(via, k)
        d = apart(left, c)
        nearer = d < best
        best[nearer], via[nearer] = d[nearer], c
    return np.array(us, np.int64), np.array(vs, np.int64)


def _linker(bits: int, most: int | None):
    def link(t: pa.Table) -> pa.Table:
        node, fp, check, home = (t.column(c).to_numpy() for c in ("node", "fp", "check", "home"))
        order = np.lexsort((~home, node))  # a node once, at home if it is
        node, fp, check, home = node[order], fp[order], check[order], home[order]
        first = np.append(True, node[1:] != node[:-1])
        node = node[first]
        u, v = leaf_links(fp[first], home[first], bits) if most is None else nearest_links(fp[first].view(np.uint64), check[first].view(np.uint64), home[first], most)
        return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})

    return link


def links(prints: DataFrame, bits: int, rows: int, most: int | None = None, leaf_rows: int = 20000) -> DataFrame:
    """prints: node, fp, check, distinct. u, v: nodes; links that connect whatever is within bits in fp. With most: whatever is
    within bits / 4 in a block of fp and within most in fp and check together."""
    levels = int(np.clip(np.ceil(np.log2(max(1, rows) / 512)), 2, 14))
    dealt = prints.select("node", "fp", "check").mapInArrow(_dealer(levels, bits // BLOCKS), "shard int, node long, fp long, check long, home boolean")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("g")).filter("g > 1")
    dealt = dealt.join(F.broadcast(sizes), "shard", "left")  # at most 4 * 2^14 shards
    chunk = F.pmod(F.xxhash64("node"), F.col("g"))
    pairs = F.when(F.col("g").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda k: F.struct(F.least(chunk, k).alias("a"), F.greatest(chunk, k).alias("b"))))
    dealt = dealt.select("shard", "node", "fp", "check", "home", F.explode(pairs).alias("p")).select("shard", "node", "fp", "check", "home", "p.a", "p.b")
    return dealt.groupBy("shard", "a", "b").applyInArrow(_linker(bits, most), "u long, v long")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def prefix(own: np.ndarray, least: float, popular: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets of a Jaccard similarity of least have one of them in common, as
    they share least * n of each one's n shingles. The order is the same for all sets, whatever popular holds."""
    n = len(own)
    if not n:
        return own
    seen = np.zeros(n, np.int64)
    if len(popular):
        at = np.minimum(np.searchsorted(popular, own), len(popular) - 1)
        seen = np.where(popular[at] == own, times[at], 0)
    return own[np.lexsort((own, seen))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def set_sketch(own: np.ndarray) -> bytes:
    """Whether an odd number of a set's shingles fall on each bit, of two bits or more a shingle."""
    bits = max(256, 1 << (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer folded: in no more than the sets differ in shingles."""
    x, y = sorted((np.frombuffer(z, np.uint64) for z in (x, y)), key=len)
    while len(x) < len(y):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sifter(least: float):
    """Candidates whose sketches do not rule a Jaccard similarity of least out: sets of such differ in at most
    (1 - least) / (1 + least) of their sizes together."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sketch_u", "sketch_v", "size_u", "size_v")), strict=True)
            mask = pa.array([sketches_differ(x, y) * (1 + least) <= (1 - least) * (m + n) + 1e-6 for x, y, m, n in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v")], ["u", "v"])

    return run


def _prefixer(words: int, least: float, popular: bytes, times: bytes):
    """Fingerprints, a hash of the shingle set, its size, its sketch and its prefix."""

    def run(batches):
        pop, freq = np.frombuffer(popular, np.uint64), np.frombuffer(times, np.int64)
        for batch in batches:
            prints, nodes, sizes, drawn, parts = [], [], [], [], []
            for t in utf8(batch.column("text")):
                h = shingle_hashes(t, words)
                own = np.unique(h.astype(np.uint64))
                prints.append((_majority(h), _majority(_mixed(h.astype(np.uint64)).astype(">u8"))) if len(h) else (bytes(8), bytes(8)))
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                drawn.append(set_sketch(own))
                parts.append(prefix(own, least, pop, freq))
            fp, check = (np.frombuffer(b"".join([p[k] for p in prints]), ">i8").astype(np.int64) for k in (0, 1))
            off = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp), pa.array(check), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(drawn, pa.binary()), pa.ListArray.from_arrays(off, pa.array(flat))], ["doc_id", "key", "fp", "check", "node", "size", "sketch", "prefix"])

    return run


def _popular(src: DataFrame, words: int, texts: int = 20_000, most: int = 200_000) -> tuple[bytes, bytes]:
    """Shingles that several of a sample of texts have, and in how many; they only order the shingles of prefixes."""
    part = src.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, src.count() // texts))) == 0)

    def count(batches):
        for batch in batches:
            own = [shingle_set(t, words) for t in utf8(batch.column("text"))]
            x, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["x", "n"])

    top = part.mapInArrow(count, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "x").limit(most).toArrow()
    x, n = top.column("x").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(x)
    return x[order].tobytes(), n[order].tobytes()


def _shingler(words: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t, words).tobytes() for t in utf8(batch.column("text"))], pa.binary())], ["node", "shingles"])

    return run


def _checker(least: float):
    """Links whose shingle sets have a Jaccard similarity of least."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                keep.append(common >= least * (both - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v")], ["u", "v"])

    return run


def _rows(docs: DataFrame, words: int, second: bool, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return materialize(src.mapInArrow(_fingerprinter(words, second), "doc_id long, key long, fp long, check long"), "fingerprints")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def simhash_components(docs: DataFrame, bits: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows = _rows(docs, words, False, id_col, text_col)
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    n = nodes.count()
    comp = materialize(components(links(nodes.select(F.col("fp").alias("node"), "fp", F.col("fp").alias("check")), bits, n)), "components").withColumnRenamed("node", "fp")
    named = join_small(nodes, comp, ["fp"], "left", comp.count(), 32).withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "label").select("fp", "component_id"), "named")
    out = join_small(rows, named, ["fp"], "inner", n, 32)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, least: float = 0.8, most: int = 32, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the least id (null last).

    Texts group if a chain of links connects them; a link is a Jaccard similarity of their shingle sets of at least `least`.
    Most links come cheaply: two fingerprints, of independent hashes, are taken, and texts that differ by at most one bit in one
    of their eight blocks and by at most `most` of all 128 bits are verified along a spanning forest. Then the rest is done
    exactly: texts that share a shingle of their prefixes, and that no link connects yet, are all verified. Only pairs whose
    sizes, places in the prefixes or sketches rule the similarity out are left, and pairs inside a group.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(src.mapInArrow(_prefixer(words, least, *_popular(src, words)), "doc_id long, key long, fp long, check long, node long, size int, sketch binary, prefix array<long>"), "prefixes")
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("key").alias("k"))
    nodes = rows.groupBy("node").agg(F.min(rank).alias("rep"), F.min(F.struct("fp", "check", "size", "sketch")).alias("p"))
    nodes = materialize(nodes.select("node", "p.fp", "p.check", "p.size", "p.sketch", "rep"), "prints")
    n = nodes.count()
    own = docs.withColumn("d__", F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))).withColumn("k__", row_key(id_col, text_col))

    def verified(pairs: DataFrame) -> DataFrame:
        with recording(made := []):
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
            for c in "uv":
                pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
            found = materialize(pairs.mapInArrow(_sifter(least), "u long, v long"), "candidates")
            # the texts that candidates stand for, once each
            of = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct()
            of = materialize(nodes.join(of, "node").select("node", F.col("rep.d").alias("d__"), F.col("rep.k").alias("k__")), "asked")
            texts = join_small(own.select("d__", "k__", F.col(text_col).cast("string").alias("text")), of, ["d__", "k__"], "inner", of.count(), 48)
            sets = materialize(texts.select("node", "text").mapInArrow(_shingler(words), "node long, shingles binary"), "shingles").dropDuplicates(["node"])
            both = found.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        out = materialize(both.select("u", "v", "a", "b").mapInArrow(_checker(least), "u long, v long"), "links")
        for path in made:  # what the links were found by is read no more
            drop_path(spark, path)
        return out

    first = verified(links(nodes, BLOCKS, n, most).unionByName(links(nodes.select("node", F.col("check").alias("fp"), F.col("fp").alias("check")), BLOCKS, n, most)))
    comp = materialize(components(first), "components")
    release(spark)
    with recording(made := []):
        rest = _rest(rows, comp, least)
    rest = verified(rest)
    for path in made:
        drop_path(spark, path)
    release(spark)
    if rest.count():
        comp = materialize(components(first.unionByName(rest)), "components")
    named = join_small(nodes, comp, ["node"], "left", comp.count(), 32).withColumn("label", F.coalesce("label", "node"))
    stays = named.groupBy("label").agg(F.min("rep").alias("rep")).select(F.col("rep.d").alias("d__"), F.col("rep.k").alias("k__"))
    named_rows = rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d__"), F.col("key").alias("k__"))
    keys = materialize(named_rows.groupBy("d__", "k__").agg(F.count(F.lit(1)).alias("copies")).join(stays.withColumn("stays", F.lit(True)), ["d__", "k__"], "left"), "stays")
    gone, many = keys.filter("stays is null").select("d__", "k__"), keys.filter("stays and copies > 1").select("d__", "k__")
    out = join_small(own, gone, ["d__", "k__"], "left_anti", gone.count(), 32)
    if m := many.count():  # repeated rows: one of each stays
        out = join_small(out, many, ["d__", "k__"], "left_anti", m, 32).unionByName(join_small(own, many, ["d__", "k__"], "left_semi", m, 32).dropDuplicates(["d__", "k__"]))
    return out.drop("d__", "k__")


def _rest(rows: DataFrame, comp: DataFrame, least: float) -> DataFrame:
    """u, v: nodes that share a shingle of their prefixes, that comp does not connect, and that may have a similarity of least."""
    named = join_small(rows.select("node", "size", "prefix"), comp, ["node"], "left", comp.count(), 32).withColumn("label", F.coalesce("label", "node"))
    tokens = named.select("node", "size", "label", F.posexplode("prefix").alias("at", "token"))
    group = Window.partitionBy("token")
    open_ = tokens.withColumn("mixed", F.min("label").over(group) < F.max("label").over(group)).filter("mixed").drop("mixed")
    open_ = materialize(open_.dropDuplicates(["token", "node"]), "open")
    x, y = (open_.select("token", *[F.col(c).alias(f"{c}_{z}") for c in ("node", "size", "label", "at")]) for z in "uv")
    # of the first shingle that two sets share, both may share what follows it
    share = F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v"))
    enough = share * (1 + least) >= least * (F.col("size_u") + F.col("size_v")) - 1e-6
    met = x.join(y, "token").filter((F.col("label_u") < F.col("label_v")) & enough)
    return met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
