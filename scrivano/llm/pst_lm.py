"""Language-model scores by a probabilistic suffix tree over words, partitioned over the cluster.

The symbols are words and an end; the states are contexts of the last 1..`depth` symbols, the mark of a text's beginning among
them. A (context, next) pair is kept if it occurs LEAST times in all training documents, so the tree grows with the data. A
context becomes a state if what its next symbols say beyond those of its suffix passes a likelihood-ratio test of divergence.
A state's distribution is discounted and the rest goes to its suffix; scoring thus uses the longest suffix states:

    p(x | context) = (n - DISCOUNT) / (total + BELOW) + rest p(x | suffix),    below all states
    p(x) = (c - FLOOR) / (N + 1),  and (FLOOR V + 1) / (N + 1) for all words that training does not have, as one class

with n, c the counts of pair and token, N all training tokens, V distinct ones. Each is a distribution over the V tokens and the
class of unknown words, as the base is, so the text's probability is one over texts in which unknown words are alike.

Nothing that grows with the data is held in one place. Blocks of documents send their distinct words, pairs and contexts to
owners, as sorted Rice-coded hashes cut to what the number of tokens needs, and get replies in the same order:

0. words: counts over all training documents;
1. pairs of level k, if its symbol and its context, pairs of level k - 1, occur LEAST times: counts over all; each pair is
   entrusted to the first block that has it;
2. contexts of level k: each block adds up the test's terms of the pairs entrusted to it, so the pairs of one context, however
   many, never meet; the owner sums them and answers with the state's discounted mass.

Terms are added as integers, so scores do not depend on blocks or partitions. Words are told apart by 64-bit hashes, pairs by
hashes of KEY_BITS bits more than the logarithm of the number of tokens has: a few in a million share theirs with another.

Nulls, ties, repeats: a null text is empty and has only its end; a null id counts as the text "null"; without training
documents all tokens are of the unknown class, whose probability is then 1, and base scores use counts of zero; an empty table
gives an empty result; repeated rows are scored and learned from each; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, parts_of, release, utf8
from .golomb_dedup import rice_decode, rice_encode

BLOCK_BYTES = 8 << 20
LEAST, DISCOUNT, BELOW, FLOOR = 2, 0.5, 6.0, 0.7
#: Stand-ins for the hashes of a text's end and beginning; units of the test's terms.
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
GAIN_UNIT, SHARE_UNIT = float(1 << 4), float(1 << 26)
KEY_BITS = 18  # of a pair's hash beyond the logarithm of the number of tokens
WORDS, PAIRS, CONTEXTS = 0, 1, 2
_BLOCKS = "block long, ids array<long>, train array<boolean>, lengths binary, codes binary, hashes binary, counts binary"
_ASKED = "block long, kind int, k int, owner long, code binary, cols array<binary>"
_REPLIES = "of long, kind int, k int, owner long, a binary, b binary, tokens long, kinds long"
_I64 = pa.int64()


def _pack(x: np.ndarray) -> bytes:
    """Compressed, byte by byte of the numbers' places."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _numbers(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h ^ (x * END)) * BEGIN
        z ^= z >> np.uint64(29)
        z *= END
        return z ^ (z >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, w):
        self[w] = n = len(self)
        return n


def _blocker(modulus: int, hold: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0

        def block():
            number = _Numbers()
            codes, lengths = [], []
            for t in texts:
                w = t.lower().split()
                lengths.append(len(w))
                codes.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
            flat = np.concatenate(codes)
            often = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")  # small numbers for frequent words
            anew = np.empty(len(often), np.int32)
            anew[often] = np.arange(len(often), dtype=np.int32)
            flat = anew[flat] if len(flat) else flat
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[often]
            counts = np.bincount(flat[np.repeat(np.array(train, bool), lengths)], minlength=len(number))
            cols = {"block": [(part << 24) | seq], "ids": [ids], "train": [train], "lengths": [_pack(np.array(lengths, np.int32))], "codes": [_pack(flat)], "hashes": [_pack(hashes)], "counts": [_pack(counts.astype(np.int32))]}
            kinds = (_I64, pa.list_(_I64), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)})

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(d)
                train.append(zlib.crc32(str("null" if d is None else d).encode()) % modulus != hold)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or len(ids) >= 20_000:
                    yield block()
                    seq += 1
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield block()

    return run


def _asks(block: int, kind: int, k: int, keys: np.ndarray, bits: int, owner_bits: int, *cols: np.ndarray) -> list[dict]:
    """Sorted distinct keys of so many bits and what belongs to them, by owner, which the leading bits name."""
    owner = (keys >> np.uint64(bits - owner_bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    out = []
    for i, j in zip(cut, np.append(cut[1:], len(keys)), strict=True):
        base = np.uint64(int(owner[i]) << (bits - owner_bits))
        out.append({"block": block, "kind": kind, "k": k, "owner": int(owner[i]), "code": rice_encode(keys[i:j] - base), "cols": [_pack(c[i:j]) for c in cols]})
    return out


def _asked(out: list[dict]) -> pa.Table:
    kinds = {"block": _I64, "kind": pa.int32(), "k": pa.int32(), "owner": _I64, "code": pa.binary(), "cols": pa.list_(pa.binary())}
    return pa.table({c: pa.array([x[c] for x in out], t) for c, t in kinds.items()})


def _word_asker(owner_bits: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                hashes, counts = _numbers(row["hashes"], np.uint64), _numbers(row["counts"], np.int32)
                order = np.argsort(hashes)
                yield from _asked(_asks(row["block"], WORDS, 0, hashes[order], 64, owner_bits, counts[order])).to_batches()

    return run


def _owner(t: pa.Table) -> pa.Table:
    """Replies to all blocks that ask one owner for words, pairs or contexts."""
    t = t.sort_by("block")
    kind, k = t.column("kind")[0].as_py(), t.column("k")[0].as_py()
    lists = [rice_decode(c) for c in t.column("code").to_pylist()]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    types = {WORDS: (np.int32,), PAIRS: (np.int32,), CONTEXTS: (np.int32, np.int64, np.int64, np.int64, np.int64)}[kind]
    cols = [np.concatenate([_numbers(x[c], kind_c) for x in t.column("cols").to_pylist()]) for c, kind_c in enumerate(types)]
    every, one, at = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    added = [np.bincount(at, c, len(every)) for c in cols]
    b = [np.zeros(0, np.int64)] * len(lists)
    if kind == CONTEXTS:
        number, n, gain, up = added[:4]
        state = diverges(number, n, gain / GAIN_UNIT, up / SHARE_UNIT, cols[4][one].astype(np.float64))
        a = np.split(np.where(state, number, 0).astype(np.int64)[at], cuts)
        b = np.split(np.where(state, n, 0).astype(np.int64)[at], cuts)
    elif kind == PAIRS:
        first = np.zeros(len(at), np.int64)
        first[one] = 1
        n = added[0].astype(np.int64)[at]
        a = np.split(np.where(n >= LEAST, 2 * n + first, 0), cuts)
    else:
        a = np.split(added[0].astype(np.int64)[at], cuts)
    rows = len(lists)
    out = {"of": t.column("block").to_pylist(), "a": [_pack(x) for x in a], "b": [_pack(x) for x in b], "tokens": [0] * rows, "kinds": [0] * rows}
    if kind == WORDS:  # once for each owner
        out["tokens"][0], out["kinds"][0] = int(added[0].sum()), int((added[0] > 0).sum())
    owner = t.column("owner")[0].as_py()
    return pa.table({"of": pa.array(out["of"], _I64), "kind": pa.array([kind] * rows, pa.int32()), "k": pa.array([k] * rows, pa.int32()), "owner": pa.array([owner] * rows, _I64), "a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary()), "tokens": pa.array(out["tokens"], _I64), "kinds": pa.array(out["kinds"], _I64)})


def diverges(number: np.ndarray, n: np.ndarray, gain: np.ndarray, up: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether contexts are states: number, counts, sums of n log(p / share in the suffix) and of these shares of their kept
    pairs, and the contexts' own counts. Unkept pairs are one outcome."""
    unseen, below = (1 - n / np.maximum(total, 1)).clip(1e-12), (1 - up).clip(1e-12)
    return (2 * gain + 2 * total * unseen * np.log(unseen / below) > 3.84 * number + 10) & (number > 0)


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


class _Block:
    """A block's symbols with what the replies so far say of them. Arrays go over positions; position 0 of a text is the mark of
    its beginning, the last its end."""

    def __init__(self, row: dict, replies: list[dict], ends: int, n_all: int, kinds: int, bits: int):
        self.block, self.bits = row["block"], bits
        self.replies = sorted(replies, key=lambda r: r["owner"])
        lengths, codes = _numbers(row["lengths"], np.int32), _numbers(row["codes"], np.int32)
        self.hashes = np.append(_numbers(row["hashes"], np.uint64), [END, BEGIN])
        v = len(self.hashes) - 2
        self.order = np.argsort(self.hashes[:v])
        self.counts = np.zeros(v + 2, np.int64)
        self.counts[self.order] = self.reply(WORDS, 0, "a")
        self.counts[v:] = ends
        self.n = lengths.astype(np.int64) + 2
        self.starts = np.cumsum(self.n) - self.n
        self.word = np.full(int(self.n.sum()), v, np.int32)
        inner = np.ones(len(self.word), bool)
        inner[self.starts] = inner[self.starts + self.n - 1] = False
        self.word[inner] = codes
        self.word[self.starts] = v + 1
        self.place = np.arange(len(self.word)) - np.repeat(self.starts, self.n)
        self.train = np.repeat(np.array(row["train"], bool), self.n)
        self.count = self.counts[self.word]  # of the pair of the level so far
        self.share = self.count / max(1, n_all)
        self.p = np.where(self.count > 0, self.count - FLOOR, FLOOR * kinds + 1) / (n_all + 1)
        self.key, self.id = self.hashes[self.word], self.word  # of the pair; what a context of the next level is known by

    def reply(self, kind: int, k: int, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[_numbers(r[name], np.int64) for r in self.replies if (r["kind"], r["k"]) == (kind, k)]])

    def level(self, k: int) -> None:
        """Contexts and pairs of level k."""
        self.total, self.own = _before(self.count), _before(self.id)
        self.there = (self.place >= k) & (self.total >= LEAST)
        self.at = np.flatnonzero(self.there & (self.count >= LEAST))
        full = np.zeros(len(self.word), np.uint64)
        full[self.at] = mix(_before(self.key)[self.at], self.hashes[self.word[self.at]])
        key = full[self.at] >> np.uint64(64 - self.bits)
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
        self.pair = np.empty(len(key), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        # contexts of this level, by their numbers: the words, or the pairs of the level below
        if k == 1:
            self.contexts, self.context_keys = np.argsort(self.hashes), self.hashes >> np.uint64(64 - self.bits)
            self.contexts = self.contexts[self.counts[self.contexts] >= LEAST]
        else:
            self.contexts, self.context_keys = np.flatnonzero(self.kept), self.keys
        self.keys, self.key = key[order][new], full

    def ask_pairs(self, k: int, owner_bits: int) -> list[dict]:
        n = np.bincount(self.pair[self.train[self.at]], minlength=len(self.keys)).astype(np.int32)
        return _asks(self.block, PAIRS, k, self.keys, self.bits, owner_bits, n)

    def tell_pairs(self, k: int) -> None:
        reply = self.reply(PAIRS, k, "a")
        self.kept, self.first = reply >= 2 * LEAST, (reply & 1) > 0
        count, number = np.zeros(len(self.word), np.int64), np.full(len(self.word), -1, np.int64)
        count[self.at], number[self.at] = (reply >> 1)[self.pair], self.pair
        self.count, self.id = count, number

    def ask_contexts(self, k: int, owner_bits: int) -> list[dict]:
        one = np.zeros(len(self.keys), np.int64)
        one[self.pair] = self.at
        one = one[self.kept & self.first]
        n, total, up = self.count[one].astype(np.float64), self.total[one], self.share[one]
        gain = np.rint(n * np.log(n / total / np.maximum(up, 1e-12)) * GAIN_UNIT)
        size = len(self.context_keys)
        of = self.own[one]
        own_total = np.zeros(size, np.int64)
        own_total[self.own[self.there]] = self.total[self.there]
        cols = [np.bincount(of, w, size)[self.contexts].astype(t) for w, t in ((None, np.int32), (n, np.int64), (gain, np.int64), (np.rint(up * SHARE_UNIT), np.int64))]
        return _asks(self.block, CONTEXTS, k, self.context_keys[self.contexts], self.bits, owner_bits, *cols, own_total[self.contexts])

    def tell_contexts(self, k: int) -> None:
        number, n = np.zeros(len(self.context_keys)), np.zeros(len(self.context_keys))
        number[self.contexts], n[self.contexts] = self.reply(CONTEXTS, k, "a"), self.reply(CONTEXTS, k, "b")
        at = np.flatnonzero(self.there)
        at = at[number[self.own[at]] > 0]
        own, total, count = self.own[at], self.total[at].astype(np.float64), self.count[at]
        hit = count >= LEAST
        self.p[at] = (1 - (n[own] - DISCOUNT * number[own]) / (total + BELOW)) * self.p[at] + np.where(hit, (count - DISCOUNT) / (total + BELOW), 0.0)
        self.share[at] = np.where(hit, count / total, self.share[at])


def _rows(left: pa.Table, right: pa.Table, *known):
    replies = right.to_pylist()
    for row in left.to_pylist():
        yield row, _Block(row, replies, *known)


def _asker(k: int, depth: int, owner_bits: int, known: tuple):
    """Asks for pairs of level k and for contexts of the level before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, b in _rows(left, right, *known):
            for j in range(1, k):
                b.level(j)
                b.tell_pairs(j)
                if j < k - 1:
                    b.tell_contexts(j)
                else:
                    out += b.ask_contexts(j, owner_bits)
            if k <= depth:
                b.level(k)
                out += b.ask_pairs(k, owner_bits)
        return _asked(out)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(depth: int, n_all: int, kinds: int, known: tuple):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row, b in _rows(left, right, *known):
            counts = b.count
            for j in range(1, depth + 1):
                b.level(j)
                b.tell_pairs(j)
                b.tell_contexts(j)
            logs, base, seen = np.log10(b.p), np.log10((counts + 1) / (n_all + kinds + 1)), (counts > 0).astype(np.int64)
            logs[b.starts], base[b.starts], seen[b.starts] = 0, 0, 0
            out["doc_id"] += row["ids"]
            out["held_out"] += [not t for t in row["train"]]
            out["n_tokens"] += (b.n - 1).tolist()
            for name, x in (("n_known", seen), ("base_score", base), ("score", logs)):
                out[name] += np.add.reduceat(x, b.starts).tolist()
        out["train_tokens"] = [n_all] * len(out["doc_id"])
        kind = {"held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        names = [x.split()[0] for x in _SCORES.split(", ")]
        return pa.table({c: pa.array(out[c], kind.get(c, _I64)) for c in names})

    return run


def pst_scores(docs: DataFrame, modulus: int = 7, hold: int = 2, depth: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; documents whose crc32(id) mod modulus
    is hold are not learned from."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(2, parts_of(docs, 16 << 20))
    owner_bits = (parts - 1).bit_length()
    stored, told = Buckets(spark, "blocks", "block", parts), Buckets(spark, "replies", "of", parts)
    blocks = stored.add(src.mapInArrow(_blocker(modulus, hold), _BLOCKS))
    ends = blocks.select(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0

    def answered(asked: DataFrame) -> DataFrame:
        """Each reply moves once, to where its block is read."""
        return told.add(asked.groupBy("kind", "k", "owner").applyInArrow(_owner, _REPLIES).repartition(parts, "of"))

    replies = answered(blocks.select("block", "hashes", "counts").mapInArrow(_word_asker(owner_bits), _ASKED))
    words, kinds = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n_all, kinds = words + ends, kinds + (ends > 0)
    known = (ends, n_all, kinds, min(64, max(owner_bits + 8, n_all.bit_length() + KEY_BITS)))
    texts = blocks.drop("counts")
    for k in range(1, depth + 2):
        release(spark)
        replies = answered(texts.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(_asker(k, depth, owner_bits, known), _ASKED))
    release(spark)
    out = texts.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(_scorer(depth, n_all, kinds, known), _SCORES)
    stored.forget()
    told.forget()
    return out
