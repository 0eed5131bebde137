"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased, punctuation deleted. A seed is an n-gram of a test item that is rare: the product of its words' shares
in the training texts, counted over all of them, is at most `rare`. An item without one uses all its n-grams, an item shorter
than n its whole as one seed. A document's seed hits are grouped by item and nearness; around each group the item is aligned
to the passage (match 2, other word -1, gap -1), which finds it through changed, added and missing words. A passage is
reported if its score is at least `least` of the score of a full copy; what lies before and after it is then aligned anew, so
each copy in a document is reported.

Items are taken in blocks of at most `block_items`; the seeds of a block, bounded by that and by the items' lengths, go out
with the code, and documents are scanned in place, without a shuffle or a limit on hits.

Nulls, ties, repeats: null or empty texts and items match nothing; null ids are carried through; of equally good
passages that overlap the first is reported; repeated documents and items are reported each; empty tables give an empty
result; further columns are ignored by find(), kept by decontaminate().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

MATCH, OTHER, GAP = 2, -1, -1
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = bytes(range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    return text.translate(_LOWER, _PUNCT).split()


@dataclass
class Seeds:
    n: int
    vocab: dict[bytes, int]
    keys: np.ndarray  # sorted
    items: list[list[int]]  # for each key
    texts: list[np.ndarray]
    ids: list
    short: dict[int, list[int]] = field(default_factory=dict)  # items of fewer than n words by their first word
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))  # words that such an item begins with


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n codes."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def make_seeds(items: list[tuple], shares: dict[bytes, float], n: int, rare: float) -> Seeds:
    vocab: dict[bytes, int] = {}
    texts, ids, found, short = [], [], {}, {}
    for item_id, text in items:
        w = words_of((text or "").encode())
        if not w:
            continue
        k = len(texts)
        codes = np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.int64)
        texts.append(codes)
        ids.append(item_id)
        if len(w) < n:
            short.setdefault(int(codes[0]), []).append(k)
            continue
        logs = np.log10([max(shares.get(x, 0.0), 1e-15) for x in w])
        p = sum(logs[j : len(w) - n + 1 + j] for j in range(n))
        ok = p <= np.log10(rare)
        for key in np.unique(_keys(codes, n)[ok if ok.any() else slice(None)]).tolist():
            found.setdefault(key, []).append(k)
    keys = np.array(sorted(found), np.uint64)
    starts = np.zeros(len(vocab) + 1, bool)
    starts[list(short)] = True
    return Seeds(n, vocab, keys, [found[int(x)] for x in keys], texts, ids, short, starts)


def _rows(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score with the last places of item and passage."""
    steps = np.arange(len(passage)) * -GAP
    above = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        t = np.maximum(above[:-1] + np.where(passage == w, MATCH, OTHER), above[1:] + GAP)
        t = np.maximum(t, 0)
        t = np.maximum(t, np.maximum.accumulate(t + steps) - steps)  # gaps along the passage
        j = int(t.argmax())
        if t[j] > best[0]:
            best = (int(t[j]), i, j)
        above[1:] = t
    return best


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score, first and last place in the passage of the best local alignment."""
    score, i, j = _rows(item, passage)
    if not score:
        return 0, 0, -1
    _, _, back = _rows(item[: i + 1][::-1], passage[: j + 1][::-1])
    return score, j - back, j


def matches(text: bytes, s: Seeds, least: float) -> list[tuple]:
    """(item, share of a full copy's score, first word, last word, seed hits) of each item that the text has."""
    codes = np.array([s.vocab.get(w, 0) for w in words_of(text)], np.int64)
    hits: dict[int, list[int]] = {}
    if len(codes) >= s.n and len(s.keys):
        known = codes > 0
        ok = known[: len(codes) - s.n + 1].copy()
        for k in range(1, s.n):
            ok &= known[k : len(codes) - s.n + 1 + k]
        at = np.flatnonzero(ok)
        if len(at):
            key = _keys(codes, s.n)[at]
            j = np.minimum(np.searchsorted(s.keys, key), len(s.keys) - 1)
            for place, k in zip(at[s.keys[j] == key].tolist(), j[s.keys[j] == key].tolist(), strict=True):
                for item in s.items[k]:
                    hits.setdefault(item, []).append(place)
    for place in np.flatnonzero(s.starts[codes]).tolist() if s.short else []:
        for item in s.short[int(codes[place])]:
            if np.array_equal(codes[place : place + len(s.texts[item])], s.texts[item]):
                hits.setdefault(item, []).append(place)
    out = []
    for item, places in hits.items():
        m, k = len(s.texts[item]), 0
        while k < len(places):
            last = k
            while last + 1 < len(places) and places[last + 1] - places[last] <= 2 * m:
                last += 1
            todo = [(max(0, places[k] - 2 * m), min(len(codes), places[last] + s.n + 2 * m))]
            while todo:
                a, b = todo.pop()
                near = [x for x in places[k : last + 1] if a <= x < b]
                if not near:
                    continue
                score, i, j = align(s.texts[item], codes[a:b])
                if score >= least * MATCH * m and score > 0:
                    out.append((item, score / (MATCH * m), a + i, a + j, sum(a + i <= x <= a + j for x in near)))
                    todo += [(a + j + 1, b), (a, a + i)]
            k = last + 1
    return out


def _count(vocab: frozenset):
    def run(batches):
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for t in utf8(batch.column(0)):
                w = words_of(t)
                total += len(w)
                seen.update(filter(vocab.__contains__, w))
        seen[b""] = total
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    return run


def word_shares(docs: DataFrame, words: frozenset, text_col: str = "text") -> dict[bytes, float]:
    """Shares in all texts of the given words, as many rows as there are words."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    total = max(1, n.pop(b"", 0))
    return {w: c / total for w, c in n.items()}


def seed_blocks(docs: DataFrame, items: DataFrame, n: int = 3, rare: float = 1e-8, block_items: int = 20_000, item_col: str = "item_id", item_text: str = "text", text_col: str = "text"):
    """Seeds of each block of items."""
    own = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    for k in range(max(1, -(-own.count() // block_items))):
        block = [(r["item"], r["text"]) for r in own.orderBy("item", "text").offset(k * block_items).limit(block_items).collect()]
        vocab = frozenset(w for _, t in block for w in words_of(t.encode()))
        yield make_seeds(block, word_shares(docs, vocab, text_col), n, rare)


def _finder(s: Seeds, least: float):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                out += [(d, s.ids[k], *rest) for k, *rest in matches(t, s, least)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word", "seeds"])

    return run


def find(docs: DataFrame, items: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, seeds of every passage of an item in a document."""
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for s in seed_blocks(docs, items, text_col=text_col, **options):
        own = src.mapInArrow(_finder(s, least), "doc_id long, item_id long, score double, first_word long, last_word long, seeds long")
        out = own if out is None else out.unionByName(own)
    return out


def _cleaner(s: Seeds, least: float, at: int):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not matches(t, s, least) for t in utf8(batch.column(at))], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.4, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, in place."""
    out = docs
    for s in seed_blocks(docs, items, text_col=text_col, **options):
        out = out.mapInArrow(_cleaner(s, least, docs.columns.index(text_col)), docs.schema)
    return out
