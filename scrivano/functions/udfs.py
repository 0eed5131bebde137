"""Row-wise text functions that Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@F.pandas_udf(_S)
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


class Near(SequenceMatcher):
    """SequenceMatcher of two texts with the same blocks. Where texts are near, the longest match is at an end of the range, which
    substring searches tell without counting places of letters; other ranges are left to difflib. Letters that difflib takes
    for junk in texts of 200 and more would change matches, so only equality is told for those."""

    def __init__(self, a: str, b: str, autojunk: bool = True):
        self.isjunk, self.autojunk, self.a, self.b, self.b2j = None, autojunk, a, b, None
        self.matching_blocks = self.opcodes = self.fullbcount = None
        self.plain = not autojunk or len(b) < 200

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if self.plain or self.a == self.b:
            found = _longest(self.a[alo:ahi], self.b[blo:bhi])
            if found:
                return Match(alo + found[0], blo + found[1], found[2])
        if self.b2j is None:
            b, self.b = self.b, None
            self.set_seq2(b)
            self.matching_blocks = None
        return super().find_longest_match(alo, ahi, blo, bhi)


def _longest(x: str, y: str) -> tuple[int, int, int] | None:
    """The longest common substring, the first in x, then in y, if it is easy to tell."""
    n, m = len(x), len(y)
    if n <= m and (at := y.find(x)) >= 0:
        return 0, at, n
    if m < n and (at := x.find(y)) >= 0:
        return at, 0, m
    if n == 1 or m == 1:
        return 0, 0, 0
    if n > 5000:
        return None
    u, v, p = _parts(x, y)
    q = n - p - len(u)
    if max(p, q) * 4 < n:
        return None
    if p >= q:
        return None if any(x[i : i + p + 1] in y for i in range(n - p)) else (0, 0, p)
    return None if y.find(x[n - q :]) < m - q or any(x[i : i + q] in y for i in range(n - q)) else (n - q, m - q, q)


def _bare(s: str) -> str:
    return "".join((s if s.isascii() else unicodedata.normalize("NFC", s)).split())


def ratio(a: str, b: str) -> float:
    """Similarity of two texts without white space."""
    return Near(_bare(a), _bare(b)).ratio()


@F.pandas_udf(_D)
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(_struct(inserts=_I, deletes=_I, replaces=_I, equals=_I, cer=_D, ratio=_D))
def char_edits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Characters inserted, deleted, replaced and kept from a to b."""
    out = []
    for x, y in zip(a, b, strict=True):
        m = Near(x or "", y or "")
        n = dict.fromkeys(("insert", "delete", "replace", "equal"), 0)
        for op, i, j, k, w in m.get_opcodes():
            n[op] += max(j - i, w - k)
        out.append((n["insert"], n["delete"], n["replace"], n["equal"], (n["insert"] + n["delete"] + n["replace"]) / max(1, len(y or "")), m.ratio()))
    return pd.DataFrame(out, columns=["inserts", "deletes", "replaces", "equals", "cer", "ratio"])


def apart(a: str, b: str) -> tuple[str, str]:
    """a and b without what they begin and end with alike; no edit distance depends on that."""
    return _parts(a, b)[:2]


def _parts(a: str, b: str) -> tuple[str, str, int]:
    """a and b where they differ, and the number of letters they begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    n, high = 0, min(len(a), len(b)) - low
    i, j = len(a), len(b)
    while n < high:
        mid = (n + high + 1) // 2
        if a[i - mid : i - n] == b[j - mid : j - n]:
            n = mid
        else:
            high = mid - 1
    return a[low : i - n], b[low : j - n], low


def edits(a: str, b: str) -> int:
    """Levenshtein distance of long texts: a column of its table at a time, as the bits of two whole numbers (Myers, Hyyrö)."""
    if not a or not b:
        return len(a) + len(b)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        x = (((same & up) + up) ^ up) | same | down
        gain, loss = down | (full & ~(x | up)), x & up
        if gain & last:
            d += 1
        elif loss & last:
            d -= 1
        gain, loss = (gain << 1) | 1, loss << 1
        up, down = (loss | (full & ~(x | gain))) & full, gain & x & full
    return d


#: Spark's levenshtein takes time by the product of the lengths, with a threshold too; beyond this product bits take over.
CELLS = 1_000_000


@F.arrow_udf(_struct(s=_S, t=_S, far=_I))
def parted(a: pa.Array, b: pa.Array) -> pa.Array:
    """Where two texts differ; far: their edit distance, if one side is empty there or both are long."""
    own, other, far = [], [], []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            own.append(None), other.append(None), far.append(None)
            continue
        x, y = apart(x, y)
        own.append(x), other.append(y)
        far.append(len(x) + len(y) if not x or not y else edits(x, y) if len(x) * len(y) > CELLS else None)
    return pa.StructArray.from_arrays([pa.array(own, pa.string()), pa.array(other, pa.string()), pa.array(far, pa.int32())], ["s", "t", "far"])


def letter_bits(text: str) -> int:
    """64 bits of a text's letters: the first, second, ... time of each letter flips a bit, so a letter put in or left out changes
    one bit at most and a letter exchanged two."""
    bits = 0
    for c, n in Counter(text).items():
        for k in range(n):
            bits ^= 1 << ((ord(c) * 0x9E3779B1 + k * 0x85EBCA6B >> 7) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


@F.arrow_udf(T.LongType())
def letter_sketch(x: pa.Array) -> pa.Array:
    return pa.array([None if s is None else letter_bits(s) for s in x.to_pylist()], pa.int64())


def aligned(a: str, b: str) -> list[tuple[str, str]]:
    """Characters of a and b side by side with as few changes as possible; "" is a gap. What they begin and end with alike is
    set aside first, so near texts cost little."""
    most, n, m = min(len(a), len(b)), 0, 0
    while n < most and a[n] == b[n]:
        n += 1
    while m < most - n and a[-1 - m] == b[-1 - m]:
        m += 1
    return [(x, x) for x in a[:n]] + _aligned(a[n : len(a) - m], b[n : len(b) - m]) + [(x, x) for x in a[len(a) - m :]]


def _aligned(a: str, b: str) -> list[tuple[str, str]]:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        up, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        here = rows[i][j]
        if i and j and rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == here:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i - 1][j] + 1 == here:
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1]


@F.pandas_udf(T.ArrayType(_struct(a=_S, b=_S)))
def align_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"a": p, "b": q} for p, q in aligned(x, y)] for x, y in zip(a, b, strict=True)])


@F.arrow_udf(T.ArrayType(_struct(a=_S, b=_S)))
def changed_chars(a: pa.Array, b: pa.Array) -> pa.Array:
    """Those of align_chars that differ."""
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
    return pa.array([None if x is None or y is None else [{"a": p, "b": q} for p, q in _aligned(*apart(x, y)) if p != q] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)


@F.arrow_udf(_struct(precision=_D, recall=_D, f1=_D))
def token_scores(predicted: pa.Array, target: pa.Array) -> pa.Array:
    """Precision, recall and f1 of token arrays, place by place: classes weighted by gold support, the shorter array padded with
    empty tokens. Classes are counted once each, so a long text takes time by its length."""
    out = []
    for p, t in zip(predicted.to_pylist(), target.to_pylist(), strict=True):
        p, t = p or [], t or []
        n = max(len(p), len(t))
        p, t = p + [""] * (n - len(p)), t + [""] * (n - len(t))
        support, given, hits = Counter(t), Counter(p), Counter(y for x, y in zip(p, t, strict=True) if x == y)
        precision = recall = f1 = 0.0
        for c, sup in support.items():
            pred, tp = given[c], hits[c]
            precision += sup / n * tp / pred if pred else 0.0
            recall += tp / n
            f1 += sup / n * 2 * tp / (sup + pred)
        out.append({"precision": precision, "recall": recall, "f1": f1} if n else {"precision": None, "recall": None, "f1": None})
    return pa.array(out, pa.struct([("precision", pa.float64()), ("recall", pa.float64()), ("f1", pa.float64())]))


@F.pandas_udf(_S)
def inline_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Deletions as [-x-], insertions as [+y+], at most 200 characters."""

    def one(x, y):
        out = ""
        for op, i, j, k, w in Near(x or "", y or "").get_opcodes():
            out += x[i:j] if op == "equal" else "".join([*(f"[-{c}-]" for c in (x or "")[i:j]), *(f"[+{c}+]" for c in (y or "")[k:w])])
            if len(out) > 200:
                return out[:200] + "…"
        return out

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


LONG = 1000


def _blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Matching blocks of a and b: whole words first, characters between them; in pages of over LONG words those that make up
    more than a hundredth match only beside rarer ones, so that long pages stay cheap."""
    x, y = (re.findall(r"\s*[^\s་༌]+[་༌]?|\s+|[་༌]", s) for s in (a, b))
    at, bt = [0], [0]
    for own, ends in ((x, at), (y, bt)):
        for w in own:
            ends.append(ends[-1] + len(w))
    out = []
    for op, i, j, k, w in SequenceMatcher(None, x, y, autojunk=len(y) > LONG).get_opcodes():
        if op == "equal":
            out.append((at[i], bt[k], at[j] - at[i]))
        elif op == "replace" and (at[j] - at[i]) * (bt[w] - bt[k]) <= 250_000:
            inner = Near(a[at[i] : at[j]], b[bt[k] : bt[w]], autojunk=False).get_matching_blocks()
            out += [(at[i] + m.a, bt[k] + m.b, m.size) for m in inner if m.size]
    return [*out, (len(a), len(b), 0)]


def transferred(gold: list[str], text: str) -> list[str]:
    """text cut where gold is cut: each cut is carried over by the matching blocks around it. The pieces joined are the text."""
    whole = "".join(gold)
    if whole == text:
        return gold
    blocks = _blocks(whole, text)
    cuts, at, k, last = [], 0, 0, 0
    for piece in gold[:-1]:
        at += len(piece)
        while k + 1 < len(blocks) and blocks[k][0] + blocks[k][2] < at:
            k += 1
        a, b, size = blocks[k]
        place = b + min(max(at - a, 0), size)
        if at <= a and k:  # between two blocks: the nearer
            before = blocks[k - 1]
            place = before[1] + before[2] if at - before[0] - before[2] <= a - at else b
        last = max(last, min(place, len(text)))
        cuts.append(last)
    return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]


@F.pandas_udf(T.ArrayType(_S))
def boundary_transfer(gold: pd.Series, text: pd.Series) -> pd.Series:
    """gold: sentences of a page; text: another reading of the page, cut at the same places."""
    return pd.Series([[] if g is None or t is None or not len(g) else transferred(list(g), t) for g, t in zip(gold, text, strict=True)])


def greedy(sources: list[str], targets: list[str], least: float = 0.55, ahead: int = 3, most: float = 2.5) -> list[dict]:
    """Pairs in order: each source takes the likest of the next targets of a like length."""
    out, j = [], 0
    bare = [(t, Counter(t)) for t in map(_bare, targets)]
    for i, s in enumerate(sources):
        best, own, letters = (-1.0, None), _bare(s), None
        for k in range(j, min(j + ahead, len(targets))):
            t = targets[k]
            if max(len(s), len(t)) <= most * max(1, min(len(s), len(t))):
                other, n = bare[k]
                if own != other:
                    letters = letters or Counter(own)
                    common = sum(min(c, n[x]) for x, c in letters.items() if x in n)
                    if 2.0 * common / (len(own) + len(other)) < max(best[0], least):  # no more than this, so not the best
                        continue
                score = Near(own, other).ratio()
                if score > best[0]:
                    best = (score, k)
                if score == 1.0:
                    break
        if best[1] is not None and best[0] >= least:
            out.append({"source": s, "target": targets[best[1]], "similarity": round(best[0], 4), "source_idx": i, "target_idx": best[1]})
            j = best[1] + 1
    return out


@F.pandas_udf(T.ArrayType(_struct(source=_S, target=_S, similarity=_D, source_idx=_I, target_idx=_I)))
def greedy_align(sources: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([greedy(list(s), list(t)) for s, t in zip(sources, targets, strict=True)])
