"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    logit = b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The pairwise part is the sum-of-squares identity, so a document is scored in time linear in its features. Features: each
distinct lower-cased word hashed to one of 2^`word_bits` slots with weight 1 / sqrt(distinct words); shares of byte classes,
repeats of words and lines, word lengths (one slot for each bin of each statistic); the length of the text as metadata.
Labels, language, source and id are no inputs.

It is fitted by Adagrad on at most `sample` labelled documents (learn_rows below, 8000 by default), whose features only are
sent to the driver; the model has (2^word_bits + bins) * (factors + 1) numbers, about 300 kB, and goes out with the code.

Nulls, ties, repeats: null and empty texts are scored as empty texts; null labels are left out; with labels of one class or
none the score is the constant share of that class (0.5 for none); repeated rows are scored each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .labelled import labelled_sample

WORD_BITS, BINS = 12, 14


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_MARK, _STOP, _BAR, _SPACE = _class("!%$&*#@^~+=<>{}[]\\/"), _class(".,;:?'\"()-"), _class("|"), _class(" \t\n\r\x0b\x0c")
_HIGH = np.arange(256) >= 128
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _MARK, _STOP, _BAR, _SPACE, _HIGH, _class("!"), _class("\n")], axis=1).astype(np.float64)
STATS = _CLASSES.shape[1] + 8


def statistics(text: bytes, words: list[bytes]) -> list[int]:
    """A bin for each statistic."""
    n, m = max(1, len(text)), max(1, len(words))
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / n).tolist()
    lines = text.split(b"\n")
    shares += [len(set(words)) / m, sum(map(operator.eq, words, words[1:])) / m, len(set(lines)) / len(lines), sum(map(len, words)) / m / 64, sum(map(bytes.isupper, words)) / m, sum(map(bytes.isalpha, words)) / m]
    bins = [min(BINS - 1, (int(s * 4095) + 1).bit_length()) for s in shares]
    return [*bins, min(BINS - 1, len(text).bit_length() // 2), min(BINS - 1, len(words).bit_length())]


def features(text: bytes, word_bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray]:
    words = text.lower().split()
    bins = statistics(text, text.split())
    kinds = set(words)
    mask = (1 << word_bits) - 1
    crc = zlib.crc32
    hashed = np.unique(np.fromiter((crc(w) & mask for w in kinds), np.int32, len(kinds))) if kinds else np.zeros(0, np.int32)
    idx = np.concatenate([hashed, (1 << word_bits) + np.arange(STATS, dtype=np.int32) * BINS + np.array(bins, np.int32)])
    x = np.ones(len(idx), np.float32)
    x[: len(hashed)] = 1 / np.sqrt(max(1, len(hashed)))
    return idx.astype(np.int32), x


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    word_bits: int

    def logits(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.v[idx] * x[:, None]
        s = np.add.reduceat(vx, starts)
        return self.bias + np.add.reduceat(self.w[idx] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, word_bits: int, factors: int = 6, epochs: int = 12, rate: float = 0.1, l2: float = 2e-4, batch: int = 128, seed: int = 1) -> Machine:
    size = (1 << word_bits) + STATS * BINS
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, factors)).astype(np.float32), word_bits)
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, factors), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            own = [rows[i] for i in order[k : k + batch]]
            n = np.array([len(r[0]) for r in own])
            idx, x = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            starts = np.cumsum(n) - n
            vx = m.v[idx] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = m.bias + np.add.reduceat(m.w[idx] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[k : k + batch]]) / len(own)
            gx = np.repeat(g, n) * x
            dw = np.bincount(idx, gx, size)
            hit = np.flatnonzero(np.bincount(idx, minlength=size))
            dw = dw[hit] + l2 * m.w[hit]
            inner = gx[:, None] * (np.repeat(s, n, axis=0) - vx)
            dv = np.stack([np.bincount(idx, inner[:, f], size)[hit] for f in range(factors)], axis=1) + l2 * m.v[hit]
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            m.w[hit] -= rate * dw / np.sqrt(gw[hit])
            m.v[hit] -= 0.3 * rate * dv / np.sqrt(gv[hit])
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def _extract(word_bits: int):
    def run(batches):
        for batch in batches:
            rows = [features(t, word_bits) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["label", "idx", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn, learn_rows: int = 8000, word_bits: int = WORD_BITS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    some = labelled_sample(docs, labels, label_col, learn, learn_rows, id_col, text_col)
    t = some.mapInArrow(_extract(word_bits), "label int, idx binary, x binary").orderBy("label", F.xxhash64("idx")).toArrow()
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(t["idx"].to_pylist(), t["x"].to_pylist(), strict=True)]
    return fit(rows, t["label"].to_numpy().astype(np.float32), word_bits)


def _scorer(m: Machine, at: int, name: str):
    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            texts = utf8(batch.column(at))
            for k in range(0, len(texts), 64):
                own = [features(t, m.word_bits) for t in texts[k : k + 64]]
                n = np.array([len(r[0]) for r in own])
                z = m.logits(np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), np.cumsum(n) - n)
                scores[k : k + 64] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, 0 to 1, higher for label 1 likelier; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = docs.schema
    at = docs.columns.index(text_col)
    return docs.mapInArrow(_scorer(model, at, name), type(schema)([*schema.fields]).add(name, "double"))
