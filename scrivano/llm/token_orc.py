"""Token ids in ORC: run-length coded integers, row indexes, Bloom filters on document ids.

Documents are ordered by range partition and sorted inside it, encoded, and written as ORC with a row index every
`stride` rows and a Bloom filter on doc_id. Partitions have about `part_bytes` of input, whatever its size. Every file holds
one or more parts, a part being what one task wrote; each row has its part and its offset in the part. The start of a document
in the whole sequence is its offset plus the ids of the parts before, which needs one sum for each part. Readers take stripes
in parallel and skip row groups by doc_id.

Ids come from the tokenizers library, called without options. Texts of Latin letters, digits and common marks are cut as its
pre-tokenizer cuts them, in arrays over the bytes of many texts; of these texts' distinct pieces, its model encodes those that
are not remembered, many in a call. The ids are remembered in two generations of bounded size. Texts with other characters or
with the content of an added token are encoded whole. Both give the ids of the whole text (tested).

Nulls, ties, repeats: a null text is empty and gets the end id only; null ids come first; rows alike in doc_id are ordered
by a hash of the text; an empty table gives an empty file set and result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, parts_of, worker_cache

MEMO = 300_000  # pieces of a generation
CALL, GAP = 64, b"\0"  # new pieces of a call of the model, and what stands between them
TOGETHER = 1 << 20  # bytes of the texts that are cut and looked up at once, one text at least
_LETTER, _MARK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u20ac"
_SPACE, _BREAK, _ODD = 3, 4, 5  # classes of characters: 0 to 2 are letters, digits and marks


def _classes() -> np.ndarray:
    """The class of each character below 65,536."""
    out = np.full(1 << 16, _ODD, np.uint8)
    for k, x in enumerate([_LETTER, "0-9", _MARK, " ", r"\n"]):
        out[[ord(c) for c in re.findall(f"[{x}]", "".join(map(chr, range(0x2100))))]] = k
    return out


def _class_of_bytes(u: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character of each byte of valid UTF-8."""
    c = classes[:256][u]
    high = np.flatnonzero(u >= 0xC0)
    lead = u[high]
    c[u >= 0x80] = _ODD  # what has four bytes stays so
    for least, most, more in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2)):
        at = high[(lead >= least) & (lead <= most)]
        code = (u[at] & (0x1F if more == 1 else 0x0F)).astype(np.int64)
        for k in range(1, more + 1):
            code = code << 6 | u[at + k] & 0x3F
        for k in range(more + 1):
            c[at + k] = classes[code]
    return c


def _cut(u: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the pre-tokenizer cuts from texts without odd characters. u: their bytes, one after the other;
    c: the bytes' classes; first: where texts that are not empty begin.

    Its rule: '(?:[sdmt]|ll|ve|re) | ?letters | ?digits | ?marks | white space but for the last before other things | white space."""
    n = len(u)
    white = c >= _SPACE
    begins = np.zeros(n + 3, bool)
    begins[1:n] = (c[1:] != c[:-1]) & (c[:-1] != _SPACE) & ~white[1:]
    last = np.append(~white[1:], False)  # a white byte before something else
    last[first[1:] - 1] = False
    begins[1:n] |= white[1:] & (~white[:-1] | last[1:])
    begins[first] = True
    head = np.ones(n + 3, bool)
    head[:n] = False
    head[first] = True
    v = np.append(u, np.zeros(3, np.uint8))
    q = np.flatnonzero((u == ord("'")) & begins[:n])
    x, y = v[q + 1], v[q + 2]
    one = np.isin(x, np.frombuffer(b"sdmt", np.uint8)) & ~head[q + 1]
    two = ((x == ord("l")) & (y == ord("l")) | np.isin(x, np.frombuffer(b"vr", np.uint8)) & (y == ord("e"))) & ~head[q + 1] & ~head[q + 2]
    begins[q[one | two] + 1] = False
    begins[q[one] + 2] = True
    begins[q[two] + 3] = True
    return np.flatnonzero(begins[:n])


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces:
    """Ids of pieces, as bytes. What was not asked for while MEMO other pieces came is forgotten.

    New pieces go to the model CALL at a time, with GAP between them: no merge has GAP's letter and no piece has GAP, so that
    merges stay inside pieces. Models that could do otherwise get piece by piece."""

    def __init__(self, tokenizer):
        from tokenizers import models

        self.model = m = tokenizer.model
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        letters = _byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        gap = letters[GAP[0]]
        self.gap = tokenizer.token_to_id(gap)
        plain = isinstance(m, models.BPE) and not (m.dropout or m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix)
        self.call = CALL if plain and self.gap is not None and not any(gap in x and x != gap for x in tokenizer.get_vocab()) else 1

    def _ids(self, some: list[bytes]) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(charmap_decode(GAP.join(some), "strict", self.letters)[0])], "<u4")

    def _learn(self, new: list[bytes]) -> list[bytes]:
        if self.call == 1:
            return [self._ids([x]).tobytes() for x in new]
        out = []
        for k in range(0, len(new), self.call):
            ids = self._ids(new[k : k + self.call])
            ends, raw = (4 * np.flatnonzero(ids == self.gap)).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
        return out

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of the pieces, which are distinct."""
        out = list(map(self.now.get, pieces))
        lacking = [k for k, ids in enumerate(out) if ids is None]
        new = []
        for k in lacking:
            out[k] = self.before.get(pieces[k])
            if out[k] is None:
                new.append(k)
        for k, ids in zip(new, self._learn([pieces[k] for k in new]), strict=True):
            out[k] = ids
        for k in lacking:
            if len(self.now) >= MEMO:
                self.before, self.now = self.now, {}
            self.now[pieces[k]] = out[k]
        return out


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of TOGETHER bytes, the last row's rest on top; the last range may have fewer."""
    at = size = 0
    for k, n in enumerate(sizes, 1):
        size += n
        if size >= TOGETHER or k == len(sizes):
            yield at, k
            at, size = k, 0


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)
        self.classes = _classes()
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _cut_and_look_up(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that are not empty."""
        data = b"".join(texts)
        u = np.frombuffer(data, np.uint8)
        c = _class_of_bytes(u, self.classes)
        bounds = np.cumsum([0, *map(len, texts)])
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(bounds, np.flatnonzero(c == _ODD), "right") - 1] = True
        if any(x in data for x in self.added):
            odd |= [any(x in t for x in self.added) for t in texts]
        if odd.any():
            rest = iter(self.encode([t for t, o in zip(texts, odd, strict=True) if not o]))
            return [self._whole(t) if o else next(rest) for t, o in zip(texts, odd, strict=True)]
        at = _cut(u, c, bounds[:-1])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(u))), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.pieces.of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        off = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(at, bounds)].tolist()
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = [b""] * len(texts)
        for i, j in _groups(list(map(len, texts))):
            if some := [k for k in range(i, j) if texts[k]]:
                for k, ids in zip(some, self._cut_and_look_up([texts[k] for k in some]), strict=True):
                    out[k] = ids
        return out


def encode_texts(texts: list[str | None], tokenizer: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without an end id."""
    ready = worker_cache("tokenizers")
    if tokenizer not in ready:
        ready[tokenizer] = Encoder(tokenizer)
    return ready[tokenizer].encode([(t or "").encode() for t in texts])


def _encoder(tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in _groups(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
                some = batch.slice(i, j - i)
                codes = [c + end for c in encode_texts(some.column("text").to_pylist(), tokenizer)]
                n = np.array([len(c) // 4 for c in codes], np.int64)
                off = at + np.cumsum(n) - n
                at += int(n.sum())
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "part": pa.array([part] * len(n), pa.int64()), "part_start": pa.array(off, pa.int64()), "n_tokens": pa.array(n), "ids": ids})

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, stride: int = 1000, stripe_bytes: int = 16 << 20, part_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs' ids to path in ascending order of id_col."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))  # so that a repeated id does not fill one range
    ordered = src.repartitionByRange(parts_of(docs, part_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    coded = ordered.mapInArrow(_encoder(tokenizer, end_id), "doc_id long, part long, part_start long, n_tokens long, ids array<int>")
    coded.write.option("orc.compress", "LZ4").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_bytes)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files at path; start counts the ids of all documents before."""
    rows = spark.read.schema("doc_id long, part long, part_start long, n_tokens long, ids array<int>").orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("m"))
    # one row a part; a part is a task's output, so there are as many as write tasks
    before = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, off = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array([zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.int64())})


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """read_tokens of some documents; their ids are pushed down to the files' Bloom filters and row indexes."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def tokens_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
