"""Exact deduplication by an exchange of Golomb-Rice coded fingerprints.

1. One scan digests each text, white space deleted: SHA-256, a 64-bit XXH3 fingerprint and the length of the original in
   code points. Rows are packed in blocks of a bounded number of documents.
2. Each block cuts its distinct fingerprints to log2(rows) + `spare_bits` bits and sends them, sorted and Rice coded, to
   the owners of their ranges. A value that repeats inside its block is marked by the sender.
3. Owners answer each block with a bitmap of the values that other blocks have too.
4. Only rows whose bit is set are suspects; their texts alone are shuffled and compared byte for byte. Grouping is by the
   text itself and combines before the shuffle, so a group with a third of all rows sends one row from each task.

Nulls, ties, repeats: a null text equals an empty one; a null doc_id comes last among ties and, alone in its group, gives a
null keep_id; of rows alike in doc_id and text one stays; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_small, materialize, utf8, width

BLOCK = 32768  # documents of a block; about 2 MB of digests
_BLOCKS = "block long, n long, ids array<long>, chars array<int>, prints array<long>, shas array<binary>"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values: 1 byte of parameter, 8 of count, the unary quotients, the fixed-width remainders."""
    n = len(values)
    if not n:
        return b"\0" * 9
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    b = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    q = (gaps >> np.uint64(b)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    shifts = np.arange(b - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel() if b else np.zeros(0, np.uint8)
    head = np.packbits(unary).tobytes()
    return bytes([b]) + n.to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + np.packbits(rest).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    b, n, m = code[0], int.from_bytes(code[1:5], "little"), int.from_bytes(code[5:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, m, 9))
    q = (np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1).astype(np.uint64)
    gaps = q << np.uint64(b)
    if b:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, 9 + m))[: n * b].reshape(n, b)
        for j in range(b):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(b - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    ids, chars, prints, shas = [], [], [], []

    def block():
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([(part << 24) | seq], pa.int64()), "n": pa.array([len(prints)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "chars": pa.array([chars], pa.list_(pa.int32())), "prints": pa.array([prints], pa.list_(pa.int64())), "shas": pa.array([shas], pa.list_(pa.binary()))}
        )

    for batch in batches:
        norm = [t.translate(None, SPACE) for t in utf8(batch.column(1))]
        ids += batch.column(0).to_pylist()
        chars += pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        prints += np.array([xxhash.xxh3_64_intdigest(t) for t in norm], np.uint64).view(np.int64).tolist()
        shas += [hashlib.sha256(t).digest() for t in norm]
        if len(prints) >= BLOCK:
            yield block()
            seq += 1
            ids, chars, prints, shas = [], [], [], []
    if prints:
        yield block()


def _cut(prints: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct leading bits of the fingerprints, sorted, and how often each occurs."""
    return np.unique(np.array(prints, np.int64).view(np.uint64) >> np.uint64(64 - bits), return_counts=True)


def _sender(bits: int, owner_bits: int):
    def send(batches):
        for batch in batches:
            for block, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, _ = _cut(prints, bits)
                owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
                at = np.flatnonzero(np.diff(owner, prepend=-1))
                own = owner[at]
                base = own.astype(np.uint64) << np.uint64(bits - owner_bits)
                ends = np.append(at[1:], len(values))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(own), pa.int64()), "owner": pa.array(own, pa.int64()), "code": pa.array([rice_encode(values[i:j] - z) for i, j, z in zip(at, ends, base, strict=True)], pa.binary())})

    return send


def _answer(t: pa.Table) -> pa.Table:
    """Which values of each block other blocks of this owner have too."""
    blocks, owners = t.column("block").to_pylist(), t.column("owner").to_pylist()
    lists = [rice_decode(c) for c in t.column("code").to_pylist()]
    _, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    bits = np.split(n[at] > 1, np.cumsum([len(v) for v in lists])[:-1])
    return pa.table({"block": pa.array(blocks, pa.int64()), "owner": pa.array(owners, pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _marker(bits: int, owner_bits: int):
    def mark(batches):
        for batch in batches:
            for _, ids, chars, prints, shas, answers in zip(*(batch.column(k).to_pylist() for k in ("block", "ids", "chars", "prints", "shas", "answers")), strict=True):
                values, n = _cut(prints, bits)
                owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
                hit = n > 1
                for a in answers or []:
                    i, j = np.searchsorted(owner, [a["owner"], a["owner"] + 1])
                    hit[i:j] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: j - i].astype(bool)
                own = np.array(prints, np.int64)
                suspect = hit[np.searchsorted(values, own.view(np.uint64) >> np.uint64(64 - bits))]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "chars": pa.array(chars, pa.int32()), "fp": pa.array(own), "sha": pa.array(shas, pa.binary()), "suspect": pa.array(suspect)})

    return mark


def _fingerprints(batches):
    for batch in batches:
        norm = [t.translate(None, SPACE) for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "chars": pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int32()), "fp": pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in norm], np.uint64).view(np.int64)), "norm": pa.array(norm, pa.binary())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = 10, owner_rows: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    owner_rows: fingerprints an owner holds at most, about; the number of owners follows the input.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(src.mapInArrow(_digest, _BLOCKS), "digests")
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    owner_bits = max(4, (width(spark) - 1).bit_length(), (max(1, rows // owner_rows) - 1).bit_length())
    bits = min(62, max(owner_bits + 1, rows.bit_length() + spare_bits))
    sent = blocks.select("block", "prints").mapInArrow(_sender(bits, owner_bits), "block long, owner long, code binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "block long, owner long, bits binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))
    marked = materialize(blocks.drop("n").join(answers, "block", "left").mapInArrow(_marker(bits, owner_bits), "doc_id long, chars int, fp long, sha binary, suspect boolean"), "marked")

    suspects = marked.filter("suspect")
    prints = suspects.select("fp").distinct()
    n = prints.count()
    texts = join_small(src.mapInArrow(_fingerprints, "doc_id long, chars int, fp long, norm binary"), prints, ["fp"], "left_semi", n, 64)
    # the bytes decide: rows group by the text itself; counts and the smallest id combine before the shuffle
    same = texts.groupBy("fp", "norm", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    same = same.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "chars", "n", "doc_id")
    groups = same.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max_by("doc_id", F.struct("chars", (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("k"))).alias("keep_id"), F.max("chars").alias("keep_chars"))
    groups = materialize(groups, "groups")
    # rows alike in id and text are counted, so that one of them stays
    members = suspects.groupBy("sha", "doc_id", "chars").agg(F.count(F.lit(1)).alias("copies"))
    members = join_small(members, groups, ["sha"], "inner", groups.count(), 128)
    members = members.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("best"), F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    members = members.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(members)
