"""Near-duplicate passages by compact windows.

Elements are hashes of five-word shingles (lower-case A-Z). For each of `hashes` functions, the places with the least value
of some run of `span` elements are the tall nodes of the Cartesian tree over the values; each gives one compact window: the
run starts for which it is the least. So a text of n elements has about 2 n / span windows a function, not n. A window's
signature joins that least value with the next function's least value in the run that has the place in its middle, so that
windows meet if two functions agree, and a short line that many texts share brings no links between them.

1. Texts are packed in blocks of bounded size, texts of over a million words cut with an overlap of a run.
2. An exchange of Rice coded signatures, as in golomb_dedup, tells each block which of its signatures other blocks have too.
3. Inside a block, windows of a signature link to the text before them and to the first text that has it; these links are
   verified at once, and texts that they connect are a class. Then all other pairs of windows of a signature whose texts are of
   different classes are tried. All windows of signatures that other blocks have, copies in a class once, go to the join of
   blocks, where the first ones of the blocks link likewise.
4. Links of near offsets are swept: the runs that their windows cover are candidate passages.
5. Candidates are verified place by place: an element counts as common if the other side has it within a few words of the
   offset. Runs stay in which every run of `span` elements has a Jaccard similarity of at least `least`.
6. What has been verified connects classes across blocks. For signatures whose windows are still of several classes, all pairs
   of windows of different classes are compared by sketches of the elements about them, then place by place by a byte of each
   element; those that this does not rule out go through steps 4 and 5 too. So whatever meets in a signature has been tried,
   cannot be a passage or is of one class: groups have no cap. Bytes travel with windows, not with pairs, so what is moved
   follows the input; the pairs compared where a signature's windows meet still grow with the square of their number.

Rows are pairs of a passage and its counterpart; `classes` gives the class of each text, the least id reachable through them.
Not each pair inside a class has a row. Of m common elements in a run of n, similarity is m / (2 n - m).

Nulls, ties, repeats: null, empty and shorter texts have no passages; null ids are carried through, but connect no classes; texts are ordered as the
scan meets them; repeated rows are texts of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, drop_path, estimated_bytes, join_small, materialize, recording, release, utf8, width
from .components import components
from .golomb_dedup import _answer, rice_encode

SHINGLE, BLOCK_BYTES, CUT = 5, 2 << 20, 1 << 20
#: Bits of a block's number in its task, of a text's in its block, of a place's in its block.
SEQ_BITS, ROW_BITS, POS_BITS = 24, 15, 24
#: Offsets are grouped by STEP; a counterpart may be off by SLACK more.
STEP, SLACK = 10, 10
_BLOCKS = "block long, n long, ids array<long>, bases array<long>, texts binary"
_I64 = pa.int64()
_K = np.uint64(0x9E3779B97F4A7C15)


#: All white space to spaces, so that line feeds can part texts.
_BLANK = bytes(32 if c in SPACE else c for c in range(256))


def packed(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(texts))


def unpacked(texts: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(texts).split(b"\n")


class _Hashes(dict):
    def __missing__(self, w):
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def elements(text: bytes, known: dict) -> np.ndarray:
    """A hash for every five-word shingle."""
    w = text.split()
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    out = h[: len(h) - SHINGLE + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, SHINGLE):
            out = out * _K + h[k : len(h) - SHINGLE + 1 + k]
    return _mixed(out)


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    n = len(x)
    m = -(-n // span) * span
    pad = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    rows = pad.reshape(-1, span)
    out = np.minimum.accumulate(rows, axis=1).ravel()[span - 1 : n]
    np.minimum.accumulate(rows[:, ::-1], axis=1, out=rows[:, ::-1])
    return np.minimum(out, pad[: n - span + 1], out=out)


def _blocker(overlap: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, bases, texts, size = [], [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << SEQ_BITS) | seq], _I64), "n": pa.array([len(ids)], _I64), "ids": pa.array([ids], pa.list_(_I64)), "bases": pa.array([bases], pa.list_(_I64)), "texts": pa.array([packed(texts)], pa.binary())})

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                t = t.lower().translate(_BLANK)
                pieces = [(0, t)]
                if len(t) > CUT:
                    w = t.split()
                    pieces = [(k, b" ".join(w[k : k + CUT + overlap])) for k in range(0, max(1, len(w) - overlap), CUT)]
                for base, p in pieces:
                    ids.append(d)
                    bases.append(base)
                    texts.append(p)
                    size += len(p)
                    if size >= BLOCK_BYTES or len(ids) >= 20_000:
                        yield block()
                        seq += 1
                        ids, bases, texts, size = [], [], [], 0
        if ids:
            yield block()

    return run


def block_elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts and the text of each."""
    known = _Hashes()
    parts = [np.fromiter(map(known.__getitem__, t.split()), np.uint64) for t in texts]  # no more than a text's words at once
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    h = np.concatenate([np.zeros(0, np.uint64), *parts])
    del parts
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    if len(h) < SHINGLE:
        return h[:0], text[:0]
    out = h[: len(h) - SHINGLE + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, SHINGLE):
            out = out * _K + h[k : len(h) - SHINGLE + 1 + k]
    inside = text[: len(out)] == text[SHINGLE - 1 :]
    return _mixed(out[inside]), text[: len(out)][inside]


def _block_windows(e: np.ndarray, text: np.ndarray, count: int, span: int, hashes: int):
    """signature, text, least place, first and last start of the compact windows of a block's texts, given their elements."""
    kinds = (np.uint64, np.int32, np.int32, np.int32, np.int32)
    cols: list[list] = [[np.zeros(0, k)] for k in kinds]
    if len(e) >= span:
        offset = np.searchsorted(text, np.arange(count + 1))
        place = np.arange(len(e), dtype=np.uint64)
        low = np.uint64((1 << POS_BITS) - 1)
        valid = text[: len(e) - span + 1] == text[span - 1 :]  # runs inside a text

        def function(f: int):
            with np.errstate(over="ignore"):
                v = _mixed(e + np.uint64(f + 1) * _K)
            return v, _sliding_least((v & ~low) | place, span)

        start = now = function(0)
        for f in range(hashes):
            after = function(f + 1) if f + 1 < hashes else start
            (v, least), (v_after, least_after) = now, after
            differs = least[1:] != least[:-1]
            first = np.flatnonzero(valid & np.append(True, differs | ~valid[:-1]))
            last = np.flatnonzero(valid & np.append(differs | ~valid[1:], True))
            at = (least[first] & low).astype(np.int64)
            middle = np.clip(at - span // 2, first, last)
            own = text[first]
            base = offset[own]
            with np.errstate(over="ignore"):
                sig = _mixed(v[at] * _K + v_after[(least_after[middle] & low).astype(np.int64)])
            for c, x in zip(cols, (sig, own, at - base, first - base, last - base), strict=True):
                c.append(x)
            now = after
    return [np.concatenate(c).astype(k) for c, k in zip(cols, kinds, strict=True)]


def _each(batch: pa.RecordBatch, *columns: str):
    """The blocks of a batch, one at a time; a batch may hold many."""
    for k in range(batch.num_rows):
        yield tuple(unpacked(batch.column(c)[k].as_py()) if c == "texts" else batch.column(c)[k].as_py() for c in columns)


def _sender(span: int, hashes: int, bits: int, owner_bits: int):
    def send(batches):
        for batch in batches:
            for block, texts in _each(batch, "block", "texts"):
                values = np.unique(_block_windows(*block_elements(texts), len(texts), span, hashes)[0] >> np.uint64(64 - bits))
                owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
                at = np.flatnonzero(np.diff(owner, prepend=-1))
                ends = np.append(at[1:], len(values))
                base = owner[at].astype(np.uint64) << np.uint64(bits - owner_bits)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(at), _I64), "owner": pa.array(owner[at], _I64), "code": pa.array([rice_encode(values[i:j] - z) for i, j, z in zip(at, ends, base, strict=True)], pa.binary())})

    return send


def spans(row, other, at, o_at, first, last, span: int):
    """row, a, b, other, q: the runs of each row that its links to another row with offsets in [q STEP, (q + 1) STEP) cover."""
    q = (at.astype(np.int64) - o_at) // STEP
    order = np.lexsort((first, q, other, row))
    row, other, q, first, end = row[order], other[order], q[order], first[order].astype(np.int64), last[order].astype(np.int64) + span
    if not len(row):
        return row, first, end, other, q
    group = np.cumsum(np.append(False, (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (q[1:] != q[:-1]))) << 32
    reach = np.maximum.accumulate(group + end)
    new = np.flatnonzero(np.append(True, (group + first)[1:] > reach[:-1]))
    return row[new], first[new], np.maximum.reduceat(end, new), other[new], q[new]


def local_links(sig, text, at, first, last):
    """text, other, at, o_at, first, last: windows of a signature with the text before and the first text that has it; what else
    meets in a signature is left to rest_pairs."""
    order = np.lexsort((at, text, sig))
    s, t = sig[order], text[order]
    new_sig = np.append(True, s[1:] != s[:-1])[: len(s)]
    new_text = new_sig | np.append(True, t[1:] != t[:-1])[: len(s)]
    lead = np.flatnonzero(new_text)  # the first window of a text that has the signature
    k = np.cumsum(new_text) - 1
    head = np.flatnonzero(new_sig[lead])[np.cumsum(new_sig[lead]) - 1] if len(lead) else lead
    before = np.where(new_sig[lead], -1, np.arange(len(lead)) - 1)
    x, y = [], []
    for to in (before, np.where(head < before, head, -1)):
        has = to[k] >= 0
        x.append(order[has])
        y.append(order[lead[to[k[has]]]])
    x, y = np.concatenate(x), np.concatenate(y)
    return text[x], text[y], at[x], at[y], first[x], last[x]


def contents(e: np.ndarray, text: np.ndarray, offset: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> np.ndarray:
    """A hash of the elements of each window and of those about it that verification may see."""
    around = STEP + SLACK
    a = offset[text] + np.maximum(0, first - around)
    b = np.minimum(offset[text + 1], offset[text] + last + span + around)
    with np.errstate(over="ignore"):
        power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(e), k, np.uint64))) for k in (_K, np.uint64(pow(int(_K), -1, 1 << 64))))
        total = np.append(np.uint64(0), np.cumsum(e * power[:-1]))
        return _mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) + (first - np.maximum(0, first - around)).astype(np.uint64) * _K)


def roots(n: int, edges) -> np.ndarray:
    """The least of each one's class."""
    up = list(range(n))

    def root(a):
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return np.array([root(a) for a in range(n)], np.int64)


def rest_pairs(sig, label, same, most: int = 4096):
    """Pairs of places that have a signature in common and differ in label, in arrays of about most pairs or one row of a
    group; copies (alike in signature, label and same) once."""
    order = np.lexsort((same, label, sig))
    s, c = sig[order], label[order]
    new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (same[order][1:] != same[order][:-1]))[: len(s)]
    order, s, c = order[new], s[new], c[new]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    size = np.diff(np.append(start, len(s)))
    mixed = c[start] != c[start + size - 1] if len(start) else np.zeros(0, bool)
    xs, ys, n = [], [], 0
    for b, g in zip(start[mixed].tolist(), size[mixed].tolist(), strict=True):
        own, step = c[b : b + g], max(1, most // g)
        for k in range(0, g, step):
            i, j = np.nonzero(own[k : k + step, None] > own[None, :])  # each pair once, from the greater label
            xs.append(order[b + k + i])
            ys.append(order[b + j])
            n += len(i)
            if n >= most:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def may_verify(e, offset, text, at, x, y, span: int, least: float) -> np.ndarray:
    """Whether windows x and y can have a passage within two runs of their least places, so in all that spans may join them to."""
    around, far = STEP + SLACK, 2 * span

    def about(w, reach):
        i = at[w][:, None] + np.arange(-reach, reach + 1)
        n = (offset[text[w] + 1] - offset[text[w]])[:, None]
        inside = (i >= 0) & (i < n)
        return e[np.where(inside, i + offset[text[w]][:, None], 0)], inside

    (own, own_in), (other, other_in) = about(x, far), about(y, far + around)
    n = 2 * far + 1
    common = np.zeros(own.shape, bool)
    for d in range(2 * around + 1):
        common |= (own == other[:, d : d + n]) & other_in[:, d : d + n]
    total = np.cumsum(np.pad(common & own_in, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    return ((total[:, span:] - total[:, :-span]).max(axis=1)) * (1 + least) >= 2 * least * span - 1e-9


def abouts(e, offset, text, at, span: int) -> np.ndarray:
    """For each window a byte of each element that verification may see from it, two runs about its least place; then, as bits,
    which of them its text has."""
    reach = 2 * span + STEP + SLACK
    i = at.astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
    inside = (i >= 0) & (i < (offset[text + 1] - offset[text])[:, None])
    own = (e >> np.uint64(48)).astype(np.uint8)[np.where(inside, i + offset[text][:, None], 0)] if len(e) else np.zeros(i.shape, np.uint8)
    return np.concatenate([np.where(inside, own, np.uint8(0)), np.packbits(inside, axis=1)], axis=1)


def _opened(about: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    wide = 2 * (2 * span + STEP + SLACK) + 1
    return about[:, :wide], np.unpackbits(about[:, wide:], axis=1, count=wide).astype(bool)


def sketches(about: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For what abouts gives of each window the bits of the elements of pieces of half a run: as the asking side, and, with the
    elements that verification may see beside them, as the answering side."""
    around, far, piece = STEP + SLACK, 2 * span, span // 2
    bit, inside = _opened(about, span)
    value = np.where(inside, np.uint64(1) << (bit & np.uint8(63)).astype(np.uint64), np.uint64(0))
    halves = [np.where((bit >> np.uint8(6)) & np.uint8(1) == h, value, np.uint64(0)) for h in (0, 1)]
    own, other = [], []
    for k in range(around, around + far * 2 // piece * piece, piece):
        whole = inside[:, k : k + piece].all(axis=1)  # a run lies inside its text: else nothing answers all bits
        for h in halves:
            own.append(np.where(whole, np.bitwise_or.reduce(h[:, k : k + piece], axis=1), ~np.uint64(0)))
            other.append(np.bitwise_or.reduce(h[:, k - around : k + piece + around], axis=1))
    return np.stack(own), np.stack(other)


def sketches_meet(own: np.ndarray, other: np.ndarray, span: int, least: float) -> np.ndarray:
    """Whether sketches of asking windows (rows) and answering ones (columns) leave a passage possible. A passage within reach of
    both has a run of span elements, of which at most `missing` are not on the other side, and each run has a whole piece in it."""
    missing = span - int(np.ceil(2 * least * span / (1 + least) - 1e-9))
    may = np.zeros((own.shape[1], other.shape[1]), bool)
    for k in range(0, len(own), 2):
        lacks = [np.bitwise_count(own[k + h][:, None] & ~other[k + h]) for h in (0, 1)]
        may |= lacks[0] + lacks[1] <= missing
    return may


def bytes_meet(x: np.ndarray, y: np.ndarray, span: int, least: float) -> np.ndarray:
    """may_verify by what abouts gives of windows x and y, a row each: a byte may hide a difference, never a common element."""
    around, n = STEP + SLACK, 4 * span + 1
    (own, own_in), (other, other_in) = ([np.ascontiguousarray(c.T) for c in _opened(z, span)] for z in (x, y))
    own, own_in = own[around : around + n], own_in[around : around + n]
    common = np.zeros(own.shape, bool)
    same, lacking = np.empty_like(common), not other_in.all()
    for d in range(2 * around + 1):
        np.equal(own, other[d : d + n], out=same)
        if lacking:
            same &= other_in[d : d + n]
        common |= same
    total = np.zeros((n + 1, own.shape[1]), np.int16)
    np.cumsum(common & own_in, axis=0, out=total[1:])
    return (total[span:] - total[:-span]).max(axis=0) * (1 + least) >= 2 * least * span - 1e-9


def _sifter(span: int, least: float):
    """Links of the windows of a signature that sketches and bytes leave, from greater classes to lesser ones in other blocks."""

    def sift(t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        row, label, place = (t.column(c).to_numpy() for c in ("row", "class", "place"))
        about = np.frombuffer(b"".join(t.column("about").to_pylist()), np.uint8).reshape(len(row), -1)
        own, other = sketches(about, span)
        block, lower, step = row >> ROW_BITS, np.searchsorted(label, label), max(1, (1 << 16) // len(row))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(row), step):
            n = int(lower[k : k + step].max())
            may = sketches_meet(own[:, k : k + step], other[:, :n], span, least)
            may &= (np.arange(n) < lower[k : k + step, None]) & (block[:n] != block[k : k + step, None])
            x, y = np.nonzero(may)
            for c in range(0, len(x), 1024):
                i, j = x[c : c + 1024] + k, y[c : c + 1024]
                left = bytes_meet(about[i], about[j], span, least)
                xs.append(i[left])
                ys.append(j[left])
        x, y = np.concatenate(xs), np.concatenate(ys)
        at = place >> 32
        cols = (row[x], at[x], (at - (place >> 16 & 0xFFFF))[x], (at - (place & 0xFFFF))[x], row[y], at[y])
        return pa.table({n.split()[0]: pa.array(c, _I64 if n.endswith("long") else pa.int32()) for n, c in zip(_LINKS.split(", "), cols, strict=True)})

    return sift


_LINKS = "row long, at int, first int, last int, other long, o_at int"


def _describer(span: int):
    """Asked windows with the bytes about them."""

    def describe(batches):
        for batch in batches:
            for texts, asked in _each(batch, "texts", "asked"):
                rows = np.array([q["row"] for q in asked], np.int64)
                at = np.array([q["at"] for q in asked], np.int64)
                used, text = np.unique(rows & ((1 << ROW_BITS) - 1), return_inverse=True)
                e, own = block_elements([texts[i] for i in used.tolist()])
                offset = np.searchsorted(own, np.arange(len(used) + 1))
                for k in range(0, len(asked), 2048):
                    part = asked[k : k + 2048]
                    cols = [pa.array([q[c] for q in part], _I64) for c in ("sig", "row", "class")]
                    # one column: a least place is less than a run behind the starts of its window
                    cols.append(pa.array([q["at"] << 32 | (q["at"] - q["first"]) << 16 | (q["at"] - q["last"]) for q in part], _I64))
                    cols.append(pa.array([x.tobytes() for x in abouts(e, offset, text[k : k + 2048], at[k : k + 2048], span)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OPEN.split(", ")])

    return describe


_ASKED = ("sig", "row", "at", "first", "last", "class")
_OPEN = "sig long, row long, class long, place long, about binary"


def _keeper(span: int, hashes: int, least: float, bits: int, owner_bits: int):
    """Passages inside blocks, and the windows that go to the join of blocks: row is null in the former, doc_id in the latter."""

    def keep(batches):
        for batch in batches:
            for block, ids, bases, texts, answers in _each(batch, "block", "ids", "bases", "texts", "answers"):
                e, own = block_elements(texts)
                offset = np.searchsorted(own, np.arange(len(texts) + 1))
                sig, text, at, first, last = _block_windows(e, own, len(texts), span, hashes)
                pairs: set[tuple[int, int]] = set()

                def passages_of(links):
                    out: list[tuple] = []
                    for x, a, b, y, q in zip(*(c.tolist() for c in spans(*links, span)), strict=True):
                        if found := verified((ids[x], bases[x], a, e[offset[x] + a : offset[x] + b]), (ids[y], bases[y], 0, e[offset[y] : offset[y + 1]]), q, span, least):
                            pairs.add((x, y))
                            out += found
                        if len(out) >= 10_000:
                            yield _found(out)
                            out = []
                    yield _found(out)

                yield from passages_of(local_links(sig, text, at, first, last))
                same = contents(e, text, offset, first, last, span)
                likely, short = [], e.astype(np.uint32)
                for x, y in rest_pairs(sig, roots(len(texts), pairs)[text], same):
                    x, y = (z[may_verify(short, offset, text, at, x, y, span, least)] for z in (x, y))
                    likely.append((text[x], text[y], at[x], at[y], first[x], last[x]))
                if likely:
                    yield from passages_of([np.concatenate(c) for c in zip(*likely, strict=True)])
                label = roots(len(texts), pairs)[text]
                cut = sig >> np.uint64(64 - bits)
                values = np.unique(cut)
                owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
                hit = np.zeros(len(values), bool)
                for x in answers or []:
                    i, j = np.searchsorted(owner, [x["owner"], x["owner"] + 1])
                    hit[i:j] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: j - i].astype(bool)
                sent = np.flatnonzero(hit[np.searchsorted(values, cut)]) if len(values) else np.zeros(0, np.int64)
                sent = sent[np.lexsort((at[sent], text[sent], sig[sent]))]
                lead = np.append(True, sig[sent][1:] != sig[sent][:-1])[: len(sent)]
                order = np.lexsort((np.arange(len(sent)), same[sent], label[sent], sig[sent]))  # copies once, the lead among them
                o = sent[order]
                new = np.append(True, (sig[o][1:] != sig[o][:-1]) | (label[o][1:] != label[o][:-1]) | (same[o][1:] != same[o][:-1]))[: len(o)]
                stays = np.sort(order[new])
                sent, lead = sent[stays], lead[stays]
                for k in range(0, len(sent), 100_000):
                    h = sent[k : k + 100_000]
                    row, root = ((block << ROW_BITS) | z.astype(np.int64) for z in (text[h], label[h]))
                    yield _found([], [np.ascontiguousarray(sig[h]).view(np.int64), row, at[h], first[h], last[h], root, np.ascontiguousarray(same[h]).view(np.int64), lead[k : k + 100_000]])

    return keep


def _found(passages: list[tuple], windows: list[np.ndarray] | None = None) -> pa.RecordBatch:
    n = len(passages) if windows is None else len(windows[0])
    kinds = (_I64, _I64, pa.int32(), pa.int32(), pa.int32(), _I64, _I64, pa.bool_())
    left = [pa.nulls(n, k) for k in kinds] if windows is None else [pa.array(x, k) for x, k in zip(windows, kinds, strict=True)]
    right = list(_passages(passages).columns) if windows is None else [pa.nulls(n, pa.float64() if k == 6 else _I64) for k in range(7)]
    return pa.RecordBatch.from_arrays([*left, *right], [x.split()[0] for x in (_WINDOWS + ", " + _OUT).split(", ")])


def _passages(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else _I64) for k, c in enumerate(cols)], [x.split()[0] for x in _OUT.split(", ")])


def _sweeper(span: int):
    """Candidate passages of the rows of a block."""

    def sweep(t: pa.Table) -> pa.Table:
        found = spans(*(t.column(c).to_numpy() for c in ("row", "other", "at", "o_at", "first", "last")), span)
        return pa.table({n: pa.array(x, _I64) for n, x in zip(("row", "a", "b", "other", "q"), found, strict=True)})

    return sweep


def _fetcher():
    """Elements of asked ranges of a block's texts."""

    def fetch(batches):
        for batch in batches:
            for _, ids, bases, texts, asked in _each(batch, "block", "ids", "bases", "texts", "asked"):
                known = _Hashes()
                out, done = [], {}
                for q in sorted(asked, key=lambda q: q["row"]):
                    i = q["row"] & ((1 << ROW_BITS) - 1)
                    if i not in done:
                        done = {i: (elements(texts[i], known) >> np.uint64(32)).astype(np.uint32)}
                    a, b = max(0, q["a"]), min(len(done[i]), q["b"])
                    out.append((q["row"], q["a"], q["b"], q["answers"], ids[i], bases[i], a, done[i][a:b].tobytes()))
                    if len(out) >= 256:
                        yield _ranges(out)
                        out = []
                if out:
                    yield _ranges(out)

    return fetch


_RANGES = "row long, a long, b long, answers boolean, doc_id long, base long, from long, elements binary"


def _ranges(out: list[tuple]) -> pa.RecordBatch:
    cols = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, {3: pa.bool_(), 7: pa.binary()}.get(k, _I64)) for k, c in enumerate(cols)], [x.split()[0] for x in _RANGES.split(", ")])


_OUT = "doc_id long, first_word long, last_word long, other_doc_id long, other_first_word long, other_last_word long, similarity double"
_WINDOWS = "sig long, row long, at int, first int, last int, label long, same long, lead boolean"
_PAIRS = "row long, other long, "


def verified(x: tuple, y: tuple, q: int, span: int, least: float) -> list[tuple]:
    """Passages of x in y near offset group q; each is id, first word of the text, first element, elements."""
    (x_id, x_base, a, own), (y_id, y_base, y_from, other) = x, y
    reach = STEP // 2 + SLACK
    centre = q * STEP + STEP // 2
    n = len(own)
    if n < span:
        return []
    # place i of x may match places start + i to start + i + 2 reach of y
    start = a - centre - reach - y_from
    padded = np.zeros(n + 2 * reach, own.dtype)
    i, j = max(0, start), min(len(other), start + len(padded))
    if j > i:
        padded[i - start : j - start] = other[i:j]
    same = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1) == own[:, None]
    total = np.append(0, np.cumsum(same.any(axis=1)))
    good = (total[span:] - total[:-span]) * (1 + least) >= 2 * least * span - 1e-9  # m / (2 span - m) >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    out = []
    for p, r in zip(edge[::2].tolist(), (edge[1::2] - 1 + span).tolist(), strict=True):
        m = int(total[r] - total[p])
        o = max(0, y_from + start + p + int(same[p:r].sum(axis=0).argmax()))
        out.append((x_id, x_base + a + p, x_base + a + r + SHINGLE - 2, y_id, y_base + o, y_base + o + r - p + SHINGLE - 2, m / (2 * (r - p) - m)))
    return out


def _verifier(span: int, least: float):
    def verify(batches):
        for batch in batches:
            out: list[tuple] = []
            rows: list[tuple] = []
            for r in batch.to_pylist():
                found = verified((r["doc_id"], r["base"], r["x_from"], np.frombuffer(r["x"], np.uint32)), (r["o_doc_id"], r["o_base"], r["y_from"], np.frombuffer(r["y"], np.uint32)), r["q"], span, least)
                out += found
                rows += [(r["row"], r["other"])] * len(found)
            names = [pa.array([x[k] for x in rows], _I64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, *_passages(out).columns], [x.split()[0] for x in (_PAIRS + _OUT).split(", ")])

    return verify


def passages(docs: DataFrame, words: int = 50, hashes: int = 6, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word, other_doc_id, other_first_word, other_last_word, similarity."""
    span = words - SHINGLE + 1
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(src.mapInArrow(_blocker(words - 1), _BLOCKS), "blocks")
    n_blocks = blocks.count()
    per_block = hashes * 2 * (BLOCK_BYTES // 6) // span
    owner_bits = max(4, (width(docs.sparkSession) - 1).bit_length(), (max(1, n_blocks * per_block >> 20) - 1).bit_length())
    bits = min(62, max(owner_bits + 1, (n_blocks * per_block).bit_length() + 10))
    # a signature has its functions mixed in, so they share one exchange
    answers = blocks.select("block", "texts").mapInArrow(_sender(span, hashes, bits, owner_bits), "block long, owner long, code binary").groupBy("owner").applyInArrow(_answer, "block long, owner long, bits binary")
    answers = materialize(answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("answers")), "answers")
    asked = join_small(blocks, answers, ["block"], "left", 1, estimated_bytes(answers))
    found = materialize(asked.mapInArrow(_keeper(span, hashes, least, bits, owner_bits), _WINDOWS + ", " + _OUT), "windows")
    out = [x.split()[0] for x in _OUT.split(", ")]
    near, ends = found.filter("row is null").select(*out), found.filter("row is not null").select(*[x.split()[0] for x in _WINDOWS.split(", ")])
    # one window of a signature from each block
    group = Window.partitionBy("sig").orderBy("row")
    place = F.struct("row", F.col("at").alias("o_at"))
    to = ends.filter("lead").select("row", "at", "first", "last", F.array_distinct(F.array(F.lag(place).over(group), F.first(place).over(group))).alias("to"))
    links = to.select("row", "at", "first", "last", F.explode("to").alias("to")).select("row", "at", "first", "last", F.col("to.row").alias("other"), "to.o_at").filter("other <> row")
    far = _across(blocks, links, span, least)
    release(docs.sparkSession)
    with recording(made := []):
        links = _rest_links(blocks, ends, far, span, least)
    rest = _across(blocks, links, span, least)
    for path in made:
        drop_path(docs.sparkSession, path)
    return near.unionByName(far.select(*out)).unionByName(rest.select(*out))


def _rest_links(blocks: DataFrame, ends: DataFrame, far: DataFrame, span: int, least: float) -> DataFrame:
    """Links of all windows that meet in a signature, whose texts what has been verified does not connect, and that can have a
    passage."""
    names = ends.filter("row <> label").select("row", "label").distinct()
    edges = far.select("row", "other").distinct()
    for c, to in (("row", "u"), ("other", "v")):
        edges = edges.join(names.select(F.col("row").alias(c), F.col("label").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    comp = materialize(components(edges.select("u", "v")).select(F.col("node").alias("label"), F.col("label").alias("class")), "classes")
    named = join_small(ends, comp, ["label"], "left", comp.count(), 32).withColumn("class", F.coalesce("class", "label"))
    # blocks have tried their own pairs, and leads the one before and the first
    group = Window.partitionBy("sig")
    tried = F.count(F.lit(1)).over(group) <= F.when(F.min("lead").over(group), 3).otherwise(2)
    named = named.withColumn("open", (F.min("class").over(group) < F.max("class").over(group)) & ~tried).filter("open")
    named = named.select("sig", "row", "at", "first", "last", "class", "same").dropDuplicates(["sig", "class", "same"])
    asked = materialize(named.groupBy(F.shiftright("row", ROW_BITS).alias("block")).agg(F.collect_list(F.struct(*_ASKED)).alias("asked")), "asked")
    del named
    release(blocks.sparkSession)  # the exchange of all windows
    named = materialize(join_small(blocks, asked, ["block"], "inner", 1, estimated_bytes(asked)).mapInArrow(_describer(span), _OPEN), "open")
    return named.groupBy("sig").applyInArrow(_sifter(span, least), _LINKS)


def _across(blocks: DataFrame, links: DataFrame, span: int, least: float) -> DataFrame:
    """Verified passages of links between blocks, with their rows."""
    with recording(made := []):
        verify = _verification(blocks, links, span, least)
    found = materialize(verify, "passages")
    for path in made:
        drop_path(blocks.sparkSession, path)
    return found


def _verification(blocks: DataFrame, links: DataFrame, span: int, least: float) -> DataFrame:
    far = materialize(links.groupBy(F.shiftright("row", ROW_BITS)).applyInArrow(_sweeper(span), "row long, a long, b long, other long, q long"), "spans")
    reach = STEP // 2 + SLACK
    centre = F.col("q") * STEP + STEP // 2
    sides = far.select("row", "a", "b", "other", "q", F.greatest(F.lit(0), F.col("a") - centre - reach).alias("oa"), F.greatest(F.lit(0), F.col("b") - centre + reach).alias("ob"))
    # each side's ranges are marked, so that the join moves no others
    wanted = sides.select("row", "a", "b", F.lit(False).alias("answers")).unionByName(sides.select(F.col("other").alias("row"), F.col("oa").alias("a"), F.col("ob").alias("b"), F.lit(True).alias("answers"))).distinct()
    wanted = materialize(wanted.groupBy(F.shiftright("row", ROW_BITS).alias("block")).agg(F.collect_list(F.struct("row", "a", "b", "answers")).alias("asked")), "wanted")
    release(blocks.sparkSession)  # the exchanges of links
    ranges = materialize(join_small(blocks, wanted, ["block"], "inner", 1, estimated_bytes(wanted)).mapInArrow(_fetcher(), _RANGES), "ranges")
    x = ranges.filter("not answers").select("row", "a", "b", "doc_id", "base", F.col("from").alias("x_from"), F.col("elements").alias("x"))
    y = ranges.filter("answers").select(F.col("row").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("doc_id").alias("o_doc_id"), F.col("base").alias("o_base"), F.col("from").alias("y_from"), F.col("elements").alias("y"))
    return sides.join(x, ["row", "a", "b"]).join(y, ["other", "oa", "ob"]).mapInArrow(_verifier(span, least), _PAIRS + _OUT)


def classes(found: DataFrame) -> DataFrame:
    """doc_id, class_id of every text that passages has rows of: the least id reachable through them."""
    return components(found.select(F.col("doc_id").alias("u"), F.col("other_doc_id").alias("v"))).select(F.col("node").alias("doc_id"), F.col("label").alias("class_id"))
