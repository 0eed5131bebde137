"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows around hits.

The lexicon is learned: words, and beginnings of words, that labelled toxic documents have far more often than others. Its
trie and the automaton that allows edits (none below 5 letters, one below 9, else two) are run together as one machine whose
states are sets of (trie node, edits) and whose steps are built once and remembered; most words leave it after a few letters.
Each hit is weighed by how much its term, exact, misspelled or as a beginning, speaks for the label in the sample, and by its
window: inside quotation marks, or near words of reporting, a hit counts a part only; near words of address, more.
A term that the sample never misspells has BACKED_OFF of its exact weight when misspelled.
A logistic curve over the sum, fitted on the same sample, gives the score.

The sample has at most `learn_rows` labelled documents (12000 by default); counts of its words are combined before they are
sent, the lexicon has at most `terms` terms. Whole texts are scored.

Nulls, ties, repeats: null and empty texts are scored as texts without hits; null labels are left out; with labels of one
class or none the lexicon is empty and the score is the constant share of that class (0.5 for none); terms of equal weight
are ordered by name; repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample

EDGE = "#$%&@+=~^/.,;:!?\"'()[]{}<>*_-|«»“”„‘’…"
OPEN, CLOSE = "\"'«“„‘(", "\"'»”“’)"
REPORT = frozenset("said says wrote writes quote quoted called calls word term dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u ur du dein ihr sie tu vous ton votre tú usted eres vosotros".split())
WINDOW, QUOTED, REPORTED, ADDRESSED = 8, 0.3, 0.6, 1.25
EXACT, MISSPELLED, BEGINNING = 0, 1, 2
BACKED_OFF = 0.7  # of a term's exact weight, for misspellings of a term that the sample has only spelled right


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Machine:
    """The lexicon's trie with the Levenshtein automaton; step results are remembered."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.open: list[int] = [-1]
        self.most = [0]
        for k, w in enumerate(words):
            self._add(w, k, self.word, edits_allowed(w))
        for k, w in enumerate(beginnings):
            self._add(w, k, self.open, 0)
        self.allowed = [edits_allowed(w) for w in words]
        start = self._closed({0: 0})
        self.start = self._state(start)

    def _add(self, term: str, k: int, ends: list[int], allowed: int) -> None:
        at = 0
        self.most[0] = max(self.most[0], allowed)
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                for x, v in ((self.next, {}), (self.word, -1), (self.open, -1), (self.most, 0)):
                    x.append(v)
            at = self.next[at][c]
            self.most[at] = max(self.most[at], allowed)
        ends[at] = k

    def _put(self, states: dict, node: int, e: int) -> None:
        if e <= self.most[node] and e < states.get(node, 99):
            states[node] = e

    def _closed(self, states: dict) -> dict:
        """With the letters that a text may lack."""
        todo = list(states)
        while todo:
            node = todo.pop()
            for n in self.next[node].values():
                if states[node] + 1 <= self.most[n] and states[node] + 1 < states.get(n, 99):
                    states[n] = states[node] + 1
                    todo.append(n)
        return states

    def _state(self, states: dict) -> tuple | None:
        """(transitions, accepted word, exact?, open beginning, nodes)."""
        if not states:
            return None
        key = frozenset(states.items())
        known = self.__dict__.setdefault("known", {})
        if key not in known:
            ends = sorted((e, self.word[n]) for n, e in states.items() if self.word[n] >= 0 and e <= self.allowed[self.word[n]])
            opened = sorted(self.open[n] for n, e in states.items() if self.open[n] >= 0 and e == 0)
            known[key] = ({}, ends[0] if ends else None, opened[0] if opened else -1, states)
        return known[key]

    def _step(self, state: tuple, c: str) -> tuple | None:
        new: dict = {}
        for node, e in state[3].items():
            self._put(new, node, e + 1)  # a letter too many
            for x, n in self.next[node].items():
                self._put(new, n, e if x == c else e + 1)
        out = self._state(self._closed(new))
        state[0][c] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(kind, term) of the best hit of a word."""
        state, opened = self.start, -1
        for c in word:
            known = state[0]
            state = known[c] if c in known else self._step(state, c)
            if state is None:
                break
            if state[2] >= 0:
                opened = state[2]
        else:
            if state[1] is not None and state[1][0] == 0:
                return EXACT, state[1][1]
        if opened >= 0:
            return BEGINNING, opened
        if state is not None and state[1] is not None:
            return MISSPELLED, state[1][1]
        return None


def hits(text: str, match, memo: dict) -> list[tuple[tuple[int, int], float]]:
    """((kind, term), context factor) of every hit."""
    words = text.lower().split()
    out = []
    for i, w in enumerate(words):
        if w in memo:
            hit = memo[w]
        else:
            bare = w.strip(EDGE)
            if len(memo) > 400_000:
                memo.clear()
            hit = memo[w] = match(bare) if bare else None
        if hit is not None:
            out.append((hit, context(words, i)))
    return out


def context(words: list[str], i: int) -> float:
    """How much a hit at i counts, from its window."""
    near = words[max(0, i - WINDOW) : i + WINDOW + 1]
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = any(w[0] in OPEN for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in set(CLOSE) and w.rstrip(".,;:!?") for w in after)
    factor = QUOTED if opened and closed else 1.0
    bare = {w.strip(EDGE) for w in near}
    if bare & REPORT:
        factor *= REPORTED
    elif bare & ADDRESS:
        factor *= ADDRESSED
    return factor


@dataclass
class Model:
    words: list[str]
    beginnings: list[str]
    weight: dict[tuple[int, int], float]
    a: float
    b: float

    def total(self, found: list[tuple[tuple[int, int], float]]) -> float:
        """Each term counts once for each kind of hit, by its strongest context."""
        best: dict = {}
        for key, factor in found:
            w = self.weight.get(key, 0.0) * factor
            best[key] = max(best.get(key, 0.0), w)
        return sum(best.values())


def _counts(least: int, longest: int):
    """Documents of either label by word and by beginning, combined for a partition."""

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = {w.strip(EDGE) for w in t.lower().split()} - {""}
                seen[bool(y)].update("=" + w for w in words if len(w) >= 3)
                seen[bool(y)].update({"^" + w[:k] for w in words for k in range(least, min(len(w), longest + 1))})
        keys = [k for k in seen[1]]
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "bad": pa.array([seen[1][k] for k in keys], pa.int64()), "good": pa.array([0] * len(keys), pa.int64())})
        keys = [k for k in seen[0]]
        for i in range(0, len(keys), 50_000):
            own = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(own, pa.string()), "bad": pa.array([0] * len(own), pa.int64()), "good": pa.array([seen[0][k] for k in own], pa.int64())})

    return run


def _found(words: list[str], beginnings: list[str]):
    def run(batches):
        m, memo = Machine(words, beginnings), {}
        for batch in batches:
            rows = [hits(t or "", m.match, memo) for t in batch.column("text").to_pylist()]
            kind = [[k for (k, _), _ in r] for r in rows]
            term = [[t for (_, t), _ in r] for r in rows]
            factor = [[f for _, f in r] for r in rows]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "kind": pa.array(kind, pa.list_(pa.int32())), "term": pa.array(term, pa.list_(pa.int32())), "factor": pa.array(factor, pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, labels: DataFrame, learn, learn_rows: int = 12000, terms: int = 1500, min_docs: int = 4, min_lift: float = 12.0, min_g: float = 20.0, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    from .common import materialize

    some = materialize(labelled_sample(docs, labels, label_col, learn, learn_rows, id_col, text_col), "labelled")
    n = {r["label"] > 0: r["n"] for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        share = 0.5 if not bad + good else min(0.999, max(0.001, bad / (bad + good)))
        return Model([], [], {}, float(np.log(share / (1 - share))), 0.0)
    counts = some.mapInArrow(_counts(4, 9), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    # twice the log-likelihood gained by the term's own rate: what many words of few documents reach by chance stays below min_g
    gain = 2 * F.col("bad") * F.log((F.col("bad") / bad) / ((F.col("bad") + F.col("good")) / (bad + good)))
    top = counts.filter((F.col("bad") >= min_docs) & (lift >= min_lift) & (gain >= min_g)).orderBy(F.desc(F.col("bad") * F.log(lift)), "term").limit(4 * terms).collect()
    whole = {r["term"][1:]: r for r in top if r["term"][0] == "="}
    opens = {r["term"][1:]: r for r in top if r["term"][0] == "^" and r["bad"] >= 2 * min_docs}
    # of nested beginnings the longest with nearly all documents of the shortest stays; one that a single word explains is none
    opens = {p: r for p, r in opens.items() if r["bad"] > 1.2 * max([whole[w]["bad"] for w in whole if w.startswith(p)], default=0)}
    opens = {p: r for p, r in opens.items() if not any(p[:k] in opens and opens[p[:k]]["bad"] <= 1.1 * r["bad"] for k in range(4, len(p)))}
    words, beginnings = sorted(list(whole)[:terms]), sorted(opens)
    t = some.mapInArrow(_found(words, beginnings), "label int, kind array<int>, term array<int>, factor array<double>").toArrow()
    rows = [list(zip(zip(k, x, strict=True), f, strict=True)) for k, x, f in zip(t["kind"].to_pylist(), t["term"].to_pylist(), t["factor"].to_pylist(), strict=True)]
    y = t["label"].to_numpy() > 0
    seen = Counter(), Counter()
    for r, label in zip(rows, y, strict=True):
        seen[bool(label)].update({k for k, _ in r})
    # half a standard deviation below the count, so that rare terms weigh less
    weight = {k: float(np.clip(np.log((max(seen[1][k] - 0.5 * seen[1][k] ** 0.5, 0.1) / bad) / ((seen[0][k] + 0.5) / good)), 0, 8)) for k in set(seen[1]) | set(seen[0])}
    weight |= {(MISSPELLED, t): BACKED_OFF * w for (kind, t), w in weight.items() if kind == EXACT and (MISSPELLED, t) not in weight}
    model = Model(words, beginnings, weight, 0.0, 1.0)
    z = np.array([model.total(r) for r in rows])
    a, b = -2.0, 1.0
    for _ in range(300):  # ridge logistic regression in one variable
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        g, s = p - y, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[s.sum() + 0.1, (s * z).sum()], [(s * z).sum(), (s * z * z).sum() + 1.0]])
        step = np.linalg.solve(h, np.array([g.sum() + 0.1 * (a + 2), (g * z).sum() + 1.0 * (b - 1)]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    model.a, model.b = a, b
    return model


def _scorer(model: Model, at: int, name: str):
    def run(batches):
        m, memo = Machine(model.words, model.beginnings), {}
        for batch in batches:
            z = np.array([model.total(hits(t or "", m.match, memo)) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(model.a + model.b * z, -30, 30))))], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, 0 to 1, higher for label 1 likelier; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = docs.schema
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), name), type(schema)([*schema.fields]).add(name, "double"))
