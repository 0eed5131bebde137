"""Synthetic errors: transforms of a syllable array, drawn from a hash of (seed, id), so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters as L
from .text import clusters


def draw(seed: int, row: Column, what: str, n: Column) -> Column:
    """A place in 0..n-1."""
    return F.pmod(F.xxhash64(F.lit(seed), row, F.lit(what)), F.greatest(n, F.lit(1)).cast("long")).cast("int")


def _put(a: Column, at: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def _cut(x: Column, at: Column, new: Column, gone: int = 1) -> Column:
    """x with gone characters at place at replaced."""
    return F.concat(F.left(x, at), new, F.substr(x, at + 1 + gone))


def _char(x: Column, at: Column) -> Column:
    return F.substr(x, at + 1, F.lit(1))


def char_delete(a: Column, seed: int, row: Column) -> Column:
    k = draw(seed, row, "syllable", F.size(a))
    s = F.get(a, k)
    return F.when(F.length(s) > 0, _put(a, k, _cut(s, draw(seed, row, "char", F.length(s)), F.lit("")))).otherwise(a)


def char_insert(a: Column, seed: int, row: Column, chars: str = L.INSERTABLE) -> Column:
    k = draw(seed, row, "syllable", F.size(a))
    s = F.get(a, k)
    new = _char(F.lit(chars), draw(seed, row, "new", F.lit(len(chars))))
    return F.when(F.size(a) > 0, _put(a, k, _cut(s, draw(seed, row, "char", F.length(s) + 1), new, 0))).otherwise(a)


def tall_short(a: Column, seed: int, row: Column) -> Column:
    k = draw(seed, row, "syllable", F.size(a))
    s = F.get(a, k)
    at = draw(seed, row, "char", F.length(s))
    flipped = F.translate(_char(s, at), L.TALLS + L.SHORTS, L.SHORTS + L.TALLS)
    return F.when(F.length(s) > 0, _put(a, k, _cut(s, at, flipped))).otherwise(a)


def confusion(a: Column, seed: int, row: Column, table: dict[str, str] = L.CONFUSIONS) -> Column:
    """A letter becomes one that looks like it."""
    keys = "[" + "".join(table) + "]"
    places = F.flatten(F.transform(a, lambda s, i: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda j: F.substr(s, j, F.lit(1)).rlike(keys)), lambda j: F.struct(i.alias("i"), (j - 1).alias("j")))))
    p = F.get(places, draw(seed, row, "place", F.size(places)))
    s = F.get(a, p["i"])
    likes = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _char(s, p["j"]))
    new = _char(likes, draw(seed, row, "new", F.length(likes)))
    return F.when(F.size(places) > 0, _put(a, p["i"], _cut(s, p["j"], new))).otherwise(a)


def _swap(a: Column, i: Column, j: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))


def inner_exchange(a: Column, seed: int, row: Column) -> Column:
    """Two characters of a syllable of three or more."""
    longs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: F.length(F.get(a, i)) > 2)
    k = F.get(longs, draw(seed, row, "syllable", F.size(longs)))
    s = F.get(a, k)
    i = draw(seed, row, "one", F.length(s))
    j = F.pmod(i + 1 + draw(seed, row, "two", F.length(s) - 1), F.length(s)).cast("int")
    return F.when(F.size(longs) > 0, _put(a, k, F.array_join(_swap(F.split(s, ""), i, j), ""))).otherwise(a)


def near_exchange(a: Column, seed: int, row: Column) -> Column:
    """A character each of two neighbours."""
    k = draw(seed, row, "syllable", F.size(a) - 1)
    s, t = F.get(a, k), F.get(a, k + 1)
    i, j = draw(seed, row, "one", F.length(s)), draw(seed, row, "two", F.length(t))
    new = F.transform(a, lambda x, n: F.when(n == k, _cut(s, i, _char(t, j))).when(n == k + 1, _cut(t, j, _char(s, i))).otherwise(x))
    return F.when((F.size(a) >= 2) & (F.length(s) > 0) & (F.length(t) > 0), new).otherwise(a)


def syllable_delete(a: Column, seed: int, row: Column) -> Column:
    k = draw(seed, row, "syllable", F.size(a))
    return F.when(F.size(a) > 1, F.filter(a, lambda _, i: i != k)).otherwise(a)


def syllable_exchange(a: Column, seed: int, row: Column) -> Column:
    k = draw(seed, row, "syllable", F.size(a) - 1)
    return F.when(F.size(a) > 1, _swap(a, k, k + 1)).otherwise(a)


def syllable_merge(a: Column, seed: int, row: Column) -> Column:
    k = draw(seed, row, "syllable", F.size(a) - 1)
    merged = F.filter(F.transform(a, lambda x, i: F.when(i == k, F.concat(x, F.get(a, k + 1))).when(i == k + 1, F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return F.when(F.size(a) > 1, merged).otherwise(a)


def masks(a: Column, seed: int, row: Column, width: int = 1) -> Column:
    """The array with [MASK] where syllable_delete (width 1) or syllable_exchange (width 2) acts."""
    k = draw(seed, row, "syllable", F.size(a) - (width - 1))
    return F.when(F.size(a) > 1, F.transform(a, lambda x, i: F.when((i >= k) & (i < k + width), "[MASK]").otherwise(x))).otherwise(a)


def homophone(a: Column, seed: int, row: Column, table: Column) -> Column:
    """A syllable becomes a homophone; table: map of syllable to array of homophones."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: F.coalesce(F.size(F.element_at(table, F.get(a, i))) > 0, F.lit(False)))
    k = F.get(places, draw(seed, row, "syllable", F.size(places)))
    likes = F.element_at(table, F.get(a, k))
    return F.when(F.size(places) > 0, _put(a, k, F.get(likes, draw(seed, row, "new", F.size(likes))))).otherwise(a)


def cluster_delete(a: Column, seed: int, row: Column) -> Column:
    """Safe form of char_delete: a whole cluster of a syllable with several."""
    k = draw(seed, row, "syllable", F.size(a))
    c = clusters(F.get(a, k))
    at = draw(seed, row, "char", F.size(c))
    return F.when(F.size(c) > 1, _put(a, k, F.array_join(F.filter(c, lambda _, i: i != at), ""))).otherwise(a)


def cluster_exchange(a: Column, seed: int, row: Column) -> Column:
    """Safe form of inner_exchange: neighbouring clusters."""
    k = draw(seed, row, "syllable", F.size(a))
    c = clusters(F.get(a, k))
    at = draw(seed, row, "char", F.size(c) - 1)
    return F.when(F.size(c) > 1, _put(a, k, F.array_join(_swap(c, at, at + 1), ""))).otherwise(a)


TYPES = {"char_random_delete": char_delete, "char_random_insert": char_insert, "char_tall_short_replace": tall_short, "char_homomorphic_replace": confusion, "char_inner_syllable_exchange": inner_exchange, "char_near_syllable_exchange": near_exchange, "syllable_random_delete": syllable_delete, "syllable_random_exchange": syllable_exchange, "syllable_random_merge": syllable_merge}


def well_formed(s: Column) -> Column:
    """A syllable that a writer could have written, as far as its letters tell."""
    return s.rlike(f"^(?![{L.VOWELS}{L.SUBSCRIPTS}{L.SHORTS}])[\\u0F00-\\u0FFF]*[{L.ROOTS}][\\u0F00-\\u0FFF]*\\z")


def corrupt(a: Column, seed: int, row: Column, homophones: Column | None = None, verbs: Column | None = None) -> Column:
    """(type, syllables): one of the types, drawn evenly."""
    kinds = dict(TYPES)
    if homophones is not None:
        kinds["syllable_homophone"] = lambda x, s, r: homophone(x, s, r, homophones)
    if verbs is not None:
        kinds["verb_tense_homophone"] = lambda x, s, r: homophone(x, s, r, verbs)
    which = draw(seed, row, "type", F.lit(len(kinds)))
    out = F.lit(None)
    for k, (name, f) in enumerate(kinds.items()):
        out = F.when(which == k, F.struct(F.lit(name).alias("type"), f(a, seed, row).alias("syllables"))).otherwise(out)
    return out
