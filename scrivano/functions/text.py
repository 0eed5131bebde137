"""Text operators as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profile import EMPTY_MARKS, LATIN_CHARS, TIBETAN, WS, ScriptProfile

MARKS = "\\u0F71-\\u0F84\\u0F86\\u0F87\\u0F8D-\\u0FBC\\u0F35\\u0F37\\u0F39\\u0FBE-\\u0FCF"
BRACKETS = "[()\\uFF08\\uFF09\\u0F3C\\u0F3D]"
ORNAMENTS = "[\\u0F01-\\u0F0A\\u0F12\\u0F13\\u0FD0-\\u0FDA]"
FOREIGN_PUNCT = "[\\p{P}\\p{S}&&[^\\u0F00-\\u0FFF\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]]"


def sub(x: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(x, pattern, to)


def strip(x: Column) -> Column:
    return sub(x, f"^{WS}+|{WS}+\\z")


def null_marker(x: Column) -> Column:
    """Null for texts that only mark emptiness."""
    return F.when(F.lower(strip(x.cast("string"))).isin(*EMPTY_MARKS), None).otherwise(x.cast("string"))


def normalize(x: Column, p: ScriptProfile = TIBETAN, nfc=None) -> Column:
    """White space and separators in one form; null if nothing is left. nfc: a column function for composition, where texts
    may not be composed. Letters that annotators interchange take the reviewers' form."""
    x = nfc(x) if nfc else x
    if p is TIBETAN:
        x = F.translate(x, "༸྅", "༧༣")
    x = F.trim(sub(x, f" {WS}+|[{WS}&&[^ ]]{WS}*", " "))  # single blanks are left as they are; from here on there is no other white space
    x = sub(x, f" ([{p.terminators}])", "$1")
    if p is TIBETAN:
        x = sub(x, f"([{p.separators}]){WS}+", "$1")
        x = sub(x, f"(?<=[{p.letters}]){WS}+(?=[{p.letters}])", "་")
        x = sub(x, f"[{p.separators}]{{2,}}", "་")
        x = sub(x, f"[{p.separators}]+([{p.terminators}])", "$1")
    return F.nullif(F.trim(x), F.lit(""))


def flatten_layout(x: Column) -> Column:
    return sub(x, "\\r\\n?|\\n")


def segments(x: Column, p: ScriptProfile = TIBETAN, min_chars: int = 1) -> Column:
    """Sentences, each with its terminator. The text is normalized before it is cut: no rule reaches over a terminator."""
    found = F.regexp_extract_all(F.coalesce(normalize(flatten_layout(x), p), F.lit("")), F.lit(f"[^{p.terminators}]+[{p.terminators}]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: (F.length(s) >= min_chars) & ~s.rlike(f"^[{p.terminators}]?\\z"))


def segments_tight(x: Column, p: ScriptProfile = TIBETAN, min_chars: int = 8) -> Column:
    """The older segmenter: all white space removed, short sentences dropped."""
    bare = sub(F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit("")), f"{WS}+")
    found = F.regexp_extract_all(bare, F.lit(f"[^{p.terminators}]+[{p.terminators}]?"), F.lit(0))
    return F.filter(found, lambda s: F.length(s) >= min_chars)


def sentences(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    """Sentences without their terminators."""
    return F.filter(F.transform(F.split(x, f"[{p.terminators}]", -1), strip), lambda s: s != "")


def syllables(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    return F.filter(F.split(strip(x), f"[{p.separators}]", -1), lambda s: s != "")


def syllables_all(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    """Split at separators and terminators; empty ones stay."""
    return F.split(x, f"[{p.separators}{p.terminators}]", -1)


def metric_syllables(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    return F.filter(F.split(x if p.separators == " " else F.replace(x, F.lit(" "), F.lit("")), f"[{p.separators}]", -1), lambda s: s != "")


def strip_separators(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    return sub(x, f"[{p.separators}]")


def strip_punct(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    extra = p.punctuation if p is not TIBETAN else ""
    return sub(x, f"[{p.terminators}{p.separators}{extra}]|{WS}")


def collapse_space(x: Column) -> Column:
    return strip(sub(x, f"{WS}+", " "))


def strip_leading_debris(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    """What a cut inside a syllable or before punctuation leaves at the beginning."""
    return sub(x, f"^(?:[{MARKS}{p.terminators}{p.separators}]|{WS})+")


def strip_brackets(x: Column) -> Column:
    return sub(x, BRACKETS)


def strip_ornaments(x: Column) -> Column:
    return sub(x, ORNAMENTS)


def strip_latin(x: Column) -> Column:
    return sub(x, f"[{LATIN_CHARS}]+")


def has_brackets(x: Column) -> Column:
    return x.rlike(BRACKETS)


def has_ornaments(x: Column) -> Column:
    return x.rlike(ORNAMENTS)


def has_latin(x: Column) -> Column:
    return x.rlike(f"[{LATIN_CHARS}]")


def has_leading_digits(x: Column) -> Column:
    return x.rlike("^[0-9]")


def latin_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"[{LATIN_CHARS}]+"), F.lit(0))


def foreign_punct(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(FOREIGN_PUNCT), F.lit(0))


def has_foreign_punct(x: Column) -> Column:
    return x.rlike(FOREIGN_PUNCT)


def paren_unmatched(x: Column) -> Column:
    marks = F.split(sub(x, "[^()]"), "")
    state = F.aggregate(marks, F.struct(F.lit(0).alias("open"), F.lit(False).alias("bad")), lambda s, c: F.struct((s["open"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("open"), (s["bad"] | ((s["open"] == 0) & (c == ")"))).alias("bad")))
    return state["bad"] | (state["open"] != 0)


def balanced_parens(x: Column) -> Column:
    return F.contains(x, F.lit("(")) & ~paren_unmatched(x)


def clean_page(x: Column) -> Column:
    """A page without bracket characters, with what it had."""
    return F.struct(strip_brackets(x).alias("text"), has_brackets(x).alias("had_brackets"), balanced_parens(x).alias("had_balanced"), paren_unmatched(x).alias("had_unmatched"), has_latin(x).alias("had_latin"))


def openings_match(a: Column, b: Column, n: int = 4) -> Column:
    same = (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a) | same)


def _pair(s: Column, t: Column, changed: Column) -> Column:
    return F.struct(s.alias("source"), t.alias("target"), changed.alias("changed"))


def _strip_one_side(s: Column, t: Column, pattern: str, same) -> Column:
    def cut(x):
        return F.regexp_extract(x, pattern, 0), sub(x, pattern)

    (ps, rs), (pt, rt) = cut(s), cut(t)
    aligned = openings_match(s, t)

    def ok(prefix, rest, other_prefix, other_rest, other):
        both = (other_prefix != "") & (other_rest != "") & same(prefix, other_prefix)
        return (prefix != "") & (rest != "") & ~both & ~aligned & openings_match(rest, other)

    return F.when(ok(ps, rs, pt, rt, t), _pair(rs, t, F.lit(True))).when(ok(pt, rt, ps, rs, s), _pair(s, rt, F.lit(True))).otherwise(_pair(s, t, F.lit(False)))


def strip_leading_syllable(s: Column, t: Column, p: ScriptProfile = TIBETAN) -> Column:
    """One side's short first syllable with its terminator goes if the sides then begin alike; the source is tried first."""
    pattern = f"^[{p.letters}{p.separators}]{{1,6}}[{p.terminators}](?:[{p.separators}]|{WS})*"
    return _strip_one_side(s, t, pattern, lambda a, b: sub(a, f"{WS}+\\z") == sub(b, f"{WS}+\\z"))


def strip_leading_marks(s: Column, t: Column, rounds: int = 4) -> Column:
    """The same for leading section marks, up to four times."""
    def one(o: Column) -> Column:
        r = _strip_one_side(o["source"], o["target"], "^[\\u0F34\\u0F14]+[\\u0F0B\\u0F0C \\t]*", lambda a, b: a == b)
        return F.transform(F.array(r), lambda x: _pair(x["source"], x["target"], o["changed"] | x["changed"]))[0]

    out = _pair(s, t, F.lit(False))
    for _ in range(rounds):
        out = F.transform(F.array(out), one)[0]  # bound, so that the expression grows by a round and not by a power
    return out


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def differences(s: Column, t: Column) -> Column:
    """s and t where they differ, and distance, the Levenshtein distance in code points."""
    from .udfs import parted

    m = parted(s, t)
    return F.struct(m["s"].alias("s"), m["t"].alias("t"), F.coalesce(m["far"], F.levenshtein(m["s"], m["t"])).alias("distance"))


def edit_distance(s: Column, t: Column) -> Column:
    """Levenshtein distance in code points."""
    return differences(s, t)["distance"]


def classify(s: Column, t: Column, p: ScriptProfile = TIBETAN, known: Column | None = None) -> Column:
    """The class of an edit, first match wins; known: their differences, where they are."""
    known = differences(s, t) if known is None else known
    m = F.greatest(F.length(s), F.length(t), F.lit(1))

    def of(x):
        d = x["distance"]
        return (
            F.when(strip_punct(x["s"], p) == strip_punct(x["t"], p), "punctuation_only")
            .when((d == 1) & (F.length(s) == F.length(t)), "single_char_substitution")
            .when(d == 1, "single_char_insert_delete")
            .when((d > 5) | (d / m.cast("double") > 0.30), "large_rewrite")
            .when(s.rlike(f"[{p.separators}]") | t.rlike(f"[{p.separators}]"), "syllable_level")
            .otherwise("multi_edit")
        )

    return _bound(known, of)


CATEGORIES = ("punctuation_only", "whitespace_only", "single_char_substitution", "single_char_insert_delete", "syllable_level", "multi_edit", "large_rewrite")


def punctuation_subtype(s: Column, t: Column, p: ScriptProfile = TIBETAN) -> Column:
    """Of a pair that differs in punctuation only: final marks, separators inside, or other."""
    tail = f"(?:[{p.terminators}]|{WS})+\\z"

    def signature(x):
        letters = F.regexp_extract_all(x, F.lit(f"(?:[{p.terminators}{p.separators}]|{WS})*[^{p.terminators}{p.separators}\\s]"), F.lit(0))
        return F.struct(F.transform(letters, lambda y: y.rlike(f"[{p.separators}]")), F.length(x) - F.length(strip_separators(x, p)))

    return (
        F.when((sub(s, tail) == sub(t, tail)) & (s != t), "terminal_shad_only")
        .when((strip_separators(s, p) == strip_separators(t, p)) & (s != t), "tsheg_within")
        .when(signature(s) != signature(t), "tsheg_within")
        .otherwise("other_punct")
    )


def agreed_separator_removal(agree: Column, s: Column, t: Column, p: ScriptProfile = TIBETAN) -> Column:
    a, b = strip_separators(s, p), strip_separators(t, p)
    return agree & (s != t) & (a == b) & (F.length(s) - F.length(a) > F.length(t) - F.length(b))


def pair_key(s: Column, t: Column) -> Column:
    return F.md5(F.concat(s, F.lit("\0"), t))


def is_script(x: Column) -> Column:
    return x.rlike(f"^(?:[\\u0F00-\\u0FFF]|{WS})*\\z")


def bucket(d: Column) -> Column:
    """Edit distances in readable classes."""
    return F.when(d <= 0, "0").when(d <= 2, d.cast("string")).when(d <= 5, "3-5").when(d <= 10, "6-10").when(d <= 20, "11-20").otherwise("21+")


def cer(prediction: Column, target: Column) -> Column:
    return edit_distance(prediction, target) / F.nullif(F.length(target), F.lit(0)).cast("double")


def clusters(x: Column) -> Column:
    """Grapheme clusters."""
    return F.regexp_extract_all(x, F.lit("(\\X)"), F.lit(1))


def collapse_repeats(x: Column, p: ScriptProfile = TIBETAN) -> Column:
    """Three or more equal syllables, then characters, in a row become one."""
    x = sub(x, f"([^{p.separators}{p.terminators}\\s]+[{p.separators}])\\1{{2,}}", "$1")
    return sub(x, "(.)\\1{2,}", "$1")


def printable(x: Column) -> Column:
    return F.when(x == "", "∅").when(x == " ", "␠").when(x == "\n", "␊").otherwise(x)


def last_verdict(x: Column) -> Column:
    """The last YES or NO of an answer."""
    return F.try_element_at(F.regexp_extract_all(F.upper(x), F.lit("\\b(YES|NO)\\b"), F.lit(1)), F.lit(-1))


def numbered_verdicts(x: Column) -> Column:
    """number -> YES or NO of an answer with a line for each."""
    lines = F.regexp_extract_all(F.upper(x), F.lit("(?m)^\\s*(\\d+)\\s*[.):\\-]?\\s*(?:YES|NO)\\b"), F.lit(0))
    return F.map_from_entries(F.transform(lines, lambda y: F.struct(F.regexp_extract(y, "\\d+", 0).cast("int"), F.regexp_extract(y, "YES|NO", 0))))


def is_real(category: Column) -> Column:
    return F.startswith(category, F.lit("real")) | category.isin("syllable_level", "single_char_substitution", "single_char_insert_delete")
