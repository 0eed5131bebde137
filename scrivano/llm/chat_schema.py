"""Chat formatting from heterogeneous layouts, chosen by schema fingerprint; DataFrame functions only.

A record's fingerprint is a hash of the nested field paths it has, out of those that any layout names; it selects a
declarative mapping to canonical turns. JSON payloads are matched with variant expressions. Tables with a row for each turn may
mix layouts too: a row has the paths that its table has and that are not null in it, and the fingerprints of a layout are the
hashes of the sets of its paths, as any field may be null. Fields that no layout names do not change a fingerprint.

Template, for each turn: "### " role ": " text "</turn>" newline. In roles and texts a backslash is written as \\b, < as \\l
and # as \\h, in roles also : as \\c, so no control string can occur inside and the writing is undone exactly.
The loss mask is run-length coded: three runs (characters, loss) a turn, of head, text and end.

Nulls, ties, repeats: null roles and texts are empty; null conversation ids form one conversation; turns of equal number are
ordered by role, then text; a null turn number comes first; repeated rows are turns each; a payload that is not JSON or
matches no layout gives null turns and layout "unknown", a row of nulls has the first layout of its table; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the fields that identify the layout. turns: SQL over the variant v that gives an array of (role, text)."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _pairs(path: str, role: str, text: str) -> str:
    return f"transform(variant_get(v, '$.{path}', 'array<struct<`{role}`:string,`{text}`:string>>'), m -> named_struct('role', m.`{role}`, 'text', m.`{text}`))"


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', variant_get(v, '$.{path}', 'string'))"


LAYOUTS = (
    Layout("messages", ("messages",), _pairs("messages", "role", "content")),
    Layout("share", ("conversations",), _pairs("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("prompt_completion", ("completion", "prompt"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Layout("question_answer", ("answer", "question"), f"array({_turn('user', 'question')}, {_turn('assistant', 'answer')})"),
    Layout("instruction", ("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Layout("instruction_input", ("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', concat_ws('\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), ''))), " + _turn("assistant", "output") + ")"),
    Layout("system_messages", ("messages", "system"), f"concat(array({_turn('system', 'system')}), {_pairs('messages', 'role', 'content')})"),
    Layout("nested_data", ("data.messages",), _pairs("data.messages", "role", "content")),
)
#: Tables with a row for each turn: the paths of conversation, order, role and text.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "speaker", "content"), ("thread.id", "thread.index", "message.role", "message.content"))
_KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, [] for array elements."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema:
            p = f"{at}.{f.name}".lstrip(".")
            out += [p, *field_paths(f.dataType, p)]
        return out
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return []


def fingerprint(paths: list[Column]) -> Column:
    """Hash of the paths, in order, that are not null."""
    return F.xxhash64(F.concat_ws("|", *paths))


def json_fingerprint(v: Column) -> Column:
    """Hash of the known paths that the variant v has."""
    return fingerprint([F.when(F.try_variant_get(v, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in _KNOWN])


def canonical_turns(records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """records with layout and turns, an array of (role, text)."""
    t = records.withColumn("v", F.try_parse_json(payload_col)).withColumn("fingerprint", json_fingerprint(F.col("v")))
    turns, name = F.lit(None).cast(TURNS), F.lit("unknown")
    for x in LAYOUTS:
        hit = F.col("fingerprint") == fingerprint([F.lit(p) for p in sorted(x.paths)])
        turns, name = F.when(hit, F.expr(x.turns).cast(TURNS)).otherwise(turns), F.when(hit, F.lit(x.name)).otherwise(name)
    return t.withColumn("turns", turns).withColumn("layout", name).drop("v", "fingerprint")


def canonical_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn, each row by the mapping that its fingerprint selects."""
    have = set(field_paths(df.schema))
    layouts = [x for x in ROW_LAYOUTS if set(x) <= have]
    if not layouts:
        raise ValueError(f"no layout has all its fields in {sorted(have)}")
    known = sorted({p for x in layouts for p in x})
    t = df.withColumn("print__", fingerprint([F.when(F.col(p).isNotNull(), F.lit(p)) for p in known]))
    of: dict[tuple[str, ...], int] = {}
    for k, x in enumerate(layouts):
        for n in range(len(x) + 1):
            for some in combinations(sorted(x), n):
                of.setdefault(some, k)
    table = F.create_map(*[y for some, k in of.items() for y in (fingerprint([F.lit(p) for p in some]), F.lit(k))])
    t = t.withColumn("layout__", F.element_at(table, F.col("print__")))

    def mapped(field: int, kind: str) -> Column:
        return F.coalesce(*[F.when(F.col("layout__") == k, F.col(x[field]).cast(kind)) for k, x in enumerate(layouts)])

    return t.select(mapped(0, "long").alias("conv_id"), mapped(1, "long").alias("turn"), mapped(2, "string").alias("role"), mapped(3, "string").alias("text"))


def escape(x: Column) -> Column:
    x = F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(x: Column) -> Column:
    # after writing, a backslash only leads a code; the backslash itself is restored last
    return F.replace(F.replace(F.replace(F.replace(x, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))


def _run(chars: Column, loss: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))


def _runs(role: Column, text: Column) -> Column:
    yes = F.coalesce(role == "assistant", F.lit(False))
    return F.array(_run(F.length(_head(role)), F.lit(False)), _run(F.length(escape(text)), yes), _run(F.lit(len(END)), F.lit(False)))


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """df with formatted and mask, from an array of (role, text)."""
    whole = F.array_join(F.transform(turns_col, lambda t: F.concat(_head(t["role"]), escape(t["text"]), F.lit(END))), "")
    return df.withColumn("formatted", whole).withColumn("mask", F.flatten(F.transform(turns_col, lambda t: _runs(t["role"], t["text"]))))


def format_rows(rows: DataFrame, block: int = 64) -> DataFrame:
    """conv_id, formatted, mask of a table with a row for each turn.

    Turns are first joined in blocks of `block` turn numbers, so that a long conversation is written by many tasks and
    only its finished blocks meet.
    """
    t = canonical_rows(rows)
    t = t.select("conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    t = format_turns(t).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "mask"))).alias("b"))
    return t.select("conv_id", F.array_join(F.col("b.formatted"), "").alias("formatted"), F.flatten("b.mask").alias("mask"))


def parse(df: DataFrame) -> DataFrame:
    """df (formatted, mask) with turns read back, an array of (role, text, loss_text); loss_text is what the mask covers."""
    pieces = F.filter(F.split("formatted", END, -1), lambda x, i: i < F.size(F.split("formatted", END, -1)) - 1)
    t = df.withColumn("pieces", F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(pieces))

    def read(p: Column, i: Column) -> Column:
        head = F.element_at("mask", 3 * i + 1)["chars"]
        run = F.element_at("mask", 3 * i + 2)
        role = F.substring_index(p, ": ", 1)
        return F.struct(unescape(F.substr(role, F.lit(5))).alias("role"), unescape(F.substr(p, F.length(role) + 3)).alias("text"), F.when(run["loss"], unescape(F.substr(p, head + 1, run["chars"]))).alias("loss_text"))

    return t.withColumn("turns", F.transform("pieces", read)).drop("pieces")


def digest(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.col("turns.loss_text"), "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 14 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""
