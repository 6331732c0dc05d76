"""Chat formatting, with DataFrame functions only.

A table's layout is recognised by a fingerprint: the hash of its nested field
paths, as far as any mapping knows them.  The fingerprint selects a declarative
mapping, which brings prompt/completion pairs, instructions, message lists or
rows by turn into one row per conversation with canonical turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """All nested field paths: ``messages[].role``; names in lower case."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: its paths, the id, and an array of (role, text); ``by_turn`` has one row per turn instead."""

    name: str
    paths: tuple[str, ...]
    key: str
    turns: Callable[[], Column] | None = None
    by_turn: tuple[str, str, str] | None = None


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(column: str, role: str, text: str, roles: dict[str, str] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        named = lambda x: F.coalesce(F.create_map(*[F.lit(y) for p in roles.items() for y in p])[x[role]], x[role]) if roles else x[role]
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x: _turn(named(x), x[text]))

    return build


def _pair(question: Callable[[], Column], answer: str) -> Callable[[], Column]:
    return lambda: F.array(_turn("user", question()), _turn("assistant", F.col(answer)))


def _asked() -> Column:
    extra = F.coalesce(F.col("input"), F.lit(""))
    return F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))


MAPPINGS = (
    Mapping("rows_by_turn", ("conv_id", "turn", "role", "text"), "conv_id", by_turn=("turn", "role", "text")),
    Mapping("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id", _messages("messages", "role", "content")),
    Mapping("from_value", ("conv_id", "conversations[].from", "conversations[].value"), "conv_id", _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("instruction", ("conv_id", "instruction", "input", "output"), "conv_id", _pair(_asked, "output")),
    Mapping("bare_instruction", ("conv_id", "instruction", "output"), "conv_id", _pair(lambda: F.col("instruction"), "output")),
    Mapping("prompt", ("conv_id", "prompt", "completion"), "conv_id", _pair(lambda: F.col("prompt"), "completion")),
    Mapping("prompt_response", ("conv_id", "prompt", "response"), "conv_id", _pair(lambda: F.col("prompt"), "response")),
)
BY_FINGERPRINT = {fingerprint_of(set(m.paths)): m for m in MAPPINGS}
_KNOWN = {p for m in MAPPINGS for p in m.paths}


def select_mapping(schema: T.StructType) -> Mapping:
    """The mapping whose fingerprint the table has; paths that no mapping knows don't count.

    Where known paths of several layouts clash, the layout with most paths that the table has in full is taken.
    """
    paths = set(field_paths(schema)) & _KNOWN
    if found := BY_FINGERPRINT.get(fingerprint_of(paths)):
        return found
    fitting = [m for m in MAPPINGS if paths >= set(m.paths)]
    if not fitting:
        raise ValueError(f"no mapping for the field paths {sorted(field_paths(schema))}")
    return max(fitting, key=lambda m: len(m.paths))


def _doubled(x: Column) -> Column:
    """Control strings start with ``<|``; ``<``, any ``^``, ``|`` gets one more ``^``, so none is left, and it can be undone."""
    return F.regexp_replace(x, r"<(\^*)\|", r"<^$1|")


def _undone(x: Column) -> Column:
    return F.regexp_replace(x, r"<\^(\^*)\|", r"<$1|")


def _formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), _doubled(role), F.lit(TEXT), _doubled(text), F.lit(END))


def format_chats(df: DataFrame, chunk: int = 64) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``.

    Turns of a conversation are put together in chunks of ``chunk`` turn
    numbers first, so that a conversation of very many turns is formatted by
    many tasks, and only its finished chunks meet in one row.  Null roles and
    texts are empty; a null turn comes first; equal turn numbers follow by
    role, then text; repeated rows are kept; a null conv_id is a conversation
    of its own.  An empty table gives an empty result.
    """
    m = select_mapping(df.schema)
    if m.by_turn is None:
        whole = F.array_join(F.transform(m.turns(), lambda x: _formatted(x["role"], x["text"])), "")
        return df.select(F.col(m.key).alias("conv_id"), whole.alias("formatted"))
    turn, role, text = (F.col(c) for c in m.by_turn)
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    rows = df.select(F.col(m.key).alias("conv_id"), turn.alias("turn"), F.floor(turn / F.lit(chunk)).alias("chunk"), role.alias("role"), text.alias("text"))
    one = F.struct("turn", "role", "text")
    parts = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    parts = parts.select("conv_id", "chunk", F.array_join(F.transform("turns", lambda x: _formatted(x["role"], x["text"])), "").alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text, in_loss)."""

    def one(piece: Column) -> Column:
        body = F.split(F.substr(piece, F.lit(len(TURN) + 1)), F.lit(r"<\|text\|>"), F.lit(2))
        role = _undone(body[0])
        return F.struct(role.alias("role"), _undone(body[1]).alias("text"), (role == "assistant").alias("in_loss"))

    pieces = F.filter(F.split(formatted, F.lit(r"<\|end\|>\n"), F.lit(-1)), lambda x: x != "")
    return F.transform(pieces, one)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from ``conv_id``, ``formatted``."""
    df = formatted.withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["in_loss"]), lambda x: x["text"]), "")
    df = df.withColumns({"_said": said, "_loss": loss})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha("_said").alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        sha("_loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), joined AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(24 + length(regexp_replace(role, '<(\^*)\|', '<^\1|', 'g')) + length(regexp_replace(text, '<(\^*)\|', '<^\1|', 'g'))) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""
