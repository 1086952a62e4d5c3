"""Conversations: building them from records, and checking them, as expressions over arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip, tokens

MESSAGES = "array<struct<role:string,content:string>>"


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def _first(df: DataFrame, *names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_field(df, n), F.lit("")) for n in names])


def chatml(df: DataFrame) -> Column:
    """messages for a flat record; an existing list of messages is kept as it is."""
    if "messages" in df.columns and isinstance(df.schema["messages"].dataType, T.ArrayType):
        return F.col("messages")
    turn = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    asked = F.coalesce(_first(df, "instruction", "prompt", "question"), F.lit(""))
    given = _first(df, "input")
    user = F.when(given.isNotNull(), strip(F.concat(asked, F.lit("\n"), given))).otherwise(asked)
    user = F.when(user != "", strip(user))
    # of falsy answers the last field's own value counts: an empty `answer` is a turn, an empty `output` isn't
    reply = F.coalesce(_first(df, "output", "response", "completion"), _field(df, "answer"))
    turns = F.array_compact(F.array(turn("system", _first(df, "system")), turn("user", user), turn("assistant", reply)))
    alone = F.array_compact(F.array(turn("user", _first(df, "text"))))
    return F.when(F.size(turns) > 0, turns).otherwise(alone).cast(MESSAGES)


def instruct(df: DataFrame) -> Column:
    some = lambda *n: F.coalesce(_first(df, *n), F.lit(""))
    return F.struct(some("instruction", "prompt", "question").alias("instruction"), some("input").alias("input"), some("output", "response", "completion", "answer").alias("output"))


def chat_reason(messages: Column, roles=("system", "user", "assistant"), lenient: bool = False, max_tokens: int | None = None) -> Column:
    """The first thing that is wrong with a conversation, or null."""
    allowed = [r.strip().lower() for r in roles]
    role = lambda m: F.lower(m["role"])
    per = F.transform(
        messages,
        lambda m: F.when(m.isNull() | m["role"].isNull() | m["content"].isNull(), "bad_message_schema")
        .when(~role(m).isin(allowed), "unknown_role")
        .when(strip(m["content"]) == "", "empty_content"),
    )
    rs = F.transform(messages, role)
    systems = F.filter(rs, lambda r: r == "system")
    core = F.filter(rs, lambda r: r.isin("user", "assistant"))
    checks = [
        (messages.isNull(), "missing_messages"),
        (F.size(messages) == 0, "empty_conversation"),
        (F.exists(per, lambda x: x.isNotNull()), F.element_at(F.array_compact(per), 1)),
        (F.size(systems) > 1, "multiple_system"),
        ((F.size(systems) == 1) & (F.element_at(rs, 1) != "system"), "system_not_first"),
        (~F.array_contains(rs, "assistant"), "no_assistant_reply"),
    ]
    if max_tokens is not None:
        total = F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(tokens(m["content"])))
        checks.append((total > max_tokens, "too_many_tokens"))
    if not lenient:
        pairs = F.arrays_zip(F.slice(core, 1, F.greatest(F.size(core) - 1, F.lit(0))).alias("x"), F.slice(core, 2, F.greatest(F.size(core) - 1, F.lit(0))).alias("y"))
        checks += [
            (F.element_at(core, 1) != "user", "first_not_user"),
            (F.exists(pairs, lambda p: p["x"] == p["y"]), "roles_not_alternating"),
            (F.element_at(rs, -1) != "assistant", "last_not_assistant"),
        ]
    out = F.lit(None).cast("string")
    for when, what in reversed(checks):
        out = F.when(when, what).otherwise(out)
    return out


def record_reason(df: DataFrame, roles=("system", "user", "assistant"), lenient: bool = False, max_tokens: int | None = None) -> Column:
    """chat_reason of a record's field `messages`, whatever its type: what isn't a list of role and content strings can't hold."""
    if "messages" not in df.columns:
        return F.lit("missing_messages")
    m, kind = F.col("messages"), df.schema["messages"].dataType
    if not isinstance(kind, T.ArrayType):
        return F.when(m.isNull(), "missing_messages").otherwise("messages_not_a_list")
    item = kind.elementType
    got = {f.name: f.dataType for f in item.fields} if isinstance(item, T.StructType) else {}
    if not all(isinstance(got.get(x), T.StringType) for x in ("role", "content")):
        return F.when(m.isNull(), "missing_messages").when(F.size(m) == 0, "empty_conversation").otherwise("bad_message_schema")
    return chat_reason(m, roles, lenient, max_tokens)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its messages in the order of turns."""
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
