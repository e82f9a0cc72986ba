"""Chat formatting with DataFrame functions only.

A declarative template says how each role's turn is marked and whether its text is learned; a
finite-state machine over roles checks the turn order.  Control strings inside texts are escaped so
that a formatted conversation splits back into exactly its turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    prefix: str
    suffix: str
    loss: bool = False


def _roles() -> dict[str, Turn]:
    return {
        "system": Turn("<<SYS>> ", " <</SYS>>\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>\n", True),
    }


def _order() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"},
    }


@dataclass(frozen=True)
class Template:
    """Marks for each role, for any other role, and the allowed turn order.

    Prefixes and suffixes are control strings, each set off from the text by white space; a control
    string begins with ``<`` or ``[`` and holds no white space, so no text can complete one across
    a mark.
    """

    roles: dict[str, Turn] = field(default_factory=_roles)
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]\n")
    order: dict[str, dict[str, str]] = field(default_factory=_order)
    accepting: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        marks = [m for t in self.roles.values() for m in (t.prefix, t.suffix)] + list(self.other)
        return list(dict.fromkeys(m.strip() for m in marks))


def escape(text: Column, template: Template) -> Column:
    """Double every backslash, then put one after the first character of each control string."""
    tails = "|".join(re.escape(c[1:]) for c in template.controls())
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={tails})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _case(role: Column, template: Template, value, otherwise) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = F.when(role == name, value(turn)) if out is None else out.when(role == name, value(turn))
    return out.otherwise(otherwise)


def _walk(roles: Column, template: Template) -> Column:
    """(state, turns read, index of the first turn out of order or -1) after an array of roles."""
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc, role):
        state = acc["state"]
        after = F.lit("out of order")
        for name, moves in template.order.items():
            for r, to in moves.items():
                after = F.when((state == name) & (role == r), F.lit(to)).otherwise(after)
        wrong = (after == "out of order") & (acc["bad"] < 0)
        return F.struct(after.alias("state"), (acc["at"] + 1).alias("at"), F.when(wrong, acc["at"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(roles, start, step)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text).

    conv_id; n_turns; valid, bad_turn (place of the first turn out of order, -1 if none);
    segments: array of (text, loss) whose texts, joined, are ``formatted``.
    Turns are ordered by turn, then role, then text, so ties and repeated rows have a fixed place;
    null text and null role are empty; rows without conv_id form one conversation.  Invalid
    conversations are formatted all the same.  A conversation is one sequence and one value, so its
    turns meet in one row; other columns are ignored.
    """
    template = template or Template()
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    before, between, after = template.other

    def marked(t: Column) -> Column:
        role = t["role"]
        other = F.concat(F.lit(before), escape(role, template), F.lit(between))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(_case(role, template, lambda x: F.lit(x.prefix), other), F.lit(False)),
            part(escape(t["text"], template), _case(role, template, lambda x: F.lit(x.loss), F.lit(False))),
            part(_case(role, template, lambda x: F.lit(x.suffix), F.lit(after)), F.lit(False)),
        )

    walked = turns.withColumn("_w", _walk(F.transform("turns", lambda t: t["role"]), template))
    made = walked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        ((F.col("_w.bad") < 0) & F.col("_w.state").isin(*template.accepting)).alias("valid"), F.col("_w.bad").alias("bad_turn"),
        F.flatten(F.transform("turns", marked)).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    template = template or Template()
    before, between, after = template.other
    ends = "|".join(re.escape(x) for x in [*[t.suffix for t in template.roles.values()], after])
    starts = "|".join(re.escape(x) for x in [*[t.prefix for t in template.roles.values()], before])
    chunks = F.regexp_extract_all(formatted, F.lit(rf"(?s)(?:{starts}).*?(?:{ends})"), F.lit(0))

    def one(c: Column) -> Column:
        named = None
        for name, turn in template.roles.items():
            inner = F.substring(c, F.lit(len(turn.prefix) + 1), F.length(c) - len(turn.prefix) - len(turn.suffix))
            pair = F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))
            hit = F.startswith(c, F.lit(turn.prefix))
            named = F.when(hit, pair) if named is None else named.when(hit, pair)
        cut = F.position(F.lit(between), c)
        role = F.substring(c, F.lit(len(before) + 1), cut - len(before) - 1)
        text = F.substring(c, cut + len(between), F.length(c) - cut - len(between) - len(after) + 1)
        return named.otherwise(F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(chunks, one)


def digest(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Format, read back, and summarise: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, bad_turn."""
    made = format_conversations(rows, template)
    back = made.withColumn("_turns", read_turns(F.col("formatted"), template)).withColumn(
        "_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    )
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )
