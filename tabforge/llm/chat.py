"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags.

A template names the marks around a turn, the transitions of a machine over
the roles, and the roles that are trained on.  A conversation becomes segments
(text, loss) whose texts, joined, are the formatted conversation: for each
turn a header, the escaped text and an end mark.  Only the texts of trained
roles carry the loss flag.

Every control string of a template starts with its opener (``<|``).  Inside
texts a backslash is put after the opener's first character, one more than
stands there already, so no text can hold a control string and ``unescaped``
gives back the text exactly.  Roles write ``<`` as ``<l`` and a line break as
``<n``.

Turns are ordered by turn, role and text.  A conversation is one output
record, so its turns meet in one row; nothing is grouped beyond that.

Cases with a defined result: null texts are empty; null roles are written
empty and refused by the machine; rows without a conversation id form one
conversation; repeated rows are turns of their own; null turns come first; a
conversation that the machine refuses is formatted all the same, with
``valid`` false and the place of the first refused turn; empty tables give
empty results; further columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns_of_chat() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    }


@dataclass(frozen=True)
class Template:
    """Marks, role transitions (state -> role -> next state) and trained roles.

    ``accepting`` are the states in which a conversation may end.
    """

    opener: str = "<|"
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    transitions: dict[str, dict[str, str]] = field(default_factory=_turns_of_chat)
    initial: str = "start"
    accepting: tuple[str, ...] = ("user", "assistant")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.opener) < 2 or "\\" in self.opener or self.opener[0] in self.opener[1:]:
            raise ValueError("an opener has at least two characters, no backslash, and its first character once")
        for mark in (self.begin, self.end):
            if not mark.startswith(self.opener) or self.opener in mark[1:]:
                raise ValueError(f"{mark!r} does not start with the opener {self.opener!r}, or holds it twice")
        if self.begin.startswith(self.end) or self.end.startswith(self.begin):
            raise ValueError("one mark is the beginning of the other")
        known = {self.initial, *self.transitions}
        for state, after in self.transitions.items():
            if missing := set(after.values()) - known:
                raise ValueError(f"{state} leads to states without transitions: {sorted(missing)}")

    @property
    def tail(self) -> str:
        return self.end + "\n"


CHATML = Template()


def escaped(text: Column, template: Template = CHATML) -> Column:
    """The text with one more backslash inside every opener, escaped or not."""
    first, rest = template.opener[0], template.opener[1:]
    return F.regexp_replace(text, re.escape(first) + r"(\\*)" + re.escape(rest),
                            _literal(first) + r"$1\\" + _literal(rest))


def unescaped(text: Column, template: Template = CHATML) -> Column:
    first, rest = template.opener[0], template.opener[1:]
    return F.regexp_replace(text, re.escape(first) + r"(\\*)\\" + re.escape(rest),
                            _literal(first) + "$1" + _literal(rest))


def _literal(s: str) -> str:
    """As the replacement of a Java pattern."""
    return s.replace("\\", r"\\").replace("$", r"\$")


def _role_out(role: Column, template: Template) -> Column:
    c = template.opener[0]
    return F.replace(F.replace(role, F.lit(c), F.lit(c + "l")), F.lit("\n"), F.lit(c + "n"))


def _role_in(role: Column, template: Template) -> Column:
    c = template.opener[0]
    return F.replace(F.replace(role, F.lit(c + "n"), F.lit("\n")), F.lit(c + "l"), F.lit(c))


def format_conversations(df: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id``, ``segments`` (text, loss), ``formatted``, ``n_turns``, ``valid`` and
    ``refused_turn`` (place of the first turn that the machine refuses, from 0; null where it refuses none)."""
    rows = df.select(F.col(conv).alias("conv_id"),
                     F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                              F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.begin), _role_out(t["role"], template), F.lit("\n")).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
        F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")))))
    machine = F.aggregate("turns", _at(template.initial, 0, None), lambda now, t: _step(now, t["role"], template))
    out = turns.select("conv_id", segments.alias("segments"), F.size("turns").cast("long").alias("n_turns"),
                       machine.alias("machine"))
    return out.select("conv_id", "segments",
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns",
                      (F.col("machine.refused").isNull() & F.col("machine.state").isin(*template.accepting)).alias("valid"),
                      F.col("machine.refused").alias("refused_turn"))


def _at(state: str, place: int, refused) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(place).cast("long").alias("place"),
                    F.lit(refused).cast("long").alias("refused"))


def _step(now: Column, role: Column, template: Template) -> Column:
    """The machine after one more turn; a refused turn leaves the state as it is."""
    after = F.lit(None).cast("string")
    for state, to in template.transitions.items():
        for name, reached in to.items():
            after = F.when((now["state"] == state) & (role == name), F.lit(reached)).otherwise(after)
    refused = F.when(after.isNull(), now["place"])
    return F.struct(F.coalesce(after, now["state"]).alias("state"), (now["place"] + 1).alias("place"),
                    F.coalesce(now["refused"], refused).alias("refused"))


def turns_read(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, re.escape(template.begin), -1)
    # a formatted conversation begins with the mark, so its first piece is empty
    pieces = F.filter(pieces, lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        at = F.length(head) + 2
        body = F.substring(p, at, F.length(p) - at + 1 - len(template.tail))
        return F.struct(_role_in(head, template).alias("role"), unescaped(body, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescaped(s["text"], template)), "")
