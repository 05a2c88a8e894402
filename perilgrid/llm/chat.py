"""Chat formatting from a declarative template, in DataFrame operations only.

A finite-state machine over roles validates the order of turns; the template says how a turn begins
and ends and which roles are learned from. The output is a list of segments with a loss flag each,
and their concatenation. Control strings begin with a sign that is escaped inside texts, so a text
that spells them out is read back as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open is put around the role; every control string begins with the sign ``lead``."""

    begin: str = "<|turn|>"
    middle: str = "<|says|>"
    end: str = "<|done|>"
    lead: str = "<"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; a turn without an entry makes the conversation invalid.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "said", ("said", "user"): "asked"}
    )
    accepting: tuple[str, ...] = ("said",)

    def escaped(self, c: Column) -> Column:
        c = F.replace(c, F.lit(self.escape), F.lit(self.escape + "e"))
        return F.replace(c, F.lit(self.lead), F.lit(self.escape + "l"))

    def plain(self, c: Column) -> Column:
        c = F.replace(c, F.lit(self.escape + "l"), F.lit(self.lead))
        return F.replace(c, F.lit(self.escape + "e"), F.lit(self.escape))

    def final_state(self, turns: Column) -> Column:
        """The state after turns (an array of structs with a role), or 'invalid'."""
        table = F.create_map(*(F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}>{role}", to)))
        return F.aggregate(turns, F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), t["role"])), F.lit("invalid")))

    def segments(self, turns: Column) -> Column:
        """Of each turn three segments: its opening, its text, its end; the loss flag is set on the
        texts of learned roles."""

        def of(t: Column) -> Column:
            opening = F.concat(F.lit(self.begin), self.escaped(t["role"]), F.lit(self.middle))
            learned = t["role"].isin(*self.learned)
            part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
            return F.array(part(opening, F.lit(False)), part(self.escaped(t["text"]), learned), part(F.lit(self.end), F.lit(False)))

        return F.flatten(F.transform(turns, of))

    def turns(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted conversation."""
        blocks = F.filter(F.split(formatted, _quoted(self.end)), lambda b: b != "")

        def of(b: Column) -> Column:
            body = F.substr(b, F.lit(len(self.begin) + 1))
            at = F.instr(body, self.middle)
            role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(self.middle))
            return F.struct(self.plain(role).alias("role"), self.plain(text).alias("text"))

        return F.transform(blocks, of)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, valid, segments, formatted) of each conversation in rows(conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text, nulls first; null roles and texts become empty.
    valid: the machine accepts the order of roles. Invalid conversations are formatted too, for the
    caller to filter. Rows without a conv_id make up one conversation; repeated rows are turns each;
    other columns aren't read. A conversation is one output row, so its turns meet in one task."""
    text = lambda c: F.col(c).cast("string")
    turn = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    clean = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    turns = turns.select("conv_id", clean.alias("turns"))
    made = turns.select("conv_id", template.final_state(F.col("turns")).isin(*template.accepting).alias("valid"), template.segments(F.col("turns")).alias("segments"))
    return made.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the output of format_conversations holds: conv_id, n_turns, turns_sha256 (of
    role, newline, text, newline for each turn), loss_chars and loss_sha256 (of all text under the
    loss mask, unescaped), formatted_chars, valid."""
    turns = template.turns(F.col("formatted"))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.plain(s["text"])))
    d = formatted.select("conv_id", "valid", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    listed = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
