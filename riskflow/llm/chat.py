r"""Chat formatting: a state machine over roles and a declarative template of segments.

The template lists the segments of one turn. Control strings start with ``<|``; texts
and roles get one backslash between ``<`` and ``|`` (and one more where there are
some already), so no text can open or close a turn and every text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: Roles whose text is learned.
LEARNED = ("assistant",)

#: Role automaton: state -> {role: next state}. A missing entry is a wrong turn.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user", "tool": "tool"},
    "tool": {"assistant": "assistant", "tool": "tool"},
}
FINAL = ("assistant",)


@dataclass(frozen=True)
class Template:
    """Segments of a turn as (kind, fixed text, learned roles): kind is fixed, role or text."""

    segments: tuple[tuple[str, str, tuple[str, ...]], ...] = (
        ("fixed", OPEN, ()),
        ("role", "", ()),
        ("fixed", "\n", ()),
        ("text", "", LEARNED),
        ("fixed", CLOSE + "\n", ()),
    )
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: MACHINE)
    final: tuple[str, ...] = FINAL


CHATML = Template()


def escape(text: Column) -> Column:
    r"""``<``, n backslashes, ``|`` becomes ``<``, n + 1 backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the line end, so line ends inside one become a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def _state_after(turns: Column, template: Template) -> Column:
    """(state, turns accepted) after the automaton has read all roles; 'error' is final."""
    moves = [(f"{s}\n{r}", t) for s, to in template.machine.items() for r, t in to.items()]
    table = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in moves]), F.array(*[F.lit(t) for _, t in moves]))

    def step(acc: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), turn["role"])), F.lit("error"))
        return F.struct(to.alias("state"), (acc["good"] + F.when(to != "error", 1).otherwise(0)).alias("good"))

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("good")), step)


def format_chats(
    rows: DataFrame,
    template: Template = CHATML,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv, formatted, segments, valid, first_bad_turn, state.

    ``segments`` are structs (text, loss) whose texts make up ``formatted``. Turns come
    in the order of (turn, role, text) with nulls first, so ties are defined and
    repeated rows are repeated turns. Null texts and roles count as empty, a null
    conversation id is a conversation of its own. Every conversation is formatted;
    ``valid`` says whether the roles follow the automaton up to a final state and
    ``first_bad_turn`` (from 0, else null) where they first do not. A conversation is
    one output value and so fits one row; no rows give no rows. Other columns are ignored.
    """
    order = F.struct(F.col(turn).alias("turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    chats = rows.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(order)).alias("_turns"))
    turns = F.transform(
        "_turns",
        lambda t: F.struct(
            F.coalesce(t["_role"], F.lit("")).alias("role"), F.coalesce(t["_text"], F.lit("")).alias("text")
        ),
    )
    chats = chats.select(conv, turns.alias("_turns"))

    def segments_of(t: Column) -> Column:
        made = []
        for kind, fixed, learned in template.segments:
            body = {"fixed": F.lit(fixed), "role": escape_role(t["role"]), "text": escape(t["text"])}[kind]
            loss = t["role"].isin(*learned) if learned else F.lit(False)
            made.append(F.struct(body.alias("text"), loss.alias("loss")))
        return F.array(*made)

    chats = chats.select(
        conv,
        F.flatten(F.transform("_turns", segments_of)).alias("segments"),
        _state_after(F.col("_turns"), template).alias("_end"),
        F.size("_turns").alias("_n"),
    )
    return chats.select(
        conv,
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        ((F.col("_end.good") == F.col("_n")) & F.col("_end.state").isin(*template.final)).alias("valid"),
        F.when(F.col("_end.good") < F.col("_n"), F.col("_end.good")).alias("first_bad_turn"),
        F.col("_end.state").alias("state"),
    )


def read_turns(formatted: Column) -> Column:
    """Structs (role, text) read back from a text in the default template."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1_000_000_000)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(head) + 2, F.length(part) - F.length(head) - 2 - len(CLOSE))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    whole = F.array_join(
        F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = chats.withColumn("_read", read_turns(F.col("formatted"))).withColumn(
        "_learned", learned_text(F.col("segments"))
    )
    return read.select(
        conv,
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )
