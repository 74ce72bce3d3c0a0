"""Chat formatting: a finite-state machine over roles writes segments with loss flags.

A declarative template says how each role's turn opens and closes, which roles
carry loss, and which role may follow which. The machine folds over the turns
of a conversation in order; every turn gives segments (marker, text, marker),
each with a loss flag, and the segments joined are the formatted conversation.
Inside texts the characters that markers and control strings start with are
escaped, so no text can open or close a turn, and unescaping gives it back.
SQL functions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes in the order of writing; they are undone in the opposite order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


@dataclass(frozen=True)
class Template:
    """Markers may hold any text but must contain ``<`` or ``[``, which texts never do once escaped."""

    open_turn: str = "<|turn|>"
    after_role: str = "<|says|>"
    end_turn: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: role -> roles that may stand before it; "" is the start.
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)}
    )

    def __post_init__(self) -> None:
        for marker in (self.open_turn, self.after_role, self.end_turn):
            if "<" not in marker and "[" not in marker:
                raise ValueError(f"marker {marker!r} could be taken for text")


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_chats(turns: DataFrame, template: Template = Template(), *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: its id, formatted, segments (array of text, loss), valid, first_fault.

    Turns are ordered by turn, then role, then text, so ties and repeated rows
    have one order; a null turn comes first. Null roles and texts count as empty.
    ``first_fault`` is the number of the first turn that the machine does not
    accept (0-based; null if valid): conversations are formatted either way. Rows
    with a null conversation id form one conversation. An empty table gives no
    rows. Other columns play no part. A conversation is one value, so its turns meet in one row.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(said)).alias("_turns"))

    def accepts(last: Column, now: Column) -> Column:
        out = F.lit(False)
        for name, before in template.follows.items():
            out = out | ((now == name) & last.isin(*before))
        return out

    roles = F.transform("_turns", lambda t: t["role"])
    lasts = F.concat(F.array(F.lit("")), F.slice(roles, 1, F.size(roles) - 1))
    steps = F.zip_with(lasts, roles, lambda last, now: accepts(last, now))
    fault = F.array_position(steps, False) - 1

    def segments(t: Column) -> Column:
        carries = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(template.open_turn), escaped(t["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), carries.alias("loss")),
            F.struct(F.lit(template.end_turn).alias("text"), F.lit(False).alias("loss")),
        )

    built = whole.select(conversation, F.flatten(F.transform("_turns", segments)).alias("segments"), fault.cast("int").alias("_fault"))
    return built.select(
        conversation,
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("_fault") < 0).alias("valid"),
        F.when(F.col("_fault") >= 0, F.col("_fault")).alias("first_fault"),
    )


def read_back(formatted: DataFrame, template: Template = Template(), *, conversation: str = "conv_id") -> DataFrame:
    """conversation, turns (array of role, text), loss_text, from the formatted text and the segments' flags."""
    pieces = F.filter(F.split("formatted", _quoted(template.end_turn)), lambda x: x != "")
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substr(x, F.lit(len(template.open_turn) + 1)), template.after_role, 1)).alias("role"),
            unescaped(F.substr(x, F.char_length(F.substring_index(x, template.after_role, 1)) + len(template.after_role) + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return formatted.select(conversation, turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _quoted(marker: str) -> str:
    return "\\Q" + marker + "\\E"
