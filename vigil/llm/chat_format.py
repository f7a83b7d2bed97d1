"""Chat formatting: a state machine over roles and a declarative template.

Native: only DataFrame functions. A conversation's turns are put in order, the
machine checks every role against the states it may follow, and the template
turns each turn into text segments with a loss flag per segment.

Defined cases: a null text or role is empty; turns with the same number are
ordered by role, then text; a null turn number comes first; rows without a
conv_id form one conversation whose id is null; a conversation whose roles break
the order is still formatted and has ``valid`` false; other columns are ignored.

One row holds one conversation, as its digest is one running hash; the longest
conversation bounds a task, not the number of conversations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which roles are learned, which role may follow which."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a role names the state after it.
    follows: dict = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    #: states in which a conversation may stop
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """Put one more backslash between "<" and "|", so no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Take that backslash out again: the inverse of ``escape`` for every text."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand before the first line break, so line breaks and "<" are percent-coded."""
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """Last state of the machine, null once a role was not allowed."""
    allowed = F.array(*[F.lit(f"{s}>{r}") for s, roles in template.follows.items() for r in roles])
    return F.aggregate(
        turns,
        F.lit(""),
        lambda state, turn: F.when(
            F.array_contains(allowed, F.concat(state, F.lit(">"), turn["role"])), turn["role"]
        ),
    )


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, valid, segments (text, loss), formatted.

    ``formatted`` is the segments joined; a trainer masks the loss by segment.
    """
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    chats = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(
                    F.concat(F.lit(template.start), escape_role(t["role"]), F.lit(template.after_role)), F.lit(False)
                ),
                segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.end + template.after_turn), F.lit(False)),
            ),
        )
    )
    last = _machine(F.col("turns"), template)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(last.isin(*template.final), F.lit(False)).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    tail = template.end + template.after_turn
    literal = "".join(f"\\{c}" if not c.isalnum() and c not in "_" else c for c in template.start)
    parts = F.slice(F.split(formatted, literal), 2, F.length(formatted) + 1)

    def turn(part):
        cut = F.instr(part, template.after_role)
        text = F.substring(part, cut + F.lit(1), F.length(part) - cut - F.lit(len(tail)))
        return F.struct(
            unescape_role(F.substring(part, F.lit(1), cut - F.lit(1))).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
