"""Chat formatting (DataFrame functions only).

A finite-state machine over roles validates the order of turns; a declarative
template says which literal and escaped segments a turn emits and which of them
carry loss. Control strings inside texts are escaped reversibly, so `read_back`
recovers roles and texts from the formatted string alone, and the loss from the flags of its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments of a turn: (kind, value). Kinds: "mark" is literal, "role" and "text" are escaped fields.
TEMPLATE = (("mark", "<|im_start|>"), ("role", ""), ("mark", "\n"), ("text", ""), ("mark", "<|im_end|>"), ("mark", "\n"))
#: Roles whose text segments carry loss.
LOSS_ROLES = ("assistant",)
#: state -> role -> next state; what is absent is an error.
MACHINE = {
    "start": {"system": "opened", "user": "asked"},
    "opened": {"user": "asked"},
    "asked": {"assistant": "answered", "tool": "asked"},
    "answered": {"user": "asked", "tool": "asked"},
}
ACCEPTING = ("answered",)
#: Every "<|" in a field becomes "<||": no mark can appear in it, and dropping
#: the bar after each "<|" undoes it. In roles, "\" and line feed are escaped too.
OPEN, SHUT = "<|", "<||"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(SHUT))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(SHUT), F.lit(OPEN))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A doubled backslash is parked on a mark that cannot stand in an escaped role: a line feed.
    parked = F.replace(role, F.lit("\\\\"), F.lit("\n"))
    pieces = F.transform(F.split(parked, "\n", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\"))


def _state(turns: Column) -> Column:
    """The machine's last state over sorted turns; "error" stays."""
    table = F.create_map(*[F.lit(x) for s, row in MACHINE.items() for r, t in row.items() for x in (f"{s} {r}", t)])
    return F.aggregate(turns, F.lit("start"), lambda s, t: F.coalesce(table[F.concat(s, F.lit(" "), t["role"])], F.lit("error")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, valid, end_state, segments, formatted.

    ``segments`` are struct(text, loss) in order, ``formatted`` their
    concatenation. Turns go by turn, null first, then role, then text; null
    text or role is empty; repeated rows are turns of their own; rows without
    conv_id are one conversation; an invalid order is reported in ``valid`` and
    still formatted. A conversation is one string in the output, so its turns
    meet in one task by contract; nothing larger does.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def emit(t: Column) -> Column:
        loss = t["role"].isin(*LOSS_ROLES)
        field = {"role": escape_role(t["role"]), "text": escape(t["text"])}
        return F.array(*[F.struct((F.lit(v) if kind == "mark" else field[kind]).alias("text"), (loss if kind == "text" else F.lit(False)).alias("loss")) for kind, v in TEMPLATE])

    chats = chats.withColumn("end_state", _state(F.col("turns"))).withColumn("segments", F.flatten(F.transform("turns", emit)))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("end_state").isin(*ACCEPTING).alias("valid"),
        "end_state",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) parsed from ``formatted`` and the loss flags of ``segments``."""
    start, end = TEMPLATE[0][1], TEMPLATE[4][1] + TEMPLATE[5][1]
    body = F.slice(F.split("formatted", _quoted(end), -1), 1, F.greatest(F.lit(0), F.size(F.split("formatted", _quoted(end), -1)) - 1))

    def parse(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(start) + 1), F.length(x))
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return chats.withColumn("read", F.transform(body, parse)).withColumn("loss_texts", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"
