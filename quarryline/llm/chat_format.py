r"""Operator 5, chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is trainable.  Turns after a conversation's last
assistant turn (all turns, if it has none) make one more example, which holds the whole
conversation and nothing to train on, so that no turn is lost.

Template of a turn::

    <turn>role
    text</turn>

with a line feed after each.  Inside roles and texts a backslash becomes ``\\``, ``<turn>`` becomes
``\o`` and ``</turn>`` becomes ``\c``; inside roles a line feed becomes ``\n``.  Escaped texts hold no marks,
and left to right the escapes read back in one way only.

A conversation is put in order once, as one sorted array; its examples are prefixes of it, so
the output is as large as prefixes are, and a long conversation is one row as long as itself.

Defined results: a null text or role is the empty text; rows of a conversation with the same turn are in order of
role, then text, and each is a turn; a null turn number comes first; null conversation ids are one conversation,
whose id is null; an empty table gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.
OPEN, CLOSE = "<turn>", "</turn>"
_OPEN_ESCAPED, _CLOSE_ESCAPED = "\\o", "\\c"


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, ("\\", "\\\\"), (OPEN, _OPEN_ESCAPED), (CLOSE, _CLOSE_ESCAPED))


def unescape(text: Column) -> Column:
    """Undo escape(): between escaped backslashes, the other escapes stand alone."""
    parts = F.split(text, r"\\\\")  # a pattern: two backslashes, taken from left to right
    return F.array_join(F.transform(parts, lambda x: _swap(x, (_OPEN_ESCAPED, OPEN), (_CLOSE_ESCAPED, CLOSE))), "\\")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), ("\n", "\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: _swap(x, ("\\n", "\n"), (_OPEN_ESCAPED, OPEN), (_CLOSE_ESCAPED, CLOSE))), "\\")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE + "\n"))


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) of a formatted text."""
    pieces = F.split(formatted, CLOSE + "\n")
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        cut = F.instr(body, "\n")
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(bodies, turn)


def expand(
    turns: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", trained_role: str = "assistant"
) -> DataFrame:
    """Examples (id, example, n_turns, text, loss_start, loss_length): text from loss_start (0-based, in characters) is trainable.

    ``example`` numbers a conversation's examples from 0; loss_length is 0 and loss_start null where there is nothing to train on.
    """
    turn = F.struct(
        F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    whole = turns.select(F.col(id_column).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: format_turn(t["role"], t["text"]))
    is_reply = F.transform("turns", lambda t: t["role"] == trained_role)
    whole = whole.select("id", shown.alias("shown"), is_reply.alias("is_reply"), F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("lengths"))
    # the ends of the prefixes: each reply, and the conversation's end
    ends = F.filter(F.sequence(F.lit(1), F.size("shown")), lambda i: F.element_at("is_reply", i) | (i == F.size("shown")))
    each = whole.select("id", "shown", "is_reply", "lengths", F.posexplode(ends).alias("example", "n_turns"))
    text = F.array_join(F.slice("shown", F.lit(1), F.col("n_turns")), "")
    reply = F.element_at("is_reply", F.col("n_turns"))
    loss = F.when(reply, F.element_at("lengths", F.col("n_turns"))).otherwise(0)
    out = each.select("id", "example", F.col("n_turns").cast("long"), text.alias("text"), loss.cast("long").alias("loss_length"), reply.alias("reply"))
    start = F.length("text") - F.lit(len(CLOSE) + 1) - F.col("loss_length")
    return out.select(F.col("id").alias(id_column), "example", "n_turns", "text", F.when(F.col("reply"), start).cast("long").alias("loss_start"), "loss_length")


def digest(examples: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from their texts."""
    read = examples.select(
        F.col(id_column).alias("id"),
        "example",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))).alias("loss"),
        # only the longest example holds all turns
        "n_turns",
        "text",
    )
    one = read.groupBy("id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.max_by("text", "n_turns").alias("text"),
    )
    turns = parse_turns(F.col("text"))
    one = one.withColumn("back", turns).withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        F.col("id").alias(id_column),
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
