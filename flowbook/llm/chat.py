"""Chat formatting with a grammar round trip (op9), in DataFrame functions only.

A turn is rendered as ``<s> role [INST] text </s>``, with one space on the inner
side of every mark.  The parser is deterministic: a turn runs to its first
`` </s>``, its role to the first `` [INST] ``; then one escape sign is taken from
each control string that has some in front.  Every control string inside a role or
text gets one escape sign more than it had, so a content never holds a control
string with a space in front and comes back.  The rendered text is reparsed and
compared with its source; ``format_chats`` fails on a difference rather than hand
out changed text.

Null text and null role are empty.  Turns are ordered by turn, null first; rows of
one conversation with equal turns are ordered by role and text; repeated rows are
repeated turns.  A null conversation is one of its own.  A conversation is one
value of output, so its turns are gathered; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>`` of the template.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
SIGN = "␛"
_OPEN, _MID, _CLOSE = "<s> ", " [INST] ", " </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({SIGN}*(?:{CONTROL}))", f"{SIGN}$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{SIGN}({SIGN}*(?:{CONTROL}))", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), role, F.lit(_MID), text, F.lit(_CLOSE))


def turns_of(rendered: Column) -> Column:
    """The rendered turns, one after the other."""
    return F.regexp_extract_all(rendered, F.lit("(?s)<s> .*? </s>"), F.lit(0))


def _mid(turn: Column) -> Column:
    return F.locate(_MID, turn)


def role_of(turn: Column) -> Column:
    return F.substring(turn, F.lit(len(_OPEN) + 1), F.greatest(F.lit(0), _mid(turn) - len(_OPEN) - 1))


def text_of(turn: Column) -> Column:
    at = _mid(turn) + len(_MID)
    return F.substring(turn, at, F.greatest(F.lit(0), F.length(turn) - at + 1 - len(_CLOSE)))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row a conversation: ``rendered``; ``escaped`` (did it need escapes);
    ``roles`` and ``texts`` as read back from it; ``mask``, the loss mask as runs
    of code points ``(length, loss)`` that cover ``rendered``, three a turn, in
    which the texts of role ``learn`` are under the loss; and ``loss_text``, what
    stands under it, unescaped."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    source = chats.select("conv", F.col("t.role").alias("r0"), F.col("t.text").alias("x0"))
    text = F.array_join(F.zip_with("r0", "x0", lambda r, x: render(escape(r), escape(x))), "")
    made = source.select("*", text.alias("rendered"))
    out = made.select("*", (F.length("rendered") != F.length(F.array_join(F.zip_with("r0", "x0", render), ""))).alias("escaped"))
    error = F.raise_error(F.concat(F.lit("no exact round trip: conversation "), F.coalesce(F.col("conv").cast("string"), F.lit("null")))).cast("string")
    back = _read(out, "rendered").select("conv", "escaped", "raw", "roles", "texts", F.when(_same("rendered"), F.col("rendered")).otherwise(error).alias("rendered"))

    def runs(turn: Column, role: Column) -> Column:
        before, text, after = _mid(turn) + len(_MID) - 1, F.length(text_of(turn)), F.lit(len(_CLOSE))
        run = lambda n, loss: F.struct(n.cast("long").alias("length"), loss.alias("loss"))
        return F.array(run(before, F.lit(False)), run(text, role == learn), run(after, F.lit(False)))

    loss = F.array_join(F.zip_with("roles", "texts", lambda r, x: F.when(r == learn, x).otherwise("")), "")
    return back.select(F.col("conv").alias(conv_col), "rendered", "escaped", "roles", "texts",
                       F.flatten(F.zip_with("raw", "roles", runs)).alias("mask"), loss.alias("loss_text"))


def _read(df: DataFrame, rendered: str) -> DataFrame:
    """Adds ``raw`` (rendered turns), ``roles`` and ``texts``, parsed from the rendered text."""
    return df.select("*", turns_of(F.col(rendered)).alias("raw")).select(
        "*", F.transform("raw", lambda t: unescape(role_of(t))).alias("roles"), F.transform("raw", lambda t: unescape(text_of(t))).alias("texts"))


def _same(rendered: str) -> Column:
    """The parser took all of the rendered text and gave the source."""
    return (F.array_join("raw", "") == F.col(rendered)) & (F.col("roles") == F.col("r0")) & (F.col("texts") == F.col("x0"))
