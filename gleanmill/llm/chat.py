"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written ``<|im_start|>role\\nbody<|im_end|>\\n``. In the grammar the two control strings are tokens wherever
they stand, a role ends at the first line feed, and an escape is ``<``, one or more backslashes, ``|``; a parser
takes one backslash off each. Escaping puts one backslash into every ``<`` backslashes ``|``, so it is undone exactly
and leaves no control string. Every turn is first written as it is and read again; where role and text don't come back
identical, the conflicting field is escaped and the turn read once more. A turn that still differs stops the job.

Null roles and texts count as empty. Turns with equal numbers stand in the order of role, then text as written; null turn numbers
come first. Repeated rows are turns of their own. Rows without a conv_id form one conversation with a null id. An
empty table gives no conversations. Only conv_id, turn, role and text are read, so other names cannot clash. The text of
a conversation is one value of the result, so its turns meet in one row by contract; escaping and checking come before
that and are done for each turn apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<\|im_(?:start|end)\|>"


def escape(text: Column, also_lines: bool = False) -> Column:
    """One more backslash in each ``<\\...\\|``; in roles line feeds are written ``<\\n|`` first."""
    out = F.regexp_replace(text, r"<(\\*n?)\|", r"<\\$1|")
    return F.replace(out, F.lit("\n"), F.lit("<n|")) if also_lines else out


def unescape(text: Column, also_lines: bool = False) -> Column:
    if also_lines:
        text = F.replace(text, F.lit("<n|"), F.lit("\n"))
    return F.regexp_replace(text, r"<\\(\\*n?)\|", r"<$1|")


def write_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def _read_frame(frame: Column) -> Column:
    """Role and text of what stands between a start and an end token."""
    at = F.locate("\n", frame)
    return F.struct(
        unescape(F.substring(frame, F.lit(1), at - 1), True).alias("role"),
        unescape(F.substring(frame, at + 1, F.length(frame)), False).alias("text"),
    )


def read_turns(formatted: Column) -> Column:
    """The parser: array of (role, text) of a formatted conversation whose bodies hold no control string."""
    frames = F.filter(F.split(formatted, END.replace("|", r"\|") + "\n", -1), lambda x: x != "")
    return F.transform(frames, lambda x: _read_frame(F.substring(x, F.lit(len(START) + 1), F.length(x))))


def _reads_back(written: Column, role: Column, text: Column) -> Column:
    """Whether the grammar finds exactly one turn in ``written``, and its role and text are the given ones."""
    parts = F.split(written, _CONTROL, -1)
    turn = _read_frame(F.try_element_at(parts, F.lit(2)))
    return F.coalesce((F.size(parts) == 3) & (F.try_element_at(parts, F.lit(3)) == "\n") & (turn["role"] == role) & (turn["text"] == text), F.lit(False))


def escape_turns(turns: DataFrame) -> DataFrame:
    """Adds ``written``: each turn as it is where it reads back identically, else with the conflicting field escaped."""
    role, text, none = F.col("role"), F.col("text"), F.lit("")
    out = turns.withColumns(
        {
            "w_role": F.when(_reads_back(write_turn(role, none), role, none), role).otherwise(escape(role, True)),
            "w_text": F.when(_reads_back(write_turn(none, text), none, text), text).otherwise(escape(text)),
        }
    )
    written = write_turn(F.col("w_role"), F.col("w_text"))
    checked = F.when(_reads_back(written, role, text), written).otherwise(F.raise_error(F.lit("a turn does not read back")).cast("string"))
    return out.withColumns({"written": checked, "n_escaped": ((F.col("w_role") != role) | (F.col("w_text") != text)).cast("long")}).drop("w_role", "w_text")


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, turns, loss_text, n_escaped``.

    ``turns`` is the array of (role, text) read back from ``formatted``; ``loss_text`` joins the texts of ``loss_role``,
    which are what the loss mask covers.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    said = F.concat(F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = escape_turns(turns).withColumn("line", F.struct("turn", "role", "written", F.md5(said).alias("of")))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.sum("n_escaped").alias("n_escaped"))
    formatted = gathered.select("conv_id", "n_escaped", F.array_join(F.col("lines.written"), "").alias("formatted"), F.array_join(F.col("lines.of"), "").alias("source"))
    read = formatted.withColumn("turns", read_turns(F.col("formatted")))
    # a row whose turns differ from the source never leaves the operator
    back = F.array_join(F.transform("turns", lambda t: F.md5(F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    checked = F.when(back == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")).cast("string"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return read.select("conv_id", checked.alias("formatted"), "turns", loss.alias("loss_text"), "n_escaped")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
    )
