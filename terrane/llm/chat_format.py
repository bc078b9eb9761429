"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the text of all turns before it is the context, its own text follows
and is all that the loss mask touches. What comes after the last reply, and a conversation without any reply, makes one
more record, a remainder, with an empty mask. Records are written out in full, so their size grows with the square of a
conversation's turns: that is the format.

Template: ``### role: text</turn>`` and a line feed. Inside a text ``\\`` becomes ``\\b``, ``###`` becomes ``\\h`` and
``</turn>`` becomes ``\\t``, so neither control string can occur there and the escape can be undone; in a role ``:``
also becomes ``\\c``.

Edge cases: a null text or role counts as empty; rows are ordered by turn (nulls first), rows of the same turn by role
and text, repeated rows are turns of their own; a null conv_id is a conversation like any other; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

HEAD, TAIL = "### ", "</turn>\n"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _swap(_swap(_swap(c, "\\", "\\b"), "###", "\\h"), "</turn>", "\\t")


def unescape(c: Column) -> Column:
    """Each backslash of an escaped text is followed by its own letter, so plain replacement undoes them in turn."""
    return _swap(_swap(_swap(c, "\\t", "</turn>"), "\\h", "###"), "\\b", "\\")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the formatted turns in order, each with the characters of its head and whether it is a reply."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("row"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = lambda r: F.concat(F.lit(HEAD), _swap(escape(r["role"]), ":", "\\c"), F.lit(": "))
    turn = lambda r: F.struct(
        F.concat(head(r), escape(r["text"]), F.lit(TAIL)).alias("formatted"),
        F.char_length(head(r)).alias("head"),
        (r["role"] == "assistant").alias("reply"),
    )
    return lists.select("conv_id", F.transform("rows", turn).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, and per remainder: conv_id, target, n_turns, text, loss_from, loss_to.

    target is the place (from 0) of the last turn in text; the mask is [loss_from, loss_to) in characters of text.
    """
    lists = turn_lists(conversations)
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.col("turns")[i]["reply"] | (i == n - 1))
    exploded = lists.select("conv_id", n.alias("n_turns"), "turns", F.explode(targets).alias("target"))
    own = exploded.select(
        "conv_id",
        "target",
        "n_turns",
        F.array_join(F.slice("turns.formatted", F.lit(1), F.col("target")), "").alias("context"),
        F.col("turns")[F.col("target")].alias("own"),
    )
    text = F.concat("context", "own.formatted")
    end = F.char_length(text)
    return own.select(
        "conv_id",
        "target",
        "n_turns",
        text.alias("text"),
        F.when(F.col("own.reply"), F.char_length("context") + F.col("own.head")).otherwise(end).alias("loss_from"),
        F.when(F.col("own.reply"), end - len(TAIL)).otherwise(end).alias("loss_to"),
    )


def written(conversations: DataFrame) -> DataFrame:
    """The examples as files in the shared folder, read again."""
    return stored(examples(conversations), "chat-examples")


def parsed_turns(text: Column) -> Column:
    """(role, text) of every turn of a formatted text, unescaped."""

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(HEAD) + 1))
        cut = F.locate(": ", inner)
        return F.struct(unescape(_swap(F.substr(inner, F.lit(1), cut - 1), "\\c", ":")).alias("role"), unescape(F.substr(inner, cut + 2)).alias("text"))

    pieces = F.split(text, TAIL)  # the text ends with TAIL, so what follows the last one is empty
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digests(records: DataFrame) -> DataFrame:
    """Per conversation, from its records: the turns of the record that holds them all, and the text under all masks."""
    turns = F.when(F.col("target") == F.col("n_turns") - 1, parsed_turns(F.col("text")))
    masked = unescape(F.substr("text", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    read = records.select("conv_id", "target", turns.alias("turns"), masked.alias("loss"), F.char_length("text").cast("long").alias("n_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "target", "loss", "n_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("digest"))
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("target", "loss"))).alias("losses"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    loss = F.array_join("losses.loss", "")
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
