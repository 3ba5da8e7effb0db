"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all turns before it are context and only
its reply is trainable. Turns after the last assistant turn go into one further example
without a trainable part, so no turn is lost. In a template turn a role and a text stand
between control strings; control strings inside a role or a text are escaped with a
backslash, backslashes are doubled, and line feeds in roles are escaped too, so reading an
example back gives the exact turns.

Null roles and texts are empty. Turns are ordered by turn, then role, then text; repeated
rows are turns of their own, null turns come first. A null conv_id is a conversation. A
conversation is one row, because its digest and its examples need all of its turns; nothing
else is gathered. An empty table gives no examples. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values of the chat format).
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """No control string is left: `<|` becomes `<\\|`; backslashes are doubled first."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def formatted_turn(turn: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n"),
                    escaped(turn["text"]), F.lit(END))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))


def examples(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, target (place of the last turn), text, loss_start and loss_chars.

    `loss_start` counts code points from 0; `loss_chars` is 0 and `trainable` false in the
    example that only closes a conversation.
    """
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    targets = F.filter(places, lambda i: F.element_at("turns", i + 1)["role"] == trained_role)
    last = F.size("turns") - 1
    shown = F.when(F.array_contains(targets, last), targets).otherwise(
        F.array_append(targets, last))
    each = conversations_of(rows).select("conv_id", "turns",
                                         F.explode(shown).alias("target"))
    target = F.element_at("turns", F.col("target") + 1)
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target")),
                                       formatted_turn), "")
    opening = F.concat(context, F.lit(START), escaped_role(target["role"]), F.lit("\n"))
    reply = escaped(target["text"])
    trainable = target["role"] == trained_role
    return each.select(
        "conv_id", "target", trainable.alias("trainable"),
        F.concat(opening, reply, F.lit(END)).alias("text"),
        F.length(opening).alias("loss_start"),
        F.when(trainable, F.length(reply)).otherwise(0).alias("loss_chars"))


def trained_text(example_text: str = "text") -> Column:
    """What stands under the loss mask, as the turn had it."""
    return unescaped(F.substring(F.col(example_text), F.col("loss_start") + 1,
                                 F.col("loss_chars")))


def turns_of(example_text: str = "text") -> Column:
    """The (role, text) turns of an example, read from its text alone."""
    pieces = F.filter(F.split(F.col(example_text), "<\\|im_start\\|>"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        body = F.length(piece) - at - len(END)
        return F.struct(unescaped_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
                        unescaped(F.substring(piece, at + 1, body)).alias("text"))

    return F.transform(pieces, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    last = F.max_by("text", "target").alias("longest")
    parts = F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct(
        "target", trained_text().alias("reply")))))
    each = formatted.groupBy("conv_id").agg(
        last, parts.alias("parts"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    read = each.withColumn("turns", turns_of("longest")).withColumn(
        "loss", F.array_join(F.transform("parts", lambda p: p["reply"]), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
