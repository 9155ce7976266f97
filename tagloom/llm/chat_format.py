"""Operator 7, chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example: all preceding turns are its context
and only that reply is trainable, given as a span of code points of the
example's text. A conversation that does not end with an assistant turn gets
one more example without a trainable span, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and
texts a backslash becomes two, ``<|`` becomes ``<\\|`` and a role's line break
gets a backslash before it, so control strings cannot occur and the original
can be read back.

An example's text is a prefix of its conversation's, so a conversation is
formatted once and cut per example. A conversation is one row by nature (its
text is one training context); all else is dealt by conversation.

Defined results: turns go by (turn, role, text), nulls first; repeated rows
are turns of their own; a null role or text is empty; a null conv_id is a
conversation of its own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the template's control strings
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, text,
    loss_start (code points before the span), loss_length."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    cut = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    placed = cut.withColumn("end", F.sum(size.cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.struct("end", F.concat("head", "body", F.lit(END)).alias("whole"),
                    F.length("body").cast("long").alias("body"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    talks = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["whole"]), "").alias("formatted"),
        F.transform("parts", lambda p, i: F.struct(
            (i + 1).alias("n_turns"), p["end"].alias("end"), p["body"].alias("body"), p["trained"].alias("trained")))
        .alias("marks"))
    wanted = F.filter("marks", lambda m: m["trained"] | (m["n_turns"] == F.size("marks")))
    each = talks.select("conv_id", "formatted", F.posexplode(wanted).alias("example", "m"))
    return each.select(
        "conv_id", "example", F.col("m.n_turns").alias("n_turns"),
        F.substring("formatted", F.lit(1), F.col("m.end").cast("int")).alias("text"),
        F.when(F.col("m.trained"), F.col("m.end") - len(END) - F.col("m.body")).otherwise(F.col("m.end"))
        .alias("loss_start"),
        F.when(F.col("m.trained"), F.col("m.body")).otherwise(F.lit(0)).cast("long").alias("loss_length"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    def one(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    parts = F.split(text, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), one)


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(F.substring(text, (start + 1).cast("int"), length.cast("int")))


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text
    and the number of formatted characters."""
    spans = F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    got = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"), F.sort_array(F.collect_list(spans)).alias("spans"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    told = got.select("conv_id", read_turns(F.col("longest")).alias("turns"), "formatted_chars",
                      F.array_join(F.transform("spans", lambda s: s["loss"]), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars")
