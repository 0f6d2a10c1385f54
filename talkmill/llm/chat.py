"""Chat formatting with Spark expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, AND, END = "<|turn|>", "<|text|>", "<|and|>", "<|end|>"
#: Control strings of other common templates, escaped as well so that no text can close or open a turn there.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>")


def _pattern(controls: tuple[str, ...]) -> tuple[str, str]:
    first = "".join(sorted({re.escape(c[0]) for c in controls}))
    rest = "|".join(sorted({"".join(f"\\{x}" if not x.isalnum() and x != "_" else x for x in c[1:]) for c in controls}))
    return f"([{first}])", f"({rest})"


CONTROLS = (TURN, TEXT, AND, END, *FOREIGN)


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """One backslash more after the first character of every control string, bare or escaped before."""
    first, rest = _pattern(controls)
    return F.regexp_replace(text, rf"{first}(\\*){rest}", r"$1\\$2$3")


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    first, rest = _pattern(controls)
    return F.regexp_replace(text, rf"{first}\\(\\*){rest}", "$1$2$3")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in characters of each learnt text).

    A conversation's turns are collected as structs and sorted by turn, then role, then text (ties and repeated rows
    stay, in that order). Neighbours of one role share one block, in which AND parts their texts, so reading back
    restores every turn. Null roles and texts are empty. A null conv_id is a conversation of its own. An empty table
    gives no rows; other columns play no part. A conversation is one string, so its turns meet in one row.
    """
    said = turns.select(
        F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said")
    )
    all_turns = F.sort_array(F.collect_list("said"))

    def pieces(t: Column) -> Column:
        """Each turn as (what precedes its text, its text, whether it is learnt)."""

        def piece(x: Column, i: Column) -> Column:
            same = (i > 0) & (F.get(t, i - 1)["role"] == x["role"])
            opened = F.concat(F.when(i > 0, END).otherwise(""), F.lit(TURN), escape(x["role"]), F.lit(TEXT))
            return F.struct(F.when(same, F.lit(AND)).otherwise(opened).alias("before"), escape(x["text"]).alias("text"), (x["role"] == learn).alias("learnt"))

        return F.transform(t, piece)

    def spans(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["before"])
            size = F.length(x["text"]).cast("long")
            span = F.array(F.struct(begin.alias("start"), size.alias("length")))
            return F.struct((begin + size).alias("at"), F.when(x["learnt"], F.concat(a["found"], span)).otherwise(a["found"]).alias("found"))

        return F.aggregate(p, start, step, lambda a: a["found"])

    return (
        said.groupBy("conv_id")
        .agg(all_turns.alias("t"))
        .select("conv_id", let(F.col("t"), pieces).alias("p"))
        .select(
            "conv_id",
            F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"])), ""), F.lit(END)).alias("formatted"),
            spans(F.col("p")).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""

    def quoted(mark: str) -> str:
        return mark.replace("|", "\\|")

    def block(b: Column) -> Column:
        part = F.split(b, quoted(TEXT), 2)
        return let(
            F.struct(unescape(part[0]).alias("role"), F.split(F.substring_index(part[1], END, 1), quoted(AND), -1).alias("texts")),
            lambda x: F.transform(x["texts"], lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text"))),
        )

    blocks = F.split(formatted, quoted(TURN), -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
