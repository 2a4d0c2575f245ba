"""Conversations as one marked text each, with the spans that training may learn from.

Spark expressions only. The rows of a conversation are collected and sorted by turn (then
role and text, nulls first); neighbours of one role become one block; blocks are written as

    system      <<SYS>> ... <</SYS>>
    user        [INST] ... [/INST]
    assistant   <s> ... </s>
    any other   [ROLE]role[/ROLE] ... [END]

with nothing between a mark and its text, and [TURN] between the turns of a block. Where a
text or a role's name holds a mark, or one with backslashes behind its bracket, it gets one
more backslash there: no text can forge a mark, and taking one backslash away gives the
text back. The loss mask is the list of the assistant turns' places, marks excluded, in
code points of the marked text.

A null text counts as empty, a null role as the role "". Repeated rows are turns of their
own. Rows without a conv_id form one conversation. A conversation is one value, so
it must fit into a task; rows of one conversation are brought together, all else is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.expressions import bound, gathered

ESCAPED = r"([<\[])(\\*)(/?s>|/?<SYS>>|/SYS>>|</SYS>>|/?INST\]|/?ROLE\]|TURN\]|END\])"
UNESCAPED = r"([<\[])\\(\\*)(/?s>|/?<SYS>>|/SYS>>|</SYS>>|/?INST\]|/?ROLE\]|TURN\]|END\])"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
TURN, ROLE, END_ROLE, END = "[TURN]", "[ROLE]", "[/ROLE]", "[END]"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def _mark(role: Column, side: int) -> Column:
    other = F.concat(F.lit(ROLE), escape(role), F.lit(END_ROLE)) if side == 0 else F.lit(END)
    out = F.when(role == "system", MARKS["system"][side])
    for name in ("user", "assistant"):
        out = out.when(role == name, MARKS[name][side])
    return out.otherwise(other)


def merged(turns: Column) -> Column:
    """Blocks of neighbouring turns of one role: array of (role, texts), from sorted turns."""

    def cut(turns: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(turns) - 1, F.lit(0)))
        first = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

        def blocks(first: Column) -> Column:
            def block(start: Column, k: Column) -> Column:
                size = F.coalesce(F.get(first, k + 1), F.size(turns)) - start
                texts = F.transform(F.slice(turns, start + 1, size), lambda t: t["text"])
                return F.struct(F.get(turns, start)["role"].alias("role"), texts.alias("texts"))

            return F.transform(first, block)

        return bound(first, blocks)

    return bound(turns, cut)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the marked text and the places (start, end) to learn from."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    conv = F.col("conv_id").cast("long").alias("conv_id")
    blocks = rows.select(conv, turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = blocks.select("conv_id", merged(F.col("turns")).alias("blocks"))
    # pieces of the marked text: each a mark or a turn's text, and whether it is learnt
    def pieces(block: Column) -> Column:
        learnt = block["role"] == LEARNT
        texts = F.transform(
            block["texts"],
            lambda text, k: F.array(
                _piece(F.when(k > 0, TURN).otherwise(_mark(block["role"], 0)), F.lit(False)),
                _piece(escape(text), learnt),
            ),
        )
        return F.concat(F.flatten(texts), F.array(_piece(_mark(block["role"], 1), F.lit(False))))

    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("parts"))

    span = "struct<start:int,end:int>"

    def place(state: dict[str, Column], part: Column):
        end = state["at"] + F.length(part["text"])
        own = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return {"at": end}, F.when(part["learnt"], own).otherwise(F.array().cast(f"array<{span}>"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        gathered(F.col("parts"), {"at": F.lit(0)}, place, span).alias("loss"),
    )


def _piece(text: Column, learnt: Column) -> Column:
    return F.struct(text.alias("text"), learnt.alias("learnt"))


def _quoted(*marks: str) -> str:
    return "|".join(f"\\Q{m}\\E" for m in marks)


def read_turns(formatted: Column) -> Column:
    """The turns of a marked text: array of (role, text)."""
    blocks = F.split(formatted, _quoted(*[m[1] for m in MARKS.values()], END))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)  # nothing stands behind the last mark

    def turns(block: Column) -> Column:
        role, rest = unescape(F.substring_index(F.substr(block, F.lit(len(ROLE) + 1)), END_ROLE, 1)), F.substr(
            block, F.locate(END_ROLE, block) + len(END_ROLE)
        )
        for name, (mark, _) in MARKS.items():
            here = F.startswith(block, F.lit(mark))
            role = F.when(here, name).otherwise(role)
            rest = F.when(here, F.substr(block, F.lit(len(mark) + 1))).otherwise(rest)
        return F.transform(
            F.split(rest, _quoted(TURN)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
