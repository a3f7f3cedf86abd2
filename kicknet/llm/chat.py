"""Chat formatting: conversations to one training string each, and back.

A conversation's turns are collected as structs, sorted, merged where neighbours
have the same role, and concatenated; everything is a Spark expression.

    <s>user[TURN]first text[MORE]next text of the same role</s><s>assistant[TURN]...</s>

A control string inside a role or text gets one backslash after its first
character, and one more if it already has some, so reading back is exact and no
text can open or close a turn. Turns are ordered by (turn, role, text), nulls first.

Null roles and texts count as empty. Rows with a null conversation id form one
conversation. Repeated rows are turns of their own. Columns other than the four
named ones are ignored. A table without rows gives no rows. A conversation is one
row of the result, so it has to fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TURN, MORE, CLOSE = "<s>", "[TURN]", "[MORE]", "</s>"
#: Control strings of this template and of a common one, without their first character.
_TAILS = r"(?:/?s>|TURN\]|MORE\]|/?INST\])"
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"


def escaped(text: Column) -> Column:
    """Text in which no control string occurs."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _pieces(turns: Column) -> Column:
    """One struct (head, texts) per run of turns with the same role.

    head opens the turn; texts are the escaped texts of the run.
    """
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.zip_with(
        starts,
        ends,
        lambda s, e: F.struct(
            F.concat(F.lit(OPEN), escaped(turns[s]["role"]), F.lit(TURN)).alias("head"),
            F.transform(F.slice(turns, s + 1, e - s), lambda t: escaped(t["text"])).alias("texts"),
            (turns[s]["role"]).alias("role"),
        ),
    )


def _spans(pieces: Column, role: str) -> Column:
    """Start and length, in code points, of every text of the role in the output."""
    more = len(MORE)

    def step(acc: Column, piece: Column) -> Column:
        inner = F.aggregate(
            piece["texts"],
            F.struct(
                (acc["at"] + F.length(piece["head"])).alias("at"),
                acc["spans"].alias("spans"),
            ),
            lambda a, t: F.struct(
                (a["at"] + F.length(t) + more).alias("at"),
                F.when(
                    piece["role"] == role,
                    F.array_append(
                        a["spans"],
                        F.struct(a["at"].alias("start"), F.length(t).cast("long").alias("length")),
                    ),
                )
                .otherwise(a["spans"])
                .alias("spans"),
            ),
        )
        return F.struct(
            (inner["at"] - more + len(CLOSE)).alias("at"), inner["spans"].alias("spans")
        )

    return F.aggregate(
        pieces,
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"),
        ),
        step,
        lambda acc: acc["spans"],
    )


def format_chat(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, `formatted` and `loss_spans`.

    `loss_spans` are the spans (start from 0, length; code points) a model is
    trained on: every text of `loss_role`, in order.
    """
    collected = turns.groupBy(F.col(conv).alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    pieces = collected.select("conv_id", _pieces(F.col("turns")).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(
            F.transform(
                "pieces",
                lambda p: F.concat(p["head"], F.array_join(p["texts"], MORE), F.lit(CLOSE)),
            ),
            "",
        ).alias("formatted"),
        _spans(F.col("pieces"), loss_role).alias("loss_spans"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def block(b: Column) -> Column:
        at = F.instr(b, TURN)
        head = unescaped(F.substring(b, F.lit(len(OPEN) + 1), at - 1 - len(OPEN)))
        body = F.substring(b, at + len(TURN), F.length(b))
        return F.transform(
            F.split(body, r"\[MORE\]", -1),
            lambda t: F.struct(head.alias("role"), unescaped(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, block))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the output and unescaped."""
    return F.transform(
        spans,
        lambda s: unescaped(
            F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
