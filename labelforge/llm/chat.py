"""Chat formatting with Spark expressions only.

Turn rows become one training string per conversation plus the character
spans that count towards the loss. Texts are escaped so that a control string
inside a text can never be read as template, and ``read_back`` recovers every
turn and the loss text from the string alone.

Template, per message (adjacent turns of one role share a message)::

    <|im_start|>{role}\\n{text}[<|im_sep|>{text}...]<|im_end|>\\n

Escaping: every ``<`` that is followed by any number of ``~`` and a ``|`` gets
one more ``~`` after it, so no escaped text holds ``<|``; reading takes one
``~`` away again. A line feed in a role is written as ``<|nl|>``.

Defined results: null text or role counts as empty; turns are ordered by
(turn, role, text) with null first, so ties and repeated rows have one order
and all are kept; rows with a null conversation id form one conversation;
empty input gives no rows; other input columns are ignored. A conversation is
one string, hence one row: its size is bounded by the conversation itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def _literal(s: str) -> str:
    """The control string as a regular expression for split()."""
    return s.replace("|", r"\|")


def messages(turns: Column) -> Column:
    """Sorted turn structs -> array of (role, texts): one message for each
    maximal run of equal roles."""
    n = F.size(turns)
    heads = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    heads = F.when(n > 0, heads).otherwise(F.array().cast("array<int>"))
    return F.transform(heads, lambda h, j: F.struct(
        F.element_at(turns, h)["role"].alias("role"),
        F.transform(F.slice(turns, h, F.coalesce(F.get(heads, j + 1), n + 1) - h),
                    lambda t: t["text"]).alias("texts")))


def _segments(message: Column) -> Column:
    """(text, loss) pieces of one message, in template order."""
    loss = message["role"] == "assistant"
    off = F.lit(False)
    head = F.concat(F.lit(START), F.replace(escape(message["role"]), F.lit("\n"), F.lit(NEWLINE)),
                    F.lit("\n"))
    body = F.flatten(F.transform(message["texts"], lambda t, i: F.array(
        F.struct(F.when(i > 0, F.lit(SEP)).otherwise("").alias("text"), off.alias("loss")),
        F.struct(escape(t).alias("text"), loss.alias("loss")))))
    return F.concat(F.array(F.struct(head.alias("text"), off.alias("loss"))), body,
                    F.array(F.struct(F.lit(END).alias("text"), off.alias("loss"))))


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, formatted, loss_spans
    (code point offsets, end exclusive)."""
    turns = (rows.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    seg = (turns.select("conv_id", messages(F.col("turns")).alias("messages"))
           .select("conv_id", F.flatten(F.transform("messages", _segments)).alias("seg")))
    spans = F.aggregate(
        "seg",
        F.struct(F.lit(0).alias("pos"),
                 F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["pos"] + F.char_length(s["text"])).alias("pos"),
            F.when(s["loss"], F.array_append(acc["spans"], F.struct(
                acc["pos"].alias("start"),
                (acc["pos"] + F.char_length(s["text"])).alias("end"))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return seg.select("conv_id",
                      F.array_join(F.transform("seg", lambda s: s["text"]), "").alias("formatted"),
                      spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """formatted, loss_spans -> also turns (role, text structs) and loss_text."""
    def parse(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.char_length(role) + 2,
                           F.char_length(block) - F.char_length(role) - 1 - len(END))
        plain_role = unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        return F.transform(F.split(body, _literal(SEP), -1), lambda t: F.struct(
            plain_role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", _literal(START), -1), lambda b: b != "")
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return chats.select("*", F.flatten(F.transform(blocks, parse)).alias("turns"),
                        F.array_join(loss, "").alias("loss_text"))
