"""Chat formatting (operator 2), with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (then
role, then text, for repeated turn numbers). Adjacent turns of one role merge
into one block. The template is

    <|start|>ROLE<|message|>TEXT(<|next|>TEXT)*<|end|>

per block, where ROLE and TEXT are escaped: ``~`` becomes ``~0``, ``<`` ``~1`` and
``[`` ``~2``. Escaped text holds no ``<`` or ``[``, so no text can form a mark of this
template (or an instruction mark of another), and undoing the three
replacements restores every text exactly. ``loss_spans`` are (begin, length) in
code points of the assistant texts inside ``formatted``, one per turn.
``read_back`` parses ``formatted`` alone (and cuts out the loss text by the spans).

Defined cases: a null text or role is empty; a null conversation id is one
conversation of its own; repeated rows are turns of their own; an empty
table gives an empty result; other columns are not read. A conversation is one row and
is built in one task, as its formatted text is one value; no step takes the square of its number of turns but running
sums over groups of ``GROUP`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
# escape pairs, in the order of escaping
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
GROUP = 128  # turns whose lengths are added up, or texts cut out, together: appending to an array copies it


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def groups(array: str) -> Column:
    """The array column in consecutive groups of at most ``GROUP`` entries."""
    return F.when(
        F.size(array) > 0,
        F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / GROUP).cast("int")), lambda g: F.slice(array, g * GROUP + 1, F.lit(GROUP))),
    ).otherwise(F.slice(F.array(F.col(array)), 1, 0))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<begin, length>>, n_blocks: one row per conversation."""
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = turns.select(F.col(conv_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    # a block begins at the first turn and wherever the role differs from the turn before
    changes = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1).role != F.get("turns", i - 2).role))
    chats = chats.select("conv_id", "turns", changes.alias("begins"))
    ends = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns") + 1))
    blocks = F.zip_with("begins", ends, lambda b, e: F.struct(
        F.get("turns", b - 1).role.alias("role"), F.transform(F.slice("turns", b, e - b), lambda t: escape(t.text)).alias("texts")))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(
        F.lit(START), escape(b.role), F.lit(MESSAGE), F.array_join(b.texts, NEXT), F.lit(END)))
    # every text with its role and the length of the marks before it, in order
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b.texts, lambda x, i: F.struct(
        b.role.alias("role"), F.char_length(x).alias("size"),
        F.when(i == 0, F.char_length(escape(b.role)) + len(START) + len(MESSAGE)).otherwise(len(NEXT)).alias("lead"),
        F.when(i == F.size(b.texts) - 1, len(END)).otherwise(0).alias("tail"),
    ))))
    chats = chats.select("conv_id", F.array_join(body, "").alias("formatted"), F.size("blocks").cast("long").alias("n_blocks"), pieces.alias("pieces"))
    # running lengths in two levels: of whole groups of pieces, then inside each group
    chats = chats.select("conv_id", "formatted", "n_blocks", groups("pieces").alias("groups"))
    lengths = F.transform("groups", lambda g: F.aggregate(g, F.lit(0), lambda n, p: n + p.lead + p["size"] + p.tail))
    before = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<begin: INT, length: INT>>)")
    spans = F.flatten(F.zip_with("groups", F.slice(before, 1, F.size("groups")), lambda g, at: F.aggregate(
        g, F.struct(at.alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + p.lead + p["size"] + p.tail).alias("at"),
            F.when(p.role == loss_role, F.array_append(acc.spans, F.struct((acc.at + p.lead).alias("begin"), p["size"].alias("length")))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )))
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"), "n_blocks")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> parsed from ``formatted``, loss_texts cut out by ``loss_spans``, and both inputs."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")
    heads = F.transform(blocks, lambda b: F.struct(
        unescape(F.replace(F.substring_index(b, MESSAGE, 1), F.lit(START), F.lit(""))).alias("role"),
        F.split(F.substring_index(b, MESSAGE, -1), r"<\|next\|>", -1).alias("texts")))
    parsed = F.flatten(F.transform(heads, lambda b: F.transform(b.texts, lambda x: F.struct(b.role.alias("role"), unescape(x).alias("text")))))
    # a group of spans cuts its own stretch out of the text first, as ``substr`` counts code points from the beginning
    chats = chats.select("*", groups("loss_spans").alias("groups"))
    stretches = F.transform("groups", lambda g: F.struct(
        g.alias("spans"), g[0].begin.alias("at"),
        F.substr(F.col("formatted"), g[0].begin + 1, F.element_at(g, -1).begin + F.element_at(g, -1).length - g[0].begin).alias("text")))
    loss = F.flatten(F.transform(stretches, lambda x: F.transform(x.spans, lambda s: unescape(F.substr(x.text, s.begin - x["at"] + 1, s.length)))))
    return chats.select("conv_id", parsed.alias("turns"), loss.alias("loss_texts"), "formatted", "loss_spans", "n_blocks")


def digests(back: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )
