"""Chat formatting by a round trip through a grammar: turns are rendered, the rendered text is
parsed again by a deterministic parser, and turns that don't come back as they were are escaped,
until they do.

Grammar: conversation = turn*; turn = OPEN role NL text CLOSE NL. OPEN and CLOSE begin with "<|".
The parser always takes one backslash out of "<\\...\\|" (one or more backslashes), so escaping is
adding one backslash between "<" and "|", and a text that needs no escape is rendered unchanged.
A role is percent-encoded when it is escaped, and always decoded.

The loss mask is a list of spans of the rendered text, in code points: each assistant's text, escaped as it
is there, without its marks. What is learnt is read by cutting the spans out of the rendered text and taking the escapes out of them.

All columns are built-in functions; the only shuffle is the grouping by conversation.

Results for odd inputs: a null text or role counts as empty; turns are ordered by turn, then role,
then text (nulls first), and repeated rows are repeated turns; rows with a null conv_id are one
conversation, as they can't be told apart; an empty table gives no rows. Further columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_NEWLINE = "\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.url_encode(role)


def unescape_role(role: Column) -> Column:
    return F.coalesce(F.try_url_decode(role), role)


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of structs (role, text)."""
    role = (lambda c: escape_role(c)) if escaped else (lambda c: c)
    text = (lambda c: escape_text(c)) if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t["role"]), F.lit(_NEWLINE), text(t["text"]), F.lit(CLOSE + _NEWLINE))), "")


def loss_spans(turns: Column, escaped: bool) -> Column:
    """Where the assistant's texts lie in render(turns, escaped): array of structs (start, length), start from 0."""
    role = (lambda c: escape_role(c)) if escaped else (lambda c: c)
    text = (lambda c: escape_text(c)) if escaped else (lambda c: c)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        before = acc["at"] + len(OPEN) + F.length(role(turn["role"])) + len(_NEWLINE)
        length = F.length(text(turn["text"]))
        spans = F.when(turn["role"] == "assistant", F.array_append(acc["spans"], F.struct(before.alias("start"), length.alias("length")))).otherwise(acc["spans"])
        return F.struct((before + length + len(CLOSE + _NEWLINE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def under_mask(rendered: Column, spans: Column) -> Column:
    """The texts of the spans, as they were before they were escaped."""
    return F.transform(spans, lambda s: unescape_text(F.substring(rendered, s["start"] + 1, s["length"])))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text: array of structs (role, text). A text with a bare "<|" in it is outside the grammar and comes back as null."""
    blocks = F.split(rendered, r"<\|im_end\|>\n?")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turn(block: Column) -> Column:
        body = F.substring(block, len(OPEN) + 1, F.length(block))
        at = F.instr(body, _NEWLINE)
        text = F.substring(body, at + 1, F.length(body))
        return F.struct(unescape_role(F.left(body, at - 1)).alias("role"), F.when(~F.contains(text, F.lit("<|")), unescape_text(text)).alias("text"))

    return F.transform(blocks, turn)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (source), formatted, escaped (whether it had to be), loss_spans (of formatted), recovered (turns read back)."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list("one")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = conversations.select("conv_id", one.alias("one")).groupBy("conv_id").agg(turns.alias("turns"))
    plain = grouped.withColumn("plain", render(F.col("turns"), False))
    # Only what begins like a mark, or has an escape already, can come back changed; the others are spared the second rendering.
    tried = plain.withColumn("same", parse(F.col("plain")).eqNullSafe(F.col("turns")))
    turns = F.col("turns")
    out = tried.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(render(turns, True)))
    out = out.withColumn("loss_spans", F.when(F.col("same"), loss_spans(turns, False)).otherwise(loss_spans(turns, True)))
    return out.select("conv_id", "turns", "formatted", (~F.col("same")).alias("escaped"), "loss_spans").withColumn("recovered", parse(F.col("formatted")))


def digests(chats: DataFrame) -> DataFrame:
    """What formatted() holds, as numbers and digests of what is read back from the rendered text."""
    recovered = F.col("recovered")
    said = F.array_join(F.transform(recovered, lambda t: F.concat(t["role"], F.lit(_NEWLINE), t["text"], F.lit(_NEWLINE))), "")
    lost = F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id",
        F.size(recovered).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        recovered.eqNullSafe(F.col("turns")).alias("round_trip"),
    )
