"""Chat formatting with typed content parts (DataFrame expressions only).

A turn's content is an array of parts ``struct<kind, text, ref, units>``: kind
``text`` carries text; ``image``, ``audio`` and ``document`` carry a reference
and a size in units (patches, seconds, pages). ``flatten_parts`` visits them
in order: text is escaped, every other part becomes one placeholder, its
reference is recorded with its ordinal, and the tokens it will expand to are
counted. ``format_chat`` joins the turns of a conversation in a template that
``parse_chat`` reads back exactly.

Control strings of any vocabulary begin with ``<`` or ``[``, so every one of
these characters in a text gets a backslash behind it, and backslashes are
doubled: no control string survives, known or not, and unescaping is exact.

Defined cases: null text or role is empty; null units count as none; a null
part or a part of unknown kind is skipped; turns are ordered by (turn, role,
content), nulls first, so ties and repeated rows give one order; rows with a
null id form one conversation; an empty table gives an empty result; other
columns are ignored, whatever their names. A conversation is one row of output
and so one value of its task; what it costs is in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import let

START, SEP, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Tokens that one unit of a part expands to.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 512}
MASK_ROLE = "assistant"


def escape(c: Column) -> Column:
    """Backslashes are doubled and each ``<`` and ``[`` gets one behind it;
    :func:`unescape` undoes both."""
    doubled = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])", r"$1\\")


def escape_role(c: Column) -> Column:
    """As escape, for one line: a line end becomes ``[n``, which no escaped text holds."""
    return F.regexp_replace(escape(c), SEP, "[n")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def flatten_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add ``content`` (escaped text with placeholders), ``attachments``
    (array of struct<ord, kind, ref, tokens>) and ``expanded_tokens``."""
    p = F.filter(F.coalesce(F.col(parts), F.array().cast(df.schema[parts].dataType)), lambda x: x["kind"].isin("text", *TOKENS_PER_UNIT))
    media = F.filter(p, lambda x: x["kind"] != "text")

    def tokens(x):
        per = F.lit(0)
        for kind, n in TOKENS_PER_UNIT.items():
            per = F.when(x["kind"] == kind, F.lit(n)).otherwise(per)
        return F.coalesce(x["units"], F.lit(0)).cast("long") * per

    attachments = F.transform(media, lambda x, i: F.struct(i.alias("ord"), x["kind"].alias("kind"), x["ref"].alias("ref"), tokens(x).alias("tokens")))
    piece = F.transform(p, lambda x: F.when(x["kind"] == "text", escape(x["text"])).otherwise(F.concat(F.lit("<|"), x["kind"], F.lit("|>"))))
    return df.withColumns(
        {
            "content": F.array_join(piece, ""),
            "attachments": attachments,
            "expanded_tokens": F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + tokens(x)),
        }
    )


def text_part(c: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("units")))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_spans`` (array of
    struct<start, length, turn> in characters of ``formatted``, covering the
    assistants' escaped contents, with the turn's ordinal), ``attachments`` in order of appearance and
    ``expanded_tokens``."""
    flat = flatten_parts(df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(parts).alias("parts")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(SEP))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumns({"head": head, "size": F.char_length(head) + F.char_length("content") + len(END)})
    flat = flat.withColumns({"ordinal": F.row_number().over(ordered) - 1, "start": F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head")})
    turns = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "head", "content", "start", "attachments", "expanded_tokens"))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["role"] == MASK_ROLE)
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["start"].cast("int").alias("start"), F.char_length(t["content"]).alias("length"), t["ordinal"].alias("turn"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["expanded_tokens"]).alias("expanded_tokens"),
    )


def _segments(formatted: Column) -> Column:
    """The turns as they stand, without their start marks. A text holds no mark,
    so splitting at them is exact."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct<role, text>,
    unescaped."""

    def turn(t):
        at = F.instr(t, SEP)
        return F.struct(
            unescape(F.regexp_replace(F.substring(t, F.lit(1), at - 1), r"\[n", SEP)).alias("role"),
            unescape(F.substring(t, at + 1, F.char_length(t) - at - len(END))).alias("text"),
        )

    return F.transform(_segments(formatted), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans. Each
    span is cut from its own turn, not from the start of the conversation."""

    def under(turns):
        return F.array_join(F.transform(spans, lambda s: let(F.get(turns, s["turn"]), lambda t: unescape(F.substring(t, F.instr(t, SEP) + 1, s["length"])))), "")

    return let(_segments(formatted), under)
