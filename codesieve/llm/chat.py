"""Chat formatting with column expressions alone: turns of a conversation become one marked text with a loss mask.

A block is ``<turn:ROLE>`` and a line feed, its texts, ``</turn>`` and a line feed. Adjacent turns of one role share a
block; ``<part>`` stands between their texts, so the original turns can be read back. Inside roles and texts a
backslash becomes ``\\b`` and the ``<`` of a control string ``\\l`` (in roles also ``>`` becomes ``\\g``): no control
string is left inside a text, and the escape is undone by two plain replacements. The loss mask is a list of spans of
the formatted text in UTF-8 bytes, one for each assistant text.

Cases: a null text or role is empty; rows with a null conversation id form one conversation; turns are ordered by
turn (null first), then role and text, so ties and repeated rows keep a defined place; an empty table gives no rows;
other columns are not used. A conversation is one row of the result and has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ("<turn:", "</turn>", "<part>")
OPEN, CLOSE, PART = "<turn:", "</turn>\n", "<part>"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it inside another lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def escape(text: Column) -> Column:
    out = _replace(text, "\\", "\\b")
    for control in CONTROL:
        out = _replace(out, control, "\\l" + control[1:])
    return out


def unescape(text: Column) -> Column:
    return _replace(_replace(text, "\\l", "<"), "\\b", "\\")


def escape_role(role: Column) -> Column:
    return _replace(_replace(_replace(role, "\\", "\\b"), "<", "\\l"), ">", "\\g")


def unescape_role(role: Column) -> Column:
    return _replace(_replace(_replace(role, "\\g", ">"), "\\l", "<"), "\\b", "\\")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conversation: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in UTF-8 bytes of ``formatted``)."""
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    sorted_rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    # a block starts where the role changes; array indexes below are zero-based
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                      lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = sorted_rows.select("conv_id", "turns", begins.alias("begins"))
    blocks = F.transform("begins", lambda start, k: F.struct(
        F.get("turns", start)["role"].alias("role"),
        F.transform(F.slice("turns", start + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - start),
                    lambda x: escape(x["text"])).alias("texts")))
    merged = cut.select("conv_id", blocks.alias("blocks"))

    # pieces in writing order: head, texts with separators, foot; each with its length and whether it bears loss
    def pieces(block: Column) -> Column:
        loss = block["role"].isin(*loss_roles)
        head = F.concat(F.lit(OPEN), escape_role(block["role"]), F.lit(">\n"))
        return F.concat(
            F.array(F.struct(head.alias("text"), F.lit(False).alias("loss"))),
            F.flatten(F.transform(block["texts"], lambda x, i: F.when(
                i == 0, F.array(F.struct(x.alias("text"), loss.alias("loss")))).otherwise(
                F.array(F.struct(F.lit(PART).alias("text"), F.lit(False).alias("loss")),
                        F.struct(x.alias("text"), loss.alias("loss")))))),
            F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))))

    written = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    # running ends of the pieces, as one array of numbers
    ends = F.aggregate("pieces", F.array(F.lit(0).cast("long")),
                       lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x["text"]))))
    spans = _let(ends, lambda e: F.filter(F.transform("pieces", lambda x, i: F.struct(
        F.get(e, i).alias("start"), F.octet_length(x["text"]).cast("long").alias("length"), x["loss"].alias("loss"))),
        lambda x: x["loss"]))
    return written.select(
        "conv_id", F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("formatted"),
        F.transform(spans, lambda x: x.dropFields("loss")).alias("loss_spans"))


def read_turns(formatted: str | Column) -> Column:
    """The original turns of a formatted text: array of struct<role, text>."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    # the first piece is what stands before the first block: nothing
    blocks = F.slice(F.split(formatted, OPEN), 2, 1 << 30)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ">\n", 1)
        body = F.substring(block, F.length(head) + 3, F.length(block) - F.length(head) - F.lit(2 + len(CLOSE)))
        return F.transform(F.split(body, PART), lambda x: F.struct(
            unescape_role(head).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss_texts(formatted: str, spans: str) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return _let(F.encode(F.col(formatted), "UTF-8"), lambda data: F.transform(spans, lambda s: unescape(F.decode(
        F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))))
