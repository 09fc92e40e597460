"""Chat formatting with typed content parts.

A message holds parts: text, image, audio or document. They are flattened in
order; a part other than text becomes a numbered placeholder, and its reference
and the tokens it expands to are recorded. Control strings inside texts are
escaped so that the formatted conversation can be read back exactly. DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Tokens a part expands to: an image's per 28 x 28 patch, audio's per second, a document's per page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 600

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"


def escape(text: Column) -> Column:
    r"""`\` becomes `\\` and `<|` becomes `<\|`, so no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_part(text: Column, more: Column) -> Column:
    r"""As `escape`; where `more` parts follow, a `<` at the end becomes `<\E`, so that it meets no `|` of theirs."""
    return F.concat(escape(text), F.when(more & text.endswith("<"), F.lit("\\E")).otherwise(F.lit("")))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<\\E"), F.lit("<")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As `escape`; a line break becomes `<\N`, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\N"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\N"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """Plain text as a list of one text part."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *empty)).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens a part other than text stands for; unknown sizes count as one unit, unknown types as none."""
    unit = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    patches = F.ceil(unit(part["width"]) / PATCH) * F.ceil(unit(part["height"]) / PATCH)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * PER_SECOND))
        .when(part["type"] == "document", unit(part["pages"]) * PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def visit(parts: Column, before: Column) -> Column:
    """Each part as (body, ref, tokens, attached); attachments count on from `before`."""
    attached = F.transform(parts, lambda p: F.when(F.coalesce(p["type"], F.lit("text")) == "text", 0).otherwise(1))
    number = lambda i: before + F.aggregate(F.slice(attached, 1, i + 1), F.lit(0), lambda s, x: s + x)
    return F.transform(
        parts,
        lambda p, i: F.when(
            F.coalesce(p["type"], F.lit("text")) == "text",
            F.struct(escape_part(F.coalesce(p["text"], F.lit("")), i < F.size(parts) - 1).alias("body"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("attached")),
        ).otherwise(
            F.struct(F.concat(F.lit("<|"), escape_role(p["type"]), F.lit("_"), number(i).cast("string"), F.lit("|>")).alias("body"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"), F.lit(1).alias("attached"))
        ),
    )


def format_chats(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, n_expanded) of each conversation.

    Takes `conv_id`, `turn`, `role` and an array of typed `parts`. Turns are put in
    order of turn, ties in order of role and content; null turns come first. A
    turn is `<|im_start|>role\\nbody<|im_end|>\\n`. `loss_spans` are (start,
    length) in code points of the bodies of assistant turns, the loss mask;
    `attachments` are (number, type, ref, tokens) in order. Null roles and texts
    count as empty, null parts as none; rows with a null conv_id are one
    conversation. Repeated rows are repeated turns. An empty table gives none. A
    conversation is one row of the result, so its texts must fit one row. Other
    columns are left aside.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    n_attached = lambda ps: F.size(F.filter(ps, lambda p: ~is_text(p)))
    # attachments before each turn, then the turns' parts one by one
    chats = chats.withColumn(
        "before",
        F.aggregate(
            F.transform("turns", lambda t: n_attached(t["parts"])),
            F.array(F.lit(0)),
            lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)),
        ),
    )
    chats = chats.withColumn("seen", F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), visit(t["parts"], F.get("before", i)).alias("parts"), t["parts"].alias("raw"))))
    chats = chats.withColumn(
        "pieces",
        F.transform(
            "seen",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                F.array_join(F.transform(t["parts"], lambda p: p["body"]), "").alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
    )
    chats = chats.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), ""))
    place = F.aggregate(
        "pieces",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    listed = F.filter(
        F.flatten(F.transform("seen", lambda t: F.zip_with(t["parts"], t["raw"], lambda p, r: F.struct(r["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), p["attached"].alias("attached"))))),
        lambda a: a["attached"] == 1,
    )
    attachments = F.transform(listed, lambda a, i: F.struct((i + 1).alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", place["spans"].alias("loss_spans"), attachments.alias("attachments"))
    return chats.withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The (role, body) of each turn, read back from a formatted conversation and unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    inner = F.transform(pieces, lambda x: F.substring_index(x, END, 1))
    return F.transform(
        inner,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
