"""Chat transcripts with typed content parts, built from DataFrame functions only.

A visitor walks over the parts of a turn: text is written with its control
strings escaped, other parts become ordered placeholders that record where they
come from and how many tokens they take up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


def escape(text: Column) -> Column:
    """Text in which no control string can begin, not even at the seam of two texts: a backslash follows each ``<``."""
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    halves = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def text_parts(text: Column) -> Column:
    """A content of one text part; NULL is the empty text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    ))


def part_tokens(part: Column, patch: int = 28, per_second: float = 25.0, per_page: int = 1024) -> Column:
    """Tokens an attachment expands to: image patches, audio frames or document pages, and one if its extent is unknown."""
    return F.greatest(F.lit(1).cast("long"), F.coalesce(
        F.when(part["kind"] == "image", F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch))
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * per_second))
        .when(part["kind"] == "document", part["pages"].cast("long") * per_page).cast("long"), F.lit(1).cast("long"),
    ))


def visit(parts: Column) -> tuple[Column, Column]:
    """The written content of a turn, and its attachments ``(part, kind, ref, tokens)`` in the order of their placeholders.

    A NULL part or kind counts as an empty text; an unknown kind is written as a
    placeholder of that name, with one token.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    written = F.transform(parts, lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("")))
    holder = F.transform(parts, lambda p: F.when(is_text(p), F.lit("")).otherwise(F.concat(F.lit("<|"), F.regexp_replace(p["kind"], r"[<|>\\]", "_"), F.lit("|>"))))
    body = F.array_join(F.zip_with(F.transform(written, escape), holder, lambda a, b: F.concat(a, b)), "")
    found = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda a: F.coalesce(a["kind"], F.lit("text")) != "text",
    )
    return body, found


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: ``conv_id, n_turns, formatted, learned, spans, attachments, attachment_tokens``.

    ``formatted`` holds the turns in order; ``learned`` tells for each whether
    its content is under the loss mask, and ``spans`` gives the start and end of
    those contents as character positions. Turns with equal numbers follow by
    role and content; NULL numbers come first, a NULL role is the empty one, and
    rows with a NULL conversation form one. No rows give no rows.
    """
    body, found = visit(F.col(parts))
    flat = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), body.alias("body"), found.alias("found"))
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    written = flat.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "found", F.char_length(head).alias("head"), F.char_length("body").alias("length"),
        F.concat(head, "body", F.lit(END)).alias("line"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "line")
    placed = written.withColumns({
        "at": F.row_number().over(order), "end": F.sum(F.char_length("line").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    begin = F.col("end") - F.char_length("line") + F.col("head")
    item = F.struct(
        "at", "line", F.col("role").isin(*learn).alias("learned"), F.struct(begin.alias("start"), (begin + F.col("length")).alias("stop")).alias("span"), "found",
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.col("items")
    attached = F.flatten(F.transform(items, lambda t: F.transform(
        t["found"], lambda a: F.struct((t["at"] - 1).alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
    )))
    return grouped.select(
        "conv_id", F.size(items).cast("long").alias("n_turns"), F.array_join(items["line"], "").alias("formatted"), items["learned"].alias("learned"),
        F.filter(items, lambda t: t["learned"])["span"].alias("spans"), attached.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a transcript without attachments as ``array<struct<role, text>>``; each text as it was before."""
    lines = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.struct(
        _role_back(F.substring_index(F.substr(line, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(line, F.locate("\n", line) + 1)).alias("text"),
    ))
