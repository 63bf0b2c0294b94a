"""Language of a text by compression.

For every language a sample of its texts becomes a raw-content dictionary. A
text is compressed once with each dictionary and belongs to the language whose
dictionary makes it smallest; if the next language is as good, it is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import free_names, text_tie, without_rows

#: Texts drawn for a language, and the characters taken from each: the bounded sample that is learned.
SAMPLE = 384
PIECE = 400
DICTIONARY = 131_072
LEVEL = 6
#: Bytes of a text that are compressed together; the whole text is, piece by piece.
CHUNK = 2048
#: Languages within so many bytes are compressed again at this level, and both outputs count.
CLOSE = 3
CLOSER_LEVEL = 12
#: A text is rejected when the best language saves fewer bytes than this against the next.
MARGIN = 1
LANGUAGES = 256
UNKNOWN = "und"


def plain(text: str) -> bytes:
    """The text in lower case with single blanks, so that shouting and layout do not count."""
    return " ".join(text.lower().split()).encode()


def learn_dictionaries(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, piece: int = PIECE,
) -> dict[str, bytes]:
    """Language -> raw dictionary content, from texts drawn by a hash of key and text.

    Rows with a NULL or empty text or language teach nothing. Copies of one text
    are drawn at most once.
    """
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not counts:
        return {}
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 8.0 * sample / n)))])[F.col("lang")]
    order = F.xxhash64("key", F.lit(29))
    # A piece from anywhere in the text, so that openings do not weigh more than the rest.
    start = 1 + F.pmod(F.xxhash64("key", F.lit(31)), F.greatest(F.length("text") - piece, F.lit(1)))
    drawn = known.filter(F.pmod(order, F.lit(1_000_000)) < rate * 1_000_000).select(
        "lang", order.alias("order"), F.expr("text").substr(start.cast("int"), F.lit(piece)).alias("piece")
    )
    first = drawn.groupBy("lang", "piece").agg(F.min("order").alias("order"))
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))).filter(F.col("place") <= sample)
    out: dict[str, list] = {k: [] for k in sorted(counts)}
    for r in best.select("lang", "place", "piece").collect():
        out[r.lang].append((r.place, r.piece))
    # Matches near the end of a dictionary are the cheapest, so the order is fixed too.
    return {k: b"\n".join(plain(p) for _, p in sorted(v))[:DICTIONARY] for k, v in out.items() if v}


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", level: int = LEVEL, chunk: int = CHUNK, margin: int = MARGIN, tie: str | None = None,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, lang_pred, score, margin, rejected``.

    ``lang_pred`` is the language with the smallest output, ties going to the
    first name after a second look; ``und`` if the text is NULL or has no letter or nothing was
    learned. ``margin`` counts the bytes saved against the next language and
    ``score`` is 1 - 2^-margin. Rejected are unknown texts and those with a
    margin under ``margin`` (with one language there is no next: margin is the
    saving against no dictionary). A column ``tie`` of longs is handed through under its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    more = [tie] if tie else []

    def run(batches):
        import pyarrow as pa
        import zstandard as z

        names = sorted(shared.value)

        def packers(level):
            out = []
            for name in names:
                content = z.ZstdCompressionDict(shared.value[name], dict_type=z.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=level)
                out.append(z.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False))
            if len(names) == 1:
                out.append(z.ZstdCompressor(level=level, write_checksum=False, write_content_size=False))
            return out

        usual, closer = packers(level), packers(CLOSER_LEVEL)

        for batch in batches:
            out = []
            for body in batch.column(1):
                body = body.as_py()
                if not names or body is None or not any(c.isalpha() for c in body):
                    out.append((UNKNOWN, 0.0, 0, True))
                    continue
                data = plain(body)
                parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
                sizes = [sum(len(p.compress(x)) for x in parts) for p in usual]
                low, next_low = sorted(sizes)[:2]
                if next_low - low < CLOSE:
                    sizes = [s + sum(len(p.compress(x)) for x in parts) for s, p in zip(sizes, closer, strict=True)]
                best = min(range(len(names)), key=sizes.__getitem__)
                saving = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
                out.append((names[best], 1.0 - 2.0 ** -max(0, min(saving, 1000)), saving, saving < margin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:]] + [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))],
                ["doc_id", *more, "lang_pred", "score", "margin", "rejected"],
            )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    handed = "".join(f"{c} long, " for c in more)
    return own.mapInArrow(run, f"doc_id long, {handed}lang_pred string, score double, margin long, rejected boolean")


def drop_unknown(docs: DataFrame, teachers: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns.

    A decision holds for all rows of the same key and text, NULL keys too. Texts
    without a letter, NULL and empty ones among them, are rejected; an empty
    table gives no rows; other columns may have any names.
    """
    dictionaries = learn_dictionaries(teachers, key, text, lang)
    (tie,) = free_names(docs, "_tie")
    found = classify(docs.withColumn(tie, text_tie(text)), dictionaries, key, text, tie=tie)
    return without_rows(docs, key, text, found.filter("rejected").select("doc_id", tie))
