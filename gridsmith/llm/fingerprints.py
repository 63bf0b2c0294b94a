"""Document fingerprints that add up: a homomorphic multiset hash over paragraphs.

A paragraph is hashed to a wide vector. Its first lanes come from a cryptographic
hash of the paragraph; the further lanes count, for each bit of a hash, the
neighbouring word pairs of the paragraph that set it. A document is the sum of
its paragraphs, each lane modulo 2^32, so the order of paragraphs does not
matter, and paragraphs can be added or taken away without the rest of the text.
The pair lanes also tell how much two documents have in common. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG = 8
PAIRS = 64
LANES = STRONG + PAIRS + 1
MODULUS = 1 << 32
#: Rows that one stretch of keys should hold when the next document is looked up, and the most stretches.
STRETCH = 4000
STRETCHES = 20_000

_BLANKS = r"[ \t\x0B-\r]+"


def _lane_sums(paragraph: Column, pair: Column, first: Column) -> list[Column]:
    """Sums that hold all lanes; two pair lanes share a long, so 2^31 pairs fit."""
    digest = F.sha2(paragraph, 256)
    strong = [
        F.sum(F.when(first, F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long"))).alias(f"s{i}") for i in range(STRONG)
    ]
    both = (1 << 32) | 1
    pairs = [F.sum(F.shiftright(pair, i).bitwiseAND(F.lit(both))).alias(f"p{i}") for i in range(PAIRS // 2)]
    return [*strong, *pairs, F.count(pair).alias("n")]


def _lanes() -> Column:
    sums = [F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(STRONG)]
    packed = [F.coalesce(F.col(f"p{i}"), F.lit(0)) for i in range(PAIRS // 2)]
    low = [p.bitwiseAND(F.lit(MODULUS - 1)) for p in packed]
    high = [F.shiftrightunsigned(p, 32) for p in packed]
    return F.array(*[F.pmod(s.cast("long"), F.lit(MODULUS)) for s in sums], *[x.cast("long") for x in (*low, *high)], F.col("n").cast("long"))


def fingerprint_lanes(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``lanes``, one row for each different ``keys``; rows that share keys are added up.

    Paragraphs are the lines with more than blanks. NULL and empty texts and
    texts of blanks have zero lanes. Rows already dealt out by some of the keys
    are not shuffled again.
    """
    lines = rows.select(*keys, F.explode_outer(F.split(F.col(text), "\n")).alias("_line"))
    lines = lines.withColumn("_line", F.when(F.col("_line").rlike(r"[^ \t\x0B-\r]"), F.btrim("_line", F.lit(" \t\x0b\x0c\r"))))
    words = F.split("_line", _BLANKS)
    # The last word of a line stands alone, so a line of one word counts too.
    units = lines.select(*keys, "_line", F.posexplode_outer(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))).alias("_at", "_unit"))
    pair = F.when(F.col("_line").isNotNull(), F.xxhash64(F.col("_unit")["a"], F.col("_unit")["b"]))
    first = F.col("_line").isNotNull() & (F.col("_at") == 0)
    return units.groupBy(*keys).agg(*_lane_sums(F.col("_line"), pair, first)).select(*keys, _lanes().alias("lanes"))


def add(a: Column, b: Column) -> Column:
    """Lanes of both documents together, or of a document with paragraphs inserted."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def remove(a: Column, b: Column) -> Column:
    """Lanes of the document ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def as_text(lanes: Column) -> Column:
    """The fingerprint: eight hex digits for each lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the two documents' word pairs as their lanes tell it, 0 to 1; 1 for equal lanes."""

    def dot(x, y):
        n, m = F.element_at(x, LANES).cast("double"), F.element_at(y, LANES).cast("double")
        pairs = F.zip_with(F.slice(x, STRONG + 1, PAIRS), F.slice(y, STRONG + 1, PAIRS), lambda p, q: (p * 2.0 - n) * (q * 2.0 - m))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, lanes`` for every row; rows with one key are added up, so keys should be unique."""
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return fingerprint_lanes(own, ["doc_id"], "_text").select("doc_id", as_text(F.col("lanes")).alias("fingerprint"), "lanes")


def in_stretches(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``stretch``, ascending with the key, and the first row of each stretch also at the end of the one before.

    Those copies have ``copied`` set, so the next row of every row lies in its own stretch.
    """
    bounds = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    cells = max(1, min(STRETCHES, -(-bounds.n // stretch)))
    if bounds.low is None:
        cells, step = 1, 1
    else:
        step = max(1, -(-(bounds.high - bounds.low + 1) // cells))
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(bounds.low or 0)) / F.lit(step)).cast("int"), F.lit(0))
    rank = F.struct("doc_id", F.xxhash64("text").alias("tie"))
    own = docs.select("doc_id", "text", cell.alias("stretch"), F.lit(False).alias("copied"))
    firsts = own.groupBy("stretch").agg(F.min_by(F.struct("doc_id", "text"), rank).alias("row"))
    present = sorted(r.stretch for r in own.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select("stretch").collect())
    before = {s: present[i - 1] for i, s in enumerate(present)}
    if not before:
        return own
    earlier = F.element_at(F.array(*[F.lit(before.get(i, 0)) for i in range(cells)]), F.col("stretch") + 1)
    return own.unionByName(firsts.select("row.doc_id", "row.text", earlier.alias("stretch"), F.lit(True).alias("copied")))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has its last half replaced by the start of the next document
    in the order of keys (of the first one after the last); rows with one key
    follow in the order of a hash of their text, NULL keys come first. Returns a
    row for every row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. One document is its own next.
    The texts are shuffled once.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("stretch").orderBy("copied", "doc_id", F.xxhash64("text"))
    dealt = in_stretches(own, stretch).repartition("stretch")
    told = dealt.select("stretch", "copied", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next", F.lit("")), F.lit(1), half))
    keys = ["stretch", "place", "copied", "doc_id", "n_chars", "edited_sha256", "version"]
    both = told.select("stretch", "place", "copied", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn(
        "edited_sha256", F.sha2(F.col("edited"), 256)
    )
    versions = both.select(*keys[:-1], F.posexplode(F.array("text", "edited")).alias("version", "body"))
    lanes = fingerprint_lanes(versions, keys, "body")
    pick = lambda v: F.max(F.when(F.col("version") == v, F.col("lanes")))
    found = lanes.groupBy(*keys[:-1]).agg(pick(0).alias("lanes"), pick(1).alias("edited"))
    following = Window.partitionBy("stretch").orderBy("copied", "place")
    return found.withColumn("next", F.lead("lanes").over(following)).filter(~F.col("copied")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("next")).alias("near_next"),
    )
