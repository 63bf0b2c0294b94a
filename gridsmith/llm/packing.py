"""Batches with little padding: optimal length buckets and token budgets.

The histogram of all lengths is gathered on the cluster; dynamic programming
chooses the bucket boundaries with the least padding; inside a bucket, documents
in hash order fill batches of a fixed number of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import saved

BUCKETS = 16
BUDGET = 32_768
#: Lengths up to this count exactly; above, they are rounded up by less than 1/256.
EXACT = 2048
#: Rows that are put into order together.
SEGMENT = 50_000


def word_count(text: str = "text") -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rounded(length: Column) -> Column:
    """Lengths as the histogram sees them: at most ``EXACT`` plus 256 for each doubling."""
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(length, F.lit(EXACT)) / F.lit(float(EXACT)))) + 2)
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding over (length, rows), the last length among them."""
    import numpy as np

    if not histogram:
        return []
    lengths, rows = (np.array(x, dtype=float) for x in zip(*sorted(histogram), strict=True))
    size = len(lengths)
    counted, used = np.append(0.0, np.cumsum(rows)), np.append(0.0, np.cumsum(rows * lengths))
    cost = np.full(size + 1, np.inf)
    cost[0] = 0.0
    cuts = []
    for _ in range(min(buckets, size)):
        new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=int)
        new[0] = 0.0
        for end in range(1, size + 1):
            tried = cost[:end] + lengths[end - 1] * (counted[end] - counted[:end]) - (used[end] - used[:end])
            cut[end] = int(tried.argmin())
            new[end] = tried[cut[end]]
        cost = new
        cuts.append(cut)
    out, end = [], size
    for cut in reversed(cuts):
        if end == 0:
            break
        out.append(int(lengths[end - 1]))
        end = int(cut[end])
    return sorted(out)


def pack(
    docs: DataFrame, key: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, segment: int = SEGMENT,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, length, bucket, boundary, batch, slot``.

    ``boundary`` is the length that a batch of its bucket is padded to, and
    boundary times rows stays within ``budget``; a document longer than the
    budget has a batch to itself. ``batch`` counts from 0 within the bucket and
    ``slot`` within the batch; only the last batch of a bucket is not full.
    Documents without words (NULL or empty) have length 0. Repeated and NULL keys
    are rows like any other; no rows give no rows.
    """
    spark = docs.sparkSession
    length = word_count() if length is None else length
    rows = saved(docs.select(F.col(key).cast("long").alias("doc_id"), length.cast("long").alias("length")).withColumn("upper", rounded(F.col("length"))))
    histogram = [(r.upper, r.n) for r in rows.groupBy("upper").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = best_boundaries(histogram, buckets)
    if not bounds:
        return rows.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    segments = max(1, -(-sum(n for _, n in histogram) // segment))
    # A bucket is the number of boundaries below the rounded length.
    bucket = sum((F.col("upper") > b).cast("int") for b in bounds)
    hashed = rows.select("doc_id", "length", bucket.alias("bucket"), F.xxhash64("doc_id", F.lit(11)).alias("order"))
    # Repeated keys share a hash; the length spreads nothing, so a draw by row keeps such a group from one segment.
    hashed = hashed.withColumn("segment", F.pmod(F.xxhash64("order", F.monotonically_increasing_id()), F.lit(segments)).cast("int"))
    placed = saved(hashed.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "segment").orderBy("order", "doc_id"))))
    counts = placed.groupBy("bucket", "segment").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(
        "bucket", "segment", (F.sum("n").over(Window.partitionBy("bucket").orderBy("segment")) - F.col("n")).alias("ahead")
    )
    boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    in_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(boundary, F.lit(1))).cast("long"))
    rank = F.col("ahead") + F.col("place") - 1
    return placed.join(ahead, ["bucket", "segment"]).select(
        "doc_id", "length", "bucket", boundary.alias("boundary"), F.floor(rank / in_batch).cast("long").alias("batch"), F.pmod(rank, in_batch).alias("slot")
    )
