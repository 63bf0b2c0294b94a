"""Resampling towards a target: documents are drawn by how much their hashed n-grams look like the target's.

One overlapped regular-expression scan of a text, whose separators are collapsed
to single blanks, emits the spans of all n-grams; each is counted in a bucket of
its CRC. Bucket counts of the corpus and of the target give a gain per bucket, a
document's weight is the sum of its gains, and Gumbel noise drawn from its key
turns the weights into a sample without replacement: the highest noisy scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import saved

WIDTH = 3
BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
#: Hundredths of the eligible documents that are drawn.
PERCENT = 5
#: What is no part of a word, once A-Z are lower-cased.
SEPARATORS = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scanner(width: int = WIDTH):
    """A pattern that matches, from a word's start, the word and up to ``width - 1`` words behind it, one group for each."""
    import regex

    # A word starts behind a blank or at the text's start and ends before one or at the text's end.
    behind = b"( [^ ]++)?+" * (width - 1)
    return regex.compile(rb"(?<![^ ])([^ ]++)" + behind + rb"(?![^ ])")


def feature_codes(text: str | None, separators, spans) -> tuple[int, list[int]]:
    """Words of ``text``, and the CRC-32 of every run of them in order of their starts; a run's code continues that of the shorter one."""
    from zlib import crc32

    if not text:
        return 0, []
    flat = separators.sub(b" ", text.encode().lower()).strip()
    words, codes = 0, []
    for found in spans.finditer(flat, overlapped=True):
        words += 1
        code = 0
        for part in found.groups():
            if part is None:
                break
            code = crc32(part, code)
            codes.append(code)
    return words, codes


def hashed_features(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, found``: the buckets of all features of a row in ascending order, as 16-bit numbers.

    A NULL or empty text, or one without a word, has none.
    """
    if not 0 < buckets <= 65_536:
        raise ValueError("buckets are numbered by 16 bits")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        separators, spans = regex.compile(SEPARATORS), scanner(width)
        for batch in batches:
            words, sizes, found = [], [], []
            for text in batch.column(1):
                count, codes = feature_codes(text.as_py(), separators, spans)
                words.append(count)
                sizes.append(len(codes))
                found.append(np.sort((np.array(codes, dtype=np.uint32) % buckets).astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "n_words", "n_features", "found"],
            )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, found binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all rows in each bucket. A task adds its rows up and sends one number for each bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for found in batch.column(0):
                total += np.bincount(np.frombuffer(found.as_py(), dtype="<u2"), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    told = features.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in told.collect():  # one row for each bucket at most
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(share in the target / share in the corpus)) for each bucket, one added to every count."""
    import math

    size, aim, n = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return [math.floor(1000 * math.log((t + 1.0) * (size + n) / ((s + 1.0) * (aim + n)))) for s, t in zip(corpus, target, strict=True)]


def _weighted(features: DataFrame, gains: list[int]) -> DataFrame:
    """The features' rows with their ``weight``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worth = np.array(gains, dtype=np.int64)
        for batch in batches:
            weights = [int(worth[np.frombuffer(f.as_py(), dtype="<u2")].sum()) for f in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "found").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: str, seed: int = SEED):
    """Gumbel noise in thousandths, from the first 32 bits of the digest of ``seed:key``; a NULL key counts as the empty text."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked_top(rows: DataFrame, order: list, wanted: int) -> DataFrame:
    """``rows`` with ``rank``, 1 to ``wanted`` by ``order`` and NULL behind; ``order`` must tell all rows apart.

    The rows are range-partitioned and written; a row's rank is its place in its
    range behind all earlier ranges, whose sizes are one row each.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.join(F.broadcast(sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))), "_part")
    rank = (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).cast("long")
    return placed.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("_part", "_before")


def importance_resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, n_words, n_features, weight, score, rank``.

    ``score`` is the weight plus the key's noise, in thousandths. Of the N rows
    with at least ``min_words`` words the floor(percent * N / 100) highest scores
    are drawn and ranked 1, 2, 3...; ``rank`` is NULL for all others. Ties go to
    the smaller key (NULL first), then to fewer features; rows of one key share
    their noise, and rows alike in key and score are ranked side by side. A NULL
    or empty text has weight 0. An empty ``docs`` gives no rows; an empty target
    gives every bucket the target count 0. Other columns of ``docs`` are not read.
    """
    features = saved(hashed_features(docs, key, text, width, buckets))
    aim = hashed_features(target.select(F.lit(0).alias("_no"), F.col(target_text)), "_no", target_text, width, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(aim, buckets))
    scored = _weighted(features, gains).withColumn("score", F.col("weight") + noise("doc_id", seed))
    # The number tells rows alike in all else apart; it holds as the table is written before it is used.
    scored = saved(scored.withColumn("_row", F.monotonically_increasing_id()))
    fit = scored.filter(F.col("n_words") >= min_words)
    share = min(max(1 - percent / 100 - 0.001, 0.0), 1.0)
    count, bar = fit.agg(F.count(F.lit(1)), F.percentile_approx("score", share, 10_000)).first()
    wanted = percent * count // 100
    blank = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, blank)
    # Only rows above a bar that lies under the cut are put in order.
    near = (F.col("n_words") >= min_words) & (F.col("score") >= bar)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("_row")]
    drawn = ranked_top(scored.filter(near), order, wanted)
    return scored.filter(~near).select(*columns, blank).unionByName(drawn.select(*columns, "rank"))
