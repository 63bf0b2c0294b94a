"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by a hash of their text and then by key, so equal texts lie
together. Keys drawn in proportion to their size give the splitters of many
small ranges; ranges that come out overfull are divided again. Exact byte sums of
the ranges then place every text on one line of bytes, which is cut into equal
parts.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.llm.common import saved

SHARDS = 24
#: Ranges for each shard; more of them when a range would hold over ROWS rows.
RANGES = 32
ROWS = 500_000
#: Samples drawn for each range.
DRAWS = 8
#: A group of equal texts under this part of a shard stays in one shard; a larger one is cut between its rows.
WHOLE = 0.05
ROUNDS = 3


def _draw(rows: DataFrame, share: Column, seed: int) -> DataFrame:
    """Rows kept with probability ``share``, decided by a hash of their key."""
    return rows.filter(F.pmod(F.xxhash64("hash", "doc_id", "row", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def _splitters(sample: list, parts: int) -> list[tuple]:
    """Quantile boundaries of a weighted sample of (hash, row hash, weight)."""
    sample = sorted(sample)
    total, held, out = sum(w for *_, w in sample), 0.0, []
    for h, r, w in sample:
        held += w
        if held >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append((h, r))
            while held >= total * (len(out) + 1) / parts and len(out) < parts - 1:
                out.append((h, r))
    return sorted(set(out))


def _ranged(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``rows`` with ``range``, the number of splitters that do not lie behind the row."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])
    h, r = rows.columns.index("hash"), rows.columns.index("row")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cuts = shared.value
        first = np.array([c[0] for c in cuts], dtype=np.int64)
        for batch in batches:
            hashes = batch.column(h).to_numpy()
            low, high = np.searchsorted(first, hashes, "left"), np.searchsorted(first, hashes, "right")
            own = batch.column(r)
            for i in np.flatnonzero(low != high):  # a text that is a splitter itself
                low[i] = bisect_right(cuts, (int(hashes[i]), own[int(i)].as_py()), int(low[i]), int(high[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], schema=pa.schema([*batch.schema, ("range", pa.int32())]))

    return rows.mapInArrow(run, schema)


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", ranges: int = RANGES, rows_in_range: int = ROWS, whole: float = WHOLE,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` counts the UTF-8 bytes of the text (NULL has none) plus 8, and the
    shards' sums of it come out nearly equal. ``slot`` numbers the rows of a
    shard without gaps from 0. Equal texts stay in one shard as long as they take
    up less than ``whole`` of it. NULL and repeated keys are rows like any other;
    with fewer texts than shards some shards are empty; no rows give no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = saved(docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"), F.xxhash64(F.col(key).cast("long"), F.lit(5)).alias("row"),
    ))
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total.rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(shards * ranges, -(-total.rows // rows_in_range))
    # At most shards / whole texts can be this large.
    large = {r.hash for r in rows.groupBy("hash").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > whole * total.bytes / shards).collect()}

    def drawn(source, share, least, seed):
        found = _draw(source, share, seed).select("hash", "row", F.greatest(F.col("size").cast("double"), F.lit(least)).alias("w")).collect()
        # Only a large text may be cut between its rows.
        return [(r.hash, r.row if r.hash in large else -(1 << 63), r.w) for r in found]

    least = total.bytes / (parts * DRAWS)
    cuts = _splitters(drawn(rows, F.col("size") / F.lit(least), least, 1), parts)
    for seed in range(2, 2 + ROUNDS):
        placed = _ranged(rows, cuts)
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("texts"))
        counted = {r["range"]: r for r in sizes.collect()}
        full = {k: r for k, r in counted.items() if r.bytes > 2 * total.bytes / parts and r.rows > 1 and (r.texts > 1 or r.rows > rows_in_range)}
        if not full or seed == 1 + ROUNDS:
            break
        finer = least / 4
        inside = placed.join(F.broadcast(spark.createDataFrame([(k,) for k in full], "range int")), "range")
        again: dict[int, list] = {}
        for h, r, w in drawn(inside, F.col("size") / F.lit(finer), finer, seed):
            again.setdefault(bisect_right(cuts, (h, r)), []).append((h, r, w))
        more = {c for k, sample in again.items() for c in _splitters(sample, 2 + int(counted[k].bytes * parts / total.bytes) if k in counted else 2)}
        if more <= set(cuts):
            break
        cuts = sorted(set(cuts) | more)
        least = finer

    starts, at = [], 0
    placed = _ranged(rows, cuts)
    counted = {r["range"]: r.bytes for r in placed.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    for k in range(len(cuts) + 1):
        starts.append(at)
        at += counted.get(k, 0)
    begin = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "range int, start long"))  # one row a range
    huge = F.broadcast(spark.createDataFrame([(h,) for h in sorted(large)], "hash long").withColumn("is_large", F.lit(True)))

    line = Window.partitionBy("range").orderBy("hash", "text_crc32", "size", "doc_id")
    group = Window.partitionBy("range", "hash", "text_crc32", "size")
    told = placed.join(begin, "range").join(huge, "hash", "left").repartition("range")
    told = told.withColumn("before", F.col("start") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    one = F.col("is_large").isNotNull()
    middle = F.when(one, F.col("before") + F.col("size") / 2).otherwise(F.min("before").over(group) + F.sum("size").over(group) / 2)
    sharded = told.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(total.bytes))), F.lit(shards - 1)).cast("int"))
    numbered = saved(sharded.select(
        "doc_id", "size", "text_crc32", "range", "shard", F.row_number().over(Window.partitionBy("range", "shard").orderBy("hash", "text_crc32", "size", "doc_id")).alias("place")
    ))
    counts = sorted((r.shard, r["range"], r.n) for r in numbered.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, seen = [], {}
    for s, k, n in counts:  # at most one row a range and shard
        offsets.append((s, k, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    ahead = F.broadcast(spark.createDataFrame(offsets, "shard int, range int, ahead long"))
    return numbered.join(ahead, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("place") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", files: int = 8) -> None:
    """Write ``docs`` as Parquet folders ``shard=N`` of about ``files`` files each; keys must name one row each."""
    placed = assign_shards(docs, shards, key, text).select(F.col("doc_id").alias("_key"), F.col("shard").alias("_shard"))
    joined = docs.join(placed, F.col(key).cast("long").eqNullSafe(F.col("_key"))).drop("_key")
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    joined.repartition(shards * files, "_shard", part).withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
