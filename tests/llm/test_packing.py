import itertools
import random

from pyspark.sql import functions as F

from gridsmith.llm.packing import best_boundaries, pack, rounded


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        histogram = [(x, rng.randint(1, 9)) for x in sorted(rng.sample(range(0, 60), rng.randint(1, 9)))]
        lengths = [x for x, _ in histogram]
        for k in (1, 2, 3, 4):
            best = min(padding(histogram, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
            found = best_boundaries(histogram, k)
            assert len(found) <= k and found[-1] == lengths[-1] and padding(histogram, found) == best
    assert best_boundaries([], 4) == []


def test_rounding_is_close(spark):
    rows = spark.range(0, 200_000, 17).select("id", rounded(F.col("id")).alias("up")).collect()
    assert all(r.id <= r.up <= r.id * (1 + 1 / 256) + 1 and (r.id > 2048 or r.id == r.up) for r in rows)
    assert len({r.up for r in rows}) < 2048 + 256 * 8


def test_batches_hold_the_budget(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 300)) for i in range(2000)] + [(3000, None), (3001, ""), (3002, "w " * 50_000), (None, "a b"), (7001, "a"), (7001, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(-1)).withColumn("bucket", F.lit("b"))
    found = pack(docs, budget=2000, segment=150, buckets=6).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    lengths = {d: len((t or "").split()) for d, t in rows}
    batches = {}
    for r in found:
        assert r.length == lengths[r.doc_id] <= r.boundary
        batches.setdefault((r.bucket, r.boundary), {}).setdefault(r.batch, []).append(r.slot)
    for (_, boundary), own in batches.items():
        full = max(1, 2000 // max(1, boundary))
        assert sorted(own) == list(range(len(own)))
        for batch, slots in own.items():
            assert sorted(slots) == list(range(len(slots)))
            assert len(slots) == full or batch == len(own) - 1 and len(slots) < full


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pack(docs.limit(0)).collect() == []
    assert [(r.length, r.boundary, r.slot) for r in pack(docs).collect()] == [(0, 0, 0)]
    hot = spark.createDataFrame([(5, "a b c")] * 3000, "doc_id long, text string")
    assert len({(r.batch, r.slot) for r in pack(hot, segment=100).collect()}) == 3000
