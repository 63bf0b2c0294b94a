import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gridsmith.llm.sharding import assign_shards, write_shards


def check(found, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in {r.shard for r in found}:
        assert 0 <= s < shards
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(3000)] + [(10_000 + i, "hot " * 40) for i in range(1500)] + [(20_000 + i, f"pair {i // 2} " * 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("hash", F.lit(1))
    found = assign_shards(docs.repartition(6), 24).collect()
    check(found, rows, 24)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) < 1.1 * min(sizes.values())
    together = {}
    for r in found:
        if 20_000 <= r.doc_id:
            together.setdefault(rows[3000 + 1500 + r.doc_id - 20_000][1], set()).add(r.shard)
    assert all(len(s) == 1 for s in together.values())


def test_odd_tables(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "x" * 500_000), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(assign_shards(docs, 24).collect(), rows, 24)
    assert assign_shards(docs.limit(0)).collect() == []
    check(assign_shards(docs, 1).collect(), rows, 1)


def test_large_ranges_are_divided(spark):
    rows = [(i, f"text {i % 37} " * (1 + i % 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(assign_shards(docs, 5, ranges=2, rows_in_range=100).collect(), rows, 5)


def test_records_are_written(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4
