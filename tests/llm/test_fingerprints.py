import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from gridsmith.llm import fingerprints as fp


def text(seed, lines=8):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 25))) for _ in range(lines))


def test_sums_are_those_of_the_paragraphs(spark):
    body = text(1, 3)
    row = fp.fingerprint_documents(spark.createDataFrame([(1, body)], "doc_id long, text string")).first()
    digests = [hashlib.sha256(line.encode()).hexdigest() for line in body.split("\n")]
    assert row.lanes[:8] == [sum(int(d[8 * i : 8 * i + 8], 16) for d in digests) % 2**32 for i in range(8)]
    assert row.lanes[-1] == len(body.split())
    assert row.fingerprint == "".join(f"{x:08x}" for x in row.lanes)


def test_pair_lanes_count_bits(spark):
    got = fp.fingerprint_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    first = xxhash.xxh64_intdigest("b", xxhash.xxh64_intdigest("a", 42))
    second = xxhash.xxh64_intdigest("b", 42)
    assert got.lanes[8:72] == [(first >> i & 1) + (second >> i & 1) for i in range(64)]


def test_order_insertion_and_removal(spark):
    body = text(2)
    lines = body.split("\n")
    other = "\n".join(reversed(lines))
    rows = [(1, body), (2, other), (3, "\n".join(lines[:5])), (4, "\n".join(lines[5:])), (5, body.replace("w", "v", 1)), (6, None), (7, ""), (8, " \n\t")]
    found = {r.doc_id: r for r in fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].fingerprint == found[2].fingerprint != found[5].fingerprint
    assert found[6].fingerprint == found[7].fingerprint == found[8].fingerprint == "0" * 8 * fp.LANES
    frame = spark.createDataFrame([(found[1].lanes, found[3].lanes, found[4].lanes)], "whole array<long>, a array<long>, b array<long>")
    row = frame.select((fp.add(F.col("a"), F.col("b")) == F.col("whole")).alias("sum"), (fp.remove(F.col("whole"), F.col("b")) == F.col("a")).alias("rest")).first()
    assert row["sum"] and row["rest"]


def edited(rows):
    out = []
    for i, (key, body) in enumerate(rows):
        body, after = body or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(body) // 2
        out.append((key, len(body), hashlib.sha256((body[: len(body) - half] + after[:half]).encode()).hexdigest()))
    return out


def test_edits_follow_the_order_of_keys(spark):
    rows = [(k, text(k, 1 + k % 9)) for k in range(0, 400, 7)] + [(5000, None), (5001, ""), (5002, "é" * 9), (90_000, "x " * 60_000), (90_001, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("p")).withColumn("next", F.lit(1))
    for stretch in (3, 4000):
        found = fp.edit_likeness(docs.repartition(5), stretch=stretch).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == edited(rows)
        long = [r for r in found if r.n_chars > 500 and r.doc_id < 5000]
        assert sum(r.near_edited > r.near_next + 0.2 for r in long) > 0.9 * len(long)
        assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one text only")], "doc_id long, text string")
    row = fp.edit_likeness(docs).first()
    assert row.near_next == 1.0 and row.n_chars == 13
    assert fp.edit_likeness(docs.limit(0)).collect() == []
    again = spark.createDataFrame([(1, "same"), (1, "same"), (None, "n"), (None, None)], "doc_id long, text string")
    assert len(fp.edit_likeness(again, stretch=1).collect()) == 4
    plan = fp.edit_likeness(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
