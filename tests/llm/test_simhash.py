import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridsmith.llm import simhash
from gridsmith.llm.simhash import block_masks, fingerprint, links, simhash_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def brute(bits, radius):
    root = {b: b for b in bits}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bits:
        for b in bits:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {b: find(b) for b in bits}


def groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_shingle_hash_is_the_engines(spark):
    row = spark.sql("select xxhash64('ab cé') as h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("ab cé".encode(), 42)


def test_fingerprints(spark):
    for text in [None, "", " \t", "One", "a b c", "a b c d", "É x Y z É x Y z É", "w " * 70_000 + "end", "a b c d e f"]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_masks_leave_no_near_pair_out():
    rng = random.Random(1)
    masks = block_masks(4, 6)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_links_connect_like_brute_force(spark):
    rng = random.Random(2)
    bits = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        for _ in range(12):
            b = seed
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                b ^= 1 << bit
            bits.add(b)
            seed = rng.choice([seed, b])
    signed = np.array(sorted(bits), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    for tile in (5, 4096):
        found = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links(df, tile=tile).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in found)
        root = {b: b for b in bits}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            root[find(a)] = find(b)
        assert groups({b: find(b) for b in bits}) == groups(brute(bits, 4))


def test_components(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(300)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3] + " tail") for i in range(60)] + [(200, None), (199, ""), (201, " "), (None, base[7]), (5, base[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("x"))
    found = simhash_components(docs).collect()
    marks = {slow_fingerprint(t) for _, t in rows}
    label = brute(marks, 4)
    first = {}
    for d, t in rows:
        k = label[slow_fingerprint(t)]
        first[k] = min(first.get(k, 10**9), 10**9 if d is None else d)
    expected = sorted([(d, f"{slow_fingerprint(t):016x}", first[label[slow_fingerprint(t)]]) for d, t in rows], key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=str) == expected
    assert simhash_components(docs.limit(0)).collect() == []


def test_refused_pairs_are_verified_once(spark, monkeypatch):
    """Texts of 500 shingles that share 440 of 560: their sketches let them pass, their sets do not, round after round."""
    rows = []
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(504)]
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join("new" + w if i % 40 == 20 and i < 480 else w for i, w in enumerate(words)))]
    asked = []
    plain = simhash._similar

    def watched(own, sets, pairs, *more):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return plain(own, sets, pairs, *more)

    monkeypatch.setattr(simhash, "_similar", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0
    assert asked and len(asked) == len(set(asked))
