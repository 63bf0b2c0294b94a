import hashlib
import random
import zlib
from collections import defaultdict

from conftest import SF_DIR
from pyspark.sql import functions as F

from gridsmith.llm import prefix_trie
from gridsmith.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, conv int, path string, key string, kind int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, g = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(g, [])[:h] + turns[h:])
    return out


def brute(rows):
    """All nodes in plain Python: members of every prefix, then sums over subtrees."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(rebuilt(rows).items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, m in members.items()
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "k", 0) for r in rows], SCHEMA)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"][0](spark, SF_DIR)) == brute(rows)


def talk(seed, convs, words):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.choice([1, 2, 3, 4, 7, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice([*words, None, ""])))
    return rows


def test_many_partitions_equal_brute_force(spark):
    rows = talk(1, [*range(-250, 900, 3), *range(5000, 5100)], ["é", "ab", "c" * 9])
    rows += [(c, t, "user", "same") for c in range(20_000, 20_400) for t in range(8)]  # copies over many partitions
    rows += [(77_777, t, "user", f"{t % 3}") for t in range(5000)] + [(88_888, t, "user", f"{t % 3}") for t in range(5001)]
    rows += [(None, 0, "user", "nobody"), (123, 1, "user", "again"), (123, 1, "user", "again")]
    table, want = frame(spark, rows), brute(rows)
    before, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for parts in ("1", "3", "70"):  # no neighbour, one round of merging, three
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert rows_of(prefix_trie.conversation_trie(table)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_merging_in_any_cut_gives_the_same_forest():
    rng = random.Random(5)
    for _ in range(60):
        turns = [bytes([rng.randrange(2)]) * prefix_trie.DIGEST for _ in range(3)]
        items = sorted((b"".join(rng.choices(turns, k=rng.randrange(5))), c) for c in range(rng.randrange(1, 14)))
        base = lambda part: [(p, [1] * (len(p) // 16), [[1] * (len(p) // 16 + 1), [c] * (len(p) // 16 + 1), *([0] * (len(p) // 16 + 1) for _ in range(3))]) for p, c in part]
        want = sorted(n[:2] + n[3:7] for n in prefix_trie.merge(base(items), [c for _, c in items], True)[0])
        cuts = sorted(rng.choices(range(1, len(items) + 1), k=3))
        found, spines = [], []
        for a, b in zip([0, *cuts], [*cuts, len(items)], strict=True):
            if a < b:
                nodes, ends, _ = prefix_trie.merge(base(items[a:b]), [c for _, c in items[a:b]], False)
                found += nodes
                spines += [(item[0], item[1], sums) for _, item, sums in ends]
        found += prefix_trie.merge(spines, None, True)[0]
        assert sorted(n[:2] + n[3:7] for n in found) == want


def test_empty_and_odd_tables(spark):
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    assert prefix_trie.conversation_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    rows = [(4, 0, None, None), (4, None, "", "x" * 300_000), (104, 0, "user", "hello")]  # one may be left without turns
    assert rows_of(prefix_trie.conversation_trie(frame(spark, rows))) == brute(rows)
    alone = [(c, 0, "user", "t") for c in range(1, 40)]  # donors are absent
    found = prefix_trie.conversation_trie(frame(spark, alone))
    assert rows_of(found) == brute(alone)
    assert found.filter(F.col("depth") == 0).count() == 1
