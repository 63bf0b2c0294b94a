import hashlib
import math
import re
import zlib

from conftest import SF_DIR

from gridsmith.llm import resampling
from gridsmith.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, found string, _row int"


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, percent=5):
    """Rows (doc_id, n_features, weight, score, rank) in plain Python."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for bucket in features(text)[1]:
                counts[bucket] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    found = QUERIES["op13_resampling"][0](spark, SF_DIR)
    assert dict(found.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert rows_of(found) == brute(docs, target)


def test_odd_rows_equal_brute_force(spark):
    long = " ".join(f"w{i % 977} É{i % 13}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten " * 3
    docs = [(1, None), (2, ""), (3, ".,;\x00 \x7f"), (4, "Straße ÀÉ İ K"), (5, long), (None, same), (None, same), (7, same), (7, same), (7, same.upper()),
            (8, "x" * 200_000), (9, "a-b_c d9"), (10, same + "benchmark words " * 12)] + [(100 + i, same + f" t{i}") for i in range(40)]
    target = ["benchmark words here", None, ""]
    table = spark.createDataFrame([(k, t, "en", "f", 1) for k, t in docs], SCHEMA)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 50, 100, 0):
        assert rows_of(resampling.importance_resample(table, aim, percent=percent)) == brute(docs, target, percent)
    spread = resampling.importance_resample(table.repartition(7), aim, percent=30)
    assert rows_of(spread) == brute(docs, target, 30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    aim = spark.createDataFrame([], "text string")
    assert resampling.importance_resample(none, aim).collect() == []
    assert rows_of(resampling.importance_resample(spark.createDataFrame([(1, "a b", "", "", 0)], SCHEMA), aim)) == brute([(1, "a b")], [])
