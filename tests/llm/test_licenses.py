import re

from conftest import SF_DIR

from gridsmith.llm import licenses
from gridsmith.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, label string, token int, _row int, blocks string"


def brute(key, text):
    """(doc_id, n_words, n_base, first, last, base_labels, labels, score): every block against every template."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, base, more, score = [], set(), set(), 0.0
    for label, phrase in licenses.PHRASES:
        phrase = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        starts += at
        base |= {label} if at else set()
    for label, notice in licenses.NOTICES:
        wanted = set(notice.split())
        for start in range(0, len(words), licenses.STRIDE):
            share = len(wanted & set(words[start : start + licenses.BLOCK])) / len(wanted)
            if 100 * len(wanted & set(words[start : start + licenses.BLOCK])) >= licenses.CONTAINMENT * len(wanted):
                more.add(label)
                score = max(score, share)
    return (key, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)),
            1.0 if starts else score)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("matches").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_licenses"][0](spark, SF_DIR)) == sorted((brute(*d) for d in docs), key=str)


def odd():
    notices = dict(licenses.NOTICES)
    fill = lambda n: " ".join(f"word{i}" for i in range(n))
    docs = [
        (1, None), (2, ""), (3, "\x00 .,"), (None, "Under THE mit-License!"), (None, "Under THE mit-License!"), (4, "under the mit licenseé"),
        (5, "cc by nc cc by nc\ncc. by, cc by nc under the mit license version 2"), (6, fill(255) + " apache License, version 2 " + fill(9)),
        (7, fill(127) + " under the mit license"), (7, fill(126) + " under the mit license " * 300), (8, "mit the under license"),
        (9, "the mit license " * 40_000 + "cc by nc"), (10, "ümit cc by nc" + "x" * 100_000),
    ]
    for n, (label, text) in enumerate(licenses.NOTICES):
        words = text.split()
        cut = len(words) // 5
        docs += [(100 + n, fill(90 * n) + " " + text.upper() + " " + fill(50)), (200 + n, " ".join(words[cut:])), (300 + n, " ".join(words[: 2 * cut])),
                 (400 + n, "; ".join(reversed(words)) + "."), (500 + n, " ".join(words[i] + " " + fill(9) for i in range(len(words))))]
        docs += [(600 + n, fill(100 + k) + " " + " ".join(words[k:])) for k in range(0, len(words), 3)]
    assert "mit-text" in notices
    return docs


def test_odd_rows_equal_brute_force(spark):
    docs = odd()
    table = spark.createDataFrame([(k, t, "l", 1, 2, "b") for k, t in docs], SCHEMA)
    want = sorted((brute(*d) for d in docs), key=str)
    assert rows_of(licenses.scan_licenses(table)) == want
    assert rows_of(licenses.scan_licenses(table.repartition(9))) == want
    assert {x[6] for x in want} >= {n for n, _ in licenses.NOTICES}


def test_matches_list_every_block(spark):
    text = licenses.NOTICES[0][1]
    docs = spark.createDataFrame([(1, "a " * 300 + text)], "doc_id long, text string")
    (row,) = licenses.scan_licenses(docs).collect()
    found = {(m["word"], m["label"]) for m in row["matches"]}
    assert found == {(w, "mit-text") for w in range(0, 400, 128) if w <= 300 and w + 256 >= 300 + 0.8 * len(text.split())}
    assert row["labels"] == "mit-text" and row["base_labels"] == "" and row["score"] == 1.0


def test_own_templates_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(none).collect() == []
    wanted = licenses.templates([("x", "a b a")], [("y", "q r s t u")], 60)
    docs = spark.createDataFrame([(1, "A, b a b a"), (2, "u . t z s"), (3, "a b"), (4, "t u")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs, wanted=wanted).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["labels"]) == (2, 0, 2, "x")
    assert (rows[2]["labels"], rows[2]["score"]) == ("y", 0.6)
    assert rows[3]["labels"] == rows[4]["labels"] == ""
