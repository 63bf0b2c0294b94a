import random

from pyspark.sql import functions as F

from gridsmith.llm.common import remainder
from gridsmith.llm.language import classify, drop_unknown, learn_dictionaries

PARTS = {"aa": ["tho", "ing", "ered", "ly", "wh"], "bb": ["keit", "ung", "sch", "ver", "ß"], "cc": ["eau", "é", "que", "oi", "ç"]}


def corpus(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").withColumn("margin", F.lit("x"))
    held = remainder("doc_id", 4) == 2
    dictionaries = learn_dictionaries(docs.filter(~held))
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    found = classify(docs, dictionaries).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.99
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 34 -- 5", "bb"), (None, "thoing wheredly thoing", None), (4, "thoing " * 40_000, "zz"), (4, "thoing", "aa")]
    docs = spark.createDataFrame([*corpus(120), *rows], "doc_id long, text string, lang string")
    dictionaries = learn_dictionaries(docs)
    found = classify(docs.filter("doc_id is null or doc_id < 5"), dictionaries)
    odd = {(r.doc_id, r.lang_pred) for r in found.collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= odd
    assert classify(docs.limit(0), dictionaries).collect() == []
    assert {r.lang_pred for r in classify(docs, {}).collect()} == {"und"}
    assert learn_dictionaries(docs.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert {r.lang_pred for r in classify(docs.filter("doc_id > 10"), {"aa": dictionaries["aa"]}).collect()} == {"aa"}


def test_dropping_keeps_columns_and_null_keys(spark):
    docs = spark.createDataFrame([*corpus(150), (900, "1 2 3", "aa"), (None, "123", "aa")], "doc_id long, text string, lang string")
    left = drop_unknown(docs, docs)
    assert left.columns == docs.columns
    keys = {r.doc_id for r in left.collect()}
    assert 900 not in keys and None not in keys and len(keys) >= 145
