import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridsmith.llm.toxicity import BlockMaxIndex, Examples, drop_toxic, labelled_sample, score_toxicity, terms_of, trains


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            for bad in rng.sample(["zorgle", "quaxxy", "vunkit"], 2):
                text.insert(rng.randrange(len(text)), rng.choice([bad, bad.upper() + "!!", bad + ","]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_terms():
    counts = terms_of("Idiot, idiot!! a an")
    assert counts == {b"idiot": 2, b"^4idio": 2, b"^5idiot": 2, b"^6idiot": 2, b"a": 1, b"an": 1}
    assert terms_of(None) == terms_of(" \t") == {}


def test_index_finds_the_exact_neighbours():
    rng = random.Random(5)
    vectors = {}
    for i in range(700):
        ids = tuple(sorted(rng.sample(range(40), rng.randint(1, 6))))
        vectors[ids, tuple(rng.randint(1, 3) for _ in ids)] = (rng.randint(0, 3), rng.randint(1, 3), i)
    rows = [(k[0], k[1], *v) for k, v in vectors.items()]
    index = BlockMaxIndex(Examples([1 + i / 10 for i in range(40)], rows, (0, 0)), size=16)

    def dense(ids, tfs):
        out = np.zeros(41)
        terms, weights = index.unit(ids, tfs)
        out[terms] = weights
        return out

    ordered = sorted(rows)
    matrix = np.array([dense(r[0], r[1]) for r in ordered])
    for ids, tfs, *_ in rng.sample(rows, 60):
        at, cosines = index.search(ids, tfs, 25)
        every = np.round(matrix @ dense(ids, tfs), 9)
        order = sorted(range(len(every)), key=lambda i: (-every[i], i))
        covered = np.cumsum([ordered[i][2] + ordered[i][3] for i in order])
        last = every[order[int(np.searchsorted(covered, 25))]]
        expected = [i for i in order if every[i] >= last]
        assert sorted(at.tolist()) == sorted(expected)
        assert np.allclose(sorted(cosines), sorted(np.minimum(every[expected], 1.0)))


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "zorgle quaxxy"), (9002, "ok " * 30_000 + "zorgle quaxxy"), (3, rows[3][1])], "doc_id long, text string")
    docs = docs.withColumn("toxic", F.lit("x")).withColumn("ids", F.lit(1))
    marks = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int")
    found = score_toxicity(docs, marks.filter(trains())).collect()
    assert len(found) == len(rows) + 5 and all(0 <= r.score <= 1 for r in found)
    held = {r.doc_id: r for r in found}
    right = sum(held[i].predicted == t for i, t in labels) / len(labels)
    assert right > 0.99
    assert held[9000].score == held[9001].score < 0.2 and held[None].predicted == held[9002].predicted == 1
    assert all(r.predicted == int(r.score >= 0.7) for r in found)
    assert held[0].evidence and held[0].evidence[0].cosine <= 1 + 1e-9
    left = drop_toxic(docs, marks.filter(trains()))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in found if not r.predicted}


def test_nothing_to_learn_or_score(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.limit(0), none).collect() == []


def test_sample_is_bounded_and_takes_majorities(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(0, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    assert labelled_sample(labels, "doc_id", "toxic", 50).count() == 50
    whole = {r.doc_id: r.toxic for r in labelled_sample(labels, "doc_id", "toxic", 1000).collect()}
    assert whole[0] == 1 and whole[1] == 1 and len(whole) == 500
    assert math.isclose(sum(whole.values()), 251)


def test_every_labelled_vector_is_searched(spark):
    rng = random.Random(8)
    bad = ["zorgle", "quaxxy", "vunkit", "plomad", "grifto", "snabel", "trokul", "wexing", "yubbot", "kranzy", "dolvic", "hestum"]
    rows, seen = [], set()
    while len(rows) < 6600:
        picked = tuple(sorted(rng.choices(bad, k=rng.randint(3, 7))))
        if picked not in seen:
            seen.add(picked)
            rows.append((len(rows), " ".join(picked), 1))
    rows += [(10_000 + i, f"fine calm words number{i % 50}", 0) for i in range(3000)]
    asked = [(20_000 + i, rows[i][1], None) for i in range(6300, 6600)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows + asked], "doc_id long, text string")
    labels = spark.createDataFrame([(d, n) for d, _, n in rows], "doc_id long, toxic int")
    found = score_toxicity(docs, labels).filter("doc_id >= 20000").collect()
    assert len(found) == 300
    assert all(r.evidence[0].example == r.doc_id - 20_000 and r.evidence[0].cosine > 1 - 1e-6 for r in found)
