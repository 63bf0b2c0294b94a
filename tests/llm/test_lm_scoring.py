import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import lm_scoring as lm
from gridsmith.llm.common import remainder


def corpus(n=260):
    rng = random.Random(8)
    tongues = [[f"{p}{i}" for i in range(300)] for p in ("a", "b")]
    return [(i, " ".join(rng.choice(tongues[i % 2]) if rng.random() < 0.6 else ("the", "le")[i % 2] for _ in range(rng.randint(0, 90)))) for i in range(n)]


ODD = [(1000, None), (1001, ""), (1002, "The\tTHE É é"), (None, "the a1"), (5, "the"), (5, "the"), (1003, "a1 " * 20_000)]


@pytest.mark.parametrize("frequent", [5, 131_072])
def test_base_scores_and_gain(spark, frequent):
    rows = [*corpus(), *ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("word", F.lit("x"))
    held = remainder("doc_id", 7) == 2
    found = lm.score_texts(docs, ~held, frequent=frequent, rounds=8)
    taught = {r.doc_id for r in docs.filter(~held).select("doc_id").collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for d, t in rows if d in taught for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted(
        (str(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 4))
        for d, t in rows
    )
    got = found.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    new = [r for r in got if r.doc_id not in taught]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert all(r.score < 0 for r in got)


def test_class_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(lm.BUCKETS, lm.CLASSES)).astype(np.float32)
    logs = lm.class_log_probabilities(weights, np.arange(0, lm.CLASSES**3, 997))
    assert np.allclose(np.exp(logs).sum(axis=1), 1)


def test_training_raises_the_likelihood(spark):
    texts = spark.createDataFrame([(t,) for _, t in corpus()], "text string")
    counts = lm.word_counts(texts)
    own, tails = lm.choose_classes(counts)
    assert len(own) + len(tails) + 1 <= lm.CLASSES and own[lm.END] == 0
    contexts = lm.context_counts(texts, own, tails)
    rows = contexts.collect()
    assert sum(sum(r.counts) for r in rows) == counts.agg(F.sum("c")).first()[0]

    def gain(weights):
        logs = lm.class_log_probabilities(weights, np.array([r.context for r in rows]))
        return sum(sum(n * logs[i, k] for k, n in zip(r.classes, r.counts)) for i, r in enumerate(rows))

    start = np.zeros((lm.BUCKETS, lm.CLASSES), dtype=np.float32)
    few, more = lm.train(contexts, rounds=3), lm.train(contexts, rounds=10)
    assert gain(start) < gain(few) < gain(more)


def test_nothing_to_learn_or_score(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score_texts(docs, F.lit(False), rounds=2).collect()}
    assert found[1].n_tokens == 3 and found[1].n_known == 0 and found[1].train_tokens == 0 and found[1].base_score == 0.0
    assert lm.score_texts(docs.limit(0), F.lit(True), rounds=2).collect() == []
