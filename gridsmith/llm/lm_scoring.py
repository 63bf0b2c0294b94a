"""Log probabilities of texts under a hashed maximum-entropy language model.

The probability of a token is that of its class after the classes before it,
times that of the token within its class. The first factor is a softmax over
hashed n-gram and skip features, trained by gradient updates on the counts of all
contexts of the training texts; the second is a softmax over the tokens' own
weights, whose best values are their smoothed counts. Word counts stay a table of
the cluster: only the most frequent words are sent to the tasks.
"""

from __future__ import annotations

import math

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import saved, words_of

#: Not a word: the token that ends a text, and the history before its first.
END = b"\n"
CLASSES = 64
#: Words that are a class of their own; the other classes are the commonest two-byte word ends, and the rest.
OWN = 40
#: Rows of the weight table that features are hashed to.
BUCKETS = 1 << 14
FEATURES = 7
ROUNDS = 16
#: Weight of the prior that draws every weight to zero.
PRIOR = 2.0
#: Rows that a task gathers before it hands them on.
HANDED_ON = 50_000
#: Words whose counts every task gets; the others are joined.
FREQUENT = 131_072
#: Contexts are at most CLASSES ** 3, so a fixed number of gradient parts is enough at any size.
PARTS = 4


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c``: counts of all words of the column ``text``, and of one ``END`` for each row."""

    def run(batches):
        import pyarrow as pa

        held: dict[bytes, int] = {}

        def flush():
            items = list(held.items())
            held.clear()
            for start in range(0, len(items), 100_000):
                part = items[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                for word in words_of(text.as_py()):
                    held[word] = held.get(word, 0) + 1
                held[END] = held.get(END, 0) + 1
                if len(held) > 500_000:
                    yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def choose_classes(counts: DataFrame) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Class numbers of the most frequent words and word ends; ``END`` is 0 and the rest 1."""
    words = [bytes(r.word) for r in counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(OWN).collect()]
    own = {END: 0} | {w: i + 2 for i, w in enumerate(words)}
    ends = counts.filter(~F.col("word").isin(*own)).groupBy(F.expr("substring(word, -2, 2)").alias("tail")).agg(F.sum("c").alias("c"))
    tails = [bytes(r.tail) for r in ends.orderBy(F.desc("c"), "tail").limit(CLASSES - len(own) - 1).collect()]
    return own, {t: i + len(own) + 1 for i, t in enumerate(tails)}


def _classes(words: list[bytes], own: dict, tails: dict) -> list[int]:
    return [own[w] if w in own else tails.get(w[-2:], 1) for w in words]


def _contexts(found: list[int]):
    """Context number and class of each token of one text."""
    import numpy as np

    line = np.zeros(len(found) + 3, dtype=np.int64)
    line[3:] = found
    return line[2:-1] + CLASSES * line[1:-2] + CLASSES * CLASSES * line[:-3], line[3:]


def context_counts(texts: DataFrame, own: dict[bytes, int], tails: dict[bytes, int]) -> DataFrame:
    """``context, classes, counts``: how often each class follows each context of three classes, over all texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(keys):
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

        keys, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                context, target = _contexts([*_classes(words_of(text.as_py()), own, tails), 0])
                keys.append(context * CLASSES + target)
                held += len(target)
                if held > 4_000_000:
                    yield told(keys)
                    keys, held = [], 0
        if keys:
            yield told(keys)

    found = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # A context has at most CLASSES rows here.
    pair = F.struct((F.col("key") % CLASSES).cast("int").alias("k"), "n")
    rows = found.groupBy(F.floor(F.col("key") / CLASSES).cast("long").alias("context")).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return rows.select("context", F.col("p.k").alias("classes"), F.col("p.n").alias("counts"))


def features_of(context):
    """Hashed feature rows of contexts: nothing, one, two and three classes before, and skips over one or two."""
    import numpy as np

    a, b, c = context % CLASSES, context // CLASSES % CLASSES, context // (CLASSES * CLASSES)
    keys = [np.zeros_like(a), a + 1, a + CLASSES * b + 1, context + 1, b + 1, c + 1, a + CLASSES * c + 1]
    out = np.empty((len(context), FEATURES), dtype=np.int64)
    for kind, key in enumerate(keys):
        mixed = (key.astype(np.uint64) * np.uint64(FEATURES) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, kind] = (mixed >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64)
    return out


def class_log_probabilities(weights, context):
    """Natural logarithms of the class probabilities after each context."""
    import numpy as np

    rows = features_of(context)
    logits = weights[rows[:, 0]].astype(np.float64)
    for kind in range(1, FEATURES):
        logits += weights[rows[:, kind]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(contexts: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR):
    """Weights (BUCKETS x CLASSES) that raise the likelihood of all counted contexts.

    In each round the parts of the table give their observed and expected feature
    counts, and every weight moves along its gradient, scaled by those counts; a
    round that lowers the likelihood halves the step.
    """
    import numpy as np

    spark = contexts.sparkSession
    weights = np.zeros((BUCKETS, CLASSES), dtype=np.float32)
    table = saved(contexts.repartition(PARTS)).coalesce(PARTS)
    best, rate = None, 1.0
    observed = np.zeros(weights.shape)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            now = shared.value  # noqa: B023  used before the next round
            observed, expected, gain = np.zeros(now.shape), np.zeros(now.shape), 0.0
            for batch in batches:
                context = batch.column(0).to_numpy()
                lists, values = batch.column(1), batch.column(2).flatten().to_numpy()
                seen = np.zeros((len(context), CLASSES))
                seen[np.repeat(np.arange(len(context)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = values
                logs = class_log_probabilities(now, context)
                gain += float((seen * logs).sum())
                model = np.exp(logs) * seen.sum(axis=1, keepdims=True)
                rows = features_of(context)
                for kind in range(FEATURES):
                    order = np.argsort(rows[:, kind], kind="stable")
                    key = rows[order, kind]
                    cut = np.flatnonzero(np.diff(key, prepend=-1))
                    observed[key[cut]] += np.add.reduceat(seen[order], cut)
                    expected[key[cut]] += np.add.reduceat(model[order], cut)
            used = np.flatnonzero(observed.any(axis=1))
            pack = lambda x: x[used].astype(np.float32).tobytes()
            seen_counts = b"" if turn else pack(observed)  # noqa: B023  they stay the same
            yield pa.RecordBatch.from_arrays(
                [pa.array([gain]), pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([seen_counts], pa.binary()), pa.array([pack(expected)], pa.binary())],
                ["gain", "used", "observed", "expected"],
            )

        told = table.mapInArrow(run, "gain double, used binary, observed binary, expected binary").toLocalIterator()
        expected, gain = np.zeros(weights.shape), 0.0
        for part in told:
            used = np.frombuffer(part.used, dtype=np.int32)
            if part.observed:
                observed[used] += np.frombuffer(part.observed, dtype=np.float32).reshape(-1, CLASSES)
            expected[used] += np.frombuffer(part.expected, dtype=np.float32).reshape(-1, CLASSES)
            gain += part.gain
        shared.destroy()
        gain -= prior / 2 * float((weights.astype(np.float64) ** 2).sum())
        if best is not None and gain < best[0]:
            rate /= 2
            weights, expected = best[1:]
        else:
            best = (gain, weights, expected)
        # Expected counts are the curvature; the active features share the step.
        step = (observed - expected - prior * weights) / (np.maximum(expected, observed) + prior)
        weights = (weights + rate * 2.0 / FEATURES * np.clip(step, -2, 2)).astype(np.float32)
    return best[1] if best else weights


def score_texts(docs: DataFrame, train_on, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``train_on`` is a condition on the rows of ``docs`` that are learned from.
    ``base_score`` is the log10 probability under add-one word counts and
    ``score`` the model's. Tokens are words and one end; a NULL text is empty and
    has its end alone. With nothing to learn from, every class is as likely and
    all tokens are unknown. No rows give no rows.
    """
    spark = docs.sparkSession
    own_rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train_on, F.lit(False)).alias("teaches"))
    teachers = own_rows.filter("teaches").select("text")
    counts = saved(word_counts(teachers))
    own, tails = choose_classes(counts)

    def classed(batches):
        import pyarrow as pa

        for batch in batches:
            found = _classes(batch.column(0).to_pylist(), own, tails)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["word", "c", "class"])

    by_class = counts.mapInArrow(classed, "word binary, c long, class int")
    sums = {r["class"]: (r.n, r.v) for r in by_class.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, kinds = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    base_log = math.log10(total + kinds + 1)
    class_log = [math.log10(sum(sums.get(k, (0, 0))) + 1) for k in range(CLASSES)]
    weights = train(context_counts(teachers, own, tails), rounds)
    # The least count of a frequent word; words are not sorted, only the counts that occur.
    steps = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(frequent + 1)
    least, held = 1 << 62, 0
    for r in steps.toLocalIterator():
        held += r.n
        if held > frequent:
            break
        least = r.c
    top = {bytes(r.word): r.c for r in counts.filter(F.col("c") >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast((weights, top))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, top = shared.value
        first, given = TaskContext.get().partitionId() << 33, 0
        table = np.empty((CLASSES**3, CLASSES), dtype=np.float32)
        known = np.zeros(CLASSES**3, dtype=bool)
        log10 = {}

        def class_part(found):
            context, target = _contexts(found)
            new = np.unique(context[~known[context]])
            for start in range(0, len(new), 20_000):
                part = new[start : start + 20_000]
                table[part] = class_log_probabilities(weights, part) / math.log(10)
                known[part] = True
            return float(table[context, target].sum(dtype=np.float64))

        names = ["rid", "doc_id", "word", "tf", "n_tokens", "n_known", "base", "score"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        rows: list[tuple] = []

        def handed():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(body.as_py())
                words.append(END)
                found = _classes(words, own, tails)
                rid = first + given
                given += 1
                tf: dict[bytes, int] = {}
                for w in words:
                    tf[w] = tf.get(w, 0) + 1
                score = class_part(found) - sum(map(class_log.__getitem__, found))
                base, n_known = -base_log * len(words), 0
                for w, n in tf.items():
                    if (c := top.get(w)) is None:
                        rows.append((rid, None, w, n, 0, 0, 0.0, 0.0))
                    else:
                        if (value := log10.get(c)) is None:
                            value = log10[c] = math.log10(c + 1)
                        n_known += n
                        base += n * value
                        score += n * value
                # The text's own row joins in under a name that no word has.
                rows.append((rid, doc, END + rid.to_bytes(8, "big"), 0, len(words), n_known, base, score))
                if len(rows) >= HANDED_ON:
                    yield handed()
        if rows:
            yield handed()

    told = own_rows.select("doc_id", "text").mapInArrow(
        run, "rid long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, score double"
    )
    # Words left to join are each at most 1/frequent of all tokens, so no key is hot.
    joined = told.join(counts.select("word", "c"), "word", "left")
    more = F.col("tf") * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))
    return joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.sum("base") + F.sum(more)).alias("base_score"), (F.sum("score") + F.sum(more)).alias("score"),
    ).drop("rid")
