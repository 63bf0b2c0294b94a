"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over the terms that tell the labels apart. The
labelled vectors form an inverted index whose postings are cut into blocks with
the highest weight of each; a search visits blocks in the order of their bound
and stops when no block left can hold a nearer example, so the cosines and the
neighbours are exact. Distance-weighted votes are turned into probabilities by a
monotone curve fitted on votes that leave the voted example out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import remainder, saved, text_tie, without_rows, words_of

#: The classifier is fitted on at most so many labelled rows, those first in hash order.
LABELLED = 40_000
#: Terms that enter the vectors: the most telling ones, if chance would give one so telling at most once in 1/CHANCE tables.
TERMS = 4000
CHANCE = 0.02
SUPPORT = 5
NEIGHBOURS = 25
#: Votes that the toxic share of all labelled rows has beside the neighbours', so that far neighbours decide little.
PRIOR_VOTES = 1.0
BLOCK = 64
FIRST_BLOCKS = 8
BINS = 50
#: Fixed value: marks at the ends of a word that do not belong to it.
MARKS = b".,;:!?\"'()[]{}<>*%$&#|~^+=/\\_-`@"

_VECTOR = "doc_id long, tie long, toxic int, ids array<int>, tfs array<int>"


def terms_of(text: str | None) -> dict[bytes, int]:
    """Counts of bare words and, after a mark each, of their first four, five and six bytes."""
    counts: dict[bytes, int] = {}
    for word in words_of(text):
        counts[word] = counts.get(word, 0) + 1
    out: dict[bytes, int] = {}
    for word, n in counts.items():
        for term in _terms(word):
            out[term] = out.get(term, 0) + n
    return out


def _terms(word: bytes) -> tuple[bytes, ...]:
    word = word.strip(MARKS) or word
    return (word, b"^4" + word[:4], b"^5" + word[:5], b"^6" + word[:6]) if len(word) > 4 else (word,)


def labelled_sample(labels: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """``doc_id, toxic`` of at most ``bound`` labelled rows, first in the order of a hash of the key."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("toxic"))
    n = rows.count()
    share = 1.0 if n <= bound else min(1.0, bound * 1.2 / n + 1e-4)
    order = F.xxhash64("doc_id", F.lit(17))
    return rows.filter(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000).orderBy(order, "doc_id").limit(bound)


def telling_terms(texts: DataFrame, limit: int, chance: float, support: int) -> list[bytes]:
    """The terms of ``texts`` (``text, toxic``) that most mark toxic ones, by likelihood ratio over different texts."""

    def run(batches):
        import pyarrow as pa

        held: dict[bytes, list[int]] = {}

        def flush():
            items = list(held.items())
            held.clear()
            for start in range(0, len(items), 50_000):
                part = items[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in part], pa.binary())] + [pa.array([v[i] for _, v in part], pa.int64()) for i in (0, 1)], ["term", "clean", "toxic"]
                )

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for term in terms_of(text.as_py()):
                    if (seen := held.get(term)) is None:
                        seen = held[term] = [0, 0]
                    seen[toxic] += 1
                if len(held) > 400_000:
                    yield from flush()
        yield from flush()

    alone = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in alone.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    counted = alone.mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    counted = saved(counted.filter(F.col("a") + F.col("b") >= support))
    tested = counted.count()
    if not tested:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    total = float(n1 + n0)

    def part(seen, rows, of):
        return F.when(seen > 0, seen * F.ln(seen * total / (rows * of))).otherwise(0.0)

    ratio = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, total - a - b, n1) + part(n0 - b, total - a - b, n0))
    # Words of clean texts say nothing about what is toxic, and most texts are left with few terms or none.
    kept = counted.withColumn("ratio", ratio).filter((F.col("ratio") >= 2 * math.log(tested / chance)) & (a * n0 > b * n1))
    return [bytes(r.term) for r in kept.orderBy(F.desc("ratio"), "term").limit(limit).collect()]


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Rows of ``docs`` (``doc_id, tie, text, toxic``) with the vocabulary numbers and counts of their whole text."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        import pyarrow as pa

        number, seen = shared.value.get, {}
        for batch in batches:
            ids, tfs = [], []
            for text in batch.column(2):
                tf: dict[int, int] = {}
                for word in words_of(text.as_py()):
                    if (own := seen.get(word)) is None:
                        if len(seen) > 300_000:
                            seen.clear()
                        own = seen[word] = tuple(i for t in _terms(word) if (i := number(t)) is not None)
                    for i in own:
                        tf[i] = tf.get(i, 0) + 1
                found = sorted(tf.items())
                ids.append([i for i, _ in found])
                tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "tie", "toxic", "ids", "tfs"],
            )

    return docs.select("doc_id", "tie", "text", "toxic").mapInArrow(run, _VECTOR)


@dataclass
class Examples:
    """Labelled vectors as rows of bounded arrays, and the weights of the terms."""

    idf: list[float]
    vectors: list[tuple]  # (ids, tfs, toxic rows, clean rows, a doc_id)
    prior: tuple[int, int]  # toxic and clean rows without any telling term


class BlockMaxIndex:
    """Postings of the labelled vectors in blocks of ``size``, each with its highest weight."""

    def __init__(self, examples: Examples, size: int = BLOCK):
        import numpy as np

        self.idf = np.array(examples.idf)
        rows = sorted(examples.vectors)
        self.toxic = np.array([r[2] for r in rows], dtype=float)
        self.clean = np.array([r[3] for r in rows], dtype=float)
        self.ids = [r[4] for r in rows]
        all_toxic, all_clean = self.toxic.sum() + examples.prior[0], self.clean.sum() + examples.prior[1]
        self.share = all_toxic / max(1.0, all_toxic + all_clean)
        self.size, self.blocks = size, -(-len(rows) // size)
        postings: dict[int, list] = {}
        self.place = {}
        for i, row in enumerate(rows):
            terms, weights = self.unit(row[0], row[1])
            self.place[tuple(row[0]), tuple(row[1])] = i
            for t, w in zip(terms, weights, strict=True):
                postings.setdefault(t, []).append((i, w))
        self.lists = {}
        for t, found in postings.items():
            at, weight = np.array([i for i, _ in found]), np.array([w for _, w in found])
            cut = np.flatnonzero(np.diff(at // size, prepend=-1))
            self.lists[t] = (at, weight, at[cut] // size, np.maximum.reduceat(weight, cut))

    def unit(self, ids, tfs):
        """TF-IDF weights of length one; tf counts as one plus its logarithm.

        A term that every text has once, of the mean weight, keeps texts with one
        telling word apart from those full of it.
        """
        import numpy as np

        at = np.asarray(ids, dtype=np.int64)
        weights = np.append((1 + np.log(np.asarray(tfs, dtype=float))) * self.idf[at], self.idf.mean())
        return [*at.tolist(), len(self.idf)], weights / np.sqrt((weights**2).sum())

    def search(self, ids, tfs, k: int, without: int = -1):
        """Examples in the order of their cosine until ``k`` rows are covered, with all ties of the last.

        ``without`` is the number of an example of which one row is left out.
        """
        import numpy as np

        terms, query = self.unit(ids, tfs)
        lists = [(q, self.lists[t]) for q, t in zip(query, terms, strict=True) if t in self.lists]

        if not lists:
            return np.zeros(0, dtype=int), np.zeros(0)

        def weighted(place, weight):
            """All places of the query's lists, with their values times the query's weights."""
            places = [x[place] for _, x in lists]
            values = np.repeat([q for q, _ in lists], [len(p) for p in places]) * np.concatenate([x[weight] for _, x in lists])
            return np.concatenate(places), values

        bound = np.bincount(*weighted(2, 3), self.blocks)
        posted, weighed = weighted(0, 1)
        block_of = posted // self.size
        rows = self.toxic + self.clean
        if without >= 0:
            rows[without] -= 1
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, cosines, least = np.zeros(0, dtype=int), np.zeros(0), 0.0
        # The most promising blocks give a cosine to beat; of the others only those that can reach it are looked at.
        for part in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            part = part[bound[part] >= least - 1e-9]
            if not len(part):
                break
            inside = np.zeros(self.blocks, dtype=bool)
            inside[part] = True
            hit = inside[block_of]
            scores = np.bincount(posted[hit], weighed[hit], len(rows))
            found = np.flatnonzero((scores > 0) & (rows > 0))
            at, cosines = np.append(at, found), np.append(cosines, np.round(scores[found], 9))
            if len(at) > k:  # each has a row or more, so what is behind the k-th is never reached
                close = cosines >= np.partition(cosines, -k)[-k]
                at, cosines = at[close], cosines[close]
            first = np.lexsort((at, -cosines))
            at, cosines = at[first], cosines[first]
            covered = np.cumsum(rows[at])
            if len(at) and covered[-1] >= k:
                least = cosines[np.searchsorted(covered, k)]
                near = cosines >= least
                at, cosines = at[near], cosines[near]
        return at, np.minimum(cosines, 1.0)

    def vote(self, ids, tfs, k: int, left_out: int | None = None) -> tuple[float | None, list]:
        """Weighted share of toxic rows among the nearest, and the three nearest as evidence; None if there is none."""
        import numpy as np

        own = self.place.get((tuple(ids), tuple(tfs)), -1) if left_out is not None else -1
        at, cosines = self.search(ids, tfs, k, own)
        toxic, clean = self.toxic[at], self.clean[at]
        if own >= 0:
            toxic, clean = toxic - (at == own) * left_out, clean - (at == own) * (1 - left_out)
        weight = cosines**2
        total = (weight * (toxic + clean)).sum() + PRIOR_VOTES
        if not len(at):
            return None, []
        near = [(self.ids[i], float(c), float(t / (t + f)) if t + f else 0.0) for i, c, t, f in zip(at[:3], cosines, toxic, clean, strict=False)]
        return float(((weight * toxic).sum() + PRIOR_VOTES * self.share) / total), near


def _monotone(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Rising curve through (vote, toxic, all) by pooling neighbours that fall; half a row of each label is added."""
    pools: list[list[float]] = []
    for x, toxic, n in sorted(points):
        pools.append([x * n, toxic, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def score_rows(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7,
    labelled: int = LABELLED, terms: int = TERMS, chance: float = CHANCE, support: int = SUPPORT, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, tie, score`` (0 to 1), ``predicted``, ``evidence``; ``tie`` is the hash of the text.

    ``labels`` holds the rows to learn from; rows with a NULL key or label teach
    nothing, and a key with several labels counts as its majority, a tie as
    toxic. ``evidence`` lists up to three nearest examples with cosine and toxic
    share. A text without any telling term (an empty or NULL one too) gets the
    toxic share of labelled texts of that kind; without any labels every score
    is 0. Repeated rows get equal scores; no rows give no rows.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, key, label, labelled)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_tie(text).alias("tie"), F.col(text).cast("string").alias("text"))
    marked = own.join(F.broadcast(saved(sample)), "doc_id", "left")  # bounded by ``labelled``
    vocabulary = telling_terms(marked.filter("toxic is not null").select("text", "toxic"), terms, chance, support)
    held = saved(vectors(marked, vocabulary))
    n = held.count()
    used = {r.id: r.n for r in held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = [math.log((1 + n) / (1 + used.get(i, 0))) + 1 for i in range(len(vocabulary))]
    grouped = (
        held.filter("toxic is not null").groupBy("ids", "tfs")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.min("doc_id").alias("example"))
    )
    empty = grouped.filter("size(ids) = 0").first()
    # All of them enter the index: there are at most as many as labelled rows drawn, and the shares are of the same rows.
    rows = [(tuple(r.ids), tuple(r.tfs), r.t, r.c, r.example) for r in grouped.filter("size(ids) > 0").orderBy("example").collect()]
    bundle = spark.sparkContext.broadcast(Examples(idf, rows, (empty.t, empty.c) if empty else (0, 0)))

    def left_out(batches):
        import pyarrow as pa

        index = BlockMaxIndex(bundle.value)
        for batch in batches:
            out = []
            for ids, tfs, t, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for mark, n in ((1, t), (0, c)):
                    if n:
                        raw, _ = index.vote(ids, tfs, neighbours, left_out=mark)
                        if raw is not None:
                            out.append((min(BINS - 1, int(raw * BINS)), raw * n, float(mark * n), float(n)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int32()] + [pa.float64()] * 3)], ["bin", "x", "toxic", "n"])

    curve: tuple[list[float], list[float]] = ([0.0, 1.0], [0.0, 1.0])
    if rows:
        known = spark.createDataFrame([(list(r[0]), list(r[1]), int(r[2]), int(r[3])) for r in rows], "ids array<int>, tfs array<int>, t long, c long")
        bins = (
            known.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(left_out, "bin int, x double, toxic double, n double")
            .groupBy("bin").agg(F.sum("x").alias("x"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()
        )
        if bins:
            curve = _monotone([(r.x / r.n, r.toxic, r.n) for r in bins])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        data = bundle.value
        index, memo = BlockMaxIndex(data), {}
        toxic, clean = data.prior
        plain = (toxic / (toxic + clean) if toxic + clean else 0.0, [])
        for batch in batches:
            scores, evidence = [], []
            for ids, tfs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = plain
                if ids and data.vectors:
                    known = (*ids, *tfs)
                    if (found := memo.get(known)) is None:
                        raw, near = index.vote(ids, tfs, neighbours)
                        found = plain if raw is None else (float(np.interp(raw, *curve)), near)
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[known] = found
                scores.append(found[0])
                evidence.append([{"example": e, "cosine": c, "toxic_share": s} for e, c, s in found[1]])
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "tie", "score", "evidence"])

    scored = held.select("doc_id", "tie", "ids", "tfs").mapInArrow(
        run, "doc_id long, tie long, score double, evidence array<struct<example: long, cosine: double, toxic_share: double>>"
    )
    return scored.select("doc_id", "tie", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def score_toxicity(docs: DataFrame, labels: DataFrame, *args, **options) -> DataFrame:
    """``doc_id, score, predicted, evidence`` of ``score_rows``, with the same arguments."""
    return score_rows(docs, labels, *args, **options).drop("tie")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    A decision holds for all rows of the same key and text, NULL keys too. NULL
    and empty texts are scored like any other; an empty table gives no rows;
    other columns may have any names.
    """
    found = score_rows(docs, labels, key, text, threshold=threshold, **options)
    return without_rows(docs, key, text, found.filter("predicted = 1").select("doc_id", "tie"))


def trains(key: str = "doc_id"):
    """Rows the registered query learns from: those whose remainder modulo 3 is not 1."""
    return remainder(key, 3) != 1
