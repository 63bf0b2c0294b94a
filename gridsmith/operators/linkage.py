"""Hierarchical clustering from the bottom up: points are merged by a linkage rule until the wanted number is left.

All pairs of a large table cannot be compared, so rows are first gathered into a
bounded number of micro-clusters, each kept as its count and mean. With no more
different points than that, every point is its own micro-cluster and the result
is the exact one. The micro-clusters are merged on the driver, and every row gets
the label of its nearest one.
"""

from __future__ import annotations

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.stages import _Fitted
from gridsmith.operators.tiles import as_array

LINKAGES = ("ward", "average", "complete", "single")
METRICS = ("euclidean", "manhattan", "cosine")
#: Micro-clusters at most: their distances to each other are one matrix on the driver.
MICRO = 2000
#: How often the means of micro-clusters are taken anew.
ROUNDS = 2


def _gaps(a, b, metric: str):
    """Distances of all rows of ``a`` and ``b``; by cosine, of unit vectors."""
    import numpy as np

    if metric == "cosine":
        return 1.0 - a @ b.T
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = np.abs(a[:, i : i + 1] - b[None, :, i])
        total += d if metric == "manhattan" else d * d
    return total if metric == "manhattan" else np.sqrt(total)


def merge_clusters(points, counts, wanted: int, linkage: str, metric: str = "euclidean"):
    """The cluster of each weighted point, 0 and up in the order of the points, after merging down to ``wanted``.

    Chains of nearest neighbours find pairs that are each other's nearest; for
    these four rules merging such pairs in any order gives the same tree.
    """
    import numpy as np

    n = len(points)
    size = np.asarray(counts, dtype=float).copy()
    gap = _gaps(points, points, metric)
    if linkage == "ward":
        gap = gap * np.sqrt(2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(gap, np.inf)
    alive = np.ones(n, dtype=bool)
    chain, merges = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        b = int(np.argmin(gap[a]))
        if len(chain) > 1 and gap[a, chain[-2]] <= gap[a, b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        height = gap[a, b]
        merges.append((height, a, b))
        if linkage == "ward":
            with np.errstate(invalid="ignore"):
                total = size[a] + size[b] + size
                row = np.sqrt(np.maximum(((size[a] + size) * gap[a] ** 2 + (size[b] + size) * gap[b] ** 2 - size * height**2) / total, 0.0))
        elif linkage == "average":
            row = (size[a] * gap[a] + size[b] * gap[b]) / (size[a] + size[b])
        else:
            row = np.maximum(gap[a], gap[b]) if linkage == "complete" else np.minimum(gap[a], gap[b])
        alive[b] = False
        row[~alive] = np.inf
        row[a] = np.inf
        gap[a], gap[:, a] = row, row
        gap[b], gap[:, b] = np.inf, np.inf
        size[a] += size[b]
    root = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - wanted)]:
        low, high = sorted((root[a], root[b]))
        root[root == high] = low
    return np.unique(root, return_inverse=True)[1].reshape(-1)


class Agglomerative(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``k`` clusters by ward, average, complete or single linkage; rows of one point share a cluster.

    Above ``micro`` different points, that many are drawn by the hash of their
    coordinates, rows are gathered around them, and distances between
    micro-clusters are those of their means, weighted by their counts.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "vector or array column")
    predictionCol = Param(Params._dummy(), "predictionCol", "cluster column")
    k = Param(Params._dummy(), "k", "clusters")
    linkage = Param(Params._dummy(), "linkage", "ward, average, complete or single")
    metric = Param(Params._dummy(), "metric", "euclidean, manhattan or cosine; ward is for euclidean alone")
    micro = Param(Params._dummy(), "micro", "largest number of micro-clusters")

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="cluster", k=2, linkage="ward", metric="euclidean", micro=MICRO):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="cluster", k=2, linkage="ward", metric="euclidean", micro=MICRO)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        import numpy as np

        of = {p.name: self.getOrDefault(p) for p in self.params}
        if of["linkage"] not in LINKAGES or of["metric"] not in METRICS:
            raise ValueError(f"unknown linkage {of['linkage']} or metric {of['metric']}")
        if of["linkage"] == "ward" and of["metric"] != "euclidean":
            raise ValueError("ward linkage is for euclidean distances")
        rows = df.select(_placed(as_array(df, of["featuresCol"]), of["metric"]).alias("x")).persist()
        try:
            folded = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
            # The hash order draws the same points from any layout of the rows; no more than the bound are collected.
            drawn = folded.orderBy(F.xxhash64("x"), "x").limit(of["micro"] + 1).collect()
            centres = np.array([r["x"] for r in drawn[: of["micro"]]])
            counts = np.array([r["n"] for r in drawn[: of["micro"]]])
            if len(drawn) > of["micro"]:
                for _ in range(ROUNDS):
                    centres, counts = _gathered(rows, centres, of["metric"])
        finally:
            rows.unpersist()
        if len(centres):
            order = np.lexsort(centres.T[::-1])
            centres, counts = centres[order], counts[order]
            labels = merge_clusters(centres, counts, of["k"], of["linkage"], of["metric"])
        else:
            labels = np.zeros(0, dtype=int)
        state = {"centres": centres.tolist(), "labels": labels.tolist(), "metric": of["metric"]}
        return AgglomerativeModel(state)._set(featuresCol=of["featuresCol"], predictionCol=of["predictionCol"])


def _placed(x: Column, metric: str) -> Column:
    """The point, or by cosine its unit vector."""
    if metric != "cosine":
        return x
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))
    return F.transform(x, lambda v: v / F.greatest(size, F.lit(1e-300)))


def _nearest(x: Column, centres, metric: str) -> Column:
    """Place of the nearest centre, the first of equals."""
    @F.pandas_udf("int")
    def find(column: pd.Series) -> pd.Series:
        import numpy as np

        out = np.zeros(len(column), dtype=np.int32)
        step = max(1, 4_000_000 // max(1, len(centres)))
        for start in range(0, len(column), step):
            out[start : start + step] = _gaps(np.stack(column.iloc[start : start + step].to_numpy()), centres, metric).argmin(axis=1)
        return pd.Series(out)

    return find(x)


def _gathered(rows: DataFrame, centres, metric: str):
    """Means and counts of the rows nearest to each centre; by cosine the means are unit vectors again."""
    import numpy as np

    near = rows.select(_nearest(F.col("x"), centres, metric).alias("c"), array_to_vector("x").alias("v"))
    found = near.groupBy("c").agg(Summarizer.mean(F.col("v")).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("c")
    told = found.select(vector_to_array("mean").alias("mean"), "n").collect()  # one row for each micro-cluster
    means = np.array([r["mean"] for r in told])
    if metric == "cosine":
        means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
    return means, np.array([r["n"] for r in told])


class AgglomerativeModel(_Fitted):
    """State: the micro-clusters' means and labels; a row takes the label of the nearest."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector or array column")
    predictionCol = Param(Params._dummy(), "predictionCol", "cluster column")

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        s, features = self.value(), self.getOrDefault(self.featuresCol)
        if not s["labels"]:
            return df.withColumn(self.getOrDefault(self.predictionCol), F.lit(None).cast("int"))
        near = _nearest(_placed(as_array(df, features), s["metric"]), np.array(s["centres"]), s["metric"])
        return df.withColumn("_near", near).withColumn(
            self.getOrDefault(self.predictionCol), F.element_at(F.split(F.lit(",".join(map(str, s["labels"]))), ",").cast("array<int>"), as_column("_near") + 1)
        ).drop("_near")
