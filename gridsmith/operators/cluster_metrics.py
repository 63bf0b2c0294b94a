"""Quality of a clustering from a table of points and labels; label -1 is noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.tiles import ROWS_PER_BLOCK, as_array, block_count, compare_blocks

#: Blocks of points grow up to this many times their rows, as long as there are so many blocks.
WIDEST, MANY_BLOCKS = 8, 16
#: Points whose distances a task takes at once, and from how many others.
PAIRS_HIGH, PAIRS_WIDE = 32, 4096
#: Sums per point and cluster that a block of more rows may hold.
SUMS = 4_000_000
#: Squared distances below this share of the squared lengths are taken from differences, not from a product.
CLOSE = 1e-4
MIN_CLUSTER_ROWS = 5
MIN_ROWS = 10


def _points(df: DataFrame, features, label: str) -> DataFrame:
    """``c, x`` of the clustered points."""
    return df.select(as_column(label).cast("bigint").alias("c"), as_array(df, features).alias("x")).filter(F.col("c") >= 0)


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """``cluster, size`` without noise."""
    c = as_column(label)
    return df.filter(c >= 0).groupBy(c.alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_size_statistics(df: DataFrame, label: str = "cluster") -> DataFrame:
    return cluster_sizes(df, label).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("mean_size"),
        F.stddev_pop("size").alias("std_size"),
    )


def _moments(points: DataFrame) -> DataFrame:
    """``c, i, n, m, v`` per cluster and coordinate: one row per cell of the centroids."""
    return (
        points.select("c", F.posexplode("x").alias("i", "v"))
        .groupBy("c", "i")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("v"))
    )


def centroids(df: DataFrame, features, label: str = "cluster") -> DataFrame:
    """``cluster, n, centroid``."""
    return _centroids(_moments(_points(df, features, label)))


def _centroids(moments: DataFrame) -> DataFrame:
    return (
        moments.groupBy(F.col("c").alias("cluster"))
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
        .select("cluster", "n", F.col("cells.m").alias("centroid"))
    )


def calinski_harabasz(df: DataFrame, features, label: str = "cluster") -> DataFrame:
    """Between over within spread, each per degree of freedom; one row."""
    cells = _moments(_points(df, features, label))
    overall = cells.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    gap = F.col("m") - F.col("mean")
    stats = cells.join(overall, "i").agg(
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count_distinct("c").alias("k"),
        F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"),
    )
    ratio = F.col("between") * (F.col("n") - F.col("k")) / F.nullif(F.col("within") * (F.col("k") - 1), F.lit(0.0))
    return stats.select(
        F.when(F.col("k") > 1, F.when(F.col("within") == 0, F.lit(1.0)).otherwise(ratio)).alias("calinski_harabasz_score")
    )


def _distance(a, b):
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, s: t + s))


def davies_bouldin(df: DataFrame, features, label: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst spread-to-separation ratio; one row."""
    points = _points(df, features, label)
    middle = _centroids(_moments(points))
    # Centroids are one row per cluster; AQE broadcasts them when small.
    spread = (
        points.join(middle, F.col("c") == F.col("cluster"))
        .groupBy("cluster")
        .agg(F.avg(_distance("x", "centroid")).alias("s"), F.first("centroid").alias("centroid"))
    )
    k = middle.count()
    if k < 2:
        return spread.agg(F.lit(None).cast("double").alias("davies_bouldin_score"))
    blocks = block_count(k)

    def worst(a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"cluster": [], "r": []})
        x, y = np.stack(a["centroid"]), np.stack(b["centroid"])
        gap = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        total = a["s"].to_numpy()[:, None] + b["s"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, total / gap, 0.0)
        ratio[a["cluster"].to_numpy()[:, None] == b["cluster"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"cluster": a["cluster"], "r": ratio.max(axis=1)})

    ratios = compare_blocks(spread, spread, "cluster", blocks, blocks, worst, "cluster bigint, r double")
    return ratios.groupBy("cluster").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin_score"))


def silhouette_points(
    df: DataFrame, key: str, features, label: str = "cluster", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Exact Euclidean silhouette of every clustered point: ``key, cluster, silhouette``.

    The measure itself needs every distance, so the work grows with the square
    of the rows; ``silhouette_sq_euclidean`` is the linear-cost figure. Each two
    blocks meet once and return distance sums per point of either and cluster, not
    distances.
    """
    points = df.select(
        as_column(key).alias("key"), as_column(label).cast("bigint").alias("c"), as_array(df, features).alias("x")
    ).filter(F.col("c") >= 0)
    sizes = points.groupBy(F.col("c").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    n, clusters = points.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
    # Rows are sent to every block; blocks of a large table hold more of them, up to a bound, and a task the sums of few clusters.
    blocks = block_count(n, max(rows_per_block, min(WIDEST * rows_per_block, math.ceil(n / MANY_BLOCKS), SUMS // max(clusters, 1))))

    kind = points.schema["key"].dataType.simpleString()

    def sums(a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"key": a["key"][:0], "c": [], "other": [], "total": []})
        alone = a["_i"].iloc[0] == a["_j"].iloc[0]
        # Rows of a cluster lie side by side, so sums over a cluster are sums over a run of rows or columns.
        a, b = a.sort_values("c", kind="stable"), b.sort_values("c", kind="stable")
        x, y = np.stack(a["x"]), np.stack(b["x"])
        (found_a, runs_a), (found_b, runs_b) = (np.unique(part["c"].to_numpy(), return_index=True) for part in (a, b))
        of_a, of_b = np.zeros((len(x), len(found_b))), np.zeros((len(found_a), len(y)))

        def cuts(runs, first, last):
            begun = np.searchsorted(runs, first, side="right") - 1
            inside = runs[begun : np.searchsorted(runs, last)] - first
            return slice(begun, begun + len(inside)), np.maximum(inside, 0)

        # Squared distances by one product, around a common middle: |u|^2 - 2 u v + |v|^2.
        middle = y.mean(axis=0)
        largest = max(((y[first : first + PAIRS_WIDE] - middle) ** 2).sum(axis=1).max() for first in range(0, len(y), PAIRS_WIDE))
        # Squares of so few pairs at a time stay in the processor's cache.
        for first in range(0, len(y), PAIRS_WIDE):
            near = y[first : first + PAIRS_WIDE]
            v = near - middle
            right = np.ascontiguousarray(np.hstack([v, np.ones((len(v), 1)), (v * v).sum(axis=1)[:, None]]).T)
            columns, at_b = cuts(runs_b, first, first + len(near))
            step = np.empty((PAIRS_HIGH, len(near)))
            for start in range(0, len(x), PAIRS_HIGH):
                mine = x[start : start + PAIRS_HIGH]
                u = mine - middle
                size = (u * u).sum(axis=1)
                gap = np.matmul(np.hstack([-2 * u, size[:, None], np.ones((len(u), 1))]), right, out=step[: len(mine)])
                # Products round where differences do not; pairs so close are worked out from these.
                edge = CLOSE * (size.max() + largest)
                if not gap.min() > edge:
                    i, j = np.divmod(np.flatnonzero(~(gap > edge)), len(near))
                    for at in range(0, len(i), PAIRS_WIDE):
                        r, c = i[at : at + PAIRS_WIDE], j[at : at + PAIRS_WIDE]
                        gap[r, c] = ((mine[r] - near[c]) ** 2).sum(axis=1)
                np.sqrt(gap, out=gap)
                of_a[start : start + len(mine), columns] += np.add.reduceat(gap, at_b, axis=1)
                if not alone:
                    rows, at_a = cuts(runs_a, start, start + len(mine))
                    of_b[rows, first : first + len(near)] += np.add.reduceat(gap, at_a, axis=0)

        def told(part, found, total):
            return pd.DataFrame({
                "key": np.repeat(part["key"].to_numpy(), len(found)), "c": np.repeat(part["c"].to_numpy(), len(found)),
                "other": np.tile(found, len(part)), "total": total.ravel(),
            })

        return told(a, found_b, of_a) if alone else pd.concat([told(a, found_b, of_a), told(b, found_a, of_b.T)])

    per_block = compare_blocks(
        points, points, "key", blocks, blocks, sums, f"key {kind}, c bigint, other bigint, total double", True
    )
    totals = per_block.groupBy("key", "c", "other").agg(F.sum("total").alias("total"))
    mine = F.col("c") == F.col("other")
    means = totals.join(sizes, "other").groupBy("key", "c").agg(
        F.max(F.when(mine & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    # A point alone in its cluster scores 0.
    score = F.when(F.col("a").isNull() | (widest == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / widest)
    return means.select(F.col("key").alias(key), F.col("c").alias("cluster"), score.alias("silhouette"))


def silhouette(df: DataFrame, key: str, features, label: str = "cluster", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return silhouette_points(df, key, features, label, rows_per_block).agg(F.avg("silhouette").alias("silhouette_score"))


#: Centroids that every task may hold.
MAX_CENTROIDS = 20_000


def silhouette_sq_euclidean(df: DataFrame, features, label: str = "cluster") -> DataFrame:
    """Silhouette under squared distance at linear cost: a different figure, so named apart.

    The mean squared distance to a cluster is the squared distance to its
    centroid plus its variance, so each point meets each centroid once. Meant for
    clusterings with few clusters: more than ``MAX_CENTROIDS`` are refused.
    """
    points = _points(df, features, label)
    # One centroid per cluster comes back: clusters times width numbers, not data rows.
    clusters = (
        _moments(points)
        .groupBy(F.col("c").alias("other"))
        .agg(
            F.max("n").alias("n"),
            F.sum("v").alias("spread"),
            F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"),
        )
        .select("other", "n", "spread", F.col("cells.m").alias("centroid"))
        .limit(MAX_CENTROIDS + 1)
        .collect()
    )
    if len(clusters) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} clusters to compare")
    if not clusters:
        return points.agg(F.lit(None).cast("double").alias("silhouette_sq_euclidean"))
    first = [r.asDict() for r in clusters]

    def score(batches):
        import numpy as np
        import pandas as pd

        ids = np.array([k["other"] for k in first])
        size = np.array([k["n"] for k in first], dtype=float)
        spread = np.array([k["spread"] for k in first])
        centre = np.array([k["centroid"] for k in first])
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"])
            mean = np.stack([spread[i] + ((x - c) ** 2).sum(axis=1) for i, c in enumerate(centre)], axis=1)
            own = batch["c"].to_numpy()[:, None] == ids[None, :]
            n_own = (own * size).sum(axis=1)
            a = (mean * own).sum(axis=1) * n_own / np.maximum(n_own - 1, 1)
            b = np.where(own, np.inf, mean).min(axis=1)
            top = np.maximum(a, b)
            s = np.where((n_own > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pd.DataFrame({"s": s})

    return points.select("c", "x").mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette_sq_euclidean"))


def cluster_health(df: DataFrame, features, label: str = "cluster", min_rows: int = MIN_CLUSTER_ROWS) -> DataFrame:
    """Counts, data problems and a grade of a clustering; one row."""
    slim = df.select(as_column(label).cast("bigint").alias("c"), as_array(df, features).alias("x"))
    sizes = slim.filter(F.col("c") != -1).groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    per_feature = (
        slim.select(F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(
            F.count_if(F.isnan("v") | F.col("v").isNull()).alias("nans"),
            F.count_if(F.abs("v") == float("inf")).alias("infs"),
            F.var_pop("v").alias("variance"),
        )
    )
    facts = sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_valid"),
        F.count_if(F.col("size") < min_rows).alias("small_clusters"),
    ).withColumn("k", F.lit(0))
    noise = slim.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("c") == -1).alias("n_noise")).withColumn("k", F.lit(0))
    quality = per_feature.agg(
        F.count_if(F.col("variance") == 0).alias("zero_variance_features"),
        F.coalesce(F.sum(F.col("nans") + F.col("infs")), F.lit(0)).alias("invalid_cells"),
    ).withColumn("k", F.lit(0))
    # Three one-row frames.
    row = noise.join(facts, "k").join(quality, "k").drop("k")
    issues = (F.col("zero_variance_features") > 0) | (F.col("invalid_cells") > 0)
    grade = (
        F.when(F.col("n_samples") == 0, "invalid")
        .when((F.col("n_clusters") < 2) | (F.col("n_samples") < MIN_ROWS), "poor")
        .when(F.col("small_clusters") > 0, "poor")
        .when(issues, "acceptable")
        .otherwise("good")
    )
    return row.withColumn("grade", grade)


def noise_share(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.agg(F.avg((as_column(label) == -1).cast("int")).alias("noise_share"))


def clustering_metrics(df: DataFrame, key: str, features, label: str = "cluster", exact: bool = True) -> DataFrame:
    """Long form ``metric, value``: the silhouette (exact or squared), Davies-Bouldin, Calinski-Harabasz."""
    one = silhouette(df, key, features, label) if exact else silhouette_sq_euclidean(df, features, label)
    parts = [one, davies_bouldin(df, features, label), calinski_harabasz(df, features, label)]
    out = None
    for part in parts:
        long = part.unpivot([], part.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out
