"""The routes large tables take, forced on small ones and checked by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.operators import association, cluster_metrics, cumulate, density, neighbors, sampling, tiles
from gridsmith.operators.codes import code_table
from gridsmith.operators.counting import distinct_near, distinct_within
from gridsmith.operators.cumulate import exact_quantiles, grouped_quantiles, running_totals
from gridsmith.operators.metrics import roc_auc, roc_curve, score_counts


@pytest.mark.parametrize("direct_rows", [0, 1_000_000])
def test_quantiles_of_a_skewed_column(spark, monkeypatch, direct_rows):
    monkeypatch.setattr(cumulate, "DIRECT_ROWS", direct_rows)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 2, 60_000), np.full(30_000, 5.0)])
    df = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(x)], "x double, y double").repartition(8)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, ["x", "y"], probs).collect()}
    assert np.allclose(got["x"], np.quantile(x, probs), rtol=1e-12)
    assert np.allclose(got["y"], np.quantile(np.arange(len(x)) % 3, probs))


def test_grouped_quantiles_with_one_hot_group(spark):
    rng = np.random.default_rng(4)
    n = 90_000
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    x = rng.normal(size=n) * (g + 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    for r in grouped_quantiles(df, "g", "x", [0.1, 0.5, 0.9]).collect():
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.quantile(x[g == r["g"]], [0.1, 0.5, 0.9]))


@pytest.mark.parametrize("per_bucket", [10, 1000])
def test_running_totals_in_buckets(spark, per_bucket):
    rows = [("a", float(i), i % 7) for i in range(500)] + [("b", float(-i), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    got = {(r["g"], r["v"]): (r["n_below"], r["n_total"]) for r in running_totals(df, "g", "v", ["n"], per_bucket).collect()}
    for g in "ab":
        total = 0
        values = sorted((v, n) for h, v, n in rows if h == g)
        for v, n in values:
            assert got[g, v] == (total, sum(m for _, m in values))
            total += n


def test_text_codes_in_buckets(spark):
    words = [f"w{i * 37 % 1009:04d}" for i in range(1009)]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "w string")
    one = df.select(F.col("w").alias("value")).distinct().dropna().withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    cut = running_totals(one, "_all", "value", ["_one"], rows_per_bucket=50)
    want = {w: i for i, w in enumerate(sorted(words))}
    assert {r["value"]: r["_one_below"] for r in cut.collect()} == want
    assert {r["value"]: r["code"] for r in code_table(df, "w").collect()} == want


@pytest.mark.parametrize("route", [{}, {"broadcast_cells": 0, "tile_rows": 60, "pivots": 8}])
def test_nearest_with_many_copies(spark, route):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 3)), np.tile([[2.0, 2.0, 2.0]], (250, 1)), rng.normal(5, 3, size=(100, 3))])
    rows = [(i, [float(v) for v in p], [float(i)]) for i, p in enumerate(x)]
    t = spark.createDataFrame(rows, "id bigint, x array<double>, payload array<double>")
    got = {}
    for r in neighbors.nearest(t.select("id", "x"), t, 5, exclude_self=True, **route).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["tid"], r["distance"])
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(len(x)), d.round(12)))[:5]
        assert np.allclose([got[i][k][1] for k in range(1, 6)], d[order])
    copies = [got[i] for i in range(300, 550)]
    assert all(c[1][1] == 0 for c in copies)


@pytest.mark.parametrize("route", [{}, {"broadcast_cells": 0, "tile_rows": 60, "pivots": 8}])
def test_knn_imputation_by_brute_force(spark, route):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[rng.random(x.shape) < 0.08] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in neighbors.knn_impute(df, ["id"], ["a", "b", "c"], 5, **route).collect()}
    assert len(got) == 400
    for i in np.flatnonzero(np.isnan(x).any(1)):
        known = ~np.isnan(x[i])
        both = known & ~np.isnan(x)
        shared = both.sum(1)
        gap = np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0).sum(1)
        d = np.where(shared > 0, np.sqrt(gap * 3 / np.maximum(shared, 1)), np.inf)
        for f in np.flatnonzero(~known):
            near = np.where(~np.isnan(x[:, f]), d, np.inf)
            ids = np.argsort(near, kind="stable")[:5]
            ids = ids[np.isfinite(near[ids])]
            want = x[ids, f].mean() if len(ids) else np.nanmean(x[:, f])
            assert got[i][f] == pytest.approx(want)


def brute_dbscan(x, eps, least, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    elif metric == "manhattan":
        d = np.abs(x[:, None] - x[None]).sum(2)
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core, label, c = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], c
        while stack:
            j = stack.pop()
            if core[j]:
                for k in np.flatnonzero(near[j]):
                    if label[k] == -1:
                        label[k] = c
                        stack.append(k)
        c += 1
    return label


@pytest.mark.parametrize(
    "width,eps,least,metric,per_box",
    [(2, 0.25, 6, "euclidean", 3), (3, 0.5, 5, "manhattan", 1000), (5, 0.9, 5, "euclidean", 1000), (3, 0.01, 5, "cosine", 1000),
     (16, 2.4, 5, "euclidean", 1000), (16, 2.4, 5, "euclidean", 4), (6, 3.5, 4, "manhattan", 3), (3, 0.01, 5, "cosine", 2)],
)
def test_dbscan_by_brute_force(spark, width, eps, least, metric, per_box):
    rng = np.random.default_rng(0)
    x = np.vstack([
        rng.normal(size=(150, width)), rng.normal(4, 0.6, size=(90, width)),
        np.tile(rng.normal(2, 1, size=(1, width)), (120, 1)), rng.uniform(-6, 8, size=(40, width)),
    ])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, x array<double>")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, "id", "x", eps, least, metric, per_box).collect()}
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, eps, least, metric))


@pytest.mark.parametrize("width,eps,metric", [(5, 1.2, "euclidean"), (6, 3.0, "manhattan"), (16, 0.1, "cosine")])
def test_dbscan_compares_open_points_only(spark, monkeypatch, width, eps, metric):
    """Most points hang together by way of a few: only the others are dealt to tiles, and the labels are those of all pairs."""
    rng = np.random.default_rng(3)
    far = np.where(np.arange(width) % 2, -3.0, 3.0)
    x = np.vstack([
        rng.normal(3, 0.5, size=(600, width)), far + rng.normal(0, 0.3, size=(60, width)), rng.uniform(-6, 8, size=(60, width)),
        np.tile(far * 2.5, (9, 1)), 3 + rng.normal(0, 0.85, size=(60, width)),
    ])
    monkeypatch.setattr(density, "PROBES", 80)
    monkeypatch.setattr(density, "OPEN_ROWS", 40)
    monkeypatch.setattr(density, "SETTLED_ROWS", 90)
    dealt = []
    plain = density._tiles
    monkeypatch.setattr(density, "_tiles", lambda points, *more: dealt.append(points.count()) or plain(points, *more))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, x array<double>")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, "id", "x", eps, 5, metric).collect()}
    want = list(brute_dbscan(x, eps, 5, metric))
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 2 and -1 in want
    assert dealt[0] < len(x) / 2


def test_silhouette_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(120, 2)), rng.integers(-1, 3, 120)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(k)) for i, (p, k) in enumerate(zip(x, c))], "id bigint, x array<double>, cluster int")
    one = cluster_metrics.silhouette(df, "id", "x").first()[0]
    many = cluster_metrics.silhouette(df, "id", "x", rows_per_block=17).first()[0]
    x, c = x[c >= 0], c[c >= 0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = c == c[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert one == pytest.approx(np.mean(s)) and many == pytest.approx(np.mean(s))


def test_segments_split_hot_and_small_strata(spark):
    rows = [(i, "hot" if i % 3 else "b") for i in range(3000)] + [(3000, "single"), (3001, None)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    out = sampling.split_rows(df, ["k"], 0.2, "s").groupBy("s", "part").count().collect()
    counts = {(r["s"], r["part"]): r["count"] for r in out}
    assert counts == {("hot", "test"): 400, ("hot", "train"): 1600, ("b", "test"): 200, ("b", "train"): 800, ("single", "train"): 1, (None, "train"): 1}
    folds = sampling.assign_folds(df, ["k"], 5, "s").groupBy("s", "fold").count().filter("s = 'b'").collect()
    assert sorted(r["count"] for r in folds) == [200] * 5


def test_distinct_near_is_exact_close_to_a_mark(spark):
    df = spark.range(1000).selectExpr("id % 100 as a", "id % 101 as b", "id as c", "cast(null as string) as d")
    assert distinct_within(df, ["a", "b", "c", "d"], 100) == {"a": 100, "b": None, "c": None, "d": 0}
    assert distinct_near(df, {"c": [1000.0]})["c"] == 1000


def test_auc_and_curve_agree(spark):
    rng = np.random.default_rng(6)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    counts = score_counts(df, "y", "s", 1)
    auc = roc_auc(counts).first()[0]
    wins = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert auc == pytest.approx(wins)
    points = sorted((r["fpr"], r["tpr"]) for r in roc_curve(counts).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(auc)


@pytest.mark.parametrize("few_pairs", [0, 100])
def test_constant_columns_have_no_correlation(spark, monkeypatch, few_pairs):
    monkeypatch.setattr(association, "FEW_PAIRS", few_pairs)
    df = spark.range(50).selectExpr("cast(id as double) a", "2.5D b", "cast(null as double) c", "cast(id * id as double) d")
    got = {(r["a"], r["b"]): r["r"] for r in association.pearson_matrix(df).collect()}
    assert got["a", "b"] is None and got["a", "c"] is None and got["a", "d"] > 0.9
    line = association.trend_line(df, "b", "a").first()
    assert line["slope"] is None


def test_categories_add_no_jobs_to_an_association(spark):
    import time
    import uuid

    from gridsmith.operators import association

    names = [f"c{i}" for i in range(30)]
    df = spark.range(500).select("id", *[(F.col("id") * (i + 3) % (i + 2)).cast("string").alias(c) for i, c in enumerate(names)])

    def jobs(columns):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        start = time.time()
        planned = association.mixed_association(df, ["id"], columns)
        planned._jdf.queryExecution().executedPlan()
        took = time.time() - start
        planned.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), took, planned

    few, _, _ = jobs(names[:2])
    many, _, _ = jobs(names)
    again, took, planned = jobs(names)
    assert many <= few + 4 and again <= few + 4
    assert took < 10 and planned.count() == 31 * 31


def test_wide_points_are_copied_a_bounded_number_of_times(spark):
    """Groups along a line: each row is compared in the tiles around it, however many rows there are."""
    rng = np.random.default_rng(2)
    centres = np.arange(60)[:, None] * 40.0 * np.ones((1, 8))
    x = np.vstack([c + rng.normal(0, 0.2, size=(50, 8)) for c in centres])
    points = spark.createDataFrame([(str(i), [float(v) for v in p], 1, i) for i, p in enumerate(x)], "id string, x array<double>, w bigint, first bigint")
    tiles = density._tiles(density._placed(points, 8, "euclidean").select("id", "at"), 8, 1.5, 200)
    assert tiles.count() <= 5 * len(x) and tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= 200


def test_odd_wide_points(spark):
    schema = "id bigint, x array<double>"
    wide = [0.5] * 9
    assert {r["cluster"] for r in density.dbscan(spark.createDataFrame([(1, wide), (2, wide)], schema), "id", "x", 0.1, 2).collect()} == {0}
    assert [r["cluster"] for r in density.dbscan(spark.createDataFrame([(1, wide)], schema), "id", "x", 0.1, 2).collect()] == [-1]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], schema)
    assert {r["id"]: r["cluster"] for r in density.dbscan(zero, "id", "x", 0.2, 2, "cosine").collect()} == {1: -1, 2: 0, 3: 0}


@pytest.mark.parametrize("patterns", [3, 64])
def test_nearest_under_gaps_visits_few_tiles(spark, monkeypatch, patterns):
    """Groups far apart, a third of the cells missing: exact answers, and no tile that all rows visit."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.uniform(0, 4000, size=(30, 5)), 30, axis=0) + rng.normal(size=(900, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:40] = np.nan_to_num(x[:40], nan=7.0)
    x[40] = np.nan
    routed = []
    monkeypatch.setattr(neighbors, "MAX_PATTERNS", patterns)
    keep = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda df: routed.append(keep(df)) or routed[-1])
    rows = [(i, [float(v) for v in p], [float(i)]) for i, p in enumerate(x)]
    t = spark.createDataFrame(rows, "id bigint, x array<double>, payload array<double>")
    got = {}
    for r in neighbors.nearest(t.select("id", "x"), t, 4, broadcast_cells=0, tile_rows=20, pivots=200).collect():
        got.setdefault((r["qid"], r["feature"]), []).append((r["rank"], r["distance"]))
    known = ~np.isnan(x)
    for i in range(len(x)):
        both = known[i] & known
        shared = both.sum(1)
        gap = np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0).sum(1)
        d = np.where(shared > 0, np.sqrt(gap * 5 / np.maximum(shared, 1)), np.inf)
        for f in np.flatnonzero(~known[i]) if not known[i].all() else [-1]:
            want = np.sort(d if f < 0 else np.where(known[:, f], d, np.inf))[:4]
            assert np.allclose([v for _, v in sorted(got.get((i, f), []))], want[np.isfinite(want)])
    tiles = next(r for r in routed if "tile" in r.columns)
    visits = tiles.groupBy("tile").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert patterns < 64 or visits < 0.6 * len(x)


def test_nearest_without_gaps_visits_few_tiles(spark, monkeypatch):
    """Dense points, copies among them: a row knows from a sample how far its neighbours can be and visits its surroundings only."""
    rng = np.random.default_rng(6)
    x = np.hstack([rng.normal(size=(6000, 2)), rng.integers(0, 4, size=(6000, 1))])
    x[:50], x[50:60] = x[100:150], x[50]
    routed = []
    keep = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda df: routed.append(keep(df)) or routed[-1])
    t = spark.createDataFrame([(i, p.tolist(), [float(i)]) for i, p in enumerate(x)], "id bigint, x array<double>, payload array<double>")
    got = {}
    for r in neighbors.nearest(t.select("id", "x"), t, 4, exclude_self=True, broadcast_cells=0, tile_rows=300, pivots=40).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["distance"], r["tid"], r["payload"][0]))
    for i in [*range(120), *range(120, 6000, 37)]:
        d = np.sqrt((((x - x[i]) ** 2)[:, 0] + ((x - x[i]) ** 2)[:, 1] + ((x - x[i]) ** 2)[:, 2]) * 3 / 3.0)
        near = [j for j in np.lexsort((np.arange(6000), d)) if j != i][:4]
        assert sorted(got[i]) == [(n + 1, d[j], j, float(j)) for n, j in enumerate(near)]
    tiles = next(r for r in routed if "tile" in r.columns)
    assert tiles.count() < 3 * len(x)


def test_wide_singular_values_without_a_square_matrix(spark):
    from gridsmith.operators.stages import truncated_svd

    rng = np.random.default_rng(8)
    x = (rng.normal(size=(400, 30)) * 0.7 ** np.arange(30)) @ rng.normal(size=(30, 600))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>").repartition(6)
    out, found = truncated_svd(df, "id", "features", 4)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(found, s[:4], rtol=1e-9)
    got = np.array([r["svd"] for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-4 * s[0])
    empty = truncated_svd(df.limit(0), "id", "features", 2)
    assert empty[1] == [] and empty[0].collect() == []


def test_paths_with_a_long_common_beginning_are_cut_into_ranges(spark):
    start = "https://example.org/" + "folder/" * 20
    rows = [(0, f"{start}é{i:05d}/page", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v string, n bigint")
    shared, ends = cumulate._text_bounds(df, "v", 10, 3000)
    assert shared >= len(start) and len(set(ends)) == 9
    got = {r["v"]: (r["n_below"], r["n_total"]) for r in running_totals(df, "g", "v", ["n"], 300).collect()}
    assert got == {v: (i, 3000) for i, (_, v, _) in enumerate(rows)}


@pytest.mark.parametrize("literal", [0, 64])
def test_codes_by_join_and_by_map_agree(spark, monkeypatch, literal):
    from gridsmith.operators import codes, preparation

    monkeypatch.setattr(codes, "LITERAL_LEVELS", literal)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"w{i % 7}") for i in range(40)], "id bigint, `a.b` string")
    levels = ["w1", "w2", "w5"]
    place = lambda v: levels.index(v) if v in levels else -1
    got = {r["id"]: r["a.b"] for r in preparation.ordinal_encode(df, "a.b", "a.b", levels).collect()}
    assert got == {i: float(place(None if i % 5 == 0 else f"w{i % 7}")) for i in range(40)}
    labels = {r["id"]: r["label"] for r in codes.encode_labels(df, "a.b", classes=levels).collect()}
    assert labels == {i: None if v < 0 else v for i, v in got.items()}
    assert preparation.ordinal_encode(df, "a.b", "o", levels).columns == ["id", "a.b", "o"]


def test_mode_of_long_texts(spark):
    from gridsmith.operators.preparation import most_frequent

    long_a, long_b = "a" * 500, "b" * 500
    rows = [(long_b, "x", None, long_a)] * 3 + [(long_a, "y", None, "short")] * 3 + [("z", "y", None, "short")] * 2 + [(None, long_a, None, long_a)] * 2
    df = spark.createDataFrame(rows, "p string, `q.r` string, s string, t string")
    assert most_frequent(df, df.columns) == {"p": long_a, "q.r": "y", "t": long_a}
    assert most_frequent(df.limit(0), ["p"]) == {} == most_frequent(df, [])


def test_tiles_are_not_cut_where_all_rows_are_within_reach(spark):
    """Cutting along every coordinate would only copy the visitors, again and again."""
    x = np.random.default_rng(8).normal(0, 0.1, size=(600, 16))
    points = spark.createDataFrame([(str(i), [float(v) for v in p]) for i, p in enumerate(x)], "id string, at array<double>")
    tiles = density._tiles(points, 16, 0.3, 100).collect()
    assert len(tiles) < 60 * len(x)
    together = {}
    for r in tiles:
        together.setdefault(r["tile"], []).append(r)
    met = set()
    for rows in together.values():
        home, guests = [int(r["id"]) for r in rows if r["home"]], [int(r["id"]) for r in rows if not r["home"]]
        own = next(r["own"] for r in rows if r["home"])
        found = [(a, b) for a in home for b in guests] + [(a, b) for a in home for b in home if own and a < b]
        pairs = {(min(p), max(p)) for p in found}
        assert len(pairs) == len(found) and not pairs & met  # no pair is counted twice
        met |= pairs
    near = np.abs(x[:, None] - x[None]).max(axis=2) <= 0.3
    assert all((i, j) in met for i, j in zip(*np.nonzero(np.triu(near, 1))))


def test_many_candidates_are_not_sent_to_every_task(spark, monkeypatch):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(30_000, 2))
    t = spark.createDataFrame([(i, p.tolist(), [float(i)]) for i, p in enumerate(points)], "id long, x array<double>, payload array<double>")
    monkeypatch.setattr(neighbors, "_nearest_broadcast", lambda *a: pytest.fail("all candidates sent to every task"))
    found = {(r["qid"], r["rank"]): r["tid"] for r in neighbors.nearest(t.filter("id % 1000 = 0").select("id", "x"), t, 3).collect()}
    for q in range(0, 30_000, 1000):
        want = np.argsort(((points - points[q]) ** 2).sum(axis=1), kind="stable")[:3]
        assert [found[q, r] for r in (1, 2, 3)] == want.tolist()


def test_a_link_inside_a_component_is_joined_in_one_round(spark, monkeypatch):
    rng = random.Random(4)
    # A long chain in ascending order, and a group in which many pairs are linked.
    links = [(i, i + 1) for i in range(300)] + [(rng.randint(1000, 1099), rng.randint(1000, 1099)) for _ in range(900)] + [(None, 5), (2000, 2000)]
    edges = spark.createDataFrame(links, "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in [*range(301), *range(1000, 1100), 2000, 3000, None]], "node long")
    joined = []
    kind = type(edges)
    plain = kind.join

    def watched(self, *args, **kwargs):
        if "b" in self.columns:
            joined.append(self.count())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(kind, "join", watched)
    found = {r.node: r.component for r in density.connected_components(nodes, edges).collect()}
    expected = {n: 0 if n < 301 else n for n in [*range(301), 2000, 3000]}
    root = {n: n for n in range(1000, 1100)}
    for _ in root:
        for a, b in links:
            if a is not None and 1000 <= a < 1100:
                root[a] = root[b] = min(root[a], root[b])
    assert found == expected | root | {None: None}
    assert sum(joined) <= 4 * len(links)


def test_silhouette_blocks_of_a_large_table_hold_more_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)) + np.arange(400)[:, None] % 3
    df = spark.createDataFrame([(i, v.tolist(), i % 4 - 1) for i, v in enumerate(x)], "id long, x array<double>, cluster long")
    counts = []
    plain = cluster_metrics.compare_blocks

    def watched(left, right, key, left_blocks, right_blocks, *more):
        counts.append((left_blocks, right_blocks))
        return plain(left, right, key, left_blocks, right_blocks, *more)

    monkeypatch.setattr(cluster_metrics, "compare_blocks", watched)
    monkeypatch.setattr(cluster_metrics, "MANY_BLOCKS", 4)
    monkeypatch.setattr(cluster_metrics, "PAIRS_WIDE", 30)
    small = {r.id: r.silhouette for r in cluster_metrics.silhouette_points(df, "id", "x", rows_per_block=20).collect()}
    whole = {r.id: r.silhouette for r in cluster_metrics.silhouette_points(df, "id", "x").collect()}
    # 300 points without noise: blocks of 75 rows, where those of 20 rows made 15.
    assert counts == [(4, 4), (1, 1)]
    assert small.keys() == whole.keys() and all(abs(small[k] - whole[k]) < 1e-12 for k in whole)
    clustered = {i: [j for j in range(400) if j % 4 == i] for i in (1, 2, 3)}
    for k in (1, 6, 399):
        away = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        a = away[clustered[k % 4]].sum() / (len(clustered[k % 4]) - 1)
        b = min(away[rows].mean() for c, rows in clustered.items() if c != k % 4)
        assert abs(whole[k] - (b - a) / max(a, b)) < 1e-12


def test_each_two_blocks_of_points_meet_once(spark):
    df = spark.range(200).select("id", F.array(F.col("id").cast("double")).alias("x"))

    def met(a, b):
        import pandas as pd

        return pd.DataFrame({"i": [a["_i"].iloc[0]], "j": [a["_j"].iloc[0]], "pairs": [len(a) * len(b)]})

    rows = tiles.compare_blocks(df, df, "id", 5, 5, met, "i bigint, j bigint, pairs bigint", True).collect()
    assert sorted((r.i, r.j) for r in rows) == [(i, j) for i in range(5) for j in range(i, 5)]
    assert sum(r.pairs * (1 if r.i == r.j else 2) for r in rows) == 200 * 200


def test_silhouette_of_close_points_far_from_the_origin(spark):
    """Squares of coordinates would swallow the distances: copies are at distance nothing, near points at theirs."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 3)) * 1e-3, rng.normal(size=(30, 3)) * 1e-3 + 0.01, np.full((20, 3), 7.0), np.full((20, 3), 9.0)]) + 1e5
    x[:5] = x[5]
    label = [0] * 30 + [1] * 30 + [2] * 20 + [3] * 20
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, x array<double>, cluster long")
    for rows in (17, 1000):
        got = {r.id: r.silhouette for r in cluster_metrics.silhouette_points(df, "id", "x", rows_per_block=rows).collect()}
        for i in range(100):
            away = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            mean = [away[np.array(label) == c].sum() / (label.count(c) - (c == label[i])) for c in range(4)]
            a, b = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
            assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
