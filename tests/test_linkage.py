import numpy as np
import pytest

from gridsmith.operators.linkage import Agglomerative, AgglomerativeModel, merge_clusters
from gridsmith.plans.catalog import search_grid


def brute(x, wanted, linkage, metric):
    """Merge the closest two groups of rows until ``wanted`` are left, by the definition of each rule."""
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
    elif metric == "manhattan":
        d = np.abs(x[:, None] - x[None]).sum(2)
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[i] for i in range(len(x))]

    def far(a, b):
        if linkage == "ward":
            gap = x[a].mean(axis=0) - x[b].mean(axis=0)
            return 2 * len(a) * len(b) / (len(a) + len(b)) * (gap @ gap)
        part = d[np.ix_(a, b)]
        return {"average": part.mean, "complete": part.max, "single": part.min}[linkage]()

    while len(groups) > wanted:
        _, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage, metric", [("ward", "euclidean"), ("average", "manhattan"), ("complete", "cosine"), ("single", "euclidean"), ("average", "cosine")])
def test_every_rule_by_brute_force(spark, tmp_path, linkage, metric):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1.0, size=(14, 3)) for c in (2, 6, 11)])
    x = np.vstack([x, x[:5], x[:3]])  # copies weigh as many rows
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>").repartition(4)
    model = Agglomerative(k=4, linkage=linkage, metric=metric).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    groups = {}
    for r in AgglomerativeModel.load(str(tmp_path / "m")).transform(df).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(groups) == [0, 1, 2, 3]
    assert {frozenset(g) for g in groups.values()} == brute(x, 4, linkage, metric)


def test_gathered_rows_keep_groups_apart(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 1.0, size=(400, 2)) for c in (0, 40, 90)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    for linkage in ("ward", "single"):
        found = Agglomerative(k=3, linkage=linkage, micro=60).fit(df)
        assert len(found.value()["labels"]) <= 60
        rows = found.transform(df).orderBy("id").collect()
        assert [len({r["cluster"] for r in rows[i : i + 400]}) for i in (0, 400, 800)] == [1, 1, 1]
        assert len({r["cluster"] for r in rows}) == 3


def test_odd_inputs(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id bigint, features array<double>")
    assert {r["cluster"] for r in Agglomerative(k=3).fit(one).transform(one).collect()} == {0}
    assert Agglomerative().fit(one.limit(0)).transform(one.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Agglomerative(linkage="ward", metric="cosine").fit(one)
    assert list(merge_clusters(np.array([[0.0], [1.0], [10.0]]), [1, 1, 1], 2, "single")) == [0, 0, 1]
    assert len(search_grid("clustering", "hierarchical")) == 16
