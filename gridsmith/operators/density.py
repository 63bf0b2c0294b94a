"""DBSCAN on a grid, with exact cell links, and on a grid of few projected coordinates where there are many.

Equal points are folded into one weighted point. A cell is small enough that
its points are all within reach of each other, so a crowded cell is core as a
whole and its inside needs no comparison. Cells are linked by comparing the
boxes of their parts, splitting only parts whose boxes leave the answer open.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.cumulate import running_totals
from gridsmith.operators.tiles import as_array
from gridsmith.session import cut_lineage

# More dimensions than this and the neighbouring cells outnumber the points.
GRID_DIMENSIONS = 4
# Boxes with at most this many points are compared point by point.
POINTS_PER_BOX = 1000
# Coordinates of wider points along which tiles may be cut.
COORDINATES = 16
# Points that every other meets first, up to so many numbers; tables of fewer than twice as many points do without.
PROBES, PROBE_CELLS = 8192, 2_000_000
# Rows that are compared at once, so that their distances stay in the processor's cache, and with how many others.
ROWS_HIGH, ROWS_WIDE = 64, 4096
# Open and settled rows of a block.
OPEN_ROWS, SETTLED_ROWS = 16_384, 65_536


def dbscan(
    df: DataFrame, key: str, features, eps: float, min_samples: int = 5, metric: str = "euclidean",
    points_per_box: int = POINTS_PER_BOX,
) -> DataFrame:
    """``key, cluster``: clusters numbered by their smallest core key, noise -1.

    A border point within reach of several clusters joins the lowest number.
    """
    points = df.select(as_column(key).alias("key"), as_array(df, features).alias("x"))
    folded = points.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min("key").alias("first"))
    folded = cut_lineage(folded.withColumn("id", F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    width = folded.select(F.max(F.size("x"))).first()[0]
    if not width:
        return points.select(F.col("key").alias(key), F.lit(-1).cast("bigint").alias("cluster"))
    if width <= GRID_DIMENSIONS and metric in ("euclidean", "manhattan"):
        labelled = _on_grid(folded, width, eps, min_samples, metric, points_per_box)
    else:
        labelled = _on_projections(folded, width, eps, min_samples, metric, 4 * points_per_box)
    # ``x, component`` with NULL for noise; number the components by first core key.
    firsts = labelled.filter("core").groupBy("component").agg(F.min("first").alias("first"))
    ranked = running_totals(
        firsts.select(F.lit(0).alias("_all"), "component", "first", F.lit(1).alias("_one")), "_all", "first", ["_one"]
    ).select(F.col("component").alias("_c"), F.col("_one_below").cast("bigint").alias("cluster"))
    core = labelled.filter("core").join(ranked, F.col("component") == F.col("_c")).select("x", "cluster")
    border = (
        labelled.filter(~F.col("core"))
        .select("x", F.explode_outer("reach").alias("component"))
        .join(ranked, F.col("component") == F.col("_c"), "left")
        .groupBy("x")
        .agg(F.coalesce(F.min("cluster"), F.lit(-1).cast("bigint")).alias("cluster"))
    )
    named = core.unionByName(border)
    return points.join(named, "x").select(F.col("key").alias(key), "cluster")


def _gap(a: Column, b: Column, metric: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y) if metric == "manhattan" else (x - y) * (x - y))
    total = F.aggregate(parts, F.lit(0.0), lambda t, s: t + s)
    return total if metric == "manhattan" else F.sqrt(total)


def _box_gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column, metric: str, furthest: bool) -> Column:
    """Smallest or largest distance between two boxes."""
    up = F.zip_with(high_b, low_a, lambda x, y: x - y)
    down = F.zip_with(high_a, low_b, lambda x, y: x - y)
    if furthest:
        side = F.zip_with(up, down, lambda x, y: F.greatest(F.abs(x), F.abs(y)))
    else:
        up = F.zip_with(low_b, high_a, lambda x, y: x - y)
        down = F.zip_with(low_a, high_b, lambda x, y: x - y)
        side = F.zip_with(up, down, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    parts = F.transform(side, lambda v: v if metric == "manhattan" else v * v)
    total = F.aggregate(parts, F.lit(0.0), lambda t, s: t + s)
    return total if metric == "manhattan" else F.sqrt(total)


def _offsets(width: int, metric: str) -> list[tuple[int, ...]]:
    """Cells that can hold a point within reach, other than the cell itself."""
    span = width if metric == "manhattan" else math.ceil(math.sqrt(width))
    out = []
    for o in itertools.product(range(-span, span + 1), repeat=width):
        steps = [max(abs(v) - 1, 0) for v in o]
        near = sum(steps) <= width if metric == "manhattan" else sum(v * v for v in steps) <= width
        if any(o) and near:
            out.append(o)
    return out


def _cell(x: Column, side: float) -> Column:
    return F.transform(x, lambda v: F.floor(v / F.lit(side)))


def _on_grid(points: DataFrame, width: int, eps: float, min_samples: int, metric: str, per_box: int) -> DataFrame:
    side = eps / (width if metric == "manhattan" else math.sqrt(width))
    # A hair smaller, so that rounding cannot put two points of a cell out of reach.
    side *= 1 - 1e-12
    offsets = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in _offsets(width, metric)])
    points = points.withColumn("cell", _cell(F.col("x"), side))
    cells = points.groupBy("cell").agg(F.sum("w").alias("weight"))

    def around(c: Column) -> Column:
        return F.transform(offsets, lambda o: F.zip_with(c, o, lambda a, b: a + b))

    # Points of crowded cells are core. The others count their neighbours; a sparse
    # cell holds fewer than min_samples points, so a crowded neighbour meets few of them.
    crowded = cells.filter(F.col("weight") >= min_samples).select("cell")
    sparse = cut_lineage(
        points.join(cells, "cell").filter(F.col("weight") < min_samples)
        .select("id", "x", "w", "first", "cell", F.col("weight").alias("near"))
    )
    asked = sparse.select("id", F.col("x").alias("px"), F.explode(around(F.col("cell"))).alias("cell"))
    others = (
        asked.join(points.select("cell", "x", "w"), "cell")
        .filter(_gap(F.col("px"), F.col("x"), metric) <= eps)
        .groupBy("id")
        .agg(F.sum("w").alias("more"))
    )
    counted = sparse.join(others, "id", "left").withColumn(
        "core", F.col("near") + F.coalesce("more", F.lit(0)) >= min_samples
    )
    core_points = points.join(crowded, "cell", "left_semi").select("id", "x", "first", "cell").unionByName(
        counted.filter("core").select("id", "x", "first", "cell")
    )
    core_points = cut_lineage(core_points)
    edges = _linked_cells(core_points, around, side, eps, metric, per_box)
    components = connected_components(core_points.select(F.col("cell").cast("string").alias("node")).distinct(), edges)
    named = core_points.join(components, F.col("cell").cast("string") == F.col("node"))
    core = named.select("x", "first", "cell", "component")
    # Non-core points lie in sparse cells only.
    loose = counted.filter(~F.col("core")).select("id", "x", "first", "cell")
    own = F.array(F.col("cell"))
    reach = (
        loose.select("id", F.col("x").alias("px"), F.explode(F.concat(around(F.col("cell")), own)).alias("cell"))
        .join(core.select("cell", "x", "component"), "cell")
        .filter(_gap(F.col("px"), F.col("x"), metric) <= eps)
        .groupBy("id")
        .agg(F.collect_set("component").alias("reach"))  # no more clusters than adjacent cells
    )
    nothing = F.array().cast("array<string>")
    return core.select("x", "first", F.lit(True).alias("core"), "component", nothing.alias("reach")).unionByName(
        loose.join(reach, "id", "left").select(
            "x", "first", F.lit(False).alias("core"), F.lit(None).cast("string").alias("component"),
            F.coalesce("reach", nothing).alias("reach"),
        )
    )


def _linked_cells(core: DataFrame, around, side: float, eps: float, metric: str, per_box: int) -> DataFrame:
    """``a, b``: pairs of core cells with two core points within reach."""

    def boxes(level: int) -> DataFrame:
        part = F.concat_ws("/", F.col("cell").cast("string"), _cell(F.col("x"), side / 2**level).cast("string"))
        shape = core.withColumn("part", part)
        extremes = []
        for i in range(core_width):
            extremes += [F.min(F.col("x")[i]).alias(f"lo{i}"), F.max(F.col("x")[i]).alias(f"hi{i}")]
        return shape.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), *extremes).select(
            F.col("cell").cast("string").alias("name"), "part", "n",
            F.array(*[F.col(f"lo{i}") for i in range(core_width)]).alias("low"),
            F.array(*[F.col(f"hi{i}") for i in range(core_width)]).alias("high"),
        )

    first = core.select(F.size("x")).first()
    if first is None:
        return core.sparkSession.createDataFrame([], "a string, b string")
    core_width = first[0]
    cells = core.select("cell").distinct()
    other = cells.select(F.col("cell").alias("bcell"))
    pairs = (
        cells.select(F.col("cell").alias("acell"), F.explode(around(F.col("cell"))).alias("bcell"))
        .join(other, "bcell")
        .select(F.col("acell").cast("string").alias("a"), F.col("bcell").cast("string").alias("b"))
        .filter(F.col("a") < F.col("b"))
    )
    level, linked = 0, None
    open_parts = None
    while True:
        here = boxes(level)
        side_a = here.select(F.col("name").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("low").alias("la"), F.col("high").alias("ha"))
        side_b = here.select(F.col("name").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        # A cell has at most 2^(level * width) parts and only open pairs are split again.
        tried = pairs.join(side_a, "a").join(side_b, "b")
        near = _box_gap(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), metric, False)
        far = _box_gap(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), metric, True)
        judged = cut_lineage(tried.filter(near <= eps).select("a", "b", "pa", "pb", "na", "nb", (far <= eps).alias("sure")))
        sure = judged.filter("sure").select("a", "b").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        unsure = judged.join(sure, ["a", "b"], "left_anti")
        small = (F.col("na") <= per_box) & (F.col("nb") <= per_box)
        checkable = unsure.filter(small)
        exact = _exact_links(core, checkable, side / 2**level, eps, metric)
        linked = cut_lineage(linked.unionByName(exact).distinct())
        open_parts = unsure.filter(~small).select("a", "b").distinct().join(linked, ["a", "b"], "left_anti")
        pairs = cut_lineage(open_parts)
        if pairs.isEmpty():
            return linked
        level += 1


def _exact_links(core: DataFrame, pairs: DataFrame, side: float, eps: float, metric: str) -> DataFrame:
    """Pairs of parts, each of bounded size, with two points within reach."""
    part = F.concat_ws("/", F.col("cell").cast("string"), _cell(F.col("x"), side).cast("string"))
    keyed = core.withColumn("part", part).select("part", "x")
    used = pairs.select(F.explode(F.array("pa", "pb")).alias("part")).distinct()
    lists = keyed.join(used, "part", "left_semi").groupBy("part").agg(F.collect_list("x").alias("xs"))
    joined = pairs.join(lists.select(F.col("part").alias("pa"), F.col("xs").alias("xa")), "pa").join(
        lists.select(F.col("part").alias("pb"), F.col("xs").alias("xb")), "pb"
    )

    def check(batches):
        import numpy as np

        for batch in batches:
            hits = []
            for xa, xb in zip(batch["xa"], batch["xb"]):
                a, b = np.stack(xa), np.stack(xb)
                gap = np.zeros((len(a), len(b)))
                for i in range(a.shape[1]):
                    d = np.abs(a[:, i : i + 1] - b[None, :, i])
                    gap += d if metric == "manhattan" else d * d
                hits.append(bool((gap <= (eps if metric == "manhattan" else eps * eps)).any()))
            yield batch.loc[hits, ["a", "b"]]

    return joined.select("a", "b", "xa", "xb").mapInPandas(check, "a string, b string").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node name each node can reach.

    Every round lets each node point at its smallest neighbour, follows the
    pointers to their ends by halves, and goes on with the links between
    different ends only, so a link inside a group is joined in one round. Rounds
    are written to the checkpoint folder.
    """
    links = cut_lineage(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("by")), F.struct(F.col("b").alias("node"), F.col("a").alias("by"))))
        near = links.select(sides.alias("_s")).select("_s.*").groupBy("node").agg(F.min("by").alias("by"))
        heads = cut_lineage(near.select("node", F.least("node", "by").alias("head")))
        while True:
            up = heads.select(F.col("node").alias("_n"), F.col("head").alias("_h"))
            stepped = cut_lineage(heads.join(up, F.col("head") == F.col("_n")).select("node", F.col("_h").alias("head"), F.col("head").alias("old")))
            heads = stepped.select("node", "head")
            if stepped.filter(F.col("head") != F.col("old")).isEmpty():
                break
        ends = heads.select(F.col("node").alias("_n"), F.col("head").alias("_h"))
        named = cut_lineage(named.join(ends, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_h", "component").alias("component")))
        left = links.join(ends, F.col("a") == F.col("_n")).select(F.col("_h").alias("a"), "b")
        left = left.join(ends, F.col("b") == F.col("_n")).select("a", F.col("_h").alias("b")).filter("a != b")
        links = cut_lineage(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return named


def _placed(points: DataFrame, width: int, metric: str) -> DataFrame:
    """The points with ``at``: a few coordinates in which no two points are further apart than in all.

    By manhattan distance these are the columns of the largest variance, else
    principal components. By cosine, unit vectors take the points' place: their
    squared distance is twice the cosine distance.
    """
    most = min(width, COORDINATES)
    if metric == "manhattan":
        spread = points.agg(*[F.var_pop(F.col("x")[i]).alias(str(i)) for i in range(width)]).first()
        chosen = sorted(range(width), key=lambda i: (-(spread[i] or 0.0), i))[:most]
        return points.withColumn("at", F.array(*[F.col("x")[i] for i in chosen]))
    if metric == "cosine":
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
        points = points.withColumn("_unit", size).withColumn("x", F.transform("x", lambda v: v / F.greatest("_unit", F.lit(1e-300)))).drop("_unit")
    if len(points.take(2)) < 2:
        return points.withColumn("at", F.slice("x", 1, most))  # one point has no components
    vectors = points.withColumn("_v", array_to_vector("x"))
    axes = PCA(k=most, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors)
    return axes.withColumn("at", vector_to_array("_p")).drop("_v", "_p")


def _split(tiles: DataFrame, k: int, side: float) -> DataFrame:
    """Every tile cut along coordinate ``k`` into strips of width ``side``.

    Rows at home in a strip visit the strip below, so each two neighbouring
    strips meet once; visitors of the tile visit up to three strips. Visits to
    strips in which nobody is at home are dropped.
    """
    strip = F.floor(F.col("at")[k] / F.lit(side))
    here = F.when(F.col("home"), F.array(F.struct(strip.alias("b"), F.lit(True).alias("stays")), F.struct((strip - 1).alias("b"), F.lit(False).alias("stays")))).otherwise(
        F.transform(F.array(strip - 1, strip, strip + 1), lambda b: F.struct(b.alias("b"), F.lit(False).alias("stays")))
    )
    cut = tiles.select(F.explode(here).alias("_to"), "tile", "id", "at").select(
        F.concat_ws("/", "tile", F.col("_to.b").cast("string")).alias("tile"), "id", "at", F.col("_to.stays").alias("home")
    )
    settled = cut.filter("home").select("tile").distinct()
    return cut.join(settled, "tile", "left_semi")


def _comparisons(tiles: DataFrame) -> float:
    """Pairs of rows that the tiles compare; every tile has rows at home."""
    home = F.count_if("home").cast("double")
    each = tiles.groupBy("tile").agg((home * (F.count(F.lit(1)) - home / 2)).alias("pairs"))
    return each.agg(F.sum("pairs")).first()[0] or 0.0


def _tiles(points: DataFrame, width: int, reach: float, per_tile: int) -> DataFrame:
    """``tile, id, home, own``: rows that have to be compared, in tiles of bounded size.

    All rows are cut along the first two coordinates, and tiles of more than
    ``per_tile`` rows along further ones, as long as a cut saves half of the
    comparisons: where rows are within reach along a coordinate it would only
    copy visitors. What is crowded then is cut into blocks by hash. ``own`` tells whether the tile's home rows are
    compared with each other too.
    """
    most = min(width, COORDINATES)
    tiles = points.select(F.lit("").alias("tile"), "id", "at", F.lit(True).alias("home"))
    done = before = None
    for k in range(most):
        cut = cut_lineage(_split(tiles, k, reach))
        if k + 1 < min(2, most):
            tiles = cut
            continue
        if before is not None and 2 * _comparisons(cut) > before:
            break
        tiles = cut
        large = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > per_tile).select("tile")
        fit = tiles.join(large, "tile", "left_anti").select("tile", "id", "home", F.col("home").alias("own"))
        done = fit if done is None else done.unionByName(fit)
        tiles = cut_lineage(tiles.join(large, "tile", "left_semi"))
        before = _comparisons(tiles)
        if not before:
            return done
    sizes = tiles.groupBy("tile", "home").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_tile)).alias("blocks"))
    at_home = sizes.filter("home").select("tile", F.col("blocks").alias("_h"))
    guests = sizes.filter("not home").select("tile", F.col("blocks").alias("_g"))
    blocked = tiles.join(sizes, ["tile", "home"]).join(at_home, "tile").join(guests, "tile", "left")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    steps = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1).cast("bigint")
    # Home block i meets itself, the home blocks behind it and all blocks of visitors.
    meets = lambda mark, i, j, home, own: F.struct(F.concat_ws("#", "tile", F.lit(mark), i.cast("string"), j.cast("string")).alias("tile"), F.lit(home).alias("home"), F.lit(own).alias("own"))
    as_home = F.concat(
        F.array(meets("h", block, block, True, True)),
        F.transform(steps(block + 1, F.col("_h") - one), lambda j: meets("h", block, j, True, False)),
        F.transform(steps(one - 1, block - 1), lambda i: meets("h", i, block, False, False)),
        F.transform(steps(one - 1, F.coalesce("_g", F.lit(0).cast("bigint")) - one), lambda j: meets("g", block, j, True, False)),
    )
    as_guest = F.transform(steps(one - 1, F.col("_h") - one), lambda i: meets("g", i, block, False, False))
    dealt = blocked.select("id", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("_m")).select("_m.tile", "id", "_m.home", "_m.own")
    return dealt if done is None else done.unionByName(dealt)


def _within(a, b, eps: float, metric: str):
    """Which rows of ``a`` and ``b`` are within reach of each other."""
    import numpy as np

    if metric == "cosine":  # of unit vectors
        return 1.0 - a @ b.T <= eps
    if metric == "manhattan":
        total = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            total += np.abs(a[:, i : i + 1] - b[None, :, i])
        return total <= eps
    one, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    gap = np.hstack([-2 * a, one[:, None], np.ones((len(a), 1))]) @ np.hstack([b, np.ones((len(b), 1)), other[:, None]]).T
    near = gap <= eps * eps
    # Products round where differences do not; what lies on the edge is worked out from these.
    edge = 1e-12 * (one.max(initial=0.0) + other.max(initial=0.0) + eps * eps) * a.shape[1]
    np.abs(np.subtract(gap, eps * eps, out=gap), out=gap)
    i, j = np.divmod(np.flatnonzero(~(gap > edge)), max(len(b), 1))
    own = ~(gap[i, j] > 1e-12 * (one[i] + other[j] + eps * eps) * a.shape[1])
    i, j = i[own], j[own]
    for at in range(0, len(i), 100_000):
        d = a[i[at : at + 100_000]] - b[j[at : at + 100_000]]
        near[i[at : at + 100_000], j[at : at + 100_000]] = (d * d).sum(axis=1) <= eps * eps
    return near


def _met(a, b, eps: float, metric: str):
    """``_within`` of a few rows at a time: where they begin in ``a`` and in ``b``, and which are within reach."""
    for first in range(0, len(b), ROWS_WIDE):
        for start in range(0, len(a), ROWS_HIGH):
            yield start, first, _within(a[start : start + ROWS_HIGH], b[first : first + ROWS_WIDE], eps, metric)


def _weights(a, b, weight_a, weight_b, eps: float, metric: str):
    """What the rows of ``b`` within reach of each row of ``a`` weigh, and the other way round."""
    import numpy as np

    of_a, of_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    for start, first, near in _met(a, b, eps, metric):
        if 8 * np.count_nonzero(near) > near.size:
            near = near.astype(np.float64)
            of_a[start : start + near.shape[0]] += (near @ weight_b[first : first + near.shape[1]].astype(np.float64)).astype(np.int64)
            of_b[first : first + near.shape[1]] += (weight_a[start : start + near.shape[0]].astype(np.float64) @ near).astype(np.int64)
            continue
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        of_a[start : start + near.shape[0]] += np.bincount(i, weight_b[first + j], near.shape[0]).astype(np.int64)
        of_b[first : first + near.shape[1]] += np.bincount(j, weight_a[start + i], near.shape[1]).astype(np.int64)
    return of_a, of_b


def _smallest(n: int, i, j):
    """For each of ``n`` places the smallest one it is linked to, by links ``i, j``."""
    import numpy as np

    root = np.arange(n)
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up


def _settled(placed: DataFrame, n: int, width: int, eps: float, min_samples: int, metric: str) -> DataFrame | None:
    """``id`` of core points that are known to be one cluster, if these are half of all or more.

    Every point meets some points that a hash draws. Who has ``min_samples`` of
    them within reach is core, and cores that share a core probe hang together.
    """
    import numpy as np

    spark = placed.sparkSession
    probes = min(PROBES, PROBE_CELLS // width)
    if n < 2 * probes:
        return None
    drawn = placed.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * (probes / n)).select("x", "w").toPandas()
    if not len(drawn):
        return None
    s, weight = np.stack(drawn["x"]), drawn["w"].to_numpy()
    sure = _weights(s, s, weight, weight, eps, metric)[0] >= min_samples
    s, all_s, rooted = s[sure], s, np.arange(int(sure.sum()))
    if not len(s):
        return None
    for start in range(0, len(s), ROWS_HIGH):
        i, j = np.nonzero(_within(s[start : start + ROWS_HIGH], s, eps, metric))
        rooted = _smallest(len(s), np.concatenate([np.arange(len(s)), start + i]), np.concatenate([rooted, j]))
    shared = spark.sparkContext.broadcast((all_s, weight, sure, rooted))

    def probe(batches):
        import pandas as pd

        all_s, weight, sure, rooted = shared.value
        for batch in batches:
            if not len(batch):
                continue
            a, links = np.stack(batch["x"].to_numpy()), []
            root = np.full(len(a), -1)
            for start in range(0, len(a), ROWS_HIGH):
                near = _within(a[start : start + ROWS_HIGH], all_s, eps, metric)
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                core = np.bincount(i, weight[j], near.shape[0]) >= min_samples
                kept = core[i] & sure[j]
                i, j = i[kept], rooted[(np.cumsum(sure) - 1)[j[kept]]]
                if len(i):
                    same = i[1:] == i[:-1]
                    links.append(np.unique(np.stack([j[:-1][same], j[1:][same]], axis=1), axis=0))
                    root[start + i] = j
            links = np.concatenate(links) if links else np.zeros((0, 2), dtype=int)
            first = _smallest(len(rooted), links[:, 0], links[:, 1])
            moved = np.flatnonzero(first != np.arange(len(first)))
            known = np.flatnonzero(root >= 0)
            ids = np.concatenate([batch["id"].to_numpy()[known], np.full(len(moved), None, dtype=object)])
            yield pd.DataFrame({"id": ids, "a": np.concatenate([first[root[known]], first[moved]]), "b": np.concatenate([np.full(len(known), -1), moved])})

    spread = placed.select("id", "x").repartition(4 * spark.sparkContext.defaultParallelism, "id")
    probed = cut_lineage(spread.mapInPandas(probe, "id string, a long, b long"))
    shared.destroy()
    links = probed.filter("id is null").select("a", "b").distinct().toPandas()
    first = _smallest(len(rooted), links["a"].to_numpy(), links["b"].to_numpy())
    counts = probed.filter("id is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()
    total = np.zeros(len(rooted), dtype=np.int64)
    for r in counts:
        total[first[r["a"]]] += r["n"]
    if 2 * total.max() < n:
        return None
    largest = spark.createDataFrame([(int(r["a"]),) for r in counts if first[r["a"]] == total.argmax()], "a long")
    return probed.filter("id is not null").join(F.broadcast(largest), "a", "left_semi").select("id")


def _near_settled(placed: DataFrame, reach: float, eps: float, metric: str) -> DataFrame:
    """``id, near``: what the settled points within reach of each open one weigh, where there are any."""
    # Open points are dealt to strips along the first coordinate, settled ones visit the strips around theirs.
    strip = F.floor(F.col("at")[0] / F.lit(reach))
    parts = placed.select("id", "x", "w", "open", F.explode(F.when(F.col("open"), F.array(strip)).otherwise(F.array(strip - 1, strip, strip + 1))).alias("strip"))
    rows = parts.groupBy("strip").agg(F.count_if("open").alias("o"), F.count_if(~F.col("open")).alias("s")).filter("o > 0 and s > 0")
    blocks = rows.select("strip", F.ceil(F.col("o") / OPEN_ROWS).alias("o"), F.ceil(F.col("s") / SETTLED_ROWS).alias("s"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("open"), F.col("o")).otherwise(F.col("s")))
    zero = F.lit(0).cast("bigint")
    other = F.explode(F.sequence(zero, F.when(F.col("open"), F.col("s")).otherwise(F.col("o")) - 1))
    dealt = parts.join(blocks, "strip").select("id", "x", "w", "open", "strip", own.alias("own"), other.alias("other")).select(
        "id", "x", "w", "open", "strip", F.when(F.col("open"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("open"), F.col("other")).otherwise(F.col("own")).alias("j"),
    )

    def weigh(part):
        import numpy as np
        import pandas as pd

        here, there = part[part["open"]], part[~part["open"]]
        if not len(here) or not len(there):
            return pd.DataFrame({"id": here["id"][:0], "near": np.zeros(0, dtype=np.int64)})
        near, _ = _weights(np.stack(here["x"].to_numpy()), np.stack(there["x"].to_numpy()), here["w"].to_numpy(), there["w"].to_numpy(), eps, metric)
        return pd.DataFrame({"id": here["id"], "near": near})[near > 0]

    # Blocks are few bytes but much work, which the planner cannot know.
    tasks = 16 * placed.sparkSession.sparkContext.defaultParallelism
    met = dealt.repartition(tasks, "strip", "i", "j").groupBy("strip", "i", "j").applyInPandas(weigh, "id string, near bigint")
    return met.groupBy("id").agg(F.sum("near").alias("near"))


def _on_projections(points: DataFrame, width: int, eps: float, min_samples: int, metric: str, per_tile: int) -> DataFrame:
    """Any width and metric: a grid on few coordinates tells which rows may be near, and tiles of them are compared in full.

    Points that some probes tell to be core and of one cluster are settled. Open
    points meet them in blocks and one another in tiles. A tile returns counts for
    its rows, then a spanning forest of its core points and the core points near
    each other point, which are fewer than ``min_samples``; never all pairs.
    """
    reach = (math.sqrt(2 * eps) if metric == "cosine" else eps) * (1 + 1e-9) + 1e-12
    placed = cut_lineage(_placed(points, width, metric))
    settled = _settled(placed, placed.count(), width, eps, min_samples, metric)
    everything = crossed = None
    if settled is not None:
        everything = cut_lineage(placed.join(settled.withColumn("_s", F.lit(True)), "id", "left").withColumn("open", F.col("_s").isNull()).drop("_s"))
        crossed = cut_lineage(_near_settled(everything, reach, eps, metric))
        placed = everything.filter("open")
    tiles = cut_lineage(_tiles(placed.select("id", "at"), width, reach, per_tile))
    slim = placed.select("id", "x", "w")

    def sides(part):
        import numpy as np

        home, guests = part[part["home"]], part[~part["home"]]
        a = np.stack(home["x"].to_numpy())
        return home, guests, a, (np.stack(guests["x"].to_numpy()) if len(guests) else a[:0])

    def count(part):
        import numpy as np
        import pandas as pd

        home, guests, a, b = sides(part)
        near, back = _weights(a, b, home["w"].to_numpy(), guests["w"].to_numpy(), eps, metric)
        if home["own"].iloc[0]:
            near += _weights(a, a, home["w"].to_numpy(), home["w"].to_numpy(), eps, metric)[0]
        return pd.DataFrame({"id": np.concatenate([home["id"], guests["id"]]), "near": np.concatenate([near, back])})

    met = tiles.join(slim, "id")
    near = met.groupBy("tile").applyInPandas(count, "id string, near bigint")
    near = (near if crossed is None else near.unionByName(crossed)).groupBy("id").agg(F.sum("near").alias("near"))
    core = cut_lineage(near.select("id", (F.col("near") >= min_samples).alias("core")))

    def link(part):
        import numpy as np
        import pandas as pd

        home, guests, a, b = sides(part)
        ids = np.concatenate([home["id"], guests["id"]])
        cores = np.concatenate([home["core"], guests["core"]]).astype(bool)
        found = []
        if home["own"].iloc[0]:
            i, j = np.nonzero(np.triu(_within(a, a, eps, metric), 1))
            found.append((i, j))
        if len(guests):
            i, j = np.nonzero(_within(a, b, eps, metric))
            found.append((i, j + len(home)))
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        both = cores[i] & cores[j]
        first = _smallest(len(ids), i[both], j[both])
        ends = np.flatnonzero(first != np.arange(len(ids)))
        one = cores[i] != cores[j]
        loose, near_core = np.where(cores[i[one]], j[one], i[one]), np.where(cores[i[one]], i[one], j[one])
        return pd.DataFrame({
            "a": np.concatenate([ids[first[ends]], ids[loose]]), "b": np.concatenate([ids[ends], ids[near_core]]),
            "core": np.concatenate([np.ones(len(ends), dtype=bool), np.zeros(len(loose), dtype=bool)]),
        })

    told = met.join(core, "id").groupBy("tile").applyInPandas(link, "a string, b string, core boolean")
    if crossed is not None:
        # All settled points are core points of one cluster: the first of them stands for it.
        stands = F.lit(everything.filter("not open").agg(F.min("id")).first()[0])
        told = told.unionByName(crossed.join(core, "id").select(F.when(F.col("core"), stands).otherwise(F.col("id")).alias("a"), F.when(F.col("core"), F.col("id")).otherwise(stands).alias("b"), "core"))
        core = core.unionByName(everything.filter("not open").select("id", F.lit(True).alias("core")))
    edges = cut_lineage(told.distinct())
    state = points.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    nodes = state.filter("core").select(F.col("id").alias("node"))
    named = connected_components(nodes, edges.filter("core").select("a", "b"))
    if crossed is not None:
        # Settled points come without links of their own.
        its = named.filter(F.col("node") == stands).select("component")
        alike = everything.filter("not open").select(F.col("id").alias("node")).crossJoin(F.broadcast(its))
        named = cut_lineage(named.join(alike.select("node"), "node", "left_anti").unionByName(alike))
    components = named.select(F.col("node").alias("_n"), "component")
    reach_of = (
        edges.filter("not core").join(components, F.col("b") == F.col("_n")).groupBy(F.col("a").alias("_l")).agg(F.collect_set("component").alias("reach"))
    )
    nothing = F.array().cast("array<string>")
    return (
        state.join(components, F.col("id") == F.col("_n"), "left").join(reach_of, F.col("id") == F.col("_l"), "left")
        .select("x", "first", "core", "component", F.coalesce("reach", nothing).alias("reach"))
    )
