"""Exact nearest neighbours, and what is built on them: k-NN models, imputation, oversampling.

Two routes give the same answer. A small candidate set (its size is counted
first) is broadcast and each task searches it. A large one is cut into tiles
around sampled pivots: bounds on the distance to a tile decide which tiles a
row must visit, and each visit is a task that holds one tile of candidates and
one block of rows. A crowded pivot is cut into rings by distance, and a ring of
equal distances by hash, so no task holds an unbounded group. Rows without gaps
know a bound on their distances from a sample of the candidates, visit only tiles
that may lie within it, and in a tile meet only the boxes that may.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column, nan_to_null
from gridsmith.operators.columns import is_numeric
from gridsmith.operators.sampling import hash_order
from gridsmith.operators.tiles import as_array
from gridsmith.session import cut_lineage

# Candidates up to this many numbers (rows times width) are broadcast; every row meets all of them.
BROADCAST_CELLS = 80_000
# A row meets the rows of the tiles it visits and the bounds of all tiles.
TILE_ROWS = 2_000
# Candidates without gaps are searched box by box, so their tiles may be larger, as long as there are tiles for all cores.
FULL_TILE_ROWS = 16_000
# Rows of a box, and numbers of the candidates from which bounds are told.
BOX_ROWS = 128
SAMPLE_CELLS = 160_000
BLOCK_ROWS = 20_000
MAX_PIVOTS = 512
MAX_TILES = 200_000
# Patterns of missing coordinates with an index of their own; rows of rarer ones are filed under the widest that they cover.
MAX_PATTERNS = 64

NEIGHBOR_SCHEMA = "qid {q}, feature int, tid {t}, distance double, payload array<double>"


def _search(q, t, k: int):
    """k nearest candidates of each row, as arrays; ties go to the smaller id.

    ``q`` and ``t`` are pandas frames with ``id, x`` and, for candidates,
    ``payload``. Rows may have NaN coordinates: distances then use the shared
    coordinates, scaled up to the full width, once per missing coordinate and
    only among candidates that have it. Complete rows search once, feature -1.
    """
    import numpy as np
    import pandas as pd

    columns = ["qid", "feature", "tid", "distance", "payload"]
    if not len(q) or not len(t):
        return pd.DataFrame({c: [] for c in columns})
    t = t.sort_values("id", kind="stable")
    y = np.stack(t["x"])
    tids, payload = t["id"].to_numpy(), t["payload"].to_numpy()
    y_known = ~np.isnan(y)
    y_full = bool(y_known.all())
    y0 = np.where(y_known, y, 0.0)
    width = y.shape[1]
    parts = []
    if y_full:
        x, qids = np.stack(q["x"]), q["id"].to_numpy()
        easy = np.isfinite(x).all(axis=1) if np.isfinite(y).all() else np.zeros(len(x), dtype=bool)
        for r, c, distance in _search_boxes(x[easy], y, k):
            parts.append((qids[easy][r], np.full(len(r), -1), tids[c], distance, payload[c]))
        q = q[~easy]
    step = max(1, 4_000_000 // len(y))
    for start in range(0, len(q), step):
        part = q.iloc[start : start + step]
        x, qids = np.stack(part["x"]), part["id"].to_numpy()
        known = ~np.isnan(x)
        x0 = np.where(known, x, 0.0)
        gap = np.zeros((len(x), len(y)))
        for i in range(width):
            term = (x0[:, i : i + 1] - y0[None, :, i]) ** 2
            if not y_full or not known[:, i].all():
                term = term * (known[:, i : i + 1] & y_known[None, :, i])
            gap += term
        shared = known.astype(float) @ y_known.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(shared > 0, np.sqrt(gap * width / shared), np.inf)
        whole = known.all(axis=1)
        asked = [(-1, np.flatnonzero(whole))] + [(i, np.flatnonzero(~known[:, i])) for i in range(width)]
        for feature, rows in asked:
            if len(rows):
                r, c = _smallest(distance[rows] if feature < 0 else np.where(y_known[:, feature], distance[rows], np.inf), k)
                parts.append((qids[rows[r]], np.full(len(r), feature), tids[c], distance[rows[r], c], payload[c]))
    if not parts:
        return pd.DataFrame({c: [] for c in columns})
    return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(columns)})


def _boxes(x, size: int) -> list:
    """Numbers of the rows ``x`` in groups of at most ``size`` that lie together: halves along the widest coordinate."""
    import numpy as np

    left, out = [np.arange(len(x))], []
    while left:
        rows = left.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        half = len(rows) // 2
        order = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], half)
        left += [rows[order[half:]], rows[order[:half]]]
    return out


def _search_boxes(x, y, k: int):
    """Row of ``x``, row of ``y`` and distance of the ``k`` nearest in ``y``, some rows of ``x`` after the other; neither has gaps.

    The box nearest to a row gives a bound on its k-th distance, which tells the
    boxes that can hold one of the k nearest.
    """
    import numpy as np

    width = y.shape[1]

    def distances(one, other):
        gap = np.zeros((len(one), len(other)))
        for i in range(width):
            gap += (one[:, i : i + 1] - other[None, :, i]) ** 2
        return np.sqrt(gap * width / float(width))

    boxes = _boxes(y, max(BOX_ROWS, 2 * k))
    low, high = np.stack([y[b].min(axis=0) for b in boxes]), np.stack([y[b].max(axis=0) for b in boxes])
    step = max(1, 1_000_000 // len(boxes))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        away = np.zeros((len(part), len(boxes)))
        for i in range(width):
            apart = np.maximum(low[None, :, i] - part[:, i : i + 1], part[:, i : i + 1] - high[None, :, i])
            np.maximum(apart, 0.0, out=apart)
            away += apart * apart
        np.sqrt(away, out=away)
        own = away.argmin(axis=1)
        reach = np.full(len(part), np.inf)
        for box in np.unique(own):
            if len(boxes[box]) >= k:
                rows = np.flatnonzero(own == box)
                reach[rows] = np.partition(distances(part[rows], y[boxes[box]]), k - 1, axis=1)[:, k - 1]
        reach = reach * (1 + 1e-9) + 1e-12
        met = np.ascontiguousarray((away <= reach[:, None]).T)
        found = []
        for box, columns in enumerate(boxes):
            rows = np.flatnonzero(met[box])
            if len(rows):
                near = distances(part[rows], y[columns])
                i, j = np.nonzero((near <= reach[rows][:, None]) & np.isfinite(near))
                found.append((rows[i], columns[j], near[i, j]))
        if found:
            r, c, distance = (np.concatenate(f) for f in zip(*found, strict=True))
            # In the order of ``y``, by which ties are settled.
            order = np.lexsort((c, distance, r))
            r, c, distance = r[order], c[order], distance[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            yield r[kept] + start, c[kept], distance[kept]


def _smallest(distance, k: int):
    """Row and column of the ``k`` smallest finite values of every row, in order; of equal values the first columns."""
    import numpy as np

    take = min(k, distance.shape[1])
    edge = np.partition(distance, take - 1, axis=1)[:, take - 1 : take]
    r, c = np.nonzero((distance <= edge) & np.isfinite(distance))
    order = np.lexsort((c, distance[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r, side="left")  # where the row's values begin
    kept = np.arange(len(r)) - first < take
    return r[kept], c[kept]


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    exclude_self: bool = False,
    broadcast_cells: int = BROADCAST_CELLS,
    tile_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """``qid, feature, tid, distance, payload, rank`` of the k nearest candidates.

    ``queries`` has ``id, x``; ``candidates`` has ``id, x, payload``, with ``x``
    and ``payload`` arrays of doubles. Exact on both routes. Copies are folded
    first: equal rows search once, and of equal candidates only the few with
    the smallest ids can ever be among the k, ties going by id.
    """
    need = k + (1 if exclude_self else 0)
    q_type = queries.schema["id"].dataType.simpleString()
    t_type = candidates.schema["id"].dataType.simpleString()
    schema = NEIGHBOR_SCHEMA.format(q="string", t=t_type)
    # The row limit per group is applied before the shuffle as well as after it.
    copies = Window.partitionBy("x").orderBy("id")
    folded = (
        candidates.select("id", "x", "payload")
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= need)
        .drop("_copy")
    )
    keyed = queries.select("id", "x", F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256).alias("_d"))
    once = keyed.select(F.col("_d").alias("id"), "x").dropDuplicates(["id"])
    size = folded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w"), F.max(F.size("payload")).alias("p")).first()
    if not size["n"]:
        empty = NEIGHBOR_SCHEMA.format(q=q_type, t=t_type)
        return queries.sparkSession.createDataFrame([], empty + ", rank int")
    if size["n"] * (size["w"] + size["p"] + 1) <= broadcast_cells:
        found = _nearest_broadcast(once, folded, need, schema)
    else:
        found = _nearest_tiled(once, folded, need, schema, size["n"], tile_rows, pivots)
        order = Window.partitionBy("qid", "feature").orderBy("distance", "tid")
        found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= need).drop("_r")
    # At most k + 1 entries per list.
    lists = found.groupBy(F.col("qid").alias("_d"), "feature").agg(
        F.array_sort(F.collect_list(F.struct("distance", "tid", "payload"))).alias("near")
    )
    joined = keyed.select("id", "_d").join(lists, "_d")
    near = F.filter("near", lambda e: e["tid"] != F.col("id")) if exclude_self else F.col("near")
    return joined.select(
        F.col("id").alias("qid"), "feature", F.posexplode(F.slice(near, 1, k)).alias("rank", "e")
    ).select("qid", "feature", "e.tid", "e.distance", "e.payload", (F.col("rank") + 1).alias("rank"))


def _nearest_broadcast(queries, candidates, k, schema):
    shared = queries.sparkSession.sparkContext.broadcast(candidates.toPandas())

    def search(batches):
        for batch in batches:
            yield _search(batch, shared.value, k)

    # Written, so that nothing needs the broadcast again once it is destroyed.
    found = cut_lineage(_spread(queries).mapInPandas(search, schema))
    shared.destroy()
    return found


def _spread(queries: DataFrame) -> DataFrame:
    """Rows dealt to all cores: they are few bytes but much work, which the planner cannot know."""
    return queries.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism, "id")


def _known(x) -> F.Column:
    """Which coordinates a row has, as a text of ones and zeros."""
    return F.array_join(F.transform(x, lambda v: F.when(F.isnan(v) | v.isNull(), "0").otherwise("1")), "")


class _Tiles:
    """Where candidates lie: tiles of an index pattern, pivot and ring, and how far they can be from a row.

    Rows of a tile are indexed by the coordinates of its pattern, which all of
    them have. ``exact`` tiles hold rows with those coordinates and no others, so
    their distances to a row are known up to the triangle's bounds; rows of
    other tiles may have more, so only the lower bound holds.
    """

    def __init__(self, centre, patterns, tiles):
        import numpy as np

        self.centre = centre
        self.patterns = np.array([[v == "1" for v in p] for p in patterns], dtype=bool).reshape(len(patterns), centre.shape[1])
        of = lambda i, kind: np.array([t[i] for t in tiles], dtype=kind)
        self.pattern, self.exact, self.pivot = of(0, int), of(1, bool), of(2, int)
        self.rows, self.low, self.high = of(3, float), of(4, float), of(5, float)

    def visits(self, x, k: int, reach=None):
        """Pairs (row, tile) of which the tile may hold one of the row's ``k`` nearest, for rows ``x`` with the same gaps.

        ``reach`` is a bound on the k-th distance of every row, where one is known.
        """
        import numpy as np

        known = ~np.isnan(x[0])
        width = len(known)
        low, high = np.zeros((len(x), len(self.pattern))), np.full((len(x), len(self.pattern)), np.inf)
        for number, has in enumerate(self.patterns):
            mine = np.flatnonzero(self.pattern == number)
            both = has & known
            if not len(mine):
                continue
            every = np.sqrt(((x[:, None, both] - self.centre[None, :, both]) ** 2).sum(axis=2))
            at = every[:, self.pivot[mine]]
            near = np.maximum(at - self.high[mine], 0.0)
            if both.sum() == has.sum():
                # Rows of a tile are no nearer to the row's own pivot than to theirs: they lie behind the plane between.
                spots = self.centre[:, has]
                own = every.argmin(axis=1)
                between = np.stack([np.sqrt(((spots - c) ** 2).sum(axis=1)) for c in spots])[own][:, self.pivot[mine]]
                mine_own, theirs = every[np.arange(len(x)), own][:, None] ** 2, at**2
                # Squares round, where pivots are close beside their distance from the rows.
                round_off = 1e-14 * width * (theirs + mine_own + self.high[mine] ** 2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    behind = (theirs - mine_own - round_off) / (2 * between)
                near = np.fmax(near, np.where(between > 0, behind, 0.0))
                # The inner side of a ring bounds too, but only where the row has all its coordinates.
                near = np.maximum(near, self.low[mine] - at)
            exact = self.exact[mine]
            # Few shared coordinates are scaled up to the full width; others have no more of them than the row.
            scale = np.where(exact, np.sqrt(width / max(both.sum(), 1)), np.sqrt(width / max(known.sum(), 1)))
            low[:, mine] = near * scale
            if both.any():
                high[:, mine] = np.where(exact, (at + self.high[mine]) * scale, np.inf)
            else:
                low[:, mine[exact]] = np.inf  # nothing shared, no distance
        wanted = np.zeros(low.shape, dtype=bool)
        for feature in np.flatnonzero(~known) if not known.all() else [-1]:
            has = np.ones(len(self.pattern), dtype=bool) if feature < 0 else self.patterns[self.pattern, feature]
            if reach is not None:
                wanted |= (low <= reach[:, None] * (1 + 1e-9) + 1e-12) & (has | ~self.exact)
                continue
            side = np.where(has, high, np.inf)
            order = np.argsort(side, axis=1)
            total = np.cumsum(np.take_along_axis(np.where(np.isfinite(side), self.rows, 0.0), order, axis=1), axis=1)
            enough = (total < k).sum(axis=1)
            bound = np.where(enough < side.shape[1], np.take_along_axis(side, np.take_along_axis(order, np.minimum(enough, side.shape[1] - 1)[:, None], axis=1), axis=1)[:, 0], np.inf)
            fits = low <= bound[:, None] * (1 + 1e-9) + 1e-12
            wanted |= fits & np.isfinite(low) & (has | ~self.exact)
        return np.nonzero(wanted)


def _nearest_tiled(queries, candidates, k, schema, n, tile_rows, pivots):
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    # The most frequent patterns of known coordinates have an index of their own.
    told = candidates.groupBy(_known("x").alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(MAX_PATTERNS).collect()
    patterns = [r["p"] for r in told]
    masks = np.array([[v == "1" for v in p] for p in patterns], dtype=bool)
    width = masks.shape[1]
    full = len(patterns) == 1 and bool(masks.all())
    if tile_rows is None:
        tile_rows = max(TILE_ROWS, min(FULL_TILE_ROWS, n // (4 * spark.sparkContext.defaultParallelism))) if full else TILE_ROWS
        if full:
            pivots = pivots or min(MAX_PIVOTS, max(2, math.ceil(2 * n / tile_rows)))
    tile_rows = max(tile_rows, math.ceil(n / MAX_TILES))
    pivots = pivots or min(MAX_PIVOTS, max(2, int(math.sqrt(n / tile_rows)) * 4))
    picked = np.stack(candidates.select("id", "x").orderBy(hash_order(["id"])).limit(pivots).toPandas()["x"])
    # Gaps of a pivot are filled: any place will do.
    known = ~np.isnan(picked)
    mean = np.where(known, picked, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    centre = np.where(known, picked, mean)
    none = np.zeros(width, dtype=bool)

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"])
            known = ~np.isnan(x)
            index, exact = np.full(len(x), len(patterns)), np.zeros(len(x), dtype=bool)
            cell, gap = np.zeros(len(x), dtype=int), np.zeros(len(x))
            distinct, which = np.unique(known, axis=0, return_inverse=True)
            for number, has in enumerate(distinct):
                rows = np.flatnonzero(which.reshape(-1) == number)
                # Its own index, else the widest whose coordinates the row has, else the one without coordinates.
                fits = np.flatnonzero(~(masks & ~has).any(axis=1))
                best = fits[np.argmax(masks[fits].sum(axis=1))] if len(fits) else len(patterns)
                used = masks[best] if len(fits) else none
                index[rows], exact[rows] = best, bool((used == has).all())
                d = np.sqrt(((x[rows][:, None, used] - centre[None, :, used]) ** 2).sum(axis=2))
                cell[rows], gap[rows] = d.argmin(axis=1), d.min(axis=1)
            yield batch.assign(index=index, exact=exact, cell=cell, gap=gap)

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.select("id", "x", "payload").schema)
    placed = cut_lineage(candidates.select("id", "x", "payload").mapInPandas(place, base + ", index int, exact boolean, cell int, gap double"))
    spot = ["index", "exact", "cell"]
    # At most one row per pattern and pivot comes back, twice where a pattern also holds rows of rarer ones.
    cells = placed.groupBy(*spot).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("gap", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000)).alias("marks"),
    ).collect()
    rings = []
    for r in cells:
        wanted = min(64, math.ceil(r["n"] / tile_rows))
        rings.append((*(r[c] for c in spot), sorted({r["marks"][round(64 * i / wanted) - 1] for i in range(1, wanted)})))
    # Patterns times pivots times at most 64 ring ends.
    ends = spark.createDataFrame(rings, "index int, exact boolean, cell int, ends array<double>")
    ringed = placed.join(F.broadcast(ends), spot).withColumn("ring", F.size(F.filter("ends", lambda e: e < F.col("gap"))))
    sizes = ringed.groupBy(*spot, "ring").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    tiles, first = [], []
    for r in sizes.orderBy(*spot, "ring").collect():
        salts = math.ceil(r["n"] / (2 * tile_rows))
        first.append((*(r[c] for c in spot), r["ring"], salts, len(tiles)))
        tiles += [(r["index"], r["exact"], r["cell"], r["n"] / salts, r["low"], r["high"])] * salts
    index = spark.createDataFrame(first, "index int, exact boolean, cell int, ring int, salts int, first int")
    tiled = ringed.join(F.broadcast(index), [*spot, "ring"]).select(
        "id", "x", "payload",
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("tile"),
    )
    where = _Tiles(centre, [*patterns, "0" * width], tiles)
    # The k-th distance to some of the candidates bounds that to all of them.
    some = np.zeros((0, width))
    if full:
        share = F.lit(1_000_000 * min(1.0, SAMPLE_CELLS / (width * n)))
        drawn = candidates.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share).select("x").toPandas()
        some = np.stack(drawn["x"]) if len(drawn) >= k else some
        some = some if np.isfinite(some).all() else some[:0]

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"])
            distinct, which = np.unique(~np.isnan(x), axis=0, return_inverse=True)
            step = max(1, 2_000_000 // max(len(tiles), len(centre) * width))
            for number in range(len(distinct)):
                same = np.flatnonzero(which.reshape(-1) == number)
                reach = None
                if len(some) and np.isfinite(x[same]).all():
                    reach = np.zeros(len(x))
                    for r, _, distance in _search_boxes(x[same], some, k):
                        np.maximum.at(reach, same[r], distance)
                for start in range(0, len(same), step):
                    rows = same[start : start + step]
                    r, tile = where.visits(x[rows], k, None if reach is None else reach[rows])
                    yield pd.DataFrame({
                        "id": batch["id"].to_numpy()[rows[r]], "x": batch["x"].to_numpy()[rows[r]], "tile": tile.astype("int32"),
                    })

    id_type = queries.schema["id"].dataType.simpleString()
    routed = cut_lineage(_spread(queries.select("id", "x")).mapInPandas(route, f"id {id_type}, x array<double>, tile int"))
    visits = routed.groupBy("tile").agg(F.count(F.lit(1)).alias("v")).select(
        "tile", F.ceil(F.col("v") / BLOCK_ROWS).cast("int").alias("blocks")
    )
    # One row per tile, at most MAX_TILES and the salted rest.
    counted = visits.collect()
    visits = F.broadcast(spark.createDataFrame(counted, "tile int, blocks int"))
    left = routed.join(visits, "tile").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = tiled.join(visits, "tile").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    groups = sum(r["blocks"] for r in counted)
    tasks = max(1, min(groups, max(8 * spark.sparkContext.defaultParallelism, groups // 64)))

    def search(q, t):
        return _search(q, t, k)

    return (
        left.select("id", "x", "tile", "block").repartition(tasks, "tile", "block").groupBy("tile", "block")
        .cogroup(right.select("id", "x", "payload", "tile", "block").repartition(tasks, "tile", "block").groupBy("tile", "block"))
        .applyInPandas(search, schema)
    )


# k-NN models --------------------------------------------------------------------


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    key: str,
    features,
    label: str,
    k: int = 5,
    weights: str = "uniform",
    task: str = "classification",
    **route,
) -> DataFrame:
    """``key, prediction`` by the vote or the mean of the k nearest training rows.

    Distance weights count an exact match alone, as its weight is unbounded.
    Ties between classes go to the smaller label.
    """
    candidates = train.select(
        as_column(key).alias("id"), as_array(train, features).alias("x"), F.array(as_column(label).cast("double")).alias("payload")
    )
    queries = test.select(as_column(key).alias("id"), as_array(test, features).alias("x"))
    near = nearest(queries, candidates, k, **route).withColumn("y", F.col("payload")[0])
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
        near = near.withColumn("_exact", exact).withColumn(
            "w", F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif(F.col("distance"), F.lit(0.0)))
        )
    else:
        near = near.withColumn("w", F.lit(1.0))
    if task == "regression":
        out = near.groupBy("qid").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
    else:
        votes = near.groupBy("qid", "y").agg(F.sum("w").alias("w"))
        out = votes.groupBy("qid").agg(F.min(F.struct((-F.col("w")).alias("w"), "y"))["y"].alias("prediction"))
    return out.withColumnRenamed("qid", key)


# k-NN imputation ----------------------------------------------------------------


def knn_fill_values(
    df: DataFrame, donors: DataFrame, keys: list[str], columns: list[str], k: int, means: dict[str, float], **route
) -> DataFrame:
    """Fill gaps with the mean of the k nearest donors that have the value.

    Rows without a gap do not enter the search. Columns keep their names; a gap
    no donor can fill takes the column mean.
    """
    used = [c for c in columns if c in means]

    def key(frame: DataFrame):
        return F.md5(F.concat_ws("|", *[as_column(c).cast("string") for c in keys]))

    def cells(frame: DataFrame):
        nan = F.lit(float("nan"))
        return F.array(*[F.coalesce(as_column(c).cast("double"), nan) for c in used])

    gaps = None
    for c in used:
        gap = nan_to_null(as_column(c).cast("double")).isNull()
        gaps = gap if gaps is None else gaps | gap
    queries = df.filter(gaps).select(key(df).alias("id"), cells(df).alias("x"))
    candidates = donors.select(key(donors).alias("id"), cells(donors).alias("x"), cells(donors).alias("payload"))
    near = nearest(queries, candidates, k, **route)
    fills = (
        near.withColumn("v", F.col("payload")[F.col("feature")])
        .groupBy("qid", "feature")
        .agg(F.avg("v").alias("v"))
        .groupBy("qid")
        .agg(*[F.max(F.when(F.col("feature") == i, F.col("v"))).alias(f"_f{i}") for i in range(len(used))])
    )
    joined = df.withColumn("_qid", F.when(gaps, key(df))).join(
        fills.withColumnRenamed("qid", "_key"), F.col("_qid") == F.col("_key"), "left"
    )
    filled = {
        c: F.coalesce(nan_to_null(as_column(c).cast("double")), F.col(f"_f{i}"), F.lit(float(means[c])))
        for i, c in enumerate(used)
    }
    return joined.withColumns(filled).select(*[as_column(c) for c in df.columns])


def knn_impute(df: DataFrame, keys: list[str], columns: list[str] | None = None, k: int = 5, **route) -> DataFrame:
    """k-NN imputation of the numeric columns, the table being its own donor set."""
    columns = columns if columns is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in keys]
    row = df.agg(*[F.avg(nan_to_null(as_column(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = {c: row[i] for i, c in enumerate(columns) if row[i] is not None}
    donors = df.select(*[as_column(c) for c in keys], *[nan_to_null(as_column(c).cast("double")).alias(c) for c in means])
    return knn_fill_values(df, donors, keys, columns, k, means, **route)


# Synthetic minority oversampling ------------------------------------------------


def smote_targets(counts: dict, strategy: str | dict | float = "auto") -> dict:
    """Rows to add per class: every class named by the strategy grows to the majority's size."""
    most = max(counts.values())
    least = min(counts.values())
    if isinstance(strategy, dict):
        return {c: max(0, strategy[c] - counts[c]) for c in strategy if c in counts}
    if isinstance(strategy, float):
        return {c: max(0, int(most * strategy) - n) for c, n in counts.items() if n == least}
    grown = {
        "minority": [c for c, n in counts.items() if n == least][:1],
        "not minority": [c for c, n in counts.items() if n != least],
        "not majority": [c for c, n in counts.items() if n != most],
        "auto": [c for c, n in counts.items() if n != most],
        "all": list(counts),
    }[strategy]
    return {c: most - counts[c] for c in sorted(grown, key=str) if most > counts[c]}


def smote(
    df: DataFrame,
    key: str,
    features,
    label: str,
    k: int = 5,
    strategy: str | dict | float = "auto",
    seed: int = 42,
    **route,
) -> DataFrame:
    """``key, x, label, synthetic``: the input rows plus interpolated rows of the small classes.

    Every row of a class makes an equal number of new rows, the first ones in
    hash order one more. A new row lies between its base and one of the base's
    k nearest rows of the same class; hashes pick the neighbour and the place.
    Meant for training rows only.
    """
    base = df.select(as_column(key).alias("id"), as_array(df, features).alias("x"), as_column(label).alias("y"))
    counts = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    real = base.select(F.col("id").cast("string"), "x", "y", F.lit(False).alias("synthetic"))
    out = real
    for c, extra in smote_targets(counts, strategy).items():
        if counts[c] < 2:
            raise ValueError(f"class {c} has a single row: nothing to interpolate with")
        members = base.filter(F.col("y") == F.lit(c))
        candidates = members.select("id", "x", F.col("x").alias("payload"))
        near = nearest(members.select("id", "x"), candidates, min(k, counts[c] - 1), exclude_self=True, **route)
        friends = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "payload"))).alias("friends"))
        whole, rest = divmod(extra, counts[c])
        if rest:
            # The first rows in hash order make one row more; found without sorting the class.
            from gridsmith.operators.sampling import hash_segments

            chosen = hash_segments(members, ["id"], [lambda n, rest=rest: F.lit(rest)], seed=seed)
            copies = F.lit(whole) + (F.col("segment") == 0).cast("int")
        else:
            chosen, copies = members.withColumn("segment", F.lit(1)), F.lit(whole)
        spread = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).filter(F.col("copy") < copies)
        joined = spread.join(friends, F.col("id") == F.col("qid"))
        pick = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("copy"), F.lit("neighbour")), F.size("friends")).cast("int")
        place = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("copy"), F.lit("place")), F.lit(1_000_000)) / 1e6
        joined = joined.withColumns({"_o": F.col("friends")[pick]["payload"], "_t": place})
        mixed = F.transform(F.arrays_zip("x", F.col("_o").alias("o")), lambda p: p["x"] + F.col("_t") * (p["o"] - p["x"]))
        new = joined.select(
            F.concat_ws("-", F.lit("new"), F.col("id").cast("string"), F.col("copy").cast("string")).alias("id"),
            mixed.alias("x"), "y", F.lit(True).alias("synthetic"),
        )
        out = out.unionByName(new)
    return out.withColumnsRenamed({"id": key, "y": label})
