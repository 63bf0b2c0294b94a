"""What a feature preparation learns, as states that merge: one scan serves every training side of a cross-validation.

A state holds the row count, per numeric column its count, mean, squared
deviations and ends, and per text column how often each level occurs. States of
disjoint groups of rows merge, so the side that leaves a fold out is the merged
states of the other folds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.scalars import missing_to_null
from gridsmith.operators.codes import CODES_IN_PLAN
from gridsmith.operators.stages import DEFAULTS, DropWork, FeatureCopies, vector_stages

# Numeric columns aggregated by one query; more of them take further scans.
COLUMNS_PER_SCAN = 100
# What a constant fill is.
NUMBER_FILL, TEXT_FILL = 0.0, "missing"


@dataclass(frozen=True)
class Numbers:
    """Count, mean, sum of squared deviations and ends of the present values of a column."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float | None = None
    high: float | None = None

    def __add__(self, other: Numbers) -> Numbers:
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Numbers(
            n, self.mean + gap * other.n / n, self.m2 + other.m2 + gap * gap * self.n * other.n / n, min(self.low, other.low), max(self.high, other.high)
        )

    def filled(self, value: float, rows: int) -> Numbers:
        """The state after the missing of ``rows`` rows became ``value``."""
        return self + Numbers(rows - self.n, value, 0.0, value, value) if rows > self.n else self


@dataclass
class Prepared:
    """The state of some rows: how many there are, and each column's part."""

    rows: int = 0
    numbers: dict[str, Numbers] = field(default_factory=dict)
    levels: dict[str, Counter] = field(default_factory=dict)

    def __add__(self, other: Prepared) -> Prepared:
        return Prepared(
            self.rows + other.rows,
            {c: self.numbers.get(c, Numbers()) + other.numbers.get(c, Numbers()) for c in self.numbers | other.numbers},
            {c: self.levels.get(c, Counter()) + other.levels.get(c, Counter()) for c in self.levels | other.levels},
        )


def mergeable(config: dict) -> bool:
    """Whether all that the preparation learns can be read off merged states: no quantiles, neighbours, components or dropped columns."""
    config = {**DEFAULTS, **config}
    return (
        config["numeric_imputation"] in ("mean", "constant") and (not config["scale_features"] or config["scaling_method"] in (None, "standard", "minmax"))
        and not config["pca_components"] and not config["clean_columns"]
    )


def gather(df: DataFrame, roles: dict, config: dict | None, group: Column) -> dict[object, Prepared] | None:
    """The state of every group of rows, or None where a preparation must be fitted to the rows of each side.

    That is a configuration that is not ``mergeable``, or a text column of more
    than ``CODES_IN_PLAN`` levels, whose codes are a table and no part of a plan.
    The groups are few: folds, or folds times training sizes.
    """
    if not mergeable(config or {}):
        return None
    copies = FeatureCopies(roles=roles)
    places = copies.copies()
    numeric, texts = [w for w, r, _, _ in places if r == "numeric"], [w for w, r, _, _ in places if r != "numeric"]
    work = missing_to_null(copies.transform(df).select(group.alias("_group"), *numeric, *texts))
    out: dict[object, Prepared] = {}
    for start in range(0, max(len(numeric), 1), COLUMNS_PER_SCAN):
        some = numeric[start : start + COLUMNS_PER_SCAN]
        parts = [f(c) for c in some for f in (F.count, F.avg, F.var_pop, F.min, F.max)]
        for row in work.groupBy("_group").agg(F.count(F.lit(1)), *parts).collect():
            state = out.setdefault(row[0], Prepared(row[1], {}, {c: Counter() for c in texts}))
            for i, c in enumerate(some):
                n, mean, variance, low, high = row[2 + 5 * i : 7 + 5 * i]
                state.numbers[c] = Numbers(n, mean, variance * n, low, high) if n else Numbers()
    if texts and out:
        counts = work.unpivot(["_group"], texts, "column", "value").filter(F.col("value").isNotNull()).groupBy("_group", "column", "value").agg(F.count(F.lit(1)).alias("n"))
        bound = CODES_IN_PLAN * len(texts) * len(out)
        rows = counts.limit(bound + 1).collect()  # no more than the levels that may stand in a plan
        if len(rows) > bound:
            return None
        for row in rows:
            out[row["_group"]].levels[row["column"]][row["value"]] = row["n"]
        if any(len(set().union(*(s.levels[c] for s in out.values()))) > CODES_IN_PLAN for c in texts):
            return None
    return out


def fit_from(spark: SparkSession, states: list[Prepared], roles: dict, config: dict | None = None, out: str = "features") -> PipelineModel:
    """The preparation that fitting to the rows of ``states`` gives, without reading them."""
    config = {**DEFAULTS, **(config or {})}
    if not mergeable(config):
        raise ValueError("this preparation needs the rows themselves")
    state = sum(states, Prepared())
    copies = FeatureCopies(roles=roles)
    of_role = lambda role: [w for w, r, _, _ in copies.copies() if r == role]
    numeric, categories, texts = of_role("numeric"), of_role("categorical"), of_role("text_or_high_cardinality")
    if not numeric + categories + texts:
        raise ValueError("no feature columns to prepare")
    fills: dict = {}
    for c in numeric:
        found = state.numbers.get(c, Numbers())
        if config["numeric_imputation"] == "constant":
            fills[c] = NUMBER_FILL
        elif found.n:
            fills[c] = found.mean
    levels = {}
    for c in categories + texts:
        seen = Counter(state.levels.get(c, {}))
        if config["categorical_imputation"] == "constant":
            fills[c] = TEXT_FILL
        elif seen:
            fills[c] = min(seen, key=lambda v: (-seen[v], v))
        if c in fills and sum(seen.values()) < state.rows:
            seen[fills[c]] += state.rows - sum(seen.values())
        levels[c] = sorted(seen)
    numeric = [c for c in numeric if c in fills]
    scaling = None
    if numeric and config["scale_features"] and config["scaling_method"]:
        scaling = {}
        for c in numeric:
            full = state.numbers.get(c, Numbers()).filled(fills[c], state.rows)
            if config["scaling_method"] == "standard":
                centre, width = full.mean, math.sqrt(full.m2 / full.n)
            else:
                centre, width = full.low, full.high - full.low
            scaling[c] = [centre, width or 1.0]
    stages, _ = vector_stages(spark, copies, fills, numeric, scaling, categories, texts, levels, {}, config, out)
    return PipelineModel([copies, *stages, DropWork()])
