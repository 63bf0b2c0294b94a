"""Gradient boosting for any number of classes: one regression tree per class and round on the softmax gradient.

The scores of all classes are one array column. A round takes a Newton step: each
class's tree is fitted to gradient / curvature with the curvature as row weight,
so its splits maximise the gain of the step and its leaves hold the Newton values
themselves. The trees of a round do not depend on each other and are submitted
together.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.session import cut_lineage

# Scores stay cached between rounds; their lineage is cut every few rounds.
ROUNDS_PER_CHECKPOINT = 10
# Curvatures below this would make a step out of rounding errors.
LEAST_CURVATURE = 1e-10


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first, so nothing overflows."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda e: e / total)


def log_loss(scores: Column, label: Column) -> Column:
    """Minus the logarithm of the label's softmax probability."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.log(total) + top - F.get(scores, label.cast("int"))


class SoftmaxBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with class probabilities; labels are 0..K-1.

    With ``patience`` above 0 a share ``validation`` of the rows is not learned
    from, and boosting stops once their loss has not improved by ``tolerance``
    for that many rounds; the rounds after the best are dropped.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")
    labelCol = Param(Params._dummy(), "labelCol", "label column")
    rounds = Param(Params._dummy(), "rounds", "largest number of rounds")
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each tree")
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree")
    minInstances = Param(Params._dummy(), "minInstances", "fewest rows of a leaf")
    subsample = Param(Params._dummy(), "subsample", "share of the rows each round learns from")
    patience = Param(Params._dummy(), "patience", "rounds without improvement before stopping, 0 for never")
    validation = Param(Params._dummy(), "validation", "share of the rows that decide on stopping")
    tolerance = Param(Params._dummy(), "tolerance", "smallest improvement of the loss")
    parallelism = Param(Params._dummy(), "parallelism", "trees fitted at once")
    seed = Param(Params._dummy(), "seed", "random seed")

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", rounds=100, learningRate=0.1, maxDepth=3, minInstances=1, subsample=1.0, patience=0,
        validation=0.1, tolerance=1e-4, parallelism=4, seed=42,
    ):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", rounds=100, learningRate=0.1, maxDepth=3, minInstances=1, subsample=1.0, patience=0,
            validation=0.1, tolerance=1e-4, parallelism=4, seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        of = {p.name: self.getOrDefault(p) for p in self.params}
        data = df.select(as_column(of["featuresCol"]).alias("features"), as_column(of["labelCol"]).cast("double").alias("label")).dropna(subset=["label"])
        if of["patience"]:
            # Which rows decide is drawn from their content, so a lost task draws the same.
            told = F.pmod(F.xxhash64("features", "label", F.lit(of["seed"])), F.lit(1 << 20)) < of["validation"] * (1 << 20)
        else:
            told = F.lit(False)
        data = data.withColumn("held", told).persist()
        counts = {int(r["label"]): r["n"] for r in data.filter("not held").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        classes, rows = max(counts, default=0) + 1, sum(counts.values())
        classes = max(classes, 2)
        # A class without rows starts as if it had half of one.
        start = [math.log(max(counts.get(k, 0), 0.5) / max(rows, 1)) for k in range(classes)]
        scored = data.withColumn("scores", F.array(*[F.lit(s) for s in start])).persist()
        trees, losses = [], []
        with ThreadPool(max(1, min(of["parallelism"], classes))) as pool:
            for number in range(of["rounds"]):
                grown = self._round(scored, classes, number, of, pool)
                trees.append(grown)
                after = self._moved(scored, grown, classes, of["learningRate"])
                after = (cut_lineage(after) if (number + 1) % ROUNDS_PER_CHECKPOINT == 0 else after).persist()
                loss = after.filter("held").agg(F.avg(log_loss(F.col("scores"), F.col("label")))).first()[0] if of["patience"] else after.count()
                scored.unpersist()
                scored = after
                losses.append(loss)
                if of["patience"] and _stalled(losses, of["patience"], of["tolerance"]):
                    break
        scored.unpersist()
        data.unpersist()
        if of["patience"] and losses and None not in losses:
            trees = trees[: losses.index(min(losses)) + 1]
        sides = [_ensemble(df, [r[k] for r in trees], of["learningRate"]) for k in range(classes)]
        return SoftmaxBoostingModel(sides, {"start": start, "rounds": len(trees)})._set(featuresCol=of["featuresCol"])

    def _round(self, scored: DataFrame, classes: int, number: int, of: dict, pool: ThreadPool) -> list:
        """One tree for each class, fitted at the same time to the same rows."""
        learn = scored.filter("not held").select("features", "label", softmax(F.col("scores")).alias("p"))
        if of["subsample"] < 1.0:
            learn = learn.sample(of["subsample"], of["seed"] + number)
        share = (classes - 1) / classes

        def grow(k):
            p = F.get("p", k)
            bend = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
            step = share * ((F.col("label") == k).cast("double") - p) / bend
            tree = DecisionTreeRegressor(
                maxDepth=of["maxDepth"], minInstancesPerNode=of["minInstances"], labelCol="step", weightCol="bend", seed=of["seed"] + number * classes + k
            )
            return tree.fit(learn.select("features", step.alias("step"), bend.alias("bend")))

        return pool.map(inheritable_thread_target(scored.sparkSession)(grow), range(classes))

    def _moved(self, scored: DataFrame, grown: list, classes: int, rate: float) -> DataFrame:
        out = scored
        for k, tree in enumerate(grown):
            out = tree.copy({tree.featuresCol: "features", tree.predictionCol: f"_t{k}"}).transform(out)
        moved = F.array(*[F.get("scores", k) + F.lit(float(rate)) * F.col(f"_t{k}") for k in range(classes)])
        return out.select("features", "label", "held", moved.alias("scores"))


def _stalled(losses: list, patience: int, tolerance: float) -> bool:
    """Whether the last ``patience`` losses are no better than the best one before."""
    if len(losses) <= patience or None in losses:
        return False
    return min(losses[-patience:]) > min(losses[:-patience]) - tolerance


def _ensemble(df: DataFrame, trees: list, rate: float) -> GBTRegressionModel:
    """The trees of one class as the library's own weighted ensemble: one column, saved and loaded as such."""
    context = df.sparkSession.sparkContext
    regression = context._jvm.org.apache.spark.ml.regression
    members = context._gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], weights[i] = tree._java_obj, float(rate)
    return GBTRegressionModel(regression.GBTRegressionModel(f"softmax_{trees[0].uid}", members, weights))


class _SoftmaxWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for k, side in enumerate(self.instance.sides):
            side.write().overwrite().save(f"{path}/sides/{k}")


class _SoftmaxReader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = SoftmaxBoostingModel()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.sides = [GBTRegressionModel.load(f"{path}/sides/{k}") for k in range(len(out.getOrDefault(out.state)["start"]))]
        return out


class SoftmaxBoostingModel(Model, MLReadable, MLWritable):
    """Adds ``rawPrediction`` (scores), ``probability`` and ``prediction``."""

    state = Param(Params._dummy(), "state", "first scores and rounds")
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")

    def __init__(self, sides=None, state=None):
        super().__init__()
        self.sides = sides or []
        if state is not None:
            self._set(state=state)

    def write(self):
        return _SoftmaxWriter(self)

    @classmethod
    def read(cls):
        return _SoftmaxReader()

    @property
    def featureImportances(self):
        """Mean of the classes' importances."""
        import numpy as np
        from pyspark.ml.linalg import Vectors

        each = [s.featureImportances.toArray() for s in self.sides]
        total = np.zeros(max(len(x) for x in each))
        for x in each:
            total[: len(x)] += x
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, start = df, self.getOrDefault(self.state)["start"]
        for k, side in enumerate(self.sides):
            out = side.copy({side.featuresCol: self.getOrDefault(self.featuresCol), side.predictionCol: f"_side{k}"}).transform(out)
        scores = F.array(*[F.lit(s) + F.col(f"_side{k}") for k, s in enumerate(start)])
        out = out.withColumn("_scores", scores).drop(*[f"_side{k}" for k in range(len(start))])
        best = F.array_position("_scores", F.array_max("_scores")) - 1
        return out.withColumns({
            "rawPrediction": array_to_vector("_scores"), "probability": array_to_vector(softmax(F.col("_scores"))), "prediction": best.cast("double"),
        }).drop("_scores")
