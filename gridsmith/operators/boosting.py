"""AdaBoost with shallow trees: weighted fits, weights moved by a column expression."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.session import cut_lineage


# Weights stay cached between rounds; their lineage is cut every few rounds.
ROUNDS_PER_CHECKPOINT = 10


def _next_weights(old: DataFrame, new: DataFrame, round_number: int) -> DataFrame:
    new = cut_lineage(new) if (round_number + 1) % ROUNDS_PER_CHECKPOINT == 0 else new
    new = new.persist()
    new.count()
    old.unpersist()
    return new


class _Boosted(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")
    labelCol = Param(Params._dummy(), "labelCol", "label column")
    rounds = Param(Params._dummy(), "rounds", "largest number of trees")
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each tree")
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree")
    seed = Param(Params._dummy(), "seed", "random seed")

    def _training(self, df: DataFrame) -> DataFrame:
        slim = df.select(
            as_column(self.getOrDefault(self.featuresCol)).alias("features"),
            as_column(self.getOrDefault(self.labelCol)).cast("double").alias("label"),
        ).dropna(subset=["label"])
        n = slim.count()
        return slim.withColumn("w", F.lit(1.0 / n)).persist()


class AdaBoostClassifier(_Boosted):
    """Discrete multi-class boosting: a round stops the loop when it is no better than chance."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=50, learningRate=1.0, maxDepth=1, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", rounds=50, learningRate=1.0, maxDepth=1, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        data = self._training(df)
        # Votes need a place for every code; the weights depend on how many classes there are.
        places, classes = data.agg(F.max("label").cast("int") + 1, F.count_distinct("label")).first()
        classes = max(2, classes)
        rate, trees, weights = self.getOrDefault(self.learningRate), [], []
        for i in range(self.getOrDefault(self.rounds)):
            tree = DecisionTreeClassifier(
                maxDepth=self.getOrDefault(self.maxDepth), weightCol="w", seed=self.getOrDefault(self.seed) + i
            ).fit(data)
            missed = (F.col("prediction") != F.col("label")).cast("double")
            guessed = tree.transform(data).select("features", "label", "w", missed.alias("miss"))
            bad, total = guessed.agg(F.sum(F.col("w") * F.col("miss")), F.sum("w")).first()
            error = bad / total
            if error <= 0:
                trees.append(tree)
                weights.append(1.0)
                break
            if error >= 1 - 1 / classes:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            alpha = rate * (math.log((1 - error) / error) + math.log(classes - 1 if classes > 2 else 1))
            trees.append(tree)
            weights.append(alpha)
            grown = total - bad + bad * math.exp(alpha)
            moved = (F.col("w") * F.exp(F.col("miss") * alpha) / F.lit(grown)).alias("w")
            data = _next_weights(data, guessed.select("features", "label", moved), i)
        data.unpersist()
        model = AdaBoostModel(trees, {"weights": weights, "classes": places, "kind": "classification"})
        return model._set(featuresCol=self.getOrDefault(self.featuresCol))


class AdaBoostRegressor(_Boosted):
    """Linear-loss boosting of regression trees; predicts the weighted median of its trees."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=50, learningRate=1.0, maxDepth=3, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", rounds=50, learningRate=1.0, maxDepth=3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        data = self._training(df)
        rate, trees, weights = self.getOrDefault(self.learningRate), [], []
        for i in range(self.getOrDefault(self.rounds)):
            tree = DecisionTreeRegressor(
                maxDepth=self.getOrDefault(self.maxDepth), weightCol="w", seed=self.getOrDefault(self.seed) + i
            ).fit(data)
            gap = F.abs(F.col("prediction") - F.col("label"))
            guessed = tree.transform(data).select("features", "label", "w", gap.alias("gap"))
            worst = guessed.agg(F.max("gap")).first()[0]
            if not worst:
                trees.append(tree)
                weights.append(1.0)
                break
            loss, total = guessed.agg(F.sum(F.col("w") * F.col("gap") / F.lit(worst)), F.sum("w")).first()
            error = loss / total
            if error >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = error / (1 - error)
            trees.append(tree)
            weights.append(rate * math.log(1 / beta))
            moved = F.col("w") * F.pow(F.lit(beta), (1 - F.col("gap") / F.lit(worst)) * rate)
            sized = guessed.select("features", "label", moved.alias("w"))
            whole = sized.agg(F.sum("w")).first()[0]
            data = _next_weights(data, sized.withColumn("w", F.col("w") / F.lit(whole)), i)
        data.unpersist()
        model = AdaBoostModel(trees, {"weights": weights, "classes": 0, "kind": "regression"})
        return model._set(featuresCol=self.getOrDefault(self.featuresCol))


class _BoostWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, tree in enumerate(self.instance.trees):
            tree.write().overwrite().save(f"{path}/trees/{i}")


class _BoostReader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = AdaBoostModel()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        s = out.getOrDefault(out.state)
        kind = DecisionTreeClassificationModel if s["kind"] == "classification" else DecisionTreeRegressionModel
        out.trees = [kind.load(f"{path}/trees/{i}") for i in range(len(s["weights"]))]
        return out


class AdaBoostModel(Model, MLReadable, MLWritable):
    state = Param(Params._dummy(), "state", "weights and kind")
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")

    def __init__(self, trees=None, state=None):
        super().__init__()
        self.trees = trees or []
        if state is not None:
            self._set(state=state)

    def write(self):
        return _BoostWriter(self)

    @classmethod
    def read(cls):
        return _BoostReader()

    @property
    def featureImportances(self):
        """Weighted mean of the trees' importances."""
        from pyspark.ml.linalg import Vectors

        weights = self.getOrDefault(self.state)["weights"]
        total = sum(w * t.featureImportances.toArray() for w, t in zip(weights, self.trees))
        return Vectors.dense(total / sum(weights))

    def _transform(self, df: DataFrame) -> DataFrame:
        s, out = self.getOrDefault(self.state), df
        names = []
        for i, tree in enumerate(self.trees):
            # Only the prediction of each tree is kept.
            tree = tree.copy({tree.featuresCol: self.getOrDefault(self.featuresCol), tree.predictionCol: f"_t{i}"})
            if s["kind"] == "classification":
                tree.setRawPredictionCol("").setProbabilityCol("")
            out = tree.transform(out)
            names.append(f"_t{i}")
        weights = s["weights"]
        if s["kind"] == "classification":
            votes = F.array(
                *[
                    sum((F.when(F.col(n) == c, w).otherwise(0.0) for n, w in zip(names, weights)), F.lit(0.0))
                    for c in range(s["classes"])
                ]
            )
            prediction = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
        else:
            pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, weights)]))
            half = sum(weights) / 2
            state = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
            prediction = F.aggregate(
                pairs,
                state,
                lambda a, e: F.struct(
                    (a["w"] + e["w"]).alias("w"),
                    F.when(a["p"].isNull() & (a["w"] + e["w"] >= half), e["p"]).otherwise(a["p"]).alias("p"),
                ),
                lambda a: a["p"],
            )
        return out.withColumn("prediction", prediction).drop(*names)
