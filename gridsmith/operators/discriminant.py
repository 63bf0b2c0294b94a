"""Linear discriminant analysis: class means and a pooled covariance from one pass."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalars import as_column
from gridsmith.operators.stages import _Fitted


class LinearDiscriminant(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian classes with one covariance; labels are 0..K-1."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")
    labelCol = Param(Params._dummy(), "labelCol", "label column")

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        import numpy as np

        slim = df.select(
            as_column(self.getOrDefault(self.labelCol)).cast("double").alias("y"),
            vector_to_array(as_column(self.getOrDefault(self.featuresCol))).alias("x"),
        ).dropna()
        # Sums are taken around one row so that large offsets do not cancel digits.
        origin = slim.select("x").first()["x"]

        def gather(batches):
            import numpy as np
            import pandas as pd

            counts, sums, gram = {}, {}, 0
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["x"]) - np.array(origin)
                y = batch["y"].to_numpy()
                gram = gram + x.T @ x
                for c in np.unique(y):
                    rows = x[y == c]
                    counts[c] = counts.get(c, 0) + len(rows)
                    sums[c] = sums.get(c, 0) + rows.sum(axis=0)
            # The covariance is pooled, so one matrix serves all classes.
            out = [(c, -1, counts[c], sums[c]) for c in counts]
            out += [(0.0, i, 0, row) for i, row in enumerate(gram)] if counts else []
            if out:
                yield pd.DataFrame(out, columns=["y", "i", "n", "v"])

        # Per partition one vector per class and one width-by-width matrix; their sums come back as whole rows.
        cells = (
            slim.mapInPandas(gather, "y double, i int, n bigint, v array<double>")
            .select("y", "i", "n", F.posexplode("v").alias("j", "v"))
            .groupBy("y", "i", "j")
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            .groupBy("y", "i")
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
            .select("y", "i", "n", "row.v")
        )
        width = len(origin)
        n, sums = {}, {}
        within = np.zeros((width, width))
        for r in cells.toLocalIterator():
            if r["i"] < 0:
                n[r["y"]], sums[r["y"]] = r["n"], np.array(r["v"])
            else:
                within[r["i"]] = r["v"]
        classes = sorted(n)
        for c in classes:
            within -= np.outer(sums[c], sums[c]) / n[c]
        total = sum(n.values())
        inverse = np.linalg.pinv(within / max(total - len(classes), 1))
        state = {"classes": classes, "weights": [], "offsets": []}
        for c in classes:
            mean = sums[c] / n[c] + np.array(origin)
            w = inverse @ mean
            state["weights"].append([float(v) for v in w])
            state["offsets"].append(float(-0.5 * mean @ w + np.log(n[c] / total)))
        return LinearDiscriminantModel(state)._with(self.getOrDefault(self.featuresCol))


class LinearDiscriminantModel(_Fitted):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")

    def _with(self, features: str):
        self._set(featuresCol=features)
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.value()
        x = vector_to_array(as_column(self.getOrDefault(self.featuresCol)))
        scores = []
        for weights, offset in zip(s["weights"], s["offsets"]):
            w = F.array(*[F.lit(v) for v in weights])
            dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
            scores.append(dot + F.lit(offset))
        raw = F.array(*scores)
        top = F.array_max("_raw")
        powers = F.transform("_raw", lambda v: F.exp(v - top))
        classes = F.array(*[F.lit(float(c)) for c in s["classes"]])
        return (
            df.withColumn("_raw", raw)
            .withColumn("prediction", F.element_at(classes, F.array_position("_raw", top).cast("int")))
            .withColumn("_pow", powers)
            .withColumn(
                "probability",
                array_to_vector(F.transform("_pow", lambda v: v / F.aggregate("_pow", F.lit(0.0), lambda t, u: t + u))),
            )
            .drop("_raw", "_pow")
        )
