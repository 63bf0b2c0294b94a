"""A linear margin classifier with probabilities: sigmoid curves over margins of rows the machine has not seen.

For each class the machine is fitted once without each fold and its margins are
taken on that fold; a logistic curve over all these margins turns the margins of
the machine fitted to all rows into probabilities. The curve aims a little below
one and above zero, so that perfectly parted classes keep a finite slope.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
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


class CalibratedSVC(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Linear machines, one for two classes and else one for each, with calibrated probabilities; labels are 0..K-1."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")
    labelCol = Param(Params._dummy(), "labelCol", "label column")
    regParam = Param(Params._dummy(), "regParam", "penalty")
    maxIter = Param(Params._dummy(), "maxIter", "iterations of a machine")
    folds = Param(Params._dummy(), "folds", "parts whose margins come from a machine fitted without them")
    parallelism = Param(Params._dummy(), "parallelism", "machines fitted at once")
    seed = Param(Params._dummy(), "seed", "seed of the folds")

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", regParam=0.0, maxIter=100, folds=3, parallelism=4, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", regParam=0.0, maxIter=100, folds=3, parallelism=4, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        of = {p.name: self.getOrDefault(p) for p in self.params}
        slim = df.select(as_column(of["featuresCol"]).alias("features"), as_column(of["labelCol"]).cast("double").alias("label")).dropna(subset=["label"])
        # A row's fold is told by its content: copies stay together, and a lost task deals the same.
        data = slim.withColumn("fold", F.pmod(F.xxhash64("features", "label", F.lit(of["seed"])), F.lit(of["folds"]))).persist()
        cells = {(int(r["label"]), r["fold"]): r["n"] for r in data.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows, places = sum(cells.values()), max((k for k, _ in cells), default=1) + 1
        counts = {k: sum(n for (c, _), n in cells.items() if c == k) for k in range(places)}
        sides = [1] if places <= 2 else list(range(places))

        def parted(side, fold):
            """Whether both kinds of rows lie outside the fold; if not, its margins are those of the machine fitted to all rows."""
            return fold is None or len({c == side for c, f in cells if f != fold}) == 2

        def machine(side, fold=None):
            part = data if fold is None else data.filter(F.col("fold") != fold)
            one = part.select("features", (F.col("label") == side).cast("double").alias("label"))
            return LinearSVC(regParam=of["regParam"], maxIter=of["maxIter"], standardization=False).fit(one)

        wanted = [(side, fold) for side in sides for fold in [None, *range(of["folds"])] if parted(side, fold)]
        try:
            with ThreadPool(max(1, min(of["parallelism"], len(wanted)))) as pool:
                work = inheritable_thread_target(df.sparkSession)
                fitted = dict(zip(wanted, pool.map(work(lambda w: machine(*w)), wanted, chunksize=1), strict=True))
                curves = pool.map(work(lambda side: self._curve(data, side, [fitted.get((side, f), fitted[side, None]) for f in range(of["folds"])], counts.get(side, 0), rows)), sides, chunksize=1)
        finally:
            data.unpersist()
        return CalibratedSVCModel([fitted[side, None] for side in sides], {"curves": curves})._set(featuresCol=of["featuresCol"])

    @staticmethod
    def _curve(data: DataFrame, side: int, machines: list, inside: int, rows: int) -> list[float]:
        """Slope and offset of the logistic curve over the margins of unseen rows."""
        margins = None
        for fold, machine in enumerate(machines):
            part = machine.copy({machine.rawPredictionCol: "_m", machine.predictionCol: ""}).transform(data.filter(F.col("fold") == fold))
            part = part.select(vector_to_array("_m")[1].alias("m"), (F.col("label") == side).alias("hit"))
            margins = part if margins is None else margins.unionByName(part)
        outside = rows - inside
        aim = F.when(F.col("hit"), (inside + 1.0) / (inside + 2.0)).otherwise(1.0 / (outside + 2.0))
        # A soft target is a row of each class, weighted.
        weighted = margins.select("m", F.inline(F.array(*[F.struct(F.lit(y).alias("label"), w.alias("w")) for y, w in ((1.0, aim), (0.0, 1 - aim))])))
        fitted = LogisticRegression(weightCol="w", maxIter=100).fit(weighted.select(array_to_vector(F.array("m")).alias("features"), "label", "w"))
        return [float(fitted.coefficients[0]), float(fitted.intercept)]


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for k, machine in enumerate(self.instance.models):
            machine.write().overwrite().save(f"{path}/machines/{k}")


class _Reader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = CalibratedSVCModel()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.models = [LinearSVCModel.load(f"{path}/machines/{k}") for k in range(len(out.getOrDefault(out.state)["curves"]))]
        return out


class CalibratedSVCModel(Model, MLReadable, MLWritable):
    """Adds ``rawPrediction`` (margins), ``probability`` and ``prediction``, which goes by the margins."""

    state = Param(Params._dummy(), "state", "curves")
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column")

    def __init__(self, models=None, state=None):
        super().__init__()
        self.models = models or []
        if state is not None:
            self._set(state=state)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

    def _transform(self, df: DataFrame) -> DataFrame:
        out, names = df, [f"_m{k}" for k in range(len(self.models))]
        for name, machine in zip(names, self.models, strict=True):
            out = machine.copy({machine.featuresCol: self.getOrDefault(self.featuresCol), machine.rawPredictionCol: name, machine.predictionCol: ""}).transform(out)
        margins = [vector_to_array(name)[1] for name in names]
        chances = [1 / (1 + F.exp(-(F.lit(a) * m + F.lit(b)))) for m, (a, b) in zip(margins, self.getOrDefault(self.state)["curves"], strict=True)]
        if len(names) == 1:
            raw, chance = F.array(-margins[0], margins[0]), F.array(1 - chances[0], chances[0])
        else:
            raw, each = F.array(*margins), F.array(*chances)
            total = F.aggregate(each, F.lit(0.0), lambda t, c: t + c)
            chance = F.transform(each, lambda c: F.when(total > 0, c / total).otherwise(1 / len(names)))
        best = (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(chance), "prediction": best}).drop(*names)
