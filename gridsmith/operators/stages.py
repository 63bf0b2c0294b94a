"""Pipeline stages around the preparation operators; all can be saved and loaded."""

from __future__ import annotations

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasInputCols
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

from gridsmith.functions.scalars import as_column, date_parts, nan_to_null
from gridsmith.operators import preparation as P
from gridsmith.operators.codes import code_table, few_levels
from gridsmith.operators.neighbors import knn_fill_values
from gridsmith.operators.tiles import as_array
from gridsmith.session import cut_lineage

# Working copies of the features carry this prefix until the vector is built.
WORK = "_x_"
#: Wider vectors go without names: the metadata is part of every plan.
NAMED_FEATURES = 20_000

class _Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted stage whose state is one JSON value."""

    state = Param(Params._dummy(), "state", "fitted values")

    def __init__(self, state=None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    def value(self):
        return self.getOrDefault(self.state)


class ColumnCleaner(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Drops constant, identifier, mostly missing and few-valued columns."""

    missingThreshold = Param(Params._dummy(), "missingThreshold", "largest missing share kept")
    minUniqueRatio = Param(Params._dummy(), "minUniqueRatio", "smallest distinct share kept")
    removeConstant = Param(Params._dummy(), "removeConstant", "drop constant columns")
    removeIdentifiers = Param(Params._dummy(), "removeIdentifiers", "drop all-distinct columns")

    @keyword_only
    def __init__(self, *, missingThreshold=0.8, minUniqueRatio=0.01, removeConstant=True, removeIdentifiers=True):
        super().__init__()
        self._setDefault(missingThreshold=0.8, minUniqueRatio=0.01, removeConstant=True, removeIdentifiers=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        drop = P.columns_to_drop(
            df,
            self.getOrDefault(self.missingThreshold),
            self.getOrDefault(self.minUniqueRatio),
            self.getOrDefault(self.removeConstant),
            self.getOrDefault(self.removeIdentifiers),
        )
        return ColumnCleanerModel([list(x) for x in drop])


class ColumnCleanerModel(_Fitted):
    def dropped(self) -> list[str]:
        return [c for c, _ in self.value()]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.dropped() if c in df.columns])


class Imputation(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills numeric columns by mean, median or a constant and text by the mode or a constant."""

    numericStrategy = Param(Params._dummy(), "numericStrategy", "mean, median or constant")
    categoricalStrategy = Param(Params._dummy(), "categoricalStrategy", "most_frequent or constant")
    numericConstant = Param(Params._dummy(), "numericConstant", "fill for the constant strategy")

    @keyword_only
    def __init__(self, *, inputCols=None, numericStrategy="mean", categoricalStrategy="most_frequent", numericConstant=0.0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(numericStrategy="mean", categoricalStrategy="most_frequent", numericConstant=0.0)

    def _fit(self, df: DataFrame):
        names = self.getInputCols() if self.isDefined(self.inputCols) else df.columns
        numeric = [c for c in names if P.is_numeric_column(df, c)]
        texts = [c for c in names if df.schema[c].dataType.typeName() == "string"]
        return ImputationModel(
            P.imputation_values(
                df, numeric, texts,
                self.getOrDefault(self.numericStrategy), self.getOrDefault(self.categoricalStrategy),
                self.getOrDefault(self.numericConstant),
            )
        )


class ImputationModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return P.fill_missing(df, {c: v for c, v in self.value().items() if c in df.columns})


class Scaling(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Standard, min-max or robust scaling."""

    method = Param(Params._dummy(), "method", "standard, minmax or robust")

    @keyword_only
    def __init__(self, *, inputCols=None, method="standard"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(method="standard")

    def _fit(self, df: DataFrame):
        values = P.scaling_values(df, self.getInputCols(), self.getOrDefault(self.method))
        return ScalingModel({c: list(v) for c, v in values.items()})


class ScalingModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return P.scale(df, {c: tuple(v) for c, v in self.value().items()})


class OneHotPlaces(_Fitted):
    """State: ``{"sizes": {column: places}, "drop_first": bool}``; turns codes into places of a one-hot vector.

    The first level (if it is left out) and unseen values get the place behind
    the last, which the encoder leaves empty.
    """

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.value()
        first = 1 if s["drop_first"] else 0
        return df.withColumns({
            c: F.when(F.col(c) >= first, F.col(c) - first).otherwise(F.lit(float(size))) for c, size in s["sizes"].items()
        })


class FeatureNames(_Fitted):
    """State: ``[column, [names]]``; writes the names of the features into the vector's metadata."""

    def _transform(self, df: DataFrame) -> DataFrame:
        column, names = self.value()
        attributes = {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}
        return df.withColumn(column, F.col(column).alias(column, metadata={"ml_attr": attributes}))


class RestoreLabels(_Fitted):
    """State: the label values in the order of their codes; predictions become those values again."""

    def _transform(self, df: DataFrame) -> DataFrame:
        values = F.array(*[F.lit(float(v)) for v in self.value()])
        return df.withColumn("prediction", F.element_at(values, F.col("prediction").cast("int") + 1))


class DecodeLabels(_Fitted):
    """State: the class names in the order of their codes; adds ``predicted_class``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted_class", F.get(F.array(*[F.lit(v) for v in self.value()]), F.col("prediction").cast("int")))


class _TableWriter(MLWriter):
    """Metadata plus one Parquet folder per fitted table."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, name in enumerate(self.instance.table_names()):
            self.instance.tables[name].write.mode("overwrite").parquet(f"{path}/tables/{i}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.tables = {n: self.sparkSession.read.parquet(f"{path}/tables/{i}") for i, n in enumerate(out.table_names())}
        return out


class _TableModel(Model, MLReadable, MLWritable):
    state = Param(Params._dummy(), "state", "fitted values")

    def __init__(self, state=None, tables=None):
        super().__init__()
        self.tables = tables or {}
        if state is not None:
            self._set(state=state)

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


class OrdinalModel(_TableModel):
    """Sorted codes in place, unseen -1. Few levels live in the state, many in a table."""

    def table_names(self) -> list[str]:
        return self.getOrDefault(self.state)["tables"]

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.getOrDefault(self.state)
        for c, levels in s["levels"].items():
            df = P.ordinal_encode(df, c, c, levels)
        for c in s["tables"]:
            df = P.ordinal_encode(df, c, c, table=self.tables[c])
        return df


class KnnImputationModel(_TableModel):
    """Fills numeric columns from the k nearest training rows."""

    def table_names(self) -> list[str]:
        return ["donors"]

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.getOrDefault(self.state)
        return knn_fill_values(df, self.tables["donors"], s["keys"], s["columns"], s["k"], s["means"])


class FeatureCopies(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Working copies of the features, named by position: numbers as doubles, text as strings, dates as parts."""

    roles = Param(Params._dummy(), "roles", "columns by role")

    @keyword_only
    def __init__(self, *, roles=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def copies(self) -> list[tuple]:
        """(working column, role, name of the feature, expression); no name of a column enters the working names."""
        roles, out = self.getOrDefault(self.roles), []
        for c in roles.get("numeric", []):
            out.append(("numeric", c, nan_to_null(as_column(c).cast("double"))))
        for c in roles.get("datetime", []):
            out += [("numeric", n, part.cast("double")) for n, part in date_parts(c).items()]
        for role in ("categorical", "text_or_high_cardinality"):
            out += [(role, c, as_column(c).cast("string")) for c in roles.get(role, [])]
        return [(f"{WORK}{i}", *x) for i, x in enumerate(out)]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({work: value for work, _, _, value in self.copies()})


class DropWork(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Removes the working columns once the vector holds them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith(WORK) or c.startswith("_vec_")])


# What happens to each kind of feature unless told otherwise.
DEFAULTS = {
    "numeric_imputation": "mean",
    "categorical_imputation": "most_frequent",
    "remove_constant_cols": True,
    "remove_identifier_cols": True,
    "missing_threshold": 0.8,
    "min_unique_ratio": 0.01,
    "scale_features": True,
    "scaling_method": "standard",
    "encoding_method": "onehot",
    "drop_first": True,
    "knn_imputer_k": 5,
    "keys": [],
    "pca_components": None,
    "clean_columns": False,
}


class Preprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the whole feature preparation and returns a ``PipelineModel``.

    Numeric and date parts: impute and scale. Categories: impute and encode.
    Text: impute and code in sorted order. Everything else is left alone. The
    result is one vector column; the input columns stay as they are.
    """

    roles = Param(Params._dummy(), "roles", "columns by role")
    config = Param(Params._dummy(), "config", "overrides of the defaults")
    outputCol = Param(Params._dummy(), "outputCol", "vector column")

    @keyword_only
    def __init__(self, *, roles=None, config=None, outputCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(config={}, outputCol="features")

    def _fit(self, df: DataFrame) -> PipelineModel:
        config = {**DEFAULTS, **self.getOrDefault(self.config)}
        roles = {k: list(v) for k, v in self.getOrDefault(self.roles).items()}
        if config["clean_columns"]:
            used = [c for names in roles.values() for c in names]
            dropped = {
                c
                for c, _ in P.columns_to_drop(
                    df.select(*[as_column(c) for c in used]), config["missing_threshold"], config["min_unique_ratio"],
                    config["remove_constant_cols"], config["remove_identifier_cols"],
                )
            }
            roles = {k: [c for c in v if c not in dropped] for k, v in roles.items()}
        out = self.getOrDefault(self.outputCol)
        copies = FeatureCopies(roles=roles)
        stages: list = [copies]
        work = copies.transform(df)
        of_role = lambda role: [w for w, r, _, _ in copies.copies() if r == role]
        numeric, categories, texts = of_role("numeric"), of_role("categorical"), of_role("text_or_high_cardinality")
        if not numeric + categories + texts:
            raise ValueError("no feature columns to prepare")
        by_neighbors = config["numeric_imputation"] == "knn" and numeric
        fills = P.imputation_values(
            work, [] if by_neighbors else numeric, categories + texts,
            "mean" if by_neighbors else config["numeric_imputation"], config["categorical_imputation"],
        )
        if by_neighbors:
            keys = config["keys"]
            if not keys:
                raise ValueError("knn imputation needs key columns that identify a row")
            means = P.imputation_values(work, numeric, [])
            donors = cut_lineage(work.select(*[as_column(c) for c in keys + numeric]))
            stages.append(KnnImputationModel(
                {"keys": keys, "columns": numeric, "k": config["knn_imputer_k"], "means": means}, {"donors": donors}
            ))
            work = stages[-1].transform(work)
            numeric = [c for c in numeric if c in means]
        work = ImputationModel(fills).transform(work)
        if not by_neighbors:
            numeric = [c for c in numeric if c in fills]
        scaling = None
        if numeric and config["scale_features"] and config["scaling_method"]:
            scaling = {c: list(v) for c, v in P.scaling_values(work, numeric, config["scaling_method"]).items()}
        levels, many = {}, {}
        if categories + texts:
            levels = few_levels(work, categories + texts)
            many = {c: cut_lineage(code_table(work, c)) for c in categories + texts if c not in levels}
        components = config["pca_components"]
        assembled = "_vec_raw" if components else out
        more, _ = vector_stages(df.sparkSession, copies, fills, numeric, scaling, categories, texts, levels, many, config, assembled)
        stages += more
        if components:
            prepared = PipelineModel(stages).transform(df)
            stages += pca_stages(prepared, assembled, out, components)
        stages.append(DropWork())
        return PipelineModel(stages)


def vector_stages(spark, copies: FeatureCopies, fills: dict, numeric: list, scaling: dict | None, categories: list, texts: list, levels: dict, many: dict, config: dict, out: str) -> tuple[list, list[str]]:
    """Stages from the working copies to the vector, and the features' names; all fitted values are given.

    ``levels`` are the sorted values of columns with few of them, ``many`` the
    code tables of the others.
    """
    named = {w: n for w, _, n, _ in copies.copies()}
    stages: list = [ImputationModel(fills)]
    if scaling is not None:
        stages.append(ScalingModel(scaling))
    hot = [] if config["encoding_method"] == "ordinal" else categories
    ordinal = hot + [c for c in categories + texts if c not in hot]
    inputs, names = list(numeric), [named[c] for c in numeric]
    if ordinal:
        stages.append(OrdinalModel({"levels": {c: levels[c] for c in ordinal if c in levels}, "tables": list(many)}, many))
        first = 1 if config["drop_first"] else 0
        sizes = {c: (len(levels[c]) if c in levels else many[c].count()) - first for c in hot}
        sizes = {c: n for c, n in sizes.items() if n > 0}  # a single level tells nothing
        if sizes:
            stages.append(OneHotPlaces({"sizes": sizes, "drop_first": bool(first)}))
            vectors = {c: f"_vec_{c}" for c in sizes}
            widest = spark.createDataFrame([tuple(float(n - 1) for n in sizes.values())], [*sizes])
            # Sparse at any number of levels; the place behind the last is the one left out.
            stages.append(OneHotEncoder(inputCols=[*sizes], outputCols=[*vectors.values()], handleInvalid="keep").fit(widest))
            for c, n in sizes.items():
                inputs.append(vectors[c])
                names += [f"{named[c]}_{v}" for v in (levels[c][first:] if c in levels else range(first, n + first))]
        inputs += [c for c in ordinal if c not in hot]
        names += [named[c] for c in ordinal if c not in hot]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error"))
    if len(names) <= NAMED_FEATURES:
        stages.append(FeatureNames([out, names]))
    return stages, names


def set_places(df: DataFrame, key: str, features: str) -> DataFrame:
    """``key, place, value`` for every entry of a vector that is not zero; a sparse vector is never written out in full."""
    v = F.unwrap_udt(as_column(features))
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    entries = F.arrays_zip(places.alias("place"), v["values"].alias("value"))
    return df.select(as_column(key), F.inline(entries).alias("place", "value")).filter("value != 0")


def pca_stages(df: DataFrame, features: str, out: str, components: int | float) -> list:
    """Centre, then project; a share below 1 keeps the fewest components that explain it."""
    centre = StandardScaler(inputCol=features, outputCol="_vec_centred", withMean=True, withStd=False).fit(df)
    centred = centre.transform(df)
    if components < 1:
        width = centred.select("_vec_centred").first()[0].size
        explained = PCA(k=width, inputCol="_vec_centred", outputCol=out).fit(centred).explainedVariance.toArray()
        total, k = 0.0, 0
        while k < width and total < components:
            total += explained[k]
            k += 1
    else:
        k = int(components)
    return [centre, PCA(k=k, inputCol="_vec_centred", outputCol=out).fit(centred)]


def pca(df: DataFrame, features: str, out: str, components: int | float) -> tuple[DataFrame, list[float]]:
    """Projection on principal components and the variance share of each."""
    stages = pca_stages(df, features, out, components)
    model = PipelineModel(stages)
    return model.transform(df).drop("_vec_centred"), list(stages[-1].explainedVariance.toArray())


def cluster_projection(df: DataFrame, features: str, label: str, key: str) -> tuple[DataFrame, list[float]]:
    """Two principal coordinates per clustered point with its label."""
    from pyspark.ml.functions import vector_to_array

    projected, shares = pca(df, features, "_vec_plane", 2)
    xy = vector_to_array("_vec_plane")
    return projected.select(as_column(key), as_column(label), xy[0].alias("pc1"), xy[1].alias("pc2")), shares


# Up to this many columns the sums of all products of two columns are taken in one scan.
GRAM_WIDTH = 512
# Directions followed beside the wanted ones, and how often they are refined at most.
EXTRA_DIRECTIONS, MOST_ROUNDS = 10, 60


def truncated_svd(df: DataFrame, key: str, features: str, k: int = 2, gram_width: int = GRAM_WIDTH) -> tuple[DataFrame, list[float]]:
    """Uncentred projection on the leading right singular vectors: ``key, svd`` and the singular values.

    Up to ``gram_width`` columns each partition reduces its rows to one
    width-by-width Gram matrix, and the driver takes the eigenvectors of their
    sum. Wider rows are never squared: k and a few more directions are refined by
    subspace iteration, one scan and width times directions numbers a round.
    """
    import numpy as np

    x = as_array(df, features)
    rows = df.select(x.alias("x"))
    width = rows.select(F.size("x")).first()
    width = width[0] if width else 0
    if width <= gram_width:
        values, vectors = _gram_directions(rows)
    else:
        rows = rows.persist()
        try:
            values, vectors = _followed_directions(rows, width, min(width, k + EXTRA_DIRECTIONS), k)
        finally:
            rows.unpersist()
    order = np.argsort(values)[::-1][:k]
    chosen = vectors[:, order]
    if chosen.size:
        # The largest entry of a direction is positive, so its sign is settled.
        chosen = chosen * np.where(chosen[np.argmax(np.abs(chosen), axis=0), np.arange(chosen.shape[1])] > 0, 1.0, -1.0)

    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(np.stack(column.to_numpy()) @ chosen) if len(column) else [], dtype=object)

    singular = [float(np.sqrt(max(values[j], 0.0))) for j in order]
    return df.select(as_column(key), project(x).alias("svd")), singular


def _summed_rows(rows: DataFrame, part_of):
    """The sum over partitions of a matrix that ``part_of(block, total)`` adds a block of rows to, row by row of the matrix."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pandas as pd

        total = None
        for batch in batches:
            if len(batch):
                total = part_of(np.stack(batch["x"]), total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    cells = (
        rows.mapInPandas(run, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .groupBy("i")
        .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))  # one row of the matrix
        .select("i", "row.v")
        .orderBy("i")
    )
    return np.array([r["v"] for r in cells.toLocalIterator()])


def _gram_directions(rows: DataFrame):
    """Eigenvalues and vectors of the sum of all products of two columns."""
    import numpy as np

    matrix = _summed_rows(rows, lambda block, total: block.T @ block if total is None else total + block.T @ block)
    return np.linalg.eigh(matrix) if len(matrix) else (np.zeros(0), np.zeros((0, 0)))


def _followed_directions(rows: DataFrame, width: int, followed: int, k: int):
    """Leading eigenvalues and vectors, refined until the k largest values stand still."""
    import numpy as np

    basis = np.linalg.qr(np.random.default_rng(42).normal(size=(width, followed)))[0]
    context, before = rows.sparkSession.sparkContext, None
    for _ in range(MOST_ROUNDS):
        shared = context.broadcast(basis)

        def add(block, total, shared=shared):
            part = block.T @ (block @ shared.value)
            return part if total is None else total + part

        image = _summed_rows(rows, add)
        shared.destroy()
        values, turn = np.linalg.eigh(basis.T @ image)
        leading = np.sort(values)[::-1][:k]
        found = values, basis @ turn
        if followed == width or before is not None and np.allclose(leading, before, rtol=1e-12, atol=0):
            break
        before, basis = leading, np.linalg.qr(image)[0]
    return found
