"""Response models fitted on tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_int
from ..functions.vectors import matrix, sqdist, total
from ..session import cut_lineage
from .exact import hash_row_number
from .scoring import gram
from .stats import regression_fit

NOISE = 0.1
# Features that MLlib's normal equations accept.
MAX_TERMS = 4096


def _vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_vec", array_to_vector("x"))


@dataclass(frozen=True)
class ForestModel:
    """A random forest with the spread of its trees."""

    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``mean``, the forest prediction, and ``std``, the deviation between trees."""
        out = _vector(df)
        names = []
        for i, tree in enumerate(self.model.trees):
            tree.setFeaturesCol("_vec")
            tree.setPredictionCol(f"_t{i}")
            out = tree.transform(out)
            names.append(f"_t{i}")
        each = F.array(*names)
        n = F.lit(float(len(names)))
        # The forest's own mean: where no spread is asked for, the single trees are not evaluated.
        out = self.model.transform(out, {self.model.predictionCol: "mean"})
        away = F.transform(each, lambda t: (t - F.col("mean")) * (t - F.col("mean")))
        return out.withColumn("std", F.sqrt(total(away) / n)).drop("_vec", *names)


def fit_forest(
    df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42, bootstrap: bool = True
) -> ForestModel:
    """Random forest on ``x`` and ``y``; without ``bootstrap`` every tree sees all rows."""
    forest = RandomForestRegressor(
        featuresCol="_vec", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap
    )
    return ForestModel(forest.fit(_vector(df)))


@dataclass(frozen=True)
class QuadraticModel:
    """A full second-order response surface."""

    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_expanded(df)).drop("_vec", "_poly")


def _expanded(df: DataFrame) -> DataFrame:
    return PolynomialExpansion(degree=2, inputCol="_vec", outputCol="_poly").transform(_vector(df))


def fit_quadratic(df: DataFrame) -> QuadraticModel:
    """Least squares on all first- and second-order terms.

    By the normal equations up to as many terms as that solver takes, else by iteration.
    """
    width = len(df.select("x").first()["x"])
    terms = width * (width + 3) // 2
    ls = LinearRegression(featuresCol="_poly", labelCol="y", solver="normal" if terms <= MAX_TERMS else "l-bfgs")
    return QuadraticModel(ls.fit(_expanded(df)))


def inducing_points(df: DataFrame, m: int, seed: int = 42) -> np.ndarray:
    """``m`` k-means centres, or all rows when there are no more than ``m``."""
    few = df.select("x").limit(m + 1).collect()
    if len(few) <= m:
        return np.array([r["x"] for r in few], dtype=float)
    fitted = KMeans(k=m, seed=seed, featuresCol="_vec", maxIter=20).fit(_vector(df))
    return np.array(fitted.clusterCenters(), dtype=float)


def rbf(a: np.ndarray, b: np.ndarray, length: float = 1.0) -> np.ndarray:
    """Squared-exponential kernel matrix."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.exp(-0.5 * np.maximum(d2, 0.0) / (length * length))


def kernel_features(x: Column, z: np.ndarray, length: float = 1.0) -> Column:
    """Kernel values of a row with every inducing point."""
    centres = np.asarray(z, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(rows: pd.Series) -> pd.Series:
        return pd.Series(list(rbf(matrix(rows), centres, length)), dtype=object)

    return features(x)


@dataclass(frozen=True)
class Scale:
    """Means and deviations by which features and labels are standardized."""

    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: float
    y_std: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return (x - self.x_mean) / self.x_std

    def rows(self, df: DataFrame) -> DataFrame:
        x = [
            (F.col("x")[i] - float(m)) / float(s)
            for i, (m, s) in enumerate(zip(self.x_mean, self.x_std))
        ]
        return df.withColumn("x", F.array(*x)).withColumn("y", (F.col("y") - self.y_mean) / self.y_std)


def fit_scale(df: DataFrame) -> Scale:
    """Population means and deviations of ``x`` and ``y``; a constant has deviation 1."""
    width = len(df.select("x").first()["x"])
    columns = [F.col("x")[i] for i in range(width)] + [F.col("y")]
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean, std = np.array(row[::2], dtype=float), np.array(row[1::2], dtype=float)
    std[std == 0] = 1.0
    return Scale(mean[:-1], std[:-1], float(mean[-1]), float(std[-1]))


@dataclass(frozen=True)
class KernelModel:
    """Weights on the inducing points and the matrix of the predictive variance.

    A model with a ``scale`` was fitted on standardized rows and answers in the original units.
    """

    z: np.ndarray
    weights: np.ndarray
    inverse: np.ndarray | None
    noise: float
    length: float
    scale: Scale | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the posterior ``mean`` and ``std``; the variance is at least 1e-6."""
        z, w, inv, noise, length = self.z, self.weights, self.inverse, self.noise, self.length
        scale = self.scale

        @F.pandas_udf(
            T.StructType(
                [T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())]
            )
        )
        def posterior(rows: pd.Series) -> pd.DataFrame:
            x = matrix(rows)
            k = rbf(x if scale is None else scale.features(x), z, length)
            if inv is None:
                var = np.full(len(k), noise)
            else:
                var = np.maximum(1.0 - (k * (k @ inv)).sum(1) + noise, 1e-6)
            mean, std = k @ w, np.sqrt(var)
            if scale is not None:
                mean, std = mean * scale.y_std + scale.y_mean, std * scale.y_std
            return pd.DataFrame({"mean": mean, "std": std})

        return (
            df.withColumn("_p", posterior("x"))
            .withColumn("mean", F.col("_p.mean"))
            .withColumn("std", F.col("_p.std"))
            .drop("_p")
        )


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a + 1e-6 * np.eye(len(a)), b)


def _normal_equations(df: DataFrame, weight: str | None = None):
    """Sums over the rows of kernel features ``_k``: one m x m matrix and one vector."""
    row = gram(df, [], "_k", "y", weight).first()
    m = len(row["xty"])
    return np.array(row["xtx"]).reshape(m, m), np.array(row["xty"])


def _standardized(df: DataFrame, z: np.ndarray, standardize: bool):
    if not standardize:
        return df, z, None
    scale = fit_scale(df)
    return scale.rows(df), scale.features(np.asarray(z, dtype=float)), scale


def fit_nystrom(
    df: DataFrame,
    z: np.ndarray,
    noise: float = NOISE,
    length: float = 1.0,
    standardize: bool = True,
) -> KernelModel:
    """Kernel regression through the inducing points.

    The n x n system (K Kmm^-1 K' + noise I) a = y is solved in its m x m Woodbury form. Features
    and labels are standardized first, and ``z`` (in the units of ``x``) with them.
    """
    df, z, scale = _standardized(df, z, standardize)
    kmm = rbf(z, z, length) + noise * np.eye(len(z))
    a, b = _normal_equations(df.withColumn("_k", kernel_features(F.col("x"), z, length)))
    return KernelModel(z, _solve(noise * kmm + a, b), None, noise, length, scale)


def fit_fitc(
    df: DataFrame,
    z: np.ndarray,
    noise: float = NOISE,
    length: float = 1.0,
    standardize: bool = True,
) -> KernelModel:
    """Kernel regression with a weight per row for the variance the inducing points miss."""
    df, z, scale = _standardized(df, z, standardize)
    kmm = rbf(z, z, length)
    inv = np.linalg.inv(kmm)

    @F.pandas_udf(T.DoubleType())
    def row_weight(k: pd.Series) -> pd.Series:
        m = matrix(k)
        missed = np.maximum(1.0 - (m * np.linalg.solve(kmm, m.T).T).sum(1), 1e-6)
        return pd.Series(1.0 / (missed + noise))

    rows = df.withColumn("_k", kernel_features(F.col("x"), z, length))
    a, b = _normal_equations(rows.withColumn("_w", row_weight("_k")), "_w")
    return KernelModel(z, _solve(a + inv, b), inv, noise, length, scale)


def fit_vfe(
    df: DataFrame,
    z: np.ndarray,
    noise: float = NOISE,
    length: float = 1.0,
    standardize: bool = True,
) -> KernelModel:
    """Kernel regression in the variational form with fixed inducing points."""
    df, z, scale = _standardized(df, z, standardize)
    kmm = rbf(z, z, length) + 1e-6 * np.eye(len(z))
    a, b = _normal_equations(df.withColumn("_k", kernel_features(F.col("x"), z, length)))
    return KernelModel(z, _solve(a + noise * kmm, b), np.linalg.inv(kmm), noise, length, scale)


def median_distance(
    df: DataFrame, row: str, n_pairs: int = 20_000, seed: int | str = 42
) -> DataFrame:
    """Median of the positive distances of ``n_pairs`` hashed pairs of rows.

    The rows are numbered by hash; pair r joins the rows at two hashed numbers, whatever the size
    of the table. Without a positive distance the value is the square root of the width.
    """
    hashed = df.select(row, "x").withColumn("_h", hash_int(str(seed), F.col(row)))
    rows = cut_lineage(hash_row_number(hashed, [], "_h", [row], "_at").select("_at", "x"), "rows")
    n = rows.count()
    pairs = df.sparkSession.range(n_pairs).select(
        *[_place(n, str(seed), side, F.col("id")).alias(side) for side in ("i", "j")]
    )
    left = rows.select(F.col("_at").alias("i"), F.col("x").alias("a"))
    right = rows.select(F.col("_at").alias("j"), F.col("x").alias("b"))
    distances = pairs.join(left, "i").join(right, "j").select(
        F.sqrt(sqdist(F.col("a"), F.col("b"))).alias("d"), F.size("a").alias("width")
    )
    middle = F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5))
    return distances.agg(F.coalesce(middle, F.sqrt(F.max("width"))).alias("median_distance"))


def _place(n: int, *parts) -> Column:
    """A number in 1..n from 52 hashed bits."""
    bits = hash_int(*parts) * F.lit(1 << 20) + hash_int(*parts, "low") % F.lit(1 << 20)
    return bits % F.lit(max(n, 1)).cast("long") + 1


def pca2(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Scores on two principal components and their explained variance shares.

    The sign of a component is fixed by its largest loading.
    """
    model = PCA(k=2, inputCol="_vec", outputCol="_pc").fit(_vector(df))
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), range(2)])
    scores = model.transform(_vector(df)).withColumn("_s", vector_to_array("_pc"))
    out = scores.withColumn("pc1", F.col("_s")[0] * float(sign[0])).withColumn(
        "pc2", F.col("_s")[1] * float(sign[1])
    )
    return out.drop("_vec", "_pc", "_s"), [float(v) for v in model.explainedVariance]


def compare_surrogates(
    df: DataFrame, configs: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable, str]]
) -> DataFrame:
    """Mean squared error, R-squared and wall time of several fits.

    A configuration is (change applied to the training rows, fitting function, prediction column).
    There is one fit per configuration, and each is a distributed job. Changed training rows are
    computed once, as a fit passes over them several times; they stay in their partitions, by which a
    forest draws its samples.
    """
    spark, rows = df.sparkSession, []
    for name, (harden, fit, column) in configs.items():
        start = time.monotonic()
        training = harden(df)
        if training is not df:
            training = training.persist(StorageLevel.DISK_ONLY)
        model = fit(training)
        if training is not df:
            training.unpersist()
        score = regression_fit(model.predict(df), "y", column).first()
        rows.append((name, score["mse"], score["r2"], time.monotonic() - start))
    return spark.createDataFrame(rows, "config string, mse double, r2 double, seconds double")


def centroids(df: DataFrame, group: str) -> np.ndarray:
    """Mean vector per group, one row each, as inducing points."""
    means = (
        df.select(group, F.posexplode("x").alias("dim", "v"))
        .groupBy(group, "dim")
        .agg(F.avg("v").alias("v"))
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_a"))
        .orderBy(group)
        .select(F.col("_a.v").alias("v"))
    )
    return np.array([r["v"] for r in means.collect()], dtype=float)
