"""Principal modes of a field with many cells and few times, and what explains a series by them.

The decomposition goes over times: the Gram matrix of times is summed over cells
(each cell's series is one row of bounded length), its eigenvectors are the
modes' standardised time series, and the patterns come back by one more pass over
the cells.  No matrix of cells by cells exists anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators import trends, windows
from isobar.session import materialize

#: Times of a field at most: their Gram matrix is held by a task and by the driver.
MOST_TIMES = 5000
#: Gram matrices that one step of the tree adds up.
FAN_IN = 8


@dataclass
class Modes:
    """times (T), pcs (T, k) of unit deviation, shares (k), cells: (keys, weight, series) as written, and what maps them to patterns."""

    times: list
    pcs: np.ndarray
    shares: np.ndarray
    cells: DataFrame
    keys: list[str]
    to_pattern: np.ndarray  # (T, k): a cell's anomalies times this are its pattern

    def table(self, spark) -> DataFrame:
        """(mode, time, pc, share)."""
        rows = [(k + 1, t, float(self.pcs[i, k]), float(self.shares[k])) for k in range(self.pcs.shape[1]) for i, t in enumerate(self.times)]
        kind = "long" if not self.times or isinstance(self.times[0], int) else "string"
        return spark.createDataFrame(rows, f"mode int, time {kind}, pc double, share double")

    def patterns(self, cells: DataFrame | None = None) -> DataFrame:
        """(keys, mode, pattern) of all cells, or of some rows of ``cells``."""
        own, keys = self.to_pattern, self.keys
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.cells.select(*keys).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _series(batch.column(len(keys)), len(own))
                found = (x - x.mean(axis=1, keepdims=True)) @ own
                n, k = found.shape
                at = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(found.ravel())], [*keys, "mode", "pattern"])

        return (self.cells if cells is None else cells).select(*keys, "series").mapInArrow(run, f"{kinds}, mode int, pattern double")


def _series(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), length)


def _gram(cells: DataFrame, length: int) -> np.ndarray:
    """Sum over cells of weight squared times the outer product of anomalies; added up in a tree of tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((length, length)), 0
        for batch in batches:
            x = _series(batch.column(1), length)
            x = (x - x.mean(axis=1, keepdims=True)) * batch.column(0).to_numpy(zero_copy_only=False)[:, None]
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["blob"])

    def added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(b.as_py(), float) for b in rows["blob"]), np.zeros(length * length))
        return pa.table({"blob": pa.array([total.tobytes()]), "n": pa.array([key[0].as_py()], pa.int64())})

    held = cells.select("weight", "series").mapInArrow(part, "blob binary").withColumn("n", F.monotonically_increasing_id())
    held = materialize(held, "gram")
    count = held.count()
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        held = materialize(held.withColumn("n", F.pmod(F.xxhash64("n"), F.lit(count))).groupBy("n").applyInArrow(added, "blob binary, n long"), "gram")
        count = held.count()
    return sum((np.frombuffer(r.blob, float).reshape(length, length) for r in held.select("blob").toLocalIterator()), np.zeros((length, length)))


def modes(field: DataFrame, time: str, keys: list[str], value: str, lat: str, k: int, probe: tuple[dict[str, float], bool] | None = None) -> Modes:
    """The ``k`` leading modes of (time, keys, value), cells weighted by the root of the cosine of ``lat`` (one of the keys).

    Cells that lack a time (or hold null or NaN at one) are left out.  probe:
    ({key: place}, whether patterns are positive there); the nearest cell
    decides.  Without it each time series' largest value in size is positive.
    Repeated (time, keys) count with their mean.
    """
    found = sorted(r[0] for r in field.select(time).distinct().where(F.col(time).isNotNull()).limit(MOST_TIMES + 1).collect())
    if len(found) > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times")
    own = field.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, time).agg(F.avg(value).alias("_v"))
    series = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))).alias("_s")).where(F.size("_s") == len(found))
    cells = series.select(*keys, F.sqrt(F.greatest(F.cos(F.radians(F.col(lat))), F.lit(0.0))).alias("weight"), F.transform("_s", lambda s: s["v"]).alias("series"))
    cells = materialize(cells, "cell-series")
    length = len(found)
    values, vectors = np.linalg.eigh(_gram(cells, length)) if length else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(values)[::-1][:k]
    size = np.sqrt(np.maximum(values[order], 0.0))
    u = vectors[:, order]
    scale = np.where(size > 0, size, 1.0)
    out = Modes(found, u * size, np.maximum(values[order], 0.0) / max(values.clip(0).sum(), 1e-300), cells, keys, u / scale)
    sign = np.ones(len(order))
    if probe is not None and length:
        at, positive = probe
        away = sum((F.pow(F.col(c) - v, 2) for c, v in at.items()), F.lit(0.0))
        near = cells.orderBy(away, *keys).limit(1)
        for r in out.patterns(near).collect():
            sign[r.mode - 1] = (1.0 if positive else -1.0) * (1.0 if r.pattern >= 0 else -1.0)
    elif length:
        largest = np.abs(out.pcs).argmax(axis=0)
        sign = np.where(out.pcs[largest, np.arange(len(order))] >= 0, 1.0, -1.0)
    deviation = out.pcs.std(axis=0) if length else np.ones(len(order))
    out.pcs, out.to_pattern = out.pcs * sign / np.where(deviation > 0, deviation, 1.0), out.to_pattern * sign
    return out


# --- attribution of series ------------------------------------------------------------


def ridge_table(rows: DataFrame, by: list[str], x: str, y: str, predictors: list[str], alphas: np.ndarray, folds: int = 5, reps: int = 20, seed: int = 42) -> DataFrame:
    """(by, term, coef, importance, r2_cv, alpha, n): ridge of each group's standardised ``y``, a row a predictor.

    A group is one series (a row a time).  The penalty is chosen by leaving one
    out; r2_cv leaves out contiguous blocks in turn; importance is the mean loss
    of R2 when a predictor is shuffled.  Rows with a missing value are left out.
    """

    def run(key, part):
        part = part.dropna(subset=[y, *predictors]).sort_values(x)
        v, a = part[y].to_numpy(float), part[predictors].to_numpy(float)
        n = len(v)
        head = dict(zip(by, key, strict=True))
        if n < 4 or v.std() == 0:
            return pd.DataFrame([{**head, "term": c, "coef": np.nan, "importance": np.nan, "r2_cv": np.nan, "alpha": np.nan, "n": n} for c in predictors])
        v = (v - v.mean()) / v.std()
        coef, alpha = trends.ridge(a, v, alphas)
        said = np.full(n, np.nan)
        edges = [n * i // folds for i in range(folds + 1)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            rest = np.r_[0:lo, hi:n]
            if len(rest) >= 3 and hi > lo:
                own, _ = trends.ridge(a[rest], v[rest], alphas)
                said[lo:hi] = a[lo:hi] @ own[:-1] + own[-1]
        ok = ~np.isnan(said)
        r2 = 1 - ((v - said)[ok] ** 2).sum() / ((v[ok] - v[ok].mean()) ** 2).sum() if ok.sum() > 3 else np.nan
        loss = trends.permutation_importance(a, v, lambda z: z @ coef[:-1] + coef[-1], reps, seed)
        return pd.DataFrame([{**head, "term": c, "coef": coef[j], "importance": loss[j], "r2_cv": r2, "alpha": alpha, "n": n} for j, c in enumerate(predictors)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", term string, coef double, importance double, r2_cv double, alpha double, n int"
    return rows.select(*by, x, y, *predictors).groupBy(*by).applyInPandas(run, schema)


def forest(trees: int = 300, depth: int = 4, least: int = 3, seed: int = 42) -> Callable:
    """A factory of ``pyspark.ml`` forests over the vector column ``features``."""

    def make():
        from pyspark.ml.regression import RandomForestRegressor

        return RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="said", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, maxBins=64)

    return make


def block_cv(rows: DataFrame, by: str, x: str, y: str, predictors: list[str], factory: Callable, folds: int = 5, parallel: int = 4) -> DataFrame:
    """(by, r2): models of ``factory`` (an estimator of ``pyspark.ml``) fitted without each contiguous block in turn.

    The values of ``by`` are a short list (regions); each fit is a Spark job over
    its own rows, ``parallel`` of them at a time.  Rows with a missing value are
    left out; groups of fewer than four rows have no R2.
    """
    from pyspark.ml.feature import VectorAssembler

    own = rows.select(by, x, F.col(y).cast("double").alias("y"), *predictors).dropna()
    own = own.withColumn("fold", windows.contiguous_folds([by], x, folds))
    table = materialize(VectorAssembler(inputCols=predictors, outputCol="features").transform(own).select(by, "y", "fold", *predictors), "block-cv")
    vectors = VectorAssembler(inputCols=predictors, outputCol="features").transform(table)
    groups = [(r[0], r.fold) for r in table.groupBy(by, "fold").count().select(by, "fold").orderBy(by, "fold").collect()]

    def fitted(at: tuple) -> DataFrame | None:
        mine = vectors.where(F.col(by).eqNullSafe(F.lit(at[0])))
        rest, left = mine.where(F.col("fold") != at[1]), mine.where(F.col("fold") == at[1])
        if len(rest.take(3)) < 3:
            return None
        return factory().fit(rest).transform(left).select(by, "y", F.col("said"))

    with ThreadPoolExecutor(parallel) as pool:
        parts = [p for p in pool.map(fitted, groups) if p is not None]
    if not parts:
        return table.select(by, F.lit(None).cast("double").alias("r2")).limit(0)
    said = parts[0]
    for p in parts[1:]:
        said = said.unionByName(p)
    return r2_table(said, by)


def r2_table(said: DataFrame, by: str) -> DataFrame:
    """(by, r2) of rows (by, y, said); null for fewer than four rows or a constant ``y``."""
    e = F.col("y") - F.col("said")
    return said.groupBy(by).agg(F.when(F.count(F.lit(1)) > 3, 1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


def ridge_cv_sums(rows: DataFrame, by: list[str], x: str, y: str, a: str, b: str, alpha: float, folds: int = 5) -> DataFrame:
    """(by, r2) of two-predictor ridge with a fixed penalty, without each contiguous block in turn, from sums by block.

    For series of any length: a block's rows are never brought together.
    """
    folded = rows.select(*by, x, *[F.col(c).cast("double").alias(n) for c, n in ((y, "_y"), (a, "_a"), (b, "_b"))]).dropna().withColumn("fold", windows.contiguous_folds(by, x, folds))
    pairs = {"n": F.lit(1.0), "y": F.col("_y"), "a": F.col("_a"), "b": F.col("_b")} | {p: F.col(f"_{p[0]}") * F.col(f"_{p[1]}") for p in ("aa", "ab", "bb", "ay", "by", "yy")}
    parts = folded.groupBy(*by, "fold").agg(*[F.sum(c).alias(f"s_{n}") for n, c in pairs.items()])
    whole = parts.groupBy(*by).agg(*[F.sum(f"s_{n}").alias(f"w_{n}") for n in pairs])
    both = parts.join(whole, by)
    t = {n: F.col(f"w_{n}") - F.col(f"s_{n}") for n in pairs}
    inner = lambda p: t[p] - t[p[0]] * t[p[1]] / t["n"]
    aa, bb, ab, ay, by_ = inner("aa") + alpha, inner("bb") + alpha, inner("ab"), inner("ay"), inner("by")
    det = aa * bb - ab * ab
    ca, cb = F.try_divide(ay * bb - by_ * ab, det), F.try_divide(by_ * aa - ay * ab, det)
    both = both.withColumn("_ca", ca).withColumn("_cb", cb).withColumn("_c0", (t["y"] - F.col("_ca") * t["a"] - F.col("_cb") * t["b"]) / t["n"])
    s = {n: F.col(f"s_{n}") for n in pairs}
    c0, ca, cb = F.col("_c0"), F.col("_ca"), F.col("_cb")
    error = s["yy"] + c0 * c0 * s["n"] + ca * ca * s["aa"] + cb * cb * s["bb"] - 2 * c0 * s["y"] - 2 * ca * s["ay"] - 2 * cb * s["by"] + 2 * c0 * ca * s["a"] + 2 * c0 * cb * s["b"] + 2 * ca * cb * s["ab"]
    out = both.groupBy(*by).agg(F.sum(error).alias("_e"), F.max(F.col("w_yy") - F.col("w_y") * F.col("w_y") / F.col("w_n")).alias("_v"))
    return out.select(*by, (1 - F.try_divide(F.col("_e"), F.col("_v"))).alias("r2"))


def attribution_rows(series: DataFrame, pcs: DataFrame, by: str, year: str, value: str, trend_of: dict[str, str], factory: Callable | None = None) -> DataFrame:
    """One row a group and mode: ridge coefficient, importance, R2 by blocks of ridge and forest, top mode, trends.

    series: (by, year, value, columns of ``trend_of``); pcs: (mode, time, pc).
    trend_of: {column: name}: trends in per cent of the mean a decade and their
    p, corrected for autocorrelation.  Years are those that both have.
    """
    wide = pcs.groupBy(F.col("time").alias("_year")).pivot("mode").agg(F.first("pc"))
    names = [c for c in wide.columns if c != "_year"]
    wide = wide.select("_year", *[F.col(c).alias(f"pc{c}") for c in names])
    predictors = [f"pc{c}" for c in names]
    both = materialize(series.join(F.broadcast(wide), F.col(year) == F.col("_year")).drop("_year"), "series-and-modes")
    ridge = ridge_table(both, [by], year, value, predictors, np.logspace(-2, 3, 20))
    top = ridge.groupBy(by).agg(F.max_by("term", "importance").alias("top_mode"))
    out = ridge.join(top, by)
    if factory is not None:
        out = out.join(block_cv(both, by, year, value, predictors, factory).withColumnRenamed("r2", "r2_forest"), by, "left")
    for column, name in trend_of.items():
        t = trends.trend_table(series, [by], year, column).join(series.groupBy(by).agg(F.avg(column).alias("_mean")), by)
        out = out.join(t.select(by, (1000 * F.try_divide(F.col("slope"), F.col("_mean"))).alias(f"{name}_trend"), F.col("p").alias(f"{name}_p"), F.col("p_plain").alias(f"{name}_p_plain"), F.col("n_eff_ratio").alias(f"{name}_n_eff_ratio")), by, "left")
    return out
