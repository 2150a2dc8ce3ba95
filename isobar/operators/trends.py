"""Trends, regression and linear algebra.

A series of one group has one number a year, so that a group is small whatever
the number of groups; those kernels run as grouped pandas functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.special import normal_sf2, student_sf2


def theil_sen(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Median of the pairwise slopes, and median(y) - slope * median(x)."""
    a = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = rows.select(*by, F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    pairs = a.join(b, by).where("_x < _x2").groupBy(*by).agg(F.median((F.col("_y2") - F.col("_y")) / (F.col("_x2") - F.col("_x"))).alias("slope"))
    middle = rows.groupBy(*by).agg(F.median(x).alias("_mx"), F.median(y).alias("_my"))
    return pairs.join(middle, by).select(*by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def mann_kendall(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """S, its variance with ties, tau and z."""
    a = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = rows.select(*by, F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    s = a.join(b, by).where("_x < _x2").groupBy(*by).agg(F.sum(F.signum(F.col("_y2") - F.col("_y"))).alias("s"))
    ties = rows.groupBy(*by, y).agg(F.count(F.lit(1)).cast("double").alias("_t"))
    ties = ties.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_t") * (F.col("_t") - 1) * (2 * F.col("_t") + 5)).alias("_c"))
    n = F.col("n")
    out = s.join(ties, by).withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("_c")) / 18.0)
    z = F.when(F.col("var_s") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var_s")).otherwise(0.0)
    return out.select(*by, "n", "s", "var_s", F.try_divide(F.col("s"), n * (n - 1) / 2).alias("tau"), z.alias("z"))


# --- kernels ------------------------------------------------------------------


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(1, len(x) + 1)
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    sums = np.bincount(inverse, weights=out)
    return (sums / counts)[inverse]


def modified_mann_kendall(y: np.ndarray) -> dict:
    """Mann-Kendall with the variance corrected for autocorrelation (Hamed and Rao, 1998).

    Ranks of the series without its Theil-Sen line give the autocorrelations;
    those within 1.96 / sqrt(n) of zero don't count.  n_eff_ratio is the factor
    of the variance.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 4:
        return {"slope": math.nan, "intercept": math.nan, "tau": math.nan, "z": math.nan, "p": math.nan, "p_plain": math.nan, "n_eff_ratio": math.nan}
    t = np.arange(n)
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(y[j] - y[i]).sum())
    counts = np.unique(y, return_counts=True)[1].astype(float)
    var = (n * (n - 1) * (2 * n + 5) - (counts * (counts - 1) * (2 * counts + 5)).sum()) / 18.0
    slope = float(np.median((y[j] - y[i]) / (j - i)))
    intercept = float(np.median(y) - slope * np.median(t))
    ranks = _ranks(y - slope * t)
    ranks = ranks - ranks.mean()
    power = float((ranks * ranks).sum())
    correction = 1.0
    if power > 0:
        lags = np.arange(1, n)
        rho = np.array([(ranks[k:] * ranks[: n - k]).sum() / power for k in lags])
        kept = np.abs(rho) > 1.96 / math.sqrt(n)
        correction += 2.0 / (n * (n - 1) * (n - 2)) * float(((n - lags) * (n - lags - 1) * (n - lags - 2) * rho)[kept].sum())
    correction = max(correction, 1e-6)
    z = lambda v: (s - np.sign(s)) / math.sqrt(v) if v > 0 else 0.0
    return {"slope": slope, "intercept": intercept, "tau": s / (n * (n - 1) / 2), "z": float(z(var * correction)), "p": normal_sf2(z(var * correction)), "p_plain": normal_sf2(z(var)), "n_eff_ratio": correction}


def kendall_p(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Kendall's tau-b and the two-sided p of its normal approximation."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    dx, dy = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
    s, total = float((dx * dy).sum()), n * (n - 1) / 2
    scale = math.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    v0 = n * (n - 1) * (2 * n + 5)
    vx, vy = ((t * (t - 1) * (2 * t + 5)).sum() for t in (tx, ty))
    var = (v0 - vx - vy) / 18.0 + (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2.0 * n * (n - 1))
    if n > 2:
        var += (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9.0 * n * (n - 1) * (n - 2))
    return (s / scale if scale else math.nan), (normal_sf2(s / math.sqrt(var)) if var > 0 and total else math.nan)


def ols(y: np.ndarray, x: np.ndarray, years: np.ndarray, detrend: bool = True, ddof: int = 1) -> dict:
    """Standardised predictors, and standard errors for the residuals' lag-1 autocorrelation.

    The effective number of years is n (1 - r) / (1 + r), two more than the
    coefficients at least and n at most; the
    residual variance is over that number less the coefficients, and the
    covariance is widened by n / n_eff once more.
    """
    y, x, years = np.asarray(y, float), np.atleast_2d(np.asarray(x, float).T).T, np.asarray(years, float)
    n = len(y)
    if detrend:
        line = lambda v: v - np.polyval(np.polyfit(years, v, 1), years)
        x = np.stack([line(c) for c in x.T], axis=1)
    sd = x.std(axis=0, ddof=ddof)
    x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    a = np.column_stack([np.ones(n), (years - years.mean()), x]) if detrend else np.column_stack([np.ones(n), x])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    resid = y - a @ beta
    r = float(np.corrcoef(resid[:-1], resid[1:])[0, 1]) if n > 3 and resid.std() > 0 else 0.0
    r = r if not math.isnan(r) else 0.0
    n_eff = float(np.clip(n * (1 - r) / max(1 + r, 1e-12), a.shape[1] + 2, max(n, a.shape[1] + 2)))
    s2 = float(resid @ resid) / (n_eff - a.shape[1])
    cov = s2 * np.linalg.pinv(a.T @ a) * (n / n_eff)
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    skip = a.shape[1] - x.shape[1]
    t = np.divide(beta, se, out=np.full_like(beta, np.inf), where=se > 0)
    p = [student_sf2(v, n_eff - a.shape[1]) if math.isfinite(v) else 0.0 for v in t]
    r2 = 1 - float(resid.var()) / float(y.var()) if y.var() > 0 else math.nan
    return {"coef": beta[skip:].tolist(), "se": se[skip:].tolist(), "p": p[skip:], "r2": r2, "n_eff": n_eff, "resid": resid}


def ridge(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge with the alpha of the least leave-one-out error; coefficients with the intercept last."""
    xm, ym = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - xm, full_matrices=False)
    best, found = math.inf, (np.zeros(x.shape[1]), float(alphas[0]))
    for a in alphas:
        d = s / (s * s + a)
        hat = ((u * (s * d)) * u).sum(axis=1) + 1.0 / len(y)
        coef = vt.T @ (d * (u.T @ (y - ym)))
        resid = (y - ym - (x - xm) @ coef) / (1 - hat)
        if (e := float((resid**2).mean())) < best:
            best, found = e, (coef, float(a))
    coef, a = found
    return np.append(coef, ym - xm @ coef), a


def permutation_importance(x: np.ndarray, y: np.ndarray, predict, reps: int = 20, seed: int = 0) -> np.ndarray:
    """Mean loss of R2 when a column is shuffled."""
    rng = np.random.default_rng(seed)
    r2 = lambda v: 1 - ((y - predict(v)) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-300)
    base, out = r2(x), np.zeros(x.shape[1])
    for c in range(x.shape[1]):
        for _ in range(reps):
            other = x.copy()
            other[:, c] = rng.permutation(other[:, c])
            out[c] += (base - r2(other)) / reps
    return out


# --- grouped forms ------------------------------------------------------------


def _key_schema(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)


def trend_table(rows: DataFrame, by: list[str], x: str, y: str, per: float = 1.0) -> DataFrame:
    """Modified Mann-Kendall of each group, one row each; slopes over ``per`` steps."""

    def run(key, part):
        part = part.sort_values(x)
        found = modified_mann_kendall(part[y].to_numpy(float))
        found["slope"] *= per
        return pd.DataFrame([{**dict(zip(by, key, strict=True)), "n": len(part), **found}])

    schema = f"{_key_schema(rows, by)}, n int, slope double, intercept double, tau double, z double, p double, p_plain double, n_eff_ratio double"
    return rows.groupBy(*by).applyInPandas(run, schema)


def regression_table(rows: DataFrame, by: list[str], x: str, y: str, predictors: list[str], detrend: bool = True, ddof: int = 1) -> DataFrame:
    """(by, label, coef, se, p, r2, n_eff): one row for each predictor."""

    def run(key, part):
        part = part.sort_values(x)
        found = ols(part[y], part[predictors].to_numpy(float), part[x], detrend, ddof)
        return pd.DataFrame([{**dict(zip(by, key, strict=True)), "label": name, "coef": found["coef"][i], "se": found["se"][i], "p": found["p"][i], "r2": found["r2"], "n_eff": found["n_eff"]} for i, name in enumerate(predictors)])

    return rows.groupBy(*by).applyInPandas(run, f"{_key_schema(rows, by)}, label string, coef double, se double, p double, r2 double, n_eff double")


def index_fit(y: np.ndarray, x: np.ndarray, years: np.ndarray, names: list[str], first: tuple[int, int], last: tuple[int, int]) -> list[dict]:
    """Rows (label, coef, se, p, corr, corr_p) for const, trend_per_decade and each index, with what holds for the whole fit.

    Indices lose their line and are standardised (sample deviation), so that the
    secular change belongs to the trend.  Standard errors use the effective
    number of years of the residuals' lag-one correlation.  r2_indices leaves
    the trend in the error; diff_index_removed is the change between the two
    windows without what the indices explain.
    """
    n = len(y)
    t = (years - years.mean()) / 10.0
    flat = [v - np.polyval(np.polyfit(t, v, 1), t) for v in x.T]
    a = np.column_stack([np.ones(n), t, *[v / sd if (sd := v.std(ddof=1)) > 0 else v for v in flat]])
    k = a.shape[1]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    resid = y - a @ beta
    r1 = float(np.corrcoef(resid[:-1], resid[1:])[0, 1]) if n > 3 and resid.std() > 0 else 0.0
    n_eff = float(np.clip(n * (1 - r1) / max(1 + r1, 1e-12), k + 2, max(n, k + 2)))
    se = np.sqrt(np.maximum(np.diag(float(resid @ resid) / (n_eff - k) * np.linalg.pinv(a.T @ a) * (n / n_eff)), 0.0))
    part = a[:, 2:] @ beta[2:]
    change = lambda v: float(v[(years >= last[0]) & (years <= last[1])].mean() - v[(years >= first[0]) & (years <= first[1])].mean())
    spread = float(y.var())
    r2 = lambda e: 1 - float(e.var()) / spread if spread > 0 else math.nan
    whole = {"r1_resid": r1, "n_eff": n_eff, "r2_full": r2(resid), "r2_indices": r2(y - part - beta[0]), "diff_raw": change(y), "diff_index_removed": change(y - part)}
    out = []
    for j, label in enumerate(["const", "trend_per_decade", *names]):
        corr = float(np.corrcoef(y, x[:, j - 2])[0, 1]) if j > 1 and spread > 0 and x[:, j - 2].std() > 0 else math.nan
        size = abs(corr) * math.sqrt((n - 2) / max(1 - corr * corr, 1e-300)) if n > 2 and not math.isnan(corr) else math.nan
        out.append({"label": label, "coef": float(beta[j]), "se": float(se[j]), "p": student_sf2(abs(float(beta[j] / se[j])), n_eff - k) if se[j] > 0 else 0.0, "corr": corr, "corr_p": student_sf2(size, n - 2), **whole})
    return out


def index_regression(rows: DataFrame, by: list[str], year: str, y: str, indices: list[str], first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """``index_fit`` of each group (a series of years); rows with a missing value are left out, groups of fewer than len(indices) + 4 years too."""
    columns = ["coef", "se", "p", "corr", "corr_p", "r1_resid", "n_eff", "r2_full", "r2_indices", "diff_raw", "diff_index_removed"]

    def run(key, part):
        part = part.dropna(subset=[y, *indices]).sort_values(year)
        if len(part) < len(indices) + 4:
            return pd.DataFrame(columns=[*by, "label", *columns])
        found = index_fit(part[y].to_numpy(float), part[indices].to_numpy(float), part[year].to_numpy(float), indices, first, last)
        return pd.DataFrame([{**dict(zip(by, key, strict=True)), **f} for f in found])

    return rows.select(*by, year, y, *indices).groupBy(*by).applyInPandas(run, f"{_key_schema(rows, by)}, label string, " + ", ".join(f"{c} double" for c in columns))


def percent_trend(rows: DataFrame, by: list[str], year: str, value: str, least: int = 2) -> DataFrame:
    """(by, trend): Theil-Sen slope in per cent of the mean a decade; null for fewer than ``least`` years or a mean of 0."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    mean = known.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return theil_sen(known, by, year, value).join(mean, by).select(*by, F.when(F.col("_n") >= least, F.try_divide(1000 * F.col("slope"), F.col("_mean"))).alias("trend"))


def fingerprint(seasonal: DataFrame, drivers: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """Three checks of what drives a trend in efficiency, one row a region.

    seasonal: by, pre, monsoon (trends of the two seasons); drivers: by, driver,
    trend, one driver being "eff"; places: by, local (whether a place lies in the
    inner box), trend (null where it has none).

    * pre_monsoon_dominant: the first season's trend is positive and above the second's,
    * igp_localised: the inner box's median trend is above that of all places,
    * thermodynamically_unforced: every other driver's trend is less than half of the efficiency's in size.

    A check that lacks a number is false.
    """
    medians = places.groupBy(*by).agg(F.median(F.when(F.col("local"), F.col("trend"))).alias("local_median"), F.median("trend").alias("regional_median"))
    eff = F.max(F.when(F.col("driver") == "eff", F.abs("trend")))
    weak = drivers.groupBy(*by).agg(eff.alias("_eff"), F.max(F.when(F.col("driver") != "eff", F.abs("trend"))).alias("_most"), F.count_if((F.col("driver") != "eff") & F.col("trend").isNull()).alias("_gaps"))
    out = medians.join(seasonal, by, "left").join(weak, by, "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        *by, "pre", "monsoon", "local_median", "regional_median",
        sure((F.col("pre") > F.col("monsoon")) & (F.col("pre") > 0)).alias("pre_monsoon_dominant"),
        sure(F.col("local_median") > F.col("regional_median")).alias("igp_localised"),
        sure((F.col("_most") < F.col("_eff") / 2) & (F.col("_gaps") == 0)).alias("thermodynamically_unforced"),
    )


def correlation_p(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, r, p) of Pearson's correlation, two-sided."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))
    sized = both.withColumn("_t", F.when((F.col("n") > 2) & (F.abs("r") < 1), F.abs("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))).withColumn("_df", F.col("n") - 2)
    return student_p(sized, "_t", "_df").select(*by, "n", "r", "p")


def welch(rows: DataFrame, by: list[str], window: str, value: str, first: str, second: str) -> DataFrame:
    """Welch's t between two windows, with Welch-Satterthwaite degrees of freedom."""
    at = lambda f, w: f(F.when(F.col(window) == w, F.col(value)))
    s = rows.groupBy(*by).agg(*[at(f, w).alias(f"{n}{i}") for i, w in ((0, first), (1, second)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    a, b = F.try_divide(F.col("v0"), F.col("n0")), F.try_divide(F.col("v1"), F.col("n1"))
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n0") - 1) + F.try_divide(b * b, F.col("n1") - 1))
    return s.select(*by, (F.col("m1") - F.col("m0")).alias("difference"), t.alias("t"), df.alias("df"))


def student_p(rows: DataFrame, t: str, df: str, name: str = "p") -> DataFrame:
    @F.pandas_udf("double")
    def two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([student_sf2(x, y) for x, y in zip(a, b, strict=True)], index=a.index)

    return rows.withColumn(name, two_sided(F.col(t).cast("double"), F.col(df).cast("double")))


def gram(rows: DataFrame, vector: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum of vectors and number of rows.

    Each partition gives one matrix; a tree of sums joins them, so that the
    driver gets one matrix of ``width`` squared.
    """

    def part(batches):
        total, sums, n = np.zeros((width, width)), np.zeros(width), 0
        for frame in batches:
            x = np.stack(frame[vector].to_numpy()).astype(float) if len(frame) else np.zeros((0, width))
            total += x.T @ x
            sums += x.sum(axis=0)
            n += len(x)
        full = np.concatenate([total.ravel(), sums, [n]])
        yield pd.DataFrame({"i": np.arange(len(full), dtype=np.int64), "x": full})

    found = rows.where(F.size(vector) == width).select(vector).mapInPandas(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    if found.empty:
        return np.zeros((width, width)), np.zeros(width), 0
    x = found.x.to_numpy()
    return x[: width * width].reshape(width, width), x[width * width : -1], int(x[-1])


def eof(rows: DataFrame, vector: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` principal patterns (rows) and their shares of variance."""
    total, sums, n = gram(rows, vector, width)
    cov = total / max(n, 1) - np.outer(sums, sums) / max(n, 1) ** 2
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    patterns = vectors[:, order[:k]].T
    # The sign is fixed: each pattern's largest element is positive.
    patterns *= np.sign(patterns[np.arange(len(patterns)), np.abs(patterns).argmax(axis=1)])[:, None]
    return patterns, np.maximum(values[order[:k]], 0) / max(values.clip(0).sum(), 1e-300)


def eof_table(spark: SparkSession, rows: DataFrame, vector: str, width: int, k: int) -> DataFrame:
    _, shares = eof(rows, vector, width, k)
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(shares)], "mode int, share double")


def kde(points: DataFrame, grid: DataFrame, x: str, factor: float, at: str = "at") -> DataFrame:
    """Gaussian density at each grid value, bandwidth ``factor`` times the sample deviation.

    The grid is a short parameter table; each point adds to each grid value in
    partial sums.
    """
    stats = F.broadcast(points.agg(F.count(x).alias("_n"), (F.stddev_samp(x) * factor).alias("_h")))
    both = points.select(F.col(x).alias("_x")).where("_x is not null").crossJoin(F.broadcast(grid.select(at))).crossJoin(stats)
    z = (F.col(at) - F.col("_x")) / F.col("_h")
    return both.groupBy(at).agg(F.sum(F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def contiguous_cv_r2(rows: DataFrame, by: list[str], x: str, y: str, k: int) -> DataFrame:
    """R2 of a line fitted without each contiguous fold in turn."""
    from isobar.operators.windows import contiguous_folds

    folded = rows.withColumn("fold", contiguous_folds(by, x, k))
    sums = lambda f: [F.sum(f).alias(n) for f, n in f]
    parts = folded.groupBy(*by, "fold").agg(*sums([(F.lit(1.0), "_n"), (F.col(x), "_x"), (F.col(y), "_y"), (F.col(x) * F.col(x), "_xx"), (F.col(x) * F.col(y), "_xy")]))
    w = Window.partitionBy(*by)
    rest = parts.select(*by, "fold", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("_n", "_x", "_y", "_xx", "_xy")])
    slope = F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    fits = rest.withColumn("_b", slope).withColumn("_a", (F.col("_y") - F.col("_b") * F.col("_x")) / F.col("_n")).select(*by, "fold", "_a", "_b")
    mean = F.avg(y).over(w)
    scored = folded.withColumn("_mean", mean).join(fits, [*by, "fold"]).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    return scored.groupBy(*by).agg((1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.sum((F.col(y) - F.col("_mean")) * (F.col(y) - F.col("_mean"))))).alias("r2"))
