"""Product-rule decompositions between periods, year by year, and their bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import ratio

# --- two periods --------------------------------------------------------------


def window_means(series: DataFrame, windows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means of ``values`` in each window (window, y0, y1), a short table, closed at both ends."""
    both = series.join(F.broadcast(windows), F.col("year").between(F.col("y0"), F.col("y1")))
    return both.groupBy(*by, "window").agg(*[F.avg(v).alias(v) for v in values])


def pair(means: DataFrame, by: list[str], values: list[str], base: str, later: str) -> DataFrame:
    """One row a group with each value's mean in the base (``v0``) and in the later window (``v1``)."""
    at = lambda w, v: F.max(F.when(F.col("window") == w, F.col(v)))
    out = [x for v in values for x in (at(base, v).alias(f"{v}0"), at(later, v).alias(f"{v}1"))]
    return means.groupBy(*by).agg(*out)


def three_term(i: str = "ivt", w: str = "iwv") -> list[Column]:
    """Thermodynamic, dynamic and cross term of I = V W, V being the ratio of means; total."""
    v0, v1 = ratio(f"{i}0", f"{w}0"), ratio(f"{i}1", f"{w}1")
    dw, dv = F.col(f"{w}1") - F.col(f"{w}0"), v1 - v0
    return [(v0 * dw).alias("thermo"), (F.col(f"{w}0") * dv).alias("dynamic"), (dw * dv).alias("cross"), (F.col(f"{i}1") - F.col(f"{i}0")).alias("total")]


def two_term(i: str = "ivt", w: str = "iwv") -> list[Column]:
    """Moisture-only change and the rest."""
    thermo = F.col(f"{i}0") * (ratio(f"{w}1", f"{w}0") - 1)
    total = F.col(f"{i}1") - F.col(f"{i}0")
    return [thermo.alias("thermo"), (total - thermo).alias("dynamic"), total.alias("total")]


def moistening(means: DataFrame, per_kelvin: float = 7.0) -> DataFrame:
    """Adds the test of moistening against warming: columns iwv0, iwv1, ivt0, ivt1, t0, t1 in, per cent and kelvins out.

    rate is the change of moisture per kelvin (null without warming), expected
    what ``per_kelvin`` per cent a kelvin would give.
    """
    percent = lambda c: 100 * (ratio(f"{c}1", f"{c}0") - 1)
    warm = F.col("t1") - F.col("t0")
    return means.withColumn("moist_percent", percent("iwv")).withColumn("ivt_percent", percent("ivt")).withColumn("warming", warm).withColumn("rate", F.try_divide("moist_percent", "warming")).withColumn("expected", per_kelvin * F.col("warming"))


# --- level by level -----------------------------------------------------------


def level_terms(clim0: DataFrame, clim1: DataFrame, by: list[str]) -> DataFrame:
    """Moist, wind, covariance and transient terms, projected on the base transport.

    Both climatologies have ``by``, month, cell, p, q, u, v, qu, qv (means of the
    products), w (level weight) and aw (cell weight, summing to 1).  Sums over
    levels come first, then the projection on each month's and cell's base unit
    vector, then the area mean and the mean over months.  iwv0 and iwv1 are the
    column moisture of the two.
    """
    keys = [*by, "month", "cell", "p"]
    both = clim0.select(*keys, "w", "aw", *[F.col(c).alias(f"{c}0") for c in ("q", "u", "v", "qu", "qv")]).join(clim1.select(*keys, *[F.col(c).alias(f"{c}1") for c in ("q", "u", "v", "qu", "qv")]), keys)
    d = lambda c: F.col(f"{c}1") - F.col(f"{c}0")
    total = lambda x: F.sum(F.col("w") * x)
    parts = []
    for c in ("u", "v"):
        mean = F.col(f"q1") * F.col(f"{c}1") - F.col("q0") * F.col(f"{c}0")
        parts += [
            total(F.col(f"q{c}0")).alias(f"base_{c}"),
            total(F.col(f"q{c}1")).alias(f"later_{c}"),
            total(F.col(f"{c}0") * d("q")).alias(f"moist_{c}"),
            total(F.col("q0") * d(c)).alias(f"wind_{c}"),
            total(d("q") * d(c)).alias(f"cov_{c}"),
            total(d(f"q{c}") - mean).alias(f"trans_{c}"),
        ]
    parts += [total(F.col(f"q{i}")).alias(f"iwv{i}") for i in (0, 1)]
    cells = both.groupBy(*by, "month", "cell").agg(F.first("aw").alias("aw"), *parts)
    size = F.hypot("base_u", "base_v")
    cells = cells.withColumn("eu", F.coalesce(F.try_divide(F.col("base_u"), size), F.lit(0.0))).withColumn("ev", F.coalesce(F.try_divide(F.col("base_v"), size), F.lit(0.0)))
    on = lambda t: F.col("aw") * (F.col(f"{t}_u") * F.col("eu") + F.col(f"{t}_v") * F.col("ev"))
    months = cells.groupBy(*by, "month").agg(
        *[F.sum(on(t)).alias(t) for t in ("moist", "wind", "cov", "trans", "base", "later")],
        F.sum(F.col("aw") * (F.hypot("later_u", "later_v") - size)).alias("dmag"),
        *[F.sum(F.col("aw") * F.col(f"iwv{i}")).alias(f"iwv{i}") for i in (0, 1)],
    )
    out = months.groupBy(*by).agg(*[F.avg(t).alias(t) for t in ("moist", "wind", "cov", "trans", "base", "later", "dmag", "iwv0", "iwv1")])
    return out.withColumn("total", F.col("later") - F.col("base")).drop("later")


def mean_speed_terms(terms: DataFrame, by: list[str]) -> DataFrame:
    """The three-term split of the size of the transport by V = size over column moisture, from ``level_terms``."""
    sizes = terms.select(*by, F.col("base").alias("ivt0"), (F.col("base") + F.col("dmag")).alias("ivt1"), "iwv0", "iwv1")
    return sizes.select(*by, *three_term(), F.col("ivt0").alias("base"))


def yearly_terms(cells: DataFrame, by: list[str]) -> DataFrame:
    """Contributions of each year against the mean of all, closing exactly.

    cells: ``by``, year, month, cell, p, q, u, w, aw (one wind component).  With
    q = Q + q', u = U + u': q u - mean(q u) = U q' + Q u' + (q'u' - mean(q'u')).
    """
    w = Window.partitionBy(*by, "month", "cell", "p")
    a = cells.withColumn("_q", F.avg("q").over(w)).withColumn("_u", F.avg("u").over(w)).withColumn("_qu", F.avg(F.col("q") * F.col("u")).over(w))
    dq, du = F.col("q") - F.col("_q"), F.col("u") - F.col("_u")
    weight = F.col("w") * F.col("aw")
    months = a.groupBy(*by, "year", "month").agg(
        F.sum(weight * F.col("_u") * dq).alias("moist"),
        F.sum(weight * F.col("_q") * du).alias("wind"),
        F.sum(weight * (dq * du - (F.col("_qu") - F.col("_q") * F.col("_u")))).alias("cov"),
        F.sum(weight * (F.col("q") * F.col("u") - F.col("_qu"))).alias("total"),
    )
    return months.groupBy(*by, "year").agg(*[F.avg(t).alias(t) for t in ("moist", "wind", "cov", "total")])


def yearly_contributions(cells: DataFrame, by: list[str]) -> DataFrame:
    """Contributions of each year with both wind components and transients, projected on the mean transport.

    cells: ``by``, year, month, cell, p, q, u, v, qu, qv (the month's mean
    products), w, aw.  moist + wind + cov + trans = total holds row by row, so a
    row that is missing has no weight.  The unit vector is that of the mean
    column transport of the month and cell; base is its size, the same each year.
    """
    level, column, whole = Window.partitionBy(*by, "month", "cell", "p"), Window.partitionBy(*by, "month", "cell"), Window.partitionBy(*by)
    a = cells.withColumns({f"_{c}": F.avg(c).over(level) for c in ("q", "u", "v", "qu", "qv")} | {f"_s{c}": F.avg(F.col("q") * F.col(c)).over(level) for c in ("u", "v")} | {"_n": F.count(F.lit(1)).over(level)})
    a = a.withColumns({f"_b{c}": F.sum(F.col("w") * F.col(f"_q{c}") / F.col("_n")).over(column) for c in ("u", "v")} | {"_rows": F.count(F.lit(1)).over(column)})
    size = F.hypot("_bu", "_bv")
    dq = F.col("q") - F.col("_q")
    terms: dict[str, Column] = {}
    for c in ("u", "v"):
        mean, now, dw = F.col("_q") * F.col(f"_{c}"), F.col("q") * F.col(c), F.col(c) - F.col(f"_{c}")
        unit = F.coalesce(F.try_divide(F.col(f"_b{c}"), size), F.lit(0.0))
        parts = {
            "moist": F.col(f"_{c}") * dq,
            "wind": F.col("_q") * dw,
            "cov": dq * dw - (F.col(f"_s{c}") - mean),
            "trans": (F.col(f"q{c}") - now) - (F.col(f"_q{c}") - F.col(f"_s{c}")),
            "total": F.col(f"q{c}") - F.col(f"_q{c}"),
        }
        terms = {t: terms[t] + unit * x if t in terms else unit * x for t, x in parts.items()}
    weight = F.col("w") * F.col("aw")
    months = a.groupBy(*by, "year", "month").agg(*[F.sum(weight * x).alias(t) for t, x in terms.items()], F.sum(F.col("aw") * size / F.col("_rows")).alias("_part"))
    months = months.withColumn("base", F.sum("_part").over(whole) / F.size(F.collect_set("month").over(whole)))
    return months.groupBy(*by, "year").agg(*[F.avg(t).alias(t) for t in terms], F.first("base").alias("base"))


# --- parameter tables ---------------------------------------------------------


def sensitivity_pairs(spark: SparkSession, first: int, last: int, lengths=range(10, 41, 5), shifts=(0, 5, 10)) -> DataFrame:
    """(length, shift, a0, a1, b0, b1): an early and a late window; overlapping pairs left out."""
    sizes = spark.createDataFrame([(int(x),) for x in lengths], "length int")
    moves = spark.createDataFrame([(int(x),) for x in shifts], "shift int")
    both = sizes.crossJoin(F.broadcast(moves))
    a0 = F.lit(first) + F.col("shift")
    out = both.select("length", "shift", a0.alias("a0"), (a0 + F.col("length") - 1).alias("a1"), (F.lit(last + 1) - F.col("length")).alias("b0"), F.lit(last).alias("b1"))
    return out.where("a1 < b0")


def perturbed_boxes(regions: DataFrame, step: float = 5.0, scales: tuple[float, float] = (0.7, 1.4)) -> DataFrame:
    """15 boxes for each region: as it is, with edges moved, and scaled about its centre.

    By ``step`` down and up: each of the four edges alone, both meridians, both parallels.
    """
    edges = [(0, 0, 1, 0), (0, 0, 0, 1), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0)]
    moves = [(0, 0, 0, 0, 1.0), *[(*(k * e for e in m), 1.0) for k in (-1, 1) for m in edges], *[(0, 0, 0, 0, x) for x in scales]]
    table = regions.sparkSession.createDataFrame([(i, *map(float, m)) for i, m in enumerate(moves)], "variant int, d_lat0 double, d_lat1 double, d_lon0 double, d_lon1 double, scale double")
    both = regions.crossJoin(F.broadcast(table))

    def edge_of(c: str) -> Column:
        centre = (F.col(f"{c[:3]}0") + F.col(f"{c[:3]}1")) / 2.0
        return (centre + (F.col(c) - centre) * F.col("scale") + F.col(f"d_{c}") * step).alias(c)

    return both.select("region", "variant", *map(edge_of, ("lat0", "lat1", "lon0", "lon1")))


# --- bootstrap ----------------------------------------------------------------


def block_draws(n: int, reps: int, block: int, seed: int, circular: bool = False, windows: int = 1) -> np.ndarray:
    """Positions (reps, windows, n) of moving-block resamples.

    One generator for all; a replicate draws its windows one after the other.
    """
    rng = np.random.default_rng(seed)
    out = np.empty((reps, windows, n), np.int64)
    count = -(-n // block)
    for r in range(reps):
        for w in range(windows):
            starts = rng.integers(0, n if circular else max(n - block + 1, 1), count)
            at = (starts[:, None] + np.arange(block)[None, :]).ravel()[:n]
            out[r, w] = at % n if circular else np.minimum(at, n - 1)
    return out


def window_draws(sizes: list[int], reps: int, block: int, seed: int) -> list[np.ndarray]:
    """Positions (reps, n) of moving-block resamples for each window's own length n.

    One generator for all; a replicate draws its windows one after the other.
    """
    rng = np.random.default_rng(seed)
    out = [np.empty((reps, n), np.int64) for n in sizes]
    for r in range(reps):
        for w, n in enumerate(sizes):
            size = min(block, n)
            starts = rng.integers(0, n - size + 1, -(-n // size))
            out[w][r] = (starts[:, None] + np.arange(size)[None, :]).ravel()[:n]
    return out


def draw_counts(spark: SparkSession, draws: np.ndarray) -> DataFrame:
    """(rep, window, pos, times): how often each position is drawn; a parameter table."""
    rows = []
    for r, windows in enumerate(draws):
        for w, at in enumerate(windows):
            pos, times = np.unique(at, return_counts=True)
            rows += [(r, w, int(p), int(t)) for p, t in zip(pos, times, strict=True)]
    return spark.createDataFrame(rows, "rep int, window int, pos int, times int")


def bootstrap_means(rows: DataFrame, counts: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """Replicate means (``by``, rep): drawn positions by their number of draws.

    The sums are partial before the shuffle; no replicate's sample is laid out.
    """
    both = rows.join(F.broadcast(counts.select("rep", F.col("pos").alias("_pos"), "times")), F.col(pos) == F.col("_pos"))
    return both.groupBy(*by, "rep").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean"))


def interval(replicates: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval and two-sided sign p of replicates."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    out = replicates.groupBy(*by).agg(q.alias("_q"), two_sided_p(value).alias("p"))
    return out.select(*by, F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("ci_hi"), "p")


def two_sided_p(value: str, point: Column | None = None) -> Column:
    """Twice the share of replicates at zero or beyond it from ``point`` (their mean by default), 1 at most."""
    point = F.avg(value) if point is None else point
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    return F.least(F.lit(1.0), 2 * F.when(point >= 0, below).otherwise(above))


def level_bootstrap(cells: DataFrame, by: list[str], years: tuple[list[int], list[int]], draws: np.ndarray) -> DataFrame:
    """Replicates (``by``, rep, term, value) of moist and wind terms between two sets of years.

    cells: ``by``, year, month, cell, p, q, u, w, aw.  A group is one month's
    column of one cell over all years (years times levels numbers), all
    replicates are matrix products inside it, and the sums over cells are
    partial aggregates.
    """
    n0, n1 = len(years[0]), len(years[1])
    m0, m1 = (np.stack([np.bincount(at, minlength=n) for at in draws[:, w, :n]]) / n for w, n in ((0, n0), (1, n1)))
    held = cells.sparkSession.sparkContext.broadcast((list(years[0]), list(years[1]), m0, m1))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema) + ", rep int, term string, value double"

    def run(key, rows):
        import pandas as pd

        y0, y1, m0, m1 = held.value
        q, u = (rows.pivot_table(index="year", columns="p", values=c) for c in ("q", "u"))
        w = rows.groupby("p")["w"].first().reindex(q.columns).to_numpy()
        aw = float(rows["aw"].iloc[0])
        q0, q1, u0, u1 = (m @ x.reindex(y).fillna(0.0).to_numpy() for m, x, y in ((m0, q, y0), (m1, q, y1), (m0, u, y0), (m1, u, y1)))
        terms = {"moist": (u0 * (q1 - q0)) @ w, "wind": (q0 * (u1 - u0)) @ w, "cov": ((q1 - q0) * (u1 - u0)) @ w}
        out = pd.concat([pd.DataFrame({"rep": np.arange(len(x), dtype=np.int32), "term": t, "value": aw * x}) for t, x in terms.items()])
        for name, value in zip(by, key, strict=False):
            out[name] = value
        return out[[*by, "rep", "term", "value"]]

    parts = cells.groupBy(*by, "month", "cell").applyInPandas(run, schema)
    months = cells.select(*by, "month").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_months"))
    return parts.groupBy(*by, "rep", "term").agg(F.sum("value").alias("value")).join(months, by).withColumn("value", F.col("value") / F.col("_months")).drop("_months")


TERMS = ("moist", "wind", "cov", "trans", "total", "base", "dmag")
#: The moist term's part of the saturation pressure (relative humidity unchanged), and the rest.
MOIST_TERMS = ("moist_cc", "moist_rh")


def _saturation(kelvin: np.ndarray) -> np.ndarray:
    """Saturation vapour pressure in Pa after Bolton (1980)."""
    return 611.2 * np.exp(17.67 * (kelvin - 273.15) / (kelvin - 29.65))



def level_term_bootstrap(cells: DataFrame, by: list[str], years: tuple[list[int], list[int]], draws: list[np.ndarray], seasons: DataFrame | None = None) -> DataFrame:
    """Replicates (``by``, rep, term, value) of all of ``level_terms`` between two sets of years.

    cells: as for ``yearly_contributions``; draws: each window's own positions.
    Each replicate is projected on its own base direction.  A group is one
    month's column of one cell over all years, whose replicates are matrix
    products.  Years that are missing at a level are left out of its means, and
    a level without any drawn year in either window has no weight.  With a
    column t (temperature in K) the moist term is split too: moist_cc is what
    saturation pressure at both periods' mean temperatures makes of the base
    moisture, moist_rh the rest.
    """
    warm = "t" in cells.columns
    names = (*TERMS, *(MOIST_TERMS if warm else ()))
    held = cells.sparkSession.sparkContext.broadcast([(list(y), np.stack([np.bincount(at, minlength=len(y)) for at in d]).astype(float)) for y, d in zip(years, draws, strict=True)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema) + ", month int, rep int, " + ", ".join(f"{t} double" for t in names)

    def run(key, rows):
        import pandas as pd

        fields = ("q", "u", "v", "qu", "qv", *(["t"] if warm else []))
        # One row a year and level: each field is laid out as years by levels, NaN where there is none.
        levels, column = np.unique(rows["p"].to_numpy(), return_inverse=True)
        w = np.zeros(len(levels))
        w[column] = rows["w"].to_numpy()
        means, there = [], True
        for y, times in held.value:
            place = {year: i for i, year in enumerate(y)}
            line = np.array([place.get(year, -1) for year in rows["year"].tolist()])
            own = line >= 0
            at = {c: np.full((len(y), len(levels)), np.nan) for c in fields}
            for c, x in at.items():
                x[line[own], column[own]] = rows[c].to_numpy(float)[own]
            n = times @ (~np.isnan(at["q"])).astype(float)
            means.append({c: times @ np.nan_to_num(x) / np.maximum(n, 1) for c, x in at.items()})
            there = there & (n > 0)
        a, b = means
        weight = np.where(there, w, 0.0)
        total = lambda x: (weight * x).sum(axis=1)
        base, later = ([total(m[f"q{c}"]) for c in ("u", "v")] for m in (a, b))
        size = np.hypot(*base)
        unit = [x / np.where(size > 0, size, 1.0) for x in base]
        on = lambda f: sum(e * total(f(c)) for e, c in zip(unit, ("u", "v"), strict=True))
        moist = on(lambda c: a[c] * (b["q"] - a["q"]))
        split = {}
        if warm:
            rise = np.where(there, _saturation(np.where(there, b["t"], 273.15)) / _saturation(np.where(there, a["t"], 273.15)) - 1, 0.0)
            split["moist_cc"] = on(lambda c: a[c] * a["q"] * rise)
            split["moist_rh"] = moist - split["moist_cc"]
        out = pd.DataFrame({
            "moist": moist,
            "wind": on(lambda c: a["q"] * (b[c] - a[c])),
            "cov": on(lambda c: (b["q"] - a["q"]) * (b[c] - a[c])),
            "trans": on(lambda c: (b[f"q{c}"] - b["q"] * b[c]) - (a[f"q{c}"] - a["q"] * a[c])),
            "total": on(lambda c: b[f"q{c}"] - a[f"q{c}"]),
            "base": size,
            "dmag": np.hypot(*later) - size,
        } | split) * float(rows["aw"].iloc[0])
        out.insert(0, "rep", np.arange(len(out), dtype=np.int32))
        for name, value in zip((*by, "month"), key, strict=False):
            out[name] = value
        return out[[*by, "month", "rep", *names]]

    parts = cells.groupBy(*by, "month", "cell").applyInPandas(run, schema)
    months = cells.select(*by, "month").distinct()
    if seasons is not None:
        parts, months = (x.join(F.broadcast(seasons), "month") for x in (parts, months))
        by = [*by, *[c for c in seasons.columns if c != "month"]]
    months = months.groupBy(*by).agg(F.count(F.lit(1)).alias("_months"))
    sums = parts.groupBy(*by, "rep").agg(*[F.sum(t).alias(t) for t in names]).join(months, by)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), (F.col(t) / F.col("_months")).alias("value")) for t in names]))
    return sums.select(*by, "rep", each.alias("_x")).select(*by, "rep", "_x.term", "_x.value")


def window_summary(cells: DataFrame, by: list[str], years: tuple[list[int], list[int]], draws: list[np.ndarray], across: list[str], seasons: DataFrame | None = None) -> DataFrame:
    """(``by``, term, point, ci_lo, ci_hi, p, pfdr) of the level terms between two sets of years.

    cells, draws and seasons (whose names join ``by``): as for ``level_term_bootstrap``.  The point values are one
    more replicate, which draws each year once, so that the cells are read
    once.  p is two-sided against the point's sign; pfdr is adjusted over the
    groups that have ``across`` and the term in common.
    """
    from isobar.operators.windows import benjamini_hochberg

    every = [np.concatenate([np.arange(len(y))[None, :], d]) for y, d in zip(years, draws, strict=True)]
    found = level_term_bootstrap(cells, by, years, every, seasons)
    by = [*by, *[c for c in (seasons.columns if seasons is not None else []) if c != "month"]]
    marked = found.select(*by, "term", F.when(F.col("rep") == 0, F.col("value")).alias("_point"), F.when(F.col("rep") > 0, F.col("value")).alias("_drawn"))
    bounds = F.percentile("_drawn", F.array(F.lit(0.025), F.lit(0.975)))
    out = marked.groupBy(*by, "term").agg(F.max("_point").alias("point"), bounds.alias("_q"), two_sided_p("_drawn", F.max("_point")).alias("p"))
    return benjamini_hochberg(out.select(*by, "term", "point", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"), "p"), "p", [*across, "term"])


def speed_bootstrap(series: DataFrame, by: list[str], years: tuple[list[int], list[int]], draws: list[np.ndarray]) -> DataFrame:
    """(``by``, rep, thermo, dynamic, cross, total, base) of the three-term split; replicate 0 draws each year once.

    series: ``by``, year, ivt, iwv.  Draws are a parameter table; sums by group,
    window and replicate are partial before the shuffle.
    """
    rows = []
    for w, (y, d) in enumerate(zip(years, draws, strict=True)):
        for rep, at in enumerate([np.arange(len(y)), *d]):
            pos, times = np.unique(at, return_counts=True)
            rows += [(rep, w, int(y[p]), int(t)) for p, t in zip(pos, times, strict=True)]
    table = series.sparkSession.createDataFrame(rows, "rep int, window int, year int, times int")
    both = series.join(F.broadcast(table), "year")
    at = lambda c, w: F.try_divide(F.sum(F.when(F.col("window") == w, F.col(c) * F.col("times"))), F.sum(F.when((F.col("window") == w) & F.col(c).isNotNull(), F.col("times")))).alias(f"{c}{w}")
    means = both.groupBy(*by, "rep").agg(*[at(c, w) for c in ("ivt", "iwv") for w in (0, 1)])
    return means.select(*by, "rep", *three_term(), F.col("ivt0").alias("base"))


def pair_summary(replicates: DataFrame, by: list[str]) -> DataFrame:
    """Point values with 90 and 95 % intervals, and the dynamic term's one-sided p, adjusted over all groups.

    replicates: of ``speed_bootstrap``.  robust: adjusted p under 0.05; robust90: under 0.10.
    """
    from isobar.operators.windows import benjamini_hochberg

    terms = ("thermo", "dynamic", "cross", "total", "base")
    marked = replicates.select(*by, *[F.when(F.col("rep") == 0, F.col(t)).alias(f"_p_{t}") for t in terms], *[F.when(F.col("rep") > 0, F.col(t)).alias(f"_d_{t}") for t in terms])
    at = lambda t: F.max(f"_p_{t}")
    wide = lambda t: F.percentile(f"_d_{t}", F.array(*[F.lit(q) for q in (0.025, 0.05, 0.95, 0.975)])).alias(f"_q_{t}")
    beyond = F.when(at("dynamic") >= 0, F.avg((F.col("_d_dynamic") <= 0).cast("double"))).otherwise(F.avg((F.col("_d_dynamic") >= 0).cast("double")))
    out = marked.groupBy(*by).agg(*[at(t).alias(t) for t in terms], *[wide(t) for t in ("thermo", "dynamic", "cross")], beyond.alias("p"))
    bands = [F.col(f"_q_{t}")[i].alias(f"{t}_{n}") for t in ("thermo", "dynamic", "cross") for i, n in ((1, "lo90"), (2, "hi90"))]
    bands += [F.col("_q_dynamic")[i].alias(f"dynamic_{n}") for i, n in ((0, "lo95"), (3, "hi95"))]
    out = benjamini_hochberg(out.select(*by, *terms, (100 * ratio("total", "base")).alias("percent"), *bands, "p"), "p", [])
    return out.withColumn("robust", F.col("pfdr") < 0.05).withColumn("robust90", F.col("pfdr") < 0.10)
