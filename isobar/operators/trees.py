"""Tree ensembles as a table: stored, loaded by pattern, scored and explained.

A row of the table is one tree of one model:

* ``model``, ``seed``, ``fold``, ``alpha`` (null where the loss has no quantile), ``tree`` (its number, from 0),
* ``features`` (names in the order of the columns), ``rate``, ``start`` (the model's constant), ``centre`` (of each feature),
* by node ``feature`` (-1 in leaves), ``cut``, ``left``, ``right``, ``value``, ``cover`` (training rows) and ``coef``
  (``len(features)`` slopes a node, all zero where leaves are constant).

Rows with x <= cut go left; null and NaN go right.  A leaf gives ``value`` plus
its slopes times (x - centre), a missing x counting as its centre.  A model's
prediction is ``start + rate * sum of leaves``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SCHEMA = (
    "model string, seed int, fold int, alpha double, tree int, features array<string>, rate double, start double, centre array<double>, "
    "feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>, cover array<bigint>, coef array<double>"
)
#: Nodes that are sent to tasks at once; a larger forest is scored in several passes over each batch's rows.
MOST_NODES = 2_000_000
#: Places (rows times trees) that are walked at a time.
WALK_CELLS = 1 << 21

_KEYS = ["model", "seed", "fold", "alpha"]


# --- store --------------------------------------------------------------------


def save(trees: DataFrame, path: str) -> None:
    """Writes models by (model, seed, fold); models of those keys that are there already are replaced, others stay."""
    trees.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("model", "seed", "fold").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, model: str, seed: int = 42, folds: list[int] | None = None) -> DataFrame:
    """The trees of one model and seed; LookupError if there are none, or if a fold of ``folds`` is missing."""
    found = spark.read.schema(SCHEMA).parquet(path).where((F.col("model") == model) & (F.col("seed") == seed))
    if folds is not None:
        found = found.where(F.col("fold").isin(*folds))
    have = sorted(r.fold for r in found.select("fold").distinct().collect())
    if not have or folds is not None and set(folds) - set(have):
        raise LookupError(f"no trees of model {model}, seed {seed}" + (f", folds {sorted(set(folds) - set(have))}" if folds and have else "") + f" at {path}")
    return found


# --- forests in a task ----------------------------------------------------------


@dataclass
class Forest:
    """Trees of several models, their nodes end to end; leaves lead to themselves."""

    names: list[tuple]  # (fold, alpha) of each model
    features: list[str]
    start: np.ndarray
    of_model: np.ndarray  # of each tree
    rate: np.ndarray  # of each tree
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    coef: np.ndarray | None
    centre: np.ndarray  # of each tree's model (trees, features)
    depth: int

    @classmethod
    def of(cls, rows: list) -> Forest:
        rows = sorted(rows, key=lambda r: (r["fold"], r["alpha"] if r["alpha"] is not None else -1.0, r["tree"]))
        names = list(dict.fromkeys((r["fold"], r["alpha"]) for r in rows))
        features = list(rows[0]["features"])
        if any(list(r["features"]) != features for r in rows):
            raise ValueError("models of one forest must have the same features in the same order")
        sizes = np.array([len(r["feature"]) for r in rows])
        root = np.cumsum(sizes) - sizes
        flat = lambda c, kind: np.concatenate([np.asarray(r[c], kind) for r in rows])
        feature = flat("feature", np.int64)
        own, shift = np.arange(len(feature)), np.repeat(root, sizes)
        leaf = feature < 0
        left, right = (np.where(leaf, own, flat(c, np.int64) + shift) for c in ("left", "right"))
        depth, level = 0, root
        while (feature[level] >= 0).any():
            level, depth = np.unique(np.concatenate([left[level], right[level]])), depth + 1
        coef = flat("coef", float).reshape(len(feature), len(features))
        return cls(
            names, features, np.array([next(r["start"] for r in rows if (r["fold"], r["alpha"]) == n) for n in names]), np.array([names.index((r["fold"], r["alpha"])) for r in rows]), np.array([r["rate"] for r in rows]),
            root, feature, flat("cut", float), left, right, flat("value", float), flat("cover", np.int64), coef if coef.any() else None, np.array([r["centre"] for r in rows], float), depth,
        )

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree, walked level by level."""
        at = np.repeat(self.root[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at], self.left[at], self.right[at])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, models)."""
        out = np.repeat(self.start[None, :], len(x), axis=0)
        step = max(1, WALK_CELLS // max(1, len(self.root)))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            at = self.leaves(part)
            given = self.value[at]
            if self.coef is not None:
                for t in range(len(self.root)):
                    given[:, t] += (self.coef[at[:, t]] * np.nan_to_num(part - self.centre[t], nan=0.0)).sum(axis=1)
            given *= self.rate
            for m in range(len(self.names)):
                out[a : a + step, m] += given[:, self.of_model == m].sum(axis=1)
        return out


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns ``first`` to ``first + n`` as doubles, null as NaN."""
    return np.column_stack([batch.column(i).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(first, first + n)]) if n else np.empty((batch.num_rows, 0))


def _parts(trees: DataFrame) -> Iterator[Forest]:
    """Forests of at most ``MOST_NODES`` nodes (or one tree), read from the table one after the other."""
    held, nodes = [], 0
    for row in trees.orderBy("fold", "alpha", "tree").toLocalIterator():
        if held and nodes + len(row["feature"]) > MOST_NODES:
            yield Forest.of(held)
            held, nodes = [], 0
        held.append(row)
        nodes += len(row["feature"])
    if held:
        yield Forest.of(held)


def score(rows: DataFrame, trees: DataFrame, names: dict[tuple, str]) -> DataFrame:
    """``rows`` with a column of predictions for each (fold, alpha) of ``names``.

    The rows aren't shuffled.  A forest beyond ``MOST_NODES`` nodes adds up in
    several passes over the same partitions.
    """
    out = rows
    for i, forest in enumerate(_parts(trees)):
        have = [n for n in forest.names if n in names]
        shared = rows.sparkSession.sparkContext.broadcast((forest, [forest.names.index(n) for n in have]))
        before = out.columns
        again = [names[n] in before for n in have] if i else [False] * len(have)
        out = _scored(out, shared, forest.features, [names[n] for n in have], again)
    return out


def _scored(rows: DataFrame, shared, features: list[str], names: list[str], again: list[bool]) -> DataFrame:
    kept = rows.columns
    asked = rows.select(*kept, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    new = [n for n, more in zip(names, again, strict=True) if not more]
    schema = StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, take = shared.value
        for batch in batches:
            found = forest.predict(_matrix(batch, len(kept), len(features)))[:, take]
            columns = {c: batch.column(j) for j, c in enumerate(kept)}
            for j, (name, more) in enumerate(zip(names, again, strict=True)):
                # A later pass adds trees only: the constant is in already.
                own = found[:, j] + (columns[name].to_numpy(zero_copy_only=False) - forest.start[take[j]] if more else 0.0)
                columns[name] = pa.array(own)
            yield pa.RecordBatch.from_arrays([columns[c] for c in (*kept, *new)], [*kept, *new])

    return asked.mapInArrow(run, schema)


def fold_mean(names: list[str]) -> Column:
    """Mean over the folds' predictions."""
    return sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)


def score_fold_mean(rows: DataFrame, trees: DataFrame, names: dict[float | None, str]) -> DataFrame:
    """``rows`` with the mean over folds for each alpha of ``names`` (``{None: column}`` where there is none).

    LookupError if the table has no model of an alpha.
    """
    models = [(r.fold, r.alpha) for r in trees.select("fold", "alpha").distinct().orderBy("fold", "alpha").collect()]
    own = {(f, a): f"_m{i}" for i, (f, a) in enumerate(models) if a in names}
    for a in names:
        if not any(b == a for _, b in own):
            raise LookupError(f"no trees for alpha {a}")
    out = score(rows, trees, own)
    return out.select(*rows.columns, *[fold_mean([n for (_, b), n in own.items() if b == a]).alias(name) for a, name in names.items()])


# --- attribution ----------------------------------------------------------------


def path_attribution(forest: Forest, tree: int, x: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of one tree with path-dependent expectations, without rate.

    A leaf's share of a row is a product over the features on its path: 1 or 0
    where the feature is known (the row follows all of its cuts or not), the
    share of training rows where it isn't.  The Shapley value of feature i of
    such a product over d features needs, for each size of coalition, the sum of
    the others' products: the coefficients of the polynomial
    prod_j (share_j + known_j z), which is divided by i's own factor (Lundberg,
    Erion and Lee, 2018).  Rows go through a leaf together.
    """
    out = np.zeros((len(x), x.shape[1]))
    root = int(forest.root[tree])
    todo = [(root, {})]  # node, and by feature: share of rows, and the closed cuts as (node, goes left)
    while todo:
        node, path = todo.pop()
        f = int(forest.feature[node])
        if f >= 0:
            for child, goes_left in ((int(forest.left[node]), True), (int(forest.right[node]), False)):
                share, cuts = path.get(f, (1.0, ()))
                ratio = forest.cover[child] / forest.cover[node] if forest.cover[node] else 0.0
                todo.append((child, {**path, f: (share * ratio, (*cuts, (forest.cut[node], goes_left)))}))
            continue
        if not path:
            continue
        used = list(path)
        share = np.array([path[f][0] for f in used])
        known = np.ones((len(x), len(used)))
        for j, f in enumerate(used):
            for cut, goes_left in path[f][1]:
                known[:, j] *= (x[:, f] <= cut) == goes_left
        d = len(used)
        sizes = np.arange(d)
        weight = np.array([_factorial(s) * _factorial(d - s - 1) / _factorial(d) for s in sizes])
        for j, f in enumerate(used):
            others = [k for k in range(d) if k != j]
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1.0
            for n, k in enumerate(others, 1):
                poly[:, 1 : n + 1] = poly[:, 1 : n + 1] * share[k] + poly[:, :n] * known[:, k : k + 1]
                poly[:, 0] *= share[k]
            out[:, f] += forest.value[node] * (known[:, j] - share[j]) * (poly @ weight)
    return out


def _factorial(n: int) -> float:
    return float(np.prod(np.arange(1, n + 1, dtype=float)))


def expectation(forest: Forest, tree: int) -> float:
    """The tree's mean leaf over its training rows (constants only)."""
    total, todo = 0.0, [(int(forest.root[tree]), 1.0)]
    while todo:
        node, weight = todo.pop()
        if forest.feature[node] < 0:
            total += weight * forest.value[node]
            continue
        for child in (int(forest.left[node]), int(forest.right[node])):
            todo.append((child, weight * forest.cover[child] / forest.cover[node] if forest.cover[node] else 0.0))
    return total


def attribute(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(models, rows, features) and (models): attributions, and the prediction that they are counted from.

    Slopes of linear leaves are credited to their features as they stand.
    """
    out = np.zeros((len(forest.names), *x.shape))
    base = forest.start.astype(float).copy()
    at = forest.leaves(x) if forest.coef is not None else None
    for t, m in enumerate(forest.of_model):
        own = path_attribution(forest, t, x)
        if at is not None:
            own = own + forest.coef[at[:, t]] * np.nan_to_num(x - forest.centre[t], nan=0.0)
        out[m] += forest.rate[t] * own
        base[m] += forest.rate[t] * expectation(forest, t)
    return out, base


def attributions(rows: DataFrame, trees: DataFrame, keys: list[str], absolute: bool = True) -> DataFrame:
    """(keys, one column a feature): attributions of each row, as means over the folds of their sizes (or signed).

    Trees beyond ``MOST_NODES`` nodes are refused: attributions of parts of a
    model can't be made absolute one by one.
    """
    parts = list(_parts(trees))
    if len(parts) != 1:
        raise ValueError(f"attributions take 1 to {MOST_NODES} nodes")
    shared = rows.sparkSession.sparkContext.broadcast(parts[0])
    features = parts[0].features
    asked = rows.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    schema = StructType([*rows.select(*keys).schema.fields, *[StructField(c, DoubleType()) for c in features]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            found, _ = attribute(forest, _matrix(batch, len(keys), len(features)))
            mean = (np.abs(found) if absolute else found).mean(axis=0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], *[pa.array(mean[:, j]) for j in range(len(features))]], [*keys, *features])

    return asked.mapInArrow(run, schema)
