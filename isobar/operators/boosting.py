"""Gradient boosting of the absolute and the quantile loss, over distributed rows.

Spark's own learners have neither loss, nor linear leaves, nor growth by the best
leaf.  Here several models (folds, quantiles) are grown at once, so that a pass
over the rows serves all of them, and every pass has the same small plan: Arrow
batches in, sums by (model, node, feature, bin) out.

* Rows of the same features and target are alike to every tree, so they are
  counted first: by model, how many it learns from and how many are held out.
  All sums are weighted by these counts.
* The counted rows are written once, ``BLOCK`` of them as the bytes of one row,
  so that a pass hands arrays to NumPy without a value at a time.
* What a model's prediction so far leaves of the target is written anew every
  ``STATE_TREES`` rounds; the trees since then are walked in NumPy.  So neither
  the plan nor the work of a pass grows with the number of rounds.
* A tree grows by its best leaf.  All leaves that could be next are split
  tentatively in one pass; what best-first order then doesn't reach is dropped.
  Where features have at most ``CELLS`` combinations of bins, the round's first
  pass counts these, and the tree grows on the counts.
  Gradients of these losses have two values, so a bin holds two counts and the
  choice of splits depends on the order of sums only where residuals are 0 but
  for their last bits.
* Leaves are fitted to residuals: least squares over the features of the path,
  from sums of products by leaf, then the loss's quantile of what is left, from
  a histogram of residuals and one refinement of the bin that holds it (a
  millionth of the range).
* The loss on held-out rows comes with the next round's first pass; a model
  stops after ``patience`` rounds without a better one and is cut back to its best.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.operators import trees as store
from isobar.session import delete, materialize, new_folder

#: Rounds between two writings of the residuals so far.
STATE_TREES = 4
#: Counted rows in a row of the table that passes read, and those that NumPy takes at a time.
BLOCK, SLICE = 64, 1 << 17
#: Combinations of bins that a tree may be grown on.
CELLS = 1 << 14
#: Bins of a residual histogram, and of the one that refines a bin of it.
RESIDUAL_BINS = 1024


@dataclass(frozen=True)
class Spec:
    """One model: its fold, its quantile (0.5: absolute error) and the rows that it learns from and is stopped by.

    Models that are given the same two columns (not equal ones) share their counts.
    named: the alpha to store (None for the absolute error).
    """

    fold: int
    alpha: float
    train: Column
    valid: Column | None = None
    named: float | None = None


@dataclass(frozen=True)
class Growth:
    """How trees grow.  bag: share of rows, drawn anew every ``bag_rounds``; feature_share: of the features, by tree."""

    rounds: int = 2000
    patience: int = 50
    leaves: int = 31
    rate: float = 0.05
    least: int = 30
    bins: int = 64
    linear: bool = True
    feature_share: float = 0.9
    bag: float = 0.9
    bag_rounds: int = 5
    seed: int = 42


@dataclass
class _Tree:
    """Arrays by node while it grows; leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])
    coef: dict[int, np.ndarray] = field(default_factory=dict)

    def split(self, node: int, feature: int, b: int) -> tuple[int, int]:
        at = len(self.feature)
        for name, value in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0), ("cover", 0)):
            getattr(self, name).extend([value, value])
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, b, at, at + 1
        return at, at + 1

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """Each row's leaf; bins by feature and row.  Nodes come after the node that they are split from, left before right."""
        at = np.zeros(bins.shape[1], np.int32)
        for node, f in enumerate(self.feature):
            if f >= 0:
                here = at == node
                at += here * np.int32(self.left[node] - node) + (here & (bins[f] > self.bin[node]))
        return at

    def output(self, leaf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """off: by feature and row, features minus their centres, 0 where missing."""
        out = np.array(self.value)[leaf]
        if self.coef:
            slopes = np.zeros((len(off), len(self.feature)))
            for node, b in self.coef.items():
                slopes[:, node] = b
            for f in np.flatnonzero(slopes.any(axis=1)):
                out += slopes[f][leaf] * off[f]
        return out

    def path(self, leaf: int) -> list[int]:
        """The features that lead to a leaf, ascending."""
        above = {c: n for n, f in enumerate(self.feature) if f >= 0 for c in (self.left[n], self.right[n])}
        out = set()
        while leaf in above:
            leaf = above[leaf]
            out.add(self.feature[leaf])
        return sorted(out)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes and a salt (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


# --- rows as bytes ----------------------------------------------------------------

_TABLE = "h binary, bins binary, off binary, learn binary, held binary, residual binary"


def _packed(rows: np.ndarray) -> pa.Array:
    """``BLOCK`` rows at a time as bytes."""
    rows = np.ascontiguousarray(rows)
    ends = np.append(np.arange(0, len(rows), BLOCK), len(rows)) * (rows.nbytes // len(rows))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """(rows, width) of all blocks: their bytes lie one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _roles(specs: list[Spec]) -> list[int]:
    """By model the number of its pair of ``train`` and ``valid``."""
    pairs = [(id(s.train), id(s.valid)) for s in specs]
    order = list(dict.fromkeys(pairs))
    return [order.index(p) for p in pairs]


def _blocks(counts: DataFrame, features: list[str], y: str, roles: list[int], cuts: list[np.ndarray], centre: np.ndarray, kinds: tuple[type, type]) -> DataFrame:
    """Counted rows in blocks: hashes, bins (x <= cuts[b] just where the bin is b or less), features minus centres (0 where missing), weights by role, residuals.

    kinds: of bins and of weights.
    """
    own = [roles.index(r) for r in range(max(roles) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(j).fill_null(np.nan).to_numpy(zero_copy_only=False) for j in range(len(cuts))]
            bins = np.column_stack([np.where(np.isnan(v), len(c), np.searchsorted(c, v, "left")) for v, c in zip(x, cuts, strict=True)]).astype(kinds[0])
            target, h = (batch.column(len(cuts) + j).to_numpy(zero_copy_only=False) for j in (0, 1))
            learn, held = (batch.column(len(cuts) + j).flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1)[:, own].astype(kinds[1]) for j in (2, 3))
            columns = [h, bins, np.nan_to_num(np.column_stack(x) - centre, nan=0.0), learn, held, np.repeat(target[:, None], len(roles), axis=1)]
            yield pa.RecordBatch.from_arrays([_packed(c) for c in columns], ["h", "bins", "off", "learn", "held", "residual"])

    asked = counts.select(*features, y, F.xxhash64(F.array(*features), F.col(y)).alias("_h"), "_learn", "_held")
    return asked.mapInArrow(run, _TABLE)


class _Sums:
    """Counts, sums and ranges by (m, node, a, b) of a task, folded whenever they get long."""

    _KINDS = (np.int64, np.int64, float, float, float)

    def __init__(self) -> None:
        self.pieces: list[list[np.ndarray]] = []
        self.length = 0

    @staticmethod
    def key(m, node, a, b) -> np.ndarray:
        """One number for 10 bits of models, 17 of nodes (-1 is one), 14 of a and 22 of b; ValueError if that doesn't hold them."""
        m, node, a, b = (np.asarray(v, np.int64) for v in (m, node, a, b))
        for v, bits in ((m, 10), (node + 1, 17), (a, 14), (b, 22)):
            if v.max(initial=0) >> bits:
                raise ValueError("more models, nodes, features or bins than a sum's key holds")
        return ((m << 17 | node + 1) << 14 | a) << 22 | b

    @staticmethod
    def parts(key: np.ndarray) -> tuple[np.ndarray, ...]:
        return key >> 53, (key >> 36 & (1 << 17) - 1) - 1, key >> 22 & (1 << 14) - 1, key & (1 << 22) - 1

    def add(self, m, node, a, b, n=0, k=0, s=0.0, lo=np.inf, hi=-np.inf) -> None:
        columns = np.broadcast_arrays(np.atleast_1d(self.key(m, node, a, b)), *[np.asarray(v, kind) for v, kind in zip((n, k, s, lo, hi), self._KINDS, strict=True)])
        self.pieces.append(columns)
        self.length += len(columns[0])
        if self.length > 1 << 20:
            self.fold()

    def fold(self) -> list[np.ndarray]:
        if not self.pieces:
            return [np.empty(0, k) for k in (np.int64, *self._KINDS)]
        columns = [np.concatenate(c) for c in zip(*self.pieces, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        key, n, k, s, lo, hi = (c[order] for c in columns)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        add = np.add.reduceat
        self.pieces = [[key[first], add(n, first), add(k, first), add(s, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)]]
        self.length = len(first)
        return self.pieces[0]


class _Learned:
    """The rows that models of one role learn from in this round, by feature and row."""

    def __init__(self, bins: np.ndarray, off: np.ndarray | None, weight: np.ndarray) -> None:
        self.mine = np.flatnonzero(weight)
        self.bins, self.weight, self._off = bins[:, self.mine], weight[self.mine].astype(float), off

    @cached_property
    def off(self) -> np.ndarray | None:
        return None if self._off is None else self._off[:, self.mine]


@dataclass
class _Batch:
    """What a pass sees of some rows for one model: those that it learns from, with their residuals, and those held out (where they are read)."""

    m: int
    alpha: float
    learned: _Learned
    residual: np.ndarray
    held: np.ndarray  # residuals of rows held out
    held_weight: np.ndarray

    @property
    def bins(self) -> np.ndarray:
        return self.learned.bins

    @property
    def off(self) -> np.ndarray | None:
        return self.learned.off

    @property
    def weight(self) -> np.ndarray:
        """How many rows each stands for."""
        return self.learned.weight


def _reads(*columns: str):
    """Marks a task that reads these columns besides those that every pass reads."""

    def mark(task):
        task.reads = columns
        return task

    return mark


class _Rows:
    """Passes over the rows of all models."""

    def __init__(self, table: DataFrame, cuts: list[np.ndarray], specs: list[Spec], growth: Growth, kinds: tuple[type, type]) -> None:
        self.cuts, self.growth, self.roles, self.kinds = cuts, growth, _roles(specs), kinds
        self.alphas = [s.alpha for s in specs]
        self.recent: list[list[_Tree]] = [[] for _ in specs]  # not yet in the table's residuals
        self.round = 0
        self.path: str | None = None
        self._write(table)

    def _write(self, table: DataFrame) -> None:
        spark, before = table.sparkSession, self.path
        self.path = new_folder(spark, "boosting-rows")
        table.write.parquet(self.path)
        self.table = spark.read.schema(_TABLE).parquet(self.path)
        if before:
            delete(spark, before)

    def _each(self, live: list[int]):
        growth, recent, alphas, at, roles = self.growth, self.recent, self.alphas, self.round, self.roles
        shapes = {"h": (np.int64, 1), "bins": (self.kinds[0], len(self.cuts)), "off": (float, len(self.cuts)), "residual": (float, len(alphas))} | dict.fromkeys(("learn", "held"), (self.kinds[1], max(roles) + 1))

        def prepared(batch: pa.RecordBatch) -> Iterator[_Batch]:
            read = {c: _unpacked(v, *shapes[c]) for c, v in zip(batch.schema.names, batch.columns, strict=True)}
            for a in range(0, len(read["h"]), SLICE):
                own = {c: v[a : a + SLICE] for c, v in read.items()}
                bins, off = (np.ascontiguousarray(own[c].T) if c in own else None for c in ("bins", "off"))
                bag = _mixed(np.ascontiguousarray(own["h"][:, 0]), growth.seed + at // growth.bag_rounds) < growth.bag
                learned = {r: _Learned(bins, off, own["learn"][:, r] * bag) for r in {roles[m] for m in live}}
                for m in live:
                    left = own["residual"][:, m]
                    if recent[m]:
                        left = left - growth.rate * sum(t.output(t.walk(bins), off) for t in recent[m])
                    held = own["held"][:, roles[m]] if "held" in own else np.zeros(0)
                    out = np.flatnonzero(held)
                    yield _Batch(m, alphas[m], learned[roles[m]], left[learned[roles[m]].mine], left[out], held[out].astype(float))

        return prepared

    def sums(self, live: list[int], task) -> dict[int, list]:
        """By model the rows (node, a, b, n, k, s, lo, hi) that ``task(batch, sums)`` adds up over all batches."""
        prepared = self._each(live)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Sums()
            for batch in batches:
                for part in prepared(batch):
                    task(part, held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.fold()], ["key", "n", "k", "s", "lo", "hi"])

        more = {*getattr(task, "reads", ()), *(["off"] if any(t.coef for m in live for t in self.recent[m]) else [])}
        found = self.table.select("h", "bins", "learn", "residual", *sorted(more)).mapInArrow(run, "key long, n long, k long, s double, lo double, hi double")
        found = found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        key, *values = (c.to_numpy() for c in found.toArrow().columns)  # as many rows as nodes, features and bins
        out: dict[int, list] = {m: [] for m in live}
        for m, *row in zip(*[c.tolist() for c in (*_Sums.parts(key), *values)], strict=True):
            out[m].append(tuple(row))
        return out

    def settle(self) -> None:
        """Writes the residuals so far; later passes walk later trees only."""
        width, recent, rate, kind = len(self.cuts), self.recent, self.growth.rate, self.kinds[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, off, residual = _unpacked(batch.column(1), kind, width), _unpacked(batch.column(2), float, width), _unpacked(batch.column(5), float, len(recent)).copy()
                for a in range(0, len(bins), SLICE):
                    part = slice(a, a + SLICE)
                    own_bins, own_off = np.ascontiguousarray(bins[part].T), np.ascontiguousarray(off[part].T)
                    for m, grown in enumerate(recent):
                        for t in grown:
                            residual[part, m] -= rate * t.output(t.walk(own_bins), own_off)
                own = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(_ends(batch.column(5))), pa.py_buffer(residual)])
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(5)), own], ["h", "bins", "off", "learn", "held", "residual"])

        self._write(self.table.mapInArrow(run, _TABLE))
        self.recent = [[] for _ in recent]


def _ends(column: pa.Array) -> np.ndarray:
    """Where a binary column's rows end, from 0."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return ends - ends[0]


# --- growth by the best leaf ------------------------------------------------------


class _Growing:
    """A tree with all tentative splits, and what best-first order takes of them."""

    def __init__(self, alpha: float, growth: Growth, features: list[int], cuts: list[np.ndarray]) -> None:
        self.tree, self.alpha, self.growth, self.features, self.cuts = _Tree(), alpha, growth, features, cuts
        self.best: dict[int, tuple[float, int, int]] = {}
        self.n: dict[int, int] = {}
        self.fresh, self.taken, self.done = [0], [], False

    def learn(self, rows: list) -> None:
        """Histograms of the fresh nodes; then the next nodes to split, or the end."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for node, f, b, n, k, *_ in rows:
            if node >= 0:
                held.setdefault((node, f), np.zeros((len(self.cuts[f]) + 1, 2), np.int64))[b] += (n, k)
        for (node, f), h in sorted(held.items()):
            self.n[node] = int(h[:, 0].sum())
            if len(h) < 2:
                continue
            left = np.cumsum(h, axis=0)[:-1]
            right = h.sum(axis=0) - left
            ok = (left[:, 0] >= self.growth.least) & (right[:, 0] >= self.growth.least)
            size = lambda c: (self.alpha * c[..., 1] - (1 - self.alpha) * (c[..., 0] - c[..., 1])) ** 2 / np.maximum(c[..., 0], 1)
            gain = np.where(ok, size(left) + size(right) - size(h.sum(axis=0)), -1.0)
            b = int(gain.argmax())
            if gain[b] > 1e-9 and gain[b] > self.best.get(node, (0.0,))[0]:
                self.best[node] = (float(gain[b]), f, b)
        self._order()

    def _order(self) -> None:
        heap, leaves, self.taken = [(-self.best[0][0], 0)] if 0 in self.best else [], 1, []
        while heap and leaves < self.growth.leaves:
            node = heap[0][1]
            if self.tree.feature[node] < 0:  # its children aren't known: split all that may come next
                self.fresh = []
                for _, n in heapq.nsmallest(self.growth.leaves - leaves, heap):
                    if self.tree.feature[n] < 0:
                        self.fresh += self.tree.split(n, *self.best[n][1:])
                return
            heapq.heappop(heap)
            self.taken.append(node)
            leaves += 1
            for child in (self.tree.left[node], self.tree.right[node]):
                if child in self.best:
                    heapq.heappush(heap, (-self.best[child][0], child))
        self.fresh, self.done = [], True

    def grown(self) -> _Tree:
        """The tree of the splits taken, numbered in their order."""
        out, at = _Tree(), {0: 0}
        for node in self.taken:
            left, right = out.split(at[node], *self.best[node][1:])
            at[self.tree.left[node]], at[self.tree.right[node]] = left, right
        for node, own in at.items():
            out.cover[own] = self.n.get(node, 0)
        return out


def _grow(rows: _Rows, live: list[int], growing: dict[int, _Growing], first: dict[int, list], cells: dict[int, tuple] | None = None) -> None:
    """cells: by model the counted combinations of bins (bins, rows, rows above 0); then no rows are read."""
    for m in live:
        growing[m].learn(first[m])
    while todo := [m for m in live if not growing[m].done]:
        fresh = {m: (growing[m].tree, np.array(growing[m].fresh), growing[m].features) for m in todo}
        if cells is not None:
            for m, (tree, asked, features) in fresh.items():
                growing[m].learn(_of_cells(cells[m], tree, asked, features))
            continue

        def task(part: _Batch, held: _Sums, fresh=fresh) -> None:
            tree, asked, features = fresh[part.m]
            _histogram(held, part.m, part.bins, part.weight, part.weight * (part.residual > 0), tree.walk(part.bins), asked, features)

        found = rows.sums(todo, task)
        for m in todo:
            growing[m].learn(found[m])


def _histogram(held: _Sums, m: int, bins: np.ndarray, weight: np.ndarray, up: np.ndarray, node: np.ndarray, asked: np.ndarray, features: list[int]) -> None:
    place = np.full(max(int(node.max(initial=0)), int(asked.max())) + 1, -1)
    place[asked] = np.arange(len(asked))
    place = place[node]
    mine = np.flatnonzero(place >= 0)
    if not len(mine):
        return
    place, weight, up = place[mine], weight[mine], up[mine]
    for f in features:
        own = bins[f][mine]
        width = int(own.max()) + 1
        cell = place * width + own
        n = np.bincount(cell, weight)
        some = np.flatnonzero(n)
        held.add(m, asked[some // width], f, some % width, n[some], np.bincount(cell, up)[some])


def _combined(held: _Sums, part: _Batch, features: list[int], shape: list[int]) -> None:
    """Counts by combination of the features' bins."""
    cell = np.zeros(len(part.weight), np.int64)
    for f, width in zip(features, shape, strict=True):
        cell = cell * width + part.bins[f]
    n = np.bincount(cell, part.weight)
    some = np.flatnonzero(n)
    held.add(part.m, 0, 0, some, n[some], np.bincount(cell, part.weight * (part.residual > 0))[some])


def _cells(rows: list, features: list[int], shape: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins by feature and cell, rows, rows above 0) of what ``_combined`` has counted."""
    found = np.array([(b, n, k) for node, _, b, n, k, *_ in rows if node >= 0], np.int64).reshape(-1, 3)
    bins = np.zeros((width, len(found)), np.int64)
    bins[features] = np.unravel_index(found[:, 0], shape)
    return bins, found[:, 1].astype(float), found[:, 2].astype(float)


def _of_cells(cells: tuple, tree: _Tree, asked: np.ndarray, features: list[int]) -> list:
    """Histograms of nodes, as a pass over the rows would give them."""
    bins, n, up = cells
    held = _Sums()
    _histogram(held, 0, bins, n, up, tree.walk(bins), asked, features)
    key, n, k, *_ = held.fold()
    return list(zip(*[c.tolist() for c in (*_Sums.parts(key)[1:], n, k)], strict=True))


# --- leaves -----------------------------------------------------------------------


def _fit_leaves(rows: _Rows, made: dict[int, _Tree], linear: bool) -> None:
    """Slopes and constants of the leaves of each model's tree, from the rows that it learns from."""
    live = list(made)
    # Each leaf's used features, padded to one length.
    paths = {m: {leaf: t.path(leaf) for leaf, f in enumerate(t.feature) if f < 0} for m, t in made.items()}

    @_reads("off")
    def stats(part: _Batch, held: _Sums) -> None:
        leaf = made[part.m].walk(part.bins)
        order = np.argsort(leaf, kind="stable")
        for at in np.unique(leaf).tolist():
            mine = order[np.searchsorted(leaf, at, "left", order) : np.searchsorted(leaf, at, "right", order)]
            r, weight = part.residual[mine], part.weight[mine]
            held.add(part.m, at, 0, 0, weight.sum(), lo=r.min(), hi=r.max())
            used = paths[part.m][at]
            if linear and used:
                z = np.vstack([np.ones(len(r)), part.off[used][:, mine], r])
                held.add(part.m, at, 1, np.arange(len(z) ** 2), s=((z * weight) @ z.T).ravel())
                held.add(part.m, at, 2, np.arange(len(used)), lo=z[1:-1].min(axis=1), hi=z[1:-1].max(axis=1))

    span: dict[tuple[int, int], list[float]] = {}
    for m, found in rows.sums(live, stats).items():
        by: dict[tuple[int, int], list] = {}
        for node, a, b, n, _, s, lo, hi in found:
            by.setdefault((node, a), []).append((b, n, s, lo, hi))
        for (node, a), held in by.items():
            if a == 0:
                _, n, _, lo, hi = held[0]
                made[m].cover[node] = n
                span[m, node] = [lo, hi]
        for (node, a), held in sorted(by.items()):
            if a != 1:
                continue
            used = paths[m][node]
            d = len(used) + 2
            z = np.array([s for _, _, s, _, _ in sorted(held)]).reshape(d, d)
            slopes = _slopes(z, made[m].cover[node])
            if slopes is None:
                continue
            made[m].coef[node] = np.zeros(len(rows.cuts))
            made[m].coef[node][used] = slopes
            reach = np.array([[b * lo, b * hi] for b, (_, _, _, lo, hi) in zip(slopes, sorted(by[node, 2]), strict=True)])
            span[m, node] = [span[m, node][0] - reach.max(axis=1).sum(), span[m, node][1] - reach.min(axis=1).sum()]
    _fit_constants(rows, made, span)


def _slopes(z: np.ndarray, n: int) -> np.ndarray | None:
    """Least squares of the last column on the others, from their products (ones first); None where they are degenerate."""
    if n < 2 * len(z):
        return None
    mean = z[0, 1:-1] / n
    inner = z[1:-1, 1:-1] - n * np.outer(mean, mean)
    right = z[1:-1, -1] - mean * z[0, -1]
    scale = np.sqrt(np.maximum(np.diag(inner), 0.0))
    if (scale <= 1e-9 * np.sqrt(np.maximum(np.diag(z)[1:-1], 1e-300))).any():
        return None
    shaped = inner / np.outer(scale, scale)
    if np.linalg.cond(shaped) > 1e8:
        return None
    return np.linalg.solve(shaped, right / scale) / scale


def _fit_constants(rows: _Rows, made: dict[int, _Tree], span: dict[tuple[int, int], list[float]]) -> None:
    """Each leaf's quantile of the residuals that its slopes leave: a histogram, then the bin that holds it."""
    for t in made.values():
        t.value = [0.0] * len(t.feature)
    lists = {m: np.array([[span.get((m, node), (0.0, 0.0))[i] for node in range(len(t.feature))] for i in (0, 1)]) for m, t in made.items()}
    rank = {(m, node): int(rows.alphas[m] * max(made[m].cover[node] - 1, 0)) for m, node in span}
    before = dict.fromkeys(span, 0)
    found_values: dict[int, list[float]] = {}
    for last in (False, True):

        @_reads("off")
        def task(part: _Batch, held: _Sums, last=last) -> None:
            t = made[part.m]
            leaf = t.walk(part.bins)
            r = part.residual - t.output(leaf, part.off)
            lo, hi = lists[part.m][:, leaf]
            place = np.where(hi > lo, (r - lo) / np.where(hi > lo, hi - lo, 1.0), 0.0) * RESIDUAL_BINS
            if last:  # only rows of the bin that holds the quantile
                mine = (place >= 0) & (place < RESIDUAL_BINS) | (hi <= lo)
            else:
                mine = np.ones(len(r), bool)
            cell = (leaf * RESIDUAL_BINS + np.clip(place, 0, RESIDUAL_BINS - 1).astype(np.int64))[mine]
            n = np.bincount(cell, part.weight[mine])
            some = np.flatnonzero(n)
            if len(some):
                held.add(part.m, some // RESIDUAL_BINS, 0, some % RESIDUAL_BINS, n[some], s=np.bincount(cell, (part.weight * r)[mine])[some])

        for m, found in rows.sums(list(made), task).items():
            by: dict[int, list] = {}
            for node, _, b, n, _, s, *_ in found:
                by.setdefault(node, []).append((b, n, s))
            for node, held in by.items():
                lo, hi = lists[m][:, node]
                width = (hi - lo) / RESIDUAL_BINS
                for b, n, s in sorted(held):
                    if before[m, node] + n > rank[m, node] or b == max(held)[0]:
                        (found_values[m] if last else made[m].value)[node] = s / n
                        lists[m][:, node] = (lo + b * width, lo + (b + 1) * width)
                        break
                    before[m, node] += n
        # The second pass measures from the slopes alone again.
        if not last:
            found_values = {m: t.value for m, t in made.items()}
            for t in made.values():
                t.value = [0.0] * len(t.feature)
    for m, t in made.items():
        t.value = found_values[m]


# --- models -----------------------------------------------------------------------


def counted(rows: DataFrame, features: list[str], y: str, specs: list[Spec]) -> DataFrame:
    """Distinct rows of features and target (NaN as null): ``_rows`` of them, and by model how many it learns from (``_learn``) and is stopped by (``_held``)."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    role = {r: F.when(F.coalesce(s.train, F.lit(False)), 1).when(F.coalesce(s.valid, F.lit(False)) if s.valid is not None else F.lit(False), 2).otherwise(0) for r, s in zip(_roles(specs), specs, strict=True)}
    own = rows.select(*[number(c).alias(c) for c in (*features, y)], *[c.alias(f"_role{r}") for r, c in role.items()])
    roles = _roles(specs)
    n = [F.count_if(F.col(f"_role{r}") == kind).alias(f"_{kind}_{r}") for kind in (1, 2) for r in range(max(roles) + 1)]
    found = own.groupBy(*features, y).agg(F.count(F.lit(1)).alias("_rows"), *n)
    return found.select(*features, y, "_rows", *[F.array(*[f"_{kind}_{r}" for r in roles]).alias(name) for kind, name in ((1, "_learn"), (2, "_held"))])


def _each_row(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Counted rows as often as they are; no list is longer than 65,536."""
    most = 1 << 16
    parts = counts.select(*columns, "_rows", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_rows") / most))).alias("_part"))
    return parts.select(*columns, F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("_rows") - (F.col("_part") - 1) * most)))).select(*columns)


def fit(rows: DataFrame, features: list[str], y: str, specs: list[Spec], growth: Growth = Growth(), model: str = "model") -> DataFrame:  # noqa: B008
    """The trees (as ``trees.SCHEMA``) of all models; rows whose target is null or NaN are left out."""
    return fit_counted(materialize(counted(rows, features, y, specs), "boosting-counts"), features, y, specs, growth, model)


def fit_counted(counts: DataFrame, features: list[str], y: str, specs: list[Spec], growth: Growth = Growth(), model: str = "model") -> DataFrame:  # noqa: B008
    """``fit`` over rows that ``counted`` has made of the same features, target and specs (read twice)."""
    spark = counts.sparkSession
    counts = counts.where(F.col(y).isNotNull())
    qs = [i / growth.bins for i in range(1, growth.bins)]
    seen = _each_row(counts, features).agg(*[F.percentile_approx(c, qs, 10000).alias(f"q{j}") for j, c in enumerate(features)], *[F.avg(c).alias(f"m{j}") for j, c in enumerate(features)]).first()
    cuts = [np.array(sorted(set(seen[f"q{j}"] or []))) for j in range(len(features))]
    centre = np.array([seen[f"m{j}"] or 0.0 for j in range(len(features))])
    most = counts.agg(F.max("_rows")).first()[0] or 0
    kinds = (np.uint8 if max(map(len, cuts)) < 1 << 8 else np.int32, np.int32 if most < 1 << 31 else np.int64)
    own = _Rows(_blocks(counts, features, y, _roles(specs), cuts, centre, kinds), cuts, specs, growth, kinds)

    # The start: the quantile of the target, as of a tree of one leaf.
    start = {m: _Tree() for m in range(len(specs))}
    own.growth = replace(growth, bag=1.1, rate=1.0)
    _fit_leaves(own, start, False)
    own.recent = [[start[m]] for m in range(len(specs))]
    own.settle()
    own.growth = growth

    kept: list[list[_Tree]] = [[] for _ in specs]
    least: list[tuple[float, int]] = [(np.inf, 0)] * len(specs)
    live = list(range(len(specs)))
    for at in range(growth.rounds + 1):
        own.round = at
        chosen = np.sort(np.random.default_rng((growth.seed, at)).permutation(len(features))[: max(1, round(growth.feature_share * len(features)))]).tolist()

        shape = [len(cuts[f]) + 1 for f in chosen]
        joint = math.prod(shape) <= CELLS

        @_reads("held")
        def task(part: _Batch, held: _Sums, chosen=chosen, shape=shape, joint=joint) -> None:
            if len(part.held):
                held.add(part.m, -1, 0, 0, part.held_weight.sum(), s=(part.held_weight * np.maximum(part.alpha * part.held, (part.alpha - 1) * part.held)).sum())
            if joint:
                _combined(held, part, chosen, shape)
            else:
                _histogram(held, part.m, part.bins, part.weight, part.weight * (part.residual > 0), np.zeros(len(part.weight), np.int64), np.array([0]), chosen)

        first = own.sums(live, task)
        for m in list(live):
            loss = next((s / n for node, _, _, n, _, s, *_ in first[m] if node == -1), None)
            if loss is not None and loss < least[m][0]:
                least[m] = (loss, at)
            if loss is None:
                least[m] = (np.inf, at)
            elif at - least[m][1] >= growth.patience:
                live.remove(m)
        if not live or at == growth.rounds:
            break
        growing = {m: _Growing(specs[m].alpha, growth, chosen, cuts) for m in live}
        cells = {m: _cells(first[m], chosen, shape, len(features)) for m in live} if joint else None
        if cells is not None:
            first = {m: _of_cells(cells[m], _Tree(), np.array([0]), chosen) for m in live}
        _grow(own, live, growing, first, cells)
        made = {m: g.grown() for m, g in growing.items()}
        for m in [m for m, t in made.items() if len(t.feature) == 1]:  # nothing left to split
            del made[m]
            live.remove(m)
        if not live:
            break
        _fit_leaves(own, made, growth.linear)
        for m, t in made.items():
            kept[m].append(t)
            own.recent[m].append(t)
        if max(map(len, own.recent)) >= STATE_TREES:
            own.settle()

    delete(spark, own.path)
    out = []
    for m, s in enumerate(specs):
        trees = kept[m][: least[m][1]] if s.valid is not None and np.isfinite(least[m][0]) else kept[m]
        head = (model, growth.seed, s.fold, s.named)
        tail = (features, growth.rate, float(start[m].value[0]), centre.tolist())
        # A model without trees is one leaf of 0.
        for i, t in enumerate(trees or [_Tree()]):
            cut = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin, strict=True)]
            coef = np.zeros((len(t.feature), len(features)))
            for node, slopes in t.coef.items():
                coef[node] = slopes
            out.append((*head, i, *tail, t.feature, cut, t.left, t.right, [float(v) for v in t.value], [int(n) for n in t.cover], coef.ravel().tolist()))
    return spark.createDataFrame(out, store.SCHEMA)
