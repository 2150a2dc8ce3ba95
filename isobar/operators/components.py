"""Connected components on integer grids, in two and three dimensions.

Time is the axis that data are dealt along.  Inside a chunk of time a union-find
in NumPy labels the voxels that touch; pairs of voxels across the chunks'
borders give edges between those labels, and only labels take part in the
rounds that join them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.session import materialize

#: Offsets to half of the neighbours, from which all pairs follow.
NEAR_2D = [(0, 1), (1, -1), (1, 0), (1, 1)]
NEAR_3D = [(0, *d) for d in NEAR_2D] + [(1, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def label(points: np.ndarray, offsets: list[tuple]) -> np.ndarray:
    """For each integer point the position of its part's first point in raster order.

    ``points`` are distinct rows; two touch if their difference is an offset.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    low = points.min(axis=0) - 1
    size = points.max(axis=0) - low + 2
    code = np.ravel_multi_index(tuple((points - low).T), tuple(size))
    order = np.argsort(code)
    codes = code[order]
    a, b = [], []
    for d in offsets:
        step = np.ravel_multi_index(tuple(np.array(d) + 1), tuple(size)) - np.ravel_multi_index((1,) * len(d), tuple(size))
        at = np.minimum(np.searchsorted(codes, codes + step), n - 1)
        hit = np.flatnonzero(codes[at] == codes + step)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while True:
        # Both ends of each edge take the smaller root; then roots are followed to their ends.
        small = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], small)
        np.minimum.at(root, root[b], small)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def components_2d(cells: DataFrame, keys: list[str], y: str = "iy", x: str = "ix") -> DataFrame:
    """Adds ``part`` to each slice's distinct cells: 1, 2, ... in raster order of the parts' first cells."""
    schema = cells.select(*keys, y, x).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", part int"

    def run(rows):
        rows = rows.drop_duplicates([y, x]).sort_values([y, x]).reset_index(drop=True)
        root = label(rows[[y, x]].to_numpy(np.int64), NEAR_2D)
        rows["part"] = (np.unique(root, return_inverse=True)[1] + 1).astype(np.int32)
        return rows

    return cells.select(*keys, y, x).groupBy(*keys).applyInPandas(run, schema)


def _join_labels(edges: DataFrame) -> DataFrame:
    """(node, root) of an edge list (a, b): smallest node reachable, by rounds of pointer halving."""
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = materialize(nodes.withColumn("root", F.col("node")), "labels")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("up"))
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = materialize(step.join(jump, "up", "left").select("node", F.least("up", F.coalesce("top", "up")).alias("root")), "labels")
        if after.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            return after
        labels = after


def components_3d(voxels: DataFrame, keys: list[str], t: str = "it", y: str = "iy", x: str = "ix", chunk: int = 64) -> DataFrame:
    """Adds ``part`` (26 neighbours) to distinct voxels: the raster number of the part's first voxel.

    ``keys`` separate cubes.  The result has keys, t, y, x, part; parts are
    numbered 1, 2, ... within a cube by ``events`` below.
    """
    own = voxels.select(*keys, t, y, x).distinct()
    bounds = own.groupBy(*keys).agg(F.min(y).alias("_y0"), F.min(x).alias("_x0"), (F.max(y) - F.min(y) + 1).cast("long").alias("_ny"), (F.max(x) - F.min(x) + 1).cast("long").alias("_nx"))
    cross = own.join(F.broadcast(bounds), keys) if keys else own.crossJoin(F.broadcast(bounds))
    raster = (F.col(t).cast("long") * F.col("_ny") + (F.col(y) - F.col("_y0"))) * F.col("_nx") + (F.col(x) - F.col("_x0"))
    numbered = cross.withColumn("voxel", raster).withColumn("chunk", F.floor(F.col(t) / chunk).cast("long")).select(*keys, t, y, x, "voxel", "chunk")
    schema = numbered.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", local bigint"

    def run(rows):
        rows = rows.sort_values("voxel").reset_index(drop=True)
        rows["local"] = rows["voxel"].to_numpy()[label(rows[[t, y, x]].to_numpy(np.int64), NEAR_3D)]
        return rows

    labelled = materialize(numbered.groupBy(*keys, "chunk").applyInPandas(run, schema), "local-labels")
    last = labelled.where(F.pmod(F.col(t), F.lit(chunk)) == chunk - 1)
    first = labelled.where(F.pmod(F.col(t), F.lit(chunk)) == 0)
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    moved = last.withColumn("_d", steps).select(*keys, (F.col(t) + 1).cast("long").alias("_t"), (F.col(y) + F.col("_d.dy")).cast("long").alias("_y"), (F.col(x) + F.col("_d.dx")).cast("long").alias("_x"), F.col("local").alias("_a"))
    border = first.select(*keys, F.col(t).cast("long").alias("_t"), F.col(y).cast("long").alias("_y"), F.col(x).cast("long").alias("_x"), F.col("local").alias("_b"))
    name = lambda c: F.struct(*keys, F.col(c).alias("label"))
    edges = moved.join(border, [*keys, "_t", "_y", "_x"]).select(name("_a").alias("a"), name("_b").alias("b"))
    roots = _join_labels(edges)
    out = labelled.withColumn("node", name("local")).join(roots, "node", "left")
    return out.select(*keys, t, y, x, F.coalesce("root.label", "local").alias("part"))
