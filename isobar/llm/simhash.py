"""SimHash near-dedup with BK-trees over shards of fingerprints.

A fingerprint bit is 1 if over half of a text's shingle hashes have it.  Only
distinct fingerprints are compared.  Each goes, for every way to choose
``blocks - RADIUS`` of its ``blocks`` bit blocks, to the shard named by the
chosen blocks' bits: fingerprints that differ in at most ``RADIUS`` bits agree
in that many blocks at least, so each link lies inside some shard.  The number
of blocks follows the number of fingerprints, so that shards stay small at any
size; every choice is lossless.

Inside a shard a BK-tree keys children by their integer Hamming distance to the
parent, and a lookup follows only edges within the radius of its own distance.
Lookups go down the tree together, as NumPy arrays.  A shard gives one edge for
each fingerprint, to the smallest of its connected part there, never all pairs.
A shard of more than ``LARGE`` fingerprints is dealt anew by finer blocks, and
those of it that are still large by ``FINEST``.

Edges are contracted to components in rounds (each node joins its neighbour of
the least hash, as in Bögeholz, Brand and Todor, 2019); a round leaves half of
the nodes at most on average, and each is written to the shared folder.

Trees go to tasks by shuffle: they hold the fingerprints of all documents, which
no broadcast is sure to bear.

Defined results: null and empty texts have fingerprint zero and are linked with
each other like any texts; one or two words are one shingle; a repeated row is
in its copies' component; the component id is the smallest doc_id of it, null
ids aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.text import batches, table, texts_of
from isobar.session import fresh_name, match, materialize

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints a shard has on average at most, and those from which it is dealt anew.
SHARD_KEYS, LARGE = 64, 20_000
#: Blocks of the last of the three ways of dealing shards.
FINEST = 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text's three-word shingles."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_digest
    found = [hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    n = len(found)
    bits = np.frombuffer(b"".join(found), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(bits[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_tag, fp) of every row; fp is the 64 bits as a signed number."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = np.array([fingerprint(t) for t in texts_of(batch, 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], ["doc_id", "text_tag", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, text_tag long, fp long")


# --- BK-trees -----------------------------------------------------------------


class _Parts:
    """Connected parts over positions 0..n-1."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            up = self.parent[found]
            if (up == found).all():
                break
            found = up
        self.parent[at] = found
        return found

    def join(self, at: np.ndarray) -> None:
        roots = np.unique(self.roots(at))
        self.parent[roots] = roots[0]


def bk_tree(fps: np.ndarray, members: np.ndarray) -> tuple[int, dict[int, tuple]]:
    """A node and its children by distance; the first member is the parent."""
    distance = np.bitwise_count(fps[members[1:]] ^ fps[members[0]])
    return int(members[0]), {int(d): bk_tree(fps, members[1:][distance == d]) for d in np.unique(distance)}


def _linked_few(fps: list[int], radius: int) -> list[int]:
    """``linked`` for a few fingerprints: each is looked up in the tree of those before it, then put in."""
    children: list[dict[int, int]] = [{} for _ in fps]
    root = list(range(len(fps)))
    for i in range(1, len(fps)):
        todo, place, end = [0], 0, None
        while todo:
            j = todo.pop()
            d = (fps[i] ^ fps[j]).bit_count()
            if d <= radius and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
            todo += [c for edge, c in children[j].items() if abs(edge - d) <= radius]
        while end != i:
            d = (fps[i] ^ fps[place]).bit_count()
            place = end = children[place].setdefault(d, i)
    return root


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of distinct ``fps`` the position of its connected part's first member."""
    n = len(fps)
    if n <= 16:
        return np.array(_linked_few(fps.tolist(), radius), np.int64)
    parts = _Parts(n)
    todo = [(bk_tree(fps, np.arange(n)), np.arange(n))]
    while todo:
        (node, children), asking = todo.pop()
        distance = np.bitwise_count(fps[asking] ^ fps[node]).astype(np.int16)
        near = asking[distance <= radius]
        if len(near):
            parts.join(np.append(near, node))
        for edge, child in children.items():
            ask = asking[np.abs(distance - edge) <= radius]
            if len(ask):
                todo.append((child, ask))
    return parts.roots(np.arange(n))


# --- shards -------------------------------------------------------------------


def blocks_for(n: int) -> int:
    """The fewest blocks (4 to 8) whose shards have ``SHARD_KEYS`` fingerprints on average."""
    for blocks in range(RADIUS + 1, 2 * RADIUS + 2):
        if n >> (64 * (blocks - RADIUS) // blocks) <= SHARD_KEYS:
            return blocks
    return 2 * RADIUS + 2


def _keys(blocks: int):
    """An array column with the shard keys of fp."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(masks[i] for i in group) for group in combinations(range(blocks), blocks - RADIUS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def _shards(fps: DataFrame, blocks: int) -> DataFrame:
    return fps.select("fp", F.inline(_keys(blocks)))


def _edges_in(shards: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint that a shard links to a smaller one."""
    dealt = shards.repartition("way", "bits").sortWithinPartitions("way", "bits", "fp").select("way", "bits", "fp")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def solve(way, bits, fps, last):
            """Edges of all shards that end here, and the rows of the one that may go on."""
            edge = np.flatnonzero((way[1:] != way[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts = np.concatenate(([0], edge, [len(fps)]))
            stop = len(starts) - 1 if last else len(starts) - 2
            a, b = [], []
            for i in np.flatnonzero(np.diff(starts[: stop + 1]) > 1).tolist():
                own = fps[starts[i] : starts[i + 1]]
                if len(own) == 2:
                    if (int(own[0]) ^ int(own[1])).bit_count() <= RADIUS:
                        a.append(own[1:])
                        b.append(own[:1])
                    continue
                root = linked(own)
                other = np.flatnonzero(root != np.arange(len(own)))
                a.append(own[other])
                b.append(own[root[other]])
            rest = starts[stop] if not last else len(fps)
            none = np.empty(0, np.uint64)
            return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64), (way[rest:], bits[rest:], fps[rest:])

        for batch in rows:
            if not batch.num_rows:
                continue
            own = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            own = (own[0], own[1], own[2].astype(np.int64).view(np.uint64))
            if left is not None:
                own = tuple(np.concatenate(pair) for pair in zip(left, own, strict=True))
            a, b, left = solve(*own, last=False)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if left is not None and len(left[0]):
            a, b, _ = solve(*left, last=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fps`` within ``RADIUS`` bits."""
    blocks, found = blocks_for(fps.count()), None
    while True:
        shards = _shards(fps, blocks)
        large = materialize(shards.groupBy("way", "bits").count().where(F.col("count") > LARGE).select("way", "bits"), "large-shards")
        # With ``FINEST`` blocks 52 bits of a shard are equal, so that it has 4,096 fingerprints at most.
        if blocks == FINEST or large.isEmpty():
            edges = _edges_in(shards)
            return (edges if found is None else found.unionByName(edges)).distinct()
        edges = _edges_in(shards.join(large, ["way", "bits"], "left_anti"))
        found = edges if found is None else found.unionByName(edges)
        fps = materialize(shards.join(large, ["way", "bits"], "left_semi").select("fp").distinct(), "large-fingerprints")
        blocks = 2 * RADIUS + 2 if blocks < 2 * RADIUS + 2 else FINEST


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the component of every node that an edge of ``edges`` (a, b) has."""
    steps, edges = [], materialize(edges.where("a != b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(c, F.lit(k)).alias("rank"), F.col(c).alias("node"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["node"].alias("up"))
        step = materialize(step, "step")
        steps.append(step)
        up = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: E731, B023
        edges = edges.join(up("a"), "a").join(up("b"), "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = steps[-1]
    for step in reversed(steps[:-1]):
        later = root.select(F.col("node").alias("up"), F.col("up").alias("later"))
        root = step.join(later, "up", "left").select("node", F.coalesce("later", "up").alias("up"))
    return root.select("node", F.col("up").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_tag, fp, component_id, representative.

    representative: the row has its component's smallest doc_id (and, among
    several texts of that doc_id, the smallest tag).
    """
    found = materialize(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_tag").alias("tag"))
    distinct = materialize(found.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    parts = materialize(components(links(distinct.select("fp"))), "components")
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = materialize(rooted.join(least, "root").select("fp", "least"), "named")
    return found.join(named, "fp").select("doc_id", "text_tag", "fp", F.col("least.id").alias("component_id"), order.eqNullSafe(F.col("least")).alias("representative"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The representatives' rows of ``docs``, with all their columns.

    Of rows that repeat a representative's doc_id and text one stays (any, where
    other columns differ).
    """
    rows = near_duplicates(docs).where("representative")
    kept = materialize(rows.groupBy("doc_id", "text_tag").agg(F.count(F.lit(1)).alias("n")), "kept")
    tag = fresh_name(docs, "text_tag")
    tagged = docs.withColumn(tag, F.xxhash64(F.col("text").cast("string")))
    on = [(F.col("doc_id").cast("long"), "doc_id"), (F.col(tag), "text_tag")]
    once = match(tagged, kept.where("n = 1"), on)
    more = match(tagged, kept.where("n > 1"), on).dropDuplicates(["doc_id", tag])
    return once.unionByName(more).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
