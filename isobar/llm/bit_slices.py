"""Exact top-k inner products over a bit-sliced index.

Components are quantised to floor(1024 * x).  The index holds blocks of rows;
in a block an attribute (a component) is a stack of bitmaps, the i-th with bit i
of every row's value above the block's least.  A query's scores are added up in
bitmaps: bit b of its component shifts the attribute's slices by b, a negative
component takes their complements, and carry-save adders reduce the bitmaps of
each weight to one.  The sum's slices are then walked from the most significant
downward: rows that are surely in, rows still level, and the rest.  Rows that are
level after the last slice have exactly equal scores; the smallest ids of them
fill the places left.

Queries and blocks meet by shuffle: a key is a block of queries and a run of
index blocks, and neither side is broadcast.  A task holds one block of queries
and one block of the index, and keeps k rows a query over its run.

Defined results: vectors that are null or hold a null, NaN or infinite component
take no part.  Vectors meet those of their own length only (two empty ones score
0).  Rows with the query's vec_id are its own; a null vec_id is a candidate, the
last among equal scores, and never a query.  Rows that repeat a vec_id are each
a candidate and, if queries, each have a ranking.  A quantised component of 2**62
or more, or a score beyond 64 bits, is an error.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm.text import table
from isobar.session import materialize

#: Steps of a unit that components are rounded down to.
SCALE = 1024
#: Rows of an index block, and components of one at most (long vectors have smaller blocks).
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 22
#: Queries of a query block, and index blocks that one task goes through with it.
QUERY_ROWS, RUN_BLOCKS = 128, 4
#: Partitions that pairs of query blocks and runs are dealt to at most.
MOST_PARTITIONS = 100_000


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, size, attributes): the vectors that take part, components rounded down; row is unique."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists("v", lambda x: F.abs(x) * SCALE >= float(1 << 62))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~odd)
    whole = F.when(large, F.raise_error(F.lit("a quantised component is beyond 62 bits")).cast("array<bigint>")).otherwise(F.transform("v", lambda x: F.floor(x * SCALE)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("size"), whole.alias("attributes"))


# --- a block of the index ---------------------------------------------------------


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans (rows, n) as 64-bit words (rows, words), the first in the lowest bit."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))).view(np.uint64)


@dataclass
class Block:
    """Rows in the order of their ids (null last), attributes as bitmaps."""

    ids: np.ndarray
    known: int  # rows whose id isn't null; they come first
    least: np.ndarray  # of each attribute
    widths: np.ndarray  # slices of each attribute
    slices: np.ndarray  # (sum of widths, words)

    def __post_init__(self) -> None:
        self.attribute = np.repeat(np.arange(len(self.widths)), self.widths)
        self.shift = np.arange(len(self.attribute)) - np.repeat(np.cumsum(self.widths) - self.widths, self.widths)
        self.both = np.concatenate([self.slices, ~self.slices])

    @classmethod
    def of(cls, ids: np.ndarray, null: np.ndarray, values: np.ndarray) -> Block:
        """ids, whether they are null, and values (rows, attributes) as int64."""
        order = np.lexsort((ids, null))
        ids, null, values = ids[order], null[order], values[order]
        least = values.min(axis=0) if values.size else np.zeros(values.shape[1], np.int64)
        above = values.astype(np.uint64) - least.astype(np.uint64)
        most = above.max(axis=0) if values.size else np.zeros(values.shape[1], np.uint64)
        widths = np.array([int(x).bit_length() for x in most], np.int64)
        words = -(-len(ids) // 64)
        found = [_packed(((above[:, j] >> np.arange(w, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(bool)) for j, w in enumerate(widths) if w]
        return cls(ids, int((~null).sum()), least, widths, np.concatenate(found) if found else np.empty((0, words), np.uint64))

    def dumps(self) -> tuple:
        return len(self.ids), self.ids.tobytes(), self.known, self.least.tobytes(), self.widths.tobytes(), self.slices.tobytes()

    @classmethod
    def loads(cls, rows: int, ids: bytes, known: int, least: bytes, widths: bytes, slices: bytes) -> Block:
        wide = np.frombuffer(widths, np.int64)
        return cls(np.frombuffer(ids, np.int64), known, np.frombuffer(least, np.int64), wide, np.frombuffer(slices, np.uint64).reshape(int(wide.sum()), -(-rows // 64)))

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of the scores with ``query``, lowest first, and the constant that they lack."""
        size = np.abs(query)
        words = self.slices.shape[1]
        bits = int(size.max(initial=0)).bit_length()
        of_row, negative = size[self.attribute], query[self.attribute] < 0
        rows = np.arange(len(of_row)) + len(of_row) * negative
        asked = ((of_row >> np.arange(bits)[:, None]) & 1).astype(bool)
        weight = self.shift + np.arange(bits)[:, None]
        base = sum(int(q) * int(low) - (abs(int(q)) * ((1 << int(w)) - 1) if q < 0 else 0) for q, low, w in zip(query, self.least, self.widths, strict=True))
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        top = int(weight[asked].max(initial=-1))
        at = 0
        while at <= top or carries:
            take = np.nonzero(asked & (weight == at))[1] if at <= top else np.empty(0, np.int64)
            stack = np.concatenate([self.both[rows[take]], *carries]) if carries else self.both[rows[take]]
            carries = []
            while len(stack) > 2:
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                x = a ^ b
                carries.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * k :]])
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
            at += 1
        return out, base

    def best(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, bool, int]]:
        """(minus score, whether the id is null, id) of the k best rows but the query's own, ties to the smaller id."""
        found, base = self.sums(query)
        level = _packed(np.ones((1, len(self.ids)), bool))[0]
        a, b = np.searchsorted(self.ids[: self.known], [query_id, query_id + 1])
        if a < b:
            own = np.zeros((1, len(self.ids)), bool)
            own[0, a:b] = True
            level &= ~_packed(own)[0]
        sure, n_sure = np.zeros_like(level), 0
        for piece in reversed(found):
            upper = level & piece
            n = n_sure + int(np.bitwise_count(upper).sum())
            if n > k:
                level = upper
                continue
            sure, n_sure = sure | upper, n
            level = level & ~piece
            if n == k:
                break
        first = _places(sure)
        if n_sure < k:  # exactly equal scores: in the order of ids
            first = np.concatenate([first, _places(level, k - n_sure)])
        if not len(first):
            return []
        bits = [(piece[first >> 6] >> (first & 63).astype(np.uint64)) & np.uint64(1) for piece in found]
        totals = [base + sum(int(v[i]) << w for w, v in enumerate(bits)) for i in range(len(first))]
        return [(-s, bool(p >= self.known), int(self.ids[p])) for s, p in zip(totals, first.tolist(), strict=True)]


def _places(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    """The places of a bitmap's ones in ascending order, ``most`` of them at most."""
    held = np.flatnonzero(bitmap)
    if most is not None:
        held = held[:most]
    bits = np.unpackbits(bitmap[held].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(bits)
    return (held[row] * 64 + col)[:most]


# --- Spark jobs -------------------------------------------------------------------

_INDEX = "size int, block int, n int, ids binary, known int, least binary, widths binary, slices binary"


def build_index(values: DataFrame, blocks: int) -> DataFrame:
    """One row a block of ``quantised`` rows; rows are dealt to blocks by their number, so that repeated ids and vectors spread."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        size = key[0].as_py()
        ids, flat = rows["vec_id"].combine_chunks(), rows["attributes"].combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, size)
        block = Block.of(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), values)
        return pa.Table.from_arrays([pa.array([x]) for x in (size, key[1].as_py(), *block.dumps())], names).cast(kinds)

    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = pa.schema([(c, pa.int32() if c in ("size", "block", "n", "known") else pa.binary()) for c in names])
    rows = values.select("size", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "attributes")
    return rows.groupBy("size", "block").applyInArrow(run, _INDEX)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row that ``is_query`` (of vec_id) names."""
    values = materialize(quantised(vectors), "quantised")
    counts = values.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.count_if(is_query).alias("asked")).first()
    rows = max(64, min(BLOCK_ROWS, BLOCK_CELLS // max(1, counts["size"] or 1)))
    blocks, query_blocks = max(1, -(-counts["n"] // rows)), max(1, -(-counts["asked"] // QUERY_ROWS))
    runs = -(-blocks // RUN_BLOCKS)
    index = materialize(build_index(values, blocks), "bit-slices")
    asked = values.where(is_query).groupBy("size", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("query_block"))
    asked = asked.agg(F.collect_list(F.struct("row", "vec_id", "attributes")).alias("queries"))

    blob = F.struct("n", "ids", "known", "least", "widths", "slices")
    left = index.select("size", F.floor(F.col("block") / RUN_BLOCKS).cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), F.col("block").alias("nth"), blob.alias("blob"))
    right = asked.select("size", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "query_block", F.lit(-1).alias("nth"), "queries")
    pairs = left.unionByName(right, allowMissingColumns=True).repartition(min(MOST_PARTITIONS, 3 * runs * query_blocks), "size", "run", "query_block").sortWithinPartitions("size", "run", "query_block", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, best = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                size, part, query_block, nth = (batch.column(c)[i].as_py() for c in range(4))
                if nth < 0:
                    if best:
                        yield _rows(queries, best)
                    at = (size, part, query_block)
                    queries = [(q["row"], q["vec_id"], np.array(q["attributes"], np.int64)) for q in batch.column(5)[i].as_py()]
                    best = [[] for _ in queries]
                elif at == (size, part, query_block):  # else no query has this length
                    block = Block.loads(*batch.column(4)[i].as_py().values())
                    for j, (_, own, vector) in enumerate(queries):
                        best[j] = sorted(best[j] + block.best(vector, own, k))[:k]
        if best:
            yield _rows(queries, best)

    found = pairs.select("size", "run", "query_block", "nth", "blob", "queries").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def _rows(queries: list, best: list[list[tuple[int, bool, int]]]) -> pa.RecordBatch:
    flat = [(row, own, None if null else i, -s) for (row, own, _), held in zip(queries, best, strict=True) for s, null, i in held]
    columns = [pa.array([x[c] for x in flat], pa.int64()) for c in range(4)]  # Arrow refuses what is beyond 64 bits
    return pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score"])


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON len(q.v) = len(e.v) AND e.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""

QUERIES = {"op11_topk_search": op11_topk_search}
ORACLE = {"op11_topk_search": SQL}
