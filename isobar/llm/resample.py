"""Importance resampling towards a target distribution of hashed n-grams.

Words and pairs of neighbouring words are hashed to buckets.  Two counts of
buckets, of all documents and of all benchmark texts, give each bucket an integer
gain; a document's weight is the floored mean of its features' gains, and its
score adds a Gumbel number drawn from a hash of its doc_id, so that the k largest
scores are a sample without replacement in proportion to exp(weight).

* The counts are summed in arrays, one a task, and shuffled as at most
  ``buckets`` rows a task.  Gains are an array of that bounded length, which goes
  to the tasks that score.
* Scores are written once (no texts).  The cutoff is found by bisecting the range
  of scores with exact count jobs over that table, four halvings a job; rows at
  the cutoff are bisected on doc_id in the same way, and rows that agree in both
  on their number in the table.  Nothing is sorted as a whole and no rows come to
  the driver.
* The rows drawn are range-partitioned by (score, doc_id), sorted inside their
  partitions and written; a rank is the number of rows in earlier partitions plus
  the place in the own one.

Defined results: a null text has no words; a document without features has weight
0.  A null doc_id has no hash: its score is null, it is never drawn and doesn't
count towards the share.  Rows that repeat a doc_id are each a document, with the
same hash; if their scores agree too, the earlier in the written table comes
first.  Texts of any length are read in stretches of ``STRETCH`` bytes.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm.text import batches, table, texts_of
from isobar.session import materialize

#: Buckets, least words of a document that can be drawn, share drawn (per cent) and seed of the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
#: Halvings of the range that one count job answers.
HALVINGS = 4

#: Bytes as they are counted: A-Z in lower case, digits, letters and all beyond ASCII; all else parts words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a list for each stretch of it; no word is cut."""
    text, at = text or b"", 0
    rest = b""
    while at < len(text):
        piece = rest + text[at : at + STRETCH].translate(_FOLDED)
        at += STRETCH
        cut = piece.rfind(b" ") + 1 if at < len(text) else len(piece)
        rest = piece[cut:]
        if words := piece[:cut].split():
            yield words


def buckets_of(text: bytes | None, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, bucket of each feature) by stretches; a pair over two stretches counts with the second.

    The checksum of a pair goes on from that of its first word.
    """
    before: list[int] = []
    for words in stretches(text):
        single = list(map(crc32, words))
        ahead = before + list(map(crc32, repeat(b" "), single))
        before = [ahead.pop()]
        pairs = list(map(crc32, words[len(words) - len(ahead) :], ahead))
        yield len(words), np.array(single + pairs, np.int64) % buckets


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the features of all rows of (text); tasks add up before the shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches(rows):
            for text in texts_of(batch, 0):
                for _, found in buckets_of(text, buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Of each bucket floor(1000 ln of the target's smoothed share over the raw one); ``buckets`` numbers come to the driver."""
    found = raw.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in found.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toLocalIterator():
        s[row.bucket], t[row.bucket] = row.s, row.t
    of_s, of_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s, t, strict=True)]


def gumbel(doc_id: int, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the SHA-256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row for each of ``docs``."""
    table_of = np.array(gain, np.int64)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                words = features = total = 0
                for n, held in buckets_of(text, len(table_of)):
                    words, features, total = words + n, features + len(held), total + int(table_of[held].sum())
                weight = total // features if features else 0
                found.append((doc_id, words, features, weight, None if doc_id is None else weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def smallest(rows: DataFrame, key: Column, k: int) -> tuple[int, int]:
    """(v, n): the least v with at least ``k`` rows of a key of v or less, and how many are less.  1 <= k <= rows.

    Each job counts the rows at the points of ``HALVINGS`` halvings of the range
    that is left.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        step = 1 << HALVINGS
        cuts = sorted({low + (high - low) * i // step for i in range(1, step)})
        counts = rows.agg(*[F.count_if(key <= c) for c in cuts]).first()
        for cut, n in zip(cuts, counts, strict=True):
            if n >= k:
                high = cut
                break
            low, below = cut + 1, n
    return low, below


def drawn(rows: DataFrame, k: int) -> Column:
    """Which of (row, doc_id, score) are the first ``k`` by descending score, doc_id and row, as a condition."""
    if k <= 0:
        return F.lit(False)
    out, left, held = F.lit(False), k, rows
    level = F.lit(True)
    for key in (-F.col("score"), F.col("doc_id"), F.col("row")):
        value, below = smallest(held, key, left)
        out, level = out | (level & (key < value)), level & (key == value)
        left, held = left - below, held.where(key == value)
    return out | level


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with their rank by descending score, doc_id and row, from 1."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number that a row gets holds its partition above bit 33 and its place below.
    placed = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return placed.join(starts, part == F.col("_part")).withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; those drawn have a rank.

    target: texts of the distribution aimed at (text).  ``percent`` of the
    documents with at least ``least_words`` words are drawn.
    """
    gain = gains(histogram(docs, buckets), histogram(target, buckets), buckets)
    rows = materialize(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    can = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    k = percent * rows.where(can).count() // 100
    mine = drawn(rows.where(can), k)
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-k // 10_000)))
    columns = ["doc_id", "n_features", "weight", "score"]
    taken = ranked(rows.where(can & mine), parts).select(*columns, "rank")
    return taken.unionByName(rows.where(~(can & F.coalesce(mine, F.lit(False)))).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 by its table of 256, which is derived from the polynomial.
SQL = f"""
WITH RECURSIVE z(b, i, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS lut FROM z WHERE i = 8),
w AS (SELECT 0 AS side, doc_id AS id, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, NULL, {_WORDS} FROM benchmark),
f AS (
  SELECT side, id, unnest(w) AS f FROM w
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)),
distinct_f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
k AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, lut[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM distinct_f, crc),
fb AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN k USING (f) GROUP BY side, id, bucket),
tot AS (SELECT CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM fb),
b AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM fb GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((b.t + 1) * (tot.s + 10000) / ((b.s + 1) * (tot.t + 10000)))) AS BIGINT) AS gain FROM b, tot),
dw AS (SELECT id AS doc_id, sum(n) AS n, sum(n * gain) AS total FROM fb JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
d AS (
  SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(dw.n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(dw.total AS DOUBLE) / CAST(dw.n AS DOUBLE)), 0) AS BIGINT) AS weight,
    CAST('0x' || left(sha256('7:' || w.doc_id), 8) AS BIGINT) AS h
  FROM w LEFT JOIN dw ON w.doc_id = dw.doc_id WHERE side = 0),
e AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_words >= 20)
SELECT e.doc_id, e.n_features, e.weight, e.score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op12_resample": op12_resample}
ORACLE = {"op12_resample": SQL}
