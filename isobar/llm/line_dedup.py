"""Line dedup over a sharded minimal perfect hash of repeated line hashes.

A pass over the documents counts, for every line key, the documents that hold
it, by 128-bit hashes, pre-aggregated before each shuffle.  The hashes of keys
found in at least ``LEAST_DOCS`` documents are indexed: the first 64 bits lead
through a shard's minimal perfect hash to a slot, whose fingerprint array has
the other 64 bits, beside the arrays of counts and of largest doc_ids.  A
second pass probes the arrays with each document's lines and joins nothing.

The index holds repeated lines only.  It is broadcast to the probing tasks
while it has at most ``BROADCAST_KEYS`` keys (about 25 bytes each, counted
first).  Beyond that the documents' repeated keys are routed to the shards:
hash rows stream past the shard that they belong to, and each document gets back
the hashes that it loses.  A shard to which more than ``mph.SHARD_ROWS`` rows go,
as the documents of its keys tell, is sent to several tasks.

Defined results: a null or empty text is one empty line; a line's key is the
line stripped of blanks at both ends with A-Z lower-cased; keys of fewer than
``LEAST_CHARS`` code points always stay; rows that repeat a doc_id hold a line
once for the count, and rows with a null doc_id count for none and are never
the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import mph
from isobar.llm.text import BLANKS, batches, table, texts_of
from isobar.session import materialize

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a broadcast index at most, and of a shard on average.
BROADCAST_KEYS, SHARD_KEYS = 2_000_000, 16_384


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The key of a lower-cased line, or None if it has under ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys)), np.uint64).reshape(-1, 2)


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the distinct keys of each row's lines, hashed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                own = {k for x in (text or b"").lower().split(b"\n") if (k := line_key(x, least)) is not None}
                keys += own
                ids += [doc] * len(own)
            found = _hashes(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, h1 long, h2 long")


def repeated_lines(hashes: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, docs, last) of keys that at least ``least_docs`` documents hold."""
    counted = hashes.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("docs") >= least_docs)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: (shard, hash, prints, counts, last), arrays by slot."""

    def run(key, rows):
        import pandas as pd

        keys = rows.h1.to_numpy(np.int64).view(np.uint64)
        # Distinct keys may share h1; then the hash is built over h1 mixed with h2.
        mixed = _slot_keys(keys, rows.h2.to_numpy(np.int64).view(np.uint64))
        held = mph.Hash.of(mixed)
        order = np.empty(len(keys), np.int64)
        order[held.slots(mixed)] = np.arange(len(keys))
        rows = rows.iloc[order]
        return pd.DataFrame([[int(key[0]), held.dumps(), rows.h2.to_numpy(np.int64).tobytes(), rows.docs.to_numpy(np.uint32).tobytes(), rows["last"].to_numpy(np.int64).tobytes()]], columns=["shard", "hash", "prints", "counts", "last"])

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "shard int, hash binary, prints binary, counts binary, last binary")


def _slot_keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ (h2 << np.uint64(1))


class Index:
    """Shards as a task reads them."""

    def __init__(self, shards: int, rows: list[tuple]) -> None:
        self.shards = shards
        self.held = {r[0]: (mph.Hash.loads(r[1]), np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.uint32), np.frombuffer(r[4], np.int64)) for r in rows}

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of hashes (n, 2): whether each is a member, and the largest doc_id that holds it."""
        member, last = np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        if not self.held or not len(found):
            return member, last
        shard = found[:, 0].astype(np.uint64).view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
        for a, b in zip(edges, edges[1:], strict=False):
            own = order[a:b]
            if (held := self.held.get(int(shard[own[0]]))) is None:
                continue
            hashed, prints, _, largest = held
            slot = hashed.slots(_slot_keys(found[own, 0], found[own, 1]))
            safe = np.maximum(slot, 0)
            member[own] = (slot >= 0) & (prints[safe] == found[own, 1])
            last[own] = largest[safe]
        return member, last


def _rewrite(batch: pa.RecordBatch, drops, least: int) -> pa.RecordBatch:
    """Result rows of a batch (doc_id, text, ...).

    drops: given the lines' hashes and the rows that they are of, which go.
    """
    texts = [t or b"" for t in texts_of(batch, 1)]
    lines, keys, row = [], [], []
    for i, text in enumerate(texts):
        lines.append(text.split(b"\n"))
        for x in text.lower().split(b"\n"):
            key = line_key(x, least)
            row.append(i)
            keys.append(key)
    at = np.array([i for i, k in enumerate(keys) if k is not None], np.int64)
    row = np.array(row, np.int64)
    gone = np.zeros(len(keys), bool)
    if len(at):
        gone[at] = drops(_hashes([keys[i] for i in at.tolist()]), row[at])
    out, first = ([], [], []), 0
    for own in lines:
        lost = gone[first : first + len(own)]
        first += len(own)
        n = int(lost.sum())
        kept = b"\n".join(x for x, g in zip(own, lost.tolist(), strict=True) if not g) if n else b"\n".join(own)
        for column, value in zip(out, (len(own), n, kept), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


_OUT = "doc_id long, n_lines long, n_dropped long, text string"


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, text (of the lines kept)."""
    hashes = line_hashes(docs, least)
    lines = materialize(repeated_lines(hashes, least_docs), "repeated-lines")
    keys = lines.count()
    shards = max(1, -(-keys // SHARD_KEYS))
    index = build_index(lines, shards)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if keys > broadcast_keys:
        return _routed(given, docs, index, shards, least)
    # A worker unpickles the arrays once, whatever the number of its tasks.
    held = docs.sparkSession.sparkContext.broadcast(Index(shards, [tuple(r) for r in index.collect()]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = held.value
        for batch in batches(parts):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            none = np.asarray(batch.column(0).is_null())
            ids = np.where(none, -1, ids).astype(np.int64)

            def drops(found: np.ndarray, row: np.ndarray, ids=ids, none=none) -> np.ndarray:
                member, last = arrays.look_up(found)
                return member & (none[row] | (last != ids[row]))

            yield _rewrite(batch, drops, least)

    return given.mapInArrow(run, _OUT)


def _routed(given: DataFrame, docs: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """The same for an index that is too large to broadcast."""
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    blobs = index.select("shard", F.struct("hash", "prints", "counts", "last").alias("blob"))
    # All lines are sent, also those that don't repeat: salts come from the rows of each shard as they are sent.
    asked = materialize(line_hashes(docs, least).select(shard, "doc_id", "h1", "h2"), "line-hashes")
    heavy = materialize(mph.salts(asked.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))), "heavy-shards")
    dealt = mph.deal(asked, blobs, heavy)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in parts:
            for own_shard, kind, a, b in mph.runs(batch):
                if kind == 0:
                    x, at = batch.column(3)[a].as_py(), own_shard
                    held = Index(shards, [(own_shard, x["hash"], x["prints"], x["counts"], x["last"])])
                    continue
                if held is None or at != own_shard:
                    continue
                own = batch.slice(a, b - a)
                found = np.stack([own.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6)], axis=1).view(np.uint64)
                member, last = held.look_up(found)
                none = np.asarray(own.column(4).is_null())
                ids = np.where(none, -1, own.column(4).to_numpy(zero_copy_only=False)).astype(np.int64)
                gone = pa.array(member & (none | (last != ids)))
                yield pa.RecordBatch.from_arrays([own.column(i).filter(gone) for i in (4, 5, 6)], ["doc_id", "h1", "h2"])

    gone = dealt.mapInArrow(run, "doc_id long, h1 long, h2 long").distinct()
    lost = materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")), "lost-lines")
    beside = given.join(lost.withColumnRenamed("doc_id", "lost_id"), F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").select("doc_id", "text", "lost")

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            sets = [{(x["h1"], x["h2"]) for x in own or ()} for own in batch.column(2).to_pylist()]

            def drops(found: np.ndarray, row: np.ndarray, sets=sets) -> np.ndarray:
                return np.array([tuple(pair) in sets[i] for pair, i in zip(found.view(np.int64).tolist(), row.tolist(), strict=True)], bool)

            yield _rewrite(batch, drops, least)

    return beside.mapInArrow(rewrite, _OUT)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM x)),
hot AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT lines.*, hot.k IS NOT NULL AND hot.last <> doc_id AS gone FROM lines LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": SQL}
