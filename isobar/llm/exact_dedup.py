"""Exact dedup against an index of historical digests.

The history's distinct digests lie in shards.  Each shard is a minimal perfect
hash whose slots hold the full digest, the winner's doc_id and the number of
rows; a lookup compares all 32 bytes, so a row that was never seen can't pass
for a member.  Members are counted onto their slot's winner; nonmembers are
grouped by digest among themselves.  Both together are the next history
(``absorb``), in which every row then finds its winner (``probe``).

The index is a DataFrame (one row a shard) and travels by shuffle, not by
broadcast, as it grows with the corpus.  Rows meet their shard in sorted
partitions that stream: a task holds one shard and one Arrow batch.  A shard to
which more than ``mph.SHARD_ROWS`` rows go is sent to several tasks, among which
its rows are dealt, so that a digest of any number of rows is never one task's.

``dedup_rows`` without a history splits the corpus: the rows whose doc_id hashes
to an even number are the history that the others are looked up in.

Defined results: a null text counts as empty; texts that differ only in A-Z
against a-z are equal; of equal texts the row with the largest doc_id stays, a
null doc_id being smaller than any other; rows that agree in doc_id and text
are one winner (``kept`` is true for each of them in ``dedup_rows``, and
``drop_duplicates`` keeps one).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import mph
from isobar.llm.text import batches, lower_ascii, table, texts_of
from isobar.session import fresh_name, match, materialize

#: Digests a shard holds on average.
SHARD_KEYS = 8192


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text after lower-casing A-Z."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [hashlib.sha256((t or b"").lower()).digest() for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary")


def _shard(shards: int):
    """Of a digest: its first 7 bytes, modulo ``shards``."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _keys(found: list[bytes]) -> np.ndarray:
    """64 bits of each digest, from other bytes than those that choose the shard."""
    return np.frombuffer(b"".join(d[8:16] for d in found), np.uint64)


def build_index(history: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """One row a shard (shard, hash, digests, winners, counts), and their number.

    ``history`` has (digest, winner, rows), one row for each distinct digest.
    """
    shards = shards or max(1, -(-history.count() // SHARD_KEYS))

    def run(key, rows):
        import pandas as pd

        found = rows.sort_values("digest")
        keys = _keys(list(found.digest))
        held = mph.Hash.of(keys)
        order = np.empty(len(keys), np.int64)
        order[held.slots(keys)] = np.arange(len(keys))
        found = found.iloc[order]
        winners = found.winner.fillna(-1).to_numpy(np.int64)
        blob = [held.dumps(), b"".join(found.digest), winners.tobytes(), found["rows"].to_numpy(np.int64).tobytes(), np.packbits(found.winner.isna()).tobytes()]
        return pd.DataFrame([[int(key[0]), *blob]], columns=["shard", "hash", "digests", "winners", "counts", "nulls"])

    index = history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(run, "shard int, hash binary, digests binary, winners binary, counts binary, nulls binary")
    return index, shards


class _Shard:
    """A shard as read back in a task."""

    def __init__(self, row: dict) -> None:
        self.hash, self.digests = mph.Hash.loads(row["hash"]), row["digests"]
        self.winners, self.counts = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["counts"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.winners)).astype(bool)

    def look_up(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots and whether the slot's full digest is the one looked up."""
        slots = self.hash.slots(_keys(found))
        held = np.array([s >= 0 and self.digests[32 * s : 32 * s + 32] == d for s, d in zip(slots.tolist(), found, strict=True)], bool)
        return slots, held


def _dealt(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, digest, member, winner, group_size) of each row of (doc_id, digest): its slot's, if that holds its digest."""
    asked = rows.select(_shard(shards).alias("shard"), "doc_id", "digest")
    heavy = materialize(mph.salts(asked.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))), "heavy-shards")
    blobs = index.select("shard", F.struct("hash", "digests", "winners", "counts", "nulls").alias("blob"))
    dealt = mph.deal(asked, blobs, heavy)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "member", "winner", "group_size"]
        held, at = None, None
        for batch in parts:
            for shard, kind, a, b in mph.runs(batch):
                if kind == 0:
                    held, at = _Shard(batch.column(3)[a].as_py()), shard
                    continue
                ids, found = batch.column(4).slice(a, b - a), batch.column(5).slice(a, b - a).to_pylist()
                if held is None or at != shard:
                    none = pa.nulls(b - a, pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary()), pa.array([False] * (b - a)), none, none], names)
                    continue
                slots, member = held.look_up(found)
                safe = np.where(member, slots, 0)
                winner = pa.array(held.winners[safe], pa.int64(), mask=~member | held.nulls[safe])
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary()), pa.array(member), winner, pa.array(held.counts[safe], pa.int64(), mask=~member)], names)

    return dealt.mapInArrow(run, "doc_id long, digest binary, member boolean, winner long, group_size long")


def probe(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(doc_id, digest, member, winner, group_size) of rows (doc_id, digest), looked up in an index over ``distinct``."""
    index, shards = build_index(distinct)
    return _dealt(rows, index, shards)


def distinct_digests(found: DataFrame) -> DataFrame:
    """(digest, winner, rows) of (doc_id, digest); pre-aggregated before the shuffle."""
    return found.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("rows"))


def absorb(distinct: DataFrame, looked: DataFrame, first: bool = False) -> DataFrame:
    """The next history (digest, winner, rows): ``distinct`` and rows that were looked up in it.

    Members add to their digest's rows, and the larger doc_id wins, unless
    ``first`` says that the history's winner stays; nonmembers form groups of
    their own.
    """
    merged = distinct.select("digest", "winner", "rows", F.lit(True).alias("old")).unionByName(distinct_digests(looked).withColumn("old", F.lit(False)))
    winner = F.max("winner") if not first else F.when(F.bool_or("old"), F.max(F.when(F.col("old"), F.col("winner")))).otherwise(F.max("winner"))
    return merged.groupBy("digest").agg(winner.alias("winner"), F.sum("rows").alias("rows"))


def history_half() -> Column:
    """Rows that are indexed first where a corpus is its own history."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 0


def dedup_rows(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    history: documents accepted earlier (doc_id, text); their winners stay
    before any row of ``docs``, and group_size counts their rows too.  Without
    it half of the corpus is the history of the other half, and the largest
    doc_id of both stays.
    """
    found = materialize(digests(docs), "digests")
    old, new = (found.where(history_half()), found.where(~history_half())) if history is None else (digests(history), found)
    distinct = materialize(distinct_digests(old), "history")
    looked = materialize(probe(new, distinct), "looked-up")
    # Members that the history's winner outlives change nothing but counts; nonmembers group separately.
    members, others = looked.where("member"), looked.where(~F.col("member"))
    after = absorb(distinct, members, first=history is not None).unionByName(distinct_digests(others))
    rows = probe(found, materialize(after, "next-history"))
    mine = F.col("winner").eqNullSafe(F.col("doc_id"))
    if history is not None:
        seen = distinct.select(F.col("digest").alias("_seen"))
        rows = rows.join(seen, F.col("digest") == F.col("_seen"), "left")
        mine = mine & F.col("_seen").isNull()
    return rows.select("doc_id", "digest", F.col("winner").alias("keep_id"), "group_size", mine.alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Equal texts keep the row with the largest doc_id; if that doc_id itself
    repeats with an equal text, one of those rows (any, where other columns
    differ) stays.
    """
    name = fresh_name(docs, "digest_of_text")
    rows = dedup_rows(docs)
    kept = materialize(rows.where("kept").groupBy("doc_id", F.lower(F.hex("digest")).alias("digest")).agg(F.count(F.lit(1)).alias("n")), "kept")
    tagged = docs.withColumn(name, F.sha2(_folded(), 256))
    on = [(F.col("doc_id").cast("long"), "doc_id"), (F.col(name), "digest")]
    once = match(tagged, kept.where("n = 1"), on)
    more = match(tagged, kept.where("n > 1"), on).dropDuplicates(["doc_id", name])
    return once.unionByName(more).select(*docs.columns)


def _folded():
    return lower_ascii(F.coalesce(F.col("text"), F.lit("")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {"op5_exact_dedup": SQL}
