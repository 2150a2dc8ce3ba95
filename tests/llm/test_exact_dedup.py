import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from isobar.llm import exact_dedup, mph
from tests.llm.conftest import lower


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        held = mph.Hash.loads(mph.Hash.of(keys).dumps())
        assert sorted(held.slots(keys).tolist()) == list(range(len(keys)))


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def test_rows_match_brute_force(docs, rows):
    out = exact_dedup.dedup_rows(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, bytes(r.digest).hex()) for r in out) == brute(rows)
    assert all(r.kept == (r.keep_id == r.doc_id) for r in out)


def test_heavy_shards_are_salted(spark, monkeypatch):
    monkeypatch.setattr(mph, "SHARD_ROWS", 500)
    many = [(i, "hot text") for i in range(100, 3000)] + [(i, f"cold {i}") for i in range(3000, 3200)]
    frame = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    rows = exact_dedup.digests(frame).select(F.lit(0).alias("shard"), F.lit(1).alias("rows"))
    assert [r.salts for r in mph.salts(rows).collect()] == [7]
    for most in (1_000_000, -1):
        monkeypatch.setattr(mph, "BROADCAST_SHARDS", most)
        out = exact_dedup.dedup_rows(frame).collect()
        assert len(out) == len(many)
        assert {r.keep_id for r in out if r.doc_id < 3000} == {2999} and sum(r.kept for r in out) == 201
        assert {r.group_size for r in out if r.doc_id < 3000} == {2900}


def test_both_halves_and_members_and_nonmembers_take_part(spark):
    frame = spark.createDataFrame([(i, f"text {i % 37}") for i in range(400)] + [(i, f"own {i}") for i in range(400, 500)], "doc_id long, text string")
    found = exact_dedup.digests(frame)
    old = found.where(exact_dedup.history_half())
    looked = exact_dedup.probe(found.where(~exact_dedup.history_half()), exact_dedup.distinct_digests(old)).collect()
    held = {bytes(r.digest) for r in old.collect()}
    assert len(looked) > 100 and all(r.member == (bytes(r.digest) in held) for r in looked)
    assert {r.member for r in looked} == {True, False}
    out = exact_dedup.dedup_rows(frame).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, bytes(r.digest).hex()) for r in out) == brute([(r.doc_id, r.text) for r in frame.collect()])


def test_rows_alike_spread_over_salts(spark, monkeypatch):
    from isobar.llm import mph
    from isobar.session import materialize

    monkeypatch.setattr(mph, "SHARD_ROWS", 50)
    # One row repeated, and rows without an id: neither digest nor doc_id tells them apart.
    rows = [(7, "the same")] * 400 + [(None, "the same")] * 200 + [(i, f"own {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = exact_dedup.dedup_rows(frame).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, bytes(r.digest).hex()) for r in out) == brute(rows)
    found = materialize(exact_dedup.digests(frame), "digests")
    index, shards = exact_dedup.build_index(exact_dedup.distinct_digests(found))
    asked = found.select(exact_dedup._shard(shards).alias("shard"), "doc_id", "digest")
    heavy = mph.salts(asked.groupBy("shard").count().withColumnRenamed("count", "rows"))
    from pyspark.sql import functions as F

    blobs = index.select("shard", F.struct("hash", "digests", "winners", "counts", "nulls").alias("blob"))
    sizes = [r["count"] for r in mph.deal(asked, blobs, heavy).where("kind = 1").groupBy("shard", "salt").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100


def test_history_comes_first(spark):
    history = spark.createDataFrame([(90, "Old text"), (91, "other")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "old TEXT"), (2, "new"), (3, "NEW"), (4, "fresh")], "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_rows(new, history).collect()}
    assert out == {1: (90, False), 2: (3, False), 3: (3, True), 4: (4, True)}


def test_stage_keeps_one_of_each_with_all_columns(clashing, rows):
    out = exact_dedup.drop_duplicates(clashing)
    assert out.columns == clashing.columns
    found = out.collect()
    assert sorted(lower(r.text) for r in found) == sorted({lower(t) for _, t in rows})
    assert all(r.digest == "own digest" for r in found)


def test_empty(none):
    assert exact_dedup.dedup_rows(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
