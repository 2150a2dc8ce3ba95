"""The bit-sliced index against plain inner products."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isobar.llm import bit_slices

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10):
    """(query_id, rank, vec_id, score) by brute force, in the order of rows."""
    held = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, q in held:
        if own is None or own % 100:
            continue
        found = [(-sum(a * b for a, b in zip(q, v, strict=True)), i is None, i or 0) for i, v in held if len(v) == len(q) and i != own]
        out += [(own, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **extra):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    for name in extra.get("clash", ()):
        df = df.withColumn(name, F.lit("own"))
    out = bit_slices.search(df, F.col("vec_id") % 100 == 0)
    return sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()], key=repr)


def odd_rows():
    dice = random.Random(5)
    one = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, [dice.uniform(-1, 1) for _ in range(4)]) for i in range(0, 320)]
    rows += [(i, one) for i in range(1000, 1040)]  # equal vectors: ties over many ids
    rows += [(100, one), (100, [-x for x in one]), (7, one), (7, one), (None, one), (-100, [9.5, -80.0, 3.0, 1e-9])]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [math.nan] * 4), (500, [math.inf, 0.0, 0.0, 0.0])]
    return rows + [(600, [1.0, 2.0]), (601, [2.0, -1.0]), (700, []), (701, []), (800, [0.0] * 4), (900, [5e5, -3e6, 1.0, 2.0])]


def test_search_is_brute_force(spark, monkeypatch):
    rows = odd_rows()
    expected = plain(rows)
    assert found(spark, rows, clash=("row", "size", "block", "score")) == expected
    # Small blocks and runs: many blocks, query blocks and merges.
    monkeypatch.setattr(bit_slices, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bit_slices, "BLOCK_CELLS", 1)
    monkeypatch.setattr(bit_slices, "QUERY_ROWS", 2)
    monkeypatch.setattr(bit_slices, "RUN_BLOCKS", 2)
    assert found(spark, rows) == expected


def test_fewer_rows_than_ranks_and_no_queries(spark):
    rows = [(0, [1.0]), (1, [1.0]), (2, [-1.0])]
    assert found(spark, rows) == plain(rows) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, -1024 * 1024)]
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == [] == found(spark, [])


def test_components_beyond_62_bits_are_an_error(spark):
    with pytest.raises(Exception, match="62 bits"):
        found(spark, [(0, [1e30]), (1, [1.0])])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 63, 64, 65, 200]), st.integers(0, 6), st.sampled_from([1, 3, 40, 2**30]))
def test_sums_and_selection(seed, n, size, reach):
    rng = np.random.default_rng(seed)
    values = rng.integers(-reach, reach + 1, (n, size))
    query = rng.integers(-reach, reach + 1, size)
    ids, null = rng.integers(0, n, n), rng.random(n) < 0.1
    block = bit_slices.Block.loads(*bit_slices.Block.of(ids, null, values).dumps())
    scores = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in values]
    own = int(ids[0])
    expected = sorted((-s, bool(x), int(i)) for s, x, i in zip(scores, null, ids, strict=True) if x or i != own)
    for k in (1, 5, n + 1):
        got = sorted(block.best(query, own, k))
        assert [(s, x, None if x else i) for s, x, i in got] == [(s, x, None if x else i) for s, x, i in expected[:k]]


def test_every_number_is_read_from_the_slices(monkeypatch):
    """No inner product is formed beside the bitmaps."""
    rng = np.random.default_rng(1)
    values = rng.integers(-500, 500, (300, 8))
    block = bit_slices.Block.of(np.arange(300), np.zeros(300, bool), values)
    slices, base = block.sums(values[3])
    total = [base + sum(int((piece[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)) << w for w, piece in enumerate(slices)) for i in range(300)]
    assert total == (values @ values[3]).tolist()
