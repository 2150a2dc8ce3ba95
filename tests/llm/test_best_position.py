"""Ranked search against a plain one, and the stopping rule of its shards."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isobar.llm import best_position as bp
from tests.llm.conftest import SCHEMA, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in terms}
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(3)
    for name in ("n", "terms", "tf", "score", "item_id", "rank"):
        df = df.withColumn(name, F.lit("own"))
    target = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = bp.search(df, target)
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=repr) == plain(docs, items)


ITEMS = [(1, "Alpha beta, GAMMA alpha"), (2, "the quick brown fox"), (3, None), (4, ""), (5, "... !"), (6, "nowhere_found"), (None, "delta x1"), (7, "été 日本語 a"), (7, "hello")]


def many(rows):
    dice = random.Random(11)
    words = "alpha beta gamma delta epsilon the fox x1 été a".split()
    docs = list(rows) + [(100 + i % 170, " ".join(dice.choices(words, weights=range(1, 11), k=dice.randint(0, 80)))) for i in range(220)]
    return docs + [(900 + i, "alpha gamma the the") for i in range(40)] + [(None, "alpha gamma the the")]


def test_search_is_the_plain_one(spark, rows, monkeypatch):
    check(spark, many(rows), ITEMS)
    # Several groups of items: as many passes.
    monkeypatch.setattr(bp, "TERM_BYTES", 200)
    check(spark, many(rows), ITEMS)


def test_empty_tables(spark, rows):
    check(spark, [], ITEMS)
    check(spark, [(1, None), (2, "?")], ITEMS)
    check(spark, list(rows), [])
    check(spark, list(rows), [(1, None)])


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 8), st.integers(1, 12))
def test_shard_keeps_all_that_may_be_best(seed, n, vocabulary, k):
    rng = np.random.default_rng(seed)
    terms = [np.flatnonzero(rng.random(vocabulary) < 0.5) for _ in range(n)]
    impacts = [rng.integers(1, rng.choice([3, 1000]), len(t)) for t in terms]
    shard = bp.Shard(list(range(n)), terms, impacts, vocabulary)
    weights = rng.integers(0, 5, vocabulary)
    asked = np.flatnonzero(rng.random(vocabulary) < 0.7)
    totals = sorted(((-int(sum(weights[t] * i for t, i in zip(ts, im, strict=True) if t in asked)), d) for d, (ts, im) in enumerate(zip(terms, impacts, strict=True))))
    expected = [(s, d) for s, d in totals[:k] if s < 0]
    for _ in range(2):  # twice: nothing is left over from the first
        assert sorted((-s, d) for s, d in shard.best(asked, weights[asked], k, 0))[:k] == expected
    if expected:
        floor = -expected[0][0]
        assert {(-s, d) for s, d in shard.best(asked, weights[asked], k, floor)} >= {x for x in expected if -x[0] >= floor}


def test_best_positions_stop_before_last_read_ones():
    """Documents that are high in one list and low in the other are seen by direct access at both ends."""
    n = 4000
    terms = [np.array([0, 1])] * n
    impacts = [np.array([n - d, n - d]) for d in range(n)]
    shard = bp.Shard(list(range(n)), terms, impacts, 2)
    found = shard.best(np.array([0, 1]), np.array([1, 1]), 10, 0)
    assert sorted((-s, d) for s, d in found)[:10] == [(-2 * (n - d), d) for d in range(10)]
    assert shard.reads <= 64
    # A shard whose best can't reach the k-th of earlier shards is left after one step.
    shard.reads = 0
    assert shard.best(np.array([0, 1]), np.array([1, 1]), 10, 10 * n) == [] and shard.reads <= 2 * bp.FIRST_STEP


def test_a_list_ahead_of_another_counts_what_direct_access_has_seen():
    seen = np.array([True, True, True, False, False, True, False, False])
    assert bp._advanced(seen, np.array([0, 5]), np.array([4, 2]), np.array([0, 0]), 2).tolist() == [3, 1]
