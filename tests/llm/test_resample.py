"""Resampling against a plain one, and the bisection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isobar.llm import resample as r
from tests.llm.conftest import SCHEMA, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(lower(text))
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs, target):
    """(doc_id, n_features, weight, score), and the ids drawn in the order of their ranks."""
    s, t = (Counter(b for text in side for b in features(text)[1]) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + 10000) / (float(s[b] + 1) * float(all_t + 10000)))) for b in range(10000)]
    rows, can = [], []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if n >= 20:
                can.append((-score, doc_id))
        rows.append((doc_id, len(found), weight, score))
    return sorted(rows, key=repr), sorted(can)[: 25 * len(can) // 100]


def check(spark, docs, target):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(3).withColumn("row", F.lit("own")).withColumn("rank", F.lit(9)).withColumn("bucket", F.lit(1))
    got = r.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, drawn = plain(docs, target)
    assert sorted([(x.doc_id, x.n_features, x.weight, x.score) for x in got], key=repr) == rows
    ranks = sorted((x["rank"], -x.score, x.doc_id) for x in got if x["rank"] is not None)
    assert ranks == [(i, *x) for i, x in enumerate(drawn, 1)]


def test_resample_is_the_plain_one(spark, rows):
    dice = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta été 日本 x1 y2 Z".split()
    docs = list(rows) + [(100 + i % 150, " ".join(dice.choices(words, k=dice.randint(0, 60)))) for i in range(200)]
    docs += [(-5, words[0] + " beta" * 40), (None, "alpha beta " * 30)] + [(77, "same text " * 20)] * 9 + [(77, "same text, " * 20)]
    check(spark, docs, ["alpha beta gamma, alpha", "beta\x00gamma", None, ""])


def test_empty_tables(spark):
    check(spark, [], ["a b"])
    check(spark, [(1, "one two"), (2, None)], [])


def test_words_are_not_cut_at_stretches(monkeypatch):
    text = "Ab cd, éf\x00gh " * 50 + "x" * 300 + " end of it"
    whole = [list(b) for _, b in r.buckets_of(text.encode(), 10000)]
    for size in (1, 2, 7, 64, 299):
        monkeypatch.setattr(r, "STRETCH", size)
        parts = list(r.buckets_of(text.encode(), 10000))
        assert sum(n for n, _ in parts) == features(text)[0]
        assert sorted(b for _, x in parts for b in x) == sorted(whole[0]) == sorted(features(text)[1])


@pytest.mark.parametrize("seed", range(4))
def test_bisection_equals_sorting(spark, seed):
    dice = random.Random(seed)
    spread = [1, 40, 10**6, 2**40][seed]
    held = [(i, dice.randint(0, 3), dice.randint(-spread, spread)) for i in range(400)]
    df = spark.createDataFrame(held, "row long, doc_id long, score long").cache()
    expected = sorted((-s, d, i) for i, d, s in held)
    for k in (0, 1, 37, 399, 400):
        assert sorted((-x.score, x.doc_id, x.row) for x in df.where(r.drawn(df, k)).collect()) == expected[:k]
    for parts in (1, 7):
        got = sorted((x["rank"], -x.score, x.doc_id, x.row) for x in r.ranked(df, parts).collect())
        assert got == [(i, *x) for i, x in enumerate(expected, 1)]
    values = sorted(s for _, _, s in held)
    assert r.smallest(df, F.col("score"), 200) == (values[199], sum(v < values[199] for v in values))
