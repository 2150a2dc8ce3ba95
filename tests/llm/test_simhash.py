import numpy as np
import xxhash
from pyspark.sql import functions as F

from isobar.llm import simhash
from tests.llm.conftest import ROWS, lower


def fingerprint(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    found = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute(rows):
    """doc_id and fingerprint to component id, by all pairs."""
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((str(d), f, str(least.get(root(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def out_of(frame):
    return sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in frame.collect())


def test_components_match_brute_force(docs, rows):
    assert out_of(simhash.near_duplicates(docs)) == brute(rows)


def test_sample_matches_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert out_of(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def near_cluster(rng, n, flips):
    base = int(rng.integers(0, 2**63))
    out = set()
    while len(out) < n:
        x = base
        for b in rng.choice(64, int(rng.integers(0, flips)), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def parts(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_trees_link_as_all_pairs_do():
    rng = np.random.default_rng(1)
    for n, flips in ((5, 3), (60, 4), (300, 6)):
        fps = near_cluster(rng, n, flips)
        root = simhash.linked(np.array(fps, np.uint64))
        groups = {}
        for f, r in zip(fps, root.tolist(), strict=True):
            groups.setdefault(r, set()).add(f)
        assert {frozenset(g) for g in groups.values()} == parts(fps)


def test_large_shards_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 10)
    rng = np.random.default_rng(2)
    fps = sorted({x for _ in range(4) for x in near_cluster(rng, 60, 5)})
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    groups = {}
    for r in simhash.components(edges).collect():
        groups.setdefault(r.root, set()).add(r.node & (2**64 - 1))
    assert {frozenset(g) for g in groups.values()} == {g for g in parts(fps) if len(g) > 1}


def test_every_link_shares_a_shard():
    rng = np.random.default_rng(4)
    from itertools import combinations

    for blocks in range(4, 9):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        for _ in range(50):
            flips = rng.choice(64, 3, replace=False)
            clean = [i for i in range(blocks) if not any(edges[i] <= f < edges[i + 1] for f in flips)]
            assert any(set(g) <= set(clean) for g in combinations(range(blocks), blocks - 3))
    assert simhash.blocks_for(1000) == 4 and simhash.blocks_for(10**9) > 4


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    out = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({out[i] for i in range(201)}) == 1 and out[1000] == out[1001] != out[0]


def test_stage_keeps_one_of_each_component(clashing, docs):
    out = simhash.keep_representatives(clashing)
    tags = {(r.doc_id, r.text): r.tag for r in docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).collect()}
    assert out.columns == clashing.columns
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted({(str(d), t or "") for d, t in ROWS for r in rows if r.representative and r.doc_id == d and r.text_tag == tags[d, t]})


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_representatives(none).count() == 0
