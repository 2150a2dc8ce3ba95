import zlib

from isobar.llm import quality
from isobar.llm.text import table


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_ranking(spark, sf01):
    labels = {r.doc_id: r.quality for r in table(spark, sf01, "labels").collect()}
    rows = quality.op8_quality(spark, sf01).collect()
    assert len(rows) == table(spark, sf01, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(pairs) >= 0.95
    good = [p >= 0.7 for p, y in pairs if y]
    assert sum(good) >= 0.95 * len(good)


def test_edge_cases(spark, docs, none, sf01):
    model = quality.fit_documents(table(spark, sf01, "documents"), table(spark, sf01, "labels"))
    rows = quality.features(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.feature for r in rows if r.tag in (1, 2)] == [model.prior, model.prior]
    assert quality.features(none, model).count() == 0


def test_one_label_or_none(spark, docs):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    flat = quality.fit_documents(docs, labels)
    assert len({r.score for r in quality.features(docs, flat).collect()}) == 1
    nothing = quality.fit_documents(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.features(docs, nothing).collect()} == {0.5}


def plain_feature(raw, model):
    """Sizes compressed piece by piece, each with a compressor of its own."""
    import zstandard

    size = {}
    for name, data in (("good", model.good), ("bad", model.bad)):
        size[name] = 0
        for i in range(0, len(raw), quality.PIECE):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=quality.LEVEL)
            size[name] += len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + quality.PIECE]))
    return (size["bad"] - size["good"] + quality.WEIGHT * model.prior) / (len(raw) + quality.WEIGHT)


def test_features_match_brute_force(spark, sf01):
    import math

    docs, labels = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    model = quality.fit_documents(docs, labels)
    own = {r.doc_id: r.text for r in docs.where("doc_id < 60").collect()} | {-1: None, -2: "", -3: "a"}
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    for r in quality.features(frame, model).collect():
        feature = plain_feature((own[r.tag] or "").encode(), model)
        assert r.feature == feature and abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * feature + model.offset))))) < 1e-12
        assert r.tag not in (-1, -2) or abs(r.feature - model.prior) < 1e-12


def test_fit_is_that_of_a_plain_one(spark, sf01):
    """Samples, prior and curve from the labels that may be learned from, in plain Python."""
    import math

    import numpy as np
    import xxhash

    docs, labels = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    model = quality.fit_documents(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learn = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert max(list(learn.values()).count(q) for q in (0, 1)) <= quality.TEXTS  # all are in the sample
    pieces = {0: [], 1: []}
    for doc_id, q in learn.items():
        raw = (texts.get(doc_id) or "").encode()
        if zlib.crc32(str(doc_id).encode()) % 4 != 3:
            pieces[q] += [(xxhash.xxh64_intdigest(p) >> 1, p) for p in (raw[i : i + quality.PIECE] for i in range(0, len(raw), quality.PIECE))]
    good, bad = ([p for _, p in sorted(pieces[q])[: quality.PIECES]] for q in (1, 0))
    assert model.good == quality.dictionary(good) and model.bad == quality.dictionary(bad)
    curve = [(plain_feature((texts[i] or "").encode(), quality.Model(model.good, model.bad)), q, len((texts[i] or "").encode())) for i, q in sorted(learn.items()) if texts.get(i) and zlib.crc32(str(i).encode()) % 4 == 3]
    assert abs(model.prior - max(0.0, float(np.quantile([f for f, q, _ in curve if q == 1], 0.25)))) < 1e-12
    x = np.array([f + quality.WEIGHT * model.prior / (n + quality.WEIGHT) for f, _, n in curve])
    y = np.array([q for _, q, _ in curve], float)
    share = [list(learn.values()).count(q) for q in (1, 0)]
    offset = model.offset - math.log((share[0] / share[1]) / (y.sum() / (len(y) - y.sum())))
    # At the optimum the penalised likelihood's slope is zero in both directions.
    scale = float(np.std(x))
    p = 1 / (1 + np.exp(-(model.slope * x + offset)))
    assert abs((y - p).sum()) < 1e-4 and abs((x / scale * (y - p)).sum() - 1e-3 * len(x) * model.slope * scale) < 1e-4


def test_clashing_columns(spark, clashing, rows, sf01):
    model = quality.fit_documents(table(spark, sf01, "documents"), table(spark, sf01, "labels"))
    assert quality.features(clashing, model).count() == len(rows)
