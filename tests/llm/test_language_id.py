import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from isobar.llm import language_id as lid
from isobar.llm.text import table


def test_held_out_accuracy(spark, sf01):
    docs = table(spark, sf01, "documents")
    rows = lid.op3_language_id(spark, sf01).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    # What the classifier rejects is the exception.
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_edge_cases(docs, spark, sf01):
    model = lid.fit_documents(table(spark, sf01, "documents"))
    out = {str(r.doc_id): r for r in lid.predict(docs, model).collect()}
    for i in ("1", "2", "3", "11"):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out["9"].lang_pred in model.langs and not out["9"].rejected is None
    assert model.predict("これは日本語の文章です。とても長いので拒否されるはずです。")[2]


def test_nothing_learned(docs, none):
    model = lid.fit_documents(none)
    assert {r.lang_pred for r in lid.predict(docs, model).collect()} == {"und"}
    assert lid.predict(none, model).count() == 0


def grams(text):
    """Hashed bins of the 2-, 3- and 4-grams of the cleaned text's bytes, counted one by one."""
    letters = "".join(c if c.isalpha() or (c.isalnum() and not c.isdigit() and c == "_") else " " for c in text.lower())
    raw = f" {' '.join(letters.split())} ".encode()
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "little")
            out[((code + n) * 2654435761 & 0xFFFFFFFF) >> 17] += 1
    return out


def test_predictions_match_brute_force(spark, sf01):
    docs = table(spark, sf01, "documents")
    model = lid.fit_documents(docs)
    centroids, langs, radius = model.centroids.astype(float), model.langs, model.radius
    own = docs.where("length(text) < 4000").limit(150).unionByName(docs.where("length(text) >= 30000").limit(2))
    texts = {r.doc_id: r.text for r in own.collect()}
    for r in lid.predict(own, model).collect():
        text = texts[r.doc_id]
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        counts = grams(text)
        w = {k: (1 + math.log(n)) * model.idf[k] for k, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        cosines = [sum(x * c[k] for k, x in w.items()) / norm for c in centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        assert abs(r.score - cosines[best]) < 1e-5 and (r.lang_pred == langs[best] or abs(max(cosines) - cosines[langs.index(r.lang_pred)]) < 1e-5)
        bound = 1 - radius[best, len(counts).bit_length()]
        assert r.rejected == (cosines[best] < bound) or abs(cosines[best] - bound) < 1e-5


def test_centroids_are_means_of_their_own_texts(spark, sf01):
    docs = table(spark, sf01, "documents")
    model = lid.fit_documents(docs)
    assert (abs(np.linalg.norm(model.centroids, axis=1) - 1) < 1e-4).all()
    # The clusters' fixed point: a centroid is the normalised mean of the rows nearest to it.
    rng = np.random.default_rng(1)
    rows = np.abs(rng.normal(size=(60, 40)))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = lid._clusters(rows, 3)
    nearest = np.argmax(rows @ found.T, axis=1)
    means = np.stack([rows[nearest == i].mean(axis=0) for i in range(3)])
    assert np.allclose(found, means / np.linalg.norm(means, axis=1, keepdims=True), atol=1e-2)


def test_every_language_is_learned_and_parts_do_not_matter(spark, sf01, monkeypatch):
    docs = table(spark, sf01, "documents").where("length(text) < 2000")
    # 12 labels from each real one: by a hash of the first letters.
    many = docs.withColumn("lang", F.concat("lang", (F.crc32(F.substring("text", 1, 3)) % 12).cast("string")))
    whole = lid.fit_documents(many)
    monkeypatch.setattr(lid, "PART", 7)
    split = lid.fit_documents(many)
    assert whole.parts == 1 and split.parts > lid.HELD and set(split.langs) == set(whole.langs)
    assert set(whole.langs) == {r.lang for r in many.where(~lid.held_out() & F.col("text").rlike(r"\p{L}")).select("lang").distinct().collect() if r.lang}
    rows = lambda m: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9), r.rejected) for r in lid.predict(many.where("doc_id < 300"), m).collect())
    assert rows(whole) == rows(split)


def test_labels_and_ids_are_no_inputs(spark, sf01):
    docs = table(spark, sf01, "documents").where("length(text) < 3000")
    model = lid.fit_documents(docs)
    other = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    rows = lambda df, less: sorted((r.doc_id - less, r.lang_pred, r.score, r.rejected) for r in lid.predict(df, model).collect())
    assert rows(docs, 0) == rows(other, 1_000_000)
    # Held-out labels teach nothing: other labels there leave the model as it is.
    lied = docs.withColumn("lang", F.when(lid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = lid.fit_documents(lied.repartition(5))
    assert (again.centroids == model.centroids).all() and again.langs == model.langs and (again.radius == model.radius).all()


def test_stage_keeps_all_columns(spark, clashing, sf01):
    model = lid.fit_documents(table(spark, sf01, "documents"))
    out = lid.drop_rejected(clashing, model)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == clashing.columns and 11 not in kept and 1 not in kept


STRANGE = {
    "letters": " ".join("".join(chr(97 + (i * i * 7919 + j * 104729 + i * j * 31) % 26) for j in range(3 + i % 7)) for i in range(200)),
    "base64": base64.b64encode(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(30))).decode(),
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "code": 'int main(int argc, char **argv) { for (int i = 0; i < argc; ++i) printf("%s\\n", argv[i]); return 0; }\nstatic inline void *xmalloc(size_t n) { void *p = malloc(n); if (!p) abort(); return p; }',
}


def test_strange_texts_are_rejected_and_held_out_ones_stay(spark, sf01):
    docs = table(spark, sf01, "documents")
    model = lid.fit_documents(docs)
    assert {name: model.predict(text)[2] for name, text in STRANGE.items()} == dict.fromkeys(STRANGE, True)
    held = docs.where(lid.held_out() & docs.lang.isNotNull() & docs.text.rlike(r"\p{L}"))
    rows = lid.predict(held, model).collect()
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_texts_without_letters_teach_nothing(spark, sf01):
    docs = table(spark, sf01, "documents")
    blank = spark.createDataFrame([(-i, f"{i} {i * i} !?", "en", "s", 9) for i in range(1, 300)], docs.schema)
    model, plain = lid.fit_documents(docs.unionByName(blank)), lid.fit_documents(docs)
    assert model.langs == plain.langs and (model.centroids == plain.centroids).all() and (model.radius == plain.radius).all()
