import random

import pytest

from isobar.llm import token_counts as tc


@pytest.fixture(scope="module")
def counter():
    return tc.Counter.load()


def test_edits_leave_the_full_count(spark, sf, counter):
    rng = random.Random(2)
    library = counter._ready()[1]
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["", "a", "   ", "it's  \n x"] * 15
    bits = ["a", " ", "  ", "\n", "'", "ll", "s", "é", "1", "#", "\t", " the", "日"]
    for text in own:
        doc = tc.Document(counter, text[: rng.choice([10, 200, 3000, 30000])])
        for _ in range(8):
            a = rng.randint(0, len(doc.text))
            doc.edit(a, a + rng.choice([0, 0, 1, 2, 5, 50, 1000]), "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 10, 400]))))
            assert doc.tree.tokens == len(library.encode_ordinary(doc.text)) and doc.tree.chars == len(doc.text)


def test_small_edits_count_little(counter):
    doc = tc.Document(counter, "some words in a row " * 20000)
    doc.edit(200000, 200003, "xyz")
    assert doc.recounted < 5000


def test_edits_at_the_end_update_sums_without_a_new_tree(counter):
    library = counter._ready()[1]
    doc = tc.Document(counter, "some words in a row and more " * 3000)
    for new in ("tail", "", "a longer tail of some words here", "x"):
        doc.edit(len(doc.text) - 40, len(doc.text), new)
        assert doc.tree.tokens == len(library.encode_ordinary(doc.text)) and doc.tree.chars == len(doc.text)
    assert doc.rebuilt == 0 and doc.recounted < 4000
    doc.edit(1000, 1000, " and yet another word" * 2000)
    assert doc.rebuilt == 1 and doc.tree.tokens == len(library.encode_ordinary(doc.text))


def test_clashing_columns(clashing, rows):
    from pyspark.sql import functions as F

    own = clashing.withColumn("leaf_chars", F.lit("own")).withColumn("leaf_tokens", F.lit("own"))
    edits = F.array(F.struct(F.lit(1).alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("new")))
    assert tc.apply_edits(own.withColumn("edits", edits)).count() == len(rows) and tc.token_trees(own).count() == len(rows)


def test_query_counts_match_the_library(spark, sf, counter):
    library = counter._ready()[1]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = tc.apply_edits(tc.derived_edits(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
        assert r.n_tokens_after == len(library.encode_ordinary(r.text)) and sum(r.leaf_tokens) == r.n_tokens_after


def test_kept_trees_and_an_edit_log(spark, docs, counter):
    library = counter._ready()[1]
    one = docs.where("doc_id in (4, 9, 12)")
    trees = tc.token_trees(one)
    log = spark.createDataFrame([(4, 2, 0, 5, "Bye"), (4, 1, 3, 3, "xx"), (9, 1, 1000, 1010, None), (77, 1, 0, 0, "a")], "doc_id long, seq int, start int, end int, new string")
    out = {r.doc_id: r for r in tc.edit_trees(trees, one, log).collect()}
    assert set(out) == {4, 9}
    assert out[4].text.startswith("Bye") and all(r.n_tokens_after == len(library.encode_ordinary(r.text)) for r in out.values())


def test_rows_of_one_doc_id_keep_their_own_trees(spark, docs, counter):
    library = counter._ready()[1]
    log = spark.createDataFrame([(14, 1, 0, 5, "omega"), (6, 1, 0, 0, "x "), (None, 1, 2, 2, "new "), (1, 1, 0, 0, "now a text")], "doc_id long, seq int, start int, end int, new string")
    trees = tc.token_trees(docs)
    rows = tc.edit_trees(trees, docs, log).collect()
    texts = {}
    for r in docs.where("doc_id IN (1, 6, 14) OR doc_id IS NULL").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    change = {14: lambda t: "omega" + t[5:], 6: lambda t: "x " + t, None: lambda t: t[:2] + "new " + t[2:], 1: lambda t: "now a text"}
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_after, r.text) for r in rows) == sorted(
        (str(i), len(library.encode_ordinary(t)), len(library.encode_ordinary(change[i](t))), change[i](t)) for i, own in texts.items() for t in own
    )
    # Without a tree the text is counted anew.
    assert tc.edit_trees(trees.where("doc_id <> 14"), docs, log).count() == len(rows)


def test_edge_cases(docs, none):
    rows = tc.apply_edits(tc.derived_edits(docs)).collect()
    assert len(rows) == docs.count()
    assert tc.token_trees(none).count() == 0 and tc.apply_edits(tc.derived_edits(none)).count() == 0
