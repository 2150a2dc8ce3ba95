import importlib

import corpus_pipeline
from isobar.llm import decontaminate, language_id
from isobar.llm.text import table
from tests.llm.conftest import lower
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute as components


def test_stages_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.fit_documents(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if not model.predict(r.text)[2]]
    keep = {}
    for i, t in rows:
        keep[lower(t)] = max(i, keep.get(lower(t), -1))
    rows = [(i, t) for i, t in rows if keep[lower(t)] == i]
    part = {int(d): int(c) for d, _, c in components(rows)}
    rows = [(i, t) for i, t in rows if part[i] == i]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text)
        m = min(len(w), 10)
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    sizes = {len(w) for w in windows}
    clean = []
    for i, t in rows:
        w = words(t)
        if not any(tuple(w[k : k + m]) in windows for m in sizes for k in range(len(w) - m + 1)):
            clean.append(i)
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean) and all(r.round_trip for r in out)


def test_stages_keep_columns_and_bear_odd_rows(spark, clashing, sf):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == clashing.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() <= clashing.count()


def test_stages_on_an_empty_table(spark, none, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_entry_adds_these_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert decontaminate.SQL == entry.oracle_sql()["op1_decontaminate"]
