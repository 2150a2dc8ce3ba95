import re

from isobar.llm import licenses
from tests.llm.conftest import LONG
from tests.llm.test_decontaminate import words


def brute(rows):
    def grams(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own, out = {k: grams(v) for k, v in licenses.TEMPLATES.items()}, []
    for i, t in rows:
        has = grams(t)
        out.append((str(i), sorted((k, round(len(g & has) / len(g), 6)) for k, g in own.items() if len(g & has) >= 0.8 * len(g))))
    return sorted(out)


def out_of(frame):
    return sorted((str(r.doc_id), [(x.template, round(x.containment, 6)) for x in r.licenses]) for r in frame.collect())


def more():
    out = [(100 + i, f"{LONG} {t} {LONG}") for i, t in enumerate(licenses.TEMPLATES.values())]
    broken = licenses.TEMPLATES["gpl-3.0-header"].split()
    out += [(200, " ".join(broken[:4] + ["odd"] + broken[5:])), (201, " ".join(broken[: len(broken) // 2])), (202, licenses.TEMPLATES["mit"].upper() + " " + licenses.TEMPLATES["mit"])]
    return out


def test_matches_brute_force(spark, rows):
    own = rows + more()
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    assert out_of(licenses.scan(docs, licenses.default_templates(spark))) == brute(own)


def test_joins_that_are_not_broadcast_find_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_KEYS", -1)
    own = [(i, t[:3000] if t else t) for i, t in rows] + more()
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert out_of(licenses.scan(docs, licenses.default_templates(spark))) == brute(own)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recall_of_the_bands_by_template(spark):
    """Every template with each of its words replaced, dropped or doubled in turn: pairs of 0.8 or more that are found."""
    own, i = [], 0
    for text in licenses.TEMPLATES.values():
        cut = text.split()
        for k in range(0, len(cut), max(1, len(cut) // 12)):
            for new in ([*cut[:k], "odd", *cut[k + 1 :]], cut[:k] + cut[k + 1 :], [*cut[:k], cut[k], *cut[k:]], cut[k:], cut[: len(cut) - k]):
                own.append((i := i + 1, f"{LONG} {' '.join(new)} and more"))
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    asked = {(d, name) for d, found in brute(own) for name, _ in found}
    got = {(d, name) for d, found in out_of(licenses.scan(docs, licenses.default_templates(spark))) for name, _ in found}
    assert got <= asked
    for template in licenses.TEMPLATES:
        mine = {x for x in asked if x[1] == template}
        assert len(mine & got) >= 0.99 * len(mine) and mine


def test_bands_alone_retrieve(spark):
    """Most texts without any template's windows are never verified."""
    docs = spark.createDataFrame([(1, LONG * 40), (2, licenses.TEMPLATES["mit-grant"])], "doc_id long, text string")
    found = licenses.retrieve(docs, licenses.default_templates(spark)).where("template IS NOT NULL").collect()
    assert {r.doc_id for r in found} == {2} and "mit-grant" in {r.template for r in found}


def test_clashing_columns(spark, clashing, rows):
    assert out_of(licenses.scan(clashing, licenses.default_templates(spark))) == brute(rows)


def test_main_path_runs_no_python(spark, docs):
    plan = licenses.scan(docs, licenses.default_templates(spark))._jdf.queryExecution().toString()
    assert not re.search("EvalPython|InPandas|InArrow", plan)


def test_empty(spark, none, docs):
    assert licenses.scan(none, licenses.default_templates(spark)).count() == 0
    out = licenses.scan(docs, licenses.default_templates(spark).limit(0)).collect()
    assert len(out) == docs.count() and not any(r.licenses for r in out)
