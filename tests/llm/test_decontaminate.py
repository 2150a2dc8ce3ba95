import random
import re

from isobar.llm import decontaminate as dec
from tests.llm.conftest import LONG, lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= own
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


def out_of(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in frame.collect())


ITEMS = [(1, "Lazy dog"), (2, LONG), (3, None), (4, ""), (5, "?!"), (6, LONG.upper()), (70, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (8, "été"), (9, "nothing of this is anywhere in any of the texts that there are here")]


def test_matches_brute_force_with_short_items(spark, docs, rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert out_of(dec.decontaminate(docs, bench)) == brute(rows, ITEMS)


def test_matches_brute_force_with_long_items_only(spark, docs, rows):
    items = [x for x in ITEMS if len(words(x[1])) >= 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert out_of(dec.decontaminate(docs, bench)) == brute(rows, items)


def test_matches_brute_force_with_short_items_alone(spark, docs, rows):
    items = [(1, "lazy dog"), (2, "été")]
    assert out_of(dec.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


def test_joins_that_are_not_broadcast_find_the_same(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_PRINTS", -1)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    own = [(i, t[:3000] if t else t) for i, t in rows]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert out_of(dec.decontaminate(spark.createDataFrame(own, "doc_id long, text string"), bench)) == brute(own, ITEMS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_words_and_ties_of_minima(spark):
    rng = random.Random(4)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 14, 25]), 2 + i % 3)) for i in range(12)]
    own = [(i, text(rng.choice([0, 5, 10, 40, 90]), 2 + i % 4) + (" " + rng.choice(items)[1] if i % 3 else "") + " " + text(5, 3)) for i in range(120)]
    for chosen in (items, [x for x in items if len(x[1].split()) >= 10]):
        out = dec.decontaminate(spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(chosen, "item_id long, text string"))
        assert out_of(out) == brute(own, chosen)
        assert all(sum(s.length for s in r.spans) == r.n_hit for r in out.collect())


def test_fingerprints_are_the_distinct_minima(spark):
    rng = random.Random(5)
    frame = spark.createDataFrame([(1, " ".join(f"w{rng.randrange(5000)}" for _ in range(3000)))], "doc_id long, text string")
    found = [r["at"] for r in dec.prints_of(frame, ["doc_id"], [dec.WINDOW], header=False).collect()]
    # One at least in every window, about two in seven in all, and each once.
    assert len(found) == len(set(found)) and 0.2 * 3000 < len(found) < 0.4 * 3000
    gaps = sorted(found)
    assert gaps[0] <= dec.REACH and max(b - a for a, b in zip(gaps, gaps[1:])) <= dec.REACH + 1 and gaps[-1] >= 3000 - dec.WINDOW


def test_main_path_runs_no_python(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = dec.decontaminate(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark, none, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    out = dec.decontaminate(docs, bench).collect()
    assert len(out) == docs.count() and not any(r.contaminated for r in out)


def test_stage_drops_hit_rows_only(spark, clashing, rows):
    items = [x for x in ITEMS if len(words(x[1])) >= 10]
    out = dec.drop_contaminated(clashing, spark.createDataFrame(items, "item_id long, text string"))
    clean = sorted(d for d, _, hit, _ in brute(rows, items) if not hit)
    assert out.columns == clashing.columns and sorted(str(r.doc_id) for r in out.collect()) == clean
