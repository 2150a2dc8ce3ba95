import hashlib
from collections import defaultdict

from isobar.llm import line_dedup
from tests.llm.conftest import lower


def brute(rows):
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20 and doc is not None:
                holders[key(x)].add(doc)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == doc]
        out.append((str(doc), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def out_of(frame):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in frame.collect())


MORE = [(20, "日本語のとても長い行がここにありますよねえそうですね\nx"), (21, " 日本語のとても長い行がここにありますよねえそうですね\t\ny"), (22, "日本語のとても長い行がここにありますよねえそうですね"), (23, "日本語の短い行"), (24, "日本語の短い行"), (25, "日本語の短い行"), (None, "hello world, this is a line that is long enough")]


def test_matches_brute_force(spark, rows):
    all_rows = rows + MORE
    frame = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
    assert out_of(line_dedup.dedup_lines(frame)) == brute(all_rows)


def test_routed_probes_give_the_same(spark, rows):
    all_rows = rows + MORE
    frame = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
    assert out_of(line_dedup.dedup_lines(frame, broadcast_keys=0)) == brute(all_rows)


def test_shards_of_lines_that_do_not_repeat_are_salted(spark, monkeypatch):
    from isobar.llm import mph

    monkeypatch.setattr(mph, "SHARD_ROWS", 40)
    rows = [(None if i % 5 == 0 else i, f"a shared line of more than twenty\n{i} a line of its own that is long enough\n" * 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert out_of(line_dedup.dedup_lines(frame, broadcast_keys=0)) == brute(rows)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = [(i, "\n".join(f"this is shared line number {j:04d}" for j in range(i % 7, 150))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert out_of(line_dedup.dedup_lines(frame)) == brute(rows)
    assert out_of(line_dedup.dedup_lines(frame, broadcast_keys=0)) == brute(rows)


def test_empty(none, clashing):
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(clashing).count() == clashing.count()
