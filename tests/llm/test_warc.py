import base64
import gzip
import hashlib
import io
import os

from isobar.llm import warc
from isobar.session import new_folder

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, "http://c/", None), (4, None, ""), (5, "http://e/", "été 日本 " * 50000), (6, "http://f/", "<p>two\r\n\r\nWARC/1.1</p>"), (7, "http://g/", "<p>one</p>")]


def made(spark, rows=PAGES, **kw):
    path = new_folder(spark, "test-warc")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, **kw)
    return path


def test_round_trip_and_revisits(spark):
    rows = {int(r.record_id.split(":")[-1][:-1]): r for r in warc.read_pages(spark, made(spark)).collect()}
    assert set(rows) == {p for p, _, _ in PAGES}
    last = {}
    for p, _, h in PAGES:
        last[h or ""] = max(p, last.get(h or "", 0))
    for p, _, h in PAGES:
        data = (h or "").encode()
        r = rows[p]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if last[h or ""] == p:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == data
        else:
            assert r.record_type == "revisit" and r.refers_to == f"<urn:isobar:page:{last[h or '']}>" and not r.payload


def test_small_payloads_may_all_be_responses(spark):
    rows = warc.read_pages(spark, made(spark, least_bytes=5)).collect()
    assert sum(r.record_type == "response" for r in rows) == 5


def test_predicates_are_pushed_and_files_bounded(spark):
    path = made(spark)
    df = warc.read_pages(spark, path).where("record_type = 'revisit' and payload_bytes >= 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.record_id for r in df.collect()) == [f"<urn:isobar:page:{i}>" for i in (1, 2, 3)]
    assert "record_type" in plan
    reader = warc.WarcReader({"path": path})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("record_id",), ("a",))]))
    assert not rest and len(reader.equal) == 2
    tiny = new_folder(spark, "test-warc")
    rows = spark.range(20).selectExpr("cast(id as string) record_id", "'response' record_type", "null target_uri", "'X' payload_digest", "1L payload_bytes", "null refers_to", "cast('p' as binary) payload")
    rows.coalesce(1).selectExpr("record_id", "record_type", "cast(target_uri as string) target_uri", "payload_digest", "payload_bytes", "cast(refers_to as string) refers_to", "payload").write.format("warc").mode("append").option("path", tiny).option("max_bytes", "1").save()
    assert len([f for f in os.listdir(tiny.removeprefix("file:")) if f.endswith(".gz")]) == 20
    assert warc.read_pages(spark, tiny).count() == 20


def test_payloads_are_stepped_over():
    big = warc.member(warc.record({"record_id": "1", "record_type": "response"}, os.urandom(1 << 20)))
    data = big + warc.member(warc.record({"record_id": "2", "record_type": "revisit"}, b"x"))

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            got = super().read(n)
            Counting.total += len(got)
            return got

    out = list(warc.read_records(Counting(data), lambda h: h["record_type"] == "revisit", True))
    assert [(h["record_id"], p) for h, p in out] == [("2", b"x")] and Counting.total < 10000
    # Plain gzip members, without lengths, are read as well, by any tool and by this one.
    plain = gzip.compress(warc.record({"record_id": "3"}, b"abc")) * 2
    assert [p for _, p in warc.read_records(io.BytesIO(plain), lambda h: True, True)] == [b"abc", b"abc"]
    assert gzip.decompress(data).count(b"WARC/1.1") >= 2


def test_empty(spark):
    assert warc.read_pages(spark, made(spark, [])).count() == 0


def test_digest_and_size_are_those_of_the_bytes_read(spark, tmp_path):
    fields = {"record_id": "<urn:page:1>", "record_type": "response", "payload_digest": "WRONG", "payload_bytes": 1}
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record(fields, b"damaged")))
    (tmp_path / "manifest.json").write_text('["a.warc.gz"]')
    (row,) = warc.described(spark, str(tmp_path)).collect()
    assert (row.payload_bytes, row.payload_digest) == (7, base64.b32encode(hashlib.sha1(b"damaged").digest()).decode())
