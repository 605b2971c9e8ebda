import gzip
import hashlib

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import warc as Wc

BIG = "é<p>" * 400
ROWS = [(1, "http://a/", BIG), (2, "http://b/x", BIG), (9, "http://b/y", BIG), (9, "http://b/y", BIG), (3, None, None), (4, "http://c/", ""), (5, "http://d/\r\nX: y", "small"), (6, "http://e/", "small"), (None, "http://f/", BIG), (7, "http://g/", "\r\n\r\nWARC/1.1\r\n" * 50000)]


def expected():
    out = []
    for p, _, h in ROWS:
        b = (h or "").encode()
        same = [q for q, _, g in ROWS if g == h and len(b) >= 1000]
        top = max((q for q in same if q is not None), default=None) if len(same) > 1 else None
        again = top is not None and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def _pages(spark):
    return spark.createDataFrame([(p, u, h, 0) for p, u, h in ROWS], "page_id long, url string, html string, refers_to int").repartition(3)


@pytest.mark.parametrize("split", [1 << 26, 300])
def test_round_trip(spark, tmp_path, split):
    path = f"file://{tmp_path}/w"
    Wc.archive(_pages(spark), path)
    got = Wc.load(spark, path, splitBytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected()
    assert {r.payload.decode() for r in got if r.page_id == 7} == {ROWS[-1][2]}


def test_predicates_are_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    Wc.archive(_pages(spark), path)
    assert {r.record_type for r in Wc.load(spark, path, recordTypes="revisit").collect()} == {"revisit"}
    assert {r.target_uri for r in Wc.load(spark, path, uriPrefix="http://b/").collect()} == {"http://b/x", "http://b/y"}
    assert all(r.payload is None and r.payload_bytes is not None for r in Wc.load(spark, path, payload="false").collect())
    df = Wc.load(spark, path).filter("record_type = 'response' and target_uri like 'http://c%'")
    assert [r.page_id for r in df.collect()] == [4]


def test_foreign_files(spark, tmp_path):
    rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://z/\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(rec * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(rec) * 2)
    got = Wc.load(spark, f"file://{tmp_path}").collect()
    assert [r.payload for r in got] == [b"hello"] * 5
    assert Wc.load(spark, f"file://{tmp_path}", recordTypes="response").count() == 0


def test_empty_table(spark, tmp_path):
    Wc.archive(_pages(spark).limit(0), f"file://{tmp_path}/none")
    assert Wc.load(spark, f"file://{tmp_path}/none").count() == 0
