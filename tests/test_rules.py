import datetime as dt
import time

from pyspark.sql import functions as F

from logloom.operators.registry import Registry, held
from logloom.plans import search, store
from logloom.plans.normalize import normalize
from logloom.streaming import jobs

XML = "<Event><System><Provider Name=\"Microsoft-Windows-Security-Auditing\"/><EventID Qualifiers=\"0\">4688</EventID></System><EventData><Data Name=\"NewProcessName\"><![CDATA[x<y]]></Data><Data Name=\"CommandLine\">a&#65;b &amp;</Data></EventData></Event>"
ROWS = [
    (0, "<34>1 2003-10-11T22:14:15Z host app 12 ID47 [a [b [c [d [e]]]]] body", "message", "body"),
    (1, "<34>1 2003-10-11T22:14:15Z host app 12 ID47 [never closed body", "message", "<34>1 2003-10-11T22:14:15Z host app 12 ID47 [never closed body"),
    (2, XML, "actor.process.name", "x<y"),
    (3, XML, "actor.process.cmd_line", "aAb &"),
    (4, XML + XML, "parse_path", "drain3"),
    (5, "Jan 15 10:00:01 h sshd[1]: IN= SRC=1.1.1.1 DST=2.2.2.2 x", "parse_path", "drain3"),
    (6, "odd \x01 text", "raw_data", "odd \x01 text"),
    (7, "#Fields: date time c-ip cs-method s-ip\n2024-05-01 12:00:00 1.1.1.1 GET 2.2.2.2 more", "src_endpoint.ip", "1.1.1.1"),
    (8, None, "metadata.dlq_error", "empty record"),
]


def test_nested_adversarial_and_odd_records(spark):
    df = spark.createDataFrame([r[:2] for r in ROWS], "id int, raw string")
    paths = sorted({r[2] for r in ROWS})
    out = {r.id: r for r in normalize(df, reference_year=2024).select("id", *(F.expr(p).cast("string").alias(f"p{i}") for i, p in enumerate(paths))).collect()}
    for i, _, path, want in ROWS:
        assert out[i][f"p{paths.index(path)}"] == want, (i, out[i])


def test_wanted_columns_only_and_clashing_names(spark):
    df = spark.createDataFrame([("Jan  5 10:00:01 h app[1]: x", 7, "mine")], "raw string, time int, `p.x` string")
    row = normalize(df, columns=("parser_id", "class_uid")).first()
    assert row.asDict() == {"time": 7, "p.x": "mine", "parser_id": "LINUX-SYSLOG-RFC3164", "class_uid": 1001}


def test_scores_of_all_parsers(spark):
    r = Registry()
    from logloom.functions import sqltext

    raw = "Jul  1 09:00:55 host kernel[0]: launchd WindowServer"
    got = spark.createDataFrame([(raw,)], "raw string").select(r.ranked(sqltext.col("raw")).column().alias("x")).first().x
    assert len(got) == 23 and [s.score for s in got] == sorted((s.score for s in got), reverse=True)
    best = next(s for s in got if s.parser_id == "MAC-ULOG-001")
    assert best.score == round(0.5 + 0.1 * min(3 / (14 * 0.3), 1), 4) and got[0] == best
    assert held(r"^a\d+longer(?:x|y)z") == "longer" and held(r"\d+") == ""


def test_search_words_and_blank_queries(spark):
    docs = spark.createDataFrame([("1", "foo-bar baz"), ("2", "other")], "event_id string, message string")
    assert [r.event_id for r in search.bm25(docs, "event_id", "message", "Foo-Bar").collect()] == ["1"]
    assert search.bm25(docs, "event_id", "message", " - ").count() == 0


def test_archive_twice_and_tier_moves(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    raw = spark.createDataFrame([(str(i), "a", f"r{i}", t(i)) for i in range(6)], "event_id string, source string, raw_log string, ingested_at timestamp_ntz").withColumn("raw_sha256", F.sha2("raw_log", 256))
    for _ in range(2):
        store.archive(raw, f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 6
    hot, cold = f"{tmp_path}/hot", f"{tmp_path}/cold"
    raw.write.parquet(hot)
    now = F.expr("timestamp_ntz'2024-01-02 04:00:00'")
    assert [store.move_tier(spark, hot, cold, now, most=3) for _ in range(3)] == [3, 1, 0]
    assert sorted(r.event_id for r in spark.read.parquet(cold).collect()) == ["0", "1", "2", "3"]
    assert sorted(r.event_id for r in spark.read.parquet(hot).collect()) == ["4", "5"]


def test_last_record_of_a_quiet_source_comes_out(spark, tmp_path):
    lines = tmp_path / "lines"
    spark.createDataFrame([("f", i, x) for i, x in enumerate(["2024-01-01 00:00:00 a", "  b", "2024-01-01 00:00:01 c"])], "source string, seq long, line string").write.parquet(str(lines))
    g = jobs.grouped(spark.readStream.schema("source string, seq long, line string").parquet(str(lines)), quiet_ms=500)
    q = g.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("quiet").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(r.raw for r in spark.table("quiet").collect()) == ["2024-01-01 00:00:00 a\n  b", "2024-01-01 00:00:01 c"]
