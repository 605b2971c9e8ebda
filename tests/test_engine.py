import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from logloom.operators import templates
from logloom.plans import search, store
from logloom.sources import extraction, grouping
from logloom.streaming import jobs

TEXT = "2024-01-01 00:00:00 INFO [App]\nProvider=a\nEventID=1\nx=1\nProvider=b\n\nJan  1 00:00:00 h p: m\n  more\n#Fields: a\n1 2"


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_grouping(spark):
    got = _one(spark, grouping.group_lines(F.lit(TEXT)))
    assert got == ["2024-01-01 00:00:00 INFO [App]\nProvider=a", "EventID=1\nx=1", "Provider=b", "Jan  1 00:00:00 h p: m\n  more", "#Fields: a\n1 2"]
    assert _one(spark, grouping.group_lines(F.lit("a\n\n b \nc"))) == ["a", "b", "c"]
    assert _one(spark, grouping.group_lines(F.lit(None).cast("string"))) == []
    assert _one(spark, grouping.group_lines(F.lit("2024-01-01 00:00:00 INFO [App]"))) == ["2024-01-01 00:00:00 INFO [App]"]
    rows = grouping.records(spark.createDataFrame([("s", TEXT)], "source string, value string")).collect()
    assert [r.seq_id for r in rows] == [1, 2, 3, 4, 5] and all(len(r.raw_sha256) == 64 for r in rows)


def test_payloads(spark):
    cases = [('{"logs": ["a", "b"]}', ["a", "b"]), ('["a"]', ["a"]), ('{"jsonl": "\\"a\\"\\n{\\"k\\": 1}\\nplain"}', ["a", '{"k": 1}', "plain"]), ("x\n\n y", ["x", " y"])]
    df = spark.createDataFrame([c[0] for c in cases], "string")
    assert [r.x for r in df.select(grouping.batch_payload(F.col("value")).alias("x")).collect()] == [c[1] for c in cases]
    m = _one(spark, grouping.kafka_value(F.lit("bare")))
    assert (m.raw, m.source) == ("bare", "kafka")


def test_extraction(spark, tmp_path):
    assert _one(spark, extraction.event_blocks(F.lit("Log Name: a\nx\n\nnothing\n\nEvent ID: 1"))) == ["Log Name: a\nx", "Event ID: 1"]
    (tmp_path / "a.evtx").write_bytes(b"ElfFile")
    row = extraction.read_evtx(spark, str(tmp_path)).first()
    assert row.ok is False and row.reason
    r = _one(spark, extraction.unified_log(F.lit('{"b": 1, "timestamp": "t"}\nbad')))
    assert r[0].record.startswith('{"timestamp": "t", "messageType": null') and r[0].record.endswith('"b": 1}') and r[1].error
    assert [x.record for x in _one(spark, extraction.unified_log(F.lit("line a\n\nline b")))] == ["line a", "line b"]
    assert _one(spark, extraction.unified_log(F.lit("[broken")))[0].error == "invalid json array"


def test_templates(spark):
    rows = [(f"job {i} took {i * 3} ms on node{i % 2}",) for i in range(50)] + [("disk full now",), (None,)]
    out = {r.template: r.n for r in templates.mine(spark.createDataFrame(rows, "raw string").repartition(4)).collect()}
    assert out == {"job <*> took <*> ms on <*>": 50, "disk full now": 1}
    assert templates.cluster([["a", "b", "c"], ["a", "x", "c"], ["q", "r", "s"]]) == [0, 0, 1]


def test_templates_do_not_depend_on_the_number_of_messages(spark):
    few = [(f"user {u} logged in here",) for u in ("ann", "bob", "eve")]
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05}")
    many = [(f"user zed logged in {name(i)}",) for i in range(20_001)]
    small, large = ({r.template: r.n for r in templates.mine(spark.createDataFrame(rows, "raw string")).collect()} for rows in (few, few + many))
    assert large == small | {"user zed logged in <*>": 20_001}


def test_store(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    raw = spark.createDataFrame([(str(i), "a" if i % 2 else "b", f"r{i}", t(i)) for i in range(10)], "event_id string, source string, raw_log string, ingested_at timestamp_ntz")
    norm = raw.filter("event_id < '5'").select("event_id", F.lit(3002).alias("class_uid"))
    got = store.page(raw, norm, 2, 1, source="a").collect()
    assert [r.event_id for r in got] == ["7", "5"] and got[0].class_uid is None
    assert store.page(raw, norm, 10, class_uid=3002).count() == 5
    hot, cold = store.tiers(raw, F.expr("timestamp_ntz'2024-01-01 06:00:00'"), 3)
    assert hot.count() == 7 and cold.count() == 3
    cov = {r.bucket: r.pct for r in store.coverage(spark.createDataFrame([("LINUX-X",), ("WIN-FIREWALL-001",), ("ANDROID-X",)], "parser_id string")).collect()}
    assert cov == {"linux": 33.3, "firewall": 33.3, "ngre_other": 33.3}
    for kind in ("json", "csv", "parquet"):
        store.export(raw, f"{tmp_path}/{kind}", kind, 4)
        reader = spark.read.option("header", True)
        assert reader.format(kind).load(f"{tmp_path}/{kind}").count() == 4
    store.archive(raw.unionByName(raw).withColumn("raw_sha256", F.sha2("raw_log", 256)), f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 10
    out = store.replay(raw, F.col("source") == "a", reference_year=2024)
    assert out.count() == 5
    store.write_flat(out.withColumn("time", F.lit("2024-01-01T00:00:00+00:00")), f"{tmp_path}/flat")
    assert spark.read.parquet(f"{tmp_path}/flat").count() == 5


def test_search(spark):
    docs = spark.createDataFrame([("1", "alpha beta", "alpha", "s"), ("2", "beta beta gamma", "x", "q"), ("3", "none", "y", "alpha")], "event_id string, message string, raw_data string, source string")
    assert [r.event_id for r in search.bm25(docs, "event_id", "message", "beta").collect()] == ["2", "1"]
    assert {r.event_id for r in search.multi_match(docs, "alpha").collect()} == {"1", "3"}


def test_streaming_ingest_and_grouping(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("k1", "Jan  5 10:00:01 h sshd[1]: Accepted password for al from 1.1.1.1 port 5 ssh2"), ("k2", '{"raw_log":"odd text","source":"app"}'), ("k3", " ")], "key string, value string").write.parquet(str(src))
    stream = jobs.unpack(spark.readStream.schema("key string, value string").parquet(str(src)))
    q = jobs.run(stream, jobs.fan_out(str(tmp_path / "out")), str(tmp_path / "cp"), once=True, reference_year=2024)
    q.awaitTermination(90)
    rows = {r.uid: r.parse_path for r in spark.read.parquet(f"{tmp_path}/out/normalized").select("metadata.uid", "parse_path").collect()}
    assert rows == {"k1": "linux-family", "k2": "drain3"}
    assert jobs.progress(q)["rows"] in (0, 2, 3) and jobs.health(spark)["ok"]
    lines = tmp_path / "lines"
    spark.createDataFrame(pd.DataFrame([("f", i, x) for i, x in enumerate(["2024-01-01 00:00:00 a", "  b", "2024-01-01 00:00:01 c", "", "d"])], columns=["source", "seq", "line"])).write.parquet(str(lines))
    g = jobs.grouped(spark.readStream.schema("source string, seq long, line string").parquet(str(lines)))
    q = g.writeStream.format("memory").queryName("grouped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.raw for r in spark.table("grouped").collect()) == ["2024-01-01 00:00:00 a\n  b", "2024-01-01 00:00:01 c"]
