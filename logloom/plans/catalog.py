"""Registered queries over the driver's tables and their DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ocsf, sqltext
from ..operators.registry import Registry
from ..operators.templates import mine
from ..session import spread, table
from ..sources.grouping import batch_payload, group_lines, kafka_value
from . import rules, search, store
from .normalize import normalize
from .render import FORMATS, MIX, TIME

NOW, YEAR = "2024-06-01T00:00:00+00:00", 2024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rendered(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """event_id and the raw line of every event in one format."""
    return spread(table(spark, sf_dir, "events")).select("event_id", F.expr(FORMATS[fmt][0]).alias("raw"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of the format that its id names."""
    case = " ".join(f"WHEN {i} THEN {FORMATS[n][0]}" for i, n in enumerate(MIX))
    return spread(table(spark, sf_dir, "events")).select("event_id", "ts", "user_id", F.expr(f"CASE event_id % {len(MIX)} {case} END").alias("raw"))


def events_of(rows: DataFrame, *columns: str) -> DataFrame:
    return normalize(rows, reference_now=NOW, reference_year=YEAR, columns=columns or None)


def mixed_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return events_of(mixed(spark, sf_dir), *columns)


def mix_sql(column: str, other: str = "NULL") -> str:
    """Expected value of a column over the mixed corpus."""
    case = " ".join(f"WHEN {i} THEN {FORMATS[n][1][column][1]}" for i, n in enumerate(MIX) if column in FORMATS[n][1])
    return f"CASE event_id % {len(MIX)} {case} ELSE {other} END"


def _format_query(name: str) -> None:
    _, columns = FORMATS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tops = dict.fromkeys(re.sub(r"^\w+\(", "", path).split("[")[0].split(".")[0].rstrip(")") for path, _ in columns.values())
        out = events_of(rendered(spark, sf_dir, name), *tops)
        return out.select("event_id", *(F.expr(path).cast("string").alias(c) for c, (path, _) in columns.items()))

    query(f"{name}_normalize", "SELECT event_id, " + ", ".join(f"CAST({sql} AS VARCHAR) AS {c}" for c, (_, sql) in columns.items()) + " FROM events")(run)


for _name in FORMATS:
    _format_query(_name)

def _rules_query(group: str) -> None:
    columns, _ = rules.GROUPS[group]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spread(table(spark, sf_dir, "events")).select("event_id", F.expr(rules.line(group)).alias("raw"))
        out = events_of(lines, *dict.fromkeys(path.split(".")[0] for path in columns.values()))
        return out.select("event_id", *(F.expr(path).cast("string").alias(c) for c, path in columns.items()))

    query(group, rules.oracle(group))(run)


for _name in rules.GROUPS:
    _rules_query(_name)

_BAD = "event_type IN ('error', 'signup')"


@query("linux_ssh_status_mix", f"SELECT 3002 AS class_uid, CASE WHEN {_BAD} THEN 'Failure' ELSE 'Success' END AS status, count(*) AS cnt FROM events GROUP BY 1, 2")
def linux_ssh_status_mix(spark, sf_dir):
    return events_of(rendered(spark, sf_dir, "linux_ssh"), "class_uid", "status").groupBy("class_uid", "status").agg(F.count(F.lit(1)).alias("cnt"))


@query("stats_by_parser", f"SELECT {mix_sql('parser_id')} AS parser_id, count(*) AS cnt FROM events GROUP BY 1")
def stats_by_parser(spark, sf_dir):
    return store.counts(mixed_events(spark, sf_dir, "parser_id"), "parser_id", "parser_id")


_UID = f"CAST({mix_sql('class_uid', "'1001'")} AS INT)"


@query("stats_by_class", f"SELECT {_UID} AS class_uid, count(*) AS cnt FROM events GROUP BY 1")
def stats_by_class(spark, sf_dir):
    return store.counts(mixed_events(spark, sf_dir, "class_uid"), "class_uid", "class_uid")


@query("stats_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY 1 ORDER BY day DESC LIMIT 14")
def stats_by_day(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("day")).limit(14)


@query("stats_by_source", "SELECT source, count(*) AS cnt FROM documents GROUP BY 1 ORDER BY cnt DESC, source LIMIT 20")
def stats_by_source(spark, sf_dir):
    return store.counts(table(spark, sf_dir, "documents"), "source", "source", 20)


@query("stats_totals", f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce({_UID} IN (1007, 3002, 3005, 4001, 4002, 6003), false)) AS needs_review FROM events")
def stats_totals(spark, sf_dir):
    return mixed_events(spark, sf_dir, "needs_review").agg(F.count(F.lit(1)).alias("total"), F.count_if("needs_review").alias("needs_review"))


_BUCKET = f"(SELECT {mix_sql('parser_id')} AS p FROM events)"
_BUCKETS = "CASE WHEN lower(p) LIKE '%drain3%' THEN 'drain3' WHEN lower(p) = 'dlq' THEN 'dlq' WHEN p LIKE 'FW-%' OR p LIKE 'WIN-FIREWALL-%' THEN 'firewall' WHEN p LIKE 'LINUX-%' THEN 'linux' WHEN p LIKE 'WIN-%' THEN 'windows' WHEN p LIKE 'MAC-%' THEN 'macos' ELSE 'ngre_other' END"


@query("coverage_buckets", f"SELECT {_BUCKETS} AS bucket, count(*) AS cnt, CAST(floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.0000001) AS BIGINT) AS tenths FROM {_BUCKET} GROUP BY 1")
def coverage_buckets(spark, sf_dir):
    out = store.coverage(mixed_events(spark, sf_dir, "parser_id"))
    total = F.sum("cnt").over(W.partitionBy(F.lit(1)))
    return out.select("bucket", "cnt", F.floor(F.lit(1000.0) * F.col("cnt") / total + F.lit(0.0000001)).cast("long").alias("tenths"))


@query("coverage_by_parser", f"SELECT p AS parser_id, {_BUCKETS} AS family, count(*) AS cnt FROM {_BUCKET} GROUP BY 1, 2")
def coverage_by_parser(spark, sf_dir):
    out = store.coverage_by_parser(mixed_events(spark, sf_dir, "parser_id", "parse_path").withColumn("path", F.col("parse_path")))
    return out.select("parser_id", "family", "cnt")


@query("flat_events", f"SELECT event_id AS id, {TIME} AS time, strftime(ts, '%Y-%m-%d') AS event_date, 3002 AS class_uid, 'Authentication' AS class_name, 'host' || event_id % 50 AS hostname, 'user' || user_id AS user_name, CAST(1024 + event_id % 60000 AS INT) AS src_port, '' AS dst_ip, 0 AS dst_port FROM events")
def flat_events(spark, sf_dir):
    out = normalize(rendered(spark, sf_dir, "linux_ssh"), reference_now=NOW, reference_year=YEAR, event_id="event_id")
    flat = store.flat(out)
    zoned = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss")
    return flat.select(F.col("event_id").cast("long").alias("id"), F.concat(zoned, F.lit("+00:00")).alias("time"), F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "class_uid", "class_name", "hostname", "user_name", "src_port", "dst_ip", "dst_port")


@query("analytics_top_users", "SELECT 'user' || user_id AS user_name, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, user_name LIMIT 20")
def analytics_top_users(spark, sf_dir):
    out = events_of(rendered(spark, sf_dir, "linux_ssh"), "actor").select(F.col("actor.user.name").alias("user_name"))
    return store.counts(out.filter("user_name <> ''"), "user_name", "user_name", 20)


def _stored(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("source"), F.col("ts").alias("ingested_at"), "user_id")
    raw = e.select("event_id", "source", "ingested_at")
    normalized = e.filter("user_id % 3 <> 0").select("event_id", (F.col("user_id") % 4 + 3001).cast("int").alias("class_uid"))
    return raw, normalized


@query("event_list_page", "SELECT CAST(e.event_id AS VARCHAR) AS event_id, event_type AS source, ts AS ingested_at, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 4 + 3001 AS INT) END AS class_uid FROM events e WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
def event_list_page(spark, sf_dir):
    raw, normalized = _stored(spark, sf_dir)
    return store.page(raw, normalized, 50, 20, source="error")


@query("event_lookup", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS source, ts AS ingested_at, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 4 + 3001 AS INT) END AS class_uid FROM events WHERE event_id = 17")
def event_lookup(spark, sf_dir):
    raw, normalized = _stored(spark, sf_dir)
    return store.point(raw, normalized, "17")


@query("upsert_latest", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS event_type FROM events")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("version"), "event_type")
    return store.upsert(e, e.filter("event_id % 5 = 0").select("event_id", F.lit(2).alias("version"), F.lit("changed").alias("event_type")))


_SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("analytics_os_family", f"SELECT CASE WHEN p LIKE 'LINUX%' THEN 'Linux' WHEN p LIKE 'ANDROID%' THEN 'Android' WHEN p LIKE 'WIN%' THEN 'Windows' WHEN p LIKE 'FW%' THEN 'Network' ELSE 'Unknown' END AS os_family, count(*) AS cnt FROM (SELECT {mix_sql('parser_id')} AS p FROM events) GROUP BY 1")
def analytics_os_family(spark, sf_dir):
    return store.counts(mixed_events(spark, sf_dir, "device").select(F.col("device.os.family").alias("os_family")), "os_family", "os_family", 20)


@query("dlq_page", "SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS ingested_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 30 OFFSET 10")
def dlq_page(spark, sf_dir):
    dead = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("ingested_at"))
    return store.dlq_page(dead, 30, 10)


@query("dlq_and_normalized_counts", "SELECT count(*) FILTER (WHERE event_type = 'error') AS dlq, count(*) FILTER (WHERE user_id % 3 <> 0) AS normalized FROM events")
def dlq_and_normalized_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "ingested_at")
    hot, cold = store.tiers(e, F.expr("timestamp_ntz'2024-01-16 00:00:00'"))
    some = "user_id % 3 <> 0"
    return store.total(e.filter("event_type = 'error'"), name="dlq").crossJoin(store.total(hot.filter(some), cold.filter(some), name="normalized"))


@query("hot_cold_page", "SELECT CAST(e.event_id AS VARCHAR) AS event_id, event_type AS source, ts AS ingested_at, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 4 + 3001 AS INT) END AS class_uid FROM events e ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 40 OFFSET 25")
def hot_cold_page(spark, sf_dir):
    raw, normalized = _stored(spark, sf_dir)
    edge = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return store.page_of_tiers((raw.filter(F.col("ingested_at") >= edge), normalized), (raw.filter(F.col("ingested_at") < edge), normalized), 40, 25)


@query("tiering_split", f"SELECT CASE WHEN ts >= {_SPLIT} THEN 'hot' ELSE 'cold' END AS tier, count(*) AS cnt, min(event_id) AS least_id FROM events GROUP BY 1")
def tiering_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "ingested_at")
    hot, cold = store.tiers(e, F.expr("timestamp_ntz'2024-01-16 00:00:00'"))
    both = hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold")))
    return both.groupBy("tier").agg(F.count(F.lit(1)).alias("cnt"), F.min("event_id").alias("least_id"))


@query("hot_cold_union", "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1")
def hot_cold_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "ingested_at")
    hot, cold = store.tiers(e, F.expr("timestamp_ntz'2024-01-16 00:00:00'"))
    return store.merged(store.counts(hot, "event_type", "event_type"), store.counts(cold, "event_type", "event_type"), "event_type")


@query("hot_else_cold", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'cold' END AS tier FROM events")
def hot_else_cold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return store.hot_else_cold(e.filter("event_id % 3 = 0").withColumn("tier", F.lit("hot")), e.withColumn("tier", F.lit("cold")))


@query("compare_diff", "WITH k AS (SELECT unnest(['name', 'nation', 'segment']) AS key), v AS (SELECT key, (SELECT CASE key WHEN 'name' THEN c_name WHEN 'nation' THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END FROM customer WHERE c_custkey = 1) AS a, (SELECT CASE key WHEN 'name' THEN c_name WHEN 'nation' THEN CAST(c_nationkey AS VARCHAR) ELSE NULL END FROM customer WHERE c_custkey = 2) AS b FROM k) SELECT key, CASE WHEN key = 'segment' THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS change, a, b FROM v")
def compare_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pairs = lambda n, keys: c.filter(F.col("c_custkey") == n).select(F.explode_outer(F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value")) for k, v in keys])).alias("e")).select("e.key", "e.value")
    keys = [("name", "c_name"), ("nation", "c_nationkey"), ("segment", "c_mktsegment")]
    return store.compared(pairs(1, keys), pairs(2, keys[:2]))


@query("raw_archive_dedup", "SELECT source, count(*) AS n, min(key) AS least_key FROM (SELECT DISTINCT source, 'raw/' || source || '/' || sha256(text) || '.log' AS key FROM documents) GROUP BY 1")
def raw_archive_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("raw/"), "source", F.lit("/"), F.sha2("text", 256), F.lit(".log")).alias("key"))
    return d.distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least_key"))


@query("rate_1m", "SELECT date_trunc('minute', ts) AS start, event_type, count(*) / 60.0 AS per_second FROM events GROUP BY 1, 2")
def rate_1m(spark, sf_dir):
    return search.rate(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("latency_quantiles_5m", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1, 2")
def latency_quantiles_5m(spark, sf_dir):
    return search.quantiles(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], exact=True)


@query("latency_histogram", "SELECT " + ", ".join(f"count(*) FILTER (WHERE value <= {e:g}) AS " + f"le_{e:g}".replace(".", "_") for e in (0.5, 1.0, 5.0, 10.0, 50.0)) + ", count(value) AS le_inf FROM events")
def latency_histogram(spark, sf_dir):
    return search.histogram(table(spark, sf_dir, "events"), "value", (0.5, 1.0, 5.0, 10.0, 50.0))


@query("hit_ratio", "SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) / CAST(greatest(count(*), 1) AS DOUBLE) AS ratio FROM events GROUP BY 1")
def hit_ratio(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(search.hit_ratio(F.count_if(F.expr("user_id % 3 = 0")), F.count(F.lit(1))).alias("ratio"))


@query("pipeline_counters", f"SELECT {mix_sql('parser_id')} AS parser_id, count(*) AS ingested, count(*) FILTER (WHERE {mix_sql('parser_id')} NOT IN ('DRAIN3-FALLBACK', 'DLQ')) AS parsed, count(*) FILTER (WHERE {mix_sql('parser_id')} = 'DRAIN3-FALLBACK') AS fallback, count(*) FILTER (WHERE {mix_sql('parser_id')} = 'DLQ') AS dlq FROM events GROUP BY 1")
def pipeline_counters(spark, sf_dir):
    out = search.counters(mixed_events(spark, sf_dir, "parser_id", "source_name", "parse_path", "needs_review"))
    return out.groupBy("parser_id").agg(*[F.sum(c).alias(c) for c in ("ingested", "parsed", "fallback", "dlq")])


@query("severity_map", "SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium' WHEN '3' THEN 'Critical' WHEN '4' THEN 'Unknown' ELSE 'Informational' END AS severity FROM orders")
def severity_map(spark, sf_dir):
    level = sqltext.expr("get(array('Error', ' WARN ', 'alert', 'trace', 'nonsense'), cast(substring(o_orderpriority, 1, 1) AS int) - 1)")
    return table(spark, sf_dir, "orders").select("o_orderkey", ocsf.severity_name(ocsf.severity_id(level)).column().alias("severity"))


@query("timestamp_steps", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.120000+00:00' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE '2024-06-01T00:00:00+00:00' END AS time FROM events")
def timestamp_steps(spark, sf_dir):
    f = {0: "map('datetime', date_format(ts, 'yyyy-MM-dd HH:mm:ss'))", 1: "map('date', date_format(ts, 'yyyy-MM-dd'), 'time', date_format(ts, 'HH:mm:ss'))", 2: "map('month', date_format(ts, 'MM'), 'day', date_format(ts, 'dd'), 'time', concat(date_format(ts, 'HH:mm:ss'), '.12'))", 3: "map('timestamp', concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '+0200'))", 4: "map('timestamp', 'soon')"}
    case = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in f.items()) + " END"
    e = table(spark, sf_dir, "events").select("event_id", F.expr(case).alias("f"))
    return ocsf.event_time(e, "f", NOW, YEAR).select("event_id", "time")


@query("ip_observables", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.' || user_id % 250 || '.9' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '1.2.3.4,9.9.9.' || user_id % 250 END AS ips FROM events")
def ip_observables(spark, sf_dir):
    text = "CASE event_id % 4 WHEN 0 THEN concat('from 10.0.', user_id % 250, '.9 ok') WHEN 1 THEN concat('version 10.0.', user_id % 250, '.9') WHEN 2 THEN 'bad 999.1.1.1 and 1.2.3.4.5' ELSE concat('1.2.3.4, 9.9.9.', user_id % 250, '; again 1.2.3.4') END"
    return table(spark, sf_dir, "events").select("event_id", F.array_join(ocsf.addresses(F.expr(text)), ",").alias("ips"))


@query("confidence_breakdown", "SELECT event_id, CAST(1 AS DOUBLE) AS format, CAST(0.93 AS DOUBLE) AS pattern, CAST(1 AS DOUBLE) AS source, CAST(1 AS DOUBLE) AS parser, CAST(1 AS DOUBLE) AS semantic, CAST(1 AS DOUBLE) AS ocsf FROM events")
def confidence_breakdown(spark, sf_dir):
    return events_of(rendered(spark, sf_dir, "linux_ssh"), "confidence_breakdown").select("event_id", *[F.col(f"confidence_breakdown.{k}").alias(k) for k in ("format", "pattern", "source", "parser", "semantic", "ocsf")])


@query("provenance_status", f"SELECT CASE WHEN {mix_sql('parser_id')} = 'DRAIN3-FALLBACK' THEN 'fallback' WHEN {mix_sql('parser_id')} = 'DLQ' THEN 'failed' WHEN {_UID} IN (1007, 3002, 3005, 4001, 4002, 6003) THEN 'parsed' ELSE 'partially_parsed' END AS parse_status, count(*) AS cnt FROM events GROUP BY 1")
def provenance_status(spark, sf_dir):
    return mixed_events(spark, sf_dir, "parse_status").groupBy("parse_status").agg(F.count(F.lit(1)).alias("cnt"))


@query("fingerprint_scores", "SELECT event_id, 'FW-W3C-001' AS parser_id, CAST(1 AS DOUBLE) AS score FROM events")
def fingerprint_scores(spark, sf_dir):
    best = F.get(Registry().ranked(sqltext.col("raw")).column(), 0)
    return rendered(spark, sf_dir, "registry_filterlog").select("event_id", best["parser_id"].alias("parser_id"), best["score"].alias("score"))


@query("group_multiline", "SELECT user_id, 2 * count(*) AS n_records, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_long FROM events GROUP BY 1")
def group_multiline(spark, sf_dir):
    lines = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' start ', event_id, if(event_id % 2 = 0, '\\n  at more', ''), '\\n\\n', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' INFO [App]\\nProvider=x')"
    e = table(spark, sf_dir, "events").select("user_id", group_lines(F.expr(lines)).alias("r"))
    long = F.size(F.filter("r", lambda x: x.contains("at more")))
    return e.groupBy("user_id").agg(F.sum(F.size("r")).alias("n_records"), F.sum(long).alias("n_long"))


@query("batch_decode", "SELECT event_id, event_type || ',line ' || user_id AS logs FROM events")
def batch_decode(spark, sf_dir):
    payload = "CASE event_id % 3 WHEN 0 THEN concat('{\"logs\":[\"', event_type, '\",\"line ', user_id, '\"]}') WHEN 1 THEN concat('[\"', event_type, '\",\"line ', user_id, '\"]') ELSE concat('\"', event_type, '\"\\nline ', user_id) END"
    return table(spark, sf_dir, "events").select("event_id", F.array_join(batch_payload(F.expr(payload)), ",").alias("logs"))


@query("kafka_payload", "SELECT event_id, 'line ' || user_id AS raw, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'kafka' END AS source FROM events")
def kafka_payload(spark, sf_dir):
    value = "if(event_id % 2 = 0, concat('{\"raw_log\":\"line ', user_id, '\",\"source\":\"', event_type, '\"}'), concat('line ', user_id))"
    m = kafka_value(F.expr(value))
    return table(spark, sf_dir, "events").select("event_id", m["raw"].alias("raw"), m["source"].alias("source"))


@query("record_hashes", "SELECT doc_id, sha256(text) AS raw_sha256 FROM documents WHERE trim(text) <> ''")
def record_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", F.sha2("text", 256).alias("raw_sha256"))


_TF = "len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x = '{w}'))"
_LEN = "len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> ''))"


@query("search_bm25", f"""
WITH d AS (SELECT doc_id, {_LEN} AS len, {_TF.format(w='stupid')} AS a, {_TF.format(w='trash')} AS b FROM documents),
s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM d)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / av)), 6) AS score
FROM d, s WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def search_bm25(spark, sf_dir):
    out = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "stupid trash", 10)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("drain_templates")
def drain_templates(spark, sf_dir):
    return mine(rendered(spark, sf_dir, "fallback_template"))


@query("registry_list")
def registry_list(spark, sf_dir):
    return Registry().frame(spark)
