"""Tables of raw, normalised and dead-letter events: upsert, lookup, pages, statistics, tiers, export, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Column types of the stored tables.
RAW = "event_id string, source string, raw_log string, raw_sha256 string, ingested_at timestamp"
NORMALIZED = "event_id string, parser_id string, confidence double, class_uid int, needs_review boolean, normalized string, path string"
DLQ = "event_id string, raw_log string, error string, ingested_at timestamp"


def upsert(table: DataFrame, changes: DataFrame, key: str = "event_id", version: str = "version") -> DataFrame:
    """One row a key: the highest version; a hash aggregate, so a hot key is summed up before it is moved."""
    rows = table.unionByName(changes)
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(version, *[c for c in others if c != version])).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).select(*rows.columns)


def point(raw: DataFrame, normalized: DataFrame, event_id: str) -> DataFrame:
    """The raw row of an event with its normalised row, if any; the filter reaches both scans."""
    return raw.filter(F.col("event_id") == event_id).join(normalized.filter(F.col("event_id") == event_id), "event_id", "left")


def hot_else_cold(hot: DataFrame, cold: DataFrame, key: str = "event_id") -> DataFrame:
    """All hot rows, and the cold rows whose key is not hot."""
    return hot.unionByName(cold.join(hot.select(key), key, "left_anti"))


def page(raw: DataFrame, normalized: DataFrame, limit: int, offset: int = 0, source: str | None = None, class_uid: int | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Newest events first, filtered, a page of them (the limit is the feature)."""
    rows = raw.join(normalized, "event_id", "left")
    for c in (source and (F.col("source") == source), class_uid and (F.col("class_uid") == class_uid), since is not None and (F.col("ingested_at") >= since), until is not None and (F.col("ingested_at") <= until)):
        rows = rows.filter(c) if isinstance(c, Column) else rows
    return rows.orderBy(F.desc("ingested_at"), "event_id").offset(offset).limit(limit)


def dlq_page(dead: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest dead-letter rows first, a page of them (the limit is the feature)."""
    return dead.orderBy(F.desc("ingested_at"), "event_id").offset(offset).limit(limit)


def total(*tables: DataFrame, name: str = "total") -> DataFrame:
    """One row: the rows of all the tables (tiers of dead-letter or normalised events)."""
    out = None
    for t in tables:
        one = t.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.sum(name).alias(name))


def page_of_tiers(hot: tuple[DataFrame, DataFrame], cold: tuple[DataFrame, DataFrame], limit: int, offset: int = 0, **filters) -> DataFrame:
    """A page over both tiers, each (raw, normalized): no tier gives more than the page's end."""
    first = [page(raw, normalized, limit + offset, **filters) for raw, normalized in (hot, cold)]
    return first[0].unionByName(first[1]).orderBy(F.desc("ingested_at"), "event_id").offset(offset).limit(limit)


def move_tier(spark: SparkSession, hot: str, cold: str, now: Column, hours: int = 24, most: int = 1000) -> int:
    """One pass that moves the oldest rows past their age from the hot to the cold table (Parquet folders); returns their number.

    Rows of the cold table are known by event_id, so a pass that broke off after the append moves nothing twice.
    """
    rows = spark.read.parquet(hot)
    _, old = tiers(rows, now, hours)
    chosen = old.orderBy("ingested_at", "event_id").limit(most).select("event_id")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(hot).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moved = rows.join(F.broadcast(chosen), "event_id", "left_semi")
    if files.exists(path(cold)):
        moved = moved.join(spark.read.parquet(cold).select("event_id"), "event_id", "left_anti")
    moved.write.mode("append").parquet(cold)
    gone = spark.read.parquet(cold).select("event_id")
    n = rows.join(gone, "event_id", "left_semi").count()
    rows.join(gone, "event_id", "left_anti").write.mode("overwrite").parquet(f"{hot}.next")
    files.delete(path(hot), True)
    files.rename(path(f"{hot}.next"), path(hot))
    return n


def counts(df: DataFrame, by: str | Column, name: str, top: int | None = None) -> DataFrame:
    """name, cnt by descending count (ties by name), the first top of them if given."""
    column = F.col(by) if isinstance(by, str) else by
    out = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), name)
    return out.limit(top) if top else out


def coverage_bucket(parser_id: Column) -> Column:
    """Family bucket of a parser id, in this order."""
    starts = parser_id.startswith
    return (
        F.when(F.lower(parser_id).contains("drain3"), "drain3").when(F.lower(parser_id) == "dlq", "dlq").when(starts("FW-"), "firewall").when(starts("WIN-FIREWALL-"), "firewall")
        .when(starts("LINUX-"), "linux").when(starts("WIN-"), "windows").when(starts("MAC-"), "macos").otherwise("ngre_other")
    )


def coverage(df: DataFrame, parser_id: str = "parser_id") -> DataFrame:
    """bucket, cnt, pct (one decimal, half even) of all rows; one shuffle of the few buckets."""
    per = df.groupBy(coverage_bucket(F.col(parser_id)).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(W.partitionBy(F.lit(1)))
    return per.select("bucket", "cnt", F.bround(F.lit(100.0) * F.col("cnt") / total, 1).alias("pct"))


def coverage_by_parser(df: DataFrame) -> DataFrame:
    """family, parser_id, path, cnt and share of its family."""
    per = df.groupBy(coverage_bucket(F.col("parser_id")).alias("family"), "parser_id", "path").agg(F.count(F.lit(1)).alias("cnt"))
    return per.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy("family")))


def merged(hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Sums of per-tier counts (exact: not the merge of per-tier top lists)."""
    return hot.unionByName(cold).groupBy(key).agg(F.sum("cnt").alias("cnt"))


def tiers(df: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(stay hot, go cold) by age; both filters reach the scan."""
    edge = now - F.expr(f"INTERVAL {hours} HOURS")
    return df.filter(F.col("ingested_at") >= edge), df.filter(F.col("ingested_at") < edge)


def flat(events: DataFrame) -> DataFrame:
    """Typed columns for analytics of normalised events; empty text and 0 stand for nothing, event_ts is the event's own time."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    num = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0))
    ts = F.coalesce(F.try_to_timestamp(F.col("time")), F.try_to_timestamp(F.substring("time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return events.select(
        F.col("metadata.uid").alias("event_id"), ts.alias("event_ts"), F.to_date(ts).alias("event_date"), "class_uid", "class_name", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "severity",
        text("status").alias("status"), "status_id", text("message").alias("message"), text("device.hostname").alias("hostname"), text("device.os.name").alias("os_name"), text("device.os.family").alias("os_family"),
        text("actor.user.name").alias("user_name"), text("actor.process.name").alias("process_name"), num("actor.process.pid").alias("pid"), text("actor.process.cmd_line").alias("cmd_line"),
        text("src_endpoint.ip").alias("src_ip"), num("src_endpoint.port").alias("src_port"), text("dst_endpoint.ip").alias("dst_ip"), num("dst_endpoint.port").alias("dst_port"), text("connection_info.protocol_name").alias("protocol"),
        "parser_id", text("source_name").alias("source"), "confidence", "parse_path", "parse_status", "needs_review", F.to_json("unmapped").alias("extra_fields"),
    )


def write_flat(events: DataFrame, path: str) -> None:
    """Flat table by day; rows are ranged by time so files prune on it."""
    flat(events).repartitionByRange("event_date", "event_ts", "class_uid").sortWithinPartitions("event_ts", "class_uid", "parser_id").write.mode("append").partitionBy("event_date").parquet(path)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, change, a, b of two one-row key/value frames (key, value): added, removed, changed or same, by value."""
    rows = a.withColumnRenamed("value", "a").withColumn("in_a", F.lit(True)).join(b.withColumnRenamed("value", "b").withColumn("in_b", F.lit(True)), "key", "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return rows.select("key", change.alias("change"), "a", "b")


def archive(raw: DataFrame, path: str) -> None:
    """Content-addressed raw archive by source and day; equal records are kept once, in one run or in several."""
    keyed = raw.dropDuplicates(["source", "raw_sha256"]).withColumn("day", F.date_format("ingested_at", "yyyy-MM-dd"))
    spark = raw.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        keyed = keyed.join(spark.read.parquet(path).select("source", "raw_sha256"), ["source", "raw_sha256"], "left_anti").select(*keyed.columns)
    keyed.write.mode("append").partitionBy("source", "day").parquet(path)


def archive_key(source: Column, at: Column, sha: Column) -> Column:
    return F.concat(F.lit("raw/"), source, F.lit("/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), sha, F.lit(".log"))


def export(events: DataFrame, path: str, kind: str, limit: int = 100_000) -> None:
    """Newest events as json, csv (nested columns as JSON text) or parquet."""
    rows = events.orderBy(F.desc("ingested_at"), "event_id").limit(limit)
    if kind == "csv":
        rows = rows.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in rows.dtypes])
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").format(kind).save(path)


def replay(raw: DataFrame, condition: Column | None = None, **options) -> DataFrame:
    """The raw rows that fit, normalised by the current parsers."""
    from .normalize import normalize

    return normalize(raw if condition is None else raw.filter(condition), raw="raw_log", **options)
