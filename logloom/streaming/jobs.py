"""Structured Streaming: micro-batch ingest, fan-out sinks, stateful grouping and template mining.

Delivery is at least once with idempotent sinks: a batch has a folder of its own that a
replay overwrites, and events carry (topic, partition, offset) as their id, by which
``store.upsert`` keeps one of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..plans.normalize import normalize
from ..sources.grouping import kafka_value


def kafka_source(spark: SparkSession, servers: str, topic: str = "logs.raw", batch: int = 500) -> DataFrame:
    """Messages of a topic as (raw, source, key); needs the Kafka connector on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", batch).load()
    key = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return unpack(rows.select(F.col("value").cast("string").alias("value"), key.alias("key")))


def unpack(messages: DataFrame) -> DataFrame:
    """(key, raw, source) of messages (key, value); blank ones are dropped, one message is one record."""
    m = kafka_value(F.col("value"))
    return messages.select("key", m["raw"].alias("raw"), m["source"].alias("source")).filter(strip(F.col("raw")) != "")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, **options):
    """Normalise every micro-batch and hand it to sink; offsets commit after it returns."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = normalize(df, event_id="key", **options).persist()
        try:
            sink(rows, epoch)
        finally:
            rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def fan_out(root: str) -> Callable[[DataFrame, int], None]:
    """Sink to parquet tables: normalised and dead-letter events, by batch folder, so a replay overwrites itself."""

    def sink(df: DataFrame, epoch: int) -> None:
        df.filter("parse_path <> 'dlq'").write.mode("overwrite").parquet(f"{root}/normalized/batch={epoch}")
        df.filter("parse_path = 'dlq'").write.mode("overwrite").parquet(f"{root}/dlq/batch={epoch}")

    return sink


def to_topics(servers: str) -> Callable[[DataFrame, int], None]:
    """Sink to the normalised and dead-letter topics, keyed by event id; raw text is not published again."""

    def sink(df: DataFrame, epoch: int) -> None:
        body = F.to_json(F.struct(*[c for c in df.columns if c != "raw_data"]))
        topic = F.when(F.col("parse_path") == "dlq", "logs.dlq").otherwise("logs.normalized")
        df.select(F.col("metadata.uid").alias("key"), body.alias("value"), topic.alias("topic")).write.format("kafka").option("kafka.bootstrap.servers", servers).save()

    return sink


def grouped(lines: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """Records of streamed (source, seq, line) rows: the open record of each source is kept as state.

    A record is put out when the next boundary line comes, or, where quiet_ms is given, once
    its source has been quiet for so long: then the last record of a source that ended comes out too. That
    needs a trigger that goes on (a run of what is available now would wait for ever); without it the last record stays open.
    """
    import re

    from ..sources.grouping import BOUNDARY, KEY_LINE, WRAPPER

    boundary, wrapper, keyed = (re.compile(p) for p in (BOUNDARY, WRAPPER, KEY_LINE))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_, held = state.get if state.exists else ("", "")
        if quiet_ms is not None and state.hasTimedOut:
            state.remove()
            last = (f"{held}\n{open_}" if held and open_ else held or open_).strip()
            yield pd.DataFrame([(key[0], last)] if last else [], columns=["source", "raw"])
            return
        out: list[str] = []
        for pdf in batches:
            for line in pdf.sort_values("seq")["line"]:
                if not line.strip():
                    out.append(open_)
                    open_, held = "", ""
                elif boundary.match(line):
                    out.append(open_)
                    wrap = bool(wrapper.match(line))
                    open_, held = ("", line) if wrap else ((held + "\n" + line) if held else line, "")
                elif keyed.match(line) and any(keyed.match(x) for x in open_.split("\n")):
                    out.append(open_)
                    open_ = line
                else:
                    open_, held = (open_ + "\n" + line, held) if open_ else ((held + "\n" + line) if held else line, "")
        state.update((open_, held))
        if quiet_ms is not None:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame([(key[0], r.strip()) for r in out if r.strip()], columns=["source", "raw"])

    return lines.groupBy("source").applyInPandasWithState(step, "source string, raw string", "open string, held string", "append", "NoTimeout" if quiet_ms is None else "ProcessingTimeTimeout")


def progress(query) -> dict:
    """Rows so far and rates of a query's last progress."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows", 0), "rows_per_second": last.get("processedRowsPerSecond", 0.0)}


def health(spark: SparkSession, **probes: Callable[[], bool]) -> dict:
    """State of each backend; ok if the store (or Spark itself, without one) answers."""

    def up(probe: Callable[[], bool]) -> bool:
        try:
            return bool(probe())
        except Exception:
            return False

    found = {k: up(p) for k, p in probes.items()} | {"spark": up(lambda: spark.range(1).count() == 1)}
    return {"ok": found.get("store", found["spark"]), "backends": found}
