"""Search documents, an inverted index and BM25 ranking; alert-free metrics over event rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def document(events: DataFrame) -> DataFrame:
    """The search document of normalised events."""
    return events.select(F.col("metadata.uid").alias("event_id"), "message", "raw_data", F.col("source_name").alias("source"), "parser_id", "class_uid", "severity", "time", "confidence")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda t: t != "")


def bm25(docs: DataFrame, key: str, text: str, query: str, top: int = 10) -> DataFrame:
    """key and score of the top documents for any of the query's words.

    Only rows with a query word are exploded or moved; length statistics are two sums over the scan.
    """
    words = sorted({w for w in re.split(r"\W+", query.lower(), flags=re.ASCII) if w})
    if not words:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    rows = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    hit = rows.select("key", "len", *[times(w).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = hit.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(stats["avg"] or 1.0)))
    some = [F.col(f"tf{i}") > 0 for i in range(len(words))]
    any_hit = some[0]
    for s in some[1:]:
        any_hit = any_hit | s
    return hit.filter(any_hit).select(F.col("key").alias(key), score.alias("score")).orderBy(F.desc("score"), key).limit(top)


def multi_match(docs: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Best of message and raw_data; an exact source counts as a hit of its own."""
    every = None
    for field in ("message", "raw_data"):
        one = bm25(docs, "event_id", field, query, top)
        every = one if every is None else every.unionByName(one)
    exact = docs.filter(F.col("source") == query).select("event_id", F.lit(1.0).alias("score"))
    return every.unionByName(exact).groupBy("event_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "event_id").limit(top)


def counters(events: DataFrame) -> DataFrame:
    """Counters by parser and source."""
    n = lambda c: F.count_if(c).alias
    p = F.col("parse_path")
    return events.groupBy("parser_id", F.col("source_name").alias("source")).agg(
        F.count(F.lit(1)).alias("ingested"), n(p.endswith("family") | (p == "ngre"))("parsed"), n(p == "drain3")("fallback"), n(p == "dlq")("dlq"), n(F.col("needs_review"))("review")
    )


def rate(df: DataFrame, ts: str, by: list[str], window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows."""
    return df.groupBy(F.window(ts, window).alias("w"), *by).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("per_second")).select(F.col("w.start").alias("start"), *by, "per_second")


def quantiles(df: DataFrame, ts: str, value: str, by: list[str], window: str = "5 minutes", exact: bool = False) -> DataFrame:
    """p50, p95, p99 of a value in tumbling windows: bounded sketches, or exact, which holds all values of a group."""
    q = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, p))
    return df.groupBy(F.window(ts, window).alias("w"), *by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99")).select(F.col("w.start").alias("start"), *by, "p50", "p95", "p99")


def histogram(df: DataFrame, value: str, edges=(0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """Cumulative bucket counts, one scan."""
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{e:g}".replace(".", "_")) for e in edges]
    return df.agg(*counts, F.count(value).alias("le_inf"))


def hit_ratio(hits: Column, total: Column) -> Column:
    return hits / F.greatest(total, F.lit(1))
