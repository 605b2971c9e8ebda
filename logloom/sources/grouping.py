"""Physical lines to logical records, and the sources that feed them.

``group_lines`` is a fold over the lines of one text (built-in aggregate, no
Python): a boundary line opens a record, a blank line closes it, a wrapper
line ("time LEVEL [source]") is held for the next record, a Provider/EventID
line opens one only if the open record already has such a line. A text
without any boundary is one record per non-blank line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip

# Lines that start a record; lines that belong to the next one; key lines.
BOUNDARY = (
    r"(?i)^(?:\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{2,4}\s+\d{2}:\d{2}:\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
    r"|Log Name\s*:|<Event[\s>]|#(?:Fields|Version|Software)\s*:|\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}|\[\s*\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}|[VDIWEFS]/[^(]+\(\s*\d+\s*\):)"
)
WRAPPER = r"(?i)^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\s+\w+\s+\[[^\]]+\]\s*$"
KEY_LINE = r"(?i)^\s*(?:Provider|EventID)\s*="


def group_lines(text: Column) -> Column:
    """Array of the records of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit("").alias("held"), F.lit(False).alias("keyed"), F.lit(False).alias("seen"))

    def step(a: Column, line: Column) -> Column:
        closed = F.when(strip(a["open"]) == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["open"]))))
        new = lambda done, open_, held, keyed, seen: F.struct(done.alias("done"), open_.alias("open"), held.alias("held"), keyed.alias("keyed"), seen.alias("seen"))
        no, yes, empty = F.lit(False), F.lit(True), F.lit("")
        with_held = F.when(a["held"] == "", line).otherwise(F.concat_ws("\n", a["held"], line))
        key = line.rlike(KEY_LINE)
        starts = line.rlike(BOUNDARY)
        return (
            F.when(strip(line) == "", new(closed, empty, empty, no, a["seen"]))
            .when(starts & line.rlike(WRAPPER), new(closed, empty, line, no, yes))
            .when(starts, new(closed, with_held, empty, key, yes))
            .when(key & a["keyed"], new(closed, line, a["held"], yes, yes))
            .when(a["open"] != "", new(a["done"], F.concat_ws("\n", a["open"], line), a["held"], a["keyed"] | key, a["seen"]))
            .otherwise(new(a["done"], with_held, empty, key, a["seen"]))
        )

    def finish(a: Column) -> Column:
        last = F.when(a["open"] == "", a["held"]).otherwise(a["open"])
        grouped = F.when(strip(last) == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(last))))
        return F.struct(grouped.alias("records"), a["seen"].alias("seen"))

    folded = F.aggregate(lines, state, step, finish)
    plain = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.when(folded["seen"], folded["records"]).otherwise(plain)


def records(texts: DataFrame, text: str = "value", source: str | None = None) -> DataFrame:
    """seq_id (from 1 within a text), raw and raw_sha256 of each record, with the other columns of texts."""
    keep = [c for c in texts.columns if c != text]
    out = texts.select(*keep, F.posexplode(group_lines(F.col(text))).alias("pos", "raw"))
    return out.select(*keep, (F.col("pos") + 1).cast("long").alias("seq_id"), "raw", F.sha2("raw", 256).alias("raw_sha256"))


def wrap(lines: DataFrame, raw: str = "raw", order: str = "seq") -> DataFrame:
    """Non-blank rows with raw_sha256; seq_id is their order column as given."""
    return lines.filter(strip(F.col(raw)) != "").select(F.col(order).cast("long").alias("seq_id"), F.col(raw).alias("raw"), F.sha2(raw, 256).alias("raw_sha256"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Records of every text file under path, with the file's name as source."""
    return records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value")))


def batch_payload(payload: Column) -> Column:
    """Records of a batch request: {"logs": [...]}, {"jsonl": text}, a list, or plain text.

    A jsonl line that decodes to a string counts as that string, any other line as it stands.
    """
    v = F.try_parse_json(payload)
    text = F.coalesce(F.try_variant_get(v, "$.jsonl", "string"), payload)
    listed = F.coalesce(F.try_variant_get(v, "$.logs", "array<string>"), F.when(strip(payload).startswith("["), F.try_variant_get(v, "$", "array<string>")))
    line = lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)) == "STRING", F.try_variant_get(F.try_parse_json(x), "$", "string")).otherwise(x)
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), line)
    return F.coalesce(listed, lines)


def kafka_value(value: Column) -> Column:
    """(raw, source) of a message: JSON with raw_log and source, or bare text from source kafka."""
    raw = F.get_json_object(value, "$.raw_log")
    return F.struct(F.coalesce(raw, value).alias("raw"), F.when(raw.isNotNull(), F.coalesce(F.get_json_object(value, "$.source"), F.lit("kafka"))).otherwise("kafka").alias("source"))


def per_source_sample(df: DataFrame, n: int, source: str = "source", order: str = "seq_id") -> DataFrame:
    """The first n // (number of sources) rows of each source (a sampling operator: the limit is the feature)."""
    from pyspark.sql import Window as W

    kinds = df.select(source).distinct().count()
    rank = F.row_number().over(W.partitionBy(source).orderBy(order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n // max(kinds, 1)).drop("_k")
