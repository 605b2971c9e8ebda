"""Extraction of records from exported artifacts: event-log text and binary, macOS unified logs."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lookup, strip

# Raw attribute to viewer label; canonical keys of unified-log JSON.
LABELS = {
    "TargetUserName": "Account Name", "SubjectUserName": "Account Name", "TargetDomainName": "Account Domain", "SubjectDomainName": "Account Domain", "LogonType": "Logon Type", "IpAddress": "Source Network Address", "IpPort": "Source Port",
    "NewProcessName": "New Process Name", "NewProcessId": "New Process ID", "CommandLine": "Process Command Line", "ParentProcessName": "Creator Process Name", "FailureReason": "Failure Reason",
}
CANONICAL = ("timestamp", "messageType", "eventMessage", "processImagePath", "processID", "subsystem", "category")


def event_blocks(text: Column) -> Column:
    """Blocks parted by blank lines that have a Log Name or Event ID line."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda b: b.rlike(r"(?m)^(?:Log Name:|Event ID:)"))


def label(attribute: Column) -> Column:
    return F.coalesce(lookup(LABELS, attribute), attribute)


def xml_to_block(xml: Column) -> Column:
    """Event XML as a labelled text block."""
    from ..operators.windows import event_xml

    e = event_xml(xml)
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c))
    head = [line(n, e[k]) for n, k in (("Log Name", "channel"), ("Source", "provider"), ("Date", "timestamp"), ("Event ID", "event_id"), ("Level", "level"), ("Computer", "computer"))]
    data = F.transform(F.map_entries(e["data"]), lambda x: F.concat(label(x["key"]), F.lit(": "), x["value"]))
    return F.when(e.isNotNull(), F.concat_ws("\n", *head, F.array_join(data, "\n")))


def read_evtx(spark: SparkSession, path: str) -> DataFrame:
    """file, ok, reason, block of binary event logs; without a decoder library each file is reported as not available."""
    files = spark.read.format("binaryFile").load(path)
    if importlib.util.find_spec("Evtx") is None:
        return files.select(F.col("path").alias("file"), F.lit(False).alias("ok"), F.lit("no evtx decoder is installed").alias("reason"), F.lit(None).cast("string").alias("block"))

    def decode(batches):
        import os
        import tempfile

        import pandas as pd
        from Evtx.Evtx import Evtx

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with tempfile.NamedTemporaryFile(delete=False) as f:
                    f.write(content)
                out = []
                with Evtx(f.name) as log:
                    for r in log.records():
                        try:
                            out.append((name, True, None, r.xml()))
                        except Exception as e:  # a broken record is reported, the rest goes on
                            out.append((name, False, str(e), None))
                os.unlink(f.name)
                yield pd.DataFrame(out, columns=["file", "ok", "reason", "block"])

    out = files.select("path", "content").mapInPandas(decode, "file string, ok boolean, reason string, block string")
    return out.withColumn("block", xml_to_block(F.col("block")))


def unified_record(line: Column) -> Column:
    """A JSON object with the canonical keys first (null where absent), the other keys as they come; null for other text."""
    obj = F.from_json(line, "map<string,string>")
    literal = lambda k: F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(line), f"$.{k}", "variant")), F.lit("null"))
    head = [F.concat(F.lit(f'"{k}": '), literal(k)) for k in CANONICAL]
    v = F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>")
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    rest = F.transform(F.map_entries(F.map_filter(v, lambda k, x: ~k.isin(*CANONICAL))), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.to_json(e["value"])))
    return F.when(obj.isNotNull() & strip(line).startswith("{"), F.concat(F.lit("{"), F.concat_ws(", ", *head, F.array_join(rest, ", ")), F.lit("}")))


def unified_log(text: Column) -> Column:
    """Array of (record, error) of a unified-log export: a JSON array, one object a line, or syslog-style lines."""
    first = F.substring(F.ltrim(strip(text)), 1, 1)
    elements = F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), lambda x: F.to_json(x))
    lines = F.filter(F.transform(F.split(text, "\r\n|\n"), strip), lambda x: x != "")
    pair = lambda r, e: F.struct(r.cast("string").alias("record"), e.cast("string").alias("error"))
    null = F.lit(None)
    read = lambda x, why: F.when(unified_record(x).isNull(), pair(null, F.lit(why))).otherwise(pair(unified_record(x), null))
    return (
        F.when(first == "[", F.coalesce(F.transform(elements, lambda x: read(x, "array element is not an object")), F.array(pair(null, F.lit("invalid json array")))))
        .when(first == "{", F.transform(lines, lambda x: read(x, "line is not a json object")))
        .otherwise(F.transform(lines, lambda x: pair(x, null)))
    )
