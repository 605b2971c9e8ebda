"""normalize(): raw records to one uniform event row each.

Order: Windows, Android, Linux, registry, template mining. A family that
detects a record but cannot read it leaves it to the next. Each family is
tried only on what the ones before left (its columns are guarded), so costly
patterns run on few records; nothing here shuffles. Records that are null or
blank go to the dead-letter shape.

Every step is a projection of plain columns: helper columns of the families
first, then the family number, then each attribute by family. So whatever a
query does not select (a count by parser selects next to nothing) is pruned.
Filters on events stop at the family number, those on other columns reach the scan.

Output: the uniform event of the schema, with ``parser_id``, ``source_name``,
``candidates`` and ``native`` beside it; extra input columns pass through,
names that start with an underscore are internal.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions import ocsf
from ..functions import sqltext as F
from ..functions.columns import MAP, Steps, as_map, blank, by_number, guarded, literal_map, some, strip
from ..functions.sqltext import Sql
from ..operators import android, linux, windows
from ..operators.parsed import ATTRIBUTES, FIELDS, PATHS, Parsed, by_family
from ..operators.registry import Registry
from ..operators.templates import masked

FAMILIES = {"windows": 1, "android": 2, "linux": 3, "ngre": 4, "drain3": 5, "dlq": 6}
#: Sources that leave it open what a record comes from, beside those common to all families.
OPEN_SOURCES = {"windows": ("windows", "eventlog"), "android": ("logcat",), "linux": ("syslog",)}
STAGES = {
    "parsed": ["format_detection", "pattern_detection", "source_detection", "parser_identification", "syntax_parsing", "normalization", "ocsf_mapping"],
    "drain3": ["format_detection", "pattern_detection", "generic_parser", "drain3_fallback"],
    "dlq": ["format_detection", "pattern_detection", "parser_identification", "failed", "dlq"],
}
#: What is said of a record that holds nothing.
DEAD = "empty record"
BREAKDOWN = ("format", "pattern", "source", "parser", "semantic", "ocsf")
#: The event's top-level keys, in order.
KEYS = (
    "class_uid class_name category_uid category_name activity_id activity_name type_uid time timezone_offset severity_id severity status status_id message "
    "device actor src_endpoint dst_endpoint connection_info auth_protocol metadata observables unmapped raw_data confidence confidence_breakdown parse_path "
    "parse_stages parse_status ocsf_mapping_status needs_review"
).split()


def os_name(family: Sql) -> Sql:
    """OS name by substring, in this order ('darwin' holds 'win', so it is Windows)."""
    low = F.lower(F.coalesce(family, F.lit("")))
    mac = low.contains("mac") | low.contains("darwin") | low.contains("osx")
    return F.when(low.contains("win"), "Windows").when(low.contains("android"), "Android").when(mac, "macOS").when(low.contains("linux"), "Linux").otherwise(family)


_NOTED: dict[tuple, tuple[Steps, dict[str, Sql]]] = {}


def _parse_steps(raw: str, registry: Registry) -> tuple[Steps, dict[int, Parsed]]:
    """Steps that add the families' columns and _family; and how each family's attributes are read."""
    text, t = F.col(raw), F.col("_text")
    out = Steps().withColumns({"_open": ~F.coalesce(blank(text), F.lit(True)), "_text": strip(text)})
    obj = F.when(t.startswith("{") & t.endswith("}"), F.from_json(t, MAP))
    out.withColumns({"_first": F.substring_index(t, "\n", 1), "_json": obj})
    out.withColumns({"_jk": F.map_keys("_json"), "_jv": F.map_values("_json")})
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    open_ = F.col("_open")
    parsers = {1: windows.steps(out, raw, open_), 2: android.steps(out, "_text", open_ & no("_wok")), 3: linux.steps(out, "_text", open_ & no("_wok") & no("_aok"))}
    parsers[4] = registry.steps(out, raw, open_ & no("_wok") & no("_aok") & no("_lok"))
    family = F.when(~no("_wok"), 1).when(~no("_aok"), 2).when(~no("_lok"), 3).when(~no("_rok"), 4).when(open_, 5).otherwise(6)
    out.settle("_family", family)
    template = masked(text)
    mined = {"format": "template", "parser_id": "DRAIN3-FALLBACK", "source_name": "Unknown", "product": "Drain3 Template Miner", "os_family": "Unknown", "category": "Unclassified", "class_uid": 1001, "unmapped": as_map({"drain3_template": template}), "template": template, "confidence": F.coalesce(registry.best(text), F.lit(0.0)), "candidates": registry.ranked(text)}
    dead = {"format": "none", "parser_id": "DLQ", "source_name": "DLQ", "product": "Dead Letter Queue", "os_family": "Unknown", "category": "Unclassified", "class_uid": 1001, "severity_id": 0, "status": "Failure", "confidence": 0.0, "unmapped": literal_map({"dlq_error": DEAD})}
    return out, parsers | {5: Parsed(mined, {"text": text}), 6: Parsed(dead, {"text": F.coalesce(text, F.lit(""))})}


def normalize(df: DataFrame, raw: str = "raw", registry: Registry | None = None, reference_now: str = "1970-01-01T00:00:00+00:00", reference_year: int | None = None, event_id: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """One event row for each row of df. reference_now stands where no time can be read, reference_year where a year is missing.

    event_id names the column with each event's id; without it the record's hash is the id. ``columns`` names the event's
    columns that are wanted, all if not given: planning the others is spared (working them out is, either way).
    """
    registry = registry or Registry()
    year = reference_year or dt.datetime.fromisoformat(reference_now).year
    key = (raw, json.dumps(registry.specs, sort_keys=True), reference_now, year, event_id)
    if key not in _NOTED:
        _NOTED[key] = _event_steps(raw, registry, reference_now, year, event_id)
    steps, event = _NOTED[key]
    wanted = event if columns is None else {c: event[c] for c in columns}
    extra = {c: F.col(f"`{c}`") for c in df.columns if c != raw and c not in wanted}
    return steps.on(df, extra | wanted)


def _event_steps(raw: str, registry: Registry, reference_now: str, year: int, event_id: str | None) -> tuple[Steps, dict[str, Sql]]:
    """All steps from raw records to what the event's columns need, and those columns."""
    out, parsers = _parse_steps(raw, registry)
    family, text = F.col("_family"), F.coalesce(F.col(raw), F.lit(""))
    picked = lambda read: by_family(parsers, family, read)
    given = {f"_p_{a}": picked(lambda p, a=a: p.attribute(a) if a in p.given else None) for a in ATTRIBUTES}
    held = {f"_v_{n}": picked(lambda p, n=n: p.values.get(n)) for n in (*PATHS, *FIELDS)}
    # A literal test on every row would take the projection into whole-stage code; these are long.
    out.withColumns({k: guarded(family > 0, c) for k, c in (given | held).items() if c is not None})
    p = {a: F.col(f"_p_{a}") for a in ATTRIBUTES}
    nothing = F.lit(None).cast("string")
    value = lambda n: F.col(f"`_v_{n}`") if held[f"_v_{n}"] is not None else nothing
    num = lambda n: ocsf.coerced(value(n))
    f = {n: value(n) for n in FIELDS}
    uid = ocsf.class_uid(p["class_uid"].cast("string"))
    unmapped = F.coalesce(p["unmapped"], literal_map({}))
    out.withColumns({"_uid": uid, "_sev": F.coalesce(p["severity_id"], ocsf.severity_id(f["level"])), "_kept": unmapped, **ocsf.time_parts(f)})
    mapped, n_kept = F.coalesce(p["n_mapped"], F.lit(0)), F.size("_kept")
    coverage = F.when(mapped + n_kept > 0, F.bround(mapped / (mapped + n_kept), 3)).otherwise(0.0)
    # Numbers of the core slots filled and so on: where the stage scores stand in their tables.
    near = F.least(p["n_fields"], F.lit(max(ocsf.CORE.values()) + 3))
    out.withColumns({"_coverage": coverage, "_confident": F.col("_uid").isin(*ocsf.CONFIDENT), "_near": near, **ocsf.time_tries(f, year)})
    confident, conf = F.col("_confident"), p["confidence"]
    direct = {
        "format": F.lit(1.0), "pattern": F.bround(F.least(conf + 0.05, F.lit(1.0)), 2), "source": F.lit(1.0), "parser": F.bround(conf, 2),
        "semantic": F.bround(F.when(confident, conf).otherwise(conf * 0.6), 2), "ocsf": F.when(confident, F.bround(conf, 2)).otherwise(0.0), "aggregate": conf,
    }
    fallback = {"format": F.lit(0.5), "pattern": F.lit(0.3), "aggregate": conf}
    known = {fam: ~F.lower(strip(F.coalesce(p["product"], F.lit("")))).isin("", "unknown", "generic", "generic log", *more) for fam, more in OPEN_SOURCES.items()}
    of_family = {fam: ocsf.family_confidence(fam, p["core"], F.least(F.col("_near"), F.lit(ocsf.CORE[fam] + 3)), ok, confident) for fam, ok in known.items()}
    scores = {}
    for k in (*BREAKDOWN, "aggregate"):
        c = F.when(family == FAMILIES["ngre"], direct[k]).when(family == FAMILIES["drain3"], fallback.get(k, F.lit(0.0)))
        for fam, s in of_family.items():
            c = c.when(family == FAMILIES[fam], s[k])
        scores[f"_s_{k}"] = guarded(family > 0, c.otherwise(0.0))
    time, original = ocsf.time_of(f, reference_now)
    out.withColumns(scores | {"_time": time, "_orig": original})
    return out, _event(raw, text, family, p, value, num, event_id, reference_now)


def _event(raw: str, text: Sql, family: Sql, p: dict[str, Sql], value, num, event_id: str | None, reference_now: str) -> dict[str, Sql]:
    confident = F.col("_confident")
    deterministic = family <= FAMILIES["ngre"]
    low = (family == FAMILIES["ngre"]) & (p["confidence"] <= 0.5)
    path = by_number(family, ["", "windows-family", "android-family", "linux-family", "ngre", "drain3", "dlq"])
    stages = F.when(deterministic, F.array(*map(F.lit, STAGES["parsed"]))).when(family == FAMILIES["drain3"], F.array(*map(F.lit, STAGES["drain3"]))).otherwise(F.array(*map(F.lit, STAGES["dlq"])))
    digest = F.sha2(text, 256)
    original = F.coalesce("_orig", F.lit(""))
    rejected = F.when(p["class_uid"] != F.col("_uid"), p["class_uid"])
    product = F.struct(p["product"].alias("name"), p["os_family"].alias("vendor_name"), F.struct(p["category"].alias("name")).alias("feature"))
    metadata = F.struct(
        F.lit("1.1.0").alias("version"), (F.col(event_id) if event_id is not None else digest).cast("string").alias("uid"), p["parser_id"].alias("parser_id"), product.alias("product"),
        F.coalesce(value("metadata.log_provider"), p["product"]).alias("log_provider"), value("metadata.log_name").alias("log_name"), num("metadata.event_code").alias("event_code"), value("metadata.uid_alt").alias("uid_alt"),
        F.col("_orig").alias("original_time"), F.lit(None).cast("string").alias("ingestion_time"), F.lit(reference_now).alias("processed_time"), digest.alias("raw_sha256"),
        F.when(original.rlike(r"\b\d{4}\b"), "source").otherwise("inferred").alias("timestamp_year_source"),
        F.when(original.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$"), "source").otherwise("collector/system configuration").alias("timestamp_timezone_source"),
        rejected.alias("ocsf_class_requested"), F.concat(F.lit("unrecognized class_uid "), rejected.cast("string"), F.lit(", taken as 1001")).alias("ocsf_class_note"), p["template"].alias("drain3_template"),
        F.when(family == FAMILIES["dlq"], DEAD).alias("dlq_error"), F.when(family == FAMILIES["dlq"], F.array().cast("array<string>")).alias("attempted_parsers"),
    )
    return {
        "class_uid": F.col("_uid"), "class_name": ocsf.class_field(F.col("_uid"), 0), "category_uid": ocsf.class_field(F.col("_uid"), 1), "category_name": ocsf.class_field(F.col("_uid"), 2),
        "activity_id": F.coalesce(p["activity_id"], F.lit(0)), "activity_name": F.coalesce(p["activity_name"], F.lit("Unknown")), "type_uid": F.col("_uid") * 100,
        "time": F.col("_time"), "timezone_offset": F.lit(0), "severity_id": F.col("_sev"), "severity": ocsf.severity_name(F.col("_sev")), "status": F.coalesce(value("status"), p["status"], F.lit("Unknown")), "status_id": F.coalesce(p["status_id"], F.lit(0)),
        "message": F.coalesce(value("message"), some(value("text")), text),
        "device": F.struct(value("device.hostname").alias("hostname"), F.lit("Unknown").alias("type"), F.struct(os_name(p["os_family"]).alias("name"), p["os_family"].alias("family"), p["os_family"].alias("type")).alias("os")),
        "actor": F.struct(
            F.struct(value("actor.process.name").alias("name"), num("actor.process.pid").alias("pid"), value("actor.process.cmd_line").alias("cmd_line"), F.struct(value("actor.process.parent_process.name").alias("name"), value("actor.process.parent_process.cmd_line").alias("cmd_line")).alias("parent_process"), F.struct(value("actor.process.file.path").alias("path")).alias("file")).alias("process"),
            F.struct(num("actor.user.name").alias("name"), num("actor.user.uid").alias("uid"), value("actor.user.domain").alias("domain")).alias("user"),
        ),
        "src_endpoint": F.struct(value("src_endpoint.ip").alias("ip"), num("src_endpoint.port").alias("port"), value("src_endpoint.hostname").alias("hostname")),
        "dst_endpoint": F.struct(value("dst_endpoint.ip").alias("ip"), num("dst_endpoint.port").alias("port"), value("dst_endpoint.hostname").alias("hostname")),
        "connection_info": F.struct(value("connection_info.protocol_name").alias("protocol_name"), value("connection_info.direction").alias("direction"), F.lit(None).cast("int").alias("protocol_num")),
        "auth_protocol": value("auth_protocol"), "metadata": metadata, "observables": ocsf.observables(text), "unmapped": F.col("_kept"), "raw_data": text,
        "confidence": F.col("_s_aggregate"), "confidence_breakdown": F.struct(*(F.col(f"_s_{k}").alias(k) for k in BREAKDOWN), F.col("_coverage").alias("field_coverage")), "parse_path": path, "parse_stages": stages,
        "parse_status": F.when(family == FAMILIES["drain3"], "fallback").when(family == FAMILIES["dlq"], "failed").when(confident, "parsed").otherwise("partially_parsed"),
        "ocsf_mapping_status": F.when(deterministic & confident, "mapped").otherwise("unmapped"), "needs_review": ~deterministic | ~confident | F.coalesce(low, F.lit(False)),
        # Class-scoped extras and routing, beside the uniform keys.
        "http_request": F.struct(value("http_request.http_method").alias("http_method"), value("http_request.url.path").alias("path")), "http_response": F.struct(num("http_response.code").alias("code")),
        "finding": F.struct(value("finding.title").alias("title")), "native": F.coalesce(p["native"], literal_map({})), "parser_id": p["parser_id"], "source_name": p["source_name"], "candidates": p["candidates"],
    }
