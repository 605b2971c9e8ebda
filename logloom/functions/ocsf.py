"""Event-schema scalars: classes, severity, time, coercion, IP observables, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import sqltext as F
from .columns import Pattern, Steps, guarded, lookup, some, strip
from .sqltext import Sql, of

# Class table (uid: class, category uid, category).
CLASSES = {
    1001: ("System Activity", 1, "System Activity"),
    1007: ("Process Activity", 1, "System Activity"),
    3002: ("Authentication", 3, "Identity & Access Management"),
    3005: ("Entity Management", 3, "Identity & Access Management"),
    4001: ("Network Activity", 4, "Network Activity"),
    4002: ("HTTP Activity", 4, "Network Activity"),
    6003: ("API Activity", 6, "Application Activity"),
    6005: ("Application Lifecycle", 6, "Application Activity"),
}
CONFIDENT = (1007, 3002, 3005, 4001, 4002, 6003)
# Severity words by id, and the names of ids.
SEVERITY_WORDS = {
    0: "verbose debug trace v d".split(),
    1: ["information", "informational", "info", "notice", "default", "audit success", "success", "i"],
    2: ["low"],
    3: "warning warn medium w".split(),
    4: ["error", "err", "high", "fault", "audit failure", "failure", "e"],
    5: "critical crit fatal emergency alert f".split(),
}
SEVERITY_NAMES = ["Unknown", "Informational", "Low", "Medium", "High", "Critical"]
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: Fields that normalisation consumes, so they are not kept as unmapped.
CONSUMED = ["drain3_template", "datetime", "date_time", "date", "time", "month", "day", "timestamp", "time_iso", "time_created", "level", "severity", "messageType", "message_type", "priority", "priority_label", "message"]
# Weights of the confidence stages.
WEIGHTS = {"format": 0.10, "pattern": 0.15, "source": 0.15, "parser": 0.25, "semantic": 0.20, "ocsf": 0.15}
#: Number of core slots of each family's envelope.
CORE = {"windows": 6, "linux": 6, "android": 5}


def class_uid(requested: Sql) -> Sql:
    """The requested class where it is known, else 1001."""
    uid = F.expr("1001").cast("int")
    number = requested.try_cast("int")
    return F.when(number.isin(*CLASSES), number).otherwise(uid)


def class_field(uid: Sql, at: int) -> Sql:
    return lookup({k: v[at] for k, v in CLASSES.items()}, uid, "int" if at == 1 else "string")


def severity_id(level: Sql) -> Sql:
    """Id of a level word; informational for an empty or unknown one."""
    words = {w: i for i, names in SEVERITY_WORDS.items() for w in names}
    return F.coalesce(lookup(words, F.lower(strip(level)), "int"), F.lit(1))


def severity_name(sev: Sql) -> Sql:
    return F.get(F.array(*map(F.lit, SEVERITY_NAMES)), sev)


def coerced(value: Sql) -> Sql:
    """Digits become a number (leading zeros go), all else stays text; both as text."""
    return F.when(value.rlike("^[0-9]{1,18}$"), value.cast("bigint").cast("string")).otherwise(value)


_ISO = Pattern(r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
_WHOLE = Pattern(r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}):(\d{2})(?:\.(\d{1,6}))?$")


def _iso_text(day: Sql, hm: Sql, sec: Sql, frac: Sql, zone: Sql) -> Sql:
    """Canonical ISO text, null unless it is a real time."""
    clock = F.concat(F.coalesce(hm, F.lit("00:00")), F.lit(":"), F.coalesce(sec, F.lit("00")))
    real = F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz").isNotNull()
    micro = F.rpad(F.coalesce(frac, F.lit("")), 6, "0")
    part = F.when(micro == "000000", "").otherwise(F.concat(F.lit("."), micro))
    z = F.when(zone.isNull(), "").when(zone == "Z", "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2)))
    return F.when(real, F.concat(day, F.lit("T"), clock, part, z))


def time_parts(f: dict[str, Sql]) -> dict[str, Sql]:
    """Columns that time_tries() reads: groups of the full datetime and of the ISO timestamp, and the parts of a clock time."""
    whole, iso = strip(f["datetime"]), f["timestamp"]
    clock = F.split(F.concat(strip(f["time"]), F.lit(":0:0")), ":")
    return {"_g": F.when(_WHOLE.found(whole), _WHOLE.groups(whole)), "_i": F.when(_ISO.found(iso), _ISO.groups(iso)), "_c": F.when(f["month"].isNotNull() & f["day"].isNotNull(), clock)}


def time_tries(f: dict[str, Sql], year: int) -> dict[str, Sql]:
    """The four ways to read a time, null where they don't apply: datetime, date and time, month day time, ISO text."""
    g, i, parts = F.col("_g"), F.col("_i"), F.col("_c")
    utc, nothing = F.lit("+00:00"), F.lit(None).cast("string")
    date, clock, month = f["date"], f["time"], f["month"]
    by_date = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & clock.rlike(r"^\d{2}:\d{2}:\d{2}$")
    by_name = F.coalesce(lookup({m: i + 1 for i, m in enumerate(MONTHS)}, F.substring(strip(month), 1, 3), "int"), F.lit(1))
    mm = F.when(month.rlike("^[0-9]+$"), month.try_cast("int")).otherwise(by_name)
    sec = F.split(F.get(parts, 2), r"\.")
    two = lambda c: F.lpad(c.try_cast("int").cast("string"), 2, "0")
    ymd = F.concat(F.lit(f"{year:04d}-"), two(mm), F.lit("-"), two(f["day"]))
    hms = F.concat(two(F.get(parts, 0)), F.lit(":"), two(F.get(parts, 1)))
    return {
        "_t1": guarded(g.isNotNull(), _iso_text(F.get(g, 0), F.get(g, 1), F.get(g, 2), some(F.get(g, 3)), utc)),
        "_t2": F.when(date.isNotNull() & clock.isNotNull() & by_date, _iso_text(date, F.substring(clock, 1, 5), F.substring(clock, 7, 2), nothing, utc)),
        "_t3": F.when(parts.isNotNull(), _iso_text(ymd, hms, two(F.get(sec, 0)), F.substring(F.get(sec, 1), 1, 6), utc)),
        "_t4": F.when(i.isNotNull(), _iso_text(F.get(i, 0), some(F.get(i, 1)), some(F.get(i, 2)), some(F.get(i, 3)), some(F.get(i, 4)))),
    }


def time_of(f: dict[str, Sql], reference_now: str) -> tuple[Sql, Sql]:
    """(time, original_time): the first way that gives a time, else reference_now."""
    month, day, clock, iso = f["month"], f["day"], f["time"], f["timestamp"]
    dated = F.when(month.rlike("^[0-9]+$"), F.concat(month, F.lit("-"), day, F.lit(" "), clock)).otherwise(F.concat_ws(" ", month, day, clock))
    raw = F.coalesce(strip(f["datetime"]), F.when(F.col("_c").isNotNull(), F.concat_ws(" ", month, day, clock)))
    time = F.coalesce("_t1", "_t2", "_t3", "_t4", F.lit(reference_now))
    original = F.when(F.col("_t1").isNotNull(), strip(f["datetime"])).when(F.col("_t2").isNotNull(), F.concat_ws(" ", f["date"], clock)).when(F.col("_t3").isNotNull(), dated).when(iso.isNotNull(), iso).otherwise(strip(raw))
    return time, original


def event_time(df: DataFrame, fields: str, reference_now: str, reference_year: int) -> DataFrame:
    """df with time and original_time of a column of field maps."""
    held = lambda *names: F.coalesce(*(some(F.element_at(F.col(fields), F.lit(n))) for n in names))
    names = {"datetime": ("datetime", "date_time"), "date": ("date",), "time": ("time",), "month": ("month",), "day": ("day",), "timestamp": ("timestamp", "time_iso")}
    f = {n: held(*x) for n, x in names.items()}
    time, original = time_of(f, reference_now)
    steps = Steps().withColumns(time_parts(f)).withColumns(time_tries(f, reference_year))
    return steps.on(df, {c: F.col(c) for c in df.columns} | {"time": time, "original_time": original})


# Fixed value: an address that no longer dotted run or version word just before it surrounds.
# What it is itself is tried first, so the look-behinds run only where an address stands.
ADDRESS = (
    r"(?s)(?<![\w.~])(?=\d{1,3}(?:\.\d{1,3}){3}(?![\w.~]))(?<!(?i:v)\b.{0,23})(?<!(?i:kb)\b.{0,22})(?<!(?i:ver)\b.{0,21})(?<!(?i:build)\b.{0,19})"
    r"(?<!(?i:version|package)\b.{0,17})(\d{1,3}(?:\.\d{1,3}){3})(?![\w.~])"
)


def addresses(raw):
    """IP addresses of a text in order of first sight (a Column for a Column); a cheap test spares most texts the look-behinds."""
    f = of(raw)
    found = f.regexp_extract_all(raw, f.lit(ADDRESS), f.lit(1))
    valid = f.filter(found, lambda a: f.forall(f.split(a, r"\."), lambda o: o.try_cast("int") <= 255))
    empty = f.array().cast("array<string>")
    return f.when(raw.rlike(r"\d\.\d{1,3}\.\d{1,3}\.\d"), f.array_distinct(valid)).otherwise(empty)


def observables(raw: Sql) -> Sql:
    return F.transform(addresses(raw), lambda a: F.struct(F.lit("ip").alias("name"), F.lit("IP Address").alias("type"), a.alias("value")))


def stage_scores(present: int, expected: int, extracted: int, source: bool, confident: bool) -> dict[str, float]:
    complete = min(1.0, present / expected)
    rich = min(1.0, extracted / (expected + 3))
    return {"format": 1.0, "pattern": round(0.6 + 0.4 * complete, 2), "source": 1.0 if source else 0.6, "parser": round(0.7 + 0.3 * rich, 2), "semantic": 1.0 if confident else 0.6, "ocsf": 1.0 if confident else 0.0}


def weighted(scores: dict[str, float]) -> float:
    total = 0.0
    for k, w in WEIGHTS.items():
        total += scores[k] * w
    return round(min(1.0, max(0.0, total)), 3)


def _table(values: list[float]) -> Sql:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def family_confidence(family: str, present: Sql, extracted: Sql, source_known: Sql, confident: Sql) -> dict[str, Sql]:
    """Stage scores and their aggregate, looked up in a table made at plan time (so rounding is exact)."""
    e = CORE[family]
    near = F.least(extracted, F.lit(e + 3))
    every = [weighted(stage_scores(p, e, x, s, c)) for p in range(e + 1) for x in range(e + 4) for s in (False, True) for c in (False, True)]
    at = ((present * (e + 4) + near) * 2 + source_known.cast("int")) * 2 + confident.cast("int")
    return {
        "format": F.lit(1.0),
        "pattern": F.get(_table([stage_scores(p, e, 0, True, True)["pattern"] for p in range(e + 1)]), present),
        "source": F.when(source_known, 1.0).otherwise(0.6),
        "parser": F.get(_table([stage_scores(0, e, x, True, True)["parser"] for x in range(e + 4)]), near),
        "semantic": F.when(confident, 1.0).otherwise(0.6),
        "ocsf": F.when(confident, 1.0).otherwise(0.0),
        "aggregate": F.get(_table(every), at.cast("int")),
    }
