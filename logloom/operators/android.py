"""Android family: five logcat text layouts and JSON records."""

from __future__ import annotations

from ..functions import sqltext as F
from ..functions.columns import PAIRS, Pattern, Steps, at, by_number, first_wins, guarded, how_many, let, lookup, pairs, some, strip
from ..functions.ocsf import CONSUMED
from ..functions.sqltext import Sql
from .parsed import ALIASES, Parsed, rows

# Layouts (a head that tells the layout, and the whole record).
_P, _TS = "[VDIWEFS]", r"\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}"
HEADS = {
    "long": rf"^\[\s*{_TS}\s+\d+:\s*\d+\s+{_P}/",
    "threadtime": rf"^{_TS}\s+\d+\s+\d+\s+{_P}\s+\S",
    "time": rf"^{_TS}\s+{_P}/[^(]+\(\s*\d+\s*\):",
    "tag": rf"^{_P}/[^(]+\(\s*\d+\s*\):",
    "process": rf"^{_P}\(\s*\d+\s*\)\s",
}
LAYOUTS = {
    "long": Pattern(rf"^\[\s*(?P<timestamp>{_TS})\s+(?P<pid>\d+):\s*(?P<tid>\d+)\s+(?P<priority>{_P})/(?P<tag>[^\]]+?)\s*\]\s*$"),
    "threadtime": Pattern(rf"^(?P<timestamp>{_TS})\s+(?P<pid>\d+)\s+(?P<tid>\d+)\s+(?P<priority>{_P})\s+(?P<tag>.*?):\s?(?P<message>.*)$"),
    "time": Pattern(rf"^(?P<timestamp>{_TS})\s+(?P<priority>{_P})/(?P<tag>[^(]+?)\(\s*(?P<pid>\d+)\s*\):\s?(?P<message>.*)$"),
    "tag": Pattern(rf"^(?P<priority>{_P})/(?P<tag>[^(]+?)\(\s*(?P<pid>\d+)\s*\):\s?(?P<message>.*)$"),
    "process": Pattern(rf"^(?P<priority>{_P})\(\s*(?P<pid>\d+)\s*\)\s(?P<message>.*?)(?:\s+\((?P<tag>[^)]+)\))?$"),
}
PARSER_IDS = {"threadtime": "THREADTIME", "time": "TIME", "tag": "BRIEF", "process": "PROCESS", "long": "LONG", "json": "JSON"}
PRIORITIES = {"V": "Verbose", "D": "Debug", "I": "Info", "W": "Warning", "E": "Error", "F": "Fatal", "S": "Silent"}
# Event-log verbs (class, activity) and parts of tags.
VERBS = {"am_proc_start": (1007, "Launch"), "am_proc_died": (1007, "Terminate"), "am_kill": (1007, "Terminate"), "am_create_activity": (6005, "Launch"), "am_finish_activity": (6005, "Terminate"), "am_crash": (6005, "Crash"), "am_anr": (6005, "ANR"), "dvm_lock_sample": (1001, "Lock")}
NETWORK_TAGS = "connectivity netd wifi network dns socket tcp http okhttp volley".split()
PROCESS_TAGS = "activitymanager am_ zygote process dalvikvm art packagemanager androidruntime".split()
SERVICE = r"(?i)\bservice[_ ]?name[:=]\s*(\S+)"
#: What an envelope holds, in this order.
HEAD = "timestamp priority tag pid tid message".split()
#: Where JSON records have it, by lower-case key.
JSON_KEYS = {"timestamp": ("time", "timestamp"), "priority": ("priority", "level", "prio"), "tag": ("tag",), "pid": ("pid",), "tid": ("tid", "thread"), "message": ("message", "msg")}
#: A verdict's number: a verb's place, then network tag, process tag, default. Each has class, activity and its name.
VERDICTS = [(uid, 1, name) for uid, name in VERBS.values()] + [(4001, 6, "Traffic"), (1007, 0, "Process Activity"), (6005, 0, "Log")]


def detect(first: Sql, keys: Sql) -> Sql:
    """Layout of a record's first line; keys are the lower-case keys of its JSON object, if it is one."""
    trio = F.arrays_overlap(keys, F.array(*map(F.lit, ("priority", "level", "pid"))))
    out = F.when(F.coalesce(F.array_contains(keys, "tag") & trio, F.lit(False)), "json")
    for name, head in HEADS.items():
        out = out.when(first.rlike(head), name)
    return out


def _groups(text: Sql, first: Sql, fmt: Sql, keys: Sql, values: Sql) -> Sql:
    """The HEAD values of a record; a head may fit and the whole not (several lines): then null."""
    held = {n: F.coalesce(*(some(at(values, keys, k)) for k in names), F.lit("")) for n, names in JSON_KEYS.items()}
    letter = F.upper(F.substring(held["priority"], 1, 1))
    held["priority"] = F.when(letter.isin(*PRIORITIES), letter).otherwise("")
    out = F.when(fmt == "json", F.array(*(held[n] for n in HEAD)))
    for name, p in LAYOUTS.items():
        of = strip(first) if name == "long" else text
        out = out.when(fmt == name, F.when(p.found(of), p.groups(of, HEAD)))
    return out


def steps(out: Steps, text: str, open_: Sql) -> Parsed:
    """Adds the family's columns (null where open_ is false or the record is another's; _aok where it is this family's).

    text names the stripped record; _first its first line, _jk and _jv the keys and values of its JSON object.
    """
    t, fmt = F.col(text), F.col("_af")
    out.withColumn("_au", F.when(F.col("_jk").isNotNull(), F.transform("_jk", lambda k: F.lower(k))))
    out.withColumn("_af", guarded(open_, detect(F.col("_first"), F.col("_au"))))
    out.withColumn("_ag", guarded(fmt.isNotNull(), _groups(t, F.col("_first"), fmt, F.col("_au"), F.col("_jv"))))
    e = lambda n: some(F.get("_ag", HEAD.index(n)))
    out.withColumns({"_aok": F.col("_ag").isNotNull(), "_at": F.lower(strip(F.coalesce(e("tag"), F.lit(""))))})
    tag = F.col("_at")
    among = lambda words: let(tag, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w)))
    verb = lookup({v: i for i, v in enumerate(VERBS)}, tag, "int")
    n = len(VERBS)
    out.withColumn("_ak", F.when(F.col("_aok"), F.coalesce(verb, F.when(among(NETWORK_TAGS), n).when(among(PROCESS_TAGS), n + 1).otherwise(n + 2))))
    return _parsed(t, fmt, e)


def _parsed(t: Sql, fmt: Sql, e) -> Parsed:
    of = lambda place, kind="string": by_number(F.col("_ak"), [v[place] for v in VERDICTS], kind)
    stamp, tag, pid, tid, priority = e("timestamp"), strip(e("tag")), e("pid"), e("tid"), e("priority")
    body = strip(F.regexp_replace(t, r"\A[^\n]*\n?", ""))
    message = F.when(fmt == "long", body).when(fmt == "json", e("message")).otherwise(F.get("_ag", HEAD.index("message")))
    parts = F.split(strip(stamp), r"\s+")
    split = F.coalesce((F.size(parts) == 2) & F.get(parts, 0).contains("-"), F.lit(False))
    day = F.split(F.get(parts, 0), "-", 2)
    extra = F.filter(rows(F.col("_jk"), F.transform("_jv", strip)), lambda x: x["v"].isNotNull() & ~x["v"].isin("", "-"))
    extra = F.when(fmt == "json", extra).otherwise(F.array().cast(PAIRS))
    ek, ev = extra["k"], extra["v"]
    own = {"month": F.when(split, F.get(day, 0)), "day": F.when(split, F.get(day, 1)), "time": F.when(split, F.get(parts, 1)), "timestamp": F.when(~split, stamp), "level": priority, "tag": tag, "pid": pid, "tid": tid}
    field = lambda n: F.coalesce(*(F.coalesce(own[a], at(ev, ek, a)) if a in own else at(ev, ek, a) for a in ALIASES[n]))
    text = F.coalesce(message, at(ev, ek, "message"))
    entries = F.concat(pairs({k: own[k] for k in ("tag", "pid", "tid")}), extra)
    left = F.filter(entries, lambda x: ~F.array_contains(F.array(*map(F.lit, [*CONSUMED, "tag", "pid"])), x["k"]))
    named = F.array_compact(F.array(F.when(message.isNotNull(), "message"), *(F.when(c != "", k) for k, c in own.items())))
    service = F.regexp_extract(F.coalesce(text, F.lit("")), SERVICE, 1)
    block = pairs({"format": fmt, "priority": priority, "priority_label": lookup(PRIORITIES, priority), "tag": tag, "pid": pid, "tid": tid, "timestamp": stamp, "message": message, "service_name": service})
    noted = F.transform(extra, lambda x: F.struct(F.concat(F.lit("extra."), x["k"]).alias("k"), x["v"].alias("v")))
    uid = of(0, "int")
    process = (uid == 1007) | (F.col("_ak") == len(VERBS) + 1)
    return Parsed(
        {
            "format": fmt, "parser_id": F.concat(F.lit("ANDROID-LOGCAT-"), lookup(PARSER_IDS, fmt)), "source_name": "Android logcat", "product": "Android logcat", "os_family": "Android", "class_uid": uid,
            "category": F.when(process, "Process Activity").when(uid == 4001, "Network Activity").otherwise("Application Activity"), "activity_id": of(1, "int"), "activity_name": of(2),
            "unmapped": first_wins(left), "n_mapped": how_many(tag, pid, text), "n_fields": F.size(F.array_distinct(F.concat(named, ek))), "core": how_many(stamp, priority, tag, pid, message), "native": first_wins(F.concat(block, noted)),
        },
        {n: field(n) for n in ("datetime", "date", "month", "day", "time", "timestamp", "level")} | {"text": text, "message": some(text), "actor.process.name": some(tag), "actor.process.pid": pid},
    )
