"""Windows family: event text blocks, key=value exports, event XML, IIS and firewall rows."""

from __future__ import annotations

from ..functions import sqltext as F
from ..functions.columns import Steps, at, by_number, first_wins, guarded, how_many, let, lookup, pairs, some, strip
from ..functions.ocsf import CONSUMED
from ..functions.sqltext import Sql
from .parsed import ALIASES, Parsed, rows

# Detection patterns, header labels and attribute names, column orders, label tables.
XML = r"(?s)<Event[\s>].*</Event>"
HEADER_LINE = r"(?m)^\s*(Log Name|Source|Event ID|Level|Computer|Task Category|Keywords)\s*:\s*\S"
LOG_NAME = r"(?m)^\s*Log Name\s*:\s*\S"
KV_TOKEN = r"(?i)(?:^|\s)(?:Provider|EventID|Event_ID|Channel|Computer)\s*="
KV_HINT = r"(?i)(?:Provider|Channel)\s*=\s*\"?(?:Microsoft-Windows|Windows|Service Control Manager|Sysmon)|EventID\s*=\s*\d+"
FW_ROW = r"(?im)^#(?:Version|Software|Fields):.*(?:Windows Firewall|drop|allow)|^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+(?:ALLOW|DROP|INFO-EVENTS-LOST)\s+(?:TCP|UDP|ICMP)\b"
IIS_FIELDS = r"(?m)^#Fields:"
IIS_ROW = r"(?m)^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\b"
TEXT_HEADERS = {"log name": "channel", "source": "provider", "event id": "event_id", "level": "level", "computer": "computer", "keywords": "keywords", "task category": "task", "date": "timestamp"}
KV_HEADERS = {"provider": "provider", "source": "provider", "eventid": "event_id", "event_id": "event_id", "channel": "channel", "logname": "channel", "computer": "computer", "level": "level", "keywords": "keywords", "task": "task", "recordid": "record_id", "eventrecordid": "record_id", "processid": "process_id", "threadid": "thread_id"}
PRIMARY = ["new logon", "target account", "account that was locked out"]
LEVELS = {"0": "Information", "1": "Critical", "2": "Error", "3": "Warning", "4": "Information", "5": "Verbose"}
IIS_ORDER = "date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip cs(User-Agent) sc-status sc-substatus sc-win32-status time-taken".split()
FW_ORDER = "date time action protocol src-ip dst-ip src-port dst-port size tcpflags tcpsyn tcpack tcpwin icmptype icmpcode info path".split()
LOGON_TYPES = {"2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive"}
#: Every "Key: value" line of a block, key and value without the blanks around them.
KV_LINE = r"(?m)^[ \t]*([A-Za-z0-9 /_\-.]+?)[ ]*:[ \t]*(.*?)[ \t]*$"
SECTION = r"^[A-Za-z][A-Za-z ]+$"
_RDN = r"(?!(?i:cn|ou|dc|o|uid|l|st|c)=)"
KV_PAIR = rf"(?s)(?:^|\s){_RDN}([A-Za-z_][\w()./\-]*)=(.*?)(?=\s{_RDN}[A-Za-z_][\w()./\-]*=|\z)"
NAMED_ELEMENT = r"(?s)<\w+\s[^>]*?\bName=[\"']([^\"']+)[\"'][^>]*?>([^<]*)</"
XML_EVENT = (
    "System STRUCT<Provider STRUCT<_Name STRING, _EventSourceName STRING>, EventID STRING, Channel STRING, Computer STRING, Task STRING, EventRecordID STRING, Keywords STRING, Level STRING, "
    "TimeCreated STRUCT<_SystemTime STRING>, Execution STRUCT<_ProcessID STRING, _ThreadID STRING>, Security STRUCT<_UserID STRING>>, "
    "EventData STRUCT<Data ARRAY<STRUCT<_Name STRING, _VALUE STRING>>>, UserData STRING, broken STRING"
)

ENVELOPE = ("timestamp", "provider", "channel", "event_id", "computer", "level", "keywords", "task", "record_id", "process_id", "thread_id", "security_user_id")

# Where each OCSF path comes from: the first listed key that the event holds.
HOST = {"device.hostname": ["Computer"]}
MAPS = {
    "logon": HOST | {"actor.user.name": ["primary::Account Name", "Account Name", "TargetUserName", "AccountName", "User"], "actor.user.domain": ["primary::Account Domain", "Account Domain", "TargetDomainName", "AccountDomain"], "src_endpoint.ip": ["Source Network Address", "IpAddress", "SourceAddress", "SourceIp"], "src_endpoint.port": ["Source Port", "IpPort", "SourcePort"]},
    "privileges": HOST | {"actor.user.name": ["Account Name", "SubjectUserName"], "actor.user.domain": ["Account Domain", "SubjectDomainName"]},
    "process": HOST | {"actor.process.name": ["New Process Name", "NewProcessName"], "actor.process.pid": ["New Process ID", "NewProcessId"], "actor.process.cmd_line": ["Process Command Line", "CommandLine"], "actor.user.name": ["Account Name", "SubjectUserName", "User"], "actor.process.parent_process.name": ["Creator Process Name", "ParentProcessName"]},
    "account": HOST | {"actor.user.name": ["Account Name", "TargetUserName", "User"], "actor.user.domain": ["Account Domain", "TargetDomainName"]},
    "sysmon1": HOST | {"actor.process.name": ["Image"], "actor.process.cmd_line": ["CommandLine"], "actor.process.pid": ["ProcessId", "PID"], "actor.user.name": ["User"], "actor.process.parent_process.name": ["ParentImage"], "actor.process.parent_process.cmd_line": ["ParentCommandLine"]},
    "sysmon3": HOST | {"src_endpoint.ip": ["SourceIp"], "src_endpoint.port": ["SourcePort"], "dst_endpoint.ip": ["DestinationIp"], "dst_endpoint.port": ["DestinationPort"], "connection_info.protocol_name": ["Protocol"], "actor.process.name": ["Image"]},
    "sysmon11": HOST | {"actor.process.file.path": ["TargetFilename"], "actor.process.name": ["Image"]},
    "powershell": HOST | {"actor.process.cmd_line": ["ScriptBlockText", "CommandLine"], "actor.process.file.path": ["Path"], "actor.user.name": ["UserId", "User"]},
    "defender": HOST | {"finding.title": ["Threat Name", "ThreatName"], "actor.process.file.path": ["Path"], "actor.user.name": ["User"]},
    "generic": HOST | {"actor.user.name": ["Account Name", "User", "SubjectUserName"]},
    "iis": {"src_endpoint.ip": ["c-ip"], "dst_endpoint.ip": ["s-ip"], "dst_endpoint.port": ["s-port"], "http_request.http_method": ["cs-method"], "http_request.url.path": ["cs-uri-stem"], "http_response.code": ["sc-status"], "actor.user.name": ["cs-username"]},
    "firewall": {"src_endpoint.ip": ["src-ip"], "dst_endpoint.ip": ["dst-ip"], "src_endpoint.port": ["src-port"], "dst_endpoint.port": ["dst-port"], "connection_info.protocol_name": ["protocol"]},
}
_AUDIT, _IAM = "Windows Security Auditing", "Identity & Access Management"
# name: map, class, activity, category, source, severity, status, message.
KINDS = {
    "logon": ("logon", 3002, (1, "Logon"), "Authentication", _AUDIT, None, "Success", "Successful logon"),
    "failed": ("logon", 3002, (1, "Logon"), "Authentication", _AUDIT, 3, "Failure", "Failed logon"),
    "privileges": ("privileges", 3002, (1, "Logon"), "Authentication", _AUDIT, None, None, "Special privileges assigned to new logon"),
    "process": ("process", 1007, (1, "Launch"), "Process Activity", _AUDIT, None, None, "A new process has been created"),
    "created": ("account", 3005, (1, "Create"), _IAM, _AUDIT, None, None, "A user account was created"),
    "enabled": ("account", 3005, (1, "Enable"), _IAM, _AUDIT, None, None, "A user account was enabled"),
    "disabled": ("account", 3005, (1, "Disable"), _IAM, _AUDIT, None, None, "A user account was disabled"),
    "deleted": ("account", 3005, (1, "Delete"), _IAM, _AUDIT, None, None, "A user account was deleted"),
    "global": ("account", 3005, (1, "Modify"), _IAM, _AUDIT, None, None, "Member added to a security-enabled global group"),
    "local": ("account", 3005, (1, "Modify"), _IAM, _AUDIT, None, None, "Member added to a security-enabled local group"),
    "universal": ("account", 3005, (1, "Modify"), _IAM, _AUDIT, None, None, "Member added to a universal group"),
    "lockout": ("account", 3005, (1, "Lockout"), _IAM, _AUDIT, 3, None, "A user account was locked out"),
    "sysmon1": ("sysmon1", 1007, (1, "Launch"), "Process Activity", "Microsoft-Windows-Sysmon", None, None, "Sysmon process creation"),
    "sysmon3": ("sysmon3", 4001, (6, "Traffic"), "Network Activity", "Microsoft-Windows-Sysmon", None, None, "Sysmon network connection"),
    "sysmon11": ("sysmon11", 1001, (0, "File Create"), "File Activity", "Microsoft-Windows-Sysmon", None, None, "Sysmon file created"),
    "powershell": ("powershell", 1007, (1, "Launch"), "Process Activity", "Microsoft-Windows-PowerShell", None, None, "PowerShell script block executed"),
    "defender": ("defender", 1001, (0, "Detection"), "Security Finding", "Microsoft-Windows-Windows Defender", 4, None, "Windows Defender detection"),
    "generic": ("generic", 1001, (0, "Unknown"), "System Activity", None, None, None, None),
    "iis": ("iis", 4002, (0, "HTTP Request"), "Network Activity", "IIS", None, None, None),
    "firewall": ("firewall", 4001, (6, "Traffic"), "Network Activity", "Windows Firewall", None, None, None),
}
SECURITY = {"4624": "logon", "4625": "failed", "4634": "logon", "4647": "logon", "4648": "logon", "4672": "privileges", "4688": "process", "4720": "created", "4722": "enabled", "4725": "disabled", "4726": "deleted", "4728": "global", "4732": "local", "4740": "lockout", "4756": "universal"}
SYSMON = {"1": "sysmon1", "3": "sysmon3", "11": "sysmon11"}
GENERIC_SOURCES = ("", "unknown", "generic", "generic log", "windows", "eventlog")


def detect(raw: Sql) -> Sql:
    """Windows format of a record; cheap tests go before patterns."""
    has = raw.contains
    headers = F.size(F.array_distinct(F.regexp_extract_all(raw, F.lit(HEADER_LINE), F.lit(1))))
    text = has(":") & raw.rlike(HEADER_LINE) & (raw.rlike(LOG_NAME) | (headers >= 2))
    iis = (has("#Fields:") & raw.rlike(IIS_FIELDS) & (has("s-ip") | has("cs-method"))) | raw.rlike(IIS_ROW)
    return F.when(has("<Event") & raw.rlike(XML), "xml").when(text, "evtx-text").when(has("=") & raw.rlike(KV_TOKEN) & raw.rlike(KV_HINT), "winkv").when(raw.rlike(FW_ROW), "firewall-text").when(iis, "iis-w3c")


def _lines(raw: Sql) -> Sql:
    return F.split(raw, "\r\n|\r|\n")


def _one_line(raw: Sql) -> Sql:
    joined = F.array_join(F.filter(F.transform(_lines(raw), strip), lambda x: x != ""), " ")
    return F.when(raw.contains("\n") | raw.contains("\r"), joined).otherwise(strip(raw))


def _event_xml(text: Sql) -> Sql:
    """One well-formed <Event> document with a System part, parsed; null for anything else."""
    whole = F.from_xml(text, XML_EVENT, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    one = text.rlike(r"(?s)^(?:<\?xml.*?\?>\s*)?<Event[\s>].*</Event>$") & (F.locate("</Event>", text) == F.length(text) - 7)
    return F.when(one & whole["broken"].isNull() & whole["System"].isNotNull(), whole)


def _table(raw: Sql, fmt: Sql) -> tuple[Sql, Sql]:
    """Sql names (of the #Fields line above, else the usual ones) and the first data row of a table, split."""
    data = lambda x: (x != "") & ~x.startswith("#")
    lines = _lines(raw)
    row = F.when(raw.contains("#") | raw.contains("\n"), F.get(F.filter(lines, data), 0)).otherwise(raw)
    named = F.when(raw.contains("#Fields:"), F.get(F.filter(lines, lambda x: x.startswith("#Fields:")), 0))
    usual = F.when(fmt == "iis-w3c", F.array(*map(F.lit, IIS_ORDER))).otherwise(F.array(*map(F.lit, FW_ORDER)))
    header = F.split(strip(F.substr(named, F.lit(9))), r"\s+")
    return F.when(F.get(header, 0) != "", header).otherwise(usual), F.split(strip(row), r"\s+")


def _sections(keys: Sql, values: Sql) -> Sql:
    """Places of the lines that open a section of the message body: a bare name that is no header label."""
    opens = lambda v, k, i: (F.get(v, i) == "") & k.rlike(SECTION) & ~F.lower(k).isin(*TEXT_HEADERS)
    return let(values, lambda v: F.filter(F.transform(keys, lambda k, i: F.when(opens(v, k, i), i)), lambda i: i.isNotNull()))


def _header(fmt: Sql, r: Sql, x: Sql) -> Sql:
    """The ENVELOPE values of an event, from its labelled rows (struct arrays) or its XML."""
    low, v = r["l"], r["v"]
    texts = {f: at(v, low, label) for label, f in TEXT_HEADERS.items()}
    places = lambda f: [F.nullif(F.array_position(low, F.lit(label)), F.lit(0)) for label, x in KV_HEADERS.items() if x == f]
    first = lambda p: F.least(*p) if len(p) > 1 else p[0]
    tokens = {f: F.get(v, first(places(f)).cast("int") - 1) for f in sorted(set(KV_HEADERS.values()))}
    s = x["System"]
    parsed = {"provider": F.coalesce(s["Provider"]["_Name"], s["Provider"]["_EventSourceName"]), "event_id": some(s["EventID"]), "channel": some(s["Channel"]), "computer": some(s["Computer"]), "task": some(s["Task"]), "record_id": some(s["EventRecordID"]), "keywords": some(s["Keywords"]), "level": some(s["Level"]), "timestamp": s["TimeCreated"]["_SystemTime"], "process_id": s["Execution"]["_ProcessID"], "thread_id": s["Execution"]["_ThreadID"], "security_user_id": s["Security"]["_UserID"]}
    day, clock = at(v, low, "date"), at(v, low, "time")
    row = {"timestamp": F.when(day.isNotNull() & clock.isNotNull(), F.concat_ws(" ", day, clock))}
    iis = row | {"provider": F.lit("IIS"), "channel": F.lit("IIS"), "event_id": F.lit("iis-request")}
    wall = row | {"provider": F.lit("Windows Firewall"), "channel": F.lit("Windows Firewall"), "event_id": F.coalesce(at(v, low, "action"), F.lit("firewall"))}
    as_array = lambda given: F.array(*(given.get(f, F.lit(None)).cast("string") for f in ENVELOPE))
    return F.when(fmt == "evtx-text", as_array(texts)).when(fmt == "winkv", as_array(tokens)).when(fmt == "xml", as_array(parsed)).when(fmt == "iis-w3c", as_array(iis)).when(fmt == "firewall-text", as_array(wall))


def steps(out: Steps, raw: str, open_: Sql) -> Parsed:
    """Adds the family's columns (null where open_ is false or the record is another's; _wok where it is this family's).

    A record becomes labelled rows first; then _wk and _wv, keys and values of the event's data with the value that counts first.
    """
    text, fmt = F.col(raw), F.col("_wf")
    none = F.array().cast("array<string>")
    out.withColumn("_wf", guarded(open_, detect(text)))
    table = fmt.isin("iis-w3c", "firewall-text")
    names, row = _table(text, fmt)
    out.withColumns({"_wj": F.when(fmt == "winkv", _one_line(text)).when(fmt == "evtx-text", text), "_wx": F.when(fmt == "xml", _event_xml(strip(text))), "_wn": F.when(table, names), "_wo": F.when(table, row)})
    j, x = F.col("_wj"), F.col("_wx")
    every = lambda p, n: F.regexp_extract_all(j, F.lit(p), F.lit(n))
    clean = lambda v: strip(F.btrim(strip(v), F.lit('"')))
    data, more = x["EventData"]["Data"], x["UserData"]
    user = lambda n: F.when(more.isNotNull(), F.regexp_extract_all(more, F.lit(NAMED_ELEMENT), F.lit(n))).otherwise(none)
    whole = lambda c: F.coalesce(F.transform(c, lambda v: F.coalesce(strip(v), F.lit(""))), none)
    width = F.least(F.size("_wn"), F.size("_wo"))
    keys = F.when(fmt == "evtx-text", every(KV_LINE, 1)).when(fmt == "winkv", every(KV_PAIR, 1)).when(table, F.slice("_wn", 1, width)).when(fmt == "xml", F.concat(whole(data["_Name"]), user(1)))
    values = F.when(fmt == "evtx-text", F.transform(every(KV_LINE, 2), strip)).when(fmt == "winkv", F.transform(every(KV_PAIR, 2), clean)).when(table, F.slice("_wo", 1, width)).when(fmt == "xml", F.concat(whole(data["_VALUE"]), F.transform(user(2), strip)))
    out.withColumns({"_wa": guarded(fmt.isNotNull(), keys), "_wb": guarded(fmt.isNotNull(), values)})
    out.withColumn("_wi", F.when(fmt == "evtx-text", _sections(F.col("_wa"), F.col("_wb"))))
    above = lambda a, w, i: F.lower(F.coalesce(F.get(a, F.array_max(F.filter(w, lambda s: s < i))), F.lit("")))
    entry = lambda k, v, s: F.struct(k.alias("k"), v.alias("v"), F.lower(k).alias("l"), s.alias("s"))
    lines = let(F.col("_wa"), lambda a: let(F.col("_wb"), lambda b: let(F.col("_wi"), lambda w: F.transform(a, lambda k, i: entry(k, F.get(b, i), above(a, w, i))))))
    flat = F.zip_with("_wa", "_wb", lambda k, v: entry(k, v, F.lit("")))
    holds = lambda e: ~e["v"].isin("", "-") & (e["k"] != "")
    out.withColumn("_wr", F.when(fmt == "evtx-text", F.filter(lines, lambda e: e["v"] != "")).otherwise(F.filter(flat, holds)))
    r = F.col("_wr")
    # A header label counts once; later ones are data like any other label.
    later = lambda e, i, low: ~F.array_contains(F.array(*map(F.lit, TEXT_HEADERS)), e["l"]) | (F.array_position(low, e["l"]) <= i)
    rest = let(r, lambda q: let(q["l"], lambda low: F.filter(q, lambda e, i: (e["v"] != "-") & later(e, i, low))))
    out.withColumns({"_wh": guarded(fmt.isNotNull(), _header(fmt, r, x)), "_wd": F.when(fmt == "evtx-text", rest).otherwise(r)})
    d = F.col("_wd")
    under = F.filter(d, lambda e: e["s"] != "")
    acting = F.reverse(F.filter(d, lambda e: e["s"].isin(*PRIMARY)))
    nested = lambda of: F.concat(d["k"], F.transform(under, lambda e: F.concat_ws("::", e["s"], e["k"])), F.transform(acting, lambda e: F.concat(F.lit("primary::"), e["k"]))) if of == "k" else F.concat(d["v"], under["v"], acting["v"])
    out.withColumns({"_wk": F.when(fmt == "evtx-text", nested("k")).otherwise(d["k"]), "_wv": F.when(fmt == "evtx-text", nested("v")).otherwise(d["v"])})
    h = lambda f: F.get("_wh", ENVELOPE.index(f))
    low = lambda f: F.lower(F.coalesce(h(f), F.lit("")))
    known = F.when(fmt == "xml", x.isNotNull()).when(fmt == "winkv", F.coalesce(h("provider"), h("event_id")).isNotNull()).when(table, F.get("_wo", 0).isNotNull()).otherwise(fmt.isNotNull())
    out.withColumns({"_wok": guarded(fmt.isNotNull(), known), "_wp": low("provider"), "_wc": low("channel"), "_we": strip(F.coalesce(h("event_id"), F.lit("")))})
    says = lambda word: F.col("_wp").contains(word) | F.col("_wc").contains(word)
    security = F.col("_wp").contains("security-auditing") | (F.col("_wc") == "security")
    eid = F.col("_we")
    kind = (
        F.when(fmt == "iis-w3c", "iis").when(fmt == "firewall-text", "firewall")
        .when(says("sysmon"), F.coalesce(lookup(SYSMON, eid), F.lit("generic"))).when(says("powershell"), "powershell").when(says("defender"), "defender")
        .when(security, F.coalesce(lookup(SECURITY, eid), F.lit("generic"))).otherwise("generic")
    )
    parser = (
        F.when(fmt == "iis-w3c", "WIN-IIS-W3C").when(fmt == "firewall-text", "WIN-FIREWALL-001").when(says("sysmon"), "WIN-SYSMON-001")
        .when(says("powershell"), F.concat(F.lit("WIN-PWSH-"), F.when(eid.isin("4103", "4104", "4105", "4106"), eid).otherwise("4104")))
        .when(says("defender"), "WIN-DEFENDER-001").when(F.col("_wp").contains("service control manager"), "WIN-SYS-SVC")
        .when(security, F.concat(F.lit("WIN-SEC-"), F.when(eid == "", "X").otherwise(eid))).otherwise("WIN-EVTLOG-001")
    )
    # The order of KINDS numbers them.
    out.withColumn("_wkind", guarded(F.col("_wok"), lookup({k: i for i, k in enumerate(KINDS)}, kind, "int")))
    return _parsed(out, fmt, h, parser)


def _parsed(out: Steps, fmt: Sql, h, parser: Sql) -> Parsed:
    kinds = list(KINDS)
    k = F.col("_wkind")
    of = lambda values, cast="string": by_number(k, values, cast)
    at_ = lambda place, cast="string": of([v[place] for v in KINDS.values()], cast)
    data = lambda *names: at(F.col("_wv"), F.col("_wk"), *names)
    is_kind = lambda *names: k.isin(*[kinds.index(n) for n in names])
    level = h("level")
    level = F.when(level.rlike("^[0-9]+$"), F.coalesce(lookup(LEVELS, level), level)).otherwise(level)
    # Each path's value, and the key it comes from, by the kind's table.
    value: dict[str, Sql] = {}
    source: dict[str, Sql] = {}
    for path in dict.fromkeys(p for m in MAPS.values() for p in m):
        taken: dict[tuple, list[int]] = {}
        for n, (name, *_) in enumerate(KINDS.values()):
            if path in MAPS[name]:
                taken.setdefault(tuple(MAPS[name][path]), []).append(n)
        for keys, numbers in taken.items():
            found = F.coalesce(data("Computer"), some(h("computer"))) if keys == ("Computer",) else data(*keys)
            name = F.lit("Computer") if keys == ("Computer",) else F.coalesce(*(F.when(F.array_contains("_wk", x), F.lit(x)) for x in keys))
            value[path] = F.when(k.isin(*numbers), found) if path not in value else value[path].when(k.isin(*numbers), found)
            source[path] = F.when(k.isin(*numbers), name) if path not in source else source[path].when(k.isin(*numbers), name)
    user = data("primary::Account Name", "Account Name", "TargetUserName", "SubjectUserName", "AccountName", "User")
    logon = is_kind("logon", "failed")
    logon_type = F.when(logon, data("Logon Type", "LogonType"))
    action = F.upper(F.coalesce(data("action"), F.lit("")))
    empty = F.lit("")
    message = (
        F.when(logon, F.concat(at_(7), F.when(user.isNull(), "").otherwise(F.concat(F.lit(" for "), user))))
        .when(is_kind("generic"), F.coalesce(data("Description", "Message"), F.concat(F.lit("Windows event "), F.coalesce(h("event_id"), F.lit("None")))))
        .when(is_kind("iis"), F.concat(F.lit("IIS "), F.coalesce(data("cs-method"), F.lit("request")), F.lit(" "), F.coalesce(data("cs-uri-stem"), empty)))
        .when(is_kind("firewall"), F.concat(F.lit("Firewall "), F.when(action == "", "event").otherwise(action), F.lit(" "), F.coalesce(data("src-ip"), empty), F.lit(" → "), F.coalesce(data("dst-ip"), empty)))
        .otherwise(at_(7))
    )
    status = F.when(is_kind("firewall"), F.when(action == "ALLOW", "Success").when(action == "DROP", "Failure")).otherwise(at_(6))
    provider = F.when(is_kind("generic"), F.coalesce(h("provider"), F.lit("Windows Event Log"))).otherwise(at_(4))
    own = {"logon_type_id": logon_type, "logon_type": lookup(LOGON_TYPES, strip(logon_type))}
    field = lambda name, head: F.coalesce(*(data(a) if i else F.coalesce(data(a), head) for i, a in enumerate(ALIASES[name])))
    nothing = F.lit(None).cast("string")
    values = {n: field(n, nothing) for n in ("datetime", "date", "time", "month", "day")} | {"timestamp": field("timestamp", some(h("timestamp"))), "level": field("level", some(level)), "text": message}
    # What is not left over: consumed names and the keys that paths come from. A column, as lambdas work out what they mention for every element.
    out.withColumn("_ws", guarded(F.col("_wok"), F.concat(F.array(*map(F.lit, CONSUMED)), F.array_compact(F.array(*source.values())))))
    entries = F.concat(pairs(own), rows(F.col("_wk"), F.col("_wv")))
    left = let(F.col("_ws"), lambda taken: F.filter(entries, lambda e: ~F.array_contains(taken, e["k"])))
    named = F.array_compact(F.array(F.when(message != "", "message"), *(F.when(c.isNotNull(), n) for n, c in own.items()), F.when(h("timestamp") != "", "timestamp"), F.when(level != "", "level"), F.when(h("computer") != "", "Computer")))
    block = pairs({"format": fmt} | {n: level if n == "level" else h(n) for n in ENVELOPE if n != "timestamp"})
    noted = F.transform(rows(F.col("_wk"), F.col("_wv")), lambda e: F.struct(F.concat(F.lit("event_data."), e["k"]).alias("k"), e["v"].alias("v")))
    return Parsed(
        {
            "format": fmt, "parser_id": parser, "source_name": provider, "product": provider, "os_family": "Windows", "category": at_(3), "class_uid": at_(1, "int"),
            "activity_id": of([v[2][0] for v in KINDS.values()], "int"), "activity_name": of([v[2][1] for v in KINDS.values()]), "severity_id": at_(5, "int"),
            "status": status, "status_id": lookup({"Success": 1, "Failure": 2}, status, "int"), "unmapped": first_wins(left), "n_mapped": how_many(*value.values()),
            "n_fields": F.size(F.array_distinct(F.concat(F.col("_wk"), named))), "core": how_many(*(h(n) for n in ("timestamp", "provider", "channel", "event_id", "computer", "level"))), "native": first_wins(F.concat(block, noted)),
        },
        value | values,
    )
