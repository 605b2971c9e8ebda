"""Linux family: syslog (two RFCs), kernel ring buffer, auditd and journald records.

Three native steps, each its own columns: detect the format, read the
envelope, pick the first taxonomy rule that fits. A rule is one pattern, so its
leftmost match decides; what the rule says may turn on one captured word
(Accepted or Failed). Rule and word give a number, and class, activity and the
rest are read from tables by that number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import sqltext as F
from ..functions.columns import MAP, Pattern, Steps, as_map, at, by_number, first_wins, guarded, how_many, literal_map, lookup, pairs, some, strip
from ..functions.sqltext import Sql
from .parsed import Parsed, rows

# Syslog severity words by number; parser ids by format.
SEVERITIES = "emergency alert critical error warning notice informational debug".split()
PARSER_IDS = {"rfc3164": "LINUX-SYSLOG-RFC3164", "rfc5424": "LINUX-SYSLOG-RFC5424", "dmesg": "LINUX-KERNEL-DMESG", "auditd": "LINUX-AUDITD", "journald_json": "LINUX-JOURNALD-JSON"}

# How the first line of a format looks, and whole records.
APPLE = r"\blaunchd\[\d+\]|\bkernel\[\d+\]:|com\.apple\."
LOOKS = {
    "auditd": r"^type=\w+\s+(?:msg=)?audit\(\d+\.\d+:\d+\):",
    "rfc5424": r"^<\d{1,3}>\d\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+",
    "rfc3164": r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+[\w.\-]+\s+[\w.\-/]+(?:\[\d+\])?:",
    "dmesg": r"^\[\s*\d+\.\d+\]\s+\S",
}
RECORDS = {
    "auditd": Pattern(r"^type=(?P<type>\w+)\s+(?:msg=)?audit\((?P<epoch>\d+\.\d+):(?P<serial>\d+)\):\s*(?P<message>.*)$", "sd"),
    "rfc5424": Pattern(r"^<(?P<pri>\d{1,3})>(?P<version>\d)\s+(?P<timestamp>\S+)\s+(?P<hostname>\S+)\s+(?P<program>\S+)\s+(?P<pid>\S+)\s+(?P<msgid>\S+)\s+(?P<message>.*)$", "sd"),
    "rfc3164": Pattern(r"^(?:<(?P<pri>\d{1,3})>)?(?P<month>[A-Z][a-z]{2})\s+(?P<day>\d{1,2})\s+(?P<time>\d{2}:\d{2}:\d{2})\s+(?P<hostname>[\w.\-]+)\s+(?P<program>[\w.\-/]+?)(?:\[(?P<pid>\d+)\])?:\s?(?P<message>.*)$", "sd"),
    "dmesg": Pattern(r"^\[\s*(?P<uptime>\d+\.\d+)\]\s+(?P<message>.*)$"),
}
SUBSYSTEM = r"^([\w.\-]+):\s+"
AUDIT_PAIR = r"(\w+)=(\"[^\"]*\"|'[^']*'|\S+)"
JOURNAL_KEYS = ["PRIORITY", "SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", "_PID", "_HOSTNAME", "_COMM", "SYSLOG_FACILITY"]
#: What an envelope holds, in this order.
HEAD = "month day time timestamp hostname program pid pri message version msgid uptime type epoch serial".split()
#: What a rule can capture, in this order; outcome is the word that a rule's verdict turns on.
CAPTURED = "outcome user src_ip src_port dst_ip dst_port protocol auth_method auth_protocol http_method http_uri http_status command process".split()
#: Event path of each captured field; others stay unmapped under their own name.
MAPPED = {"user": "actor.user.name", "src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port", "protocol": "connection_info.protocol_name", "auth_protocol": "auth_protocol", "http_method": "http_request.http_method", "http_uri": "http_request.url.path", "http_status": "http_response.code", "command": "actor.process.cmd_line"}
KEPT = ("auth_method", "fw_action")


@dataclass
class Says:
    """What a rule says of a record; None leaves a thing open."""

    activity: tuple[int, str]
    severity: int | None = None
    status: tuple[str, int] | None = None


@dataclass
class Rule:
    """One taxonomy rule: its pattern, words of which a message that fits holds one, and what it says (otherwise: where the outcome is one of the words)."""

    pattern: Pattern | None
    words: tuple[str, ...]
    class_uid: int
    category: str
    source: str
    says: Says
    programs: tuple[str, ...] = ()
    turns: tuple[str, ...] = ()
    otherwise: Says | None = field(default=None)


SUCCESS, FAILURE = ("Success", 1), ("Failure", 2)
LOGON, LAUNCH, END, TRAFFIC, HTTP = (1, "Logon"), (1, "Launch"), (4, "Terminate"), (6, "Traffic"), (0, "HTTP Request")
WEB = ("nginx", "apache2", "httpd", "apache")
_AUTH, _ID, _PROC, _NETWORK, _WEB = "Authentication", "Identity & Access Management", "Process Activity", "Network Activity", "HTTP Activity"

# The rules' patterns and verdicts, in rule order. Severity 3 is Medium, 4 High.
RULES = [
    Rule(Pattern(r'^(?P<src_ip>\d{1,3}(?:\.\d{1,3}){3})\s+\S+\s+\S+\s+.*?"(?P<http_method>[A-Z]+)\s+(?P<http_uri>\S+)\s+HTTP/[\d.]+"\s+(?P<http_status>(?P<outcome>\d)\d{2})'), ("HTTP/",), 4002, _WEB, "Linux web", Says(HTTP), WEB, ("4", "5"), Says(HTTP, 3)),
    Rule(Pattern(r"\[error\]\s+client\s+(?P<src_ip>[\d.]+)"), ("[error]",), 4002, _WEB, "Linux web", Says(HTTP, 3), WEB),
    Rule(Pattern(r"\b(?P<outcome>Accepted|Failed)\s+(?P<auth_method>password|publickey|keyboard-interactive|none)\s+for\s+(?:invalid user\s+)?(?P<user>\S+)\s+from\s+(?P<src_ip>[\da-fA-F.:]+)\s+port\s+(?P<src_port>\d+)(?:\s+(?P<auth_protocol>ssh\d))?"), ("Accepted", "Failed"), 3002, _AUTH, "Linux auth", Says(LOGON, None, SUCCESS), (), ("Failed",), Says(LOGON, 3, FAILURE)),
    Rule(Pattern(r"[Ii]nvalid user\s+(?P<user>\S+)\s+from\s+(?P<src_ip>[\da-fA-F.:]+)(?:\s+port\s+(?P<src_port>\d+))?"), ("nvalid user",), 3002, _AUTH, "Linux auth", Says(LOGON, 3, FAILURE)),
    Rule(Pattern(r"pam_unix\(sshd:session\):\s+session\s+(?:opened|closed)\s+for\s+user\s+(?P<user>[\w.\-]+)"), ("pam_unix(sshd:session)",), 3002, _AUTH, "Linux auth", Says(LOGON, None, SUCCESS)),
    Rule(Pattern(r"connection authorized:\s+user=(?P<user>[\w.\-]+)\s+database=(?:[\w.\-]+)(?:\s+client=(?P<src_ip>[\d.]+))?"), ("connection authorized:",), 3002, _AUTH, "Linux database", Says(LOGON, None, SUCCESS)),
    Rule(Pattern(r'password authentication failed for user\s+"(?P<user>[^"]+)"'), ("password authentication failed",), 3002, _AUTH, "Linux database", Says(LOGON, 3, FAILURE)),
    Rule(None, ("USER_LOGIN",), 3002, _AUTH, "Linux auditd", Says(LOGON)),
    Rule(Pattern(r"\b(?:useradd|userdel|usermod|groupadd|groupdel|gpasswd|chpasswd|passwd)\b|new user:|new group:|password changed for"), ("useradd", "userdel", "usermod", "groupadd", "groupdel", "passwd", "new user:", "new group:", "password changed for"), 3005, _ID, "Linux account", Says((0, "Account Change"))),
    Rule(Pattern(r"USER=\S+\s*;\s*COMMAND=(?P<command>.+)$", "sd"), ("COMMAND=",), 1007, _PROC, "Linux sudo", Says(LAUNCH)),
    Rule(Pattern(r"CMD\s+\((?P<command>.+)\)\s*$", "sd"), ("CMD",), 1007, _PROC, "Linux cron", Says(LAUNCH)),
    Rule(Pattern(r"\bEXECVE\b.*?\ba0=\"?(?P<command>[^\"\s]+)\"?", "sd"), ("EXECVE",), 1007, _PROC, "Linux auditd", Says(LAUNCH)),
    Rule(Pattern(r"\bSYSCALL\b.*?\bexe=\"?(?P<command>[^\"\s]+)\"?", "sd"), ("SYSCALL",), 1007, _PROC, "Linux auditd", Says(LAUNCH)),
    Rule(Pattern(r"(?:Out of memory|Memory cgroup out of memory|oom-kill).*?Killed process\s+\d+\s+\((?P<process>[^)]+)\)", "sd"), ("Killed process",), 1007, _PROC, "Linux kernel", Says(END, 4)),
    Rule(Pattern(r"\boom-kill\b|Out of memory"), ("oom-kill", "Out of memory"), 1007, _PROC, "Linux kernel", Says(END, 4)),
    Rule(Pattern(r"\bcontainer\s+(?P<process>\S+)\s+(?P<outcome>started|exited|created|died)"), ("container",), 1007, _PROC, "Linux container", Says(LAUNCH), (), ("exited", "died"), Says(END)),
    Rule(Pattern(r"\bsegfault at\b|\btraps:\s"), ("segfault at", "traps:"), 1007, _PROC, "Linux kernel", Says(END, 4)),
    Rule(Pattern(r"SRC=(?P<src_ip>[\d.]+).*?DST=(?P<dst_ip>[\d.]+)(?:.*?PROTO=(?P<protocol>\w+))?(?:.*?SPT=(?P<src_port>\d+))?(?:.*?DPT=(?P<dst_port>\d+))?", "sd"), ("SRC=",), 4001, _NETWORK, "Linux netfilter", Says(TRAFFIC), ("kernel",), ("BLOCK", "DROP", "REJECT"), Says(TRAFFIC, 3, FAILURE)),
    Rule(Pattern(r"TCP:\s+Possible SYN flooding"), ("Possible SYN flooding",), 4001, _NETWORK, "Linux kernel", Says(TRAFFIC, 4)),
    Rule(Pattern(r"\b(?P<outcome>Ban|Unban)\s+(?P<src_ip>[\d.]+)"), ("Ban", "Unban"), 4001, _NETWORK, "Linux fail2ban", Says(TRAFFIC), (), ("Ban",), Says(TRAFFIC, 3)),
    Rule(Pattern(r"DHCPACK of\s+(?P<dst_ip>[\d.]+)|DHCPACK|DHCPREQUEST|DHCPOFFER"), ("DHCP",), 4001, _NETWORK, "Linux dhcp", Says(TRAFFIC)),
    Rule(None, (), 1001, "System Activity", "Linux syslog", Says((0, "System Activity")), (), ("denied",), Says((0, "System Activity"), 4)),
]
PACKET = next(i for i, r in enumerate(RULES) if r.source == "Linux netfilter")
UFW = Pattern(r"\[UFW\s+(?P<tagged>[A-Z]+)\]|\b(?P<bare>BLOCK|DROP|REJECT|ACCEPT|ALLOW)\b")


def detect(text: Sql, first: Sql, keys: Sql) -> Sql:
    """Linux format of a stripped record and its first line, null if it is none; keys are the upper-case keys of its JSON object, if it is one."""
    is_journal = F.array_contains(keys, "MESSAGE") & F.arrays_overlap(keys, F.array(*map(F.lit, JOURNAL_KEYS)))
    out = F.when(F.coalesce(is_journal, F.lit(False)), "journald_json")
    for name, look in LOOKS.items():
        out = out.when(first.rlike("(?d)" + look), F.when(~first.rlike(APPLE), name))
    return out


def _groups(text: Sql, first: Sql, fmt: Sql, keys: Sql, values: Sql) -> Sql:
    """The HEAD values of a record; null where its first line alone looked like the format."""
    get = lambda *names: F.coalesce(some(at(values, keys, *names)), F.lit(""))
    journal = {"timestamp": get("__REALTIME_TIMESTAMP"), "hostname": get("_HOSTNAME"), "program": F.coalesce(*(some(at(values, keys, k)) for k in ("SYSLOG_IDENTIFIER", "_COMM", "UNIT", "_SYSTEMD_UNIT")), F.lit("")), "pid": F.coalesce(some(at(values, keys, "_PID")), some(at(values, keys, "SYSLOG_PID")), F.lit("")), "pri": get("PRIORITY"), "message": get("MESSAGE")}
    out = F.when(fmt == "journald_json", F.array(*(journal.get(n, F.lit("")) for n in HEAD)))
    for name, p in RECORDS.items():
        of = first if name == "dmesg" else text
        out = out.when(fmt == name, F.when(p.found(of), p.groups(of, HEAD)))
    return out


def _structured(rest: Sql) -> Sql:
    """Leading structured data: up to the bracket that closes the first one, or all without such; '' if there is none."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(a: Sql, c: Sql) -> Sql:
        depth = a["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        end = F.when((a["end"] == 0) & (c == "]") & (depth == 0), a["seen"] + 1).otherwise(a["end"])
        return F.struct(depth.alias("depth"), (a["seen"] + 1).alias("seen"), end.alias("end"))

    nested = F.aggregate(F.split(rest, ""), begin, step, lambda a: F.when(a["end"] > 0, F.substring(rest, F.lit(1), a["end"])).otherwise(rest))
    flat = r"^\[[^\[\]]*\]"
    return F.when(~rest.startswith("["), "").when(rest.rlike(flat), F.regexp_extract(rest, flat, 0)).otherwise(nested)


def _utc_iso(micros: Sql) -> Sql:
    # Counted from a zone-free epoch, so the session's time zone does not matter.
    seconds = (micros.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)")
    moment = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    frac = F.pmod(micros, F.lit(1_000_000))
    part = F.when(frac == 0, "").otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def rule_of(program: Sql, message: Sql) -> Sql:
    """Number of the first rule that fits; a word test spares most messages a rule's pattern."""
    out = None
    for i, r in enumerate(RULES):
        fits = program.isin(*r.programs) if r.programs else None
        if r.words:
            held = message.contains(r.words[0])
            for w in r.words[1:]:
                held = held | message.contains(w)
            fits = held if fits is None else fits & held
        if i == PACKET:
            fits = fits & message.contains("DST=")
        if r.pattern is not None:
            fits = fits & r.pattern.found(message)
        fits = F.lit(True) if fits is None else fits
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out


def _captured(rule: Sql, message: Sql) -> Sql:
    """The CAPTURED values of the rule that fits."""
    out = None
    for i, r in enumerate(RULES):
        if r.pattern is not None and any(n in CAPTURED for n in r.pattern.names):
            out = F.when(rule == i, r.pattern.groups(message, CAPTURED)) if out is None else out.when(rule == i, r.pattern.groups(message, CAPTURED))
    return out.otherwise(F.array(*(F.lit("") for _ in CAPTURED)))


def _fw_action(message: Sql) -> Sql:
    g = UFW.groups(message)
    return F.when(UFW.found(message), F.concat(F.get(g, 0), F.get(g, 1))).otherwise("")


def steps(out: Steps, text: str, open_: Sql) -> Parsed:
    """Adds the family's columns (null where open_ is false or the record is another's; _lok where it is this family's).

    text names the stripped record; _first its first line, _jk and _jv the keys and values of its JSON object.
    """
    t, first, fmt = F.col(text), F.col("_first"), F.col("_lf")
    upper = F.transform("_jk", lambda k: F.upper(k))
    out.withColumn("_lu", F.when(F.col("_jk").isNotNull(), upper))
    out.withColumn("_lf", guarded(open_, detect(t, first, F.col("_lu"))))
    out.withColumn("_lg", guarded(fmt.isNotNull(), _groups(t, first, fmt, F.col("_lu"), F.col("_jv"))))
    e = lambda n: some(F.get("_lg", HEAD.index(n)))
    dash = lambda c: F.nullif(c, F.lit("-"))
    modern = fmt == "rfc5424"
    rest = strip(F.get("_lg", HEAD.index("message")))
    out.withColumn("_lm", guarded(fmt.isNotNull(), F.when(fmt.isin("rfc5424", "dmesg", "auditd"), rest).otherwise(F.get("_lg", HEAD.index("message")))))
    out.withColumn("_ls", guarded(modern, _structured(F.col("_lm"))))
    m = F.col("_lm")
    system = F.regexp_extract(m, SUBSYSTEM, 1)
    program = F.when(fmt == "dmesg", F.when(system == "", "kernel").otherwise(system)).when(fmt == "auditd", "auditd").when(modern, dash(e("program"))).otherwise(e("program"))
    message = F.when(modern & (F.col("_ls") != ""), strip(F.substr(m, F.length("_ls") + 1))).when(fmt == "auditd", strip(F.concat_ws(" ", e("type"), m))).when(fmt == "journald_json", some(m)).otherwise(m)
    out.withColumns({"_lp": guarded(fmt.isNotNull(), program), "_lmsg": guarded(F.col("_lg").isNotNull(), message)})
    out.withColumn("_lq", F.lower(F.coalesce("_lp", F.lit(""))))
    msg, low = F.coalesce("_lmsg", F.lit("")), F.lower(t)
    foreign = low.contains("filterlog") | low.contains("socketfilterfw") | ((F.col("_lq") == "sshd") & msg.contains("SRC=") & msg.contains("DST="))
    out.withColumn("_lr", guarded(F.col("_lg").isNotNull() & ~foreign, rule_of(F.col("_lq"), msg)))
    rule = F.col("_lr")
    out.withColumn("_lok", rule.isNotNull())
    out.withColumns({"_lc": guarded(F.col("_lok"), _captured(rule, msg)), "_la": guarded(rule == PACKET, _fw_action(msg))})
    c = lambda n: F.get("_lc", CAPTURED.index(n))
    lower = F.lower(msg)
    noted = (lower.contains("denied") & lower.contains("apparmor")) | lower.contains("i/o error") | lower.contains("blk_update_request")
    outcome = F.when(rule == PACKET, F.col("_la")).when(rule == len(RULES) - 1, F.when(noted, "denied")).otherwise(c("outcome"))
    turns = F.when(F.lit(False), F.lit(False))
    for i, r in enumerate(RULES):
        if r.turns:
            turns = turns.when(rule == i, outcome.isin(*r.turns))
    out.withColumn("_ln", guarded(F.col("_lok"), rule * 2 + F.when(F.coalesce(turns, F.lit(False)), 1).otherwise(0)))
    return _parsed(e, c, fmt, dash)


def _parsed(e, c, fmt: Sql, dash) -> Parsed:
    verdicts = [x for r in RULES for x in (r.says, r.otherwise or r.says)]
    of = lambda values, kind="string": by_number(F.col("_ln"), values, kind)
    rule = lambda name, kind="string": by_number(F.col("_lr"), [getattr(r, name) for r in RULES], kind)
    pri = e("pri").try_cast("int")
    level = F.get(F.array(*map(F.lit, SEVERITIES)), pri.bitwiseAND(F.lit(7)))
    stamp = F.when(fmt == "rfc5424", e("timestamp")).when(fmt == "auditd", _utc_iso(F.round(e("epoch").try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))).when(fmt == "journald_json", _utc_iso(e("timestamp").try_cast("bigint")))
    dated = e("month").isNotNull()
    host, pid = dash(e("hostname")), F.when(fmt == "rfc5424", dash(e("pid"))).otherwise(e("pid"))
    program, message = F.col("_lp"), F.col("_lmsg")
    command, protocol = strip(c("command")), F.upper(c("auth_protocol"))
    field = lambda n: command if n == "command" else protocol if n == "auth_protocol" else c(n)
    values = {path: some(field(n)) for n, path in MAPPED.items()} | {
        "device.hostname": host, "actor.process.name": F.coalesce(some(c("process")), program), "actor.process.pid": pid,
        "month": e("month"), "day": e("day"), "time": e("time"), "timestamp": F.when(~dated, stamp), "level": level, "text": message,
    }
    n_mapped = how_many(host, program, pid, c("process"), *map(field, MAPPED))
    kept = {"auth_method": c("auth_method"), "fw_action": F.col("_la")}
    n_fields = F.when(dated, 3).when(stamp.isNotNull(), 1).otherwise(0) + F.when(level.isNotNull(), 1).otherwise(0) + F.when(message.isNotNull(), 1).otherwise(0) + n_mapped + how_many(*kept.values())
    core = F.when(dated | stamp.isNotNull(), 1).otherwise(0) + how_many(host, program, pid, level, message)
    block = {"format": fmt, "facility": F.when(fmt.isin("rfc3164", "rfc5424"), F.shiftright(pri, 3)), "hostname": host, "program": program, "pid": pid, "level": level, "timestamp": stamp, "message": message}
    return Parsed(
        {
            "format": fmt, "parser_id": lookup(PARSER_IDS, fmt), "source_name": rule("source"), "product": rule("source"), "os_family": "Linux", "category": rule("category"), "class_uid": rule("class_uid", "int"),
            "activity_id": of([v.activity[0] for v in verdicts], "int"), "activity_name": of([v.activity[1] for v in verdicts]), "severity_id": of([v.severity for v in verdicts], "int"),
            "status": of([v.status and v.status[0] for v in verdicts]), "status_id": of([v.status and v.status[1] for v in verdicts], "int"),
            "unmapped": as_map(kept), "n_mapped": n_mapped, "n_fields": n_fields, "core": core, "native": F.map_from_entries(F.concat(pairs(block), _native(e, fmt, pri, dash))),
        },
        values,
    )


def _native(e, fmt: Sql, pri: Sql, dash) -> Sql:
    """(native.<key>, value) of all that the format holds beside the envelope."""
    syslog = {"pri": pri, "facility": F.shiftright(pri, 3)}
    modern = syslog | {"syslog_version": e("version"), "msgid": dash(e("msgid")), "structured_data": F.col("_ls")}
    values = F.transform(F.regexp_extract_all("_lm", F.lit(AUDIT_PAIR), F.lit(2)), lambda v: F.btrim(v, F.lit("\"'")))
    noted = F.filter(rows(F.regexp_extract_all("_lm", F.lit(AUDIT_PAIR), F.lit(1)), values), lambda x: ~x["v"].isin("", "-"))
    audit = first_wins(F.concat(pairs({"audit_type": e("type"), "audit_epoch": e("epoch"), "audit_serial": e("serial")}), noted))
    journal = F.filter(rows(F.col("_jk"), F.col("_jv")), lambda x: (F.upper(x["k"]) != "MESSAGE") & x["v"].isNotNull() & ~x["v"].isin("", "-"))
    found = F.when(fmt == "rfc3164", pairs(syslog)).when(fmt == "rfc5424", pairs(modern)).when(fmt == "dmesg", pairs({"uptime": e("uptime")}))
    found = found.when(fmt == "auditd", F.map_entries(audit.cast(MAP)).cast("array<struct<k:string,v:string>>")).otherwise(journal)
    return F.transform(found, lambda x: F.struct(F.concat(F.lit("native."), x["k"]).alias("k"), x["v"].alias("v")))
