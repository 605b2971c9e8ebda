import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import ocsf
from logloom.functions.columns import Pattern
from logloom.functions.parser_specs import SPECS
from logloom.operators.registry import Registry
from logloom.plans.normalize import KEYS, normalize

NOW = "2024-06-01T00:00:00+00:00"
BLOCK = "Log Name: Security\nSource: Microsoft-Windows-Security-Auditing\nDate: 2024-01-02T03:04:05Z\nEvent ID: 4625\nLevel: 0\nComputer: PC\nSubject:\n\tAccount Name: SYS\nNew Logon:\n\tAccount Name: bob\n\tAccount Domain: D\nLogon Type: 3\nSource Network Address: 10.1.1.1"
# raw, parser_id, class, activity, status, severity, {path: value}
GOLDEN = [
    ("Jan  5 10:00:01 web1 sshd[321]: Failed password for invalid user bob from 10.0.0.5 port 2222 ssh2", "LINUX-SYSLOG-RFC3164", 3002, "Logon", "Failure", "Medium", {"actor.user.name": "bob", "src_endpoint.port": "2222", "auth_protocol": "SSH2", "time": "2024-01-05T10:00:01+00:00", "unmapped['auth_method']": "password"}),
    ("Jan 15 10:00:01 h sshd[1]: Invalid user eve from 10.0.0.9 port 4", "LINUX-SYSLOG-RFC3164", 3002, "Logon", "Failure", "Medium", {"actor.user.name": "eve"}),
    ("Jan 15 10:00:01 h sshd[1]: pam_unix(sshd:session): session closed for user al", "LINUX-SYSLOG-RFC3164", 3002, "Logon", "Success", "Informational", {"actor.user.name": "al"}),
    ("Jan 15 10:00:01 h postgres[1]: password authentication failed for user \"pg\"", "LINUX-SYSLOG-RFC3164", 3002, "Logon", "Failure", "Medium", {"actor.user.name": "pg"}),
    ("Jan 15 10:00:01 h cron[1]: (root) CMD (/bin/x y)", "LINUX-SYSLOG-RFC3164", 1007, "Launch", "Unknown", "Informational", {"actor.process.cmd_line": "/bin/x y"}),
    ("Jan 15 10:00:01 h dockerd[1]: container abc died", "LINUX-SYSLOG-RFC3164", 1007, "Terminate", "Unknown", "Informational", {"actor.process.name": "abc"}),
    ("Jan 15 10:00:01 h app[1]: x: segfault at 0", "LINUX-SYSLOG-RFC3164", 1007, "Terminate", "Unknown", "High", {}),
    ("Jan 15 10:00:01 h kernel: TCP: Possible SYN flooding on port 80", "LINUX-SYSLOG-RFC3164", 4001, "Traffic", "Unknown", "High", {}),
    ("Jan 15 10:00:01 h fail2ban[1]: [sshd] Ban 9.9.9.9", "LINUX-SYSLOG-RFC3164", 4001, "Traffic", "Unknown", "Medium", {"src_endpoint.ip": "9.9.9.9"}),
    ("Jan 15 10:00:01 h dhcpd: DHCPACK of 10.0.0.7", "LINUX-SYSLOG-RFC3164", 4001, "Traffic", "Unknown", "Informational", {"dst_endpoint.ip": "10.0.0.7"}),
    ("Jan 15 10:00:01 h kernel: apparmor=\"DENIED\" op", "LINUX-SYSLOG-RFC3164", 1001, "System Activity", "Unknown", "High", {"parse_status": "partially_parsed"}),
    ("<34>1 2003-10-11T22:14:15.003Z host app 12 ID47 [ex@1 a=\"[b]\"] body", "LINUX-SYSLOG-RFC5424", 1001, "System Activity", "Unknown", "Critical", {"message": "body", "time": "2003-10-11T22:14:15.003000+00:00", "native['native.facility']": "4"}),
    ("[ 08-10 09:20:19.692  3907: 3921 E/dumpsys ]\nline one\nline two", "ANDROID-LOGCAT-LONG", 6005, "Log", "Unknown", "High", {"message": "line one\nline two", "actor.process.pid": "3907"}),
    ("08-10 09:20:19.692 W/wifi( 39): m", "ANDROID-LOGCAT-TIME", 4001, "Traffic", "Unknown", "Medium", {"time": "2024-08-10T09:20:19.692000+00:00"}),
    ("I( 39) hello (am_crash)", "ANDROID-LOGCAT-PROCESS", 6005, "Crash", "Unknown", "Informational", {"message": "hello"}),
    (BLOCK, "WIN-SEC-4625", 3002, "Logon", "Failure", "Medium", {"actor.user.name": "bob", "actor.user.domain": "D", "unmapped['Account Name']": "SYS", "message": "Failed logon for bob", "native['event_data.subject::Account Name']": "SYS"}),
    ("Provider=Service Control Manager EventID=7036 Level=2 Computer=PC Message=The x service", "WIN-SYS-SVC", 1001, "Unknown", "Unknown", "High", {"device.hostname": "PC"}),
    ("#Fields: date time c-ip cs-method s-ip\n2024-05-01 12:00:00 1.1.1.1 GET 2.2.2.2", "WIN-IIS-W3C", 4002, "HTTP Request", "Unknown", "Informational", {"src_endpoint.ip": "1.1.1.1", "dst_endpoint.ip": "2.2.2.2"}),
    ("Jul  1 09:00:55 calvisitor kernel[0]: IOThunder", "MAC-ULOG-001", 1001, "Unknown", "Unknown", "Informational", {"actor.process.name": "kernel", "needs_review": "true"}),
    ("Jan  5 10:00:01 fw filterlog[12]: 5,,,100,em0,match,block,in,4,0x0,,64,1,0,none,6,tcp,60,1.1.1.1,2.2.2.2,5,80", "FW-W3C-001", 4001, "Unknown", "block", "Informational", {"connection_info.direction": "in"}),
    ("08-10 09:20:19.692  3907  3921 W dumpsys : first\nsecond", "DRAIN3-FALLBACK", 1001, "Unknown", "Unknown", "Informational", {"parse_status": "fallback"}),
    ("  ", "DLQ", 1001, "Unknown", "Failure", "Unknown", {"parse_path": "dlq"}),
]


def test_golden_records(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, raw string").repartition(3)
    paths = sorted({p for g in GOLDEN for p in g[6]})
    out = normalize(df, reference_now=NOW).select("id", "parser_id", "class_uid", "activity_name", "status", "severity", "raw_data", "type_uid", *[F.expr(p).cast("string").alias(f"p{i}") for i, p in enumerate(paths)])
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == len(GOLDEN)
    for i, (raw, *want, more) in enumerate(GOLDEN):
        r = rows[i]
        assert [r.parser_id, r.class_uid, r.activity_name, r.status, r.severity] == want, raw
        assert r.raw_data == raw and r.type_uid == r.class_uid * 100
        for p, v in more.items():
            assert r[f"p{paths.index(p)}"] == v, (raw, p)


def test_uniform_keys_and_filters(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN] + [(None,)], "raw string")
    out = normalize(df, reference_now=NOW)
    assert [c for c in out.columns if c in KEYS] == list(KEYS)
    assert out.filter("class_uid = 3002 and status = 'Failure'").count() == sum(g[2] == 3002 and g[4] == "Failure" for g in GOLDEN)
    assert normalize(df.limit(0)).count() == 0


def test_stage_scores_round_as_documented():
    assert ocsf.stage_scores(5, 6, 12, True, True)["pattern"] == 0.93
    assert ocsf.weighted(ocsf.stage_scores(6, 6, 9, True, True)) == 1.0


def test_pattern_translation():
    p = Pattern(r"(?P<a_b>\w+) (?:x)(y)?[(]")
    assert p.bare == r"(\w+) (?:x)(y)?[(]" and p.names == ["a_b", None]


def test_registry_crud_and_folder(spark, tmp_path):
    r = Registry()
    assert len(r.list()) == len(SPECS) == 23
    made = r.put({"parser_id": None, "substrings": ["ZAP"], "signature": r"ZAP \d+", "pattern": r"ZAP (?P<n>\d+) (?P<user>\w+)", "mapping": {"user": "actor.user.name"}, "class_uid": 9999})
    assert made.startswith("CUSTOM-") and r.get(made)["class_uid"] == 9999
    row = normalize(spark.createDataFrame([("ZAP 007 ann",)], "raw string"), registry=r, reference_now=NOW).select("parser_id", "actor.user.name", "class_uid", "metadata.ocsf_class_requested", "unmapped").first()
    assert (row.parser_id, row.name, row.class_uid, row.ocsf_class_requested, row.unmapped) == (made, "ann", 1001, 9999, {"n": "007"})
    assert Registry.test(r"a(?P<x>b)", "ab") == {"x": "b"} and Registry.test("q", "ab") is None
    (tmp_path / "a.json").write_text(json.dumps({"parser_id": "A"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"parser_id": "A", "weight": 2}))
    folder = Registry.from_folder(str(tmp_path))
    assert [s["parser_id"] for s in folder.list()] == ["A"] and folder.get("A")["weight"] == 0.5
    (tmp_path / "d.json").write_text(json.dumps({"parser_id": "D"}))
    assert len(folder.reload().list()) == 2


@pytest.mark.parametrize("text,want", [("server 10.0.0.1", []), ("srv 10.0.0.1", []), ("from 10.0.0.1", ["10.0.0.1"]), ("KB 1.2.3.4", []), ("1.2.3.4 1.2.3.4 256.1.1.1 ~~6.1.1.2", ["1.2.3.4"])])
def test_addresses(spark, text, want):
    assert spark.range(1).select(ocsf.addresses(F.lit(text)).alias("a")).first().a == want
