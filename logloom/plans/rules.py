"""Lines that each reach one rule or layout, and what their normalisation must give.

An entry is a Spark SQL text for the line and the expected values (DuckDB SQL)
of the group's columns; a column that an entry does not name is expected to be null. Lines with two matches
check that the leftmost decides. Events are dealt to the entries by event_id.
"""

from __future__ import annotations

_BSD = "date_format(ts, 'MMM dd HH:mm:ss')"


def _syslog(program: str, message: str) -> str:
    return f"concat({_BSD}, ' h {program}: ', {message})"


def _linux(program: str, message: str, uid: int, activity: str, status: str = "Unknown", severity: str = "Informational", **more: str) -> tuple[str, dict[str, str]]:
    given = {"parser_id": "LINUX-SYSLOG-RFC3164", "class_uid": str(uid), "activity_name": activity, "status": status, "severity": severity, "process": program.split("[")[0]} | more
    return _syslog(program, message), {k: v if v.startswith("'") else f"'{v}'" for k, v in given.items()}


def _windows(text: str, parser: str, uid: int, activity: str, status: str = "Unknown", severity: str = "Informational", **more: str) -> tuple[str, dict[str, str]]:
    given = {"parser_id": parser, "class_uid": str(uid), "activity_name": activity, "status": status, "severity": severity} | more
    return f"concat({text})", {k: v if v.startswith("'") else f"'{v}'" for k, v in given.items()}


def _security(eid: int, activity: str, key: str = "TargetUserName", status: str = "Unknown", severity: str = "Informational", uid: int = 3005) -> tuple[str, dict[str, str]]:
    return _windows(f"'Provider=Microsoft-Windows-Security-Auditing EventID={eid} Channel=Security Computer=PC1 {key}=user', user_id", f"WIN-SEC-{eid}", uid, activity, status, severity, user_name="'user' || user_id")


def _any(line: str, **given: str) -> tuple[str, dict[str, str]]:
    return line, {k: v if v.startswith("'") else f"'{v}'" for k, v in given.items()}


def _android(line: str, layout: str, uid: int, activity: str, severity: str, process: str, pid: str, message: str) -> tuple[str, dict[str, str]]:
    return _any(line, parser_id=f"ANDROID-LOGCAT-{layout}", class_uid=str(uid), activity_name=activity, severity=severity, process=process, pid=pid, message=message)


_VERB = "'08-10 09:20:19.692  39  7 I {}: x', user_id"
_SYSMON = "'Provider=Microsoft-Windows-Sysmon EventID={} Channel=S Computer=PC1 "

#: group: (columns with their event paths, entries).
GROUPS: dict[str, tuple[dict[str, str], list[tuple[str, dict[str, str]]]]] = {
    "linux_rules": (
        {"parser_id": "parser_id", "class_uid": "class_uid", "activity_name": "activity_name", "status": "status", "severity": "severity", "user_name": "actor.user.name", "src_ip": "src_endpoint.ip", "dst_ip": "dst_endpoint.ip", "process": "actor.process.name", "cmd_line": "actor.process.cmd_line"},
        [
            _linux("nginx", "'10.0.0.1 - - [x] \"GET /a HTTP/1.1\" 200 5 \"GET /x HTTP/1.1\" 404 ', event_id", 4002, "HTTP Request", src_ip="10.0.0.1"),
            _linux("nginx", "'[error] client 10.1.1.7, x', event_id", 4002, "HTTP Request", severity="Medium", src_ip="10.1.1.7"),
            _linux("sshd[1]", "'Failed password for bob', user_id, ' from 10.0.0.1 port 5 ssh2; Accepted password for al from 10.0.0.2 port 6'", 3002, "Logon", "Failure", "Medium", user_name="'bob' || user_id", src_ip="10.0.0.1"),
            _linux("sshd[1]", "'Invalid user eve', user_id, ' from 10.0.0.9 port 4'", 3002, "Logon", "Failure", "Medium", user_name="'eve' || user_id", src_ip="10.0.0.9"),
            _linux("sshd[1]", "'pam_unix(sshd:session): session closed for user al', user_id", 3002, "Logon", "Success", user_name="'al' || user_id"),
            _linux("postgres[1]", "'connection authorized: user=u', user_id, ' database=db client=10.0.0.3'", 3002, "Logon", "Success", user_name="'u' || user_id", src_ip="10.0.0.3"),
            _linux("postgres[1]", "'password authentication failed for user \"pg', user_id, '\"'", 3002, "Logon", "Failure", "Medium", user_name="'pg' || user_id"),
            _linux("audit", "'USER_LOGIN pid=', event_id", 3002, "Logon"),
            _linux("passwd[7]", "'password changed for user', user_id", 3005, "Account Change"),
            _linux("cron[1]", "'(root) CMD (/bin/x ', event_id, ')'", 1007, "Launch", cmd_line="'/bin/x ' || event_id"),
            _linux("kernel", "'SYSCALL arch=c0 exe=\"/usr/bin/i', user_id, '\" key=1'", 1007, "Launch", cmd_line="'/usr/bin/i' || user_id"),
            _linux("kernel", "'Out of memory in x', event_id", 1007, "Terminate", severity="High"),
            _linux("dockerd[1]", "'container a', user_id, ' started then container b2 exited'", 1007, "Launch", process="'a' || user_id"),
            _linux("dockerd[1]", "'container z', user_id, ' died'", 1007, "Terminate", process="'z' || user_id"),
            _linux("app[1]", "'x: segfault at ', event_id", 1007, "Terminate", severity="High"),
            _linux("kernel", "'TCP: Possible SYN flooding on port ', event_id", 4001, "Traffic", severity="High"),
            _linux("fail2ban[1]", "'[sshd] Unban 1.1.1.1 after Ban 2.2.2.', user_id % 250", 4001, "Traffic", src_ip="1.1.1.1"),
            _linux("fail2ban[1]", "'[sshd] Ban 9.9.9.', user_id % 250", 4001, "Traffic", severity="Medium", src_ip="'9.9.9.' || user_id % 250"),
            _linux("dhcpd", "'DHCPREQUEST for 10.0.0.7; DHCPACK of 10.0.0.8 ', event_id", 4001, "Traffic"),
            _linux("dhcpd", "'DHCPACK of 10.0.0.', user_id % 250", 4001, "Traffic", dst_ip="'10.0.0.' || user_id % 250"),
            _linux("kernel", "'apparmor=\"DENIED\" op=', event_id", 1001, "System Activity", severity="High"),
        ],
    ),
    "windows_kinds": (
        {"parser_id": "parser_id", "class_uid": "class_uid", "activity_name": "activity_name", "status": "status", "severity": "severity", "user_name": "actor.user.name", "process": "actor.process.name", "cmd_line": "actor.process.cmd_line", "file_path": "actor.process.file.path", "hostname": "device.hostname"},
        [
            (line, {"hostname": "'PC1'"} | given)
            for line, given in [
                _security(4634, "Logon", status="Success", uid=3002), _security(4647, "Logon", status="Success", uid=3002), _security(4648, "Logon", status="Success", uid=3002), _security(4672, "Logon", "SubjectUserName", uid=3002),
                _security(4720, "Create"), _security(4722, "Enable"), _security(4725, "Disable"), _security(4726, "Delete"), _security(4728, "Modify"), _security(4732, "Modify"), _security(4756, "Modify"), _security(4740, "Lockout", severity="Medium"),
                _windows(_SYSMON.format(1) + "Image=C:/a.exe CommandLine=a.exe -x ', event_id, ' User=U1 ParentImage=p.exe'", "WIN-SYSMON-001", 1007, "Launch", process="C:/a.exe", cmd_line="'a.exe -x ' || event_id", user_name="U1"),
                _windows(_SYSMON.format(11) + "TargetFilename=C:/f', event_id, ' Image=i.exe'", "WIN-SYSMON-001", 1001, "File Create", process="i.exe", file_path="'C:/f' || event_id"),
                _windows("'Provider=Microsoft-Windows-PowerShell EventID=4103 Computer=PC1 ScriptBlockText=Get-X ', event_id", "WIN-PWSH-4103", 1007, "Launch", cmd_line="'Get-X ' || event_id"),
                _windows("'Provider=Microsoft-Windows-Windows Defender EventID=1116 Computer=PC1 ThreatName=Eicar Path=C:/e User=user', user_id", "WIN-DEFENDER-001", 1001, "Detection", severity="High", user_name="'user' || user_id", file_path="C:/e"),
                _windows("'Provider=Service Control Manager EventID=7036 Level=2 Computer=PC1 Message=The x', event_id", "WIN-SYS-SVC", 1001, "Unknown", severity="High"),
                _windows("'Provider=Microsoft-Windows-Kernel EventID=12 Computer=PC1 User=user', user_id", "WIN-EVTLOG-001", 1001, "Unknown", user_name="'user' || user_id"),
            ]
        ],
    ),
    "android_layouts": (
        {"parser_id": "parser_id", "class_uid": "class_uid", "activity_name": "activity_name", "severity": "severity", "process": "actor.process.name", "pid": "actor.process.pid", "message": "message"},
        [
            _android("concat('08-10 09:20:19.692 W/wifi( 39): m', event_id)", "TIME", 4001, "Traffic", "Medium", "wifi", "39", "'m' || event_id"),
            _android("concat('E/zygote( 12): boom', event_id)", "BRIEF", 1007, "Process Activity", "High", "zygote", "12", "'boom' || event_id"),
            _android("concat('I( 39) hello', event_id, ' (am_crash)')", "PROCESS", 6005, "Crash", "Informational", "am_crash", "39", "'hello' || event_id"),
            _android("concat('[ 08-10 09:20:19.692  3907: 3921 E/dumpsys ]\\nline ', event_id)", "LONG", 6005, "Log", "High", "dumpsys", "3907", "'line ' || event_id"),
            _android("concat('{\"tag\":\"am_anr\",\"priority\":\"F\",\"pid\":5,\"message\":\"x', event_id, '\"}')", "JSON", 6005, "ANR", "Critical", "am_anr", "5", "'x' || event_id"),
            *(_android(f"concat({_VERB.format(verb)})", "THREADTIME", uid, name, "Informational", verb, "39", "'x' || user_id") for verb, uid, name in (("am_proc_died", 1007, "Terminate"), ("am_kill", 1007, "Terminate"), ("am_create_activity", 6005, "Launch"), ("am_finish_activity", 6005, "Terminate"), ("dvm_lock_sample", 1001, "Lock"))),
        ],
    ),
    "registry_parsers": (
        {"parser_id": "parser_id", "class_uid": "class_uid", "status": "status", "severity": "severity", "process": "actor.process.name", "message": "message", "os_name": "device.os.name", "parse_path": "parse_path"},
        [
            (line, {"status": "'Unknown'", "severity": "'Informational'", "parse_path": "'ngre'"} | given)
            for line, given in [
                _any("concat('Jul  1 09:00:55 calvisitor kernel[0]: IOThunder ', event_id)", parser_id="MAC-ULOG-001", class_uid="1001", process="kernel", message="'IOThunder ' || event_id", os_name="macOS"),
                _any("concat('Jul  1 09:00:55 host socketfilterfw[113] <Info>: Allow x', event_id)", parser_id="MAC-APPFW-001", class_uid="4001", process="socketfilterfw", message="'Allow x' || event_id", os_name="macOS"),
                _any("concat('Thu Jul  1 09:00:55.123 <airportd[64]> scan ', event_id)", parser_id="MAC-WIFI-001", class_uid="4001", process="airportd", message="'scan ' || event_id", os_name="macOS"),
                _any("concat('2024-01-01 10:00:00+02 mac installd[93]: Installed ', event_id)", parser_id="MAC-INSTALL-001", class_uid="6005", process="installd", message="'Installed ' || event_id", os_name="macOS"),
                _any("concat('[Time 2024.01.01] [Sender foo] [Level 3] [PID 7] [Message hi ', event_id, ']')", parser_id="MAC-ASL-LEGACY", class_uid="1001", process="foo", message="'hi ' || event_id", os_name="macOS"),
            ]
        ],
    ),
}


def line(group: str) -> str:
    """Spark SQL of every event's line."""
    entries = GROUPS[group][1]
    return f"CASE event_id % {len(entries)} " + " ".join(f"WHEN {i} THEN {x}" for i, (x, _) in enumerate(entries)) + " END"


def oracle(group: str) -> str:
    columns, entries = GROUPS[group]
    case = lambda c: f"CASE event_id % {len(entries)} " + " ".join(f"WHEN {i} THEN {given[c]}" for i, (_, given) in enumerate(entries) if c in given) + " END"
    return "SELECT event_id, " + ", ".join(f"CAST({case(c)} AS VARCHAR) AS {c}" for c in columns) + " FROM events"
