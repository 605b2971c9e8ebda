"""Log lines made from the events table, and what their normalisation must give.

Each format has the Spark SQL that renders a row of ``events`` and, for each
checked column, the event path and the DuckDB expression over the source
columns, so the expectation does not go through any parser.
"""

from __future__ import annotations

BSD = "date_format(ts, 'MMM dd HH:mm:ss')"
IP = "concat('10.', user_id % 250, '.', event_id % 250, '.7')"
PORT = "(1024 + event_id % 60000)"
BAD = "event_type IN ('error', 'signup')"
ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
D_IP = "concat('10.', user_id % 250, '.', event_id % 250, '.7')"
D_PORT = "CAST(1024 + event_id % 60000 AS VARCHAR)"


def expected(parser: str, uid: int, activity: str, status: str = "'Unknown'", severity: str = "'Informational'", time: str = TIME, **more: tuple[str, str]) -> dict[str, tuple[str, str]]:
    return {
        "parser_id": ("parser_id", f"'{parser}'"), "class_uid": ("class_uid", f"'{uid}'"), "activity_name": ("activity_name", f"'{activity}'"),
        "status": ("status", status), "severity": ("severity", severity), "time": ("time", time),
    } | more


_USER = {"user_name": ("actor.user.name", "'user' || user_id")}
_SRC = {"src_ip": ("src_endpoint.ip", D_IP), "src_port": ("src_endpoint.port", D_PORT)}
_SRC_IP = {"src_ip": ("src_endpoint.ip", D_IP)}

FORMATS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "linux_ssh": (
        f"concat({BSD}, ' host', event_id % 50, ' sshd[', 1000 + event_id % 9000, ']: ', if({BAD}, 'Failed', 'Accepted'), ' password for user', user_id, ' from ', {IP}, ' port ', {PORT}, ' ssh2')",
        expected("LINUX-SYSLOG-RFC3164", 3002, "Logon", f"CASE WHEN {BAD} THEN 'Failure' ELSE 'Success' END", f"CASE WHEN {BAD} THEN 'Medium' ELSE 'Informational' END", hostname=("device.hostname", "'host' || event_id % 50"), pid=("actor.process.pid", "CAST(1000 + event_id % 9000 AS VARCHAR)"), auth_protocol=("auth_protocol", "'SSH2'"), observable=("observables[0].value", D_IP), **_USER, **_SRC),
    ),
    "linux_netfilter": (
        f"concat({BSD}, ' fw1 kernel: [', event_id, '.5] [UFW ', if({BAD}, 'BLOCK', 'ALLOW'), '] IN=eth0 OUT= SRC=', {IP}, ' DST=192.168.1.', event_id % 200, ' LEN=60 PROTO=TCP SPT=', {PORT}, ' DPT=443')",
        expected("LINUX-SYSLOG-RFC3164", 4001, "Traffic", f"CASE WHEN {BAD} THEN 'Failure' ELSE 'Unknown' END", f"CASE WHEN {BAD} THEN 'Medium' ELSE 'Informational' END", dst_ip=("dst_endpoint.ip", "'192.168.1.' || event_id % 200"), dst_port=("dst_endpoint.port", "'443'"), protocol=("connection_info.protocol_name", "'TCP'"), fw_action=("unmapped['fw_action']", f"CASE WHEN {BAD} THEN 'BLOCK' ELSE 'ALLOW' END"), **_SRC),
    ),
    "linux_http": (
        f"concat({BSD}, ' web nginx: ', {IP}, ' - - [x] \"GET /p/', user_id, ' HTTP/1.1\" ', if({BAD}, 500, 200), ' 12')",
        expected("LINUX-SYSLOG-RFC3164", 4002, "HTTP Request", severity=f"CASE WHEN {BAD} THEN 'Medium' ELSE 'Informational' END", method=("http_request.http_method", "'GET'"), url_path=("http_request.path", "'/p/' || user_id"), code=("http_response.code", f"CASE WHEN {BAD} THEN '500' ELSE '200' END"), **_SRC_IP),
    ),
    "linux_sudo": (
        f"concat('<86>', {BSD}, ' h sudo: ann : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/run ', event_id)",
        expected("LINUX-SYSLOG-RFC3164", 1007, "Launch", cmd_line=("actor.process.cmd_line", "'/bin/run ' || event_id"), process=("actor.process.name", "'sudo'")),
    ),
    "linux_account": (
        f"concat({BSD}, ' h useradd[', 100 + event_id % 900, ']: new user: name=user', user_id)",
        expected("LINUX-SYSLOG-RFC3164", 3005, "Account Change", pid=("actor.process.pid", "CAST(100 + event_id % 900 AS VARCHAR)")),
    ),
    "linux_oom": (
        f"concat({BSD}, ' h kernel: Out of memory: Killed process ', event_id, ' (proc', user_id, ') total')",
        expected("LINUX-SYSLOG-RFC3164", 1007, "Terminate", severity="'High'", process=("actor.process.name", "'proc' || user_id")),
    ),
    "linux_rfc5424": (
        f"concat('<', if({BAD}, 131, 134), '>1 ', {ISO}, 'Z host', event_id % 9, ' app ', event_id, ' ID1 [ex@1 k=\"', user_id, '\"] order ', event_id, ' done')",
        expected("LINUX-SYSLOG-RFC5424", 1001, "System Activity", severity=f"CASE WHEN {BAD} THEN 'High' ELSE 'Informational' END", message=("message", "'order ' || event_id || ' done'"), hostname=("device.hostname", "'host' || event_id % 9"), structured=("native['native.structured_data']", "'[ex@1 k=\"' || user_id || '\"]'"), facility=("native['native.facility']", "'16'")),
    ),
    "linux_auditd": (
        f"concat('type=EXECVE msg=audit(', {EPOCH}, '.000:', event_id, '): argc=1 a0=\"/bin/p', user_id, '\"')",
        expected("LINUX-AUDITD", 1007, "Launch", cmd_line=("actor.process.cmd_line", "'/bin/p' || user_id"), serial=("native['native.audit_serial']", "CAST(event_id AS VARCHAR)")),
    ),
    "linux_journald": (
        f"concat('{{\"MESSAGE\":\"Accepted publickey for user', user_id, ' from ', {IP}, ' port ', {PORT}, '\",\"_PID\":\"', event_id, '\",\"PRIORITY\":\"4\",\"_HOSTNAME\":\"j1\",\"SYSLOG_IDENTIFIER\":\"sshd\",\"__REALTIME_TIMESTAMP\":\"', {EPOCH}, '000000\"}}')",
        expected("LINUX-JOURNALD-JSON", 3002, "Logon", "'Success'", "'Medium'", hostname=("device.hostname", "'j1'"), pid=("actor.process.pid", "CAST(event_id AS VARCHAR)"), **_USER, **_SRC),
    ),
    "linux_dmesg": (
        "concat('[', event_id, '.25] usb', user_id, ': new device ', event_type)",
        expected("LINUX-KERNEL-DMESG", 1001, "System Activity", time="'2024-06-01T00:00:00+00:00'", process=("actor.process.name", "'usb' || user_id"), uptime=("native['native.uptime']", "event_id || '.25'")),
    ),
    "android_threadtime": (
        f"concat(date_format(ts, 'MM-dd HH:mm:ss'), '.250  ', event_id, '  7 ', if({BAD}, 'E', 'I'), ' ', if(event_id % 2 = 0, 'netd', 'Launcher'), ': user ', user_id)",
        {
            "parser_id": ("parser_id", "'ANDROID-LOGCAT-THREADTIME'"), "class_uid": ("class_uid", "CASE WHEN event_id % 2 = 0 THEN '4001' ELSE '6005' END"), "activity_name": ("activity_name", "CASE WHEN event_id % 2 = 0 THEN 'Traffic' ELSE 'Log' END"),
            "severity": ("severity", f"CASE WHEN {BAD} THEN 'High' ELSE 'Informational' END"), "time": ("time", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250000+00:00'"), "message": ("message", "'user ' || user_id"), "tid": ("unmapped['tid']", "'7'"), "mapping": ("ocsf_mapping_status", "CASE WHEN event_id % 2 = 0 THEN 'mapped' ELSE 'unmapped' END"),
        },
    ),
    "android_json": (
        "concat('{\"tag\":\"am_proc_start\",\"priority\":\"warn\",\"pid\":', event_id, ',\"message\":\"u', user_id, ' servicename: svc', user_id, '\"}')",
        expected("ANDROID-LOGCAT-JSON", 1007, "Launch", severity="'Medium'", time="'2024-06-01T00:00:00+00:00'", pid=("actor.process.pid", "CAST(event_id AS VARCHAR)"), service=("native['service_name']", "'svc' || user_id")),
    ),
    "windows_logon": (
        f"concat('Log Name: Security\\nSource: Microsoft-Windows-Security-Auditing\\nDate: ', {ISO}, 'Z\\nEvent ID: ', if({BAD}, 4625, 4624), '\\nLevel: Information\\nComputer: PC', event_id % 20, '\\nSubject:\\n\\tAccount Name:\\t\\tSYSTEM\\nLogon Type:\\t\\t3\\nNew Logon:\\n\\tAccount Name:\\t\\tuser', user_id, '\\n\\tAccount Domain:\\t\\tCORP\\nNetwork Information:\\n\\tSource Network Address:\\t', {IP}, '\\n\\tSource Port:\\t\\t', {PORT})",
        expected("X", 3002, "Logon", f"CASE WHEN {BAD} THEN 'Failure' ELSE 'Success' END", f"CASE WHEN {BAD} THEN 'Medium' ELSE 'Informational' END", hostname=("device.hostname", "'PC' || event_id % 20"), domain=("actor.user.domain", "'CORP'"), logon_type=("unmapped['logon_type']", "'Network'"), **_USER, **_SRC) | {"parser_id": ("parser_id", f"CASE WHEN {BAD} THEN 'WIN-SEC-4625' ELSE 'WIN-SEC-4624' END")},
    ),
    "windows_kv": (
        f"concat('Provider=Microsoft-Windows-Sysmon EventID=3 Channel=Sysmon/Operational Computer=PC1 SourceIp=', {IP}, ' SourcePort=', {PORT}, ' DestinationIp=8.8.8.8 DestinationPort=53 Protocol=udp Image=C:\\\\Program Files\\\\a', user_id, '.exe')",
        expected("WIN-SYSMON-001", 4001, "Traffic", time="'2024-06-01T00:00:00+00:00'", dst_ip=("dst_endpoint.ip", "'8.8.8.8'"), dst_port=("dst_endpoint.port", "'53'"), image=("actor.process.name", "'C:\\Program Files\\a' || user_id || '.exe'"), **_SRC),
    ),
    "windows_xml": (
        f"concat('<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System><Provider Name=\"Microsoft-Windows-Security-Auditing\"/><EventID>4688</EventID><Level>0</Level><Channel>Security</Channel><Computer>PC2</Computer><TimeCreated SystemTime=\"', {ISO}, '.500Z\"/></System><EventData><Data Name=\"NewProcessName\">C:\\\\p', user_id, '.exe</Data><Data Name=\"NewProcessId\">', event_id, '</Data></EventData></Event>')",
        expected("WIN-SEC-4688", 1007, "Launch", time="strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.500000+00:00'", process=("actor.process.name", "'C:\\p' || user_id || '.exe'"), pid=("actor.process.pid", "CAST(event_id AS VARCHAR)"), hostname=("device.hostname", "'PC2'")),
    ),
    "windows_iis": (
        f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' 10.0.0.1 GET /p/', user_id, ' - 80 - ', {IP}, ' UA ', if({BAD}, 500, 200), ' 0 0 5')",
        expected("WIN-IIS-W3C", 4002, "HTTP Request", url_path=("http_request.path", "'/p/' || user_id"), code=("http_response.code", f"CASE WHEN {BAD} THEN '500' ELSE '200' END"), dst_port=("dst_endpoint.port", "'80'"), **_SRC_IP),
    ),
    "windows_firewall": (
        f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), if({BAD}, ' DROP', ' ALLOW'), ' TCP ', {IP}, ' 10.9.9.9 ', {PORT}, ' 443 0 - - - - - - - RECEIVE')",
        expected("WIN-FIREWALL-001", 4001, "Traffic", f"CASE WHEN {BAD} THEN 'Failure' ELSE 'Success' END", dst_port=("dst_endpoint.port", "'443'"), protocol=("connection_info.protocol_name", "'TCP'"), **_SRC),
    ),
    "registry_filterlog": (
        f"concat({BSD}, ' fw filterlog[', 1 + event_id % 99, ']: 5,,,100,em0,match,', if({BAD}, 'block', 'pass'), ',in,4,0x0,,64,', event_id, ',0,none,6,tcp,60,', {IP}, ',192.168.0.1,', {PORT}, ',443')",
        expected("FW-W3C-001", 4001, "Unknown", f"CASE WHEN {BAD} THEN 'block' ELSE 'pass' END", direction=("connection_info.direction", "'in'"), dst_port=("dst_endpoint.port", "'443'"), path=("parse_path", "'ngre'"), **_SRC),
    ),
    "registry_cbs": (
        "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ', Info                  CBS    Appl: Package_for_KB', 2900000 + event_id, '~31bf3856ad364e35~amd64~~6.1.1.', user_id, ', ApplicableState: 112, CurrentState: ', event_id % 7)",
        expected("WIN-CBS-001", 1001, "Unknown", version=("native['package.version']", "'6.1.1.' || user_id"), kb=("native['package.kb']", "'KB' || (2900000 + event_id)"), state=("native['current_state']", "CAST(event_id % 7 AS VARCHAR)"), observed=("size(observables)", "'0'")),
    ),
    "fallback_template": (
        "concat('widget ', event_id, ' reported ', event_type, ' state')",
        {"parser_id": ("parser_id", "'DRAIN3-FALLBACK'"), "status": ("parse_status", "'fallback'"), "template": ("metadata.drain3_template", "'widget <*> reported ' || event_type || ' state'"), "review": ("needs_review", "'true'"), "format_score": ("confidence_breakdown.format", "'0.5'")},
    ),
    "dead_letter": (
        "if(event_id % 2 = 0, cast(null as string), repeat(' ', cast(event_id % 5 as int)))",
        {"parser_id": ("parser_id", "'DLQ'"), "status": ("status", "'Failure'"), "parse_status": ("parse_status", "'failed'"), "severity": ("severity", "'Unknown'")},
    ),
}
#: Formats of the mixed corpus, by event_id modulo their number.
MIX = [n for n in FORMATS]
