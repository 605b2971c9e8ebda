"""The declarative parser table: one row for each registry parser.

Identifiers, patterns and field paths are formats that results depend on.
"""

from __future__ import annotations

FIELDS = ("parser_id", "source_name", "os_family", "category", "class_uid", "weight", "substrings", "signature", "processes", "pattern", "mapping", "static", "activity_id", "activity_name")

# Identifiers, patterns and mappings of the log formats, in order of parser_id.
ROWS = [
    (
        'FW-GENERIC-001',
        'Generic Firewall Log (iptables/netfilter/UFW kernel style)',
        'Network',
        'Network Activity',
        4001,
        0.9,
        ['SRC=', 'DST=', 'PROTO='],
        'SRC=[\\d\\.]+\\s+DST=[\\d\\.]+',
        ['kernel'],
        '^(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>\\S+)\\s+kernel:(?:\\s*\\[[\\d\\. ]+\\])?\\s*(?:\\[(?:UFW\\s+)?(?P<action>ACCEPT|DROP|REJECT|BLOCK|ALLOW)\\])?.*?\\bIN=(?P<in_iface>\\S*).*?SRC=(?P<src_ip>[\\d\\.]+)\\s+DST=(?P<dst_ip>[\\d\\.]+).*?PROTO=(?P<protocol>\\w+)(?:.*?SPT=(?P<src_port>\\d+))?(?:.*?DPT=(?P<dst_port>\\d+))?',
        {'host': 'device.hostname', 'src_ip': 'src_endpoint.ip', 'dst_ip': 'dst_endpoint.ip', 'src_port': 'src_endpoint.port', 'dst_port': 'dst_endpoint.port', 'protocol': 'connection_info.protocol_name', 'action': 'status'},
        {},
        None,
        None,
    ),
    (
        'FW-W3C-001',
        'pfSense filterlog (W3C/CSV firewall log)',
        'Network',
        'Network Activity',
        4001,
        0.9,
        ['filterlog'],
        'filterlog\\[\\d+\\]:\\s*\\d+,.*?,(?:block|pass|rdr|nat),',
        ['filterlog'],
        '^(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>\\S+)\\s+filterlog\\[(?P<pid>\\d+)\\]:\\s*(?P<rulenum>\\d+),[^,]*,[^,]*,(?P<tracker>\\d+),(?P<iface>[^,]+),(?P<reason>[^,]+),(?P<action>block|pass|rdr|nat),(?P<direction>in|out),(?P<ipver>\\d+),[^,]*,[^,]*,(?P<ttl>\\d+),(?P<ipid>\\d+),[^,]*,[^,]*,(?P<protoid>\\d+),(?P<protocol>\\w+),(?P<length>\\d+),(?P<src_ip>[\\d\\.]+),(?P<dst_ip>[\\d\\.]+),(?P<src_port>\\d+),(?P<dst_port>\\d+)',
        {'host': 'device.hostname', 'src_ip': 'src_endpoint.ip', 'dst_ip': 'dst_endpoint.ip', 'src_port': 'src_endpoint.port', 'dst_port': 'dst_endpoint.port', 'protocol': 'connection_info.protocol_name', 'direction': 'connection_info.direction', 'action': 'status'},
        {},
        None,
        None,
    ),
    (
        'LINUX-AUTH-001',
        'Linux auth.log SSH authentication (sshd)',
        'Linux',
        'Authentication',
        3002,
        1.0,
        ['sshd'],
        'sshd\\[\\d+\\]:\\s+(?:Accepted|Failed)\\s+\\w+\\s+for',
        ['sshd'],
        '^(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>\\S+)\\s+sshd\\[(?P<pid>\\d+)\\]:\\s+(?P<result>Accepted|Failed)\\s+(?P<auth_method>\\w+)\\s+for\\s+(?:invalid user\\s+)?(?P<user>\\S+)\\s+from\\s+(?P<src_ip>[\\da-fA-F\\.:]+)\\s+port\\s+(?P<src_port>\\d+)',
        {'host': 'device.hostname', 'user': 'actor.user.name', 'auth_method': 'auth_protocol', 'src_ip': 'src_endpoint.ip', 'src_port': 'src_endpoint.port', 'result': 'status'},
        {'actor.process.name': 'sshd'},
        None,
        None,
    ),
    (
        'LINUX-SYSLOG-001',
        'Linux syslog / kern.log / messages (RFC3164 style)',
        'Linux',
        'System Activity',
        1001,
        0.9,
        [],
        '^\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\s+\\S+\\s+\\S+(\\[\\d+\\])?:',
        ['sshd', 'sudo', 'systemd', 'cron', 'crond', 'NetworkManager', 'dbus-daemon', 'rsyslogd', 'kthreadd'],
        '^(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>\\S+)\\s+(?P<process>[\\w\\.\\-/]+)(?:\\[(?P<pid>\\d+)\\])?:\\s*(?P<message>.*)$',
        {'host': 'device.hostname', 'process': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'MAC-APPFW-001',
        'macOS Application Firewall (socketfilterfw)',
        'macOS',
        'Network Activity',
        4001,
        1.0,
        ['socketfilterfw'],
        'socketfilterfw\\[\\d+\\]\\s*<[^>]+>:',
        ['socketfilterfw'],
        '^(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>\\S+)\\s+socketfilterfw\\[(?P<pid>\\d+)\\]\\s*<(?P<level>[^>]+)>:\\s*(?P<message>.*)$',
        {'host': 'device.hostname', 'pid': 'actor.process.pid', 'message': 'message'},
        {'actor.process.name': 'socketfilterfw'},
        None,
        None,
    ),
    (
        'MAC-ASL-LEGACY',
        'macOS Apple System Log (ASL)',
        'macOS',
        'System Activity',
        1001,
        0.9,
        ['[Sender ', '[Message '],
        '\\[Sender [^\\]]+\\][\\s\\S]*?\\[Message ',
        [],
        '\\[Time (?P<datetime>[^\\]]+)\\][\\s\\S]*?\\[Sender (?P<process>[^\\]]+)\\][\\s\\S]*?\\[Level (?P<level_num>\\d+)\\][\\s\\S]*?\\[PID (?P<pid>\\d+)\\][\\s\\S]*?\\[Message (?P<message>[^\\]]*)\\]',
        {'process': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'MAC-CRASH-IPS',
        'macOS Crash Report (.ips)',
        'macOS',
        'Application Lifecycle',
        6005,
        0.9,
        ['"app_name"', '"bug_type"'],
        '"app_name"\\s*:\\s*"[^"]*"[\\s\\S]*?"bug_type"\\s*:',
        [],
        '"app_name"\\s*:\\s*"(?P<process>[^"]*)"[\\s\\S]*?"timestamp"\\s*:\\s*"(?P<timestamp>[^"]*)"[\\s\\S]*?"bug_type"\\s*:\\s*"(?P<bug_type>[^"]*)"[\\s\\S]*?"os_version"\\s*:\\s*"(?P<os_version>[^"]*)"[\\s\\S]*?"incident_id"\\s*:\\s*"(?P<incident_id>[^"]*)"',
        {'process': 'actor.process.name', 'incident_id': 'metadata.uid_alt'},
        {'severity_id': 4, 'severity': 'High', 'status': 'Failure'},
        None,
        None,
    ),
    (
        'MAC-INSTALL-001',
        'macOS Installer (install.log)',
        'macOS',
        'Application Lifecycle',
        6005,
        1.0,
        ['installd'],
        '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(?:[\\+\\-]\\d{2,4})?\\s+\\S+\\s+[^\\[]+\\[\\d+\\]:',
        ['installd', 'installer', 'softwareupdated', 'packagekit'],
        '^(?P<datetime>\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})(?P<tzoffset>[\\+\\-]\\d{2,4})?\\s+(?P<host>\\S+)\\s+(?P<process>[^\\[]+)\\[(?P<pid>\\d+)\\]:\\s*(?P<message>.*)$',
        {'datetime': '_datetime', 'host': 'device.hostname', 'process': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'MAC-ULOG-001',
        'macOS Syslog / Unified Log (BSD)',
        'macOS',
        'System Activity',
        1001,
        0.92,
        [],
        '^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s{1,2}\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\s+[\\w][\\w\\.-]*\\s+[^\\[]+\\[\\d+\\](?:\\s*\\([^)]*\\))?:',
        ['kernel', 'launchd', 'WindowServer', 'loginwindow', 'syslogd', 'sandboxd', 'mDNSResponder', 'configd', 'symptomsd', 'coreauthd', 'com.apple.CDScheduler', 'networkd', 'blued', 'UserEventAgent'],
        '^(?P<month>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))\\s{1,2}(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<host>[\\w][\\w\\.-]*)\\s+(?P<process>[^\\[\\s][^\\[]*?)\\[(?P<pid>\\d+)\\](?:\\s*\\([^)]*\\))?:\\s*(?P<message>.*)$',
        {'host': 'device.hostname', 'process': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'MAC-ULOG-UNIFIED-JSON',
        'macOS Unified Log (log show ndjson)',
        'macOS',
        'System Activity',
        1001,
        0.9,
        ['"eventMessage"', '"timestamp"'],
        '"eventMessage"\\s*:\\s*"[\\s\\S]*?"(?:processImagePath|subsystem)"',
        [],
        '"timestamp"\\s*:\\s*"(?P<timestamp>[^"]+)"[\\s\\S]*?"messageType"\\s*:\\s*"(?P<message_type>[^"]*)"[\\s\\S]*?"eventMessage"\\s*:\\s*"(?P<message>(?:[^"\\\\]|\\\\.)*)"[\\s\\S]*?"processImagePath"\\s*:\\s*"(?P<process_path>[^"]*)"[\\s\\S]*?"processID"\\s*:\\s*(?P<pid>\\d+)[\\s\\S]*?"subsystem"\\s*:\\s*"(?P<subsystem>[^"]*)"[\\s\\S]*?"category"\\s*:\\s*"(?P<log_category>[^"]*)"',
        {'process_path': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'MAC-WIFI-001',
        'macOS Wi-Fi (airportd)',
        'macOS',
        'Network Activity',
        4001,
        1.0,
        ['airportd'],
        '^\\w{3}\\s+\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\.\\d+\\s+<[^\\[]+\\[\\d+\\]>',
        ['airportd', 'airport'],
        '^(?P<weekday>\\w{3})\\s+(?P<month>\\w{3})\\s+(?P<day>\\d{1,2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\.(?P<ms>\\d+)\\s+<(?P<process>[^\\[]+)\\[(?P<pid>\\d+)\\]>\\s*:?\\s*(?P<message>.*)$',
        {'process': 'actor.process.name', 'pid': 'actor.process.pid', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'WIN-AD-DS',
        'Windows Security Auditing',
        'Windows',
        'Entity Management',
        3005,
        1.0,
        ['Event ID:', 'Target Account'],
        'Event ID:\\s*(?:4720|4726|4738|4740|4767)\\b',
        ['Microsoft-Windows-Security-Auditing'],
        'Event ID:\\s*(?P<event_id>\\d+)\\b[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?Subject:[\\s\\S]*?Account Name:\\s*(?P<actor_account>[^\\r\\n]+)[\\s\\S]*?Target Account:[\\s\\S]*?Account Name:\\s*(?P<target_account>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'actor_account': 'actor.user.name', 'target_account': 'actor.user.domain'},
        {},
        1,
        'Create',
    ),
    (
        'WIN-CBS-001',
        'Windows CBS/CSI Component Store Log',
        'Windows',
        'System Activity',
        1001,
        0.9,
        ['CBS'],
        '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}, \\w+\\s+(?:CBS|CSI)\\s+',
        ['CBS', 'CSI', 'TrustedInstaller', 'WindowsUpdateAgent'],
        '^(?P<datetime>\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}), (?P<level>\\w+)\\s+(?P<component>CBS|CSI)\\s+(?P<message>.+)$',
        {'datetime': '_datetime', 'component': 'actor.process.name', 'message': 'message'},
        {},
        None,
        None,
    ),
    (
        'WIN-DHCP-001',
        'Windows DHCP Server',
        'Windows',
        'Network Activity',
        4001,
        0.6,
        [],
        '^\\d{1,3},\\d{2}/\\d{2}/\\d{2},\\d{2}:\\d{2}:\\d{2},(?:Assign|Renew|Release|Expire|Delete|Deny|Offer|Ack|Nack|New)\\b',
        ['Assign', 'Renew', 'Release', 'Ack', 'Nack'],
        '^(?P<event_code>\\d{1,3}),(?P<date>\\d{2}/\\d{2}/\\d{2}),(?P<time>\\d{2}:\\d{2}:\\d{2}),(?P<description>[^,]*),(?P<ip>\\d{1,3}(?:\\.\\d{1,3}){3}),(?P<hostname>[^,]*),(?P<mac>[0-9A-Fa-f]*)',
        {'ip': 'src_endpoint.ip', 'hostname': 'src_endpoint.hostname', 'description': 'message'},
        {'actor.process.name': 'DhcpServer'},
        None,
        None,
    ),
    (
        'WIN-EVTLOG-001',
        'Windows Event Log (generic)',
        'Windows',
        'System Activity',
        1001,
        0.9,
        ['Log Name:', 'Source:', 'Event ID:', 'Level:', 'Computer:'],
        'Log Name:\\s*[^\\n]+[\\s\\S]*?Event ID:\\s*\\d+',
        [],
        'Log Name:\\s*(?P<log_name>[^\\r\\n]+)[\\s\\S]*?Source:\\s*(?P<source>[^\\r\\n]+)[\\s\\S]*?Event ID:\\s*(?P<event_id>\\d+)[\\s\\S]*?Level:\\s*(?P<level>[^\\r\\n]+)[\\s\\S]*?(?:User:\\s*(?P<user>[^\\r\\n]+)[\\s\\S]*?)?Computer:\\s*(?P<computer>[^\\r\\n]+)',
        {'log_name': 'metadata.log_name', 'source': 'metadata.log_provider', 'event_id': 'metadata.event_code', 'user': 'actor.user.name', 'computer': 'device.hostname'},
        {},
        None,
        None,
    ),
    (
        'WIN-FIREWALL-001',
        'Windows Defender Firewall',
        'Windows',
        'Network Activity',
        4001,
        0.5,
        [],
        '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} (?:ALLOW|DROP|DENY|BLOCK) (?:TCP|UDP|ICMP)\\b',
        [],
        '^(?P<date>\\d{4}-\\d{2}-\\d{2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<action>ALLOW|DROP|DENY|BLOCK)\\s+(?P<protocol>TCP|UDP|ICMP|\\S+)\\s+(?P<src_ip>\\S+)\\s+(?P<dst_ip>\\S+)\\s+(?P<src_port>\\S+)\\s+(?P<dst_port>\\S+)\\s+(?P<size>\\S+)\\s+(?P<tcpflags>\\S+)(?:\\s+(?P<tcpsyn>\\S+)\\s+(?P<tcpack>\\S+)\\s+(?P<tcpwin>\\S+)\\s+(?P<icmptype>\\S+)\\s+(?P<icmpcode>\\S+)\\s+(?P<info>\\S+)\\s+(?P<direction>\\S+))?$',
        {'src_ip': 'src_endpoint.ip', 'dst_ip': 'dst_endpoint.ip', 'src_port': 'src_endpoint.port', 'dst_port': 'dst_endpoint.port', 'action': 'status'},
        {},
        None,
        None,
    ),
    (
        'WIN-IIS-W3C',
        'IIS W3C Access Log',
        'Windows',
        'HTTP Activity',
        4002,
        0.5,
        [],
        '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} \\d{1,3}(?:\\.\\d{1,3}){3} (?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ',
        [],
        '^(?P<date>\\d{4}-\\d{2}-\\d{2})\\s+(?P<time>\\d{2}:\\d{2}:\\d{2})\\s+(?P<s_ip>\\d{1,3}(?:\\.\\d{1,3}){3})\\s+(?P<method>GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\\s+(?P<uri_stem>\\S+)\\s+(?P<uri_query>\\S+)\\s+(?P<s_port>\\d+)\\s+(?P<username>\\S+)\\s+(?P<c_ip>\\d{1,3}(?:\\.\\d{1,3}){3})\\s+(?P<user_agent>\\S+)\\s+(?P<http_status>\\d{3})\\s+(?P<substatus>\\d+)\\s+(?P<win32_status>\\d+)\\s+(?P<time_taken>\\d+)$',
        {'c_ip': 'src_endpoint.ip', 's_ip': 'dst_endpoint.ip', 's_port': 'dst_endpoint.port'},
        {},
        0,
        'Unknown',
    ),
    (
        'WIN-PWSH-4104',
        'Microsoft-Windows-PowerShell',
        'Windows',
        'Process Activity',
        1007,
        1.0,
        ['PowerShell', 'Event ID:', '4104'],
        'Source:\\s*Microsoft-Windows-PowerShell[\\s\\S]*?Event ID:\\s*4104\\b',
        ['Microsoft-Windows-PowerShell', 'PowerShell'],
        'Source:\\s*Microsoft-Windows-PowerShell[\\s\\S]*?Event ID:\\s*(?P<event_id>4104)\\b[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?ScriptBlockText:\\s*(?P<script_block>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'script_block': 'actor.process.cmd_line'},
        {'actor.process.name': 'powershell.exe'},
        1,
        'Launch',
    ),
    (
        'WIN-SEC-4624',
        'Windows Security Auditing',
        'Windows',
        'Authentication',
        3002,
        1.0,
        ['Event ID:', '4624', 'Logon Type:'],
        'Event ID:\\s*4624\\b',
        ['Microsoft-Windows-Security-Auditing'],
        'Event ID:\\s*(?P<event_id>4624)[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?Account Name:\\s*(?P<account_name>[^\\r\\n]+)[\\s\\S]*?Account Domain:\\s*(?P<account_domain>[^\\r\\n]+)[\\s\\S]*?Logon Type:\\s*(?P<logon_type>\\d+)[\\s\\S]*?Source Network Address:\\s*(?P<src_ip>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'account_name': 'actor.user.name', 'account_domain': 'actor.user.domain', 'src_ip': 'src_endpoint.ip'},
        {'status': 'Success', 'status_id': 1},
        1,
        'Logon',
    ),
    (
        'WIN-SEC-4625',
        'Windows Security Auditing',
        'Windows',
        'Authentication',
        3002,
        1.0,
        ['Event ID:', '4625', 'Logon Type:'],
        'Event ID:\\s*4625\\b',
        ['Microsoft-Windows-Security-Auditing'],
        'Event ID:\\s*(?P<event_id>4625)[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?Account Name:\\s*(?P<account_name>[^\\r\\n]+)[\\s\\S]*?Account Domain:\\s*(?P<account_domain>[^\\r\\n]+)[\\s\\S]*?Logon Type:\\s*(?P<logon_type>\\d+)[\\s\\S]*?(?:Failure Reason:\\s*(?P<failure_reason>[^\\r\\n]+)[\\s\\S]*?)?Source Network Address:\\s*(?P<src_ip>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'account_name': 'actor.user.name', 'account_domain': 'actor.user.domain', 'src_ip': 'src_endpoint.ip'},
        {'status': 'Failure', 'status_id': 2, 'severity_id': 3, 'severity': 'Medium'},
        1,
        'Logon',
    ),
    (
        'WIN-SEC-4688',
        'Windows Security Auditing',
        'Windows',
        'Process Activity',
        1007,
        1.0,
        ['Event ID:', '4688', 'New Process Name:'],
        'Event ID:\\s*4688\\b',
        ['Microsoft-Windows-Security-Auditing'],
        'Event ID:\\s*(?P<event_id>4688)[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?Account Name:\\s*(?P<account_name>[^\\r\\n]+)[\\s\\S]*?New Process ID:\\s*(?P<new_process_id>[^\\r\\n]+)[\\s\\S]*?New Process Name:\\s*(?P<new_process_name>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'account_name': 'actor.user.name', 'new_process_name': 'actor.process.name', 'new_process_id': 'actor.process.pid'},
        {},
        1,
        'Launch',
    ),
    (
        'WIN-SYS-SVC',
        'Service Control Manager',
        'Windows',
        'System Activity',
        1001,
        1.0,
        ['Service Control Manager', 'Event ID:'],
        'Source:\\s*Service Control Manager[\\s\\S]*?Event ID:\\s*(?:7036|7034|7035|7040|7045)\\b',
        ['Service Control Manager'],
        'Source:\\s*Service Control Manager[\\s\\S]*?Event ID:\\s*(?P<event_id>\\d+)\\b[\\s\\S]*?Level:\\s*(?P<level>[^\\r\\n]+)[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?(?:Description:\\s*)?(?P<service_message>The [^\\r\\n]+)',
        {'computer': 'device.hostname', 'service_message': 'message'},
        {'actor.process.name': 'services.exe'},
        None,
        None,
    ),
    (
        'WIN-SYSMON-001',
        'Microsoft-Windows-Sysmon',
        'Windows',
        'Process Activity',
        1007,
        1.0,
        ['Sysmon', 'Event ID:', '1', 'Image:'],
        'Source:\\s*Microsoft-Windows-Sysmon[\\s\\S]*?Event ID:\\s*1\\b',
        ['Microsoft-Windows-Sysmon', 'Sysmon'],
        'Source:\\s*Microsoft-Windows-Sysmon[\\s\\S]*?Event ID:\\s*(?P<event_id>1)\\b[\\s\\S]*?Computer:\\s*(?P<computer>[^\\r\\n]+)[\\s\\S]*?Image:\\s*(?P<image>[^\\r\\n]+)[\\s\\S]*?CommandLine:\\s*(?P<command_line>[^\\r\\n]+)[\\s\\S]*?User:\\s*(?P<user>[^\\r\\n]+)',
        {'computer': 'device.hostname', 'image': 'actor.process.name', 'command_line': 'actor.process.cmd_line', 'user': 'actor.user.name'},
        {},
        1,
        'Launch',
    ),
]

SPECS = [dict(zip(FIELDS, row, strict=True)) for row in ROWS]
