"""Word lists, ports, messages and limits that results depend on."""

# Service names that mark a connection as OT.
OT_SERVICES = (
    "modbus",
    "dnp3", "dnp3_tcp",
    "s7comm", "s7comm-plus", "s7comm_plus", "cotp",
    "enip", "ethernet-ip", "ethernet_ip", "cip", "cip_io", "cip_identity",
    "bacnet",
    "bsap", "bsap_ip", "bsap_serial",
    "ethercat",
    "ge-srtp", "ge_srtp",
    "genisys",
    "opcua-binary", "opcua_binary", "opc_ua_binary",
    "profinet", "profinet_io", "profinet_io_cm",
    "synchrophasor", "c37_118", "c37.118",
    "iec104", "iec-104", "iec_60870_5_104",
    "hart-ip", "hart_ip",
)

# Fixed value: the agents' own list has no "opc_ua_binary".
AGENT_OT_SERVICES = tuple(s for s in OT_SERVICES if s != "opc_ua_binary")

# Ports that mark a connection as OT.
OT_PORTS = (502, 20000, 102, 44818, 2222, 47808, 18245, 4840, 2404, 5094, 34962, 34963, 34964)

# Port -> service guess used by agents.
PORT_SERVICES = {
    80: "http", 443: "https", 53: "dns", 22: "ssh", 21: "ftp",
    23: "telnet", 25: "smtp", 445: "smb", 3389: "rdp",
    502: "modbus", 20000: "dnp3_tcp", 102: "s7comm",
    44818: "ethernet-ip", 2222: "ethernet-ip", 47808: "bacnet",
    18245: "ge-srtp", 4840: "opcua-binary", 2404: "iec104",
    5094: "hart-ip", 34962: "profinet", 34963: "profinet", 34964: "profinet",
}

# Protocol words looked for in alert text, first match wins.
PROTOCOL_KEYWORDS = (
    "Modbus", "FTP", "SSH", "SMB", "HTTP", "HTTPS", "DNS", "RDP", "Telnet", "TFTP", "SNMP",
    "DNP3", "S7comm", "BACnet", "EtherNet/IP", "CIP", "EtherCAT", "GE-SRTP",
    "Genisys", "OPC UA", "PROFINET", "Synchrophasor", "BSAP", "IEC104", "HART-IP",
)
PORT_SCAN_WORDS = ("port scan", "portscan", "scandetect")

# Notice names and message formats of the detections.
SCAN_NOTE = "ScanDetect::Possible_Port_Scan"
SCAN_MESSAGE_AGENT = (
    "%s touched %d distinct destination ports within ~60s - possible port scan (agent-detected)"
)
SCAN_MESSAGE_SENSOR = (
    "%s touched %d distinct destination ports within ~1 minute - possible port scan"
)
SCAN_PORTS = 15
SCAN_SECONDS = 60
MODBUS_NOTE = "OTPolicy::Unauthorized_Modbus_Write"
MODBUS_MESSAGE = "Modbus coil write from %s to %s (addr=%d)"
SIGNATURE_NOTE = "Signatures::Sensitive_Signature"

# Signature rules as (rule, proto, dst_port, field, pattern, event).
SIGNATURE_RULES = (
    ("sig-modbus-diagnostic-abuse", "tcp", 502, "payload", r"^\x00.*\x08\x00",
     "Suspicious Modbus diagnostic function code usage"),
    ("sig-sql-injection-attempt", "tcp", 80, "http_request", r".*(\%27)|(\')|(\-\-)|(\%23)|(#).*",
     "Possible SQL injection pattern in HTTP request"),
    ("sig-plaintext-ftp-creds", "tcp", 21, "payload", r"^USER .*",
     "Plaintext FTP credentials observed"),
)

# Accepted request values, status words and decision texts.
ALERT_ACTIONS = ("allow", "block", "investigate")
POLICIES = ("blacklist", "whitelist", "quarantine", "none")
GUARDED_POLICIES = ("blacklist", "quarantine")
ZONES = ("IT", "OT")
CRITICALITIES = ("", "low", "medium", "high", "critical")
STATUS_LABELS = {
    "open": "Open", "allow": "Allowed", "block": "Blocked", "investigate": "Investigating",
}
BLOCK_DETAIL = (
    "No live enforcement backend configured yet - would block traffic from %s to %s."
)
ALLOW_DETAIL = (
    "No enforcement backend configured for allow - recorded as decision only (%s -> %s)."
)
INVESTIGATE_DETAIL = "Marked for investigation."
BLACKLIST_DETAIL = (
    "No live enforcement backend configured yet - would block ALL traffic to/from %s."
)
QUARANTINE_DETAIL = (
    "No live enforcement backend configured yet - would isolate %s from the network entirely."
)
WHITELIST_DETAIL = (
    "%s recorded as explicitly whitelisted - no block to remove, decision only."
)
CLEARED_DETAIL = "Policy for %s cleared - recorded only."
INVALID_ACTION = "Invalid action"
INVALID_IP = "Invalid IP address"
INVALID_ZONE = "zone must be IT or OT"
INVALID_CRITICALITY = "Invalid criticality"
INVALID_POLICY = "Invalid policy"
CRITICAL_HOST = "%s is tagged CRITICAL. Resubmit with confirm_critical=true to proceed."
ALERT_NOT_FOUND = "(alert not found)"

# Matching limits.
FUZZY_THRESHOLD = 70
MAX_COSINE_DISTANCE = 1.1
NEIGHBOURS = 3
AGENT_TIMEOUT_SECONDS = 90
REPORT_SECONDS = 30
