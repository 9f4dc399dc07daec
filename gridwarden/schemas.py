"""Explicit schemas: stored tables, raw logs and requests. Nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType,
    StructField, StructType,
)

TEXT, DOUBLE, FLOAT, LONG = StringType(), DoubleType(), FloatType(), LongType()
INT, BOOL, VECTOR = IntegerType(), BooleanType(), ArrayType(FloatType())


def _struct(names, default=TEXT, **types):
    """Fields in the order of ``names``; those not in ``types`` have the default type."""
    return StructType([StructField(n, types.get(n, default)) for n in names.split()])


ALERTS = _struct("id ts note_type message src_h dst_h severity zone source", ts=DOUBLE)
SOFTWARE = _struct("id ts host software_type name unparsed_version", ts=DOUBLE)
CONNECTION_STATS = _struct("zone service count", count=LONG)
CVE_DESCRIPTIONS = _struct(
    "cve_id description embedding keyword cvss_score", embedding=VECTOR, cvss_score=FLOAT)
MITRE_ATTACK = _struct("technique_id description embedding name tactic", embedding=VECTOR)
CVE_MATCHES = _struct(
    "id source_key host software cve_id cvss_score description match_type ts", cvss_score=FLOAT)
MITRE_MATCHES = _struct(
    "id source_key alert_note_type alert_message alert_severity technique_id technique_name "
    "tactic similarity ts", similarity=FLOAT)
ALERT_ACTIONS = _struct(
    "id alert_id action actor notes enforcement_status enforcement_detail ts", ts=DOUBLE)
ASSET_OBSERVATIONS = _struct(
    "ip zone first_seen last_seen", first_seen=DOUBLE, last_seen=DOUBLE)
ASSET_ADMIN = _struct("ip owner criticality tags notes actor ts", ts=DOUBLE)
IP_POLICIES = _struct(
    "id ip policy actor notes enforcement_status enforcement_detail ts", ts=DOUBLE)
AGENTS = _struct("agent_id hostname ip os agent_group version last_checkin", last_checkin=DOUBLE)
AGENT_CONNECTION_STATS = _struct("agent_id zone service count ts", count=LONG, ts=DOUBLE)

# One JSON object per line. `ts` and the port are read as text, so that a number
# written as text is still a number and anything else can be told apart from absent.
CONN_LOG = _struct("ts id.orig_h id.resp_h id.resp_p proto service conn_state")
NOTICE_LOG = _struct("ts note msg service src dst id.orig_h id.resp_h id.resp_p")
SOFTWARE_LOG = _struct("ts host software_type name unparsed_version")
MODBUS_LOG = _struct(
    "ts orig_h resp_h func is_request address", ts=DOUBLE, is_request=BOOL, address=LONG)
PAYLOADS = _struct("ts src_h dst_h proto dst_port payload http_request", ts=DOUBLE, dst_port=INT)
SIGNATURE_RULES = _struct("rule proto dst_port field pattern event", dst_port=INT)

AGENT_CHECKIN = _struct("agent_id hostname ip os agent_group version ts", ts=DOUBLE)
AGENT_BATCH = _struct(
    "agent_id alerts conn_counts ts", ts=DOUBLE, conn_counts=MapType(TEXT, LONG),
    alerts=ArrayType(_struct("ts note_type message src_h dst_h severity zone", ts=DOUBLE)))
ALERT_ACTION_REQUEST = _struct("alert_id src_h dst_h action actor notes ts", ts=DOUBLE)
ASSET_REQUEST = _struct("ip zone owner criticality tags notes actor ts", ts=DOUBLE)
POLICY_REQUEST = _struct(
    "ip policy actor notes confirm_critical ts", confirm_critical=BOOL, ts=DOUBLE)

_CVSS = ArrayType(_struct("cvssData", _struct("baseScore", DOUBLE)))
_CVE = _struct(
    "id descriptions metrics", descriptions=ArrayType(_struct("lang value")),
    metrics=_struct("cvssMetricV31 cvssMetricV30 cvssMetricV2", _CVSS))
NVD_PAGE = _struct("vulnerabilities", ArrayType(_struct("cve", _CVE)))
STIX_BUNDLE = _struct("objects", ArrayType(_struct(
    "type revoked x_mitre_deprecated external_references kill_chain_phases name description",
    revoked=BOOL, x_mitre_deprecated=BOOL,
    external_references=ArrayType(_struct("source_name external_id")),
    kill_chain_phases=ArrayType(_struct("phase_name")))))
CVE_CACHE = _struct("cve_id keyword description cvss_score", cvss_score=DOUBLE)
TECHNIQUE_CACHE = _struct("technique_id name tactic description")
CVE_LIST = _struct("pos cve_id keyword description cvss_score", pos=LONG, cvss_score=DOUBLE)

LOGS = {
    "conn": CONN_LOG, "notice": NOTICE_LOG, "software": SOFTWARE_LOG, "modbus": MODBUS_LOG,
    "payloads": PAYLOADS, "checkins": AGENT_CHECKIN, "agent_batches": AGENT_BATCH,
    "alert_actions": ALERT_ACTION_REQUEST, "assets": ASSET_REQUEST, "policies": POLICY_REQUEST,
}

TABLES = {
    "alerts": ALERTS, "software": SOFTWARE, "connection_stats": CONNECTION_STATS,
    "cve_list": CVE_LIST, "cve_descriptions": CVE_DESCRIPTIONS, "mitre_attack": MITRE_ATTACK,
    "cve_matches": CVE_MATCHES, "mitre_matches": MITRE_MATCHES,
    "alert_actions": ALERT_ACTIONS, "asset_observations": ASSET_OBSERVATIONS,
    "asset_admin": ASSET_ADMIN, "ip_policies": IP_POLICIES, "agents": AGENTS,
    "agent_connection_stats": AGENT_CONNECTION_STATS,
}
TABLES |= {f"latest_{log}": TABLES[log] for log in ("alert_actions", "asset_admin", "ip_policies")}

#: Tables that grow by what sensors and agents report from day to day. They are stored by UTC day
#: of the column given here (epoch seconds), the others are not.
DATED = {"alerts": "ts", "asset_observations": "last_seen", "agents": "last_checkin",
         "agent_connection_stats": "ts"}
