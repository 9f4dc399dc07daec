"""Queries over detections."""

from gridwarden.functions import constants as K
from gridwarden.operators import detect, ingest
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.expressions import NOTICE_ALERTS_SQL, write_notices
from gridwarden.plans.registry import query
from gridwarden.session import fresh_path
from gridwarden.sources import read_logs, split_rejects

_AGENT_MESSAGE = "src || '" + K.SCAN_MESSAGE_AGENT.replace("%s", "").replace("%d", "15") + "'"
_SENSOR_MESSAGE = "src || '" + K.SCAN_MESSAGE_SENSOR.replace("%s", "").replace("%d", "15") + "'"

AGENT_SCANS_SQL = S.with_views(S.scans(per_protocol=False), "scan_events") + f"""
    SELECT f.us / 1000000 AS ts, '{K.SCAN_NOTE}' AS note_type, {_AGENT_MESSAGE} AS message,
        src AS src_h, f.dst AS dst_h, 'medium' AS severity,
        {S.agent_zone(S.guess('port'), 'port')} AS zone, start / 1000000 AS window_start
    FROM ranked WHERE rank = 15"""
SENSOR_SCANS_SQL = S.with_views(S.scans(per_protocol=True), "scan_events") + f""",
    edges AS (SELECT src, start,
        max(struct_pack(us := f.us, port := port, proto := proto)) FILTER (rank = 15) AS since,
        max(struct_pack(us := f.us, port := port, proto := proto)) FILTER (rank = 16) AS until
        FROM ranked GROUP BY ALL)
    SELECT w.us / 1000000 AS ts, '{K.SCAN_NOTE}' AS note_type, {_SENSOR_MESSAGE} AS message,
        src AS src_h, '' AS dst_h, 'medium' AS severity, 'IT' AS zone,
        start / 1000000 AS window_start
    FROM win w JOIN edges USING (src, start)
    WHERE struct_pack(us := w.us, port := w.port, proto := w.proto) >= since
      AND (until IS NULL OR struct_pack(us := w.us, port := w.port, proto := w.proto) < until)"""


@query(AGENT_SCANS_SQL)
def agent_scans(spark, sf):
    return detect.detect_scans(A.scan_events(spark, sf))


@query(SENSOR_SCANS_SQL)
def sensor_scans(spark, sf):
    return detect.detect_scans(A.scan_events(spark, sf), refire=True)


_WRITES = f"""SELECT ts, '{K.MODBUS_NOTE}' AS note_type,
    'Modbus coil write from ' || orig_h || ' to ' || resp_h || ' (addr=' || address || ')'
    AS message, orig_h AS src_h, resp_h AS dst_h, '' AS service, 502 AS port
    FROM modbus WHERE func = 'WRITE_SINGLE_COIL' AND is_request"""


@query(S.cte("modbus") + _WRITES)
def modbus_writes(spark, sf):
    return detect.detect_modbus_writes(A.modbus(spark, sf))


@query(S.cte("modbus") + _WRITES + f""" AND orig_h NOT IN
    (SELECT {S.host('c_custkey')} FROM customer WHERE c_mktsegment = 'BUILDING')""")
def unlisted_modbus_writes(spark, sf):
    """With an allow-list: the hosts of one customer segment may write."""
    allowed = A.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        A.host("c_custkey").alias("orig_h"))
    return detect.detect_modbus_writes(A.modbus(spark, sf), allowed)


_HITS = " UNION ALL ".join(
    f"""SELECT ts, '{rule}' AS rule, '{K.SIGNATURE_NOTE}' AS note_type,
    src_h || ': {event}' AS message, src_h, dst_h, '' AS service, dst_port AS port
    FROM payloads WHERE proto = '{proto}' AND dst_port = {port}
    AND regexp_matches({field}, '{pattern.replace("'", "''")}')"""
    for rule, proto, port, field, pattern, event in K.SIGNATURE_RULES)


@query(S.cte("payloads") + _HITS)
def signature_hits(spark, sf):
    return detect.match_signatures(A.payloads(spark, sf))


@query(S.cte("payloads") + _HITS)
def signature_hits_joined(spark, sf):
    """The same rules given as a table."""
    return detect.match_signatures(A.payloads(spark, sf), detect.signature_rules(spark))


_DETECTED = f"""SELECT ts, note_type, message, src_h, dst_h,
    'high' AS severity, 'OT' AS zone, 'zeek' AS source FROM ({_WRITES})
    UNION ALL SELECT ts, note_type, message, src_h, dst_h, 'high',
    {S.zone('service', 'port')}, 'zeek' FROM ({_HITS})"""


@query(S.cte("modbus", "payloads") + f"""SELECT {S.digest(S.micros('ts'), 'note_type',
    'message', 'src_h', 'dst_h', 'severity', 'zone', 'source')} AS id, * FROM ({_DETECTED})
    UNION ALL ({NOTICE_ALERTS_SQL})""")
def alerts_of_all_producers(spark, sf):
    """Detections and notice logs in one alerts table."""
    path = fresh_path(spark, "notice-log")
    write_notices(spark, sf, path)
    good, _ = split_rejects(read_logs(spark, path, "notice"), ingest.valid_notice())
    found = detect.detect_modbus_writes(A.modbus(spark, sf)).unionByName(
        detect.match_signatures(A.payloads(spark, sf)).drop("rule"))
    return detect.to_alerts(found, "zeek").unionByName(ingest.normalize_notice(good))
