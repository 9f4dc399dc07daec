"""SQL counterparts of the adapters, as common table expressions for DuckDB."""

import re

from gridwarden.functions import constants as K


def words(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def numbers(values):
    return ", ".join(str(v) for v in values)


def host(u):
    return f"('10.' || ({u} % 4) || '.' || ({u} // 250) || '.' || ({u} % 250))"


def seconds(ts):
    return f"(epoch_us({ts}) / CAST(1000000 AS DOUBLE))"


def micros(ts):
    return f"CAST(round({ts} * 1000000) AS BIGINT)"


def digest(*parts):
    """24 hex digits over the parts, NULL as ''."""
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"substr(sha256({joined}), 1, 24)"


def zone(service, port):
    return f"""CASE WHEN len(list_filter(
        string_split(lower(coalesce({service}, '')), ','),
        lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
                  IN ({words(K.OT_SERVICES)}))) > 0
        OR coalesce({port}, 0) IN ({numbers(K.OT_PORTS)}) THEN 'OT' ELSE 'IT' END"""


def agent_zone(service, port):
    return (f"CASE WHEN coalesce({service}, '') IN ({words(K.AGENT_OT_SERVICES)}) "
            f"OR coalesce({port}, 0) IN ({numbers(K.OT_PORTS)}) THEN 'OT' ELSE 'IT' END")


def guess(port):
    cases = " ".join(f"WHEN {p} THEN '{s}'" for p, s in K.PORT_SERVICES.items())
    return f"CASE {port} {cases} ELSE 'unclassified' END"


def normal_service(service):
    trimmed = f"lower(trim(coalesce({service}, '')))"
    return f"CASE WHEN {trimmed} = '' THEN 'unclassified' ELSE {trimmed} END"


def protocol(text):
    low = f"lower({text})"
    cases = [f"WHEN contains({low}, '{w.lower()}') THEN '{w}'" for w in K.PROTOCOL_KEYWORDS]
    cases += [f"WHEN contains({low}, '{w}') THEN 'Port Scan'" for w in K.PORT_SCAN_WORDS]
    return f"CASE {' '.join(cases)} ELSE 'Other' END"


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def ip_number(ip):
    octets = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"((({octets[0]} * 256 + {octets[1]}) * 256 + {octets[2]}) * 256 + {octets[3]})"


def _range(first, bits):
    a, b, c, d = (int(x) for x in first.split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return f"BETWEEN {low} AND {low + 2 ** (32 - bits) - 1}"


_PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4),
)


def asset_ip(ip):
    """Range tests on the address as a number."""
    n = ip_number(ip)
    inside = " OR ".join(f"{n} {_range(*r)}" for r in _PRIVATE)
    return (f"(CASE WHEN regexp_full_match({ip}, '{IPV4}') THEN ({inside}) AND {ip} NOT IN "
            "('0.0.0.0', '255.255.255.255', '192.0.0.9', '192.0.0.10') ELSE false END)")


def cte(*names):
    """``WITH`` over the named adapters and whatever they build on."""
    done = []

    def add(name):
        if name not in done:
            for other in re.findall(r"\b(\w+)\b", VIEWS[name]):
                if other in VIEWS and other != name:
                    add(other)
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in done) + "\n"


_SERVICE = """CASE event_id % 6 WHEN 0 THEN 'ssl,modbus' WHEN 1 THEN 'SSL' WHEN 2 THEN ''
              WHEN 3 THEN 'ssh' WHEN 4 THEN 'http' END"""
_PORT = """CAST(CASE event_id % 6 WHEN 0 THEN 502 WHEN 1 THEN 443 WHEN 2 THEN 2404
           WHEN 3 THEN 22 WHEN 4 THEN 80 ELSE 53 END AS INTEGER)"""
_RESPONDER = """CASE WHEN event_id % 7 = 0 THEN '8.8.8.8'
                ELSE '192.168.1.' || (event_id % 250) END"""
_CLASS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical'
            WHEN '2-HIGH' THEN 'high' ELSE 'low' END"""

VIEWS = {
    "conn": f"""SELECT {seconds('ts')} AS ts, {host('user_id')} AS orig_h,
        {_RESPONDER} AS resp_h, {_PORT} AS resp_p,
        CASE WHEN event_id % 6 = 5 THEN 'udp' ELSE 'tcp' END AS proto, {_SERVICE} AS service,
        CASE WHEN event_id % 5 = 0 THEN 'S0' ELSE 'SF' END AS conn_state FROM events""",
    "agent_conn": f"""SELECT 'agent-' || (user_id % 20) AS agent_id, {seconds('ts')} AS ts,
        {_PORT} AS resp_p FROM events""",
    "alerts": f"""SELECT CAST(event_id AS VARCHAR) AS id, {seconds('ts')} AS ts,
        CASE event_type WHEN 'error' THEN 'OTPolicy::Unauthorized_Modbus_Write'
            WHEN 'view' THEN 'Signatures::Sensitive_Signature'
            WHEN 'click' THEN 'ScanDetect::Possible_Port_Scan'
            ELSE 'Note::' || event_type END AS note_type,
        'event ' || event_type || ' ' || props AS message,
        {host('user_id')} AS src_h, {_RESPONDER} AS dst_h,
        CASE WHEN event_type IN ('error', 'view') THEN 'high' ELSE 'medium' END AS severity,
        CASE WHEN event_id % 6 IN (0, 2) THEN 'OT' ELSE 'IT' END AS zone,
        'zeek' AS source FROM events""",
    "alert_actions": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id,
        CAST((o_orderkey % 5000) * 2 AS VARCHAR) AS alert_id,
        CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'O' THEN 'allow'
            ELSE 'investigate' END AS action,
        'analyst' || (o_custkey % 5) AS actor, o_orderpriority AS notes,
        CASE o_orderstatus WHEN 'F' THEN 'stubbed' ELSE 'not_applicable' END
            AS enforcement_status, {seconds('o_orderdate')} AS ts FROM orders""",
    "agents": f"""SELECT CAST(user_id AS VARCHAR) AS agent_id, 'h' || user_id AS hostname,
        {host('user_id')} AS ip, event_type AS os,
        CASE WHEN user_id % 3 = 0 THEN '' ELSE 'g' || (user_id % 7) END AS agent_group,
        '1.' || (event_id % 4) AS version, {seconds('ts')} AS last_checkin FROM events""",
    "asset_admin": f"""SELECT {host('o_custkey')} AS ip, 'team' || (o_orderkey % 9) AS owner,
        {_CLASS} AS criticality, o_orderstatus AS tags, o_orderpriority AS notes,
        'admin' AS actor, {seconds('o_orderdate')} AS ts FROM orders""",
    "ip_policies": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {host('o_custkey')} AS ip,
        CASE o_orderstatus WHEN 'F' THEN 'blacklist' WHEN 'O' THEN 'whitelist'
            ELSE 'quarantine' END AS policy, 'admin' AS actor, o_orderpriority AS notes,
        CASE o_orderstatus WHEN 'O' THEN 'not_applicable' ELSE 'stubbed' END
            AS enforcement_status, {seconds('o_orderdate')} AS ts FROM orders""",
    "policy_requests": f"""SELECT {host('o_custkey')} AS ip,
        CASE o_orderkey % 5 WHEN 0 THEN 'blacklist' WHEN 1 THEN 'whitelist'
            WHEN 2 THEN 'quarantine' WHEN 3 THEN 'none' ELSE 'drop' END AS policy,
        'analyst' || o_orderkey AS actor, o_orderpriority AS notes,
        o_orderkey % 3 = 0 AS confirm_critical,
        {seconds('o_orderdate')} + 172800 AS ts FROM orders""",
    "action_requests": f"""SELECT CAST(o_orderkey AS VARCHAR) AS alert_id,
        {host('o_custkey')} AS src_h, '192.168.1.' || (o_custkey % 250) AS dst_h,
        CASE o_orderkey % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block'
            WHEN 2 THEN 'investigate' ELSE 'close' END AS action,
        'analyst' || (o_custkey % 5) AS actor, o_orderpriority AS notes,
        {seconds('o_orderdate')} AS ts FROM orders""",
    "asset_requests": """SELECT CASE WHEN c_custkey % 11 = 0
            THEN '10.0.0.' || (c_custkey + 250)
            ELSE ' 10.' || (c_custkey % 256) || '.' || c_nationkey || '.7 ' END AS ip,
        CASE c_custkey % 7 WHEN 0 THEN 'OT' WHEN 1 THEN 'DMZ' ELSE 'IT' END AS zone,
        c_name AS owner, CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY'
            THEN 'high' WHEN 'FURNITURE' THEN 'urgent' ELSE '' END AS criticality,
        c_mktsegment AS tags, '' AS notes, 'admin' AS actor,
        CAST(c_custkey AS DOUBLE) AS ts FROM customer""",
    "checkins": f"""SELECT CAST(user_id AS VARCHAR) AS agent_id, 'h' || user_id AS hostname,
        CASE event_id % 9 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '224.0.0.5'
            WHEN 2 THEN '::1' WHEN 3 THEN 'fe80::' || hex(user_id) WHEN 4 THEN 'n/a'
            WHEN 5 THEN '8.8.4.' || (user_id % 256)
            ELSE '10.9.' || (user_id // 250) || '.' || (user_id % 250) END AS ip,
        event_type AS os, CASE WHEN event_id % 2 = 0 THEN 'plant' ELSE 'default' END
            AS agent_group, '1.0.0' AS version, {seconds('ts')} AS ts FROM events""",
    "software": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-'
            || l_suppkey AS id, {seconds('l_shipdate')} AS ts, {host('l_suppkey')} AS host,
        'APP' AS software_type, p_name AS name, p_brand AS unparsed_version
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cve_items": """SELECT pos, 'CVE-' || pos AS cve_id, p_name AS keyword,
        'Overflow in ' || p_name || ' as used by ' || p_type AS description,
        round((price - 900) / 10, 1) AS cvss_score
        FROM (SELECT p_name, p_type, min(p_partkey) AS pos, max(p_retailprice) AS price
              FROM part GROUP BY ALL)""",
    "technique_items": """SELECT item_id AS pos, 'T' || (item_id + 1000) AS technique_id,
        'Technique ' || item_id AS name, 'tactic-' || (item_id % 12) AS tactic,
        text || ' event ' || list_extract(['error', 'view', 'unauthorized modbus write',
            'signature'], CAST(item_id % 4 + 1 AS INTEGER)) AS description FROM benchmark""",
    "scored_matches": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-'
            || l_suppkey AS source_key, 'product ' || (l_partkey % 40) AS software,
        'Technique ' || (l_suppkey % 30) AS technique_name,
        'tactic-' || (l_linenumber % 5) AS tactic,
        CASE WHEN l_tax > 0 THEN l_discount * 100 END AS cvss_score FROM lineitem""",
    "scan_events": f"""SELECT CAST(1700000000 + event_id AS DOUBLE) AS ts,
        '10.0.0.' || (user_id % 3) AS orig_h, {_RESPONDER} AS resp_h,
        CAST((event_id * 7) % 1000 AS INTEGER) AS resp_p,
        CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto FROM events""",
    "modbus": f"""SELECT {seconds('ts')} AS ts, {host('user_id')} AS orig_h,
        {_RESPONDER} AS resp_h,
        CASE event_type WHEN 'error' THEN 'WRITE_SINGLE_COIL'
            WHEN 'click' THEN 'WRITE_SINGLE_COIL' ELSE 'READ_COILS' END AS func,
        event_type <> 'click' OR event_id % 2 = 0 AS is_request,
        event_id % 100 AS address FROM events""",
    "payloads": """SELECT CAST(page_id AS DOUBLE) AS ts, '10.1.0.' || (page_id % 250) AS src_h,
        '192.168.1.10' AS dst_h, 'tcp' AS proto, 80 AS dst_port, html AS payload,
        url AS http_request FROM pages
        UNION ALL SELECT CAST(doc_id AS DOUBLE), '10.1.0.' || (doc_id % 250), '192.168.1.10',
        'tcp', 80, NULL, text FROM documents
        UNION ALL SELECT CAST(conv_id AS DOUBLE), '10.1.0.' || (conv_id % 250),
        '192.168.1.10', 'tcp', CASE WHEN role = 'user' THEN 21 ELSE 502 END,
        CASE WHEN role = 'user' THEN upper(role) || ' ' || text
             ELSE chr(0) || text || chr(8) || chr(0) END, NULL FROM conversations""",
    "observations": f"""SELECT ip, CASE WHEN count(*) FILTER (zone = 'OT') > 0 THEN 'OT'
            ELSE 'IT' END AS zone, min(ts) AS first_seen, max(ts) AS last_seen FROM (
            SELECT ts, {zone('service', 'resp_p')} AS zone, orig_h AS ip FROM conn
            UNION ALL SELECT ts, {zone('service', 'resp_p')}, resp_h FROM conn
            WHERE conn_state <> 'S0') WHERE {asset_ip('ip')} GROUP BY ip""",
    "conn_stats": f"""SELECT {zone('service', 'resp_p')} AS zone,
        {normal_service('service')} AS service, count(*) AS count FROM conn GROUP BY ALL""",
    "latest_action": """SELECT alert_id, r.action AS action, r.actor AS actor,
        r.notes AS notes, r.enforcement_status AS enforcement_status FROM (
            SELECT alert_id, arg_max(struct_pack(action := action, actor := actor,
                notes := notes, enforcement_status := enforcement_status),
                struct_pack(ts := ts, id := id)) AS r FROM alert_actions GROUP BY alert_id)""",
    "latest_admin": """SELECT ip, r.owner AS owner, r.criticality AS criticality,
        r.tags AS tags, r.notes AS notes FROM (
            SELECT ip, max(struct_pack(ts := ts, owner := owner, criticality := criticality,
                tags := tags, notes := notes)) AS r FROM asset_admin GROUP BY ip)""",
    "latest_policy": """SELECT ip, r.policy AS policy,
        r.enforcement_status AS enforcement_status FROM (
            SELECT ip, max(struct_pack(ts := ts, id := id, policy := policy,
                enforcement_status := enforcement_status)) AS r FROM ip_policies GROUP BY ip)""",
    "roster": """SELECT agent_id, r.hostname AS hostname, r.ip AS ip, r.os AS os,
        r.agent_group AS agent_group, r.version AS version, last_checkin, first_checkin FROM (
            SELECT agent_id, max(struct_pack(last_checkin := last_checkin,
                hostname := hostname, ip := ip, os := os, agent_group := agent_group,
                version := version)) AS r, max(last_checkin) AS last_checkin,
                min(last_checkin) AS first_checkin FROM agents GROUP BY agent_id)""",
    "status_alerts": """SELECT al.*, coalesce(a.action, '') AS action,
        coalesce(a.actor, '') AS actor, coalesce(a.notes, '') AS notes,
        coalesce(a.enforcement_status, '') AS enforcement_status,
        CASE a.action WHEN 'allow' THEN 'Allowed' WHEN 'block' THEN 'Blocked'
            WHEN 'investigate' THEN 'Investigating' ELSE 'Open' END AS status
        FROM alerts al LEFT JOIN latest_action a ON a.alert_id = al.id""",
}


def vector(text, dim):
    """Feature hashing of a text, as in ``hashing_encoder``."""
    slots = (f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
             f"lambda w: w <> ''), lambda w: CAST(('0x' || substr(md5(w), 1, 6)) AS INTEGER) "
             f"% {dim})")
    return (f"list_transform(range(0, {dim}), lambda i: CAST(len(list_filter({slots}, "
            "lambda s: s = i)) AS DOUBLE))")


def scans(per_protocol, threshold=15, width=60_000_000):
    """Window starts by recursion, then the event that brings the last port."""
    key = "port, proto" if per_protocol else "port"
    return f"""WITH RECURSIVE ev AS (
        SELECT orig_h AS src, resp_h AS dst, resp_p AS port, proto,
               CAST(round(ts * 1000000) AS BIGINT) AS us FROM scan_events),
    starts AS (
        SELECT src, min(us) AS start FROM ev GROUP BY src
        UNION ALL
        SELECT s.src, (SELECT min(e.us) FROM ev e
                       WHERE e.src = s.src AND e.us > s.start + {width}) AS nxt
        FROM starts s WHERE nxt IS NOT NULL),
    win AS (
        SELECT e.*, s.start FROM ev e ASOF JOIN
            (SELECT * FROM starts WHERE start IS NOT NULL) s
            ON e.src = s.src AND e.us >= s.start),
    firsts AS (
        SELECT src, start, {key}, min(struct_pack(us := us, dst := dst)) AS f
        FROM win GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY src, start ORDER BY f.us, {key}) AS rank
        FROM firsts)"""


def with_views(recursive_sql, *names):
    """Put adapter views in front of the CTEs of ``recursive_sql``."""
    return cte(*names).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + (
        recursive_sql.replace("WITH RECURSIVE ", "", 1))
