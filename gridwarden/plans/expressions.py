"""Queries over single expressions, sources and row-level ingest."""

from pyspark.sql import functions as F

from gridwarden import functions as G, schemas
from gridwarden.functions import constants as K
from gridwarden.operators import analytics, commands, ingest, state
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.registry import query
from gridwarden.session import fresh_path
from gridwarden.sources import (
    flatten_nvd, flatten_stix, load_reference_lines, read_agent_batches, read_logs, split_rejects,
)

NOW = 1706745600.0  # the hour after the last event


# -- zones, services, addresses -------------------------------------------------------

@query(S.cte("conn") + f"""SELECT resp_p, service, {S.zone('service', 'resp_p')} AS zone,
    {S.normal_service('service')} AS normal, count(*) AS n FROM conn GROUP BY ALL""")
def connection_zones(spark, sf):
    conn = A.conn(spark, sf)
    return conn.groupBy(
        "resp_p", "service", G.zone(F.col("service"), F.col("resp_p")).alias("zone"),
        G.normal_service(F.col("service")).alias("normal")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, {S.zone("replace(text, ' ', ',')", 'CAST(n_chars AS INTEGER)')}
    AS zone FROM documents""")
def text_zones(spark, sf):
    """Every word of a document taken as a service name, its length as the port."""
    names = F.replace("text", F.lit(" "), F.lit(","))
    return A.table(spark, sf, "documents").select(
        "doc_id", G.zone(names, F.col("n_chars")).alias("zone"))


@query(S.cte("agent_conn") + f"""SELECT resp_p, {S.guess('resp_p')} AS service,
    {S.agent_zone(S.guess('resp_p'), 'resp_p')} AS zone, count(*) AS n
    FROM agent_conn GROUP BY ALL""")
def agent_zones(spark, sf):
    service = G.guess_service(F.col("resp_p"))
    return A.agent_conn(spark, sf).groupBy(
        "resp_p", service.alias("service"),
        G.agent_zone(service, F.col("resp_p")).alias("zone")).agg(F.count("*").alias("n"))


_IP = """CASE event_id % 13 WHEN 0 THEN '192.0.0.' || (event_id % 256)
    WHEN 1 THEN '172.' || (event_id % 256) || '.1.2' WHEN 2 THEN '10.0.0.0' || (event_id % 10)
    WHEN 3 THEN '198.' || (event_id % 256) || '.51.9' WHEN 4 THEN '0.0.0.' || (event_id % 3)
    WHEN 5 THEN '255.255.255.' || (event_id % 256 + event_id % 2 * 30)
    ELSE (event_id * 7919 % 256) || '.' || (user_id % 256) || '.' || (event_id % 256) || '.'
         || (event_id % 13) END"""


@query(f"SELECT event_id, ip, {S.asset_ip('ip')} AS is_asset "
       f"FROM (SELECT event_id, {_IP} AS ip FROM events)")
def asset_addresses(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.expr(_IP).alias("ip")).withColumn(
        "is_asset", G.is_asset_ip(F.col("ip")))


@query(S.cte("checkins") + f"""SELECT ip, count(*) AS n,
    CASE WHEN regexp_full_match(ip, '{S.IPV4}') THEN ip NOT LIKE '127.%' AND ip <> '0.0.0.0'
        AND CAST(split_part(ip, '.', 1) AS INTEGER) NOT BETWEEN 224 AND 239
    ELSE ip LIKE 'fe80::%' END AS is_agent FROM checkins GROUP BY ip""")
def agent_addresses(spark, sf):
    return A.checkins(spark, sf).groupBy("ip").agg(F.count("*").alias("n")).withColumn(
        "is_agent", G.is_agent_ip(F.col("ip")))


# -- text, scores, labels --------------------------------------------------------------

@query(f"""SELECT 'document' AS kind, doc_id AS id, {S.protocol("source || ' ' || text")}
    AS protocol FROM documents UNION ALL SELECT 'benchmark', item_id,
    {S.protocol("' ' || text")} FROM benchmark UNION ALL SELECT 'page', page_id,
    {S.protocol("url || ' ' || html")} FROM pages""")
def protocols_of_text(spark, sf):
    def rows(name, kind, key, first, second):
        return A.table(spark, sf, name).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"),
            G.extract_protocol(first, F.col(second)).alias("protocol"))
    return rows("documents", "document", "doc_id", F.col("source"), "text").unionByName(
        rows("benchmark", "benchmark", "item_id", F.lit(None).cast("string"), "text"),
    ).unionByName(rows("pages", "page", "page_id", F.col("url"), "html"))


@query("""SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount * 100 >= 9 THEN
    'critical' WHEN l_discount * 100 >= 7 THEN 'high' WHEN l_discount * 100 >= 4 THEN 'medium'
    ELSE 'info' END AS band FROM lineitem""")
def cvss_bands(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        G.cvss_band(F.col("l_discount") * 100).alias("band"))


@query(S.cte("agents") + f"""SELECT agent_id, last_checkin, CASE WHEN d < 60 THEN
    CAST(floor(d) AS BIGINT) || 's ago' WHEN d < 3600 THEN CAST(floor(d / 60) AS BIGINT) ||
    'm ago' WHEN d < 86400 THEN CAST(floor(d / 3600) AS BIGINT) || 'h ago' ELSE
    CAST(floor(d / 86400) AS BIGINT) || 'd ago' END AS age, CASE WHEN {NOW} - last_checkin < 90
    THEN 'active' ELSE 'disconnected' END AS status
    FROM (SELECT agent_id, last_checkin, greatest(0, {NOW} - last_checkin) AS d FROM agents)""")
def checkin_ages(spark, sf):
    """P14 and P16 on every check-in."""
    ts = F.col("last_checkin")
    return A.agents(spark, sf).select(
        "agent_id", "last_checkin", G.age_label(ts, NOW).alias("age"),
        G.agent_status(ts, NOW).alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id * 1000000 + 250000
    END AS us FROM events""")
def event_times(spark, sf):
    text = F.expr("CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE concat(event_id, '.25') END")
    return A.table(spark, sf, "events").select(
        "event_id", F.unix_micros(G.event_time(text)).alias("us"))


@query(S.cte("software") + """SELECT name, unparsed_version,
    trim(name || ' ' || unparsed_version) AS software, count(*) AS n
    FROM software GROUP BY ALL""")
def software_texts(spark, sf):
    return A.software(spark, sf).groupBy(
        "name", "unparsed_version",
        G.software_text(F.col("name"), F.col("unparsed_version")).alias("software"),
    ).agg(F.count("*").alias("n"))


_KEY = """CASE event_id % 5 WHEN 0 THEN 'OT|modbus' WHEN 1 THEN 'IT|' WHEN 2 THEN '|x' || user_id
    WHEN 3 THEN 'x|a|' || event_type ELSE 'bare' || user_id END"""


@query(f"""SELECT event_id, CASE WHEN z = '' THEN 'IT' ELSE z END AS zone,
    CASE WHEN s = '' THEN 'unclassified' ELSE s END AS service FROM (SELECT event_id,
    split_part(k, '|', 1) AS z, CASE WHEN contains(k, '|')
    THEN substr(k, instr(k, '|') + 1) ELSE '' END AS s
    FROM (SELECT event_id, {_KEY} AS k FROM events))""")
def zone_service_keys(spark, sf):
    zone, service = G.split_zone_service(F.col("k"))
    return A.table(spark, sf, "events").select("event_id", F.expr(_KEY).alias("k")).select(
        "event_id", zone.alias("zone"), service.alias("service"))


@query(f"""SELECT event_id, {S.digest('event_id', 'event_type', 'props',
    S.micros(S.seconds('ts')))} AS id FROM events""")
def content_ids(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", "event_type", "props", A.seconds("ts")).select(
        "event_id", G.content_id(
            F.col("event_id"), F.col("event_type"), F.col("props"),
            G.epoch_micros(F.col("ts"))).alias("id"))


@query("""SELECT a.vec_id, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distances(spark, sf):
    """Distance of each vector to the next one."""
    left = A.vectors(spark, sf)
    right = left.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    distance = F.round(G.cosine_distance(F.col("vec"), F.col("next")), 6) + F.lit(0.0)
    return left.join(right, "id").select(F.col("id").alias("vec_id"), distance.alias("distance"))


# -- filters ----------------------------------------------------------------------------

@query(S.cte("alerts") + """SELECT * FROM alerts WHERE lower(severity) IN ('high', 'critical')""")
def severe_alerts(spark, sf):
    return A.alerts(spark, sf).where(G.is_severe(F.col("severity")))


@query(S.cte("status_alerts") + """SELECT * FROM status_alerts
    WHERE severity IN ('high') AND status IN ('Open', 'Blocked')""")
def filtered_alerts(spark, sf):
    rows = state.dashboard_alerts(A.alerts(spark, sf), A.alert_actions(spark, sf))
    return analytics.filter_alerts(rows, ["high"], ["Open", "Blocked"])


@query(S.cte("alerts") + " SELECT * FROM alerts WHERE " + " OR ".join(
    f"regexp_matches(lower({c}), 'k.: [12]|scan|8\\.8')"
    for c in ("message", "note_type", "src_h", "dst_h")))
def searched_alerts(spark, sf):
    return analytics.search_alerts(A.alerts(spark, sf), r"K.: [12]|Scan|8\.8")


@query(S.cte("alerts") + " SELECT * FROM alerts WHERE " + " OR ".join(
    f"contains(lower({c}), '\"k\": 1')" for c in ("message", "note_type", "src_h", "dst_h")))
def searched_alerts_plain(spark, sf):
    return analytics.search_alerts(A.alerts(spark, sf), '"K": 1', regex=False)


# -- logs read back from JSON lines -----------------------------------------------------

_NOTICE = """SELECT {seconds} AS ts, CASE event_type WHEN 'error' THEN
    'OTPolicy::Unauthorized_Modbus_Write' WHEN 'view' THEN 'Signatures::Sensitive_Signature'
    ELSE 'Note::' || event_type END AS note, props AS msg,
    CASE event_id % 3 WHEN 0 THEN 'ssl, DNP3 ' WHEN 1 THEN 'http' END AS service,
    'src' || user_id AS src, 'dst' || user_id AS dst,
    CASE WHEN event_id % 4 = 0 THEN {host} END AS orig_h,
    CASE WHEN event_id % 4 = 0 THEN '10.9.9.9' END AS resp_h,
    CASE event_id % 5 WHEN 0 THEN '102' WHEN 1 THEN '80' END AS resp_p, event_id
    FROM events"""


def write_notices(spark, sf, path, files=None):
    """Notice log lines of all events: some without a time, some not JSON at all."""
    rows = A.table(spark, sf, "events").select(
        "event_id", A.seconds("ts"),
        F.expr("""CASE event_type WHEN 'error' THEN 'OTPolicy::Unauthorized_Modbus_Write'
            WHEN 'view' THEN 'Signatures::Sensitive_Signature'
            ELSE concat('Note::', event_type) END""").alias("note"),
        F.col("props").alias("msg"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'ssl, DNP3 ' WHEN 1 THEN 'http' END")
        .alias("service"),
        F.concat(F.lit("src"), "user_id").alias("src"),
        F.concat(F.lit("dst"), "user_id").alias("dst"),
        F.when(F.col("event_id") % 4 == 0, A.host("user_id")).alias("id.orig_h"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN '10.9.9.9' END").alias("id.resp_h"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 102 WHEN 1 THEN 80 END").alias("id.resp_p"))
    timed = F.when(F.col("event_id") % 50 != 1, F.col("ts")).alias("ts")
    whole = F.to_json(F.struct(timed, *[
        F.col(f"`{c}`") for c in rows.columns if c not in ("ts", "event_id")]))
    line = F.when(F.col("event_id") % 50 == 2, F.concat(F.lit("{broken "), whole)).otherwise(whole)
    lines = rows.select(line.alias("value"))
    (lines.repartition(files) if files else lines).write.text(path)


_NOTICE_SQL = _NOTICE.format(seconds=S.seconds("ts"), host=S.host("user_id"))
_NOTICE_ROWS = f"""SELECT ts, note AS note_type, msg AS message,
    coalesce(orig_h, src) AS src_h, coalesce(resp_h, dst) AS dst_h,
    CASE WHEN contains(note, 'Unauthorized') OR contains(note, 'Sensitive') THEN 'high'
        ELSE 'medium' END AS severity,
    {S.zone('service', 'CAST(resp_p AS INTEGER)')} AS zone, 'zeek' AS source
    FROM ({_NOTICE_SQL}) WHERE event_id % 50 NOT IN (1, 2)"""
NOTICE_ALERTS_SQL = (
    f"SELECT {S.digest(S.micros('ts'), 'note_type', 'message', 'src_h', 'dst_h', 'severity', 'zone', 'source')}"
    f" AS id, * FROM ({_NOTICE_ROWS})")


@query(NOTICE_ALERTS_SQL)
def notice_alerts(spark, sf):
    path = fresh_path(spark, "notice-log")
    write_notices(spark, sf, path)
    good, _ = split_rejects(read_logs(spark, path, "notice"), ingest.valid_notice())
    return ingest.normalize_notice(good)


@query("SELECT count(*) AS n FROM events WHERE event_id % 50 = 2")
def rejected_lines(spark, sf):
    """Lines that do not parse, kept with their text."""
    path = fresh_path(spark, "notice-log")
    write_notices(spark, sf, path)
    _, rejects = split_rejects(read_logs(spark, path, "notice"), ingest.valid_notice())
    broken = F.col("_corrupt_record").startswith("{broken ")
    return rejects.select("msg", broken.alias("broken")).agg(F.count_if("broken").alias("n"))


def write_software_log(spark, sf, path):
    A.software(spark, sf).drop("id").write.json(path)


SOFTWARE_ROWS_SQL = S.cte("software") + f"""SELECT {S.digest(S.micros('ts'), 'host',
    'software_type', 'name', 'unparsed_version')} AS id, ts, host, software_type, name,
    unparsed_version FROM software"""


@query(SOFTWARE_ROWS_SQL)
def software_rows(spark, sf):
    path = fresh_path(spark, "software-log")
    write_software_log(spark, sf, path)
    good, _ = split_rejects(read_logs(spark, path, "software"), ingest.valid_software())
    return ingest.normalize_software(good)


def write_conn_log(spark, sf, path, files=None):
    """The log as JSON lines, a file per task that holds it, or in as many files."""
    log = A.conn(spark, sf).withColumnsRenamed({
        "orig_h": "id.orig_h", "resp_h": "id.resp_h", "resp_p": "id.resp_p",
    })
    (log.repartition(files) if files else log).write.json(path)


@query(S.cte("conn_stats") + "SELECT * FROM conn_stats")
def logged_connection_stats(spark, sf):
    """Connection counts of a log written and read back as JSON lines."""
    path = fresh_path(spark, "conn-log")
    write_conn_log(spark, sf, path)
    good, _ = split_rejects(read_logs(spark, path, "conn"), ingest.valid_conn())
    return ingest.connection_stats(ingest.normalize_conn(good))


BATCH_ALERTS_SQL = f"""SELECT {S.digest("'agent-' || user_id", S.micros('ts'), 'props')} AS id, ts,
    'Agent::' || event_type AS note_type, props AS message, '' AS src_h,
    '10.0.0.' || i AS dst_h, CASE WHEN i = 1 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN event_id % 2 = 0 THEN 'OT' ELSE 'IT' END AS zone,
    'agent:agent-' || user_id AS source
    FROM (SELECT event_id, user_id, event_type, props, i,
        CAST(event_id * 2 + i AS DOUBLE) AS ts FROM events, range(0, 2) r(i)
        WHERE (event_type = 'error') OR (event_type = 'click' AND i = 0))"""


def _batches(spark, sf):
    path = fresh_path(spark, "agent-batches")
    A.agent_batches(spark, sf).write.json(path)
    good, _ = split_rejects(read_agent_batches(spark, path))
    return good


@query(BATCH_ALERTS_SQL)
def agent_batch_alerts(spark, sf):
    return ingest.ingest_agent_batches(_batches(spark, sf))[0]


BATCH_COUNTS_SQL = f"""SELECT 'agent-' || user_id AS agent_id, zone, service, count,
    {S.seconds('ts')} AS ts FROM (
    SELECT user_id, ts, CASE WHEN event_id % 4 = 0 THEN 'IT' ELSE 'OT' END AS zone,
        'modbus' AS service, event_id % 10 AS count FROM events
    UNION ALL SELECT user_id, ts, 'IT', CASE WHEN event_id % 3 = 0 THEN 'unclassified'
        ELSE 'http' END, user_id FROM events
    UNION ALL SELECT user_id, ts, 'bare', 'unclassified', 1 FROM events)"""


@query(BATCH_COUNTS_SQL)
def agent_batch_counts(spark, sf):
    return ingest.ingest_agent_batches(_batches(spark, sf))[1]


@query(f"""SELECT agent_id, zone, service, CAST(sum(count) AS BIGINT) AS count
    FROM ({BATCH_COUNTS_SQL}) GROUP BY ALL""")
def agent_traffic(spark, sf):
    return ingest.agent_traffic(ingest.ingest_agent_batches(A.agent_batches(spark, sf))[1])


@query(S.cte("agent_conn") + f"""SELECT agent_id, {S.agent_zone(S.guess('resp_p'), 'resp_p')}
    AS zone, {S.guess('resp_p')} AS service, count(*) AS count,
    floor(ts / 30) * 30 + 30 AS ts FROM agent_conn GROUP BY ALL""")
def agent_increments(spark, sf):
    return ingest.agent_increments(A.agent_conn(spark, sf))


@query(S.cte("checkins") + """SELECT agent_id, hostname, ip, os, agent_group, version,
    ts AS last_checkin FROM checkins""")
def checkin_agents(spark, sf):
    return ingest.ingest_checkins(A.checkins(spark, sf))[0]


@query(S.cte("checkins") + """SELECT ip, 'IT' AS zone, ts AS first_seen, ts AS last_seen
    FROM checkins WHERE ip LIKE 'fe80::%' OR ip LIKE '8.8.4.%' OR ip LIKE '10.9.%'""")
def checkin_observations(spark, sf):
    return ingest.ingest_checkins(A.checkins(spark, sf))[1]


# -- reference documents ----------------------------------------------------------------

def nvd_pages(spark, sf):
    """One vulnerability page per part, as JSON text with all the odd cases in it."""
    score = "named_struct('cvssData', named_struct('baseScore', {}))"
    metric = f"array({score.format('round(p_retailprice / 100, 1)')}, {score.format('0.5D')})"
    empty = f"filter({metric}, m -> false)"
    none = f"array({score.format('CAST(NULL AS double)')})"
    pages = A.table(spark, sf, "part").select("p_brand", F.expr(f"""to_json(named_struct(
        'vulnerabilities', array(named_struct('cve', named_struct(
            'id', concat('CVE-', p_partkey),
            'descriptions', CASE WHEN p_size % 7 = 0
                THEN array(named_struct('lang', 'es', 'value', p_name))
                ELSE array(named_struct('lang', 'es', 'value', 'nada'),
                           named_struct('lang', 'en', 'value', concat(p_name, ' ', p_type)),
                           named_struct('lang', 'en', 'value', 'second')) END,
            'metrics', named_struct(
                'cvssMetricV31', CASE p_size % 4 WHEN 0 THEN {metric} WHEN 1 THEN {empty}
                    WHEN 2 THEN {none} END,
                'cvssMetricV30', CASE WHEN p_size % 3 = 0 THEN {metric} END,
                'cvssMetricV2', CASE WHEN p_size % 5 = 0 THEN {metric} END))))))""").alias("page"))
    return pages.select(
        "p_brand", F.from_json("page", schemas.NVD_PAGE).alias("j")).select("p_brand", "j.*")


@query("""SELECT 'CVE-' || p_partkey AS cve_id, p_brand AS keyword,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name || ' ' || p_type END AS description,
    CASE WHEN p_size % 4 = 0 THEN round(p_retailprice / 100, 1) WHEN p_size % 4 = 2 THEN NULL
        WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN round(p_retailprice / 100, 1) END
        AS cvss_score FROM part""")
def nvd_rows(spark, sf):
    return flatten_nvd(nvd_pages(spark, sf), keyword=F.col("p_brand"))


def stix_bundles(spark, sf):
    refs = """array(named_struct('source_name', 'capec', 'external_id', 'C1'),
        named_struct('source_name', '{}', 'external_id', concat('T', doc_id)))"""
    phases = "array(named_struct('phase_name', lang), named_struct('phase_name', source))"
    bundles = A.table(spark, sf, "documents").select(F.expr(f"""to_json(named_struct(
        'objects', array(named_struct(
            'type', CASE WHEN doc_id % 11 = 0 THEN 'malware' ELSE 'attack-pattern' END,
            'revoked', CASE WHEN doc_id % 13 = 0 THEN true WHEN doc_id % 2 = 0 THEN false END,
            'x_mitre_deprecated', CASE WHEN doc_id % 17 = 0 THEN true END,
            'external_references', CASE WHEN doc_id % 7 = 0 THEN {refs.format('other')}
                ELSE {refs.format('mitre-attack')} END,
            'kill_chain_phases', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {phases} END,
            'name', source, 'description', text))))""").alias("bundle"))
    return bundles.select(F.from_json("bundle", schemas.STIX_BUNDLE).alias("j")).select("j.*")


@query(f"""SELECT 'T' || doc_id AS technique_id, source AS name, CASE WHEN doc_id % 5 = 0 THEN ''
    ELSE lang || ', ' || source END AS tactic, text
    AS description FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0
    AND doc_id % 17 <> 0 AND doc_id % 7 <> 0""")
def stix_rows(spark, sf):
    return flatten_stix(stix_bundles(spark, sf))


@query(S.cte("cve_items") + """SELECT row_number() OVER (ORDER BY
    split_part(description, ' as used by ', 2), pos) - 1 AS pos, cve_id,
    keyword, description, cvss_score FROM cve_items""")
def cached_reference(spark, sf):
    """The list, by product type, written in files of JSON lines and read back."""
    path = fresh_path(spark, "reference")
    kind = F.split_part("description", F.lit(" as used by "), F.lit(2))
    A.cve_items(spark, sf).orderBy(kind, "pos").select(
        "cve_id", "keyword", "description", "cvss_score").write.json(path)
    return load_reference_lines(spark, f"{path}/*.json", "cve")


# -- requests ---------------------------------------------------------------------------

_DECIDED = f"""CASE action WHEN 'block' THEN 'stubbed' ELSE 'not_applicable' END
    AS enforcement_status, CASE action WHEN 'block' THEN
    '{K.BLOCK_DETAIL.replace('%s', "' || src_h || '", 1).replace('%s', "' || dst_h || '", 1)}'
    WHEN 'allow' THEN
    '{K.ALLOW_DETAIL.replace('%s', "' || src_h || '", 1).replace('%s', "' || dst_h || '", 1)}'
    ELSE '{K.INVESTIGATE_DETAIL}' END AS enforcement_detail"""


@query(S.cte("action_requests") + f"""SELECT {S.digest('alert_id', 'action', S.micros('ts'))}
    AS id, alert_id, action, actor, notes, {_DECIDED}, ts
    FROM action_requests WHERE action <> 'close'""")
def action_rows(spark, sf):
    return commands.apply_alert_actions(A.action_requests(spark, sf))[0]


@query(S.cte("action_requests") + """SELECT *, 'Invalid action' AS error FROM action_requests
    WHERE action = 'close'""")
def rejected_actions(spark, sf):
    return commands.apply_alert_actions(A.action_requests(spark, sf))[1]


_CHECKED = f"""SELECT * REPLACE (trim(ip) AS ip), CASE
    WHEN NOT regexp_full_match(trim(ip), '{S.IPV4}') THEN 'Invalid IP address'
    WHEN zone NOT IN ('IT', 'OT') THEN 'zone must be IT or OT'
    WHEN criticality = 'urgent' THEN 'Invalid criticality' END AS error FROM asset_requests"""


@query(S.cte("asset_requests") + f"""SELECT ip, zone, ts AS first_seen, ts AS last_seen
    FROM ({_CHECKED}) WHERE error IS NULL""")
def added_observations(spark, sf):
    return commands.add_assets(A.asset_requests(spark, sf))[0]


@query(S.cte("asset_requests") + f"""SELECT ip, owner, criticality, tags, notes, actor, ts
    FROM ({_CHECKED}) WHERE error IS NULL""")
def added_admin_rows(spark, sf):
    return commands.add_assets(A.asset_requests(spark, sf))[1]


@query("""SELECT CASE c_custkey % 3
        WHEN 0 THEN '2001:db8::' || lower(hex(c_custkey % 65535 + 1)) || ':0:0:1'
        WHEN 1 THEN 'fe80::' || lower(hex(c_custkey % 65535 + 1)) || '%eth0'
        ELSE '::ffff:10.' || (c_custkey % 256) || '.' || c_nationkey || '.7' END AS ip,
    count(*) AS requests, max(CAST(c_custkey AS DOUBLE)) AS last_seen
    FROM customer GROUP BY 1""")
def added_ipv6_hosts(spark, sf):
    """Hosts that are added under long, capital, mapped and scoped spellings, counted by one."""
    spelled = F.expr("""CASE c_custkey % 3
        WHEN 0 THEN format_string('2001:0DB8:0000:0:%04X:0:0:0001', c_custkey % 65535 + 1)
        WHEN 1 THEN format_string('FE80:0:0:0:0:000:0:%04x%%eth0', c_custkey % 65535 + 1)
        ELSE format_string('0:0::0:FFFF:10.%d.%d.7', c_custkey % 256, c_nationkey) END""")
    requests = A.asset_requests(spark, sf).where("false").unionByName(
        A.table(spark, sf, "customer").select(
            spelled.alias("ip"), F.lit("IT").alias("zone"), F.col("c_name").alias("owner"),
            *[F.lit("").alias(c) for c in ("criticality", "tags", "notes", "actor")],
            F.col("c_custkey").cast("double").alias("ts")))
    return commands.add_assets(requests)[0].groupBy("ip").agg(
        F.count("*").alias("requests"), F.max("last_seen").alias("last_seen"))


@query(S.cte("asset_requests") + f"SELECT * FROM ({_CHECKED}) WHERE error IS NOT NULL")
def rejected_assets(spark, sf):
    return commands.add_assets(A.asset_requests(spark, sf))[2]


@query(S.cte("asset_requests") + """SELECT ip, owner, criticality, tags, notes, actor, ts
    FROM asset_requests""")
def edited_assets(spark, sf):
    return commands.edit_assets(A.asset_requests(spark, sf))


_EDITS = """edits AS (SELECT ip, ts, max(struct_pack(owner := owner, criticality := criticality,
    tags := tags, notes := notes)).criticality AS criticality FROM asset_admin GROUP BY ip, ts),
    judged AS (SELECT r.*, e.criticality AS host_criticality FROM policy_requests r
    ASOF LEFT JOIN edits e ON e.ip = r.ip AND r.ts >= e.ts),
    checked AS (SELECT *, CASE WHEN policy = 'drop' THEN 'Invalid policy'
    WHEN policy IN ('blacklist', 'quarantine') AND host_criticality = 'critical'
        AND NOT confirm_critical THEN ip || ' is tagged CRITICAL. Resubmit with confirm_critical=true to proceed.'
    END AS error FROM judged)"""
_POLICY_CTE = S.cte("policy_requests", "asset_admin").rstrip() + ",\n" + _EDITS
_POLICY_DETAIL = f"""CASE policy WHEN 'blacklist' THEN '{K.BLACKLIST_DETAIL.replace('%s', "' || ip || '")}'
    WHEN 'quarantine' THEN '{K.QUARANTINE_DETAIL.replace('%s', "' || ip || '")}'
    WHEN 'whitelist' THEN '{K.WHITELIST_DETAIL.replace('%s', "' || ip || '")}'
    ELSE '{K.CLEARED_DETAIL.replace('%s', "' || ip || '")}' END"""


@query(_POLICY_CTE + f""" SELECT {S.digest('ip', 'policy', S.micros('ts'))} AS id, ip, policy,
    actor, notes, CASE WHEN policy IN ('blacklist', 'quarantine') THEN 'stubbed'
    ELSE 'not_applicable' END AS enforcement_status, {_POLICY_DETAIL} AS enforcement_detail, ts
    FROM checked WHERE error IS NULL""")
def policy_rows(spark, sf):
    return commands.apply_ip_policies(
        A.policy_requests(spark, sf), A.asset_admin(spark, sf))[0]


@query(_POLICY_CTE + """ SELECT * EXCLUDE (host_criticality) FROM checked
    WHERE error IS NOT NULL""")
def rejected_policies(spark, sf):
    return commands.apply_ip_policies(
        A.policy_requests(spark, sf), A.asset_admin(spark, sf))[1]
