"""Queries over current state, joins and analytics."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridwarden.operators import analytics, ingest, state
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.expressions import NOW
from gridwarden.plans.registry import query


# -- aggregates and current state ---------------------------------------------------------

@query(S.cte("conn_stats") + "SELECT * FROM conn_stats")
def connection_stats(spark, sf):
    return ingest.connection_stats(A.conn(spark, sf))


@query(S.cte("observations") + "SELECT * FROM observations")
def asset_observations(spark, sf):
    return ingest.asset_observations(A.conn(spark, sf))


def stored_observations(spark, sf):
    """Observations as they come to be stored: here in two parts that share hosts."""
    conn = A.conn(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    even = ingest.asset_observations(conn.where("day % 2 = 0"))
    return even.unionByName(ingest.asset_observations(conn.where("day % 2 = 1")))


@query(S.cte("observations") + "SELECT * FROM observations")
def collapsed_assets(spark, sf):
    return state.collapse_assets(stored_observations(spark, sf))


@query(S.cte("latest_action") + "SELECT * FROM latest_action")
def latest_actions(spark, sf):
    return state.latest_action(A.alert_actions(spark, sf))


@query(S.cte("latest_admin") + "SELECT * FROM latest_admin")
def latest_admin(spark, sf):
    return state.latest_admin(A.asset_admin(spark, sf))


@query(S.cte("latest_policy") + "SELECT * FROM latest_policy")
def latest_policies(spark, sf):
    return state.latest_policy(A.ip_policies(spark, sf))


@query(S.cte("roster") + "SELECT * FROM roster")
def agent_roster(spark, sf):
    return state.agent_roster(A.agents(spark, sf))


@query(S.cte("roster") + f"""(SELECT 'status' AS kind, CASE WHEN {NOW} - last_checkin < 90
    THEN 'active' ELSE 'disconnected' END AS label, count(*) AS count FROM roster GROUP BY ALL)
    UNION ALL (SELECT 'os', CASE WHEN os = '' THEN 'unknown' ELSE os END AS label, count(*) AS n
        FROM roster GROUP BY ALL ORDER BY n DESC, label LIMIT 5)
    UNION ALL (SELECT 'group', CASE WHEN agent_group = '' THEN 'default' ELSE agent_group END
        AS label, count(*) AS n FROM roster GROUP BY ALL ORDER BY n DESC, label LIMIT 5)""")
def agent_breakdown(spark, sf):
    return state.agent_breakdown(state.agent_roster(A.agents(spark, sf)), NOW)


@query(S.cte("scored_matches") + "SELECT DISTINCT source_key FROM scored_matches")
def seen_keys(spark, sf):
    return state.seen_keys(A.scored_matches(spark, sf))


# -- joins on current state ---------------------------------------------------------------

@query(S.cte("observations", "latest_admin", "latest_policy", "agents") + """
    SELECT o.*, coalesce(a.owner, '') AS owner, coalesce(a.criticality, '') AS criticality,
        coalesce(a.tags, '') AS tags, coalesce(a.notes, '') AS notes,
        coalesce(p.policy, 'none') AS policy,
        coalesce(p.enforcement_status, '') AS enforcement_status,
        coalesce(g.hostname, '') AS agent_hostname
    FROM observations o LEFT JOIN latest_admin a ON a.ip = o.ip
    LEFT JOIN latest_policy p ON p.ip = o.ip
    LEFT JOIN (SELECT ip, max(struct_pack(t := last_checkin, agent_id := agent_id,
        hostname := hostname)).hostname AS hostname FROM agents GROUP BY ip) g ON g.ip = o.ip""")
def asset_inventory(spark, sf):
    return state.asset_inventory(
        ingest.asset_observations(A.conn(spark, sf)), A.asset_admin(spark, sf),
        A.ip_policies(spark, sf), A.agents(spark, sf))


_WITH_STATUS = """SELECT al.*, coalesce(a.action, 'open') AS status,
    coalesce(a.actor, '') AS last_actor, coalesce(a.notes, '') AS last_notes
    FROM alerts al LEFT JOIN latest_action a ON a.alert_id = al.id"""


@query(S.cte("alerts", "latest_action") + _WITH_STATUS + " ORDER BY al.ts DESC, al.id LIMIT 100")
def alerts_with_status(spark, sf):
    return state.alerts_with_status(A.alerts(spark, sf), A.alert_actions(spark, sf))


@query(S.cte("alerts", "latest_action") + _WITH_STATUS)
def all_alerts_with_status(spark, sf):
    return state.alerts_with_status(
        A.alerts(spark, sf), A.alert_actions(spark, sf), limit=None)


@query(S.cte("status_alerts") + "SELECT * FROM status_alerts")
def dashboard_alerts(spark, sf):
    return state.dashboard_alerts(A.alerts(spark, sf), A.alert_actions(spark, sf))


@query(S.cte("alerts", "alert_actions") + f"""SELECT a.id, a.alert_id, a.action, a.actor,
    a.notes, a.ts, coalesce(al.message, '(alert not found)') AS message,
    CAST(floor(({NOW} - a.ts) / 86400) AS BIGINT) || 'd ago' AS age
    FROM (SELECT * FROM alert_actions ORDER BY ts DESC, id LIMIT 10) a
    LEFT JOIN alerts al ON al.id = a.alert_id""")
def recent_actions(spark, sf):
    return state.recent_actions(A.alert_actions(spark, sf), A.alerts(spark, sf), NOW)


@query(S.cte("alerts") + "SELECT * FROM alerts ORDER BY ts DESC, id LIMIT 200")
def newest_alerts(spark, sf):
    return state.newest_first(A.alerts(spark, sf), limit=200)


# -- counts, shares, trends -----------------------------------------------------------------

@query(S.cte("alerts", "scored_matches") + """SELECT (SELECT count(*) FROM alerts) AS alerts,
    (SELECT count(*) FROM alerts WHERE severity = 'high') AS high_alerts,
    (SELECT count(*) FROM scored_matches) AS cve_matches,
    (SELECT count(DISTINCT source_key) FROM scored_matches) AS technique_matches""")
def kpi_totals(spark, sf):
    matches = A.scored_matches(spark, sf)
    return analytics.kpis(A.alerts(spark, sf), matches, state.seen_keys(matches))


@query(S.cte("alerts") + """SELECT severity, count(*) AS count,
    round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 2) AS percent
    FROM alerts GROUP BY severity""")
def severity_split(spark, sf):
    return analytics.severity_split(A.alerts(spark, sf))


@query(S.cte("conn_stats") + """SELECT zone, CAST(sum(count) AS BIGINT) AS count
    FROM conn_stats GROUP BY zone""")
def traffic_by_zone(spark, sf):
    return analytics.traffic_by_zone(connection_stats(spark, sf))


@query(S.cte("alerts") + "SELECT zone, count(*) AS count FROM alerts GROUP BY zone")
def alerts_by_zone(spark, sf):
    return analytics.alerts_by_zone(A.alerts(spark, sf))


@query(S.cte("conn_stats") + """SELECT service AS protocol, CAST(sum(count) AS BIGINT) AS count
    FROM conn_stats GROUP BY service""")
def traffic_by_service(spark, sf):
    return analytics.traffic_by_service(connection_stats(spark, sf))


@query(S.cte("alerts") + f"""SELECT {S.protocol("note_type || ' ' || message")} AS protocol,
    count(*) AS count FROM alerts GROUP BY ALL""")
def alerts_by_protocol(spark, sf):
    return analytics.alerts_by_protocol(A.alerts(spark, sf))


@query(S.cte("conn_stats") + "SELECT service, zone, count FROM conn_stats")
def traffic_by_service_zone(spark, sf):
    return analytics.traffic_by_service_zone(connection_stats(spark, sf))


@query("SELECT count(*) AS connections FROM events")
def traffic_total(spark, sf):
    return analytics.traffic_total(connection_stats(spark, sf))


@query(S.cte("scored_matches") + """SELECT tactic, count(*) AS count FROM scored_matches
    GROUP BY tactic""")
def tactic_counts(spark, sf):
    return analytics.tactic_counts(A.scored_matches(spark, sf))


@query("""WITH c AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY m)
    SELECT epoch_ms(g.m) // 1000 AS minute, coalesce(n, 0) AS count FROM (SELECT unnest(
        generate_series(min(m), max(m), INTERVAL 1 MINUTE)) AS m FROM c) g LEFT JOIN c USING (m)""")
def alert_trend(spark, sf):
    return analytics.alert_trend(A.alerts(spark, sf)).withColumn(
        "minute", F.unix_seconds("minute"))


@query(S.cte("scored_matches") + """SELECT bin, CAST(bin AS DOUBLE) AS low,
    CAST(bin + 1 AS DOUBLE) AS high, count(*) AS count FROM (SELECT CAST(least(
        floor(cvss_score), 9) AS INTEGER) AS bin FROM scored_matches
    WHERE cvss_score IS NOT NULL) GROUP BY bin""")
def cvss_histogram(spark, sf):
    return analytics.cvss_histogram(A.scored_matches(spark, sf))


def _top(table, col, n):
    return (S.cte(table) + f"SELECT {col}, count(*) AS count FROM {table} GROUP BY {col} "
            f"ORDER BY count DESC, {col} LIMIT {n}")


@query(_top("alerts", "src_h", 8))
def top_sources(spark, sf):
    return analytics.top_n(A.alerts(spark, sf), "src_h", 8)


@query(_top("scored_matches", "software", 8))
def top_software(spark, sf):
    return analytics.top_n(A.scored_matches(spark, sf), "software", 8)


@query(_top("scored_matches", "technique_name", 10))
def top_techniques(spark, sf):
    return analytics.top_n(A.scored_matches(spark, sf), "technique_name", 10)


@query(S.cte("alerts") + "SELECT * FROM alerts ORDER BY ts DESC, id LIMIT 25 OFFSET 75")
def alert_page(spark, sf):
    return analytics.page(A.alerts(spark, sf), 3, 25)


@query(S.cte("alerts") + """SELECT * FROM alerts ORDER BY ts DESC, id LIMIT 50
    OFFSET (SELECT (greatest(count(*) - 1, 0) // 50) * 50 FROM alerts)""")
def last_alert_page(spark, sf):
    """A page number past the end gives the last page."""
    return analytics.indexed_page(analytics.page_index(A.alerts(spark, sf)), 10 ** 9, 50)


@query(S.cte("alerts").rstrip() + """,
    placed AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) - 1 AS place,
        count(*) OVER () AS total FROM alerts)
    SELECT * EXCLUDE (place, total) FROM placed
    WHERE place < 100 OR (place // 100 = total // 200)""")
def pages_of_one_index(spark, sf):
    """The first page and one half-way down, both out of one index."""
    index = analytics.page_index(A.alerts(spark, sf))
    half = sum(n for _, n in index[1]) // 200
    pages = [analytics.indexed_page(index, number, 100) for number in {0, half}]
    return reduce(DataFrame.unionByName, pages)


@query(S.cte("alerts") + """SELECT * FROM alerts WHERE ts < 1705000000.0
    ORDER BY ts DESC, id LIMIT 25""")
def alert_page_after(spark, sf):
    return analytics.page_after(A.alerts(spark, sf), 1705000000.0, "~", 25)


@query(S.cte("scored_matches") + "SELECT DISTINCT source_key, cvss_score FROM scored_matches")
def best_matches(spark, sf):
    """The whole matches table, sorted by score."""
    rows = A.scored_matches(spark, sf).select("source_key", "cvss_score").distinct()
    return analytics.by_score(rows, "cvss_score")


@query(S.cte("scored_matches") + """SELECT DISTINCT source_key, CAST(1 - cvss_score / 10 AS DOUBLE)
    AS similarity FROM scored_matches""")
def closest_matches(spark, sf):
    """All similarities made from the order lines, sorted; closest_techniques sorts real ones."""
    rows = A.scored_matches(spark, sf).select(
        "source_key", (1 - F.col("cvss_score") / 10).alias("similarity")).distinct()
    return analytics.by_score(rows, "similarity")


_EVERY_THIRD = """timed AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN ts END AS ts)
    FROM alerts)"""


@query(S.cte("alerts").rstrip() + f""",\n{_EVERY_THIRD} SELECT * FROM timed
    WHERE ts < 1705000000.0 OR ts IS NULL""")
def alerts_after(spark, sf):
    """All that follows a row when a third of the alerts has no time: the timeless last."""
    rows = A.alerts(spark, sf).withColumn(
        "ts", F.when(F.col("id").cast("long") % 3 > 0, F.col("ts")))
    return analytics.page_after(rows, 1705000000.0, "~", None)
