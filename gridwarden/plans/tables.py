"""Queries that write stored tables and read them back."""

from pyspark.sql import functions as F

from gridwarden import sinks
from gridwarden.operators import ingest, state
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.expressions import NOW
from gridwarden.plans.registry import query
from gridwarden.session import fresh_path
from gridwarden.sources import read_snapshot, read_table


@query(S.cte("alerts") + """SELECT id, note_type, zone FROM alerts UNION ALL
    SELECT id, note_type, NULL FROM alerts WHERE severity = 'high'""")
def appended_alerts(spark, sf):
    """Two appends, the second without a zone; only three columns are read back."""
    root = fresh_path(spark, "store")
    rows = A.alerts(spark, sf)
    sinks.append(rows, root, "alerts")
    sinks.append(rows.where("severity = 'high'").drop("zone"), root, "alerts")
    return read_table(spark, root, "alerts", ["id", "note_type", "zone"])


@query(S.cte("conn_stats") + "SELECT * FROM conn_stats")
def replaced_stats(spark, sf):
    """A snapshot replaced twice; readers see the last one."""
    root = fresh_path(spark, "store")
    stats = ingest.connection_stats(A.conn(spark, sf))
    sinks.replace(stats.withColumn("count", F.lit(0)), root, "connection_stats", 1.0)
    sinks.replace(stats, root, "connection_stats", 2.0)
    return read_snapshot(spark, root, "connection_stats")


def _kept(spark, log, table):
    """The newest rows of a log, kept over two refreshes of which each sees half of it."""
    root = fresh_path(spark, "store")
    half = F.pmod(F.hash(*log.columns), F.lit(2))
    for part in range(2):
        sinks.append(log.where(half == part), root, table)
        sinks.refresh_latest(spark, root, table)
    return read_snapshot(spark, root, f"latest_{table}")


@query(S.cte("latest_action") + "SELECT * FROM latest_action")
def kept_latest_actions(spark, sf):
    return state.latest_action(_kept(spark, A.alert_actions(spark, sf), "alert_actions"))


@query(S.cte("latest_admin") + "SELECT * FROM latest_admin")
def kept_latest_admin(spark, sf):
    return state.latest_admin(_kept(spark, A.asset_admin(spark, sf), "asset_admin"))


@query(S.cte("latest_policy") + "SELECT * FROM latest_policy")
def kept_latest_policies(spark, sf):
    return state.latest_policy(_kept(spark, A.ip_policies(spark, sf), "ip_policies"))


def _match_rows(spark, sf):
    return A.scored_matches(spark, sf).select(
        "source_key", "software", F.col("cvss_score").cast("float").alias("cvss_score"),
        F.lit("fuzzy").alias("match_type"))


@query(S.cte("scored_matches") + "SELECT DISTINCT source_key, 'fuzzy' AS match_type FROM "
       "scored_matches")
def appended_matches(spark, sf):
    """Appends of overlapping matches leave one row per key."""
    root = fresh_path(spark, "store")
    rows = _match_rows(spark, sf)
    sinks.append_new(rows.where("cvss_score > 3"), root, "cve_matches")
    sinks.append_new(rows, root, "cve_matches")
    sinks.append_new(rows, root, "cve_matches")
    return read_table(spark, root, "cve_matches", ["source_key", "match_type"])


@query(S.cte("scored_matches") + "SELECT DISTINCT source_key, 'fuzzy' AS match_type FROM "
       "scored_matches")
def matches_appended_by_key(spark, sf):
    """Overlapping appends to a table in buckets of its keys, which are not shuffled again."""
    path = fresh_path(spark, "matches")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = _match_rows(spark, sf)
    sinks.append_new_by_key(rows.where("cvss_score > 3"), name, "cve_matches", 16, path=path)
    sinks.append_new_by_key(rows, name, "cve_matches", 16, path=path)
    sinks.append_new_by_key(rows, name, "cve_matches", 16, path=path)
    return spark.table(name).select("source_key", "match_type")


@query(S.cte("scored_matches") + """SELECT DISTINCT source_key FROM scored_matches
    WHERE source_key NOT IN (SELECT source_key FROM scored_matches WHERE cvss_score > 3)""")
def unseen_matches(spark, sf):
    rows = _match_rows(spark, sf)
    return sinks.unseen(rows, rows.where("cvss_score > 3")).select("source_key")


@query(S.cte("alerts") + f"SELECT * FROM alerts WHERE ts >= {NOW} - 7 * 86400")
def retained_alerts(spark, sf):
    return sinks.retain(A.alerts(spark, sf), 7, NOW)


@query(S.cte("conn_stats") + """SELECT zone, service, CAST(2 * count AS BIGINT) AS count
    FROM conn_stats""")
def restored_stats(spark, sf):
    """Totals restored from a stored snapshot go on growing."""
    root = fresh_path(spark, "store")
    stats = ingest.connection_stats(A.conn(spark, sf))
    sinks.replace(stats, root, "connection_stats", 1.0)
    return ingest.add_stats(read_snapshot(spark, root, "connection_stats"), stats)
