"""Raw logs and agent reports to stored rows, connection counts and observed hosts."""

from pyspark.sql import functions as F

from gridwarden.functions.addresses import is_agent_ip, is_asset_ip
from gridwarden.functions.alerts import content_id, notice_severity, row_id
from gridwarden.functions.constants import REPORT_SECONDS
from gridwarden.functions.times import epoch_micros, event_time
from gridwarden.functions.zones import (
    agent_zone, guess_service, is_ot_port, is_ot_service, normal_service, split_zone_service,
    zone,
)


def _text(name):
    return F.coalesce(F.col(name), F.lit(""))


def _number(name):
    return F.col(name).try_cast("double")


def valid_conn():
    """The port, when there is one, is a whole number."""
    port = F.col("`id.resp_p`")
    return port.isNull() | (port == "") | port.try_cast("int").isNotNull()


def valid_notice():
    return valid_conn() & (F.col("ts").isNull() | _number("ts").isNotNull())


def valid_software():
    return F.col("ts").isNull() | _number("ts").isNotNull()


def normalize_conn(logs):
    """Connection log to plain columns.

    An absent time counts as 0; a time that is no number is NULL, and such a record
    is counted but gives no host observation.
    """
    ts = F.when(F.col("ts").isNull() | (F.col("ts") == ""), F.lit(0.0)).otherwise(_number("ts"))
    return logs.select(
        ts.alias("ts"),
        F.col("`id.orig_h`").alias("orig_h"),
        F.col("`id.resp_h`").alias("resp_h"),
        F.coalesce(F.col("`id.resp_p`").try_cast("int"), F.lit(0)).alias("resp_p"),
        _text("proto").alias("proto"),
        "service", "conn_state",
    )


def normalize_notice(logs):
    """Notice log to alert rows; records without a time are dropped."""
    port = F.coalesce(F.col("`id.resp_p`").try_cast("int"), F.lit(0))
    rows = logs.where(F.col("ts").isNotNull()).select(
        _number("ts").alias("ts"),
        _text("note").alias("note_type"),
        _text("msg").alias("message"),
        F.coalesce(F.col("`id.orig_h`"), F.col("src"), F.lit("")).alias("src_h"),
        F.coalesce(F.col("`id.resp_h`"), F.col("dst"), F.lit("")).alias("dst_h"),
        notice_severity(_text("note")).alias("severity"),
        zone(F.col("service"), port).alias("zone"),
        F.lit("zeek").alias("source"),
    )
    return rows.select(row_id(rows).alias("id"), "*")


def normalize_software(logs):
    rows = logs.where(F.col("ts").isNotNull()).select(
        _number("ts").alias("ts"),
        *[_text(c).alias(c) for c in ("host", "software_type", "name", "unparsed_version")],
    )
    return rows.select(row_id(rows).alias("id"), "*")


def connection_stats(conn):
    """Connections per (zone, service).

    Counts are taken per raw service text first, so the zone and name rules run once
    per distinct service instead of once per connection.
    """
    raw = conn.groupBy(
        "service", is_ot_port(F.col("resp_p")).alias("ot_port"),
    ).agg(F.count("*").alias("n"))
    service = normal_service(F.col("service"))
    named = raw.select(
        F.when(F.col("ot_port"), "OT").otherwise(zone(service, F.lit(0))).alias("zone"),
        service.alias("service"), "n")
    return named.groupBy("zone", "service").agg(F.sum("n").alias("count"))


def add_stats(*stats):
    """Sum (zone, service) counts, e.g. a restored snapshot and what came since."""
    total = stats[0]
    for other in stats[1:]:
        total = total.unionByName(other)
    return total.groupBy("zone", "service").agg(F.sum("count").alias("count"))


def asset_observations(conn):
    """Private hosts seen: every originator, and responders that answered.

    The zone is kept as a truth value until the end: minima and maxima of fixed-size
    values are hash-aggregated, those of text would sort every connection first.
    """
    answered = ~F.col("conn_state").eqNullSafe("S0")
    hosts = F.array("orig_h", F.when(answered, F.col("resp_h")))
    is_ot = is_ot_service(F.col("service")) | is_ot_port(F.col("resp_p"))
    seen = conn.where(F.col("ts").isNotNull()).select(
        "ts", is_ot.alias("is_ot"), F.explode(hosts).alias("ip"))
    return seen.where(is_asset_ip(F.col("ip"))).groupBy("ip").agg(
        F.max("is_ot").alias("is_ot"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    ).select("ip", F.when(F.col("is_ot"), "OT").otherwise("IT").alias("zone"),
             "first_seen", "last_seen")


def ingest_checkins(requests):
    """(agent rows, host observations) of agent check-ins."""
    filled = requests.fillna({"agent_group": "default", "version": "1.0.0"})
    agents = filled.select(
        "agent_id", "hostname", "ip", "os", "agent_group", "version",
        F.col("ts").alias("last_checkin"))
    observations = filled.where(is_agent_ip(F.col("ip"))).select(
        "ip", F.lit("IT").alias("zone"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    return agents, observations


def ingest_agent_batches(batches):
    """(alert rows, connection count increments) of agent reports."""
    alert = batches.select("agent_id", F.explode("alerts").alias("a"))
    alerts = alert.select(
        content_id(
            F.col("agent_id"), epoch_micros(F.col("a.ts")), F.col("a.message")).alias("id"),
        F.col("a.ts").alias("ts"),
        F.col("a.note_type").alias("note_type"),
        F.col("a.message").alias("message"),
        F.coalesce(F.col("a.src_h"), F.lit("")).alias("src_h"),
        F.coalesce(F.col("a.dst_h"), F.lit("")).alias("dst_h"),
        F.coalesce(F.col("a.severity"), F.lit("medium")).alias("severity"),
        F.coalesce(F.col("a.zone"), F.lit("IT")).alias("zone"),
        F.concat(F.lit("agent:"), F.col("agent_id")).alias("source"),
    )
    counts = batches.select("agent_id", "ts", F.explode("conn_counts").alias("key", "count"))
    zone_name, service = split_zone_service(F.col("key"))
    increments = counts.select(
        "agent_id", zone_name.alias("zone"), service.alias("service"), "count", "ts")
    return alerts, increments


def agent_increments(conn, seconds=REPORT_SECONDS):
    """Connections per agent, report interval, zone and guessed service.

    ``conn`` has ``agent_id``, ``ts`` and ``resp_p``; a stream needs a watermark on
    ``event_time``.
    """
    timed = conn if "event_time" in conn.columns else conn.withColumn(
        "event_time", event_time(F.col("ts")))
    service = guess_service(F.col("resp_p"))
    return timed.groupBy(
        "agent_id",
        F.window("event_time", f"{seconds} seconds").alias("w"),
        agent_zone(service, F.col("resp_p")).alias("zone"),
        service.alias("service"),
    ).agg(F.count("*").alias("count")).select(
        "agent_id", "zone", "service", "count",
        (F.unix_micros(F.col("w.end")) / 1000000).alias("ts"))


def agent_traffic(increments):
    """Total connections per agent, zone and service."""
    return increments.groupBy("agent_id", "zone", "service").agg(F.sum("count").alias("count"))
