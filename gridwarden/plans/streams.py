"""Streaming jobs run over the test tables until their input is used up."""

from pyspark.sql import functions as F

from gridwarden import schemas, sinks, streaming
from gridwarden.functions import event_time
from gridwarden.operators import correlate, state
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.correlation import (
    CVE_MATCHES_SQL, ENCODER, RUN_TS, TECHNIQUE_MATCHES_SQL,
)
from gridwarden.plans.detections import AGENT_SCANS_SQL, SENSOR_SCANS_SQL
from gridwarden.plans.expressions import (
    BATCH_ALERTS_SQL, BATCH_COUNTS_SQL, NOTICE_ALERTS_SQL, SOFTWARE_ROWS_SQL, write_conn_log, write_notices, write_software_log,
)
from gridwarden.plans.registry import query
from gridwarden.session import fresh_path
from gridwarden.sources import read_table

ONCE = {"availableNow": True}
#: The first second of the last notice's day.
LATEST_DAY = f"(SELECT floor(max(ts) / 86400) * 86400 FROM ({NOTICE_ALERTS_SQL}))"


def _paths(spark, name):
    base = fresh_path(spark, name)
    return f"{base}/in", f"{base}/store", f"{base}/checkpoint"


@query(NOTICE_ALERTS_SQL)
def streamed_alerts(spark, sf):
    logs, root, checkpoint = _paths(spark, "alert-stream")
    write_notices(spark, sf, logs)
    streaming.stream_alerts(spark, logs, root, checkpoint, ONCE).awaitTermination()
    return read_table(spark, root, "alerts")


def _alerts_in_batches(spark, sf):
    """A store that a stream has filled batch by batch."""
    logs, root, checkpoint = _paths(spark, "alert-batches")
    write_notices(spark, sf, logs, files=4)
    streaming.stream_alerts(
        spark, logs, root, checkpoint, ONCE, files_per_trigger=1).awaitTermination()
    return root


@query(f"""SELECT *, CASE WHEN ts < {LATEST_DAY} THEN 'merged' END AS part
    FROM ({NOTICE_ALERTS_SQL})""")
def merged_alerts(spark, sf):
    """Streamed alerts, the files of all days but the last one merged."""
    root = _alerts_in_batches(spark, sf)
    last = read_table(spark, root, "alerts").agg(F.max("ts")).first()[0]
    sinks.merge_days(spark, root, "alerts", last)
    rows = spark.read.parquet(f"{root}/alerts").drop("event_date")
    return rows.withColumn("part", F.when(F.col("part") == "merged", F.col("part")))


@query(f"SELECT * FROM ({NOTICE_ALERTS_SQL}) WHERE ts >= {LATEST_DAY} - 3 * 86400")
def retained_days(spark, sf):
    """Streamed alerts of the last three days and the days before these deleted."""
    root = _alerts_in_batches(spark, sf)
    last = read_table(spark, root, "alerts").agg(F.max("ts")).first()[0]
    sinks.drop_days(spark, root, "alerts", 3, last)
    return read_table(spark, root, "alerts")


@query(SOFTWARE_ROWS_SQL)
def streamed_software(spark, sf):
    logs, root, checkpoint = _paths(spark, "software-stream")
    write_software_log(spark, sf, logs)
    streaming.stream_software(spark, logs, root, checkpoint, ONCE).awaitTermination()
    return read_table(spark, root, "software")


def _connections(spark, sf):
    logs, root, checkpoint = _paths(spark, "conn-stream")
    write_conn_log(spark, sf, logs, files=4)
    streaming.stream_connections(
        spark, logs, root, checkpoint, ONCE, files_per_trigger=2).awaitTermination()
    return root


@query(S.cte("conn_stats") + "SELECT * FROM conn_stats")
def streamed_connection_stats(spark, sf):
    """Running totals over two micro-batches."""
    return streaming.read_totals(spark, _connections(spark, sf))


@query(S.cte("conn_stats") + """SELECT zone, service, CAST(2 * count AS BIGINT) AS count
    FROM conn_stats""")
def resumed_connection_stats(spark, sf):
    """A second stream with its own checkpoint goes on with the stored totals."""
    logs, root, checkpoint = _paths(spark, "conn-stream")
    write_conn_log(spark, sf, logs, files=4)
    for run in ("first", "second"):
        streaming.stream_connections(
            spark, logs, root, f"{checkpoint}-{run}", ONCE).awaitTermination()
    return streaming.read_totals(spark, root)


@query(f"SELECT * FROM ({NOTICE_ALERTS_SQL}) UNION ALL SELECT * FROM ({BATCH_ALERTS_SQL})")
def streamed_alerts_of_producers(spark, sf):
    """Sensor notices and agent reports, two streams into one alerts table."""
    logs, root, checkpoint = _paths(spark, "producers")
    write_notices(spark, sf, f"{logs}/notice")
    A.agent_batches(spark, sf).write.json(f"{logs}/agents")
    streaming.stream_alerts(
        spark, f"{logs}/notice", root, f"{checkpoint}-notice", ONCE).awaitTermination()
    streaming.stream_agent_batches(
        spark, f"{logs}/agents", root, f"{checkpoint}-agents", ONCE).awaitTermination()
    return read_table(spark, root, "alerts")


@query(BATCH_COUNTS_SQL)
def streamed_agent_counts(spark, sf):
    """The connection counts of agent reports, out of the stream that stores their alerts too."""
    logs, root, checkpoint = _paths(spark, "agent-stream")
    A.agent_batches(spark, sf).write.json(logs)
    streaming.stream_agent_batches(spark, logs, root, checkpoint, ONCE).awaitTermination()
    return read_table(spark, root, "agent_connection_stats")


@query(S.cte("checkins") + """SELECT agent_id, hostname, ip, os, agent_group, version,
    ts AS last_checkin FROM checkins""")
def streamed_checkins(spark, sf):
    logs, root, checkpoint = _paths(spark, "checkin-stream")
    A.checkins(spark, sf).write.json(logs)
    streaming.stream_checkins(spark, logs, root, checkpoint, ONCE).awaitTermination()
    return read_table(spark, root, "agents")


@query(S.cte("observations") + "SELECT * FROM observations")
def streamed_assets(spark, sf):
    """Host observations of two micro-batches, merged when read."""
    root = _connections(spark, sf)
    return state.collapse_assets(read_table(spark, root, "asset_observations"))


def _scan_stream(spark, events, refire):
    """The scan input as a stream, closed by one late event that moves the watermark on."""
    logs, out, checkpoint = _paths(spark, "scan-stream")
    end = events.agg((F.max("ts") + 7200).alias("ts")).select(
        "ts", F.lit("0.0.0.0").alias("orig_h"), F.lit("").alias("resp_h"),
        F.lit(0).alias("resp_p"), F.lit("tcp").alias("proto"))
    events.repartition(4).write.parquet(logs)
    end.write.mode("append").parquet(logs)
    stream = spark.readStream.schema(events.schema).parquet(logs)
    found = streaming.detect_scans_stream(stream, refire=refire, slot_seconds=3600)
    found.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(**ONCE).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(AGENT_SCANS_SQL)
def streamed_agent_scans(spark, sf):
    return _scan_stream(spark, A.scan_events(spark, sf), refire=False)


@query(SENSOR_SCANS_SQL)
def streamed_sensor_scans(spark, sf):
    return _scan_stream(spark, A.scan_events(spark, sf), refire=True)


@query(AGENT_SCANS_SQL.replace("'10.0.0.' || (user_id % 3) AS orig_h", "'10.0.0.0' AS orig_h"))
def streamed_scans_of_one_source(spark, sf):
    """All events come from one source."""
    events = A.scan_events(spark, sf).withColumn("orig_h", F.lit("10.0.0.0"))
    return _scan_stream(spark, events, refire=False)


INCREMENTS_SQL = S.cte("agent_conn") + f"""SELECT * FROM (SELECT agent_id,
    {S.agent_zone(S.guess('resp_p'), 'resp_p')} AS zone, {S.guess('resp_p')} AS service,
    count(*) AS count, floor(ts / 30) * 30 + 30 AS ts FROM agent_conn GROUP BY ALL)"""


@query(INCREMENTS_SQL)
def streamed_increments(spark, sf):
    logs, out, checkpoint = _paths(spark, "increment-stream")
    rows = A.agent_conn(spark, sf).withColumn("event_time", event_time(F.col("ts")))
    rows.write.parquet(logs)
    end = rows.agg(F.max("ts").alias("ts")).select(
        F.lit("end").alias("agent_id"), (F.col("ts") + 7200).alias("ts"),
        F.lit(0).alias("resp_p")).withColumn("event_time", event_time(F.col("ts")))
    end.write.mode("append").parquet(logs)
    stream = spark.readStream.schema(rows.schema).parquet(logs)
    streaming.stream_increments(stream, out, checkpoint, trigger=ONCE).awaitTermination()
    return spark.read.schema(schemas.AGENT_CONNECTION_STATS).parquet(out)


@query(INCREMENTS_SQL)
def streamed_late_increments(spark, sf):
    """The connections of the second half come first, so those of the first are late."""
    logs, root, checkpoint = _paths(spark, "late-stream")
    rows = A.agent_conn(spark, sf).withColumn("event_time", event_time(F.col("ts")))
    middle = rows.agg(F.avg("ts")).first()[0]
    for part in (rows.where(F.col("ts") >= middle), rows.where(F.col("ts") < middle)):
        part.write.mode("append").parquet(logs)
        stream = spark.readStream.schema(rows.schema).parquet(logs)
        streaming.stream_late_increments(
            stream, root, checkpoint, trigger=ONCE).awaitTermination()
    return streaming.read_increments(spark, root)


@query(TECHNIQUE_MATCHES_SQL)
def streamed_technique_matches(spark, sf):
    """Alerts matched as they come; the reference is new, so the first batch takes all."""
    logs, root, checkpoint = _paths(spark, "match-stream")
    sinks.append(A.alerts(spark, sf), root, "alerts")
    sinks.replace(
        correlate.build_technique_reference(A.technique_items(spark, sf), ENCODER),
        root, "mitre_attack")
    stream = spark.readStream.schema(schemas.ALERTS).parquet(f"{root}/alerts")
    streaming.stream_matches(
        stream, lambda: read_table(spark, root, "alerts"), root, "mitre_attack",
        streaming.technique_matcher(ENCODER, RUN_TS), "mitre_matches", checkpoint, ONCE,
    ).awaitTermination()
    return read_table(spark, root, "mitre_matches")


def _earlier_list(spark, sf):
    """The list as it was: some items missing, some with another keyword and text, and some that
    are withdrawn since."""
    listed = A.cve_items(spark, sf)
    was = listed.where("pos % 5 <> 0").withColumns({
        "keyword": F.when(F.col("pos") % 7 == 0, F.concat("keyword", F.lit(" mk2"))).otherwise(
            F.col("keyword")),
        "description": F.when(F.col("pos") % 7 == 0, F.concat(
            F.lit("Earlier "), "description")).otherwise(F.col("description")),
        "cvss_score": F.when(F.col("pos") % 11 == 0, 1.5).otherwise(F.col("cvss_score"))})
    withdrawn = listed.where("pos % 3 = 0").select(
        (F.col("pos") + 1_000_000).alias("pos"), F.concat(F.lit("GONE-"), "pos").alias("cve_id"),
        "keyword", F.concat(F.lit("Withdrawn "), "description").alias("description"),
        "cvss_score")
    return was.unionByName(withdrawn)


@query(CVE_MATCHES_SQL)
def streamed_cve_matches(spark, sf):
    """Half of the software under an earlier list, the other half under the one that replaced it:
    the same matches as of all software and the last list."""
    _, root, checkpoint = _paths(spark, "software-match-stream")
    rows = A.software(spark, sf)
    half = F.pmod(F.hash("id"), F.lit(2))
    for part, listed in ((0, _earlier_list(spark, sf)), (1, A.cve_items(spark, sf))):
        sinks.replace(listed, root, "cve_list")
        sinks.append(rows.where(half == part), root, "software")
        stream = spark.readStream.schema(schemas.SOFTWARE).parquet(f"{root}/software")
        streaming.stream_software_matches(
            stream, root, ENCODER, RUN_TS, checkpoint, ONCE).awaitTermination()
    return streaming.read_matches(spark, root, checkpoint)
