"""Continuous ingest and matching.

Every job writes from ``foreachBatch``, which may run a batch twice after a failure. Writes
are therefore either named after the stream and the batch (a replay overwrites its own rows)
or limited to unseen keys. The offsets live in the query's checkpoint, so a restart goes on where it left.
"""

import time

from pyspark.sql import functions as F

from gridwarden.operators import correlate, ingest
from gridwarden.session import scratch
from gridwarden.sinks import append_new, append_once, to_table
from gridwarden.sources.logs import read_logs, split_rejects
from gridwarden.sources.tables import (
    COMMIT_SCHEMA, COMMITS, current_version, read_snapshot, read_table, stored_files,
)

POLL = "3 seconds"
LATE, SEEN = "late_connections", "seen_times"


def start_batches(stream, each_batch, checkpoint, trigger):
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL})).start()


def _logs(spark, path, kind, files_per_trigger):
    return read_logs(spark, path, kind, streaming=True, files_per_trigger=files_per_trigger)


def producer(spark, checkpoint):
    """The id that the stream keeps in its checkpoint: a restart goes on under it, a stream
    with a new checkpoint is another producer."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _keep_rejects(rejects, root, kind, batch_id, producer):
    rejects.select("_corrupt_record", F.to_json(F.struct(
        *[F.col(f"`{c}`") for c in rejects.columns if c != "_corrupt_record"])).alias("parsed"),
    ).write.mode("overwrite").parquet(f"{root}/rejects/{kind}/part={producer}.{batch_id}")


def _log_job(spark, path, kind, valid, tables, root, checkpoint, trigger, files=None):
    """Append what ``tables(good rows)`` gives, {table: rows}, once per micro-batch."""
    def each_batch(batch, batch_id):
        run = producer(spark, checkpoint)
        batch = batch.persist()  # read once for all tables and the rejects
        try:
            good, rejects = split_rejects(batch, valid)
            for table, rows in tables(good).items():
                append_once(rows, root, table, batch_id, run)
            _keep_rejects(rejects, root, kind, batch_id, run)
        finally:
            batch.unpersist()

    return start_batches(_logs(spark, path, kind, files), each_batch, checkpoint, trigger)


def stream_alerts(spark, path, root, checkpoint, trigger=None, files_per_trigger=None):
    """Notice logs to the alerts table."""
    def tables(good):
        return {"alerts": ingest.normalize_notice(good)}

    return _log_job(spark, path, "notice", ingest.valid_notice(), tables, root, checkpoint,
                    trigger, files_per_trigger)


def stream_software(spark, path, root, checkpoint, trigger=None, files_per_trigger=None):
    """Software logs to the software table."""
    def tables(good):
        return {"software": ingest.normalize_software(good)}

    return _log_job(spark, path, "software", ingest.valid_software(), tables, root, checkpoint,
                    trigger, files_per_trigger)


def stream_connections(spark, path, root, checkpoint, trigger=None, files_per_trigger=None):
    """Connection logs to (zone, service) counts and host observations.

    Each micro-batch appends its own counts, a row per zone and service; ``read_totals``
    sums them. Totals so go on over restarts, new checkpoints and several producers.
    """
    def tables(good):
        conn = ingest.normalize_conn(good)
        return {"connection_stats": ingest.connection_stats(conn).coalesce(1),
                "asset_observations": ingest.asset_observations(conn)}

    return _log_job(spark, path, "conn", ingest.valid_conn(), tables, root, checkpoint,
                    trigger, files_per_trigger)


def read_totals(spark, root):
    """Running totals per zone and service."""
    return ingest.add_stats(read_table(spark, root, "connection_stats"))


def stream_checkins(spark, path, root, checkpoint, trigger=None, files_per_trigger=None):
    """Agent check-ins to the agents table and host observations."""
    def tables(good):
        agents, observations = ingest.ingest_checkins(good)
        return {"agents": agents, "asset_observations": observations}

    return _log_job(spark, path, "checkins", None, tables, root, checkpoint, trigger,
                    files_per_trigger)


def stream_agent_batches(spark, path, root, checkpoint, trigger=None, files_per_trigger=None):
    """Agent reports to the alerts table and the agents' connection counts."""
    def tables(good):
        alerts, increments = ingest.ingest_agent_batches(good)
        return {"alerts": alerts, "agent_connection_stats": increments}

    return _log_job(spark, path, "agent_batches", None, tables, root, checkpoint, trigger,
                    files_per_trigger)


def stream_increments(conn, path, checkpoint, watermark="10 minutes", trigger=None):
    """Per-agent counts of each closed report interval, appended as Parquet.

    ``conn`` is a stream with agent_id, event_time and resp_p.
    """
    closed = ingest.agent_increments(conn.withWatermark("event_time", watermark))
    return (
        to_table(closed, "agent_connection_stats").writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def stream_late_increments(conn, root, checkpoint, delay=600, trigger=None):
    """Per-agent counts of report intervals, rows of any age included.

    Every micro-batch appends its own counts to ``agent_connection_stats``; ``read_increments``
    sums them, so a row counts in its interval however late it comes and nothing waits in state.
    Rows whose interval had ended ``delay`` seconds before the latest time that earlier batches
    have seen are kept under ``late_connections`` as well: counts of their intervals that were
    read before have changed. ``conn`` is a stream with agent_id, event_time and resp_p.
    """
    spark = conn.sparkSession
    seen_path = f"{root}/{SEEN}"

    def each_batch(batch, batch_id):
        run = producer(spark, checkpoint)
        seen = stored_files(spark, f"{seen_path}/{run}", "until double, batch bigint").where(
            F.col("batch") < batch_id).agg(F.max("until")).first()[0]
        batch = batch.persist()  # read once for the counts, the late rows and the latest time
        try:
            append_once(ingest.agent_increments(batch), root, "agent_connection_stats",
                        batch_id, run)
            end = F.window("event_time", f"{ingest.REPORT_SECONDS} seconds")["end"]
            late = batch.where(F.unix_micros(end) <= (
                -1 if seen is None else int((seen - delay) * 1e6)))
            late.write.mode("overwrite").parquet(f"{root}/{LATE}/part={run}.{batch_id}")
            batch.agg((F.unix_micros(F.max("event_time")) / 1e6).alias("until")).write.mode(
                "overwrite").parquet(f"{seen_path}/{run}/batch={batch_id}")
        finally:
            batch.unpersist()

    return start_batches(conn, each_batch, checkpoint, trigger)


def read_increments(spark, root):
    """Counts per agent, zone, service and report interval."""
    rows = read_table(spark, root, "agent_connection_stats")
    return rows.groupBy("agent_id", "zone", "service", "ts").agg(F.sum("count").alias("count"))


def stream_matches(new_rows, all_rows, root, reference, match, table, checkpoint,
                   trigger=None, clock=time.time):
    """Match new rows as they come, and all rows again when the reference was replaced.

    ``new_rows`` is a stream of software or alerts, ``all_rows()`` reads the stored table,
    ``reference`` names the replaced reference table under ``root``, and
    ``match(rows, reference_rows)`` gives the match rows. Keys that are stored already are
    left out, so replays and full passes add nothing twice.
    """
    spark = new_rows.sparkSession
    done = f"{root}/{table}_{COMMITS}"

    def each_batch(batch, batch_id):
        version = current_version(spark, root, reference)
        fresh = version != _last_matched(spark, done)
        rows = all_rows() if fresh else batch
        with scratch(spark):
            append_new(match(rows, read_snapshot(spark, root, reference)), root, table)
        if fresh:
            spark.createDataFrame([(version, float(clock()))], COMMIT_SCHEMA).coalesce(
                1).write.mode("append").parquet(done)

    return start_batches(new_rows, each_batch, checkpoint, trigger or {"processingTime": "30 seconds"})


def _last_matched(spark, path):
    commits = stored_files(spark, path, COMMIT_SCHEMA)
    return commits.agg(F.max_by("version", "committed").alias("v")).first()["v"]


def software_matcher(cves, encoder, run_ts):
    """``match`` for software: ``cves`` is the raw list behind the reference, or a function
    that reads it, which a running job calls for every micro-batch."""
    def match(rows, reference):
        listed = cves() if callable(cves) else cves
        return correlate.match_software(rows, listed, reference, encoder, run_ts)
    return match


def technique_matcher(encoder, run_ts):
    def match(rows, reference):
        return correlate.match_techniques(rows, reference, encoder, run_ts)
    return match
