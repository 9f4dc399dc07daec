"""Detections over log tables: port scans, control writes, payload signatures."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, Window as W

from gridwarden import schemas
from gridwarden.functions import constants as K
from gridwarden.functions.alerts import notice_severity, row_id
from gridwarden.functions.times import epoch_micros
from gridwarden.functions.zones import agent_zone, guess_service, zone
from gridwarden.session import materialize

MICROS = 1_000_000


# -- port scans ---------------------------------------------------------------------
#
# A source's window opens at its first event and closes when an event comes more than
# `seconds` later; that event opens the next one. Where windows begin therefore depends
# on all earlier events of the source, which rules out window() + count(distinct).
# To keep a busy source out of a single task:
#   1. time is cut into buckets of the window's length; a source with an empty bucket
#      starts afresh after it, so runs of non-empty buckets are independent;
#   2. runs in which no two neighbouring buckets hold enough ports are left out whole;
#   3. window starts of a long run are found chunk by chunk in parallel (`_starts`);
#   4. windows meet events on (source, bucket), and the ports are counted by partial
#      aggregation.

def detect_scans(conn, threshold=K.SCAN_PORTS, seconds=K.SCAN_SECONDS, refire=False,
                 chunk_windows=60):
    """Sources that touch ``threshold`` distinct ports within one window.

    ``refire=False`` is the agents' rule: one alert per window, raised by the event that
    brings the last port. ``refire=True`` is the sensor's rule: ports differ by protocol,
    and every event raises a notice while the set has exactly ``threshold`` members.
    """
    width = seconds * MICROS
    port_key = ["port", "proto"] if refire else ["port"]
    events = conn.select(
        F.col("orig_h").alias("src"), F.col("resp_h").alias("dst"),
        F.col("resp_p").alias("port"), "proto", epoch_micros(F.col("ts")).alias("us"),
    ).where("src IS NOT NULL AND us IS NOT NULL").withColumn("bucket", _floor("us", width))

    # Written once: it is small, and both passes below begin with it.
    runs = materialize(_busy_runs(events, port_key, threshold), "scan-runs")
    busy = events.join(runs, ["src", "bucket"])
    starts = _starts(busy, width, chunk_windows)
    spans = starts.withColumn("bucket", F.explode(F.array_distinct(F.array(
        _floor("start", width), _floor_of(F.col("start") + width, width)))))
    in_window = busy.drop("run", "last_bucket").join(spans, ["src", "bucket"]).where(
        F.col("us").between(F.col("start"), F.col("start") + width))

    # The first event of each port; at most one row per port and window goes on. Only the
    # agents' alert names the other host, so only there is it carried along.
    first = F.min("us").alias("us") if refire else F.min(F.struct("us", "dst")).alias("first")
    firsts = in_window.groupBy("src", "start", *port_key).agg(first)
    if not refire:
        firsts = firsts.select("src", "start", *port_key, "first.*")
    order = W.partitionBy("src", "start").orderBy("us", *port_key)
    ranked = firsts.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= threshold + 1)
    if not refire:
        return _scan_rows(
            ranked.where(F.col("rank") == threshold), threshold, K.SCAN_MESSAGE_AGENT, agent=True)

    at = F.struct("us", *port_key)
    edges = ranked.groupBy("src", "start").agg(
        F.max(F.when(F.col("rank") == threshold, at)).alias("since"),
        F.max(F.when(F.col("rank") == threshold + 1, at)).alias("until"),
    ).where("since IS NOT NULL")
    here = F.struct("us", *port_key)
    firing = in_window.join(edges, ["src", "start"]).where(
        (here >= F.col("since")) & (F.col("until").isNull() | (here < F.col("until"))))
    return _scan_rows(firing, threshold, K.SCAN_MESSAGE_SENSOR, agent=False)


def _floor_of(us, width):
    return ((us - F.pmod(us, F.lit(width))) / width).cast("bigint")


def _floor(name, width):
    return _floor_of(F.col(name), width)


def _busy_runs(events, port_key, threshold):
    """(src, bucket, run, last_bucket) of the runs that could hold a full window.

    One row per source and bucket is left before the windows over a source.
    """
    counts = events.select("src", "bucket", *port_key).distinct().groupBy("src", "bucket").agg(
        F.count("*").alias("ports"))
    by_bucket = W.partitionBy("src").orderBy("bucket")
    gap = F.col("bucket") - F.lag("bucket").over(by_bucket)
    adjacent = F.when(gap == 1, F.lag("ports").over(by_bucket)).otherwise(0)
    linked = counts.select(
        "src", "bucket",
        F.when(gap == 1, 0).otherwise(1).alias("opens"),
        (F.col("ports") + adjacent >= threshold).alias("full"))
    so_far = by_bucket.rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = linked.withColumn("run", F.sum("opens").over(so_far))
    whole = W.partitionBy("src", "run")
    return runs.select(
        "src", "bucket", "run",
        F.max("full").over(whole).alias("full"),
        F.max("bucket").over(whole).alias("last_bucket"),
    ).where("full").drop("full")


def _starts(busy, width, chunk_windows):
    """(src, start) of every window of the busy runs.

    A run is cut into chunks. Which window is open when a chunk begins is not known yet,
    but it can only end within one window length, so a chunk has few possible first
    starts: each chunk lists where every one of them leads (`_chunk_exits`), a pass over
    those short lists picks the true one (`_entries`), and the chunks are then walked in
    parallel (`_walk`).
    """
    chunk_us = width * chunk_windows
    times = materialize(busy.select(
        "src", "run", "us", _floor("us", chunk_us).alias("chunk"),
        (_floor_of(F.col("last_bucket") * width, chunk_us)).alias("last_chunk"),
    ).distinct(), "scan-times")
    key = ["src", "run", "chunk"]
    # Only chunks with a later chunk in the same run have anything to hand on.
    exits = times.where("chunk < last_chunk").groupBy(*key).applyInArrow(
        lambda t: _chunk_exits(t, width, chunk_us),
        "src string, run bigint, chunk bigint, cand bigint, exit bigint")
    entries = exits.repartition("src", "run").sortWithinPartitions(*key, "cand").mapInPandas(
        lambda batches: _entries(batches, width),
        "src string, run bigint, chunk bigint, after bigint")
    return times.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(
        lambda t, e: _walk(t, e, width), "src string, start bigint")


def _sorted_times(table):
    return np.sort(table.column("us").to_numpy())


def _chunk_exits(table, width, chunk_us):
    times = _sorted_times(table)
    lo = table.column("chunk")[0].as_py() * chunk_us
    n_cand = min(np.searchsorted(times, lo + width, "left") + 1, len(times))
    cand = times[:n_cand]
    at = np.arange(n_cand)
    while True:
        after = np.searchsorted(times, times[at] + width, "right")
        going = after < len(times)
        if not going.any():
            break
        at = np.where(going, after, at)
    last = times[at]
    keep = np.append(last[1:] != last[:-1], True)  # one row per distinct exit
    cand, last = cand[keep], last[keep]
    keys = {k: pa.repeat(table.column(k)[0], len(cand)) for k in ("src", "run", "chunk")}
    return pa.table({**keys, "cand": cand, "exit": last})


def _entries(batches, width):
    """For each chunk but a run's first: the time after which its first window starts."""
    columns = ["src", "run", "chunk", "after"]
    run = chunk = after = None  # `after` is the end of the last window known so far
    found = False               # whether this chunk's first start has been met
    for pdf in batches:
        out = []
        for src, run_no, chunk_no, cand, last in pdf.itertuples(index=False, name=None):
            if (src, run_no) != run or chunk_no != chunk:
                if chunk is not None:
                    out.append((*run, chunk + 1, after))
                if (src, run_no) != run:
                    after = None
                run, chunk, found = (src, run_no), chunk_no, False
            if not found and (after is None or cand > after):
                after, found = last + width, True
        if out:
            yield pd.DataFrame(out, columns=columns)
    if chunk is not None:
        yield pd.DataFrame([(*run, chunk + 1, after)], columns=columns)


def _walk(times_table, entry_table, width):
    if times_table.num_rows == 0:
        return pa.table({"src": pa.array([], pa.string()), "start": pa.array([], pa.int64())})
    times = _sorted_times(times_table)
    at = 0
    if entry_table.num_rows:
        at = np.searchsorted(times, entry_table.column("after")[0].as_py(), "right")
    starts = []
    while at < len(times):
        starts.append(times[at])
        at = np.searchsorted(times, times[at] + width, "right")
    return pa.table({
        "src": pa.repeat(times_table.column("src")[0], len(starts)),
        "start": pa.array(starts, pa.int64()),
    })


def _scan_rows(hits, threshold, message, agent):
    if agent:
        dst, where = F.col("dst"), agent_zone(guess_service(F.col("port")), F.col("port"))
    else:  # the sensor's notice names the source only
        dst, where = F.lit(""), zone(F.lit(""), F.lit(0))
    return hits.select(
        (F.col("us") / MICROS).alias("ts"),
        F.lit(K.SCAN_NOTE).alias("note_type"),
        F.format_string(message, F.col("src"), F.lit(threshold)).alias("message"),
        F.col("src").alias("src_h"), dst.alias("dst_h"),
        F.lit("medium").alias("severity"), where.alias("zone"),
        (F.col("start") / MICROS).alias("window_start"),
    )


# -- control writes and signatures --------------------------------------------------

def detect_modbus_writes(modbus, allowed=None):
    """Every single-coil write request; ``allowed`` (orig_h) exempts some originators."""
    writes = modbus.where((F.col("func") == "WRITE_SINGLE_COIL") & F.col("is_request"))
    if allowed is not None:
        writes = writes.join(allowed.select("orig_h").distinct(), "orig_h", "left_anti")
    return writes.select(
        "ts", F.lit(K.MODBUS_NOTE).alias("note_type"),
        F.format_string(
            K.MODBUS_MESSAGE, F.col("orig_h"), F.col("resp_h"), F.col("address"),
        ).alias("message"),
        F.col("orig_h").alias("src_h"), F.col("resp_h").alias("dst_h"),
        F.lit("").alias("service"), F.lit(502).alias("port"),
    )


def signature_rules(spark):
    """The built-in rules as a DataFrame."""
    return spark.createDataFrame(list(K.SIGNATURE_RULES), schemas.SIGNATURE_RULES)


def _search_form(pattern):
    """The pattern without a leading '.*', which a search does not need.

    Java would otherwise try it again from every position of a long line.
    """
    bare = pattern.startswith(".*") and pattern[2:3] not in ("?", "+", "{")
    return "(?d)" + (pattern[2:] if bare else pattern)


#: Parts that the records of one protocol and port are dealt to; each meets all its rules.
RULE_SALTS = 32


def match_signatures(records, rules=K.SIGNATURE_RULES):
    """Records whose payload or request matches a rule for their protocol and port.

    ``rules`` is a list of tuples or a DataFrame. A list becomes one constant pattern per
    rule inside the scan, without a join; a DataFrame is joined on protocol, port and a salt,
    so that a port that holds most records is spread out.
    A rule's pattern is searched for anywhere unless it is anchored.
    """
    if isinstance(rules, (list, tuple)):
        hits = [
            F.when(
                (F.col("proto") == proto) & (F.col("dst_port") == port)
                & F.col(field).rlike(_search_form(pattern)),
                F.struct(F.lit(rule).alias("rule"), F.lit(event).alias("event")))
            for rule, proto, port, field, pattern, event in rules
        ]
        found = records.withColumn("hit", F.explode(F.filter(
            F.array(*hits), lambda h: h.isNotNull()))).withColumns(
            {"rule": F.col("hit.rule"), "event": F.col("hit.event")})
    else:
        salt = F.pmod(F.xxhash64("ts", "src_h", "dst_h"), F.lit(RULE_SALTS)).cast("int")
        spread = rules.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1))))
        met = records.withColumn("_salt", salt).join(spread, ["proto", "dst_port", "_salt"])
        found = met.where(F.expr(
            "CASE field WHEN 'payload' THEN payload WHEN 'http_request' THEN http_request END "
            r"RLIKE concat('(?d)', regexp_replace(pattern, r'^\.\*(?![?+{])', ''))"))
    return found.select(
        "ts", "rule", F.lit(K.SIGNATURE_NOTE).alias("note_type"),
        F.concat(F.col("src_h"), F.lit(": "), F.col("event")).alias("message"),
        "src_h", "dst_h", F.lit("").alias("service"), F.col("dst_port").alias("port"),
    )


def to_alerts(detections, source):
    """Detections as alert rows; severity and zone are derived where not set."""
    have = detections.columns
    severity = F.col("severity") if "severity" in have else notice_severity(F.col("note_type"))
    where = F.col("zone") if "zone" in have else zone(F.col("service"), F.col("port"))
    rows = detections.select(
        "ts", "note_type", "message", "src_h", "dst_h", severity.alias("severity"),
        where.alias("zone"), F.lit(source).alias("source"))
    return rows.select(row_id(rows).alias("id"), "*")
