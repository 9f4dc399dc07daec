"""Counts, trends, top lists, search and paging over alerts and matches."""

import math

from pyspark.sql import functions as F, Window as W

from gridwarden.functions.alerts import extract_protocol, text_matches
from gridwarden.functions.times import epoch_micros
from gridwarden.session import materialize


def kpis(alerts, cve_matches, technique_matches):
    """One row of totals; each input is reduced to one row before they meet."""
    names = ["alerts", "high_alerts", "cve_matches", "technique_matches"]
    parts = [
        alerts.agg(
            F.count("*").alias("alerts"),
            F.count_if(F.col("severity") == "high").alias("high_alerts")),
        cve_matches.agg(F.count("*").alias("cve_matches")),
        technique_matches.agg(F.count("*").alias("technique_matches")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in names])


def severity_split(alerts):
    counts = alerts.where(F.col("severity").isNotNull()).groupBy("severity").agg(
        F.count("*").alias("count"))
    total = F.sum("count").over(W.partitionBy())  # a handful of severities
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 2))


def traffic_by_zone(stats):
    return stats.groupBy("zone").agg(F.sum("count").alias("count"))


def alerts_by_zone(alerts):
    """Stands in for traffic by zone when there are no connection counts."""
    return alerts.where(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.count("*").alias("count"))


def traffic_by_service(stats):
    return stats.groupBy(F.col("service").alias("protocol")).agg(F.sum("count").alias("count"))


def alerts_by_protocol(alerts):
    """Stands in for traffic by service. Messages are mostly unique, so the words are
    matched row by row inside the scan and only the few protocol names are shuffled."""
    protocol = extract_protocol(F.col("note_type"), F.col("message"))
    return alerts.groupBy(protocol.alias("protocol")).agg(F.count("*").alias("count"))


def traffic_by_service_zone(stats):
    return stats.groupBy("service", "zone").agg(F.sum("count").alias("count"))


def traffic_total(stats):
    return stats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("connections"))


def tactic_counts(matches):
    return matches.where(F.col("tactic").isNotNull()).groupBy("tactic").agg(
        F.count("*").alias("count"))


def alert_trend(alerts):
    """Alerts per minute from the first to the last, with 0 for empty minutes."""
    counts = alerts.select(
        F.floor(epoch_micros(F.col("ts")) / 60_000_000).alias("at"),
    ).where("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("n"))
    # The span comes from the grouped counts, not from a second look at the alerts.
    # Days first, then minutes, so that no single row holds a long sequence.
    span = counts.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo IS NOT NULL")
    days = span.select("lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / 1440), F.floor(F.col("hi") / 1440))).alias("day"))
    every = days.select(F.explode(F.sequence(
        F.greatest("lo", F.col("day") * 1440), F.least("hi", F.col("day") * 1440 + 1439),
    )).alias("at"))
    return every.join(counts, "at", "left").select(
        F.timestamp_seconds(F.col("at") * 60).alias("minute"),
        F.coalesce("n", F.lit(0)).alias("count"))


def cvss_histogram(matches, bins=10):
    """Counts in equal bins over 0 to 10; 10 itself belongs to the last bin."""
    width = 10.0 / bins
    score = F.col("cvss_score").cast("double")
    bin_no = F.least(F.floor(score / width), F.lit(bins - 1))
    return matches.where(score.isNotNull() & ~F.isnan(score)).groupBy(
        bin_no.cast("int").alias("bin")).agg(F.count("*").alias("count")).select(
        "bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"),
        "count")


def top_n(df, col, n):
    """The ``n`` most frequent values; equal counts go by value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count("*").alias("count")).orderBy(F.desc("count"), col).limit(n)


def filter_alerts(alerts, severities, statuses):
    return alerts.where(F.col("severity").isin(*severities) & F.col("status").isin(*statuses))


def search_alerts(alerts, pattern, regex=True):
    """Alerts whose message, type or hosts hold the pattern, in any letter case."""
    if not pattern:
        return alerts
    cols = [F.col(c) for c in ("message", "note_type", "src_h", "dst_h")]
    return alerts.where(text_matches(pattern, *cols, regex=regex))


def page_count(total, size):
    return max(1, math.ceil(total / size))


def page(alerts, number, size, total=None):
    """One page of alerts, newest first; a page past the end is the last one.

    Each task keeps the rows up to the end of the page, so this is for the first pages, which
    it takes out of one pass. ``indexed_page`` serves pages of any depth.
    """
    total = alerts.count() if total is None else total
    skip = min(number, page_count(total, size) - 1) * size
    return alerts.orderBy(F.desc_nulls_last("ts"), "id").offset(skip).limit(size)


def page_index(alerts):
    """(rows, parts): the alerts in the order of the pages, newest first, for any number of pages.

    The rows are dealt to tasks by ranges of the order, sorted there and written to the shared
    folder with the number of their part and their place in it; parts lists the rows of each
    part, one entry per task. A rank is the rows of the parts before and the place.
    """
    order = [F.desc_nulls_last("ts"), F.asc("id")]
    placed = alerts.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_part": F.spark_partition_id(),
        "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    stored = materialize(placed, "page-index")
    counts = stored.groupBy("_part").agg(F.count("*").alias("n")).collect()
    return stored, sorted((r["_part"], r["n"]) for r in counts)


def indexed_page(index, number, size):
    """The same page out of the alerts' ``page_index``; its cost does not grow with depth.

    The ranks of the page name places in one or a few parts, the only ones that are read.
    Pages of one index neither overlap nor leave rows out, repeated rows included.
    """
    rows, parts = index
    skip = min(number, page_count(sum(n for _, n in parts), size) - 1) * size
    on_page, before = F.lit(False), 0
    for part, n in parts:
        if before < skip + size and before + n > skip:
            on_page = on_page | ((F.col("_part") == part) & F.col("_place").between(
                skip - before, skip + size - before - 1))
        before += n
    return rows.where(on_page).orderBy("_part", "_place").drop("_part", "_place")


def page_after(alerts, ts, row_id, size):
    """The page that follows the row (``ts``, ``row_id``); its cost does not grow with depth.

    Rows without a time come last, by id; ``ts`` is None for a row of theirs. Without a
    ``size`` all rows that follow are given.
    """
    after = F.col("id") > F.lit(row_id)
    if ts is None:
        later = F.col("ts").isNull() & after
    else:
        later = (F.col("ts") < F.lit(ts)) | F.col("ts").isNull() | (
            (F.col("ts") == F.lit(ts)) & after)
    rows = alerts.where(later).orderBy(F.desc_nulls_last("ts"), "id")
    return rows if size is None else rows.limit(size)


def by_score(matches, score, tie="source_key"):
    return matches.orderBy(F.desc_nulls_last(score), tie)
