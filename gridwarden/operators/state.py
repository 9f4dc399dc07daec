"""Current state from append-only logs, and the joins built on it."""

from pyspark.sql import functions as F

from gridwarden.functions.alerts import age_label, agent_status, status_label
from gridwarden.functions.constants import ALERT_NOT_FOUND


def latest_by(df, key, ts, cols, ties=()):
    """The newest row per key, as one struct so that its columns stay together.

    An aggregate over structs, which Spark sorts by key in each task: one row per key and task is
    shuffled, so a key that holds most of the log costs no more than any other. Logs that are
    asked often keep their newest rows, see ``sinks.refresh_latest``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = F.max_by(F.struct(*cols), F.struct(ts, *ties, *cols))
    return df.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def collapse_assets(observations):
    """One row per host: OT when ever seen as OT, first and last time seen."""
    return observations.groupBy("ip").agg(
        F.when(F.count_if(F.col("zone") == "OT") > 0, "OT").otherwise("IT").alias("zone"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def latest_admin(admin):
    return latest_by(admin, "ip", "ts", ["owner", "criticality", "tags", "notes"])


def latest_policy(policies):
    return latest_by(policies, "ip", "ts", ["policy", "enforcement_status"], ties=["id"])


def latest_agent_host(agents):
    return latest_by(agents, "ip", "last_checkin", ["hostname"], ties=["agent_id"]).select(
        "ip", F.col("hostname").alias("agent_hostname"))


def latest_action(actions):
    return latest_by(
        actions, "alert_id", "ts", ["action", "actor", "notes", "enforcement_status"],
        ties=["id"])


def asset_inventory(observations, admin, policies, agents):
    """Hosts with their current owner, criticality, policy and agent."""
    rows = (
        collapse_assets(observations)
        .join(latest_admin(admin), "ip", "left")
        .join(latest_policy(policies), "ip", "left")
        .join(latest_agent_host(agents), "ip", "left")
    )
    blank = ["owner", "criticality", "tags", "notes", "enforcement_status", "agent_hostname"]
    return rows.fillna({"policy": "none", **{c: "" for c in blank}}).select(
        "ip", "zone", "first_seen", "last_seen", "owner", "criticality", "tags", "notes",
        "policy", "enforcement_status", "agent_hostname",
    )


def newest_first(df, ts="ts", tie="id", limit=None):
    rows = df.orderBy(F.desc_nulls_last(ts), F.asc(tie))
    return rows if limit is None else rows.limit(limit)


def alerts_with_status(alerts, actions, limit=100):
    """Newest alerts with the analysts' latest decision on each.

    The limit is taken before the join: a left join on a unique key neither drops
    nor repeats alerts, so only ``limit`` of them meet the decisions.
    """
    newest = alerts if limit is None else newest_first(alerts, limit=limit)
    decided = latest_action(actions).select(
        F.col("alert_id").alias("id"), F.col("action").alias("status"),
        F.col("actor").alias("last_actor"), F.col("notes").alias("last_notes"))
    rows = newest.join(decided, "id", "left").fillna(
        {"status": "open", "last_actor": "", "last_notes": ""})
    return rows if limit is None else newest_first(rows)


def dashboard_alerts(alerts, actions):
    """Every alert with decision columns and the status label."""
    blank = ["action", "actor", "notes", "enforcement_status"]
    decided = latest_action(actions).withColumnRenamed("alert_id", "id")
    rows = alerts.join(decided, "id", "left").fillna({c: "" for c in blank})
    return rows.withColumn("status", status_label(F.col("action")))


def recent_actions(actions, alerts, now, n=10, message_chars=None):
    """The last ``n`` decisions with the alert's message and the decision's age.

    Messages are whole unless the caller asks for their first ``message_chars``.
    """
    last = newest_first(actions, limit=n).select("id", "alert_id", "action", "actor", "notes", "ts")
    # n ids at most: the scan of alerts is filtered by a broadcast of known size.
    wanted = F.broadcast(last.select("alert_id").distinct())
    found = (
        alerts.join(wanted, alerts["id"] == wanted["alert_id"], "left_semi")
        .groupBy(F.col("id").alias("alert_id"))
        .agg(F.max_by("message", F.struct("ts", "message")).alias("message"))
    )
    message = F.coalesce("message", F.lit(ALERT_NOT_FOUND))
    if message_chars is not None:
        message = F.substring(message, 1, message_chars)
    return newest_first(last.join(found, "alert_id", "left").select(
        "id", "alert_id", "action", "actor", "notes", "ts", message.alias("message"),
        age_label(F.col("ts"), now).alias("age"),
    ))


def agent_roster(agents):
    """Agents with their newest details, first and last check-in."""
    details = ["hostname", "ip", "os", "agent_group", "version"]
    newest = F.max_by(F.struct(*details), F.struct("last_checkin", *details))
    return agents.groupBy("agent_id").agg(
        newest.alias("r"),
        F.max("last_checkin").alias("last_checkin"),
        F.min("last_checkin").alias("first_checkin"),
    ).select("agent_id", "r.*", "last_checkin", "first_checkin")


def agent_breakdown(roster, now, top=5):
    """Agents by status, and the most common systems and groups."""
    def counted(kind, label, limit=None):
        rows = roster.groupBy(label.alias("label")).agg(F.count("*").alias("count"))
        if limit:
            rows = rows.orderBy(F.desc("count"), "label").limit(limit)
        return rows.select(F.lit(kind).alias("kind"), "label", "count")

    def named(c, default):
        return F.when(F.col(c) != "", F.col(c)).otherwise(default)

    return (
        counted("status", agent_status(F.col("last_checkin"), now))
        .unionByName(counted("os", named("os", "unknown"), top))
        .unionByName(counted("group", named("agent_group", "default"), top))
    )


#: Key and order of the logs whose newest rows are kept.
LOGS = {
    "alert_actions": ("alert_id", "ts", ("id",)), "ip_policies": ("ip", "ts", ("id",)),
    "asset_admin": ("ip", "ts", ()),
}


def newest_rows(log, table):
    """The whole newest row per key of a log; of the rows that two sets of newest rows hold it
    gives the same as of all rows behind them."""
    key, ts, ties = LOGS[table]
    # the order that the state's own functions use: time, ties, then the other columns
    cols = [c for c in log.columns if c not in (key, ts, *ties)]
    order = {"asset_admin": ["owner", "criticality", "tags", "notes", "actor"]}.get(table, cols)
    newest = F.max_by(F.struct(*log.columns), F.struct(ts, *ties, *order))
    return log.groupBy(key).agg(newest.alias("r")).select("r.*")


def seen_keys(matches):
    return matches.select("source_key").distinct()
