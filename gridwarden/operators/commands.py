"""Analyst requests: check, derive the rows to append, return (accepted, rejected)."""

from pyspark.sql import functions as F, Window as Wnd

from gridwarden.functions import constants as K
from gridwarden.functions.addresses import canonical_ip, is_ip
from gridwarden.functions.alerts import content_id
from gridwarden.functions.times import epoch_micros


def _split(checked):
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def _in(col, values):
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def _decide(requests, decide):
    """Add enforcement_status and enforcement_detail."""
    status, detail = decide
    return requests.withColumns({"enforcement_status": status, "enforcement_detail": detail})


def alert_decision():
    """What is recorded for an alert action; nothing is enforced."""
    hosts = [F.coalesce(c, F.lit("")) for c in ("src_h", "dst_h")]
    status = F.when(F.col("action") == "block", "stubbed").otherwise("not_applicable")
    detail = (
        F.when(F.col("action") == "block", F.format_string(K.BLOCK_DETAIL, *hosts))
        .when(F.col("action") == "allow", F.format_string(K.ALLOW_DETAIL, *hosts))
        .otherwise(K.INVESTIGATE_DETAIL)
    )
    return status, detail


def policy_decision():
    ip = F.col("ip")
    status = F.when(_in("policy", K.GUARDED_POLICIES), "stubbed").otherwise("not_applicable")
    detail = (
        F.when(F.col("policy") == "blacklist", F.format_string(K.BLACKLIST_DETAIL, ip))
        .when(F.col("policy") == "quarantine", F.format_string(K.QUARANTINE_DETAIL, ip))
        .when(F.col("policy") == "whitelist", F.format_string(K.WHITELIST_DETAIL, ip))
        .otherwise(F.format_string(K.CLEARED_DETAIL, ip))
    )
    return status, detail


def apply_alert_actions(requests, decide=None):
    """Decisions on alerts. ``decide`` may be a DataFrame -> DataFrame function that adds
    the two enforcement columns instead of the built-in texts."""
    error = F.when(~_in("action", K.ALERT_ACTIONS), K.INVALID_ACTION)
    accepted, rejected = _split(requests.withColumn("error", error))
    decided = decide(accepted) if decide else _decide(accepted, alert_decision())
    return decided.select(
        content_id(F.col("alert_id"), F.col("action"), epoch_micros(F.col("ts"))).alias("id"),
        "alert_id", "action", "actor", F.coalesce("notes", F.lit("")).alias("notes"),
        "enforcement_status", "enforcement_detail", "ts",
    ), rejected


def add_assets(requests):
    """(observations, admin rows, rejected) of hosts added by hand, each address in one spelling."""
    ip = F.btrim("ip", F.lit(" \t\n\r\x0b\x0c"))
    checked = requests.withColumn("ip", ip).fillna(
        {"zone": "IT", "owner": "", "criticality": "", "tags": "", "notes": ""},
    ).withColumn("error", (
        F.when(~is_ip(F.col("ip")), K.INVALID_IP)
        .when(~_in("zone", K.ZONES), K.INVALID_ZONE)
        .when(~_in("criticality", K.CRITICALITIES), K.INVALID_CRITICALITY)
    ))
    accepted, rejected = _split(checked)
    accepted = accepted.withColumn("ip", canonical_ip(F.col("ip")))
    observations = accepted.select(
        "ip", "zone", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    admin = accepted.select("ip", "owner", "criticality", "tags", "notes", "actor", "ts")
    return observations, admin, rejected


def edit_assets(requests):
    """Admin rows of asset edits; any value is accepted."""
    blank = {"owner": "", "criticality": "", "tags": "", "notes": ""}
    return requests.fillna(blank).select(
        "ip", "owner", "criticality", "tags", "notes", "actor", "ts")


def criticality_as_of(requests, admin):
    """Requests with the host's criticality in force at their time, or NULL.

    An as-of join on narrow keys: the distinct hosts and times that are asked for and the
    edits of a host are put in one sequence, each time takes the last edit up to it, and the
    requests themselves meet only the answers. The sequence is cut into days and only the
    last edit of each day is carried on, so a host with very many rows is spread over its
    days. Edits or requests without a host or a time meet nothing.
    """
    day = F.floor(F.col("ts") / 86400).alias("day")
    text = ["owner", "criticality", "tags", "notes"]
    edits = admin.where("ip IS NOT NULL AND ts IS NOT NULL").select("ip", "ts", *text, day)
    asked = requests.where("ip IS NOT NULL AND ts IS NOT NULL").select("ip", "ts").distinct()
    asked = asked.select("ip", "ts", day)

    in_force = F.coalesce("criticality", F.lit(""))
    both = edits.withColumn("in_force", in_force).unionByName(
        asked.withColumn("asked", F.lit(1)), allowMissingColumns=True)
    # Of edits at one time the one with the greatest texts is in force, as in a maximum of them.
    order = Wnd.partitionBy("ip", "day").orderBy("ts", F.asc_nulls_first("asked"), *text)
    within = both.withColumn("in_day", F.last("in_force", ignorenulls=True).over(
        order.rowsBetween(Wnd.unboundedPreceding, Wnd.currentRow))).where(
        "asked = 1").select("ip", "day", "ts", "in_day")

    # One row per day with an edit, and one per day asked for, which comes before its edit.
    last_of_day = edits.groupBy("ip", "day").agg(
        F.max(F.struct("ts", *text)).alias("e")).select(
        "ip", "day", F.coalesce("e.criticality", F.lit("")).alias("carried"))
    days = last_of_day.unionByName(
        asked.select("ip", "day").distinct(), allowMissingColumns=True)
    before = Wnd.partitionBy("ip").orderBy("day", F.asc_nulls_first("carried")).rowsBetween(
        Wnd.unboundedPreceding, Wnd.currentRow)
    carried = days.select("ip", "day", "carried", F.last("carried", ignorenulls=True).over(
        before).alias("before")).where("carried IS NULL").select("ip", "day", "before")
    answers = within.join(carried, ["ip", "day"], "left").select(
        F.col("ip").alias("_ip"), F.col("ts").alias("_ts"),
        F.coalesce("in_day", "before").alias("host_criticality"))
    return requests.join(
        answers, [F.col("ip") == F.col("_ip"), F.col("ts") == F.col("_ts")], "left").drop(
        "_ip", "_ts")


def judged_ip_policies(requests, admin):
    """Requests with ``error``, the reason why a host policy is refused, or NULL.

    Only requests that a critical host would refuse are looked up among the edits: others
    stay where they are.
    """
    valid = _in("policy", K.POLICIES)
    guarded = _in("policy", K.GUARDED_POLICIES) & ~F.coalesce(
        F.col("confirm_critical"), F.lit(False))
    free = requests.where(~guarded).withColumn("error", F.when(~valid, K.INVALID_POLICY))
    looked_up = criticality_as_of(requests.where(guarded), admin).withColumn("error", F.when(
        F.col("host_criticality") == "critical",
        F.format_string(K.CRITICAL_HOST, F.col("ip")))).drop("host_criticality")
    return free.unionByName(looked_up)


def apply_ip_policies(requests, admin, decide=None):
    """Host policies; a critical host needs ``confirm_critical`` to be cut off.

    Criticality is the one in force at the request's time. Each of the two results looks the
    edits up by itself; who needs both of many requests stores ``judged_ip_policies`` first
    and passes it to ``split_ip_policies``.
    """
    return split_ip_policies(judged_ip_policies(requests, admin), decide)


def split_ip_policies(judged, decide=None):
    """(rows to append, rejected requests) of judged requests."""
    accepted, rejected = _split(judged)
    decided = decide(accepted) if decide else _decide(accepted, policy_decision())
    return decided.select(
        content_id(F.col("ip"), F.col("policy"), epoch_micros(F.col("ts"))).alias("id"),
        "ip", "policy", "actor", F.coalesce("notes", F.lit("")).alias("notes"),
        "enforcement_status", "enforcement_detail", "ts",
    ), rejected
