"""Alert and match text: severity, protocol, labels, ids."""

from pyspark.sql import functions as F

from gridwarden.functions.constants import (
    AGENT_TIMEOUT_SECONDS, PORT_SCAN_WORDS, PROTOCOL_KEYWORDS, STATUS_LABELS,
)
from gridwarden.functions.times import epoch_micros


def content_id(*cols):
    """24 hex digits that depend only on the given values; NULL counts as ''."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def row_id(df):
    """Id of a row's whole content; its time counts in microseconds."""
    return content_id(*[epoch_micros(F.col(c)) if c == "ts" else F.col(c) for c in df.columns])


def notice_severity(note):
    hot = note.contains("Unauthorized") | note.contains("Sensitive")
    return F.when(hot, "high").otherwise("medium")


def is_severe(severity):
    return F.lower(severity).isin("high", "critical")


def extract_protocol(note_type, message):
    """First keyword, in list order, found anywhere in the alert's text."""
    text = F.lower(F.concat(
        F.coalesce(note_type, F.lit("")), F.lit(" "), F.coalesce(message, F.lit(""))))
    tests = [(F.contains(text, F.lit(word.lower())), word) for word in PROTOCOL_KEYWORDS]
    tests += [(F.contains(text, F.lit(word)), "Port Scan") for word in PORT_SCAN_WORDS]
    (test, label), *rest = tests
    found = F.when(test, label)
    for test, label in rest:
        found = found.when(test, label)
    return found.otherwise("Other")


def age_label(ts, now):
    """How long ago, in the largest whole unit; '-' when there is no time."""
    seconds = ts.try_cast("double")
    delta = F.greatest(F.lit(0.0), F.lit(float(now)) - F.nanvl(seconds, F.lit(float(now))))

    def units(seconds, letter):
        return F.concat(F.floor(delta / seconds).cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(seconds.isNull(), "-")
        .when(delta < 60, units(1, "s"))
        .when(delta < 3600, units(60, "m"))
        .when(delta < 86400, units(3600, "h"))
        .otherwise(units(86400, "d"))
    )


def status_label(action):
    label = F.lit(None).cast("string")
    for value, text in STATUS_LABELS.items():
        label = F.when(action == value, text).otherwise(label)
    return F.coalesce(label, F.lit("Open"))


def agent_status(last_checkin, now):
    alive = (F.lit(now) - last_checkin) < AGENT_TIMEOUT_SECONDS
    return F.when(alive, "active").otherwise("disconnected")


def text_matches(pattern, *cols, regex=True):
    """Any column holds the lower-cased pattern, as a regex or as plain text."""
    needle = pattern.lower()
    hit = F.lit(False)
    for c in cols:
        text = F.lower(c)
        found = text.rlike(needle) if regex else F.contains(text, F.lit(needle))
        hit = hit | F.coalesce(found, F.lit(False))
    return hit


def software_text(name, version):
    """``name version`` without outer spaces; '' when there is neither."""
    return F.trim(F.concat(
        F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(version, F.lit(""))))


def alert_document(note_type, message):
    return F.concat(
        F.coalesce(note_type, F.lit("")), F.lit(": "), F.coalesce(message, F.lit("")))
