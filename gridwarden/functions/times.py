"""Epoch seconds, microseconds and timestamps."""

from pyspark.sql import functions as F


def event_time(ts):
    """Epoch seconds to a timestamp; NULL when it is not a number."""
    return F.timestamp_micros(epoch_micros(ts))


def epoch_micros(ts):
    """Epoch seconds as whole microseconds, so that time differences are exact."""
    seconds = ts.try_cast("double")
    return F.when(~F.isnan(seconds), F.round(seconds * 1000000).try_cast("bigint"))
