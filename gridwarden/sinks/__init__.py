"""Writers: append, append unseen, replace, retain."""

from gridwarden.sinks.tables import (
    append, append_new, append_new_by_key, append_once, drop_days, drop_expired, merge_days, refresh_latest,
    replace, retain, to_table, unseen, unseen_in_buckets, write_by_date,
)

__all__ = [
    "append", "append_new", "append_new_by_key", "append_once", "drop_days", "drop_expired", "merge_days",
    "refresh_latest", "replace", "retain", "to_table", "unseen", "unseen_in_buckets",
    "write_by_date",
]
