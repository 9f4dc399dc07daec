"""Readers: raw logs, cached reference data and stored tables."""

from gridwarden.sources.logs import read_agent_batches, read_logs, split_rejects
from gridwarden.sources.reference import (
    flatten_nvd, flatten_stix, load_nvd, load_reference, load_reference_lines, load_stix,
)
from gridwarden.sources.tables import read_snapshot, read_table

__all__ = [
    "flatten_nvd", "flatten_stix", "load_nvd", "load_reference", "load_reference_lines",
    "load_stix", "read_agent_batches", "read_logs", "read_snapshot", "read_table", "split_rejects",
]
