"""Structured Streaming jobs built from the batch operators."""

from gridwarden.streaming.jobs import (
    read_increments, read_totals, software_matcher, stream_agent_batches, stream_alerts,
    stream_checkins, stream_connections, stream_increments, stream_late_increments,
    stream_matches, stream_software, technique_matcher,
)
from gridwarden.streaming.matching import read_matches, stream_software_matches
from gridwarden.streaming.scans import detect_scans_stream

__all__ = [
    "detect_scans_stream", "read_increments", "read_matches", "read_totals", "software_matcher",
    "stream_agent_batches", "stream_alerts", "stream_checkins", "stream_connections",
    "stream_increments", "stream_late_increments", "stream_matches", "stream_software", "stream_software_matches", "technique_matcher",
]
