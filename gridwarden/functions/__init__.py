"""Column expressions; all of them stay inside the JVM."""

from gridwarden.functions.addresses import canonical_ip, is_agent_ip, is_asset_ip, is_ip
from gridwarden.functions.alerts import (
    age_label, agent_status, alert_document, content_id, extract_protocol, is_severe,
    notice_severity, row_id, software_text, status_label, text_matches,
)
from gridwarden.functions.scores import cosine_distance, cvss_band, similarity
from gridwarden.functions.times import epoch_micros, event_time
from gridwarden.functions.zones import (
    agent_zone, guess_service, normal_service, split_zone_service, zone,
)

__all__ = [
    "age_label", "agent_status", "agent_zone", "alert_document", "canonical_ip", "content_id",
    "cosine_distance", "cvss_band", "epoch_micros", "event_time", "extract_protocol",
    "guess_service", "is_agent_ip", "is_asset_ip", "is_ip", "is_severe", "normal_service",
    "notice_severity", "row_id", "similarity", "software_text", "split_zone_service", "status_label",
    "text_matches", "zone",
]
