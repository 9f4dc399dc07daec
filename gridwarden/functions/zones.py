"""IT/OT zone and service names."""

import re

from pyspark.sql import functions as F

from gridwarden.functions.constants import (
    AGENT_OT_SERVICES, OT_PORTS, OT_SERVICES, PORT_SERVICES,
)

_SPACE = " \t\n\r\x0b\x0c"
# One comma-separated token equal to a known name. A single regex keeps the
# test inside generated code, where split + transform would leave it.
_OT_TOKEN = (
    r"(?:^|,)\s*(?:" + "|".join(re.escape(s) for s in OT_SERVICES) + r")\s*(?:,|\z)"
)


def is_ot_service(service):
    """True when any comma-separated token names an OT service."""
    return F.coalesce(F.lower(service).rlike(_OT_TOKEN), F.lit(False))


def is_ot_port(port):
    return F.coalesce(port.isin(*OT_PORTS), F.lit(False))


def zone(service, port):
    return F.when(is_ot_service(service) | is_ot_port(port), "OT").otherwise("IT")


def agent_zone(service, port):
    """Agents compare the whole service string, as it is written."""
    named = F.coalesce(service.isin(*AGENT_OT_SERVICES), F.lit(False))
    return F.when(named | is_ot_port(port), "OT").otherwise("IT")


def guess_service(port):
    pairs = [F.lit(x) for item in PORT_SERVICES.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), port.cast("int"))
    return F.coalesce(known, F.lit("unclassified"))


def normal_service(service):
    """Trimmed and lower-cased; empty or missing is 'unclassified'."""
    clean = F.lower(F.btrim(service, F.lit(_SPACE)))
    return F.when(clean != "", clean).otherwise("unclassified")


def split_zone_service(key):
    """``ZONE|service`` cut at the first bar, with defaults for empty parts."""
    bar = F.instr(key, "|")
    zone_part = F.when(bar > 0, F.substring(key, F.lit(1), bar - 1)).otherwise(key)
    service = F.when(bar > 0, F.substring(key, bar + 1, F.length(key))).otherwise("")
    return (
        F.when(zone_part != "", zone_part).otherwise("IT"),
        F.when(service != "", service).otherwise("unclassified"),
    )
