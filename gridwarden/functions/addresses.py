"""IP addresses: tests as single regular expressions, and one spelling for each."""

from pyspark.sql import functions as F

_O = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_O}(?:\.{_O}){{3}}"

# Private ranges, less the broadcast, unspecified and two globally reachable addresses.
_ASSET = (
    r"^(?!0\.0\.0\.0\z)(?!255\.255\.255\.255\z)(?!192\.0\.0\.(?:9|10)\z)(?:"
    + "|".join([
        rf"(?:0|10)\.{_O}\.{_O}\.{_O}",
        rf"172\.(?:1[6-9]|2[0-9]|3[01])\.{_O}\.{_O}",
        rf"192\.168\.{_O}\.{_O}",
        rf"192\.0\.[02]\.{_O}",
        rf"198\.1[89]\.{_O}\.{_O}",
        rf"198\.51\.100\.{_O}",
        rf"203\.0\.113\.{_O}",
        rf"(?:24[0-9]|25[0-5])\.{_O}\.{_O}\.{_O}",
    ])
    + r")\z"
)

_H = r"[0-9a-f]{1,4}"
_SCOPE = r"(?:%[^%]+)?"


def _ipv6():
    """Full form, every position of '::', and the same with an IPv4 tail."""
    forms = []
    for tail, width in ((_H, 1), (_IPV4, 2)):
        lead = 8 - width
        forms.append(rf"(?:{_H}:){{{lead}}}{tail}")
        for left in range(lead):
            head = rf"(?:{_H}:){{{left}}}" if left else ":"
            right = lead - left - 1
            forms.append(rf"{head}:(?:{_H}:){{0,{right}}}{tail}")
    for left in range(8):
        head = rf"{_H}(?::{_H}){{{left - 1}}}" if left else ""
        forms.append(rf"{head}::")
    return "(?:" + "|".join(forms) + ")"


_IP = rf"(?i)^(?:{_IPV4}|{_ipv6()}{_SCOPE})\z"
# Loopback, unspecified and multicast, in every spelling of the zeros.
_NOT_AN_AGENT = (
    r"(?i)^(?:127\.|0\.0\.0\.0\z|22[4-9]\.|23[0-9]\.|ff[0-9a-f]{2}:"
    r"|[0:]*:0{0,3}[01]?(?:%.*)?\z)"
)


def is_ip(ip):
    """A well-formed IPv4 or IPv6 address."""
    return F.coalesce(ip.rlike(_IP), F.lit(False))


def is_asset_ip(ip):
    """A private IPv4 host address."""
    return F.coalesce(ip.rlike(_ASSET), F.lit(False))


def is_agent_ip(ip):
    """Any host address but loopback, unspecified and multicast ones."""
    return is_ip(ip) & ~ip.rlike(_NOT_AN_AGENT)


def _groups(text):
    return F.array_remove(F.split(text, ":"), "")


def canonical_ip(ip):
    """The one spelling of a well-formed address; IPv4 and NULL stay as they are.

    IPv6: small hex groups without leading zeros, the longest run of two or more zero groups,
    the first of equally long ones, as '::'. An IPv4 tail is kept only in mapped addresses
    (::ffff:a.b.c.d); a scope is kept as written.
    """
    scope = F.regexp_extract(ip, r"(?s)%.*\z", 0)
    body = F.lower(F.regexp_replace(ip, r"(?s)%.*\z", ""))
    octets = [F.regexp_extract(body, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z", i + 1).cast("int")
              for i in range(4)]
    hexed = F.when(body.contains("."), F.concat(
        F.regexp_replace(body, r"[0-9.]+\z", ""), F.lower(F.hex(octets[0] * 256 + octets[1])),
        F.lit(":"), F.lower(F.hex(octets[2] * 256 + octets[3])))).otherwise(body)
    left, right = (_groups(F.split_part(hexed, F.lit("::"), F.lit(i))) for i in (1, 2))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    groups = F.transform(F.concat(left, zeros, right),
                         lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(ip.contains(":"), F.concat(F.transform(
        F.array(F.concat_ws(":", groups)), _shortened)[0], scope)).otherwise(ip)


def _shortened(full):
    """Eight groups with the longest run of zeros left out, or a mapped IPv4 address."""
    short = full
    for length in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{length - 1}}}(?::|\z)(.*)\z"
        short = F.when(full.rlike(run), F.regexp_replace(full, run, "$1::$2")).otherwise(short)
    high, low = (F.conv(F.split_part(full, F.lit(":"), F.lit(i)), 16, 10).cast("int")
                 for i in (7, 8))
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(
        ".", F.shiftright(high, 8), high % 256, F.shiftright(low, 8), low % 256))
    return F.when(full.startswith("0:0:0:0:0:ffff:"), mapped).otherwise(short)
