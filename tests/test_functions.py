import ipaddress
import random

from pyspark.sql import functions as F

from gridwarden import functions as G
from gridwarden.functions import constants as K


def one(spark, values, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*cols).collect()]


def test_zone_tokens(spark):
    cases = [
        ("ssl,modbus", 443, "OT", "IT"), (" MODBUS ", 1, "OT", "IT"), (",", 1, "IT", "IT"),
        (None, 502, "OT", "OT"), ("http", 2404, "OT", "OT"), ("dnp3_tcp", 1, "OT", "OT"),
        ("opc_ua_binary", 1, "OT", "IT"), ("http", None, "IT", "IT"), (None, None, "IT", "IT"),
        ("modbusx", 1, "IT", "IT"), ("c37.118", 1, "OT", "OT"), ("c37x118", 1, "IT", "IT"),
        ("ssl,\tHART-IP", 1, "OT", "IT"), ("modbus", 1, "OT", "OT"),
    ]
    got = one(spark, [c[:2] for c in cases], "s string, p int",
              G.zone(F.col("s"), F.col("p")), G.agent_zone(F.col("s"), F.col("p")))
    assert got == [c[2:] for c in cases]


def test_services(spark):
    cases = [("  SSL ", "ssl"), ("", "unclassified"), (None, "unclassified"),
             (" \t", "unclassified"), ("A,b", "a,b")]
    got = one(spark, [(c[0],) for c in cases], "s string", G.normal_service(F.col("s")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    ports = [80, 502, 34964, 9, None]
    got = one(spark, [(p,) for p in ports], "p int", G.guess_service(F.col("p")))
    assert [g[0] for g in got] == ["http", "modbus", "profinet", "unclassified", "unclassified"]


def test_zone_service_keys(spark):
    cases = {"OT|modbus": ("OT", "modbus"), "IT|": ("IT", "unclassified"), "|x": ("IT", "x"),
             "x|a|b": ("x", "a|b"), "noBar": ("noBar", "unclassified"),
             "": ("IT", "unclassified")}
    got = one(spark, [(k,) for k in cases], "k string", *G.split_zone_service(F.col("k")))
    assert got == list(cases.values())


def test_notice_severity(spark):
    cases = {"unauthorized": "medium", "Sensitive x": "high", "An Unauthorized": "high",
             "": "medium"}
    got = one(spark, [(k,) for k in cases], "n string", G.notice_severity(F.col("n")))
    assert [g[0] for g in got] == list(cases.values())


def _asset(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    if a.version != 4 or a.is_loopback or a.is_multicast or a.is_link_local or a.is_unspecified:
        return False
    return a.is_private and text != "255.255.255.255"


def _agent(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    if a.version == 6 and a.ipv4_mapped is not None:
        return True  # judged as IPv6 whatever address it wraps
    return not (a.is_loopback or a.is_unspecified or a.is_multicast)


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(5)
    ips = {"10.0.0.01", "::1", "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "10.0.0.1\n", " 10.0.0.1",
           "::", "0:0:0:0:0:0:0:1", "::0001", "0::", "fe80::1%eth0", "ff02::1", "FF02::1",
           "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "1:2::7:8",
           "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1",
           "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1.2.3.4::", ":1", "1:", "2001:db8::g", "ff::1"}
    for net in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
                "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
                "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
                "240.0.0.0/4", "255.255.255.255/32"):
        n = ipaddress.ip_network(net)
        for at in (int(n[0]) - 1, int(n[0]), int(n[0]) + 1, int(n[-1]) - 1, int(n[-1]),
                   int(n[-1]) + 1):
            if 0 <= at < 2 ** 32:
                ips.add(str(ipaddress.IPv4Address(at)))
    ips |= {f"192.0.0.{i}" for i in range(256)}
    ips |= {str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(3000)}
    ips |= {str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128)
                                      & rng.getrandbits(128))) for _ in range(500)}
    ips |= {ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(100)}
    got = one(spark, [(i,) for i in sorted(ips)], "ip string", "ip",
              G.is_asset_ip(F.col("ip")), G.is_agent_ip(F.col("ip")))
    assert [(i, a) for i, a, _ in got if a != _asset(i)] == []
    assert [(i, b) for i, _, b in got if b != _agent(i)] == []


def test_protocol_order(spark):
    cases = [("x", "got HTTPS hello", "HTTP"), ("", "tftp read", "FTP"),
             ("ScanDetect::X", "", "Port Scan"), ("a", "portscan", "Port Scan"),
             (None, None, "Other"), ("Unauthorized_Modbus", "ftp", "Modbus"),
             ("", "IEC104 and BACnet", "BACnet")]
    got = one(spark, [c[:2] for c in cases], "n string, m string",
              G.extract_protocol(F.col("n"), F.col("m")))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_cvss_bands(spark):
    cases = [("9.0", "critical"), ("8.9", "high"), ("7.0", "high"), ("4.0", "medium"),
             ("3.9", "info"), (None, "info"), ("NaN", "info"), ("x", "info")]
    got = one(spark, [(c[0],) for c in cases], "s string", G.cvss_band(F.col("s")))
    assert [g[0] for g in got] == [c[1] for c in cases]


def test_labels(spark):
    now = 1000000.0
    cases = [("999999.5", "0s ago"), ("999941", "59s ago"), ("999940", "1m ago"),
             ("996400", "1h ago"), ("913600", "1d ago"), ("1000050", "0s ago"),
             (None, "-"), ("soon", "-")]
    got = one(spark, [(c[0],) for c in cases], "t string", G.age_label(F.col("t"), now))
    assert [g[0] for g in got] == [c[1] for c in cases]
    got = one(spark, [(x,) for x in ("allow", "block", "investigate", "", None, "odd", "open")],
              "a string", G.status_label(F.col("a")))
    assert [g[0] for g in got] == [
        "Allowed", "Blocked", "Investigating", "Open", "Open", "Open", "Open"]
    got = one(spark, [(now - 89.9,), (now - 90.0,)], "t double", G.agent_status(F.col("t"), now))
    assert [g[0] for g in got] == ["active", "disconnected"]


def test_content_id_keeps_places(spark):
    got = one(spark, [("a", None), (None, "a"), ("a", "")], "x string, y string",
              G.content_id(F.col("x"), F.col("y")))
    ids = [g[0] for g in got]
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == 24


def test_agent_list_differs_by_one_name():
    assert set(K.OT_SERVICES) - set(K.AGENT_OT_SERVICES) == {"opc_ua_binary"}


def test_one_spelling_of_addresses(spark):
    """Against the standard library, over every length and place of runs of zeros."""
    draw = random.Random(5)
    spelled = ["10.0.0.1", "::", "::1", "1::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::FFFF:1.2.3.4",
               "::ffff:0:0", "0:0:0:0:0:ffff:255.255.0.9", "64:ff9b::192.0.2.33", "fe80::A%Eth0",
               "0::0.0.0.0", "1:0:0:2:0:0:0:3", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::"]
    for _ in range(400):
        groups = [draw.choice((0, 0, 0, 1, 16, 0xABCD, 0xFFFF)) for _ in range(8)]
        text = [draw.choice(("%x", "%04X", "%03x")) % g for g in groups]
        at, to = sorted(draw.sample(range(9), 2))
        if draw.random() < 0.5 and not any(groups[at:to]):
            spelled.append(":".join(text[:at]) + "::" + ":".join(text[to:]))
        else:
            spelled.append(":".join(text))
    df = spark.createDataFrame([(x,) for x in spelled + [None]], "ip string")
    got = {r["ip"]: r["one"] for r in df.select(
        "ip", G.canonical_ip(F.col("ip")).alias("one")).collect()}
    assert got == {None: None} | {x: _standard(x) for x in spelled}


def _standard(text):
    address = ipaddress.ip_address(text)
    mapped = getattr(address, "ipv4_mapped", None)  # older versions write it in hex
    return f"::ffff:{mapped}" if mapped else str(address)
