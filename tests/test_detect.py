import random

from conftest import rows
from pyspark.sql import functions as F

from gridwarden import streaming
from gridwarden.operators import detect

BASE = 1_700_000_000.0
SCHEMA = "ts double, orig_h string, resp_h string, resp_p int, proto string, service string"


def conn(spark, events):
    return spark.createDataFrame(
        [(BASE + t, s, d, p, proto, "") for t, s, d, p, proto in events], SCHEMA)


def scans(df, **kw):
    found = detect.detect_scans(df, **kw)
    return rows(found.select(
        "src_h", F.round(F.col("ts") - BASE, 3), F.round(F.col("window_start") - BASE, 3),
        "dst_h", "zone"))


def expected(events, threshold=15, window=60.0, refire=False):
    """One event at a time, as a sensor would see them."""
    out, state = [], {}
    for t, s, d, p, proto in sorted(events, key=lambda e: (e[0], e[3], e[4], e[2])):
        start, seen, fired = state.get(s, (None, None, None))
        if start is None or t - start > window:
            start, seen, fired = t, set(), False
        seen.add((p, proto) if refire else p)
        if refire and len(seen) == threshold:
            out.append((s, round(t, 3), round(start, 3), "", "IT"))
        if not refire and len(seen) >= threshold and not fired:
            fired = True
            zone = "OT" if p in (502, 102, 2404) else "IT"
            out.append((s, round(t, 3), round(start, 3), d, zone))
        state[s] = (start, seen, fired)
    return sorted(out)


def line(n, at=0.0, step=1.0, src="a", first=1):
    return [(at + i * step, src, f"d{i}", first + i, "tcp") for i in range(n)]


def test_thresholds_and_edges(spark):
    assert scans(conn(spark, line(14))) == []
    assert scans(conn(spark, line(15))) == [("a", 14.0, 0.0, "d14", "IT")]
    on_edge = line(14) + [(60.0, "a", "e", 99, "tcp")]
    assert scans(conn(spark, on_edge)) == [("a", 60.0, 0.0, "e", "IT")]
    assert scans(conn(spark, line(14) + [(60.001, "a", "e", 99, "tcp")])) == []
    again = line(30) + line(15, at=61.0, first=100)
    assert scans(conn(spark, again)) == [
        ("a", 14.0, 0.0, "d14", "IT"), ("a", 75.0, 61.0, "d14", "IT")]
    assert scans(conn(spark, line(14) + [(20.0, "a", "plc", 502, "tcp")])) == [
        ("a", 20.0, 0.0, "plc", "OT")]


def test_sensor_rule_fires_while_the_set_is_full(spark):
    events = line(15) + [(20.0, "a", "x", 3, "tcp"), (21.0, "a", "x", 3, "udp"),
                         (22.0, "a", "x", 3, "tcp")]
    got = scans(conn(spark, events), refire=True)
    assert [g[1] for g in got] == [14.0, 20.0]
    assert got == expected(events, refire=True)


def _random_events(seed, n, span, sources="abcd", ports=40):
    rng = random.Random(seed)
    return [(round(rng.uniform(0, span), 3), rng.choice(sources), f"d{rng.randrange(9)}",
             rng.choice((502, 102, *range(1, ports))), rng.choice(("tcp", "udp")))
            for _ in range(n)]


def test_random_events_for_every_chunk_size(spark):
    events = _random_events(1, 1500, 2000.0)
    events += [(t + 7000, "a", d, p, x) for t, _, d, p, x in _random_events(2, 400, 900.0)]
    df = conn(spark, events)
    for refire in (False, True):
        want = expected(events, refire=refire)
        assert len(want) > 20
        for chunk in (1, 2, 7, 60):
            assert scans(df, refire=refire, chunk_windows=chunk) == want


def test_one_source_without_pause(spark):
    events = [(i * 4.0, "hot", "d", i * 7 % 90, "tcp") for i in range(3000)]
    want = expected(events)
    assert scans(conn(spark, events), chunk_windows=5) == want and len(want) > 100


def test_stream_equals_batch(spark, tmp_path):
    events = _random_events(3, 800, 1500.0)
    random.Random(4).shuffle(events)
    end = [(90000.0, "end", "", 1, "tcp")]
    for refire in (False, True):
        want = expected(events, refire=refire)
        for files in (1, 3):
            base = tmp_path / f"{refire}{files}"
            for i in range(files):
                conn(spark, events[i::files]).coalesce(1).write.mode("append").parquet(
                    str(base / "in"))
            conn(spark, end).write.mode("append").parquet(str(base / "in"))
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(
                str(base / "in"))
            found = streaming.detect_scans_stream(stream, refire=refire, watermark="30 minutes")
            found.writeStream.format("parquet").option("path", str(base / "out")).option(
                "checkpointLocation", str(base / "cp")).trigger(
                availableNow=True).start().awaitTermination()
            got = spark.read.schema(found.schema).parquet(str(base / "out"))
            assert rows(got.select(
                "src_h", F.round(F.col("ts") - BASE, 3),
                F.round(F.col("window_start") - BASE, 3), "dst_h", "zone")) == want


class _Held:
    """A state variable of one key, as a streaming processor sees it."""

    def __init__(self):
        self.rows = {}

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value

    def clear(self):
        del self.rows[None]


def test_state_of_a_hot_source_is_bounded_by_ports_and_empty_at_the_end(monkeypatch):
    import pandas as pd
    from gridwarden.streaming import scans as scans_stream
    from gridwarden.streaming.scans import ScanTracker

    width, timers, held = 60_000_000, set(), {}

    class Handle:
        registerTimer = staticmethod(timers.add)

        def getValueState(self, name, schema):
            return held.setdefault(name, _Held())

        def getMapState(self, name, key, value):
            return held.setdefault(name, _Held())

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    tracker, taken = ScanTracker(15, width, True, width), []
    tracker.init(Handle())
    take = tracker._taken
    tracker._taken = lambda tables, *a: taken.append(sum(map(len, tables))) or take(tables, *a)
    monkeypatch.setattr(scans_stream, "ROWS_AT_ONCE", 100)
    rng = random.Random(8)
    events = [(rng.randrange(1200 * 1_000_000), rng.randrange(3000)) for _ in range(30_000)]
    for at in range(0, len(events), 1000):
        us, port = zip(*events[at:at + 1000])
        frame = pd.DataFrame({"us": us, "port": port, "proto": "tcp", "dst": "d"})
        list(tracker.handleInputRows(("s",), [frame], None))
    most, found = 0, []
    for ms in range(0, 1_400_000, 150_000):
        if due := {t for t in timers if t <= ms}:
            timers -= due
            found += list(tracker.handleExpiredTimer(("s",), Watermark(ms), None))
            most = max(most, len(held["open"].get()[1]) if held["open"].exists() else 0)
    assert len(taken) == 20 and max(taken) < 2000  # one slot at a time
    assert most == 16 and not any(h.rows for h in held.values())
    assert [tuple(r) for f in found for r in f[["us", "start"]].itertuples(index=False)] == sorted(
        (round(t * 1e6), round(w * 1e6)) for t, w in replay(events))


def test_scattered_rows_of_a_hot_source_wait_in_few_parts(monkeypatch):
    import pandas as pd
    from gridwarden.streaming import scans as scans_stream

    width, timers, held, written = 60_000_000, set(), {}, []

    class Handle:
        registerTimer = staticmethod(timers.add)

        def getValueState(self, name, schema):
            return held.setdefault(name, _Held())

        def getMapState(self, name, key, value):
            return held.setdefault(name, _Held())

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    monkeypatch.setattr(scans_stream, "ROWS_AT_ONCE", 4_000)
    tracker = scans_stream.ScanTracker(15, width, True, width)
    tracker.init(Handle())
    update = held["waiting"].updateValue
    held["waiting"].updateValue = lambda *a: written.append(a[0]) or update(*a)
    rng = random.Random(9)
    # 30,000 rows in batches that each touch most of 500 slots
    events = [(rng.randrange(500 * width), rng.randrange(40)) for _ in range(30_000)]
    frames = [pd.DataFrame(events[at:at + 1000], columns=["us", "port"]).assign(
        proto="tcp", dst="d") for at in range(0, len(events), 1000)]
    for at in range(0, len(frames), 10):
        list(tracker.handleInputRows(("s",), frames[at:at + 10], None))
    assert len(written) <= 3 * 3 * (scans_stream.PARTS + 1)
    found = []
    # the watermark stops inside parts, too
    for ms in [*range(0, 30_000_000, 700_000), 40_000_000]:
        if due := {t for t in timers if t <= ms}:
            timers -= due
            found += list(tracker.handleExpiredTimer(("s",), Watermark(ms), None))
    assert not any(h.rows for h in held.values())
    assert [tuple(r) for f in found for r in f[["us", "start"]].itertuples(index=False)] == sorted(
        (round(t * 1e6), round(w * 1e6)) for t, w in replay(events))


def replay(events, threshold=15, width=60.0):
    """(time, window start) of each notice of one source, event by event."""
    start, ports, out = None, set(), []
    for us, port in sorted(events):
        if start is None or us - start > width * 1e6:
            start, ports = us, set()
        ports.add(port)
        if len(ports) == threshold:
            out.append((us / 1e6, start / 1e6))
    return out


def test_modbus_writes(spark):
    log = spark.createDataFrame(
        [(1.0, "a", "b", "WRITE_SINGLE_COIL", True, 7), (2.0, "a", "b", "READ_COILS", True, 7),
         (3.0, "a", "b", "WRITE_SINGLE_COIL", False, 7), (4.0, "c", "b", "WRITE_SINGLE_COIL", True, 1)],
        "ts double, orig_h string, resp_h string, func string, is_request boolean, address bigint")
    assert rows(detect.detect_modbus_writes(log), "ts", "message") == [
        (1.0, "Modbus coil write from a to b (addr=7)"),
        (4.0, "Modbus coil write from c to b (addr=1)")]
    allowed = spark.createDataFrame([("c",)], "orig_h string")
    alerts = detect.to_alerts(detect.detect_modbus_writes(log, allowed), "zeek")
    assert rows(alerts, "ts", "severity", "zone", "source") == [(1.0, "high", "OT", "zeek")]


def test_signatures(spark):
    def rec(port, payload=None, request=None, proto="tcp"):
        return (1.0, "s", "d", proto, port, payload, request)
    records = spark.createDataFrame([
        rec(502, "\x00\x01abc\x08\x00"), rec(502, "\x01\x00\x08\x00"),
        rec(502, "\x00\n\x08\x00"), rec(80, None, "/q?a=1%27--"), rec(80, "USER x", "/plain"),
        rec(21, "USER root"), rec(21, "xUSER root"), rec(21, "USER root", proto="udp"),
        rec(80, None, "it's")],
        "ts double, src_h string, dst_h string, proto string, dst_port int, payload string, "
        "http_request string")
    want = [("sig-modbus-diagnostic-abuse", 502), ("sig-plaintext-ftp-creds", 21),
            ("sig-sql-injection-attempt", 80), ("sig-sql-injection-attempt", 80)]
    assert rows(detect.match_signatures(records), "rule", "port") == want
    assert rows(detect.match_signatures(records, detect.signature_rules(spark)),
                "rule", "port") == want
