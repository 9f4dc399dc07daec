import json

from conftest import rows

from gridwarden import schemas
from gridwarden.operators import ingest
from gridwarden.sources import read_logs, split_rejects


def logs(spark, tmp_path, kind, lines, valid):
    folder = tmp_path / kind
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(
        x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return split_rejects(read_logs(spark, str(folder), kind), valid)


def test_notices(spark, tmp_path):
    good, bad = logs(spark, tmp_path, "notice", [
        {"note": "NoTime"},
        {"ts": 1.5, "note": "A", "src": "1.1.1.1"},
        {"ts": "2.5", "note": "Unauthorized", "msg": "m", "src": "s", "id.orig_h": "o",
         "id.resp_h": "r", "dst": "d", "id.resp_p": 502},
        "{not json", {"ts": 3, "id.resp_p": "abc"}, {"ts": "later"},
    ], ingest.valid_notice())
    got = rows(ingest.normalize_notice(good), "ts", "note_type", "message", "src_h", "dst_h",
               "severity", "zone", "source")
    assert got == [
        (1.5, "A", "", "1.1.1.1", "", "medium", "IT", "zeek"),
        (2.5, "Unauthorized", "m", "o", "r", "high", "OT", "zeek")]
    assert bad.count() == 3


def test_equal_rows_keep_one_id_each(spark, tmp_path):
    good, _ = logs(spark, tmp_path, "software", [
        {"ts": 1, "host": "h", "name": "n"}, {"ts": 1, "host": "h", "name": "n"},
        {"ts": 2, "host": "h", "name": "n"}], ingest.valid_software())
    got = ingest.normalize_software(good)
    assert got.count() == 3 and got.select("id").distinct().count() == 2


def test_connections_with_odd_times_and_states(spark, tmp_path):
    good, bad = logs(spark, tmp_path, "conn", [
        {"ts": 5, "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "conn_state": "S0",
         "service": "ssl,Modbus"},
        {"id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.3", "service": "HTTP "},
        {"ts": "bad", "id.orig_h": "10.0.0.9", "id.resp_h": "8.8.8.8", "service": "http"},
        {"ts": 7, "id.orig_h": "8.8.8.8", "id.resp_h": "10.0.0.3", "conn_state": "SF"},
        {"ts": 8, "id.resp_p": "x"}, "]",
    ], ingest.valid_conn())
    assert bad.count() == 2
    conn = ingest.normalize_conn(good)
    assert rows(ingest.connection_stats(conn)) == [
        ("IT", "http", 2), ("IT", "unclassified", 1), ("OT", "ssl,modbus", 1)]
    assert rows(ingest.asset_observations(conn)) == [
        ("10.0.0.1", "OT", 0.0, 5.0), ("10.0.0.3", "IT", 0.0, 7.0)]


def test_stats_add_up(spark):
    a = spark.createDataFrame([("IT", "http", 3)], schemas.CONNECTION_STATS)
    b = spark.createDataFrame([("IT", "http", 4), ("OT", "x", 1)], schemas.CONNECTION_STATS)
    assert rows(ingest.add_stats(a, b)) == [("IT", "http", 7), ("OT", "x", 1)]


def test_checkins(spark):
    req = spark.createDataFrame([
        ("a", "h", "10.0.0.1", "linux", None, None, 1.0), ("b", "h", "127.0.0.1", "l", "g", "2", 2.0),
        ("c", "h", "8.8.8.8", "l", "g", "2", 3.0), ("d", "h", "::1", "l", "g", "2", 4.0),
        ("e", "h", "2001:db8::5", "l", "g", "2", 5.0)], schemas.AGENT_CHECKIN)
    agents, seen = ingest.ingest_checkins(req)
    assert agents.count() == 5
    assert rows(agents.where("agent_id = 'a'"), "agent_group", "version") == [
        ("default", "1.0.0")]
    assert [r[0] for r in rows(seen, "ip")] == ["10.0.0.1", "2001:db8::5", "8.8.8.8"]


def test_agent_batches(spark):
    batch = spark.createDataFrame([(
        "a1", [(1.0, "N", "m", None, "d", None, None)],
        {"OT|modbus": 3, "|": 1}, 9.0)], schemas.AGENT_BATCH)
    alerts, counts = ingest.ingest_agent_batches(batch)
    assert rows(alerts, "ts", "src_h", "dst_h", "severity", "zone", "source") == [
        (1.0, "", "d", "medium", "IT", "agent:a1")]
    assert rows(counts) == [("a1", "IT", "unclassified", 1, 9.0), ("a1", "OT", "modbus", 3, 9.0)]
