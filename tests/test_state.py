import random

from conftest import rows
from pyspark.sql import functions as F

from gridwarden import schemas
from gridwarden.operators import analytics, commands, state


def table(spark, name, *values):
    return spark.createDataFrame(list(values), schemas.TABLES[name])


def test_latest_keeps_columns_together_on_ties(spark):
    log = spark.createDataFrame(
        [("k", "a", 9, 1.0, "1"), ("k", "b", 1, 1.0, "2"), ("k", "z", 7, 0.5, "3"),
         ("one", "q", 0, 3.0, "4")], "k string, a string, n int, ts double, id string")
    assert rows(state.latest_by(log, "k", "ts", ["a", "n"], ties=["id"])) == [
        ("k", "b", 1), ("one", "q", 0)]


def test_inventory_defaults(spark):
    obs = table(spark, "asset_observations", ("1", "IT", 5.0, 6.0), ("1", "OT", 3.0, 4.0),
                ("2", "IT", 1.0, 9.0))
    admin = table(spark, "asset_admin", ("1", "old", "low", "", "", "x", 1.0),
                  ("1", "new", "high", "t", "n", "x", 2.0))
    none = table(spark, "ip_policies")
    agents = table(spark, "agents", ("a", "host", "2", "l", "g", "1", 1.0))
    assert rows(state.asset_inventory(obs, admin, none, agents)) == [
        ("1", "OT", 3.0, 6.0, "new", "high", "t", "n", "none", "", ""),
        ("2", "IT", 1.0, 9.0, "", "", "", "", "none", "", "host")]


def _alert(i, ts, severity="high", zone="IT"):
    return (str(i), ts, "N", f"m{i}", "s", "d", severity, zone, "zeek")


def test_alerts_with_status(spark):
    alerts = table(spark, "alerts", _alert(1, 1.0), _alert(2, 2.0), _alert(3, 3.0))
    actions = table(
        spark, "alert_actions", ("a", "3", "block", "x", "n", "", "", 1.0),
        ("b", "3", "allow", "y", "", "", "", 2.0), ("c", "1", "block", "x", "n", "", "", 1.0))
    got = [tuple(r) for r in state.alerts_with_status(alerts, actions, 2).select(
        "id", "status", "last_actor").collect()]
    assert got == [("3", "allow", "y"), ("2", "open", "")]
    assert rows(state.dashboard_alerts(alerts, actions), "id", "status") == [
        ("1", "Blocked"), ("2", "Open"), ("3", "Allowed")]
    feed = rows(state.recent_actions(actions.union(table(
        spark, "alert_actions", ("d", "9", "allow", "z", "", "", "", 3.0))), alerts, 63.0),
        "id", "message", "age")
    assert feed == [("a", "m3", "1m ago"), ("b", "m3", "1m ago"), ("c", "m1", "1m ago"),
                    ("d", "(alert not found)", "1m ago")]


def test_trend_fills_gaps(spark):
    alerts = table(spark, "alerts", _alert(1, 30.0), _alert(2, 59.0), _alert(3, 250.0),
                   _alert(4, None))
    got = rows(analytics.alert_trend(alerts).withColumn("minute", F.unix_seconds("minute")))
    assert got == [(0, 2), (60, 0), (120, 0), (180, 0), (240, 1)]
    assert analytics.alert_trend(table(spark, "alerts", _alert(1, None))).count() == 0
    over_midnight = table(spark, "alerts", _alert(1, 86370.0), _alert(2, 86400.0 + 61))
    assert analytics.alert_trend(over_midnight).count() == 3


def test_histogram_edges(spark):
    m = spark.createDataFrame([(0.0,), (10.0,), (9.0,), (0.99,), (None,), (float("nan"),)],
                              "cvss_score double")
    assert rows(analytics.cvss_histogram(m), "bin", "count") == [(0, 2), (9, 2)]


def test_pages(spark):
    alerts = table(spark, "alerts", *[_alert(i, float(i // 2)) for i in range(23)])
    everything = state.newest_first(alerts)
    want = [r["id"] for r in everything.collect()]
    assert [r["id"] for r in analytics.page(alerts, 1, 10).collect()] == want[10:20]
    assert [r["id"] for r in analytics.page(alerts, 99, 10).collect()] == want[20:]
    last = everything.collect()[9]
    assert [r["id"] for r in analytics.page_after(
        alerts, last["ts"], last["id"], 10).collect()] == want[10:20]
    index = analytics.page_index(alerts)
    for number in (0, 1, 2, 9):
        assert [r["id"] for r in analytics.indexed_page(index, number, 10).collect()
                ] == want[min(number, 2) * 10:][:10]
    spread = table(spark, "alerts", *[
        _alert(i, None if i % 9 == 0 else i * 0.004 + (i % 4) * 86400) for i in range(60)])
    want = [r["id"] for r in state.newest_first(spread).collect()]
    index = analytics.page_index(spread)
    for number in range(9):
        assert [r["id"] for r in analytics.indexed_page(index, number, 7).collect()
                ] == want[number * 7:][:7]
    none = table(spark, "alerts")
    assert analytics.page(none, 3, 10).count() == 0
    assert analytics.indexed_page(analytics.page_index(none), 3, 10).count() == 0
    assert analytics.page_count(0, 10) == 1 and analytics.page_count(21, 10) == 3


def test_pages_of_repeated_rows(spark):
    """Pages cut a run of equal rows, and rows of one time and id, without loss or repeats."""
    same = [_alert(1, 5.0)] * 9 + [_alert(2, 5.0)] * 4 + [_alert(3, None)] * 3
    twins = [(*_alert(0, 7.0)[:-1], last) for last in ("a", "b", "c", None)]
    alerts = table(spark, "alerts", *same, *twins).repartition(5)
    index = analytics.page_index(alerts)
    got = [r for n in range(5) for r in analytics.indexed_page(index, n, 4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, alerts.collect()))
    assert [r["id"] for r in got] == [r["id"] for r in state.newest_first(alerts).collect()]


def test_search(spark):
    alerts = table(spark, "alerts", ("1", 1.0, "A.b", "x", "h", "d", "high", "IT", "z"),
                   ("2", 1.0, "AxB", None, "h", "d", "high", "IT", "z"))
    assert rows(analytics.search_alerts(alerts, "a.B"), "id") == [("1",), ("2",)]
    assert rows(analytics.search_alerts(alerts, "a.B", regex=False), "id") == [("1",)]
    assert analytics.search_alerts(alerts, "").count() == 2


def test_kpis_of_nothing(spark):
    empty = table(spark, "alerts")
    assert rows(analytics.kpis(empty, empty, empty)) == [(0, 0, 0, 0)]


def test_alert_action_requests(spark):
    req = spark.createDataFrame([
        ("1", "a", "b", "block", "x", "n", 1.0), ("1", "a", None, "allow", "x", None, 2.0),
        ("1", "", "", "investigate", "x", "", 3.0), ("1", "", "", "Block", "x", "", 4.0),
        ("1", "", "", None, "x", "", 5.0)], schemas.ALERT_ACTION_REQUEST)
    ok, bad = commands.apply_alert_actions(req)
    assert [(r["action"], r["enforcement_status"], r["enforcement_detail"])
            for r in ok.orderBy("ts").collect()] == [
        ("block", "stubbed", "No live enforcement backend configured yet - would block traffic "
         "from a to b."),
        ("allow", "not_applicable", "No enforcement backend configured for allow - recorded as "
         "decision only (a -> )."),
        ("investigate", "not_applicable", "Marked for investigation.")]
    assert rows(bad, "ts", "error") == [(4.0, "Invalid action"), (5.0, "Invalid action")]

    def live(df):
        return df.withColumns({"enforcement_status": F.lit("applied"),
                               "enforcement_detail": F.lit("done")})
    ok, _ = commands.apply_alert_actions(req, decide=live)
    assert {r["enforcement_status"] for r in ok.collect()} == {"applied"}


def test_policy_guard_takes_the_last_edit(spark):
    """Against a search of all edits: ties, repeated rows, blank fields and the order of days."""
    draw = random.Random(3)
    def some(*values):
        return draw.choice(values)
    edits = [(some("a", "b", None), some("", "o"), some("critical", "low", None), some("", "t"),
              "", "x", some(None, *[86400.0 * d + s for d in range(5) for s in (0.0, 9.0)]))
             for _ in range(60)]
    asked = [(some("a", "b", "c", None), "quarantine", f"r{i}", "", some(False, None),
              some(None, *[86400.0 * d + s for d in range(6) for s in (0.0, 5.0, 9.0)]))
             for i in range(80)]
    def in_force(ip, ts):
        known = [(e[6], *[(v is not None, v or "") for v in (e[1], e[2], e[3], e[4])], e[2] or "")
                 for e in edits if ip is not None and e[0] == ip and None not in (e[6], ts)
                 and e[6] <= ts]
        return max(known)[-1] if known else None
    requests = spark.createDataFrame(asked + asked[:9], schemas.POLICY_REQUEST)
    found = commands.criticality_as_of(requests, table(spark, "asset_admin", *edits))
    assert sorted((r["actor"], str(r["host_criticality"])) for r in found.collect()) == sorted(
        (r[2], str(in_force(r[0], r[5]))) for r in asked + asked[:9])


def test_added_assets(spark):
    def req(ip, zone="IT", criticality=""):
        return (ip, zone, "o", criticality, "", "", "a", 1.0)
    requests = spark.createDataFrame([
        req(" 10.0.0.1 "), req("2001:DB8:0:0::1"), req("10.0.0"), req("10.0.0.2", "DMZ"),
        req("10.0.0.3", "OT", "severe"), req("10.0.0.4", None, None)], schemas.ASSET_REQUEST)
    seen, admin, bad = commands.add_assets(requests)
    assert rows(seen, "ip", "zone") == [
        ("10.0.0.1", "IT"), ("10.0.0.4", "IT"), ("2001:db8::1", "IT")]
    assert admin.count() == 3
    assert rows(bad, "ip", "error") == [
        ("10.0.0", "Invalid IP address"), ("10.0.0.2", "zone must be IT or OT"),
        ("10.0.0.3", "Invalid criticality")]


def test_policy_guard_follows_criticality_over_time(spark):
    day = 86400.0
    admin = table(spark, "asset_admin", ("h", "", "critical", "", "", "a", 10.0),
                  ("h", "", "low", "", "", "a", 3 * day + 5))
    def req(ts, policy, confirm=False, ip="h"):
        return (ip, policy, "x", "", confirm, ts)
    requests = spark.createDataFrame([
        req(5.0, "blacklist"), req(10.0, "quarantine"), req(20.0, "blacklist", True),
        req(2 * day, "blacklist"), req(2 * day + 1, "whitelist"), req(2 * day + 2, "drop"),
        req(3 * day + 6, "blacklist"), req(9 * day, "quarantine"),
        req(2 * day, "blacklist", ip="other"), req(30.0, "none", None)], schemas.POLICY_REQUEST)
    ok, bad = commands.apply_ip_policies(requests, admin)
    assert rows(bad, "ts", "error") == [
        (10.0, "h is tagged CRITICAL. Resubmit with confirm_critical=true to proceed."),
        (2 * day, "h is tagged CRITICAL. Resubmit with confirm_critical=true to proceed."),
        (2 * day + 2, "Invalid policy")]
    assert rows(ok, "ts", "policy", "enforcement_status") == [
        (5.0, "blacklist", "stubbed"), (20.0, "blacklist", "stubbed"),
        (30.0, "none", "not_applicable"), (2 * day, "blacklist", "stubbed"),
        (2 * day + 1, "whitelist", "not_applicable"), (3 * day + 6, "blacklist", "stubbed"),
        (9 * day, "quarantine", "stubbed")]
