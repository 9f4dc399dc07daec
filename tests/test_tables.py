import datetime
import json
import os
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwarden import schemas, session, sinks
from gridwarden.plans import expressions
from gridwarden.sinks import tables
from gridwarden.sinks.tables import with_event_date
from gridwarden.sources import (
    flatten_nvd, flatten_stix, load_nvd, load_reference, load_reference_lines, load_stix,
    read_snapshot, read_table,
)


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    df = spark.range(5).select(F.col("id").cast("string").alias("ip"), F.lit("IT").alias("zone"))
    for batch in (0, 1, 1):
        sinks.append_once(df, str(tmp_path), "asset_observations", batch, "one")
    got = read_table(spark, str(tmp_path), "asset_observations")
    assert got.count() == 10 and got.where("first_seen IS NULL").count() == 10


def test_writers_do_not_touch_each_other(spark, tmp_path):
    df = spark.range(2).select(F.col("id").cast("string").alias("ip"))
    root = str(tmp_path)
    sinks.append(df, root, "asset_observations")
    for producer in ("one", "two"):
        sinks.append_once(df, root, "asset_observations", 0, producer)
    sinks.append(df, root, "asset_observations")
    assert read_table(spark, root, "asset_observations").count() == 8


def test_failed_write_fails(spark, tmp_path):
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("ip"))
    with pytest.raises(Exception):
        sinks.append(bad, str(tmp_path), "asset_observations")


def test_snapshot_versions(spark, tmp_path):
    stats = spark.createDataFrame([("IT", "a", 1)], schemas.CONNECTION_STATS)
    root = str(tmp_path)
    sinks.replace(stats, root, "connection_stats", 1.0)
    before = read_snapshot(spark, root, "connection_stats")
    sinks.replace(stats.withColumn("count", F.lit(2)), root, "connection_stats", 2.0)
    assert rows(read_snapshot(spark, root, "connection_stats")) == [("IT", "a", 2)]
    assert rows(before) == [("IT", "a", 1)]  # an open reader keeps its version


def test_kept_rows_read_only_what_is_new(spark, tmp_path):
    root = str(tmp_path)
    def actions(*given):
        return spark.createDataFrame(
            [(i, a, "allow", "x", "", "", "", t) for i, a, t in given], schemas.ALERT_ACTIONS)
    def refresh():
        n = sinks.refresh_latest(spark, root, "alert_actions", margin=0)
        return n, rows(read_snapshot(spark, root, "latest_alert_actions"), "alert_id", "id")
    sinks.append(actions(("1", "a", 5.0), ("2", "a", 5.0), ("3", "b", 1.0)).coalesce(1),
                 root, "alert_actions")
    old = [f for f in _stored_files(root, "alert_actions")]
    for f in old:  # written an hour ago
        os.utime(f, (0, int(f.stat().st_mtime) - 3600))
    assert refresh() == (1, [("a", "2"), ("b", "3")])
    assert refresh()[0] == 0
    sinks.append(actions(("4", "b", 0.5), ("1", "a", 5.0), ("0", "c", 9.0)).coalesce(1),
                 root, "alert_actions")
    assert refresh() == (1, [("a", "2"), ("b", "3"), ("c", "0")])


def test_append_new(spark, tmp_path):
    root = str(tmp_path)
    def matches(*keys):
        return spark.createDataFrame([(k,) for k in keys], "source_key string")
    sinks.append_new(matches("a", "a", "b"), root, "cve_matches")
    sinks.append_new(matches("b", "c"), root, "cve_matches")
    assert rows(read_table(spark, root, "cve_matches", ["source_key"])) == [
        ("a",), ("b",), ("c",)]


def test_append_new_by_key(spark):
    def matches(*keys):
        return spark.createDataFrame([(k, "fuzzy") for k in keys], "source_key string, match_type string")
    for keys in (("a", "a", "b"), ("b", "c"), ("c", "a"), ()):
        sinks.append_new_by_key(matches(*keys), "matches_by_key", "cve_matches", 6)
    stored = spark.table("matches_by_key")
    assert rows(stored, "source_key") == [("a",), ("b",), ("c",)]
    assert stored.columns == schemas.TABLES["cve_matches"].names
    many = spark.range(300).selectExpr("CAST(id % 100 AS STRING) AS source_key")
    sinks.append_new_by_key(many, "matches_by_key", "cve_matches", 99)  # it keeps its 6 buckets
    assert spark.table("matches_by_key").count() == 103
    new = sinks.to_table(many, "cve_matches").dropDuplicates(["source_key"])
    plan = sinks.unseen_in_buckets(new, spark.table("matches_by_key"), 6)._jdf.queryExecution(
        ).executedPlan().toString()
    # The stored keys are read bucket by bucket, without an exchange.
    stored_side = plan.split("Range (")[1]
    assert "SelectedBucketsCount: 6 out of 6" in stored_side
    assert "FileScan" in stored_side and "Exchange" not in stored_side



def test_old_days_are_dropped(spark):
    day = 86400.0
    alerts = spark.createDataFrame(
        [(str(i), i * day + 5, "n", "m", "s", "d", "high", "IT", "z") for i in range(12)],
        schemas.ALERTS)
    sinks.write_by_date(alerts, "alerts_by_day")
    dropped = sinks.drop_expired(spark, "alerts_by_day", 7, 11 * day + 100)
    assert dropped == ["1970-01-01", "1970-01-02", "1970-01-03", "1970-01-04"]
    assert spark.table("alerts_by_day").agg(F.min("ts")).first()[0] == 4 * day + 5
    assert sinks.retain(alerts, 7, 11 * day + 5).count() == 8
    assert sinks.retain(with_event_date(alerts), 7, 11 * day + 5).count() == 8


def _stored_files(root, table):
    return [f for f in Path(root, table).rglob("*.parquet")]


def test_many_small_batches_are_merged(spark, tmp_path):
    root, day = str(tmp_path), 86400.0
    for batch in range(24):  # each over two of five days
        rows_of = spark.createDataFrame(
            [(f"{batch}-{i}", (batch + i) % 5 * day + 50.0 * i, "n", "m", "s", "d", "high", "IT", "z")
             for i in range(2)] + ([("none", None, "n", "m", "s", "d", "high", "IT", "z")]
                                   if batch == 3 else []), schemas.ALERTS).coalesce(1)
        sinks.append_once(rows_of, root, "alerts", batch, "one")
    want = rows(read_table(spark, root, "alerts"))
    assert len(want) == 49 and len(_stored_files(root, "alerts")) == 49
    days = [f"1970-01-0{i}" for i in range(1, 5)]
    assert sinks.merge_days(spark, root, "alerts", 4 * day + 9) == days  # the last day is open
    assert rows(read_table(spark, root, "alerts")) == want
    files = _stored_files(root, "alerts")
    assert sum("part=merged" in str(f) for f in files) <= 8
    assert sum("part=merged" not in str(f) for f in files) == 10
    assert sinks.merge_days(spark, root, "alerts", 4 * day + 9) == []
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) in (
        ["alerts"], ["_merging", "_replaced", "alerts"])
    late = spark.createDataFrame(
        [("late", 3.0, "n", "m", "s", "d", "high", "IT", "z")], schemas.ALERTS)
    sinks.append(late, root, "alerts")
    assert sinks.merge_days(spark, root, "alerts", 4 * day + 9) == days[:1]
    assert len(rows(read_table(spark, root, "alerts"))) == 50
    recent = read_table(spark, root, "alerts", since=datetime.date(1970, 1, 3))
    assert recent.agg(F.min("ts")).first()[0] >= 2 * day
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    assert sinks.drop_days(spark, root, "alerts", 2, 4 * day) == days[:2]
    assert read_table(spark, root, "alerts").where("ts < 172800").count() == 0
    assert read_table(spark, root, "alerts").where("ts IS NULL").count() == 1


def test_an_unfinished_merge_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    def alerts(*ids):
        return spark.createDataFrame(
            [(i, 5.0, "n", "m", "s", "d", "high", "IT", "z") for i in ids], schemas.ALERTS)
    for batch, name in enumerate("ab"):
        sinks.append_once(alerts(name), root, "alerts", batch, "one")
    finish = tables._finish
    monkeypatch.setattr(tables, "_finish", lambda *a: None)
    sinks.merge_days(spark, root, "alerts", 1e6)
    # the job died between the two moves of the day
    (tmp_path / "_replaced" / "alerts").mkdir(parents=True)
    (tmp_path / "alerts" / "event_date=1970-01-01").rename(
        tmp_path / "_replaced" / "alerts" / "event_date=1970-01-01")
    monkeypatch.setattr(tables, "_finish", finish)
    assert sinks.merge_days(spark, root, "alerts", 1e6) == []
    assert rows(read_table(spark, root, "alerts", ["id"])) == [("a",), ("b",)]
    # a merge that was never completed is dropped
    (tmp_path / "_merging" / "alerts" / "event_date=1970-01-01").mkdir(parents=True)
    assert sinks.merge_days(spark, root, "alerts", 1e6) == []
    assert rows(read_table(spark, root, "alerts", ["id"])) == [("a",), ("b",)]


def test_nvd_metrics(spark, tmp_path):
    def cve(name, metrics, descriptions=({"lang": "en", "value": "text"},)):
        return {"cve": {"id": name, "descriptions": list(descriptions), "metrics": metrics}}
    def metric(score):
        return [{"cvssData": {"baseScore": score}}, {"cvssData": {"baseScore": 0.1}}]
    page = {"vulnerabilities": [
        cve("A", {"cvssMetricV31": [], "cvssMetricV30": metric(6.5)}),
        cve("B", {"cvssMetricV31": [{"cvssData": {}}], "cvssMetricV2": metric(2.0)}),
        cve("C", {"cvssMetricV2": metric(2.0)}, [{"lang": "es", "value": "x"}]),
        cve("D", {}, [{"lang": "es", "value": "x"}, {"lang": "en", "value": "1"},
                      {"lang": "en", "value": "2"}])]}
    (tmp_path / "page.json").write_text(json.dumps(page, indent=1))
    assert rows(flatten_nvd(load_nvd(spark, str(tmp_path)), "kw")) == [
        ("A", "kw", "text", 6.5), ("B", "kw", "text", None), ("C", "kw", "", 2.0),
        ("D", "kw", "1", None)]


def test_stix_objects(spark, tmp_path):
    def obj(i, **more):
        ref = {"source_name": "mitre-attack", "external_id": f"T{i}"}
        return {"type": "attack-pattern", "name": f"n{i}", "description": "d" * 900,
                "external_references": [{"source_name": "x", "external_id": "no"}, ref], **more}
    bundle = {"objects": [
        obj(1, kill_chain_phases=[{"phase_name": "a"}, {"phase_name": "b"}]),
        obj(2, revoked=True), obj(3, x_mitre_deprecated=True),
        obj(4, external_references=[{"source_name": "x", "external_id": "no"}]),
        obj(5, type="malware"), obj(6, revoked=False)]}
    (tmp_path / "stix.json").write_text(json.dumps(bundle, indent=1))
    assert rows(flatten_stix(load_stix(spark, str(tmp_path)))) == [
        ("T1", "n1", "a, b", "d" * 900), ("T6", "n6", "", "d" * 900)]


def test_reference_cache(spark, tmp_path):
    assert load_reference(spark, f"{tmp_path}/cve.json", "cve").count() == 0
    (tmp_path / "cve.json").write_text(json.dumps(
        [{"cve_id": "A", "keyword": "k", "description": "d", "cvss_score": None},
         {"cve_id": "B", "keyword": "k", "description": "d", "cvss_score": 1.5}], indent=2))
    assert rows(load_reference(spark, f"{tmp_path}/cve.json", "cve")) == [
        (0, "A", "k", "d", None), (1, "B", "k", "d", 1.5)]
    (tmp_path / "later.json").write_text(json.dumps([{"cve_id": "C"}]))
    assert rows(load_reference(spark, f"{tmp_path}/*.json", "cve"), "pos", "cve_id") == [
        (0, "A"), (1, "B"), (2, "C")]


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    one, two = session.fresh_path(spark, "x"), session.fresh_path(spark, "x")
    assert one != two and one.startswith(session.shared_dir(spark))


def test_reference_lines_in_several_parts(spark, tmp_path):
    lines = ['{"cve_id": "%d", "description": "%s"}' % (i, "a\\nb" * (i % 50)) for i in range(900)]
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("\n".join(lines[300 * k:300 * k + 300]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = load_reference_lines(spark, f"{tmp_path}/*.json", "cve").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.pos, r.cve_id) for r in found) == [(i, str(i)) for i in range(900)]
    assert load_reference_lines(spark, f"{tmp_path}/none*.json", "cve").count() == 0


def test_conn_log_is_written_by_every_task(spark, tmp_path, monkeypatch):
    conn = expressions.A.conn
    monkeypatch.setattr(expressions.A, "conn", lambda *a: conn(*a).repartition(3))
    expressions.write_conn_log(spark, "/root/testdata/sf0.001", f"{tmp_path}/log")
    assert len(list((tmp_path / "log").glob("part-*"))) == 3
