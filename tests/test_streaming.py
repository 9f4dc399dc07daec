import json
import os
import random

import pytest
from conftest import rows

from gridwarden import schemas, sinks, streaming
from gridwarden.functions import event_time
from gridwarden.operators import correlate, ingest, state, vectors
from gridwarden.session import materialize, scratch, shared_dir
from gridwarden.streaming import jobs
from gridwarden.sources import read_logs, read_table, split_rejects
from pyspark.sql import functions as F

ONCE = {"availableNow": True}


def write(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(
        (r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def conn_record(i):
    return {"ts": 1000.0 + i, "id.orig_h": f"10.0.0.{i % 5}", "id.resp_h": f"192.168.0.{i % 7}",
            "id.resp_p": (502, 80, 53)[i % 3], "service": ("", "HTTP", "dns")[i % 3],
            "conn_state": "S0" if i % 4 == 0 else "SF"}


def leftovers(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_scratch_deletes_what_was_written_inside(spark):
    before = leftovers(spark)
    outside = materialize(spark.range(3), "outside")
    with scratch(spark):
        assert materialize(spark.range(5), "inside").count() == 5
        with scratch(spark):
            materialize(spark.range(2), "nested")
        assert {n.split("-")[0] for n in leftovers(spark) - before} == {"outside", "inside"}
    with pytest.raises(ValueError), scratch(spark):
        materialize(spark.range(2), "failed")
        raise ValueError
    assert {n.split("-")[0] for n in leftovers(spark) - before} == {"outside"}
    assert outside.count() == 3


def test_totals_and_hosts_survive_a_restart(spark, tmp_path):
    logs, root, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    for i in range(4):
        write(logs, f"{i}.log", [conn_record(n) for n in range(i * 30, i * 30 + 30)] + ["{oops"])

    def run():
        streaming.stream_connections(
            spark, str(logs), root, checkpoint, ONCE, files_per_trigger=1).awaitTermination()

    run()
    write(logs, "later.log", [conn_record(n) for n in range(500, 520)])
    run()  # goes on from the checkpoint
    run()  # nothing new

    good, _ = split_rejects(read_logs(spark, str(logs), "conn"), ingest.valid_conn())
    conn = ingest.normalize_conn(good)
    assert rows(streaming.read_totals(spark, root)) == rows(
        ingest.connection_stats(conn))
    seen = read_table(spark, root, "asset_observations")
    assert rows(state.collapse_assets(seen)) == rows(state.collapse_assets(
        ingest.asset_observations(conn)))
    rejects = spark.read.parquet(f"{root}/rejects/conn")
    assert rejects.where("_corrupt_record = '{oops'").count() == 4


def test_one_file_or_many_give_the_same_alerts(spark, tmp_path):
    records = [{"ts": i, "note": f"N{i % 3}", "msg": f"m{i}", "src": "s"} for i in range(40)]
    for name, parts in (("one", 1), ("many", 5)):
        for i in range(parts):
            write(tmp_path / name, f"{i}.log", records[i::parts])
        streaming.stream_alerts(
            spark, str(tmp_path / name), str(tmp_path / f"{name}-store"),
            str(tmp_path / f"{name}-cp"), ONCE, files_per_trigger=1).awaitTermination()
    one, many = (rows(read_table(spark, str(tmp_path / f"{n}-store"), "alerts"))
                 for n in ("one", "many"))
    assert one == many and len(one) == 40


def test_late_rows_beyond_the_watermark(spark, tmp_path):
    def part(name, values):
        df = spark.createDataFrame(values, "agent_id string, ts double, resp_p int")
        df.withColumn("event_time", event_time(F.col("ts"))).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(
            "agent_id string, ts double, resp_p int, event_time timestamp",
        ).parquet(str(tmp_path / "in"))
        streaming.stream_increments(
            stream, str(tmp_path / "out"), str(tmp_path / "cp"), watermark="1 minute",
            trigger=ONCE).awaitTermination()

    part("a", [("x", 10_000.0, 80), ("x", 10_001.0, 80), ("x", 10_500.0, 502)])
    run()
    part("b", [("x", 10_002.0, 80), ("x", 20_000.0, 80)])  # the first is far too late
    run()
    got = spark.read.schema(schemas.AGENT_CONNECTION_STATS).parquet(str(tmp_path / "out"))
    assert rows(got) == [("x", "IT", "http", 2, 10_020.0), ("x", "OT", "modbus", 1, 10_530.0)]


def test_late_rows_count_and_are_kept(spark, tmp_path):
    root, schema = str(tmp_path / "store"), "agent_id string, ts double, resp_p int"

    def run(*values):
        df = spark.createDataFrame(values, schema).withColumn("event_time", event_time(F.col("ts")))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f"{schema}, event_time timestamp").parquet(
            str(tmp_path / "in"))
        streaming.stream_late_increments(
            stream, root, str(tmp_path / "cp"), delay=60, trigger=ONCE).awaitTermination()
        late = spark.read.parquet(f"{root}/{jobs.LATE}")
        return rows(streaming.read_increments(spark, root)), rows(late, "agent_id", "ts")

    columns = [("x", "IT", "http", 10_020.0, 2), ("x", "OT", "modbus", 10_530.0, 1)]
    assert run(("x", 10_000.0, 80), ("x", 10_001.0, 80), ("x", 10_500.0, 502)) == (columns, [])
    # the interval of the first had ended a minute before 10,500, that of the second had not
    got, late = run(("x", 10_002.0, 80), ("x", 10_450.0, 80), ("x", 20_000.0, 80))
    assert got == [("x", "IT", "http", 10_020.0, 3), ("x", "IT", "http", 10_470.0, 1),
                   ("x", "IT", "http", 20_010.0, 1), columns[1]]
    assert late == [("x", 10_002.0)]


def test_matching_takes_all_rows_again_after_a_new_reference(spark, tmp_path):
    root = str(tmp_path / "store")
    encoder = vectors.hashing_encoder(16)

    def listed(*items):
        return spark.createDataFrame(
            [(i, c, k, d, s) for i, (c, k, d, s) in enumerate(items)],
            "pos long, cve_id string, keyword string, description string, cvss_score double")

    def software(*names):
        sinks.append(spark.createDataFrame(
            [(f"{n}-id", 1.0, "h", "t", n, "1") for n in names], schemas.SOFTWARE),
            root, "software")

    def run(cves):
        stream = spark.readStream.schema(schemas.SOFTWARE).parquet(f"{root}/software")
        streaming.stream_matches(
            stream, lambda: read_table(spark, root, "software"), root, "cve_descriptions",
            streaming.software_matcher(lambda: cves, encoder, "t"), "cve_matches",
            str(tmp_path / "cp"), ONCE).awaitTermination()
        return rows(read_table(spark, root, "cve_matches"), "source_key", "match_type")

    first = listed(("C1", "openssh", "remote login flaw", 5.0))
    sinks.replace(correlate.build_cve_reference(first, encoder), root, "cve_descriptions", 1.0)
    software("openssh")
    before = leftovers(spark)
    one = run(first)
    assert leftovers(spark) == before  # a micro-batch cleans up after itself
    assert ("h|openssh|C1", "fuzzy") in one
    software("nginx")
    two = run(first)
    assert set(one) <= set(two) and len(two) == len({k for k, _ in two})
    second = listed(("C1", "openssh", "remote login flaw", 5.0), ("C2", "openssh", "other", 1.0))
    sinks.replace(correlate.build_cve_reference(second, encoder), root, "cve_descriptions", 2.0)
    software("zlib")
    three = run(second)
    assert ("h|openssh|C2", "fuzzy") in three  # an old row gained a match
    assert len(three) == len({k for k, _ in three}) and set(two) <= set(three)


def test_matches_follow_software_and_list(spark, tmp_path, monkeypatch):
    """After every batch the matches are those of all software and the newest list; only what
    is new is scored."""
    from gridwarden.streaming import matching
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    encoder, rng = vectors.hashing_encoder(16), random.Random(5)
    words = ["openssh", "nginx", "zlib", "curl", "bash", "perl", "remote", "flaw", "login"]
    scored = []
    scores = matching.fuzzy_scores

    def counted(texts, keywords, threshold):
        scored.append((texts.count(), keywords.count()))
        return scores(texts, keywords, threshold)

    monkeypatch.setattr(matching, "fuzzy_scores", counted)
    texts = ["{} {}".format(*rng.sample(words, 2)) for _ in range(12)]
    listed = [(i, f"C{i % 8}", rng.choice(words), rng.choice(texts), float(i)) for i in range(12)]
    names = "pos long, cve_id string, keyword string, description string, cvss_score double"
    seen = []
    for turn in range(4):
        if turn in (1, 3):  # some go, some change, some come; positions move
            listed = [x for x in listed if rng.random() < 0.7]
            listed = [(p, c, k if rng.random() < 0.8 else rng.choice(words),
                       d if rng.random() < 0.8 else rng.choice(texts) + " again", v)
                      for p, c, k, d, v in listed]
            listed += [(0, f"C{rng.randrange(12)}", rng.choice(words), rng.choice(texts), 2.0)
                       for _ in range(3)]
            rng.shuffle(listed)
            listed = [(i, *x[1:]) for i, x in enumerate(listed)]
        cves = spark.createDataFrame(listed, names)
        if turn != 2:
            sinks.replace(cves, root, "cve_list", float(turn))
        more = [(f"{turn}-{i}" if turn < 3 else f"0-{i}-", 1.0, f"h{rng.randrange(3)}", "t",
                 rng.choice(words), rng.choice(["1", "2", "flaw", ""])) for i in range(6)]
        seen += more
        sinks.append(spark.createDataFrame(more, schemas.SOFTWARE), root, "software")
        stream = spark.readStream.schema(schemas.SOFTWARE).parquet(f"{root}/software")
        before = leftovers(spark)
        scored.clear()
        streaming.stream_software_matches(
            stream, root, encoder, "t", checkpoint, ONCE).awaitTermination()
        assert leftovers(spark) == before
        software = spark.createDataFrame(seen, schemas.SOFTWARE)
        want = correlate.match_software(
            software, cves, correlate.build_cve_reference(cves, encoder), encoder, "t")
        assert rows(streaming.read_matches(spark, root, checkpoint), *want.columns) == rows(want)
        if turn == 2:
            assert len(scored) == 1  # the list is as it was: known texts are left alone
    # a replayed batch changes nothing
    path = matching._path(spark, root, checkpoint)
    got = rows(streaming.read_matches(spark, root, checkpoint))
    batch = spark.createDataFrame(more, schemas.SOFTWARE)
    matching.update_matches(batch, 3, root, path, encoder, "t")
    assert rows(streaming.read_matches(spark, root, checkpoint)) == got


def test_changes_of_a_product_are_one_row(spark, tmp_path):
    """Matches are kept without scores, descriptions and ids, one row per product and batch;
    reading shuffles only these, once. Unlisted and withdrawn vulnerabilities go, others stay."""
    from gridwarden.streaming import matching
    root, path, encoder = str(tmp_path / "store"), str(tmp_path / "state"), vectors.hashing_encoder(16)
    names = "pos long, cve_id string, keyword string, description string, cvss_score double"
    no_id = (8, None, "openssh", "no id", 8.0)
    first = [(i, f"C{i}", "openssh", f"flaw {i} in openssh", float(i)) for i in range(6)]
    second = [(0, "C0", "openssh", "told otherwise", 9.0), *first[1:4],
              (7, "C7", "nginx", "flaw in nginx", 7.0), no_id]
    seen = []
    for batch_id, (listed, hosts) in enumerate(
            [([*first, no_id], ("h0", "h1", None)), (second, ("h1", "h2"))]):
        cves = spark.createDataFrame(listed, names)
        sinks.replace(cves, root, "cve_list", float(batch_id))
        more = [(f"{batch_id}-{h}-{n}", 1.0, h, "t", n, "1") for h in hosts
                for n in ("openssh", "nginx")]
        more += more[:1]
        seen += more
        matching.update_matches(spark.createDataFrame(more, schemas.SOFTWARE), batch_id, root,
                                path, encoder, f"t{batch_id}")
        software = spark.createDataFrame(seen, schemas.SOFTWARE)
        want = correlate.match_software(
            software, cves, correlate.build_cve_reference(cves, encoder), encoder, "t")
        columns = [c for c in want.columns if c != "ts"]
        store = matching._Store(spark, path, 1 << 62)
        got = matching.read_stored(store)
        key = [x if x != "cve_id" else "coalesce(cve_id, '') AS cve_id" for x in columns]
        assert rows(got.selectExpr(*key)) == rows(want.selectExpr(*key))
    assert {(h, c, t) for h, c, t in rows(got.where("software = 'openssh 1' AND cve_id < 'C2'"),
                                          "host", "cve_id", "ts")} >= {
        ("h0", "C0", "t1"), ("h0", "C1", "t0"), ("h2", "C1", "t1")}
    stored = store.read("product_changes")
    assert stored.columns == ["host", "name", "ts", "changes", "batch"]
    assert stored.count() == stored.select("host", "name", "batch").distinct().count()
    plan = matching._live(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_installed_rows_are_dealt_once_and_changes_are_numbers(spark):
    """New rows meet known products in one shuffle; a product's changes hold the codes that are
    gone and found, and add up to its matches."""
    from gridwarden.streaming import matching
    new = spark.createDataFrame(
        [(i, 0.0, "h", "t", "ssh", v) for i, v in [("3", "1"), ("0", "2"), ("7", "2")]],
        schemas.SOFTWARE)
    known = spark.createDataFrame(
        [("h", "ssh", ["ssh 3", "ssh 1"], ["4", "5"]), ("h", "zip", ["zip"], ["1"])],
        matching._STATE["installed"])
    met = matching._installed(new, known)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(met, "name", "texts", "fresh.software", "fresh.id", "touched") == [
        ("ssh", ["ssh 2", "ssh 1", "ssh 3"], ["ssh 2", "ssh 1"], ["0", "3"], True),
        ("zip", ["zip"], [], [], False)]

    def found(*matches):
        return spark.createDataFrame(
            [("h", "ssh", list(matches))], "host string, name string, "
            "matches array<struct<software: string, codes: array<int>>>")

    stored = spark.createDataFrame([], matching._STATE["product_changes"] + ", batch bigint")
    wanted = [([], [("a", [2, 4]), ("b", [6])]), ([4, 6], [("b", [4, 9])]), ([2], [])]
    for batch, matches in enumerate([
            [("a", [2, 4]), ("b", [6])], [("a", [2]), ("b", [4, 9])], [("b", [4, 9])]]):
        changes = matching._differences(found(*matches), matching._live(stored), f"t{batch}")
        assert rows(changes, "changes.gone", "changes.live") == [wanted[batch]]
        stored = stored.unionByName(changes.withColumn("batch", F.lit(batch).cast("long")))
    assert rows(matching._matches(matching._live(stored)), "ts", "software", "no", "match_rank") == [
        ("t1", "b", 2, 0), ("t1", "b", 4, 1)]
