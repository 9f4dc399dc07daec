import json
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwarden.operators import correlate, fuzzy, vectors
from gridwarden.session import materialize
from gridwarden.sources import flatten_nvd, flatten_stix, load_nvd, load_stix

CVE = "pos long, cve_id string, keyword string, description string, cvss_score double"
SOFTWARE = "id string, ts double, host string, software_type string, name string, " \
           "unparsed_version string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def slow_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for s, t in {(a, b), (b, a)}:
        if len(s) > len(t):
            continue
        m, n = len(s), len(t)
        windows = [t[i:i + m] for i in range(n - m + 1)]
        windows += [t[:i] for i in range(1, m)] + [t[-i:] for i in range(1, m)]
        best = max([best] + [200.0 * lcs(s, w) / (m + len(w)) for w in windows])
    return best


def words(seed, n, alphabet="abcde ", longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest + 1)))
            for _ in range(n)]


def test_ratio_of_known_pairs():
    assert fuzzy.partial_ratio("openssh 8.2p1", "openssh") == 100.0
    assert fuzzy.partial_ratio("abc", "") == 0.0
    assert fuzzy.partial_ratio("", "") == 100.0
    assert fuzzy.partial_ratio("abcd", "xbcd") == slow_ratio("abcd", "xbcd")
    assert fuzzy.partial_ratio("é" * 70 + "x", "é" * 69) == 100.0


def test_ratio_against_plain_dynamic_programming():
    texts, keywords = words(1, 90), words(2, 60)
    want = {(t, k): slow_ratio(t, k) for t in texts for k in keywords}
    for t in texts:
        for k in keywords:
            assert fuzzy.partial_ratio(t, k) == pytest.approx(want[t, k])
    t, k, score = fuzzy.score_pairs(texts, keywords, 0)
    assert len(score) == len(texts) * len(keywords)
    for i, j, x in zip(t, k, score):
        assert x == pytest.approx(want[texts[i], keywords[j]])


def test_ratio_of_long_texts():
    texts = words(3, 6, "ab", 200) + ["a" * 63, "b" * 64, "ab" * 40]
    keywords = words(4, 6, "ab", 90) + ["a" * 64, "a" * 63]
    t, k, score = fuzzy.score_pairs(texts, keywords, 0)
    for i, j, x in zip(t, k, score):
        assert x == pytest.approx(slow_ratio(texts[i], keywords[j]))


def test_both_ways_of_joining_give_the_same(spark):
    texts = spark.createDataFrame([(x,) for x in words(5, 150) + ["ABC d"]], "text string")
    keywords = spark.createDataFrame([(x,) for x in words(6, 80) + ["abc"]], "keyword string")
    one = rows(fuzzy.fuzzy_scores(texts, keywords))
    many = rows(fuzzy.fuzzy_scores(
        texts, keywords, broadcast_keywords=3, left_rows=20, right_rows=9))
    assert one == many
    low = sorted({r[0].lower() for r in texts.collect()})
    assert one == sorted(
        (t, k, slow_ratio(t, k)) for t in low
        for k in {r[0].lower() for r in keywords.collect()} if slow_ratio(t, k) >= 70)


def vec_frame(spark, matrix, first=0):
    return spark.createDataFrame(
        [(i + first, [float(x) for x in v]) for i, v in enumerate(matrix)],
        "id long, vec array<float>")


def brute(queries, refs, k):
    out = []
    q64, r64 = np.asarray(queries, np.float32).astype(float), np.asarray(refs, np.float32).astype(float)
    for i, q in enumerate(q64):
        ranked = []
        for j, r in enumerate(r64):
            norm = np.sqrt((q * q).sum()) * np.sqrt((r * r).sum())
            if norm > 0:
                ranked.append((round(1 - (q * r).sum() / norm, 9) + 0.0, j))
        out += [(i, j, n + 1) for n, (_, j) in enumerate(sorted(ranked)[:k])]
    return sorted(out)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 4
    refs = np.vstack([centres[rng.integers(6, size=120)] + rng.normal(size=(120, 8)),
                      np.tile(centres[0], (40, 1)), np.zeros((2, 8))])
    queries = np.vstack([centres[rng.integers(6, size=50)] + rng.normal(size=(50, 8)),
                         np.tile(centres[0], (10, 1)), np.zeros((1, 8)), rng.normal(size=(5, 8))])
    qf, rf = vec_frame(spark, queries), vec_frame(spark, refs)
    for k in (1, 3):
        want = brute(queries, refs, k)
        for kw in ({}, {"cells": 5, "left_rows": 16, "right_rows": 16},
                   {"cells": 64, "left_rows": 999, "right_rows": 7}):
            got = vectors.nearest(qf, rf, k, **kw)
            assert rows(got, "query_id", "ref_id", "rank") == want


def test_fewer_references_than_neighbours(spark):
    qf = vec_frame(spark, [[1.0, 0.0], [0.0, 1.0]])
    rf = vec_frame(spark, [[1.0, 1.0], [2.0, 0.0]])
    for kw in ({}, {"cells": 4}):
        got = vectors.nearest(qf, rf, 3, **kw)
        assert rows(got, "query_id", "ref_id", "rank") == [
            (0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    assert vectors.nearest(qf, rf.where("false"), 3).count() == 0


def test_caller_model(spark):
    def factory():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])
    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "t string")
    got = vectors.embed(df, "t", vectors.model_encoder(factory, batch=1))
    assert sorted((r["t"] or "", r["embedding"]) for r in got.collect()) == [
        ("", None), ("aa", [2.0, 2.0]), ("aa", [2.0, 2.0]), ("b", [1.0, 0.0])]


def test_reference_rules(spark):
    items = spark.createDataFrame([
        (0, "C1", "old", "first", 5.0), (1, "C1", None, "last " + "x" * 2000, None),
        (2, "C2", "k", "", 1.0), (3, "", "k", "no id", 1.0), (4, None, "k", "no id", 1.0),
        (5, "C3", "k", None, 1.0)], CVE)
    got = correlate.build_cve_reference(items, vectors.hashing_encoder(8)).collect()
    assert len(got) == 1
    assert (got[0]["cve_id"], got[0]["keyword"], got[0]["cvss_score"]) == ("C1", "", 0.0)
    assert got[0]["description"] == "last " + "x" * 2000
    assert sum(got[0]["embedding"]) == 2.0


def _software(spark, *items):
    return spark.createDataFrame(
        [(i, 0.0, h, "t", n, v) for i, h, n, v in items], SOFTWARE)


def test_match_precedence(spark):
    cves = spark.createDataFrame([
        (0, "C1", "zzzzzz", "first listing", 1.0), (1, "C1", "openssh", "second listing", 7.5),
        (2, "C1", "openssh 8", "third listing", 9.0), (3, "C2", "nginx", "web", None),
        (4, "C3", "qqqq", "openssh openssh", 4.0)], CVE)
    software = _software(
        spark, ("2", "h", "openssh", "8"), ("1", "h", "openssh", ""), ("3", "h", "", ""),
        ("4", "g" * 70, "openssh", "9"))
    encoder = vectors.hashing_encoder(16)
    reference = correlate.build_cve_reference(cves, encoder)
    got = correlate.match_software(software, cves, reference, encoder, "2024-01-01T00:00:00")
    by_key = {r["source_key"]: r for r in got.collect()}
    first = by_key["h|openssh|C1"]
    # The lowest id matched first, under the first listed keyword that reaches 70.
    assert (first["software"], first["match_type"], first["description"]) == (
        "openssh", "fuzzy", "second listing")
    assert first["cvss_score"] == 7.5 and first["ts"] == "2024-01-01T00:00:00"
    nearest = by_key["h|openssh|C3"]
    assert (nearest["match_type"], nearest["description"]) == ("semantic", "openssh openssh")
    long = by_key["g" * 70 + "|openssh|C1"]
    assert len(long["id"]) == 28 and len({r["id"] for r in by_key.values()}) == len(by_key)
    assert not any(k.startswith("h||") for k in by_key)
    keyed = [r["source_key"] for r in got.collect()]
    assert len(keyed) == len(set(keyed))


def test_pages_give_positions(spark, tmp_path):
    def page(*items):
        return {"vulnerabilities": [{"cve": {"id": i, "descriptions": [
            {"lang": "en", "value": text}], "metrics": {}}} for i, text in items]}

    pages = {"keyword=b": [page(("C1", "late"), ("C2", "x"))],
             "keyword=a": [page(("C1", "early"), ("C3", "")), {"vulnerabilities": None}, page(),
                           page(("C4", "y"))]}
    for lines in (False, True):
        for folder, found in pages.items():
            path = tmp_path / str(lines) / folder
            path.mkdir(parents=True)
            if lines:
                (path / "all.json").write_text("".join(json.dumps(p) + "\n" for p in found))
            else:
                for i, p in enumerate(found):
                    (path / f"{i}.json").write_text(json.dumps(p, indent=1))
        listed = flatten_nvd(
            load_nvd(spark, str(tmp_path / str(lines)), lines, True), F.col("keyword"))
        assert rows(listed, "pos", "keyword", "cve_id", "description") == [
            (0, "a", "C1", "early"), (1, "a", "C3", ""), (2, "a", "C4", "y"),
            (3, "b", "C1", "late"), (4, "b", "C2", "x")]
        reference = correlate.build_cve_reference(listed, vectors.hashing_encoder(8))
        assert rows(reference, "cve_id", "description", "keyword") == [
            ("C1", "late", "b"), ("C2", "x", "b"), ("C4", "y", "a")]


def test_bundles_give_positions(spark, tmp_path):
    def pattern(i, name, **more):
        return {"type": "attack-pattern", "name": name, "description": name, "external_references": [
            {"source_name": "mitre-attack", "external_id": i}], **more}

    for i, objects in enumerate([[pattern("T1", "a"), {"type": "malware"}, pattern("T2", "b")],
                                 [pattern("T1", "c"), pattern("T3", "d", revoked=True)]]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"objects": objects}))
    listed = flatten_stix(load_stix(spark, str(tmp_path), positions=True))
    assert rows(listed, "pos", "technique_id", "name") == [
        (0, "T1", "a"), (2, "T2", "b"), (3, "T1", "c")]
    reference = correlate.build_technique_reference(listed, vectors.hashing_encoder(8))
    assert rows(reference, "technique_id", "name") == [("T1", "c"), ("T2", "b")]


def test_no_back_fill_beyond_the_nearest(spark):
    reference = spark.createDataFrame([
        ("A", "a", [1.0, 0.0], "", 0.0), ("B", "b", [1.0, 0.1], "", 0.0),
        ("C", "c", [-1.0, 0.0], "", 0.0), ("D", "d", [0.9, 0.3], "", 0.0)],
        "cve_id string, description string, embedding array<float>, keyword string, "
        "cvss_score float")
    software = _software(spark, ("1", "h", "n", "v"))
    texts = spark.createDataFrame([("n v", [-1.0, -0.05])], "text string, embedding array<float>")
    got = correlate.semantic_match(software, reference, vectors=texts)
    assert rows(got, "cve_id", "pos") == [("C", 1)]  # the other two of three lie beyond 1.1


def test_techniques(spark):
    alerts = spark.createDataFrame([
        ("1", 0.0, "modbus", "write coil", "s", "d", "HIGH", "OT", "z"),
        ("2", 0.0, "modbus", "write coil", "s", "d", "Critical", "OT", "z"),
        ("3", 0.0, "modbus", "write coil", "s", "d", "medium", "OT", "z")],
        "id string, ts double, note_type string, message string, src_h string, dst_h string, "
        "severity string, zone string, source string")
    items = spark.createDataFrame([
        (0, "T1", "Write", "impact", "modbus write coil now"), (1, "T2", "Other", "x", "phishing")],
        "pos long, technique_id string, name string, tactic string, description string")
    encoder = vectors.hashing_encoder(1024)
    got = correlate.match_techniques(
        alerts, correlate.build_technique_reference(items, encoder), encoder, "t")
    assert rows(got, "source_key", "technique_name", "alert_severity") == [
        ("1|T1", "Write", "HIGH"), ("2|T1", "Write", "Critical")]
    wordless = alerts.withColumn("note_type", F.lit("")).withColumn("message", F.lit("."))
    left = correlate.match_techniques(
        wordless, correlate.build_technique_reference(items, encoder), encoder, "t")
    assert rows(left, "source_key", "similarity") == [("1|T1", 0.0), ("2|T1", 0.0)]
    # 3 shared words of 3 and 4
    assert abs(got.first()["similarity"] - 0.866) < 1e-6


def test_cosine_of_zero_vector_is_null(spark):
    from gridwarden.functions import cosine_distance
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 1.0]


def test_first_matches_stay_with_their_product(spark, monkeypatch):
    """Wide rows, one per product and vulnerability, are not shuffled; more pairs than are sent
    to every task give the same rows."""
    installed = correlate.numbered(spark.createDataFrame(
        [(f"h{i % 7}", f"n{i % 3}", f"t{i % 5}", str(i)) for i in range(60)],
        "host string, name string, software string, id string").groupBy(
        "host", "name", "software").agg({"id": "min"}).withColumnRenamed("min(id)", "id"))
    fuzzy_pairs = spark.createDataFrame(
        [(f"t{i % 5}", f"c{i % 11}", i) for i in range(40)], "software string, cve_id string, pos long")
    near = spark.createDataFrame(
        [(f"t{i}", f"c{i + 8}", 1) for i in range(5)], "software string, cve_id string, pos long")
    columns = ["host", "name", "cve_id", "software", "id", "match_rank", "pos"]
    found = correlate.first_per_key(installed, fuzzy_pairs, near)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and (
        "cve_id" in line or "version_no" in line)]
    monkeypatch.setattr(correlate, "BROADCAST_PAIRS", 0)
    other = correlate.first_per_key(installed, fuzzy_pairs, near)
    assert rows(found, *columns) == rows(other, *columns) != []
    versions = {}
    for r in installed.collect():
        versions.setdefault((r.host, r.name), []).append((r.version_no, r.software, r.id))
    pairs = [(r.software, r.cve_id, rank, r.pos) for rank, p in enumerate((fuzzy_pairs, near))
             for r in p.collect()]
    expected = {}
    for product, listed in versions.items():
        for no, text, i in sorted(listed):
            for software, cve, rank, pos in sorted(pairs, key=lambda x: x[2:]):
                if software == text:
                    expected.setdefault((*product, cve), (text, i, rank, pos))
    assert rows(found, *columns) == sorted((*k, *v) for k, v in expected.items())


def test_pieces_of_a_cell_do_not_multiply_the_shuffle(spark):
    """What is dealt out grows with the rows, not with the number of pieces."""
    from gridwarden.operators.blocks import cell_join
    left = spark.range(1000).selectExpr("id", "0 AS cell")
    right = spark.range(500).selectExpr("id", "0 AS cell")

    def sizes(a, b):
        import pyarrow as pa
        return pa.table({"n": [len(a) * len(b)], "rows": [len(b)]})

    def joined(pieces):
        return cell_join(left, right, "id", "id", pieces, pieces, sizes, "n long, rows long")

    for pieces in (7, 1000):
        assert joined(pieces).agg({"n": "sum"}).first()[0] == 500_000
        assert joined(pieces).agg({"rows": "max"}).first()[0] <= pieces

    def once(a, b):
        import pyarrow as pa
        return pa.table({"n": [len(b)], "rows": [len(a)]})

    # Every left row comes to one task, and finds the whole right side there.
    met = cell_join(left, right, "id", "id", 1, 500, once, "n long, rows long")
    assert met.agg({"rows": "sum", "n": "min"}).first() == (1000, 500)
    assert "CoGroup" not in met._jdf.queryExecution().executedPlan().toString()


def test_products_are_shuffled_once_and_are_one_row(spark):
    """Software is dealt by its products once, however often it repeats; what is kept of it and
    shuffled again is one row per product."""
    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    software = spark.createDataFrame(
        [(i, 0.0, "h", "t", n, v) for i, n, v in [
            ("5", "ssh", "1"), ("2", "ssh", "2"), ("9", "ssh", "2"), ("1", "ssh", None),
            ("3", "zip", "1"), ("4", None, "")]], SOFTWARE)
    products = correlate.by_product(correlate.installed_texts(software))
    assert shuffles(products) == 1
    assert rows(products) == [
        ("h", "ssh", ["ssh", "ssh 2", "ssh 1"], ["1", "2", "5"]), ("h", "zip", ["zip 1"], ["3"])]
    pairs = spark.createDataFrame(
        [("ssh 1", "C1", 0), ("ssh 2", "C1", 3), ("ssh 2", None, 4), ("zip 1", "C1", 1)],
        "software string, cve_id string, pos long")
    kept = materialize(products, "products")
    found = correlate.first_per_product(kept.drop("ids"), pairs)
    assert shuffles(found) == 1
    columns = ["name", "software", "pos"]
    assert rows(found, *columns) == [("ssh", "ssh 2", 3), ("ssh", "ssh 2", 4), ("zip", "zip 1", 1)]
    assert rows(correlate.first_per_product(kept, pairs), *columns, "id") == [
        ("ssh", "ssh 2", 3, "2"), ("ssh", "ssh 2", 4, "2"), ("zip", "zip 1", 1, "3")]


def test_neighbours_are_screened_in_single_precision(monkeypatch):
    """Nearest references are those of double precision, also among equal and all but equal ones;
    most are ruled out without being measured, and each piece's references are prepared once."""
    rng = np.random.default_rng(3)

    def units(n):
        m = rng.normal(size=(n, 16))
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    queries, refs = units(60), units(3000)
    refs[100:200] = refs[0]  # equal ones
    refs[300:400] = refs[0] + 1e-7 * units(100)
    refs[300:400] /= np.sqrt((refs[300:400] ** 2).sum(axis=1, keepdims=True))
    queries[0] = refs[0]
    dist = np.round(1.0 - queries @ refs.T, 9) + 0.0
    measured = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: measured.append(len(a)) or einsum(how, a, b))
    for far, right_rows in ((9.0, 32), (9.0, 5000), (0.3, 64)):
        measured.clear()
        row, ref, value, rank = vectors._top_k(
            queries, refs, refs.astype(np.float32), np.full(60, far), 3, right_rows)
        want = [(i, j, n + 1, dist[i, j]) for i in range(60)
                for n, j in enumerate(np.argsort(dist[i], kind="stable")[:3]) if dist[i, j] <= far]
        assert list(zip(row, ref, rank, value)) == want
        assert sum(measured) < dist.size / 20
