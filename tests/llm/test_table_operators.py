"""Operators on whole tables: near-duplicates, packing, sharding, archives, the pipeline."""

import random

import brute
import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from gridwarden.llm import packing, queries, sharding, simhash, warc
from gridwarden.llm.shared import find_spans
from gridwarden.session import fresh_path

SF = "/root/testdata/sf0.001"


def test_fingerprints_and_classes(docs, none, same):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = [brute.fingerprint(t) for _, t in rows]
    low = {}
    for (i, _), c in zip(rows, brute.classes(marks)):
        low[c] = min(low.get(c, 10**9), 10**9 if i is None else i)
    wanted = [(i, f"{m:016x}", low[c]) for (i, _), m, c in zip(rows, marks, brute.classes(marks))]
    got = simhash.classes(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"), "component_id")
    same(got.collect(), wanted)
    assert simhash.classes(none).count() == 0


def test_one_of_each(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    wanted = {r.component_id for r in simhash.classes(docs).collect()}
    assert sorted(ids) == sorted(wanted)
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("crowd", [1000, 3])
def test_near_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    marks = set(seeds)
    for seed in seeds:
        for _ in range(8):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                seed ^= 1 << bit if rng.random() < 0.5 else 0
            marks.add(seed)
    marks = sorted(marks)
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = simhash.near_pairs(spark.createDataFrame(signed, "fingerprint long"))
    trees = {r.node: r.root for r in simhash.components(links).collect()}
    roots = [trees.get(s, s) for s, in signed]
    wanted = brute.classes(marks)
    assert len(set(roots)) == len(set(wanted)) == len(set(zip(roots, wanted)))


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(docs, capacity=64).collect()
    wanted = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        wanted += [(r.doc_id, start, len(p), brute.crc(p)) for start, p in brute.pieces(ids, 64)]
    import zlib
    got = [(r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 64
    assert len(full) <= 1.02 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_documents(none).count() == 0


def test_ids_of_the_added_token():
    import public_tokenizers
    from tokenizers import Tokenizer

    from gridwarden.llm.tokens import token_encoder
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encode = token_encoder()
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n  é", "<|end", ""):
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids


def test_genetic_steps_keep_every_document():
    rng = random.Random(2)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    people = packing.evolve([], counts, 100, 8, 5, rng)
    for solution in people:
        placed = {}
        for pattern, n in solution.items():
            assert n > 0 and sum(pattern) <= 100
            for length in pattern:
                placed[length] = placed.get(length, 0) + n
        assert placed == counts
    assert packing.fitness(people[0], 100) <= packing.fitness(packing.best_fit(counts, 100), 100)


def test_hilbert_steps_are_neighbours():
    side = np.arange(16)
    cells = [a.ravel() for a in np.meshgrid(side, side, side)]
    index = sharding.hilbert_index(cells, 4)
    assert sorted(index) == list(range(16 ** 3))
    path = np.stack(cells)[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards_of_strings_with_a_common_prefix(spark):
    rows = spark.createDataFrame(
        [(i, f"https://example.org/{i % 10}", None if i == 7 else (i * 37) % 1000)
         for i in range(1000)], "doc_id int, source string, size int").repartition(3)
    found = sharding.hilbert_shards(rows, ("source", "size"), ("doc_id",), shards=4).groupBy(
        "shard").agg(F.count_distinct("source").alias("sources"),
                     (F.max("size") - F.min("size")).alias("range")).collect()
    assert len(found) == 4 and all(r.sources < 8 and r.range < 800 for r in found)
    one = rows.select("doc_id", F.when(F.col("doc_id") > 5, F.lit("é\U0001F600")).alias("source"))
    assert sharding.hilbert_shards(one, ("source",), ("doc_id",)).groupBy("hilbert").count() \
        .select("count").orderBy("count").collect() == [(6,), (994,)]


def test_sharding(docs, none, spark, tmp_path):
    rows = docs.select("doc_id", "lang", "n_chars", "shard").unionByName(
        docs.select("doc_id", "lang", "n_chars", "shard"))
    cut = sharding.hilbert_shards(rows, ("lang", "n_chars"), ("doc_id",), shards=5)
    found = cut.collect()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == rows.count() and set(slots) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    sharding.write_shards(cut, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(found)
    assert sharding.hilbert_shards(none.select("doc_id", "lang"), ("lang",)).count() == 0


@pytest.mark.parametrize("limit", [100_000, -1])
def test_archives(spark, same, monkeypatch, limit):
    from gridwarden.llm import shared
    monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n" \
            "X-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 60
    pages = [(1, "u", "short"), (2, "u\r\nx", "short"), (5, "u", long), (3, "u", long),
             (4, None, long), (6, "u", inner * 3), (7, "u", None), (8, "u", ""),
             (9, "u", "x" * 100), (10, "u", "x" * 99), (11, "u", "x" * 100), (12, "u", "a\r\n\r\nb"),
             (None, "u", long), (13, "u", "WARC/1.0\r\n" * 50), (14, "u", "z" * 300000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "archives")
    warc.write_archives(table, path, archive_bytes=2000)
    import hashlib
    wanted, first = [], {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        data = (html or "").encode()
        mark = hashlib.sha256(data).hexdigest()
        low = first.setdefault(mark, page) if len(data) >= 100 else page
        wanted.append((page, len(data), mark, "response" if low == page else "revisit",
                       None if low == page else low))
    same(warc.archived_pages(spark, path).collect(), wanted)
    empty = fresh_path(spark, "archives")
    warc.write_archives(table.limit(0), empty)
    assert warc.archived_pages(spark, empty).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    pages = [(i, "u", f"{i} " * (20_000 if 1000 <= i < 1030 else 2)) for i in range(3000)]
    pages.append((3000, "u", "x" * 500_000))
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "archives")
    warc.write_archives(table, path, archive_bytes=250_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    sizes = sorted(r.length for r in files.select("length").collect())
    assert sizes[-2] <= 250_000 < 500_000 < sizes[-1] < 501_000 and len(sizes) < 30
    assert warc.archived_pages(spark, path).select("page_id").distinct().count() == 3001


def test_spans_alternate_with_gaps(spark):
    df = spark.createDataFrame([("é1 22\U0001F600333",), ("none",), ("",)], "t string")
    rows = df.select(find_spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert [[(s.start, s.end, s.value) for s in r.s] for r in rows] == [
        [(1, 2, "1"), (3, 5, "22"), (6, 9, "333")], [], []]


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


def test_pipeline(spark, none):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = queries.read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == before.columns and 0 < kept.count() <= before.count()
        assert stage(spark, none.select(*before.columns), SF).count() == 0
    texts = [r.text for r in kept.collect()]
    assert all(not brute.spans(t, brute.SECRETS)[1] for t in texts)
    marks = [brute.fingerprint(r.text) for r in corpus_pipeline.one_of_each(
        spark, queries.read(spark, SF, "documents"), SF).collect()]
    assert len(set(brute.classes(marks))) == len(marks)
    packed = corpus_pipeline.sequences(spark, kept, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
