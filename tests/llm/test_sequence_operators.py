"""Operators on texts as sequences: pieces, fill-in-middle frames, importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from gridwarden.llm import importance, middle, pieces, queries
from gridwarden.session import fresh_path

SF = "/root/testdata/sf0.001"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- pieces ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return pieces.decoder(str(pieces.model_path()))


@pytest.fixture(scope="module")
def encoder():
    return pieces.load(str(pieces.model_path()))[0]


def test_ids_and_texts_are_the_library_s(docs, none, library, same):
    got = pieces.encode(docs.withColumn("ids", F.lit("clash")), decoded=True)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    rows = got.select("doc_id", "text", "ids", "decoded").collect()
    same([(r.doc_id, r.text) for r in rows], docs.select("doc_id", "text").collect())
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids)
    again = pieces.decode(got.select("ids", "decoded")).collect()
    assert {(tuple(r.ids), r.decoded) for r in again} == {(tuple(r.ids), r.decoded) for r in rows}
    assert pieces.encode(none, decoded=True).count() == 0
    assert pieces.decode(none.select(F.lit(None).cast("array<int>").alias("ids"))).count() == 0


def test_ids_without_an_end(docs):
    r = pieces.encode(docs.where("text = 'two words'"), end=False).first()
    assert r.ids and 2 not in r.ids


def test_ids_of_odd_texts(encoder, library):
    rng = random.Random(7)
    signs = " " * 6 + "aeinrst\n\t▁é東😀́Ω<>/0x\0.,'"
    made = [lambda: "".join(rng.choices(signs, k=rng.randint(0, 60))),
            lambda: "".join(rng.choices(encoder.tokens, k=rng.randint(0, 12))).replace("▁", " "),
            lambda: " " * rng.randint(0, 60) + rng.choice(["a", "the", "", "\n"])
            + " " * rng.randint(0, 40)]
    for i in range(6000):
        text = made[i % 3]()
        assert encoder.encode(text) == library.encode(text), text
    for text in ("a" * 30_000, " " * 30_001, "ab" * 15_000, "東" * 9000, "<s></s><0x41><unk>"):
        assert encoder.encode(text) == library.encode(text)


def small(scores):
    ids = {p: i for i, p in enumerate(scores)}
    return pieces.MergeEncoder(scores, ids, None, -1)


def test_backtracking_equals_merging():
    """On vocabularies where the longest match is often wrong, and equal scores abound."""
    rng = random.Random(3)
    for _ in range(300):
        found = {a: 0.0 for a in "abc"}
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(list(found)), rng.choice(list(found))
            found[a + b] = -float(rng.randint(1, 4))
        one = small(found)
        for _ in range(20):
            text = "".join(rng.choices("abc", k=rng.randint(1, 25)))
            got = [one.tokens[t] for t in one._run(text)]
            assert got == pieces.merged(text, found), (found, text)


def test_unknown_letters_and_forgotten_chunks(monkeypatch):
    one = small({"a": 0.0, "b": 0.0, "ab": -1.0, "▁": 0.0, "▁a": -2.0})
    assert [one.ids[t] for t in one._run("ab")] == [(2,)]
    monkeypatch.setattr(pieces, "CHUNKS", 1)
    monkeypatch.setattr(pieces, "PAIRS", 1)
    monkeypatch.setattr(pieces, "LONGEST", 2)
    assert one.encode("ab xxa aab") == [3, 2, 3, -1, 0, 4, 2]
    assert one.encode("ab xxa aab") == [3, 2, 3, -1, 0, 4, 2]


def test_pieces_query(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece"](spark, SF).collect()}
    texts = queries.read(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = library.encode(r.text or "", add_eos=True)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), hexed(" ".join(map(str, ids))),
                                        hexed(library.decode(ids)))


# -- fill-in-middle -------------------------------------------------------------------

def filled(doc_id, text, rate=100, suffix_first=50, marks=middle.MARKS):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, keep, order = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((a % (len(lines) + 1), b % (len(lines) + 1)))
    if not text or any(m in text for m in marks) or keep % 100 >= rate:
        return len(lines), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    P, S, M = marks
    first = order % 100 < suffix_first
    out = f"{S}{s}{P}{p}{M}{m}" if first else f"{P}{p}{S}{s}{M}{m}"
    return len(lines), "spm" if first else "psm", len(p), len(m), out, text


@pytest.mark.parametrize("size", [middle.FRAME, 7])
@pytest.mark.parametrize("rate,first", [(100, 50), (30, 100)])
def test_fill_in_middle(spark, docs, same, size, rate, first):
    more = spark.createDataFrame(
        [(900 + i, t) for i, t in enumerate(
            ["a <P> b\nc", "<S>", "x<M", "<", "\n", "\n\n\n", "a\nb\nc\nd", "é\n東京\n😀😀\n", "a\r\nb",
             "<P" + "\n" * 50 + ">", "".join(f"line {i}\n" for i in range(300)), "x" * 20 + "<M>"])],
        "doc_id long, text string")
    texts = docs.select("doc_id", "text", F.lit("clash").alias("n")).unionByName(
        more.withColumn("n", F.lit("clash")))
    path = fresh_path(spark, "texts")
    middle.store_texts(texts, path, size)
    made = middle.fill_in_middle(
        spark.read.parquet(path).withColumn("form", F.lit("clash")), 7, rate, first)
    rows = middle.texts(middle.digests(made)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_text", "restored_text",
        "output_sha256", "restored_sha256").collect()
    same([tuple(r)[:7] for r in rows],
         [(r.doc_id, *filled(r.doc_id, r.text, rate, first)) for r in texts.collect()])
    for r in rows:
        assert (hexed(r.output_text), hexed(r.restored_text)) == (
            r.output_sha256, r.restored_sha256)


def test_frames_are_independent_and_moved_as_they_are():
    text = "".join(f"line {i} é\n" for i in range(500)).encode()
    writer = middle.FrameWriter(100)
    writer.add(text)
    frames, seek = writer.done()
    whole = middle.FrameReader(frames, seek)
    assert all(0 < len(whole.frame(i)) <= 100 for i in range(len(seek)))
    assert b"".join(whole.stream()) == text
    starts = [0] + [m.end() for m in re.finditer(b"\n", text)]
    opened = []
    monitor = whole.frame
    whole.frame = lambda i: opened.append(i) or monitor(i)
    for units in (0, 1, 250, 500):
        opened.clear()
        at, chars = whole.cut(units)
        assert at == starts[units] and chars == len(text[:at].decode()) and len(opened) <= 1
    opened.clear()
    other = middle.FrameWriter(100)
    whole.send(other, 150, len(text) - 150)
    assert len(opened) == 2  # only the frames at the two ends
    assert b"".join(middle.FrameReader(*other.done()).stream()) == text[150:-150]
    assert whole.find((b"line 7 ", b"line 499", b"none")) == [
        text.find(b"line 7 "), text.find(b"line 499"), -1]


def test_no_texts(spark, none):
    path = fresh_path(spark, "texts")
    middle.store_texts(none, path)
    made = middle.fill_in_middle(spark.read.parquet(path))
    assert middle.texts(middle.digests(made)).count() == 0


# -- importance -----------------------------------------------------------------------

def test_position_sums():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(40_000))
    for depth in (1, 3, 8, 64):
        sums = importance.PositionCrc(depth)
        spans = [(at := rng.randrange(39_000), rng.choice([1, 2, depth, depth + 1, 5 * depth,
                                                           rng.randint(1, 900)]))
                 for _ in range(400)]
        got = sums.spans(np.frombuffer(data, np.uint8), *np.array(spans).T)
        assert got.tolist() == [zlib.crc32(data[a:a + n]) for a, n in spans]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def hashed(text, buckets=importance.BUCKETS):
    return Counter(zlib.crc32(f.encode()) % buckets for f in features(text))


@pytest.mark.parametrize("together", [importance.TOGETHER, 40])
def test_feature_buckets(docs, monkeypatch, together):
    monkeypatch.setattr(importance, "TOGETHER", together)
    texts = [r.text or "" for r in docs.collect()]
    got = [Counter() for _ in texts]
    for owner, found in importance.feature_buckets(texts, importance.PositionCrc()):
        for o, f in zip(owner.tolist(), found.tolist()):
            got[o][f] += 1
    assert got == [hashed(t) for t in texts]


def resampled(rows, aims, percent=25, buckets=importance.BUCKETS):
    counts = [hashed(t) for _, t in rows]
    s, t = sum(counts, Counter()), sum((hashed(a) for a in aims), Counter())
    total, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / (
        (s[b] + 1) * (aim + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, text), found in zip(rows, counts):
        n = sum(found.values())
        weight = sum(gain[b] * k for b, k in found.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode())
                .hexdigest()[:8], 16)
        out.append((doc_id, n, weight, weight + math.floor(
            -1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 39),
                  key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    ranks = [(*r, i + 1) for i, r in enumerate(drawn)]
    rest = Counter(out) - Counter(drawn)
    return ranks + [(*r, None) for r in rest.elements()]


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling(spark, docs, none, same, percent):
    aims = ["one two three four five six", None, "the and of alpha", ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id int, text string")
    got = importance.resample(docs.withColumn("weight", F.lit("clash")), target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = docs.select("doc_id", "text").collect()
    same(got.collect(), resampled([tuple(r) for r in rows], aims, percent))
    assert importance.resample(none, target).count() == 0
    assert importance.resample(docs, none).where("rank IS NULL").count() > 0


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_importance"])
def test_queries(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None
