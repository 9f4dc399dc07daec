"""Operators on single texts, against plain Python, on edge cases and on given tables."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from gridwarden.llm import decontaminate, language, pii, quality, queries, rules, secrets
from gridwarden.session import fresh_path

SF = "/root/testdata/sf0.001"


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture
def items(spark):
    passage = ("One two three four five six seven eight nine ten eleven twelve thirteen "
               "fourteen fifteen")
    return spark.createDataFrame(
        [(1, passage), (10, passage), (2, "two words"), (2, "x"), (3, None), (4, "!!"),
         (None, "zeta"), (5, passage.lower()[:40])], "item_id long, text string")


@pytest.mark.parametrize("block", [200_000, 1])
def test_contamination(docs, items, same, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_PAIRS", block)
    rows = collected(docs)
    wanted = brute.contamination([t for _, t in rows], [tuple(r) for r in items.collect()])
    found = decontaminate.contamination(docs, items)
    got = found.select("doc_id", "n_words", "n_hit", F.concat_ws(",", "items"), "contaminated")
    same(got.collect(), [(i, n, hit, ",".join(met), bad)
                         for (i, _), (n, hit, met, bad) in zip(rows, wanted)])


def test_contamination_of_nothing(docs, none, items, spark):
    assert decontaminate.contamination(none, items).count() == 0
    no_items = spark.createDataFrame([], items.schema)
    assert decontaminate.contamination(docs, no_items).where("n_hit > 0").count() == 0


def test_personal_data(docs, none, same):
    found = pii.find(docs)
    base = F.filter("spans", lambda s: s["strict"])
    got = found.select("doc_id", F.array_join(queries.listed(base, "kind"), ","))
    same(got.collect(), [(i, ",".join(brute.spans(t, brute.KINDS)[1]))
                         for i, t in collected(docs)])
    assert pii.find(none).count() == 0
    values = [s.value for r in found.collect() for s in r.spans if not s.strict]
    assert sorted(values) == ["212-555-0199", "jane [at] example [dot] org"]


def test_labelers_that_agree_are_believed():
    patterns = {(0, (1, 1, 1, 1)): 50, (0, (0, -1, -1, -1)): 40, (0, (1, 1, 0, 1)): 30}
    belief = pii.estimate(patterns)
    assert belief[0, (1, 1, 1, 1)] > 0.9 > 0.1 > belief[0, (0, -1, -1, -1)]
    weights = pii.train([((1,) * 10, 1.0, 5), ((0,) * 10, 0.0, 5)])
    assert sum(weights) > 0 > weights[0]


def test_secrets(docs, none, same, spark):
    ledger = fresh_path(spark, "ledger")
    found = secrets.findings(docs, ledger)
    base = F.filter("spans", lambda s: s["rule"].isin(*secrets.BASE))
    got = found.select("doc_id", F.array_join(queries.listed(base, "rule"), ",")).collect()
    same(got, [(i, ",".join(brute.spans(t, brute.SECRETS)[1])) for i, t in collected(docs)])
    assert {s.rule for r in found.collect() for s in r.spans} >= {"assign", "access", "hex", "jwt"}
    assert secrets.scan(docs, ledger) == 0
    assert secrets.findings(none, fresh_path(spark, "ledger")).count() == 0


def test_ledger_scans_only_unseen_pairs(docs, spark, monkeypatch):
    ledger = fresh_path(spark, "ledger")
    blobs = docs.select(secrets.blob_id(F.col("text"))).distinct().count()
    assert secrets.scan(docs.where("doc_id < 5"), ledger) == 4  # a null text is an empty blob
    assert secrets.scan(docs, ledger) == blobs - 4
    monkeypatch.setitem(secrets.RULES, "hex", (2, *secrets.RULES["hex"][1:]))
    assert secrets.scan(docs, ledger) == blobs
    rules_seen = secrets.read_ledger(spark, ledger).first()["scanned"]
    assert "hex@1" in rules_seen and "hex@2" in rules_seen
    spans = secrets.known_findings(spark, ledger).select(F.explode("spans").alias("s"))
    assert spans.groupBy("s").count().where("count > 3").count() == 0


def test_redaction(docs, spark):
    clean = secrets.redact(docs, fresh_path(spark, "ledger"))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[19]["text"] == '[SECRET]" PassWord: short [SECRET]'
    assert texts[19].n_chars == len(texts[19]["text"])
    before = {r.doc_id: r["text"] for r in docs.collect()}
    assert texts[6]["text"] == before[6] and texts[0]["text"] is None


def test_rules(docs, none, same):
    got = rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                   "n_repeat_words", "base_failed").collect()
    same(got, [(i, *brute.rules(t)) for i, t in collected(docs)])
    assert rules.judge(none).count() == 0


def test_rules_keep_clean_text(spark):
    judged = queries.QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").join(
        queries.read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not base_failed")
    rate = {r.quality: r.kept for r in judged.groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.7


def test_rules_drop_long_word_lists(spark):
    judged = queries.QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01")
    found = judged.where("doc_id in (232, 802, 845, 981)").collect()
    assert len(found) == 4 and not any(r.base_failed or r.kept for r in found)
    labelled = judged.join(queries.read(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    assert labelled.where("quality = 0 and kept").count() < 10


def test_rules_keep_rare_languages(spark):
    def text(alphabet, n, seed):
        rng = random.Random(seed)
        letters = random.Random(alphabet)
        words = ["".join(letters.choices(alphabet, k=letters.randint(2, 7))) for _ in range(300)]
        return " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n)) + "."

    latin, arabic = "abcdefghilmnoprstu", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    korean = "가나다라마바사아자차카타파하"
    junk = " ".join(f"|{i}|" for i in range(1000, 1400))
    rows = [(i, "en", text(latin, 150, i)) for i in range(30)]
    rows += [(100, "ar", text(arabic, 120, 1)), (101, "ar", text(arabic, 120, 2)),
             (102, None, text(arabic, 120, 3)), (103, "ko", text(korean, 80, 4)),
             (104, None, text(latin, 150, 5)), (105, None, junk), (106, "en", junk)]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(got[i].kept for i in (*range(30), 100, 101, 102, 103, 104))
    assert got[100].char_distance is None and got[103].word_distance is None
    assert not got[105].kept and not got[106].kept and not got[106].base_failed


def test_word_limits(spark):
    def texts(n, words, lang="en", near="en", failed=False):
        return [(lang, near, words, 16 / words ** 0.5 / 8 * (1 + i % 40 / 100), failed)
                for i in range(n)]

    rows = [*texts(40, 70), *texts(40, 300), *texts(40, 300), *texts(10, 5000),
            *[texts(1, 300)[0]] * 500, *texts(40, 70, near="de"), *texts(40, 70, failed=True),
            *texts(5, 70, "de", "de"), (None, "en", 70, 0.01, False)]
    measured = spark.createDataFrame(rows, "lang string, word_lang string, n_alnum int, "
                                           "word_distance double, base_failed boolean")
    limits = rules.word_limits(measured)
    short, long, longest = limits["en"][0], limits["en"][4], limits["en"][-1]
    assert 0.3 < short <= rules.MOST_WORDS and 0.16 < long < 0.25
    assert longest == long and len(limits["en"]) == 13
    assert limits["de"] == [rules.MOST_WORDS]
    asked = spark.createDataFrame([(n, n, "en", 0.26, 0.1, False) for n in (70, 300, 9000)],
                                  "id int, n_alnum int, word_lang string, word_distance double, "
                                  "char_distance double, base_failed boolean")
    assert [r.id for r in rules.verdict(asked, limits).where("kept").collect()] == [70]


def test_language(docs, none, spark):
    found = queries.QUERIES["op7_language"](spark, "/root/testdata/sf0.01")
    truth = queries.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    right = found.where("held_out").join(truth, "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    model = language.fit(docs.select("lang", "text", F.col("doc_id").alias("order")), sample=3)
    rows = language.identify(docs, model).select("doc_id", "text", "lang_pred", "score").collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
        assert 0 <= r.score <= 1
    nothing = language.fit(none.select("lang", "text", F.col("doc_id").alias("order")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_code_lengths_are_probabilities():
    import numpy as np
    code, n = np.unique(language._codes(b"abracadabra"), return_counts=True)
    tree = language.ContextTree(code, n.astype(float))
    context = language._codes(b"abr")[-1] // 257 * 257
    total = (2.0 ** -tree.cost(context + np.arange(256))).sum()
    assert 0.5 < total <= 1.0 + 1e-9


def test_quality(docs, none, spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_quality"](spark, sf)
    right = found.where("held_out").join(queries.read(spark, sf, "labels"), "doc_id").agg(
        F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95
    labels = spark.createDataFrame([(6, 1), (6, 0), (8, 1), (9, 0), (10, None), (11, 5)],
                                   "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    scores = quality.score(docs, machine).select("score").collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def test_pair_terms_in_linear_time():
    import numpy as np
    machine = quality.FactorisationMachine(size=6, factors=3)
    x = np.array([0.5, 0, 2.0, 1.0, 0, 0.3])
    slots = np.flatnonzero(x)
    pairs = sum(machine.v[i] @ machine.v[j] * x[i] * x[j] for i in slots for j in slots if i < j)
    assert np.allclose(machine.raw([(slots, x[slots])])[0], pairs)


def test_repeated_words_of_small_vocabularies(spark):
    """Repeated halves of windows, overlapping and adjacent repeats, against plain counting."""
    import random

    from pyspark.sql import functions as F

    from gridwarden.llm import rules
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc"[:rng.randint(1, 3)], k=rng.randint(0, 40)))
             for _ in range(60)]
    texts += ["a b c d e f g h " * 2, "a b c d x a b c d y a b c d z", "p q r s t u v w x"]

    def plain(words):
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        return len(hit)

    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)],
                               "i int, words array<string>")
    found = dict(map(tuple, df.select("i", rules.repeated_words(F.col("words"))).collect()))
    assert found == {i: plain(t.split()) for i, t in enumerate(texts)}
