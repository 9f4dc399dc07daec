"""Quality classification by a factorisation machine over words, structure and metadata."""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import whole

SLOTS = 1 << 14
FACTORS = 8
#: Labelled documents that the machine is fitted on, whole texts.
SAMPLE = 5_000
THRESHOLD = 0.3

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Byte classes: lower, upper, digit, space, new line, symbol, other punctuation, non-ASCII.
_CLASS = np.full(256, 6)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[list(b"#*$%&|<>~^")] = 5
_CLASS[128:] = 7
STRUCTURE = 15


def features(text, n_chars):
    """Slots and values: hashed words of unit length, then structure and metadata."""
    data = np.frombuffer(text.encode(), np.uint8)
    classes = np.bincount(_CLASS[data], minlength=8)[:8]
    words = [w for w in _SPACES.split(text) if w]
    slots = {}
    for word in words:
        slots[word] = slots.get(word, 0) + 1
    hashed = {}
    for word, n in slots.items():
        slot = zlib.crc32(word.lower().encode()) % SLOTS
        hashed[slot] = hashed.get(slot, 0) + n
    place = np.fromiter(hashed, np.int64, len(hashed))
    value = np.sqrt(np.fromiter(hashed.values(), float, len(hashed)))
    value /= np.sqrt((value ** 2).sum()) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    share = classes / max(len(data), 1)
    n = max(len(words), 1)
    marks = np.array([
        *share, np.log1p(len(words)) / 12, min(len(text) / n / 20, 2), len(slots) / n,
        1 - len(set(lines)) / max(len(lines), 1), max(slots.values(), default=0) / n,
        len(lines) / n, np.log1p(max(n_chars, 0)) / 12])
    return (np.concatenate([place, SLOTS + np.arange(STRUCTURE)]),
            np.concatenate([value, marks]))


class FactorisationMachine:
    """w0 + w x + the sum over pairs of <v_i, v_j> x_i x_j, which is half of the squared sums
    less the sums of squares of v x, so it costs as much as there are features."""

    def __init__(self, size=SLOTS + STRUCTURE, factors=FACTORS, seed=7):
        random = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(size)
        self.v = random.normal(0, 0.05, (size, factors))

    def raw(self, rows):
        """Scores, and what the gradient needs, of (slots, values) rows."""
        slot = np.concatenate([r[0] for r in rows])
        value = np.concatenate([r[1] for r in rows])
        start = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
        vx = self.v[slot] * value[:, None]
        sums = np.add.reduceat(vx, start)
        squares = np.add.reduceat(vx ** 2, start)
        score = self.w0 + np.add.reduceat(self.w[slot] * value, start) \
            + 0.5 * (sums ** 2 - squares).sum(axis=1)
        return score, (slot, value, vx, sums)

    def scores(self, rows):
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -500, 500)))

    def fit(self, rows, labels, steps=1000, batch=64, rate=0.1, decay=1e-5, seed=7):
        """Logistic loss, steps scaled by the gradients so far (AdaGrad).

        Both labels weigh the same in all, however rare one is.
        """
        random, labels = np.random.default_rng(seed), np.asarray(labels, float)
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        for _ in range(-(-steps * batch // len(rows))):
            order = random.permutation(len(rows))
            for begin in range(0, len(rows), batch):
                mine = order[begin:begin + batch]
                picked = [rows[i] for i in mine]
                score, (slot, value, vx, sums) = self.raw(picked)
                error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels[mine]) \
                    * weight[mine] / len(mine)
                each = np.repeat(error, [len(r[0]) for r in picked])
                back = np.repeat(np.arange(len(mine)), [len(r[0]) for r in picked])
                used, where = np.unique(slot, return_inverse=True)
                dw = np.bincount(where, each * value) + decay * self.w[used]
                part = (each * value)[:, None] * (sums[back] - vx)
                dv = np.stack([np.bincount(where, part[:, f]) for f in range(part.shape[1])],
                              axis=1) + decay * self.v[used]
                d0 = error.sum()
                g0 += d0 ** 2
                gw[used] += dw ** 2
                gv[used] += dv ** 2
                self.w0 -= rate * d0 / np.sqrt(g0)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def fit(docs: DataFrame, labels: DataFrame, sample=SAMPLE):
    """A machine fitted on at most ``sample`` labelled documents, those with the least hashes.

    docs: doc_id, text, n_chars; labels: doc_id, quality (0 or 1; other values are left out, and
    so are ids whose labels disagree). The sample is chosen on ids, before texts are read.
    """
    agreed = labels.where("quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).where(
        "quality = most").drop("most")
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").join(agreed, "doc_id").distinct().orderBy(order).limit(sample)

    def extract(batches):
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "quality": batch["quality"],
                "slots": [r[0].tolist() for r in rows], "values": [r[1].tolist() for r in rows]})

    rows = docs.select("doc_id", whole(F.col("text")).alias("text"), _length().alias("n_chars")) \
        .join(ids, "doc_id").mapInPandas(
        extract, "doc_id bigint, quality int, slots array<int>, values array<float>").toPandas()
    rows["key"] = rows["values"].map(sum)
    rows = rows.sort_values(["doc_id", "key"])
    machine = FactorisationMachine()
    if rows["quality"].nunique() == 2:
        machine.fit([(np.asarray(s, np.int64), np.asarray(v, float))
                     for s, v in zip(rows["slots"], rows["values"])], rows["quality"])
    return machine


def _length():
    return F.coalesce(F.col("n_chars"), F.char_length(whole(F.col("text")))).cast("bigint")


def score(docs: DataFrame, machine) -> DataFrame:
    """docs with score, how likely label 1 is (0 to 1), from text and n_chars alone.

    A null text is scored as an empty one; a null n_chars is counted. A column called score is
    replaced. Without labels of both kinds in the fit, the scores tell nothing apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        rows = [features(t, n) for t, n in zip(texts, lengths)]
        return pd.Series(np.concatenate([
            shared.value.scores(rows[i:i + 500]) for i in range(0, len(rows), 500)])
            if rows else [], dtype=float)

    return docs.withColumn("score", scored(whole(F.col("text")), _length()))
