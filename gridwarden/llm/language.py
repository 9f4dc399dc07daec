"""Language identification by prediction by partial matching."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.shared import broadcast_if_short, whole

ORDER = 3
#: Texts per language that the models are fitted on, whole.
SAMPLE = 400
UNDETERMINED = "und"

_TOGETHER = 2 << 20
_BASE = 257  # bytes, and one sign for what stands before a text


def _codes(data):
    """For each byte the number that the bytes before it and itself spell, oldest first."""
    signs = np.concatenate([np.full(ORDER, 256, np.int64), np.frombuffer(data, np.uint8)])
    code = np.zeros(len(data), dtype=np.int64)
    for i in range(ORDER + 1):
        code = code * _BASE + signs[i:i + len(data)]
    return code


def count_contexts(docs: DataFrame, sample=SAMPLE) -> DataFrame:
    """lang, code, n: how often each byte follows each context in the sampled texts.

    docs: lang, text, order (what the sample is chosen by, least first; equal ones count once).
    The sample is chosen on languages and orders, in salted parts before it is chosen in all.
    """
    def counted(batches):
        for batch in batches:
            parts = []
            for lang, group in batch.groupby("lang"):
                found = np.concatenate([_codes(t.encode()) for t in group["text"]])
                code, n = np.unique(found, return_counts=True)
                parts.append(pd.DataFrame({"lang": lang, "code": code, "n": n}))
            if parts:
                yield pd.concat(parts)

    def first(rows, *keys):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")

    salted = docs.select("lang", "order").withColumn("salt", F.pmod(F.hash("order"), F.lit(64)))
    picked = first(first(salted, "lang", "salt"), "lang").select("lang", "order").distinct()
    kept = docs.join(broadcast_if_short(picked), ["lang", "order"], "left_semi") \
        .dropDuplicates(["lang", "order"])
    return kept.select("lang", "text").mapInPandas(
        counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))


class ContextTree:
    """Code lengths, in bits, of bytes after their contexts, in one language.

    Where the context has been seen, a byte seen there costs by its count, and another one an
    escape (as many different bytes there against all) and its cost in the context without its
    oldest byte. A context never seen costs nothing to leave. Below the empty context all
    bytes cost the same.
    """

    def __init__(self, code, n):
        self.levels = []
        for order in range(ORDER + 1):
            short, back = np.unique(code % _BASE ** (order + 1), return_inverse=True)
            count = np.bincount(back, weights=n)
            context, back, different = np.unique(
                short // _BASE, return_inverse=True, return_counts=True)
            room = np.log2(np.bincount(back, weights=count) + different)
            self.levels.append((short, room[back] - np.log2(count),
                                context, room - np.log2(different)))

    def cost(self, code):
        bits, left = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            short, seen, contexts, escape = self.levels[order]
            wanted = code[left] % _BASE ** (order + 1)
            at, known = _find(short, wanted)
            bits[left[known]] += seen[at[known]]
            left, wanted = left[~known], wanted[~known]
            at, known = _find(contexts, wanted // _BASE)
            bits[left[known]] += escape[at[known]]
        bits[left] += 8
        return bits


def _find(keys, wanted):
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(trees, texts):
    """Bits that each language needs for each text; a row per text.

    Texts are taken together as long as they are short, so that a code they share is looked
    up once.
    """
    out, begin = [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= _TOGETHER):
            size += len(texts[end])
            end += 1
        codes = [_codes(t) for t in texts[begin:end]]
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        cost = np.stack([tree.cost(code) for tree in trees], axis=1)
        at = 0
        for one in codes:
            out.append(cost[back[at:at + len(one)]].sum(axis=0))
            at += len(one)
        begin = end
    return out


def fit(docs: DataFrame, sample=SAMPLE):
    """Languages in order and their trees, from docs (lang, text, order)."""
    counts = count_contexts(docs.where("lang is not null and text <> ''"), sample).toPandas()
    groups = sorted(counts.groupby("lang"))
    return [name for name, _ in groups], [
        ContextTree(g["code"].to_numpy(np.int64), g["n"].to_numpy(float)) for _, g in groups]


def identify(docs: DataFrame, model) -> DataFrame:
    """docs with lang_pred, the language that needs the fewest bits for the whole text, score
    and bits (language to bits).

    The score is the language's share when each is weighted by its code length. A null text or
    one without a letter is ``und`` with score 0 and no bits, as is every text when no model
    could be fitted. Ties go to the first language by name. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits map<string,double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, trees = shared.value
        judged = [bool(langs) and any(map(str.isalpha, t)) for t in texts]
        costs = iter(code_lengths(trees, [t.encode() for t, j in zip(texts, judged) if j]))
        rows = []
        for known in judged:
            if not known:
                rows.append((UNDETERMINED, 0.0, {}))
                continue
            bits = next(costs)
            best = int(bits.argmin())
            share = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
            rows.append((langs[best], float(share), dict(zip(langs, bits.tolist()))))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "bits"])

    return docs.withColumn("_found", predict(whole(F.col("text")))).select(
        *[c for c in docs.columns if c not in ("lang_pred", "score", "bits")], "_found.*")
