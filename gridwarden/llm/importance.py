"""Importance resampling towards a target, by hashed word features."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.shared import cut, whole

BUCKETS = 10_000
WORDS = 2
LEAST_WORDS = 20
PERCENT = 25
#: Bytes from a span's end that have tables; what lies before them is folded in such blocks.
DEPTH = 64
#: Bytes of text that are taken together.
TOGETHER = 1 << 20

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


class PositionCrc:
    """CRC-32 of many spans of a buffer at once.

    The sum is linear: each byte contributes a value that depends on the byte and its distance
    from the span's end, the span's length contributes the sum of as many zero bytes, and all
    are combined by exclusive or. Spans longer than the tables are cut into blocks from their
    end; neighbours are folded in pairs, the earlier one moved on by the later one's length.
    """

    def __init__(self, depth=DEPTH):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> 1) ^ np.where(step & 1, np.uint32(POLYNOMIAL), np.uint32(0))
        table = [step]
        while len(table) < depth:
            table.append((table[-1] >> 8) ^ step[table[-1] & 255])
        self.depth, self.table = depth, np.stack(table).ravel()
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(depth):
            bits = (bits >> 8) ^ step[bits & 255]
        self.moves = [self._move(bits)]
        self.constants = np.array([zlib.crc32(bytes(n)) for n in range(depth + 1)], np.uint32)

    @staticmethod
    def _move(bits):
        """Tables per byte of the linear map that sends bit i to ``bits[i]``."""
        tables = np.zeros((4, 256), np.uint32)
        for i, value in enumerate(bits):
            tables[i >> 3, (np.arange(256) >> (i & 7)) & 1 == 1] ^= value
        return tables

    @staticmethod
    def _moved(tables, values):
        return (tables[0][values & 255] ^ tables[1][values >> 8 & 255]
                ^ tables[2][values >> 16 & 255] ^ tables[3][values >> 24])

    def _raw(self, data, starts, lengths):
        """Contributions of spans that the tables cover."""
        first = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum(), dtype=np.int32) - np.repeat(
            first.astype(np.int32), lengths)
        byte = data[np.repeat(starts.astype(np.int32), lengths) + within]
        distance = np.repeat((lengths - 1).astype(np.int32), lengths) - within
        return np.bitwise_xor.reduceat(self.table[(distance << 8) + byte], first)

    def _folded(self, data, starts, lengths):
        """Contributions of long spans."""
        blocks = -(-lengths // self.depth)
        span = np.repeat(np.arange(len(starts)), blocks)
        # a span's blocks in the text's order, numbered down to 0 at the end
        number = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(blocks.sum())
        ends = (starts + lengths)[span] - number * self.depth
        begins = np.maximum(ends - self.depth, starts[span])
        values, level = self._raw(data, begins, ends - begins), 0
        while len(values) > len(starts):
            if level == len(self.moves):
                self.moves.append(self._move(self._moved(
                    self.moves[-1], self._moved(self.moves[-1],
                                                np.uint32(1) << np.arange(32, dtype=np.uint32)))))
            values = np.where(number & 1, self._moved(self.moves[level], values), values)
            number >>= 1
            heads = np.flatnonzero(np.r_[True, (number[1:] != number[:-1])
                                         | (span[1:] != span[:-1])])
            values = np.bitwise_xor.reduceat(values, heads)
            number, span, level = number[heads], span[heads], level + 1
        return values

    def spans(self, data, starts, lengths):
        """Unsigned CRC-32 of each span; none is empty."""
        out = np.zeros(len(starts), np.uint32)
        long = lengths > self.depth
        for chosen, sums in ((~long, self._raw), (long, self._folded)):
            if chosen.any():
                out[chosen] = sums(data, starts[chosen], lengths[chosen])
        out[~long] ^= self.constants[lengths[~long]]
        if long.any():
            sizes, back = np.unique(lengths[long], return_inverse=True)
            out[long] ^= np.array([zlib.crc32(bytes(n)) for n in sizes.tolist()], np.uint32)[back]
        return out


_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = (_LOWER >= 0x80) | ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | (
    (_LOWER >= 0x61) & (_LOWER <= 0x7A))


def _joined(data):
    """The buffer's words in lower case with one space behind each, their starts and lengths,
    and where each began in the buffer."""
    inside = _IN_WORD[data]
    ends = np.r_[False, inside] & ~np.r_[inside, False]
    inside = np.r_[inside, False]
    kept = inside | ends
    words = np.where(inside, np.r_[_LOWER[data], np.uint8(32)], np.uint8(32))[kept]
    spaces = np.flatnonzero(ends[kept])
    starts = np.r_[0, spaces[:-1] + 1] if len(spaces) else spaces
    began = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    return words, starts, spaces - starts, began


def _parts(texts):
    """(first document, texts' bytes, whether it goes on with the document before it), in turn;
    long texts are cut between words."""
    waiting, first, size = [], 0, 0
    for number, text in enumerate(texts):
        data = text.encode()
        if size + len(data) > TOGETHER and waiting:
            yield first, waiting, False
            waiting, size = [], 0
        if not waiting:
            first = number
        if len(data) <= TOGETHER:
            waiting.append(data)
            size += len(data)
            continue
        at = 0
        while at < len(data):
            end = min(at + TOGETHER, len(data))
            outside = np.flatnonzero(~_IN_WORD[np.frombuffer(data, np.uint8, end - at, at)])
            if end < len(data) and len(outside):
                end = at + int(outside[-1]) + 1
            while end < len(data) and _IN_WORD[data[end - 1]] and _IN_WORD[data[end]]:
                end += 1  # a word longer than a part stays whole
            yield number, [data[at:end]], at > 0
            at = end
    if waiting:
        yield first, waiting, False


def feature_buckets(texts, sums, buckets=BUCKETS, words=WORDS):
    """(document numbers, buckets) of all features of the texts, in parts of a bounded size.

    A feature is a run of 1 to ``words`` consecutive words.
    """
    tail = []
    for first, parts, goes_on in _parts(texts):
        tail = tail if goes_on else []
        raw = b" ".join([*tail, *parts])
        data, starts, lengths, began = _joined(np.frombuffer(raw, np.uint8))
        if not len(starts):
            continue
        if goes_on:
            document = np.zeros(len(starts), np.int64)
        else:
            edges = np.cumsum([len(p) + 1 for p in parts])
            document = np.searchsorted(edges, began, "right")
        owners, found = [], []
        for width in range(1, words + 1):
            left = np.arange(len(starts) - width + 1)
            right = left + width - 1
            # of a run that lies in what was carried over, the part before has counted it
            own = (document[left] == document[right]) & (right >= len(tail))
            left, right = left[own], right[own]
            if len(left):
                crc = sums.spans(data, starts[left], starts[right] + lengths[right] - starts[left])
                owners.append(first + document[left])
                found.append(crc % np.uint32(buckets))
        last = range(max(len(starts) - words + 1, 0), len(starts))
        tail = [data[starts[i]:starts[i] + lengths[i]].tobytes() for i in last]
        if found:
            yield np.concatenate(owners), np.concatenate(found)


def feature_counts(rows: DataFrame, buckets=BUCKETS, words=WORDS) -> DataFrame:
    """bucket, n: how many features of all texts (null: none) fall into each bucket."""
    def counted(batches):
        sums, counts = PositionCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_buckets(batch["text"], sums, buckets, words):
                counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": held, "n": counts[held]})

    return rows.select(whole(F.col("text")).alias("text")).mapInPandas(
        counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets=BUCKETS):
    """Each bucket's gain in thousandths, from the counts of both sides; an array of ``buckets``."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, counts in ((s, source), (t, target)):
        found = counts.toPandas()
        side[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return np.floor(1000 * np.log(
        (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain, words=WORDS) -> DataFrame:
    """docs with n_features and weight, the floored mean of the gains of a text's features.

    A text without words, a null or an empty one has no features and weight 0. Columns of these
    names are replaced, others kept; repeated rows are each returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_features bigint, weight bigint")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        gain, sums = shared.value, PositionCrc()
        number, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owner, found in feature_buckets(texts, sums, len(gain), words):
            lowest = owner[0]
            n = np.bincount(owner - lowest)
            number[lowest:lowest + len(n)] += n
            total[lowest:lowest + len(n)] += np.bincount(
                owner - lowest, weights=gain[found]).astype(np.int64)
        return pd.DataFrame({"n_features": number, "weight": total // np.maximum(number, 1)})

    return docs.withColumn("_weighed", weighed(whole(F.col("text")))).select(
        *[c for c in docs.columns if c not in ("n_features", "weight")], "_weighed.*")


def draw(weighed: DataFrame, seed=7, percent=PERCENT, least_words=LEAST_WORDS,
         words=WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where not drawn.

    To the weight comes noise of a Gumbel distribution, from the SHA-256 of ``seed:doc_id``, so
    that the highest scores are a sample without replacement. ``percent`` of 100 of the rows
    with at least ``least_words`` words are drawn; ties go to the smaller doc_id, equal rows have
    ranks of their own, a null doc_id counts as an empty one. Rows are ranked where they are
    sorted by range; only the counts of the ranges meet.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    least = sum(least_words - w for w in range(min(words, least_words)))
    rows = cut(weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"),
        (F.col("n_features") >= least).alias("_may"), F.monotonically_increasing_id().alias("_own")))
    order = [F.desc("_may"), F.desc("score"), F.asc("doc_id"), F.asc("_own")]
    lots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(lots, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_lot"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth")))
    before = Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_lot").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("_may").alias("_able")).select(
        "_lot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.expr(f"({percent} * sum(_able) over ()) div 100").alias("_drawn"))
    rank = F.col("_start") + F.col("_nth") + 1
    return dealt.join(F.broadcast(starts), "_lot").select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("_may") & (rank <= F.col("_drawn")), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets=BUCKETS, words=WORDS, **drawing):
    """draw() over docs (doc_id, text), weighed by how much likelier the features are in target.

    Counts are over all rows of both sides. Without docs there are no rows, without target all
    buckets of the target are empty. Other columns of docs are left out. Long texts are taken in
    parts of ``TOGETHER`` bytes, or of one word; what is counted together in a task has the size of
    such a part, and ``buckets`` numbers are all that leaves it.
    """
    gain = gains(feature_counts(docs, buckets, words), feature_counts(target, buckets, words),
                 buckets)
    return draw(weigh(docs.select("doc_id", "text"), gain, words), words=words, **drawing)
