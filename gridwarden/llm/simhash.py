"""SimHash near-duplicates by deletion-variant signatures."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import ascii_lower, cut, row_key, whole

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints under one key that are compared pair by pair; more go the finer way.
CROWD = 1000

_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def fingerprint(words, width=SHINGLE):
    """Bit by bit what over half of the shingles' hashes have; 0 without words."""
    import xxhash
    if not words:
        return 0
    last = max(len(words) - width, 0)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + width]), SEED)
                       for i in range(last + 1)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width=SHINGLE) -> DataFrame:
    """doc_id, content (md5 of the text) and fingerprint (signed 64-bit) of each document.

    docs: doc_id, text. Words are what ASCII white space parts, A-Z in lower case; a null or
    empty text has fingerprint 0, one with fewer than ``width`` words is one shingle.
    """
    @F.pandas_udf("bigint")
    def fingerprint_of(texts: pd.Series) -> pd.Series:
        marks = [fingerprint([w for w in _SPACES.split(t) if w], width) for t in texts]
        return pd.Series(np.array(marks, dtype=np.uint64).view(np.int64))

    return docs.select(
        *row_key(), fingerprint_of(ascii_lower(whole(F.col("text")))).alias("fingerprint"))


def near_pairs(marks: DataFrame, distance=DISTANCE) -> DataFrame:
    """Links (left, right) between different fingerprints that suffice to connect all that
    differ in ``distance`` bits or fewer. marks: distinct fingerprints.

    The 64 bits are cut into ``distance // 2 + 1`` segments, so that some segment differs in at
    most one bit. Each segment is indexed once per bit with that bit deleted; equal keys meet by
    a shuffle and are compared in full. A pair is given under the first key it shares only.
    Under a key that more than CROWD fingerprints share, the fingerprints are indexed again with
    ``distance`` bits deleted from the whole, where those with equal keys are near by
    construction and one link each is enough.
    """
    segments = distance // 2 + 1
    bounds = [64 * i // segments for i in range(segments + 1)]
    masks = np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])],
                     dtype=np.uint64)
    owner = F.lit(int(masks.view(np.int64)[-1]))
    for bound, mask in list(zip(bounds[1:], masks.view(np.int64)))[-2::-1]:
        owner = F.when(F.col("bit") < bound, F.lit(int(mask))).otherwise(owner)
    index = marks.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    index = index.select("fingerprint", "bit", F.expr(
        "fingerprint & ~shiftleft(1L, bit)").bitwiseAND(owner).alias("rest"))
    index = index.repartition("bit", "rest").sortWithinPartitions("bit", "rest")

    def compare(batches):
        held = np.empty((0, 3), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([held, batch[["bit", "rest", "fingerprint"]].to_numpy(np.int64)])
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            done = int(change[-1]) if len(change) else 0
            crowded = len(rows) - done > CROWD + 1
            if crowded:  # its rows go at once; those left make the next batch see a crowd
                yield _alone(rows[done:, 2])
                held = rows[-(CROWD + 1):]
            else:
                held = rows[done:]
            yield _compared(rows[:done], distance, bounds, masks)
        yield _compared(held, distance, bounds, masks)

    met = cut(index.mapInPandas(compare, "left bigint, right bigint"))
    crowd = met.where("right is null").select(F.col("left").alias("fingerprint")).distinct()
    return met.where("right is not null").unionByName(_fine_links(crowd, distance))


def _alone(marks):
    return pd.DataFrame({"left": np.unique(marks), "right": pd.NA}).astype("Int64")


def _compared(rows, distance, bounds, masks):
    """Near pairs under equal keys of sorted rows; members of crowds without a partner."""
    starts = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[:len(rows)]
    sizes = np.diff(np.concatenate([np.flatnonzero(starts), [len(rows)]]))
    size = np.repeat(sizes, sizes)
    parts = [_alone(rows[size > CROWD, 2])]
    rows = rows[(size > 1) & (size <= CROWD)]
    for step in range(1, CROWD):
        same = (rows[step:, :2] == rows[:-step, :2]).all(axis=1)
        if not same.any():
            break
        a, b, bit = rows[:-step, 2][same], rows[step:, 2][same], rows[step:, 0][same]
        change = (a ^ b).view(np.uint64)
        near = np.bitwise_count(change) <= distance
        a, b, bit, change = a[near], b[near], bit[near], change[near]
        first = np.full(len(a), -1)
        for start, mask in list(zip(bounds, masks))[::-1]:
            part = change & mask
            few = np.bitwise_count(part) <= 1
            at = np.where(part == 0, start, np.log2(np.maximum(part, 1).astype(float)).astype(int))
            first = np.where(few, at, first)
        mine = first == bit
        parts.append(pd.DataFrame({"left": np.minimum(a, b)[mine],
                                   "right": np.maximum(a, b)[mine]}).astype("Int64"))
    return pd.concat(parts)


def _fine_links(marks, distance):
    """Each fingerprint and the least one under each of its keys with ``distance`` bits deleted."""
    names = [f"bit{i}" for i in range(distance)]
    variants = marks.withColumn("rest", F.col("fingerprint"))
    for i, name in enumerate(names):
        start = f"{names[i - 1]} + 1" if i else "0"
        variants = variants.withColumn(name, F.expr(
            f"explode(sequence({start}, {63 - (distance - 1 - i)}))")).withColumn(
            "rest", F.expr(f"rest & ~shiftleft(1L, {name})"))
    met = variants.groupBy(*names, "rest").agg(F.collect_set("fingerprint").alias("all")).where(
        F.size("all") > 1)
    links = met.select(F.array_min("all").alias("left"), F.explode("all").alias("right"))
    return links.where("left < right").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node each linked node reaches.

    Alternating large-star and small-star steps; each halves the depth of the trees, and the
    links are kept in the shared folder between steps.
    """
    edges, sign = cut(links.select("left", "right").distinct()), None
    while True:
        both = edges.unionByName(edges.select(
            F.col("right").alias("left"), F.col("left").alias("right")))
        least = both.groupBy("left").agg(F.min("right").alias("low")).select(
            "left", F.least("left", "low").alias("low"))
        large = cut(both.join(least, "left").where("right > left").select(
            F.col("low").alias("left"), "right").distinct())
        lowest = large.groupBy("right").agg(F.min("left").alias("low"))
        small = large.join(lowest, "right")
        after = cut(small.where("left > low").select(F.col("low").alias("left"),
                                                     F.col("left").alias("right"))
                    .unionByName(lowest.select(F.col("low").alias("left"), "right")).distinct())
        before, sign = sign, after.agg(F.count(F.lit(1)).alias("n"), F.expr(
            "bit_xor(xxhash64(left, right))").alias("mark")).first()
        edges = after
        if sign == before:
            break
    return edges.select(F.col("right").alias("node"), F.col("left").alias("root"))


def classes(docs: DataFrame, width=SHINGLE, distance=DISTANCE) -> DataFrame:
    """doc_id, content, fingerprint, root (a fingerprint) and component_id of each document.

    Fingerprints link at ``distance`` differing bits or fewer; component_id is the smallest
    doc_id reachable, itself included. Equal fingerprints are one node, so copies cost nothing.
    Equal rows are each returned; null ids count for no component_id. No documents, no rows.
    """
    marks = cut(fingerprints(docs, width))
    nodes = cut(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    trees = components(near_pairs(nodes.select("fingerprint"), distance))
    rooted = cut(nodes.join(trees, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "low"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fingerprint", "root").join(lows, "root")
    return marks.join(named, "fingerprint").select(
        "doc_id", "content", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, width=SHINGLE, distance=DISTANCE) -> DataFrame:
    """docs with one document of each class: the smallest doc_id, or of rows without id the
    smallest content; among equal rows any one. All columns stay."""
    named = cut(classes(docs, width, distance))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    first = named.groupBy("root").agg(F.min(order).alias("first")).select(
        "root", "first.doc_id", "first.content")
    kept = cut(named.join(first, [
        named.root == first.root, named.content == first.content,
        named.doc_id.eqNullSafe(first.doc_id)]).groupBy(
        named.doc_id.alias("_id"), named.content.alias("_content"))
        .agg(F.count(F.lit(1)).alias("_rows")))
    doc_id, content = row_key()
    keyed = docs.withColumns({"_key": doc_id, "_digest": content})
    met = keyed.join(kept, F.col("_key").eqNullSafe(F.col("_id"))
                     & (F.col("_digest") == F.col("_content")))
    extra = ["_key", "_digest", "_id", "_content", "_rows"]
    single = met.where("_rows = 1").drop(*extra)
    repeated = met.where("_rows > 1").dropDuplicates(["_key", "_digest"]).drop(*extra)
    return single.unionByName(repeated)
