"""Benchmark decontamination by a prefix-filtered set join."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import alnum_words, cut, row_key

WINDOW = 13
SHINGLE = 5
#: (window, item) pairs that one broadcast may hold; about 300 bytes each.
BLOCK_PAIRS = 200_000


def _shingle(words, start, width):
    return F.xxhash64(F.lit(width), *[F.get(words, start + i) for i in range(width)])


def item_windows(items: DataFrame, window=WINDOW) -> DataFrame:
    """Distinct windows of the items' words, with the ids of the items that hold them."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("words")).where(
        F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    cuts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return (cuts.select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("window"))
            .groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


def _positions(docs, widths, carried=()):
    """A row for each word position and shingle width, and one at position -1 per document."""
    keys = F.array(*[_shingle(F.col("words"), F.col("at"), w) for w in widths])
    places = docs.select(
        *carried, "words",
        F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    if len(widths) == 1:
        return places.withColumn("shingle", F.when(F.col("at") >= 0, keys[0]))
    return places.withColumn("shingle", F.explode(
        F.when(F.col("at") >= 0, keys).otherwise(F.array(F.lit(None).cast("bigint")))))


def prefix_table(docs: DataFrame, windows: DataFrame, widths, blocks) -> DataFrame:
    """Each window with its rarest shingle and where in the window that stands.

    A window must occur whole, so all its shingles are needed and a prefix of one, in order
    of rarity over all documents, is enough to find every occurrence.
    """
    width = F.least(F.size("window"), F.lit(SHINGLE))
    offsets = windows.withColumn("width", width).select(
        "window", "items", "width",
        F.explode(F.sequence(F.lit(0), F.size("window") - F.col("width"))).alias("offset"))
    key = reduce(lambda rest, w: F.when(
        F.col("width") == w, _shingle(F.col("window"), F.col("offset"), w)).otherwise(rest),
        widths, F.lit(None).cast("bigint"))
    offsets = cut(offsets.withColumn("shingle", key))
    wanted = offsets.select("shingle").distinct()
    places = _positions(docs, widths).select("shingle").where("shingle is not null")
    counts = reduce(DataFrame.unionByName, [
        places.join(F.broadcast(part), "shingle").groupBy("shingle").count()
        for part in _blocks(wanted, "shingle", blocks)])
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("offset"), F.col("shingle"))
    return cut(offsets.join(counts, "shingle", "left").groupBy("window").agg(
        F.first("items").alias("items"), F.min(rank).alias("rarest")).select(
        "window", "items", F.col("rarest.offset").alias("offset"),
        F.col("rarest.shingle").alias("shingle")))


def _blocks(df, column, count):
    if count == 1:
        return [df]
    return [df.where(F.pmod(F.hash(column), F.lit(count)) == i) for i in range(count)]


def contamination(docs: DataFrame, items: DataFrame, window=WINDOW) -> DataFrame:
    """Per document, the words that lie in an occurrence of an item window.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are runs of
    digits, ASCII letters in lower case and non-ASCII characters. A window is ``window``
    consecutive item words, or the whole item if it has fewer.

    Returns doc_id, content (md5 of the text), n_words, n_hit, n_items, items (sorted as strings), hits (start and length
    of each merged run of hit words) and contaminated (n_hit > 0 and 20 n_hit >= n_words).
    A null or empty text has no words and is clean; an item without words has no window; a null
    item_id counts for hits but is not listed. Equal rows are each returned. Without items, or
    without documents, nothing is hit.

    Documents are read twice, once to count the shingles' rarity and once to join, and only
    the hits are shuffled. The items' side is broadcast in blocks of a bounded number of
    windows, so the join has no hot key whatever the items' number.
    """
    windows = cut(item_windows(items, window))
    size = windows.agg(
        F.coalesce(F.sum(F.size("items") + F.size("window")), F.lit(0)).alias("pairs"),
        F.collect_set(F.least(F.size("window"), F.lit(SHINGLE))).alias("widths")).first()
    widths = sorted(size.widths) or [SHINGLE]
    blocks = 1 + size.pairs // (BLOCK_PAIRS * 4)
    words = docs.select(*row_key(), alnum_words(F.col("text")).alias("words"))
    prefixes = prefix_table(words, windows, widths, blocks).withColumn(
        "length", F.size("window"))
    keyed = _positions(words, widths, ("doc_id", "content"))
    parts = []
    for number, part in enumerate(_blocks(prefixes, "shingle", blocks)):
        met = keyed if number == 0 else keyed.where("at >= 0")
        met = met.join(F.broadcast(part), "shingle", "left").where("at < 0 or window is not null")
        begin = F.col("at") - F.col("offset")
        fits = (begin >= 0) & (begin + F.col("length") <= F.size("words"))
        same = F.when(fits, F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("length"))
                      == F.col("window")).otherwise(F.lit(False))
        parts.append(met.where((F.col("at") < 0) | same).select(
            "doc_id", "content",
            F.when(F.col("at") < 0, F.size("words").cast("bigint")).alias("n_words"),
            F.when(F.col("at") >= 0, F.struct(begin.alias("start"), F.col("length"))).alias("run"),
            F.when(F.col("at") >= 0, F.col("items")).alias("items")))
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "content").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.sort_array(F.collect_set("run")).alias("runs"),
        F.sort_array(F.array_distinct(F.transform(
            F.flatten(F.collect_set("items")), lambda i: i.cast("string")))).alias("items"))
    merged = found.withColumn("hits", _merged(F.col("runs")))
    counted = merged.select(
        "doc_id", "content", "n_words",
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["length"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), "items", "hits",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return counted.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merged(runs):
    """Sorted runs with those that touch or overlap joined into one."""
    kind = "array<struct<start:bigint,length:bigint>>"
    state = F.struct(F.array().cast(kind).alias("done"),
                     F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))

    def piece(s):
        return F.array(F.struct(s["start"].alias("start"),
                                (s["end"] - s["start"]).alias("length")))

    def step(s, run):
        end = (run["start"] + run["length"]).cast("bigint")
        joins = (s["start"] >= 0) & (run["start"] <= s["end"])
        return F.struct(
            F.when(joins | (s["start"] < 0), s["done"]).otherwise(
                F.concat(s["done"], piece(s))).alias("done"),
            F.when(joins, s["start"]).otherwise(run["start"].cast("bigint")).alias("start"),
            F.when(joins, F.greatest(s["end"], end)).otherwise(end).alias("end"))

    return F.aggregate(runs, state, step, lambda s: F.when(
        s["start"] < 0, s["done"]).otherwise(F.concat(s["done"], piece(s))))
