"""Text embedding and exact nearest neighbours by cosine distance."""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T, Window as W

from gridwarden.functions.scores import RANK_DIGITS
from gridwarden.operators.blocks import cell_join
from gridwarden.session import materialize
from gridwarden.sources.tables import stored_files

LEFT_ROWS, RIGHT_ROWS = 4096, 8192
ROWS_AT_ONCE, REFS_AT_ONCE = 512, 1024
VISITS_AT_ONCE, PAIRS_AT_ONCE = 16_384, 16_384
FAR = 9.0  # farther than any reference


# -- embedding ----------------------------------------------------------------------

def _slots(text, dim):
    """The slot of each word (letters and digits of any script), by its MD5 digest."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"), F.lit(dim)).cast("string"))


def _counted(texts, dim):
    """texts with ``counts``, a sparse vector of how many words fall into each slot."""
    from pyspark.ml.feature import CountVectorizerModel  # here: Python workers need none of it
    slots = texts.withColumn("_slots", _slots(F.col("text"), dim))
    return CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], "_slots", "counts").transform(slots).drop("_slots")


def hashing_encoder(dim=64):
    """Feature hashing: each word counts in the slot its MD5 digest picks.

    Needs no model and no Python; the words of a text are counted in one pass over them.
    """
    def encode(texts):
        from pyspark.ml.functions import vector_to_array
        return _counted(texts, dim).select(
            "text", vector_to_array("counts", "float32").alias("embedding"))
    encode.on_frame = True
    return encode


def weighted_encoder(corpus, dim=64):
    """Feature hashing with slots weighted by how few texts of the corpus fall into them,
    ln((texts + 1) / (texts with the slot + 1)), and vectors of length one.

    One pass over the corpus (``text``) fits the weights; a text of no weight stays zero.
    """
    from pyspark.ml.feature import IDF, Normalizer
    from pyspark.ml.functions import vector_to_array
    idf = IDF(inputCol="counts", outputCol="weighted").fit(
        _counted(corpus.select("text").where("text IS NOT NULL"), dim))
    normal = Normalizer(inputCol="weighted", outputCol="unit", p=2.0)

    def encode(texts):
        return normal.transform(idf.transform(_counted(texts, dim))).select(
            "text", vector_to_array("unit", "float32").alias("embedding"))
    encode.on_frame = True
    return encode


def model_encoder(factory, batch=256):
    """A caller's model. ``factory()`` runs once per task and returns a function from a
    list of texts to a 2-d array of vectors."""
    def encode(texts):
        def run(batches):
            model = factory()
            for pdf in batches:
                for at in range(0, len(pdf), batch):
                    part = pdf.iloc[at:at + batch]
                    vectors = np.asarray(model(part["text"].tolist()), dtype=np.float32)
                    yield part.assign(embedding=list(vectors))
        return texts.mapInPandas(run, "text string, embedding array<float>")
    encode.on_frame = True
    return encode


def embed_texts(texts, encoder):
    """(text, embedding) for each distinct value of the column ``text``."""
    distinct = texts.select("text").where("text IS NOT NULL").distinct()
    if getattr(encoder, "on_frame", False):
        return encoder(distinct)
    return distinct.withColumn("embedding", encoder(F.col("text")))


def embed(df, col, encoder, name="embedding"):
    """Add the vector of a text column; every distinct text is encoded once."""
    vectors = embed_texts(df.select(F.col(col).alias("text")), encoder)
    return df.join(
        vectors.select(F.col("text").alias(col), F.col("embedding").alias(name)), col, "left")


_VECTORS = "text_id string, embedding array<float>"


def embed_cached(texts, encoder, path):
    """``embed_texts`` with the vectors kept under ``path`` by the texts' content: only texts
    that no earlier call has encoded go to the encoder. One encoder per path."""
    spark = texts.sparkSession
    distinct = texts.select("text").where("text IS NOT NULL").distinct().withColumn(
        "text_id", F.sha2("text", 256))
    held = stored_files(spark, path, _VECTORS).select("text_id")
    new = embed_texts(distinct.join(held, "text_id", "left_anti"), encoder)
    new.select(F.sha2("text", 256).alias("text_id"), "embedding").write.parquet(
        f"{path}/run={uuid.uuid4().hex}")
    # Calls at the same time may have encoded the same text.
    vectors = stored_files(spark, path, _VECTORS).dropDuplicates(["text_id"])
    return distinct.join(vectors, "text_id").select("text", "embedding")


# -- nearest neighbours -------------------------------------------------------------

def nearest(queries, refs, k, cells=None, left_rows=LEFT_ROWS, right_rows=RIGHT_ROWS):
    """The ``k`` nearest references of each query, exactly.

    Both inputs are (id, vec). Distances are rounded to RANK_DIGITS before ranking, and
    equal ones are ordered by reference id. A zero or missing vector has no direction and
    takes no part. Result: query_id, ref_id, distance, rank.

    References are grouped around pivots, whose number grows with the root of theirs
    (``cells`` sets it). On unit vectors the Euclidean distance e and the cosine distance c
    agree in order (e*e = 2c), and e obeys the triangle inequality: with d the distance from a
    query to a pivot and [low, high] those of the pivot's references to it, none of them is
    nearer than max(d-high, low-d). A query visits the cells that start nearest first; how far
    its k-th reference is then decides which others can still hold a nearer one, and it visits
    these. Only k rows per query leave a cell, and crowded cells are cut on both sides; a task
    writes some visits at a time, however many cells there are. Within a cell, products in single
    precision rule out what cannot be among the k nearest, by a bound on their error; the others
    are measured in double precision.
    """
    spark = queries.sparkSession
    schema = _result_schema(queries, refs)
    ref_type = refs.schema["id"].dataType.simpleString()
    query_type = queries.schema["id"].dataType.simpleString()
    whole = refs.select("id", "vec").where(F.exists("vec", lambda x: x != 0))
    n = whole.count()
    if not n:
        return spark.createDataFrame([], schema)
    cells = cells or max(1, round(n ** 0.5 / 32))
    pivots = whole.orderBy(F.xxhash64("id"), "id").limit(cells)
    shared = spark.sparkContext.broadcast(_units(pivots.toPandas())[1])

    def to_pivots(units):
        cos = np.clip(units @ shared.value.T, -1.0, 1.0)
        return np.sqrt(2.0 - 2.0 * cos)

    def assign(batches):
        for pdf in batches:
            ids, units = _units(pdf)
            if len(ids):
                dist = to_pivots(units)
                cell = dist.argmin(axis=1)
                yield pd.DataFrame({
                    "id": ids, "vec": list(units), "cell": cell.astype(np.int32),
                    "far": dist[np.arange(len(ids)), cell]})

    # Unit vectors in double precision from here on.
    placed = whole.mapInPandas(
        assign, f"id {ref_type}, vec array<double>, cell int, far double")
    if cells > 1:
        placed = materialize(placed, "cells")
        # One row per pivot.
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"),
                                           F.max("far").alias("high")).toPandas()
        cell_ids, held, low, high = (
            stats[c].to_numpy() for c in ("cell", "n", "low", "high"))
    else:
        cell_ids, held, low, high = (np.array([x]) for x in (0, n, 0.0, 2.0))
    slack = 1e-6  # far above the rounding of the distances

    def visits(batches, later):
        step = max(1, VISITS_AT_ONCE // len(cell_ids))
        for pdf in (b[i:i + step] for b in batches for i in range(0, len(b), step)):
            at, units = _units(pdf.assign(id=range(len(pdf))))
            if not len(at):
                continue
            ids, d = pdf["id"].to_numpy()[at], to_pivots(units)[:, cell_ids]
            starts = np.maximum(np.maximum(d - high, low - d), 0.0)
            order = np.lexsort((d, starts), axis=1)
            rows = np.arange(len(ids))[:, None]
            # the nearest cells that hold k references together come first
            before = np.cumsum(held[order], axis=1) - held[order]
            first = np.empty(order.shape, bool)
            first[rows, order] = before < k
            far = np.full(len(ids), FAR)
            if later:
                far = pdf["far"].fillna(FAR).to_numpy(float)[at]
                reach = np.sqrt(2.0 * np.maximum(far, 0.0))
                wanted = ~first & (starts <= reach[:, None] + slack)
            else:
                wanted = first
            row, cell = np.nonzero(wanted)
            if len(row):
                yield pd.DataFrame({
                    "id": ids[row], "vec": list(units[row]),
                    "cell": cell_ids[cell].astype(np.int32), "far": far[row]})

    def hold(refs):
        ids, units = _table_units(refs.sort_by("id"))
        return ids, units, units.astype(np.float32), refs.schema.field("id").type

    def piece(left, held):
        query_ids, q = _table_units(left)
        ref_ids, r, screen, ref_type = held
        # A cell visited later need not give what is farther than the k found before.
        far = left.column("far").to_numpy()
        row, ref, value, rank = _top_k(q, r, screen, far, k, right_rows)
        return pa.table({
            "query_id": pa.array(query_ids[row], left.schema.field("id").type),
            "ref_id": pa.array(ref_ids[ref], ref_type),
            "distance": value, "rank": pa.array(rank.astype(np.int32))})

    def met(asked, later):
        found = asked.mapInPandas(lambda batches: visits(batches, later),
                                  f"id {query_type}, vec array<double>, cell int, far double")
        return cell_join(found, placed.drop("far"), "id", "id", left_rows, right_rows,
                         piece, schema, hold)

    def best(found):
        order = W.partitionBy("query_id").orderBy("distance", "ref_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = queries.select("id", "vec")
    found = best(met(queries, False))
    if cells == 1:
        return found
    found = materialize(found, "neighbours")
    reached = found.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("distance").alias("far"))
    return best(found.unionByName(met(queries.join(reached, "id", "left"), True)))


def _result_schema(queries, refs):
    return T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType),
        T.StructField("ref_id", refs.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])


def _units(pdf):
    """Ids and unit vectors of the rows whose vector is not zero."""
    pdf = pdf[pdf["vec"].notna()]
    m = np.asarray(pdf["vec"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
    norms = np.sqrt((m * m).sum(axis=1))
    keep = norms > 0
    return pdf["id"].to_numpy()[keep], m[keep] / norms[keep, None]


def _table_units(table):
    """``_units`` of an Arrow table without a missing vector, without an object per row."""
    m = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    norms = np.sqrt((m * m).sum(axis=1))
    keep = norms > 0
    return table.column("id").to_numpy()[keep], m[keep] / norms[keep, None]


def _top_k(query_units, ref_units, screen, far, k, right_rows):
    """Row numbers, reference numbers, distances and ranks of the nearest references that are no
    farther than ``far``; references in id order.

    ``screen`` holds the references in single precision.
    """
    parts = []
    for at in range(0, len(query_units), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        kept = _k_nearest(query_units[rows], ref_units, screen, far[rows], k, right_rows)
        row, place = np.nonzero(kept[1] >= 0)
        parts.append((row + at, kept[1][row, place], kept[0][row, place] + 0.0, place + 1))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    return [np.concatenate(p) for p in zip(*parts)]


def _k_nearest(queries, refs, screen, far, k, right_rows):
    """Distances and numbers of each query's ``k`` nearest references, -1 where there are fewer."""
    dist = np.full((len(queries), k), np.inf)
    ref_no = np.full((len(queries), k), -1)
    single = queries.astype(np.float32)
    # Above the error of a product of unit vectors in single precision, and of rounding.
    slack = (queries.shape[1] + 8) * 1.2e-7 + 10.0 ** -RANK_DIGITS
    bound, waiting = far.copy(), []
    floor = (1.0 - slack - bound[:, None]).astype(np.float32)

    def put(row, ref, value):
        _merge(dist, ref_no, row, ref, value)
        np.minimum(far, dist[:, -1], out=bound)
        floor[:] = 1.0 - slack - bound[:, None]

    def settle():
        if waiting:
            row, ref = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            value = np.concatenate([
                np.round(1.0 - np.einsum("ij,ij->i", queries[row[i:i + PAIRS_AT_ONCE]],
                                         refs[ref[i:i + PAIRS_AT_ONCE]]), RANK_DIGITS)
                for i in range(0, len(row), PAIRS_AT_ONCE)])
            keep = value <= bound[row]
            put(row[keep], ref[keep], value[keep])

    step = min(right_rows, REFS_AT_ONCE)
    for at in range(0, len(refs), step):
        cos = single @ screen[at:at + step].T
        near = np.flatnonzero(cos >= floor)
        if 8 * len(near) > cos.size:  # the first references, or many equally near ones
            settle()
            exact = np.round(1.0 - queries @ refs[at:at + step].T, RANK_DIGITS)
            kth = min(k, exact.shape[1]) - 1
            last = np.minimum(np.partition(exact, kth, axis=1)[:, kth], bound)
            row, ref = np.nonzero(exact <= last[:, None])
            put(row, ref + at, exact[row, ref])
        elif len(near):
            row, ref = np.divmod(near, cos.shape[1])
            waiting.append((row, ref + at))
            # A few more candidates cost less than to put each piece's own in their places.
            if sum(len(x) for x, _ in waiting) >= len(queries):
                settle()
    settle()
    return dist, ref_no


def _merge(dist, ref_no, row, ref, value):
    """Put what was found in rows among the nearest so far; equal ones by their number."""
    touched = np.unique(row)
    own, place = np.nonzero(ref_no[touched] >= 0)
    own = touched[own]
    row = np.concatenate([own, row])
    value = np.concatenate([dist[own, place], value])
    ref = np.concatenate([ref_no[own, place], ref])
    order = np.lexsort((ref, value, row))
    row, ref, value = row[order], ref[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < dist.shape[1]
    dist[row[keep], rank[keep]] = value[keep]
    ref_no[row[keep], rank[keep]] = ref[keep]
