"""Best-fit packing of documents into sequences by a grouping genetic algorithm."""

import random
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.shared import cut, whole
from gridwarden.llm.tokens import token_encoder

SEQUENCE = 2048
SEPARATOR = 0
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 6
POPULATION = 6

_PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids binary, "
           "lot int, nth bigint")


def cut_documents(docs: DataFrame, capacity=SEQUENCE, encoder=token_encoder) -> DataFrame:
    """Token pieces of every document, each at most ``capacity`` long.

    docs: doc_id, text (null: empty); other columns are ignored. A document is its token ids
    and a separator. A longer one is cut into whole pieces, what is left over coming first.

    Returns doc_id, piece, start, length, ids (packed little-endian unsigned 32-bit) and,
    for pack_pieces, lot (the task) and nth (the piece's number among those of its length there).
    """
    def pieces(batches):
        from pyspark import TaskContext
        encode, lot = encoder(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + SEPARATOR.to_bytes(4, "little")
                total = len(ids) // 4
                start, length = 0, total % capacity or min(total, capacity)
                piece = 0
                while start < total:
                    rows.append((doc_id, piece, start, length, ids[4 * start:4 * (start + length)],
                                 lot, int(seen[length])))
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            frame = pd.DataFrame(rows, columns=[
                "doc_id", "piece", "start", "length", "ids", "lot", "nth"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text")).alias("text")) \
        .mapInPandas(pieces, _PIECES)


# A solution is a dict from pattern to count; a pattern is the sorted lengths of one sequence.

def best_fit(counts, capacity, bins=None):
    """Places counted lengths, longest first, each into the fullest sequence that takes it.

    Sequences of one pattern are filled together, so the work depends on the number of
    different lengths and patterns and not on the number of documents.
    """
    groups, done = {}, {}

    def put(pattern, n):
        left = capacity - sum(pattern)
        if left == 0:
            done[pattern] = done.get(pattern, 0) + n
            return
        at = groups.setdefault(left, {})
        if not at:
            insort(lefts, left)
        at[pattern] = at.get(pattern, 0) + n

    lefts = []
    for pattern, n in (bins or {}).items():
        put(pattern, n)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(lefts, length)
            if i == len(lefts):
                fit = min(capacity // length, n)
                full, n = divmod(n, fit)
                put((length,) * fit, full)
                if n:
                    put((length,) * n, 1)
                break
            left = lefts[i]
            pattern, have = groups[left].popitem()
            if not groups[left]:
                del groups[left], lefts[i]
            fit = min(left // length, n)
            full = min(have, n // fit)
            put(tuple(sorted(pattern + (length,) * fit, reverse=True)), full)
            n -= full * fit
            if have > full:
                put(pattern, have - full)
    for at in groups.values():
        for pattern, n in at.items():
            done[pattern] = done.get(pattern, 0) + n
    return done


def fitness(solution, capacity):
    """Sequences used, then how unevenly they are filled (fuller ones are better)."""
    n = sum(solution.values())
    fill = sum(c * (sum(p) / capacity) ** 2 for p, c in solution.items())
    return n, -fill / max(n, 1)


def crossover(one, other, capacity, rng):
    """Whole well-filled sequences of ``other`` enter ``one``; what they displace is best-fitted."""
    full = sorted(other, key=lambda p: (-sum(p), p))
    take = full[:max(1, rng.randint(len(full) // 4, max(1, 3 * len(full) // 4)))]
    child, over = {}, {}
    for pattern in take:
        child[pattern] = n = max(1, other[pattern] // rng.choice((1, 1, 2)))
        for length in pattern:
            over[length] = over.get(length, 0) + n
    displaced = {}
    for pattern in sorted(one, key=lambda p: (sum(p), p)):
        stay = n = one[pattern]
        need = {}
        for length in pattern:
            need[length] = need.get(length, 0) + 1
        hits = [-(-over.get(length, 0) // k) for length, k in need.items() if over.get(length)]
        gone = min(n, max(hits, default=0))
        stay -= gone
        if gone:
            for length, k in need.items():
                dropped = min(over.get(length, 0), gone * k)
                over[length] = over.get(length, 0) - dropped
                if gone * k > dropped:
                    displaced[length] = displaced.get(length, 0) + gone * k - dropped
        if stay:
            child[pattern] = child.get(pattern, 0) + stay
    return best_fit(displaced, capacity, child)


def mutate(solution, capacity, rng):
    """Empties some of the least filled sequences and places their documents anew."""
    kept, loose = dict(solution), {}
    for pattern in sorted(solution, key=lambda p: (sum(p), p))[:max(1, len(solution) // 8)]:
        if rng.random() < 0.8:
            n = kept.pop(pattern)
            for length in pattern:
                loose[length] = loose.get(length, 0) + n
    return best_fit(loose, capacity, kept)


def evolve(population, counts, capacity, generations, size, rng):
    """Some generations on one island; the best come first."""
    if not population:
        population = [best_fit(counts, capacity)]
    while len(population) < size:
        population.append(mutate(rng.choice(population), capacity, rng))
    for _ in range(generations):
        population.sort(key=lambda s: fitness(s, capacity))
        one, other = rng.sample(population[:max(2, size // 2)], 2)
        child = mutate(crossover(one, other, capacity, rng), capacity, rng)
        population[-1] = child
    population.sort(key=lambda s: fitness(s, capacity))
    return population


_ELITE = "island int, rank int, patterns array<array<int>>, counts array<bigint>"


def plan_sequences(spark, counts, capacity=SEQUENCE, islands=ISLANDS, epochs=EPOCHS,
                   generations=GENERATIONS, size=POPULATION):
    """Pattern counts that place every counted length, by islands that trade their elite.

    ``counts`` has an entry for each length, at most ``capacity`` of them. Each island is a
    task that holds its own population; after an epoch its best solution goes to the next
    island. A solution has a few thousand patterns at most, whatever the documents' number.

    Where best fit alone needs as many sequences as the tokens fill, no plan is better, and no
    island runs.
    """
    floor = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = best_fit(counts, capacity)
    elite = {}

    def tasks(epoch, elite):
        def run(frames):
            for frame in frames:
                rows = []
                for island in frame["island"]:
                    rng = random.Random(1000 * epoch + int(island))
                    guests = [dict(s) for i in (island, (island - 1) % islands)
                              for s in elite.get(i, [])]
                    for rank, s in enumerate(evolve(
                            guests, counts, capacity, generations, size, rng)[:2]):
                        rows.append((island, rank, [list(p) for p in s], list(s.values())))
                yield pd.DataFrame(rows, columns=["island", "rank", "patterns", "counts"])
        return run

    for epoch in range(epochs):
        if sum(best.values()) <= floor:
            break
        grown = spark.range(0, islands, 1, islands).selectExpr("cast(id as int) island") \
            .mapInPandas(tasks(epoch, elite), _ELITE).collect()
        elite = {}
        for row in sorted(grown, key=lambda r: (r.island, r["rank"])):
            solution = {tuple(p): n for p, n in zip(row.patterns, row["counts"])}
            elite.setdefault(row.island, []).append(solution)
            best = min(best, solution, key=lambda s: fitness(s, capacity))
    return best


def _slots(plan):
    """Per length: from which rank on, which sequences and which offset; ranks are dense."""
    table, first = {}, 0
    for pattern in sorted(plan, key=lambda p: (-sum(p), p)):
        n, at = plan[pattern], 0
        for length in pattern:
            starts, bases, offsets = table.setdefault(length, ([0], [], []))
            starts.append(starts[-1] + n)
            bases.append(first)
            offsets.append(at)
            at += length
        first += n
    return {length: tuple(np.array(x, dtype=np.int64) for x in slots)
            for length, slots in table.items()}


def pack_pieces(pieces: DataFrame, capacity=SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, lot, nth); other columns stay.

    Pieces of one length are exchangeable, so the genetic algorithm works on the number of
    pieces of each length (at most ``capacity`` numbers). Each piece then finds its place from
    its rank among those of its length: the count in earlier lots plus its number in its lot.
    No length, however frequent, meets in one task.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    lots = pieces.groupBy("lot", "length").agg(F.count(F.lit(1)).alias("n"))
    lots = cut(lots)
    counts = {r.length: r.n for r in lots.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(spark, counts, capacity)))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = lots.select("lot", "length", F.coalesce(F.sum("n").over(before), F.lit(0))
                          .alias("_earlier"))
    ranked = pieces.join(offsets, ["lot", "length"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for one in np.unique(length):
            starts, bases, offsets = slots.value[int(one)]
            mine = np.flatnonzero(length == one)
            slot = np.searchsorted(starts, rank[mine], "right") - 1
            sequence[mine] = bases[slot] + rank[mine] - starts[slot]
            offset[mine] = offsets[slot]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    kept = [c for c in pieces.columns if c not in ("lot", "nth", "sequence_id", "offset")]
    return ranked.withColumn("_place", place("length", F.col("_earlier") + F.col("nth"))).select(
        *kept, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, capacity=SEQUENCE, encoder=token_encoder) -> DataFrame:
    """Every document's pieces with their token ids, sequence and place in it.

    Null and empty texts are one separator long. Equal rows are packed once each; a null
    doc_id stays null. No documents give no pieces.
    """
    return pack_pieces(cut_documents(docs, capacity, encoder), capacity)
