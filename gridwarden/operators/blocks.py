"""Joins on a computed condition, cut into pieces of bounded size."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Tasks that share the left rows, per core, and about how many right rows a task holds at most.
TASKS_PER_CORE, HELD_ROWS = 4, 65_536

_GROUP = ["cell", "deal", "cut"]


def cell_join(left, right, left_id, right_id, left_rows, right_rows, fn, schema, hold=None):
    """Run ``fn(left piece, right piece)`` for all pieces that share a ``cell``.

    The left rows of a cell are dealt to a number of tasks that only the cores decide, and each
    of these gets the cell's right rows, so what is shuffled grows with the rows and not with
    their pairs. A task holds the right rows, and those of a cell of more than ``HELD_ROWS`` are
    cut over as many tasks; the left rows stream past, ``left_rows`` at a time against
    ``right_rows`` of the held ones. ``fn`` takes and returns Arrow tables and should return only
    the rows that are kept. With ``hold``, right rows are put into another form once for all left
    pieces: ``hold(all right rows)`` is what ``fn`` then takes with each left piece, and cutting it
    is its own matter.
    """
    spark = left.sparkSession
    # One row per cell, of which callers make a fixed number.
    held = right.groupBy("cell").agg(F.count("*").alias("n")).collect()
    if not held:
        return spark.createDataFrame([], schema)
    total, tasks = sum(r["n"] for r in held), TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    sizes = F.broadcast(spark.createDataFrame([
        (r["cell"], math.ceil(tasks * max(r["n"] / total, 1 / len(held))),
         math.ceil(r["n"] / HELD_ROWS)) for r in held], "cell int, deals int, cuts int"))

    def one_of(key, n):
        return F.pmod(F.xxhash64(key), n).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(df, deal, cut, number):
        own = F.struct(*[c for c in df.columns if c != "cell"])
        rows = [F.lit(None).cast(_row(other)) for other in (left, right)]
        rows[number] = own
        return df.join(sizes, "cell").withColumn("deal", deal).withColumn("cut", cut).select(
            *_GROUP, F.lit(number).alias("side"), *[
                row.alias(name) for row, name in zip(rows, ("left", "right"))])

    met = side(left, one_of(left_id, F.col("deals")), each("cuts"), 0).unionByName(
        side(right, each("deals"), one_of(right_id, F.col("cuts")), 1))
    # The right rows of a group come first.
    return met.repartition(tasks, *_GROUP).sortWithinPartitions(
        *_GROUP, F.desc("side")).mapInArrow(_meet(left_rows, right_rows, fn, hold), schema)


def _row(df):
    fields = [f for f in df.schema.fields if f.name != "cell"]
    return f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in fields)}>"


def _meet(left_rows, right_rows, fn, hold):
    """``fn`` over sorted groups, with one group's right rows in memory at a time."""
    def met(lefts, rights):
        whole = pa.concat_tables(lefts).combine_chunks()
        for at in range(0, len(whole), left_rows):
            for right in rights:
                yield from fn(whole.slice(at, left_rows), right).to_batches()

    def run(batches):
        group, loose, rights, lefts = None, [], [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False)
                             for c in (*_GROUP, "side")])
            ends = [*(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1), len(batch)]
            begin = 0
            for end in map(int, ends):
                if begin == end:
                    continue
                *key, side = keys[:, begin].tolist()
                rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(
                    batch.column("right" if side else "left").slice(begin, end - begin))])
                begin = end
                if key != group:
                    if lefts:
                        yield from met(lefts, rights)
                    group, loose, rights, lefts = key, [], [], []
                if side:
                    loose.append(rows)
                    continue
                if loose:
                    whole, loose = pa.concat_tables(loose).combine_chunks(), []
                    rights = [hold(whole)] if hold else [
                        whole.slice(at, right_rows) for at in range(0, len(whole), right_rows)]
                lefts.append(rows)
                n = sum(map(len, lefts))
                if rights and n >= left_rows:
                    whole = pa.concat_tables(lefts)
                    full = n - n % left_rows
                    yield from met([whole.slice(0, full)], rights)
                    lefts = [whole.slice(full)] if full < n else []
                elif not rights:
                    lefts = []
        if lefts:
            yield from met(lefts, rights)

    return run
