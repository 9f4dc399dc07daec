"""Table writers. A failed write fails the job or the micro-batch; nothing is skipped."""

import datetime
import time
import uuid

from pyspark.sql import functions as F

from gridwarden import schemas
from gridwarden.functions.times import epoch_micros
from gridwarden.operators.state import newest_rows
from gridwarden.session import filesystem
from gridwarden.sources.tables import COMMIT_SCHEMA, COMMITS, read_snapshot, stored_files


def to_table(df, table):
    """Project to the stored columns and types; a missing column becomes NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TABLES[table].fields
    ])


def append(df, root, table):
    """Append rows. Every call writes a folder of its own."""
    append_once(df, root, table, 0, f"append-{uuid.uuid4().hex}")


def append_once(df, root, table, batch_id, producer):
    """Append one micro-batch of a producer; a replayed batch overwrites its own folders.

    ``producer`` names the run, such as a stream's checkpoint id. All writers of a table use
    this one layout, and none can touch the rows of another. Tables with a time are stored by
    day, with as few files per day as the size of the batch allows.
    """
    rows, part = to_table(df, table), f"{producer}.{batch_id}"
    if table not in schemas.DATED:
        rows.write.mode("overwrite").parquet(f"{root}/{table}/part={part}")
        return
    dated = with_event_date(rows, schemas.DATED[table]).withColumn("part", F.lit(part))
    dated.hint("rebalance", "event_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("event_date", "part").parquet(
        f"{root}/{table}")


def unseen(df, existing, key="source_key"):
    """One row per key that the stored table does not hold yet."""
    return df.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_new(df, root, table, key="source_key"):
    """Append rows with unseen keys. The first write creates the table."""
    stored = stored_files(df.sparkSession, f"{root}/{table}", schemas.TABLES[table])
    append(unseen(to_table(df, table), stored, key), root, table)


def append_new_by_key(df, table_name, table, buckets, key="source_key", path=None):
    """Append rows with unseen keys to a catalog table that is stored in buckets of its keys.

    The first write creates it, in the warehouse or under ``path``, with ``buckets`` buckets,
    as many as make its files about ``FILE_BYTES`` large; later ones keep its number. Only new
    rows are shuffled, first to one row per key, then to the bucket of the key, where they meet
    the stored keys, which are read in place. Repeated keys and replayed batches change nothing;
    rows without a key count as one key that is never stored yet, as in ``append_new``. For one
    writer at a time: two that run together may both add a key.
    """
    spark = df.sparkSession
    rows = to_table(df, table).dropDuplicates([key])
    if spark.catalog.tableExists(table_name):
        spec = {r["col_name"]: r["data_type"] for r in spark.sql(
            f"DESCRIBE FORMATTED {table_name}").where("col_name = 'Num Buckets'").collect()}
        buckets = int(spec["Num Buckets"])
        rows = unseen_in_buckets(rows, spark.table(table_name), buckets, key)
    else:
        rows = rows.repartition(buckets, key)
    writer = rows.write.mode("append").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table_name)


def unseen_in_buckets(rows, stored, buckets, key="source_key"):
    """Rows whose key a table of as many buckets does not hold; the table is not shuffled."""
    return rows.repartition(buckets, key).join(
        stored.select(key).hint("merge"), key, "left_anti")


def replace(df, root, table, committed=None):
    """Write a new version, then commit it; readers never see a half-written table."""
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    to_table(df, table).write.parquet(f"{root}/{table}/{version}")
    commit = [(version, float(committed if committed is not None else time.time()))]
    spark.createDataFrame(commit, COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{root}/{table}/{COMMITS}")
    return version


def refresh_latest(spark, root, table, margin=600):
    """Take what the log ``table`` has gained into its kept newest rows, ``latest_`` and its name.

    Only files written since the last refresh are read, and those of ``margin`` seconds before
    it, for writers whose clocks differ: a row that is taken twice changes nothing. Returns how
    many files were read.
    """
    kept = f"latest_{table}"
    commits = stored_files(spark, f"{root}/{kept}/{COMMITS}", COMMIT_SCHEMA)
    through = commits.agg(F.max("committed")).first()[0]
    log = spark.read.schema(schemas.TABLES[table])
    if through is not None:
        since = datetime.datetime.fromtimestamp(through - margin, datetime.timezone.utc)
        log = log.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S")).option(
            "timeZone", "UTC")
    tail = log.parquet(f"{root}/{table}")
    written = tail.select(F.max("_metadata.file_modification_time").cast("double"), F.count_distinct(
        "_metadata.file_path")).first()
    if written[1]:
        rows = tail.select(*schemas.TABLES[table].names)
        if through is not None:
            rows = rows.unionByName(read_snapshot(spark, root, kept))
        replace(newest_rows(rows, table), root, kept, written[0])
    return written[1]


def with_event_date(df, ts="ts"):
    """Add the UTC day, whatever the session's time zone."""
    day = F.floor(epoch_micros(F.col(ts)) / 86_400_000_000).cast("int")
    return df.withColumn("event_date", F.date_from_unix_date(day))


def write_by_date(df, table_name, ts="ts", sort=("ts", "id")):
    """Append to a catalog table partitioned by day, each file sorted by the table's key."""
    dated = with_event_date(df, ts)
    dated.sortWithinPartitions("event_date", *sort).write.mode("append").partitionBy(
        "event_date").format("parquet").saveAsTable(table_name)


def retain(df, days, as_of, ts="ts"):
    """Rows of the last ``days`` days before the epoch second ``as_of``; older partitions of
    a table by ``event_date`` are not read."""
    first = float(as_of) - days * 86400.0
    rows = df.where(F.col(ts) >= F.lit(first))
    if "event_date" in df.columns:
        day = datetime.date(1970, 1, 1) + datetime.timedelta(days=first // 86400)
        rows = rows.where(F.col("event_date") >= F.lit(day))
    return rows


def drop_expired(spark, table_name, days, as_of):
    """Drop whole day partitions older than ``days`` days; returns the dropped days."""
    last = datetime.datetime.fromtimestamp(as_of, datetime.timezone.utc).date()
    oldest = last - datetime.timedelta(days=days)
    names = spark.sql(f"SHOW PARTITIONS {table_name}").collect()  # one row per day
    days_held = [r[0].split("=", 1)[1] for r in names]
    expired = sorted(d for d in days_held if d[:4].isdigit() and d < oldest.isoformat())
    if expired:
        specs = ", ".join(f"PARTITION (event_date = DATE'{d}')" for d in expired)
        spark.sql(f"ALTER TABLE {table_name} DROP IF EXISTS {specs}")
    return expired


# -- stored days --------------------------------------------------------------------

FILE_BYTES = 128 << 20
_MERGING, _REPLACED = "_merging", "_replaced"


def _days(spark, root, table, before):
    """(day, bytes, folders) of the stored days before a day."""
    files, top = filesystem(spark, f"{root}/{table}")
    for day in files.listStatus(top):
        name = day.getPath().getName()
        if name.startswith("event_date=") and name[11:] < before:  # nulls' folder sorts later
            size = files.getContentSummary(day.getPath())
            yield name[11:], size.getLength(), len(files.listStatus(day.getPath()))


def _utc_day(as_of, days=0):
    day = datetime.datetime.fromtimestamp(as_of, datetime.timezone.utc).date()
    return (day - datetime.timedelta(days=days)).isoformat()


def merge_days(spark, root, table, as_of, file_bytes=FILE_BYTES):
    """Merge the small files of all days before that of the epoch second ``as_of``.

    Each such day with more than one folder is written anew, sorted by time and the other
    columns, in files of about ``file_bytes`` that readers can skip by their least and greatest
    values, and then put in the place of the old folder. Returns the days.

    For days that nothing is written to any more. A reader that begins between the two moves of
    a day misses that day, and one that is at work may have to be run again. If the job stops
    half-way no row is lost: the next call first puts the unfinished day in its place. A stream
    over the table takes merged files as new ones.
    """
    store = f"{root}/{table}"
    _finish(spark, root, table)
    days = [(d, size) for d, size, folders in _days(spark, root, table, _utc_day(as_of))
            if folders > 1]
    if not days:
        return []
    names = [d for d, _ in days]
    schema = schemas.TABLES[table]
    time = schemas.DATED[table]
    order = ["event_date", time, *[c for c in schema.names if c != time]]
    rows = spark.read.option("basePath", store).schema(f"{schema.toDDL()}, event_date date").parquet(
        *[f"{store}/event_date={d}" for d in names])
    count = len(names) + sum(size for _, size in days) // file_bytes
    rows.select(*schema.names, "event_date", F.lit("merged").alias("part")).repartitionByRange(
        count, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "event_date", "part").parquet(f"{root}/{_MERGING}/{table}")
    _finish(spark, root, table)
    return sorted(names)


def _finish(spark, root, table):
    """Put merged days in their places. Days are moved only out of a complete merge, and the
    merged rows of a day stay until its old folder is out of the way."""
    files, merging = filesystem(spark, f"{root}/{_MERGING}/{table}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not files.exists(merging):
        return
    if files.exists(path(merging, "_SUCCESS")):
        replaced = path(f"{root}/{_REPLACED}/{table}")
        files.mkdirs(replaced)
        for day in files.listStatus(merging):
            name = day.getPath().getName()
            if not name.startswith("event_date="):
                continue
            here, old = path(f"{root}/{table}/{name}"), path(replaced, name)
            if files.exists(here) and not files.exists(old) and not files.rename(here, old):
                raise OSError(f"cannot move {here}")
            if not files.rename(day.getPath(), here):
                raise OSError(f"cannot move {day.getPath()}")
            files.delete(old, True)
        files.delete(replaced, True)
    files.delete(merging, True)


def drop_days(spark, root, table, days, as_of):
    """Delete the stored days older than ``days`` days; returns them."""
    files, top = filesystem(spark, f"{root}/{table}")
    expired = sorted(d for d, _, _ in _days(spark, root, table, _utc_day(as_of, days)))
    for day in expired:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(top, f"event_date={day}"), True)
    return expired
