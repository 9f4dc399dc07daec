"""Newline-JSON logs, read whole in batch or file by file as a stream."""

from pyspark.sql import functions as F, types as T

from gridwarden import schemas

CORRUPT = "_corrupt_record"


def read_logs(spark, path, kind, streaming=False, files_per_trigger=None):
    """Rows of one log kind plus the raw text of lines that do not parse.

    Point it at closed (rotated) files: a stream picks up each new file once and
    remembers it in its checkpoint.
    """
    schema = T.StructType(schemas.LOGS[kind].fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def split_rejects(logs, valid=None):
    """(good rows, rejects): rejects did not parse, or fail the ``valid`` test."""
    good = F.col(CORRUPT).isNull()
    if valid is not None:
        good = good & F.coalesce(valid, F.lit(False))
    return logs.where(good).drop(CORRUPT), logs.where(~good)


def read_agent_batches(spark, path, streaming=False):
    return read_logs(spark, path, "agent_batches", streaming)
