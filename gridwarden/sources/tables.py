"""Stored tables on Parquet."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridwarden import schemas

COMMITS = "_commits"
COMMIT_SCHEMA = "version string, committed double"


def stored_files(spark, path, schema):
    """What is stored under ``path``; no rows if nothing has been written there yet.

    Any other failure is raised: a table that can't be read is not an empty one.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark, root, table, columns=None, since=None):
    """A stored table; only the asked columns are read from the files.

    Of a table stored by day, days before ``since`` (a date) are not read.
    """
    schema = schemas.TABLES[table]
    rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    if since is not None:
        rows = rows.where(F.col("event_date") >= F.lit(since))
    return rows.select(*columns or schema.names)


def current_version(spark, root, table):
    """Name of the newest complete version of a replaced table, or None."""
    commits = stored_files(spark, f"{root}/{table}/{COMMITS}", COMMIT_SCHEMA)
    newest = F.max_by("version", F.struct("committed", "version"))
    return commits.agg(newest.alias("v")).first()["v"]


def read_snapshot(spark, root, table):
    """The newest complete version of a table that is replaced as a whole."""
    version = current_version(spark, root, table)
    df = spark.read.schema(schemas.TABLES[table])
    return df.parquet(f"{root}/{table}/{version}")
