"""Session settings and the shared working folder."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_written = ContextVar("written", default=None)


def build_session(app="gridwarden", master=None, **conf):
    """A session with the settings the library relies on.

    ``conf`` keys use ``__`` for ``.``: ``spark__sql__shuffle__partitions=8``.
    On a cluster leave ``master`` unset and let the submit settings win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder every executor can reach, as named by the cluster.

    Only a local-mode session without the setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by the executors")
        folder = tempfile.mkdtemp(prefix="gridwarden-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def fresh_path(spark, name):
    """A path under the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Unlike a cache the files outlive a lost executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _written.get() is not None:
        _written.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark):
    """Delete at the end what ``materialize`` wrote inside, also after a failure.

    For jobs that store their results inside the scope; a frame made there cannot be read
    once it is over.
    """
    paths = []
    outer = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(outer)
        for path in paths:
            files, folder = filesystem(spark, path)
            files.delete(folder, True)


def filesystem(spark, path):
    """The file system that holds ``path``, and the path as it takes it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder
