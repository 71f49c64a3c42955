"""Session helpers shared by every package: shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "tamarind", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none, as in tests, a temporary folder is made, set, and
    removed at exit. On a cluster the setting is required: a machine's own folder would not
    be shared.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tamarind-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set(CHECKPOINT_DIR, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that this thread has staged, oldest first.
_staged = threading.local()


def _paths() -> list[str]:
    if not hasattr(_staged, "paths"):
        _staged.paths = []
    return _staged.paths


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The copy survives lost executors, is read with real size statistics, and its
    rows stay the same however often a later stage is run again.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many tables this thread has staged and not released: a mark for ``release``."""
    return len(_paths())


def release(spark: SparkSession, since: int = 0, kept: int = 0) -> None:
    """Delete the tables staged after the mark ``since``, but for the last ``kept``.

    For tables that no result still to be computed reads: those behind a newer staged table.
    Without a mark all go, as at the end of a session.
    """
    paths = _paths()
    stop = len(paths) - kept
    for path in paths[since:stop]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since:stop]
