"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

# Only used where the session names no checkpoint folder, which we accept in local mode only.
_local_roots: dict[str, str] = {}


def get_spark(app: str = "tillstream", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; a cluster supplies master and memory itself."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tillstream-")
    return _local_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses. Nothing is created yet."""
    return f"{shared_root(spark)}/tillstream/{label}-{uuid.uuid4().hex}"


# Scratch folders of the jobs that run inside ``scratch_freed``, and how many such blocks are open.
_scratch: list[str] = []
_open_blocks = 0
_lock = Lock()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for data that is needed until the job's result is stored."""
    path = new_folder(spark, label)
    with _lock:
        if _open_blocks:
            _scratch.append(path)
    return path


def free(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job has made and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_freed(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders of a job that stores its result inside this block.

    With several blocks open at a time, the last to close deletes those of all.
    """
    global _open_blocks
    with _lock:
        _open_blocks += 1
    try:
        yield
    finally:
        with _lock:
            _open_blocks -= 1
            done = _scratch[:] if not _open_blocks else []
            if done:
                _scratch.clear()
        for path in done:
            free(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` once in the shared folder and read it back; cuts the lineage."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
