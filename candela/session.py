"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC times and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("candela")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir.

    Only where that is unset and all tasks run on this machine, as in local tests, is a folder of it chosen and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-candela-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCOPE: ContextVar[str | None] = ContextVar("staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Tables that are staged inside the block share a folder, which is deleted when the block ends.

    Results read staged tables, so write or collect them before the end. The
    folder may be in any store that Arrow knows; in another it stays.
    """
    from pyarrow import fs

    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        scheme, _, rest = folder.partition(":")
        try:
            system, path = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(folder)
        except (ValueError, NotImplementedError, OSError):
            system, path = None, folder
        if system is not None and system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


def staging_folder(spark: SparkSession) -> str:
    """Where tables are staged: the folder of the innermost staging block, else the shared one."""
    return _SCOPE.get() or shared_folder(spark)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the staging folder that nothing uses yet."""
    return f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """df written to the shared folder and read back: computed once, and its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    # Digests as text take about half the room under zstd.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
