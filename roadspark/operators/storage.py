"""Intermediate tables in the folder that the session names: they cut lineage, outlive lost executors, and are deleted once replaced."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the temp folder of a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/roadspark-work"
    return base.rstrip("/")


#: Spark's setting by which the shuffle files of a write go with its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_PASSING: ContextVar[list[Store] | None] = ContextVar("passing", default=None)


@contextmanager
def passing() -> Iterator[None]:
    """Stores opened in this block go at its end, so what is derived from their tables must be written to another by then."""
    stores: list[Store] = []
    token = _PASSING.set(stores)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for store in stores:
            store.close()


class Store:
    """Tables below one folder, which goes with the JVM at the latest."""

    def __init__(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/roads-{uuid.uuid4().hex}")
        self._jvm, self._fs, self._at = spark._jvm, path.getFileSystem(spark._jsc.hadoopConfiguration()), path
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        if (stores := _PASSING.get()) is not None:
            stores.append(self)

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """df written and read back; then the table it replaces is deleted."""
        folder, conf = f"{self._at.toString()}/{uuid.uuid4().hex}", df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(folder)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        out = df.sparkSession.read.schema(df.schema).parquet(folder)
        out.kept_in = folder
        if instead_of is not None:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(instead_of.kept_in), True)
        return out

    def local(self) -> str | None:
        """The folder as a path, where tasks open its files as the driver does."""
        return self._at.toUri().getPath() if self._fs.getUri().getScheme() == "file" else None

    def close(self) -> None:
        self._fs.delete(self._at, True)


def keep(df: DataFrame) -> DataFrame:
    return Store(df.sparkSession).keep(df)
