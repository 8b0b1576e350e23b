"""Folders that all executors share, written intermediate tables, joins that spread hot keys, and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.operators import storage

#: Parts into which the rows of one key are spread in joins and minima.
SALTS = 64
#: Up to so many edges in all, the edges of one node fit in a task, and aren't spread.
FEW_EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """The work folders of one run, all below one folder of its own, which lies in that of the workspace in use. close() deletes them and nothing else; so does the end of the JVM."""

    def __init__(self, spark: SparkSession) -> None:
        outer = _CURRENT.get()
        base = outer._path.toString() if outer else spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/roadspark-work"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/run-{uuid.uuid4().hex}")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(path)
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def folder(self, name: str) -> str:
        return f"{self._path.toString()}/{name}-{uuid.uuid4().hex}"

    def close(self) -> None:
        self._fs.delete(self._path, True)


_CURRENT: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
#: The workspace of callers that opened none, by Spark application.
_COMMON: dict[str, Workspace] = {}


@contextmanager
def inside(work: Workspace) -> Iterator[Workspace]:
    """Work folders made in this block belong to work."""
    token = _CURRENT.set(work)
    try:
        yield work
    finally:
        _CURRENT.reset(token)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Work folders made in this block are deleted at its end, so results derived from them must be written by then."""
    work = Workspace(spark)
    try:
        with inside(work):
            yield work
    finally:
        work.close()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the workspace in use; outside of all, of one that lasts as long as the Spark application."""
    work = _CURRENT.get()
    if work is None:
        application = spark.sparkContext.applicationId
        work = _COMMON[application] = _COMMON.get(application) or Workspace(spark)
    return work.folder(name)


def keep(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """df written once to shared storage and read back: cuts the lineage and outlives lost executors. tidy: its shuffle files go at once."""
    folder, conf = work_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(storage.CLEANUP, None)
    if tidy:
        conf.set(storage.CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        if tidy:
            conf.unset(storage.CLEANUP) if before is None else conf.set(storage.CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Write a file under a name that readers pass over and move it into place, so that repeated or lost task attempts leave whole files only."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed_rows(docs: DataFrame) -> DataFrame:
    """All columns of docs as one struct, safe from clashes with columns added beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def rows_and_text(docs: DataFrame, text: str, columns: list[str] | None = None) -> tuple[DataFrame, int | None]:
    """docs (or some of its columns) as a struct `row`, and the text beside it unless it is in there; where it is, its number among the fields."""
    names = columns or docs.columns
    field = names.index(text) if text in names else None
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    return docs.select(row, *([] if field is not None else [F.col(f"`{text}`").alias("text")])), field


def texts_of(batch: pa.RecordBatch, field: int | None) -> pa.Array:
    """The texts of a batch of rows_and_text(); null is empty."""
    return pc.fill_null(batch.column("text") if field is None else batch.column("row").field(field), "")


def spread_join(rows: DataFrame, unique: DataFrame, key: str | list[str], salt: Column, how: str = "inner") -> DataFrame:
    """rows joined to unique, which has one row for each key. The rows of a hot key are dealt over SALTS parts.

    salt is a number that differs among the rows of a key. unique is joined to the (key, part) pairs that occur, at most SALTS of a key, and
    those pairs to the rows, so no task gets all rows of a key.
    """
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("__salt", F.coalesce(F.pmod(salt, F.lit(SALTS)).cast("int"), F.lit(0)))
    parts = salted.select(*keys, "__salt").distinct().join(unique, keys, how)
    return salted.join(parts, [*keys, "__salt"], how).drop("__salt")


def _with_least(edges: DataFrame, spread: bool) -> DataFrame:
    """edges (u, v) with m, the least v of their u; a hot u is dealt over SALTS parts, each folded before they meet."""
    if not spread:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("part"))
    least = parts.groupBy("u").agg(F.min("part").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def _star(edges: DataFrame, spread: bool = True) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, spread).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    small = _with_least(large, spread)
    return (
        small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(small.select("u", F.col("m").alias("v")))
        .filter("u > v").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): a row (node, component) for every node that is not the smallest of its component.

    Alternating large-star and small-star steps; each round is a written table, and the rounds grow with the logarithm of the longest path.
    """
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, edges = now, keep(_star(edges, now[0] > FEW_EDGES), "edges")
