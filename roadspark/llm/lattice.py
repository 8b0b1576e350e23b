"""Near-duplicate embeddings by lattice hashing.

A vector is projected at random to a few eight-dimensional points, and each is decoded to the nearest point of the E8
lattice (the better of D8 and D8 shifted by one half). The points of one table together name a cell. A vector is
posted in its own cell of every table and probes neighbouring cells: those in which one point is the nearest of the other
coset. Vectors that meet in a cell, at least one of them at home there, are verified by cosine in double precision.

Equal vectors with one label are one entry, with a number of its own. The lists of a cell hold numbers, not vectors. Cells without an entry at
home are left out, and cells with many entries are compared in blocks of bounded size. A block first compares sketches of one byte for each
component, whose error is bounded, so no pair is lost; vectors are fetched for those entries alone that may have a partner there. A pair is counted only
in the smallest cell in which it meets, so links are counted once however often a pair is found. A block gives each entry its count of links and
one edge of a spanning forest, never all pairs.

Vectors link only where labels are equal (by a 64-bit hash) and not null and lengths are equal. Null or zero vectors, those with null or non-finite
components, and rows without vec_id link with nothing. Repeated rows, and rows that share a vec_id, count as vectors of their own. The bound is
inclusive (ties link). Very long vectors are compared in smaller blocks. Empty tables give no row; other columns, whatever their names, travel along untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import blocks, common

COSINE = 0.98
TABLES, POINTS, SCALE = 5, 2, 0.45
SEED = 17
SMALL_BLOCK = 12
#: Entries of one cell that are compared in one block.
PART_ROWS = 128


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=-1)[..., None]
    odd = (r.sum(axis=-1).astype(np.int64) & 1).astype(bool)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    moved = np.take_along_axis(r, worst, -1) + np.where(odd, step, 0.0)
    np.put_along_axis(r, worst, moved, -1)
    return r


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 point, and the nearest of the other coset of D8; both doubled, as integers."""
    whole = nearest_d8(x)
    half = nearest_d8(x - 0.5) + 0.5
    closer = (((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[..., None]
    a, b = np.where(closer, whole, half), np.where(closer, half, whole)
    return (2 * a).astype(np.int8), (2 * b).astype(np.int8)


@lru_cache(maxsize=8)
def _projection(size: int, tables: int, points: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, tables * points * 8))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ a >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ a >> np.uint64(32)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, points: int = POINTS, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each vector's own cells (n, tables) and of the cells it probes (n, tables * points)."""
    n = len(unit)
    x = (unit @ _projection(unit.shape[1], tables, points) * scale).reshape(n, tables, points, 8)
    near, other = (np.ascontiguousarray(p).view(np.uint64)[..., 0] for p in decode_e8(x))
    space = _mix(label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(1 << 20) + np.uint64(unit.shape[1] << 8) + np.arange(tables, dtype=np.uint64))

    def key(parts: list[np.ndarray]) -> np.ndarray:
        k = space
        for p in parts:
            k = _mix(k ^ p)
        return k

    own = key([near[:, :, p] for p in range(points)])
    probes = [key([other[:, :, q] if p == q else near[:, :, q] for q in range(points)]) for p in range(points)]
    return own.view(np.int64), np.concatenate(probes, axis=1).view(np.int64)


def _unit(vectors: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in whole steps (one byte each), the size of a step, and the length of what is lost (rounded up)."""
    step = np.abs(unit).max(axis=1) / 127
    steps = np.rint(unit / step[:, None])
    lost = np.sqrt(((unit - steps * step[:, None]) ** 2).sum(axis=1))
    return steps.astype(np.int8), step.astype(np.float32), (lost * (1 + 1e-6) + 1e-6).astype(np.float32)


CODED = ["entry", "h1", "h2", "least", "weight", "vector", "size", "label"]


def _code(tables: int, points: int, scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                unit = _unit(part.column("vector"), part.num_rows)
                own, probes = cells(unit, part.column("label").to_numpy(), tables, points, scale)
                steps, step, lost = sketch(unit)
                lists = [pa.array(list(k), pa.list_(pa.int64())) for k in (own, probes)]
                rough = [pa.array([r.tobytes() for r in steps], pa.binary()), pa.array(step), pa.array(lost)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in CODED), *lists, *rough], [*CODED, "own", "probes", "steps", "step", "lost"])

    return run


def _close(x: np.ndarray, lost: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block whose product is at least the bound, less what may be lost of it."""
    n, size = len(x), ends - begins
    small, end = np.repeat(size <= SMALL_BLOCK, size), np.repeat(ends, size)
    for d in range(1, SMALL_BLOCK):
        rows = np.flatnonzero(small & (np.arange(n) + d < end))
        if not len(rows):
            break
        hit = rows[np.einsum("ij,ij->i", x[rows], x[rows + d]) + lost[rows] + lost[rows + d] + 3 * lost[rows] * lost[rows + d] >= least]
        yield hit, hit + d
    for b, e in zip(begins[size > SMALL_BLOCK].tolist(), ends[size > SMALL_BLOCK].tolist(), strict=True):
        for at in range(b, e, 1024):
            to, y = min(e, at + 1024), lost[at:e]
            i, j = np.nonzero(x[at:to] @ x[at:e].T + lost[at:to, None] + y + 3 * lost[at:to, None] * y >= least)
            later = j > i
            yield at + i[later], at + j[later]


def _may_meet(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of a block are pairs of this block: two entries, one label, one of them at home, of both parts if there are two."""
    entry, part, label = (table.column(c).to_numpy() for c in ("entry", "part", "label"))
    mixed = table.column("left").to_numpy() != table.column("right").to_numpy()
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    return (entry[a] != entry[b]) & (label[a] == label[b]) & (home[a] | home[b]) & ~(mixed[a] & (part[a] == part[b]))


BLOCK = ["key", "left", "right"]
PLACE = [*BLOCK, "part", "home", "entry"]


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole blocks, apart by the length of vectors, with where they begin and end."""
    for whole, _ in blocks.by_block(batches, BLOCK):
        sizes = whole.column("size").to_numpy()
        for size in np.unique(sizes):
            table = whole.filter(pa.array(sizes == size))
            begins = blocks._begins(table, BLOCK)
            yield table, begins, np.append(begins[1:], table.num_rows)


def _rough(least: float):
    """The entries of blocks that may have a partner there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins, ends in _sizes(batches):
            steps = np.frombuffer(b"".join(table.column("steps").to_pylist()), np.int8).reshape(table.num_rows, -1)
            x = steps.astype(np.float32) * table.column("step").to_numpy()[:, None]
            some = np.zeros(table.num_rows, bool)
            for a, b in _close(x, table.column("lost").to_numpy(), begins, ends, least - 1e-5):
                ok = _may_meet(table, a, b)
                some[a[ok]] = some[b[ok]] = True
            yield from table.select(PLACE).filter(pa.array(some)).to_batches()

    return run


def _first_meeting(keys: np.ndarray, home: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key in which a and b meet with one of them at home: keys[:, :home] are own cells."""
    x, y = keys[a], keys[b]
    meet = x[:, :, None] == y[:, None, :]
    meet[:, home:, home:] = False
    return np.where(meet, x[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))


def _match(least: float, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins, ends in _sizes(batches):
            yield _links(table, begins, ends, least, tables)

    return run


def _links(table: pa.Table, begins: np.ndarray, ends: np.ndarray, least: float, tables: int) -> pa.RecordBatch:
    n = table.num_rows
    unit, weight = _unit(table.column("vector"), n), table.column("weight").to_numpy()
    entry, key = table.column("entry").to_numpy(), table.column("key").to_numpy()
    keys = np.concatenate([table.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("own", "probes")], axis=1)
    links, a_all, b_all, held = np.zeros(n, np.int64), [], [], 0
    for a, b in _close(unit, np.zeros(n), begins, ends, least):
        ok = _may_meet(table, a, b)
        a, b = a[ok], b[ok]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            first = _first_meeting(keys, tables, x, y) == key[x]
            x, y = x[first], y[first]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            a_all.append(x)
            b_all.append(y)
            held += len(x)
        if held > 4 * n + (1 << 18):
            x, y = blocks.forest(np.concatenate(a_all), np.concatenate(b_all), n)
            a_all, b_all, held = [x], [y], len(x)
    x, y = (np.concatenate(v) if v else np.zeros(0, int) for v in (a_all, b_all))
    node, root = blocks.forest(x, y, n)
    parent = np.arange(n)
    parent[node] = root
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(entry[some]), pa.array(entry[parent[some]]), pa.array(links[some])], ["u", "v", "links"])


def link(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, points: int = POINTS, scale: float = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, n_links, component_id): every row of vectors as a struct."""
    rows = common.packed_rows(vectors).select("row", F.col("row")[vec_id].alias("vec_id"), F.col("row")[vector].alias("vector"), F.col("row")[label].alias("of"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & F.col("of").isNotNull() & sound, F.col("vector")))
    known = F.col("vector").isNotNull()
    rows = rows.withColumn("h1", F.when(known, F.xxhash64("of", "vector"))).withColumn("h2", F.when(known, F.xxhash64(F.lit(SEED), "of", "vector")))

    # An entry is known by two hashes, 128 bits; its number is given once, as the table is written.
    reps = rows.filter(known).groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.xxhash64(F.first("of")).alias("label"))
    reps = reps.select(F.monotonically_increasing_id().alias("entry"), "h1", "h2", "least", "weight", "vector", F.size("vector").alias("size"), "label")
    kind = ", ".join(f"{c} {reps.schema[c].dataType.simpleString()}" for c in CODED)
    coded = common.keep(reps.mapInArrow(_code(tables, points, scale), f"{kind}, own array<long>, probes array<long>, steps binary, step float, lost float"), "cells")
    posted = coded.select("entry", F.posexplode(F.concat("own", "probes")).alias("at", "key")).select("entry", "key", (F.col("at") < tables).alias("home"))
    met = blocks.dealt(posted, "key", "entry", part_rows=PART_ROWS, useful=F.max("home"))

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    rough = by_block(met.join(coded.select("entry", "size", "label", "steps", "step", "lost"), "entry"))
    left = rough.mapInArrow(_rough(least), "key long, left int, right int, part int, home boolean, entry long")
    exact = by_block(left.join(coded.select("entry", "weight", "vector", "size", "label", "own", "probes"), "entry"))
    found = common.keep(exact.mapInArrow(_match(least, tables), "u long, v long, links long"), "links")

    parts = common.components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    per = coded.select("entry", "h1", "h2", "least", "weight").join(links, F.col("entry") == F.col("u"), "left").join(parts, F.col("entry") == F.col("node"), "left")
    per = per.select("entry", "h1", "h2", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "entry").alias("root"))
    low = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = common.keep(common.spread_join(per, low, "root", F.col("entry")).select("h1", "h2", "n_links", "component_id"), "per-entry")
    out = common.spread_join(rows.drop("vector", "of"), per, ["h1", "h2"], F.xxhash64("vec_id"), "left")
    return out.select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(common.table(spark, sf_dir, "embeddings"))
    vec_id = F.col("row.vec_id")
    return found.select(vec_id.alias("vec_id"), "n_links", "component_id", vec_id.eqNullSafe(F.col("component_id")).alias("kept"))
