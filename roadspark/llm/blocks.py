"""Comparing the members of groups in blocks of bounded size, and bounded edges instead of all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.llm import common

#: Rows of one group that are compared with one another in one block; a larger group becomes pairs of such parts.
PART_ROWS = 2048
#: Bytes of rows that are brought together before their whole blocks are handed on.
HELD_BYTES = 16 << 20


def dealt(rows: DataFrame, key: str, member: str, at_least: int = 2, part_rows: int = PART_ROWS, useful: Column | None = None) -> DataFrame:
    """rows whose key has at least so many rows (and for which an aggregate is true), with (left, right, part): each pair of parts of a key is one block.

    A key with up to part_rows rows is the block (0, 0). A larger one is cut by a hash of member into parts, and each row
    goes to the block of its part with every part, so no block grows with its key.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("group_rows"), (F.lit(True) if useful is None else useful).alias("useful")).filter((F.col("group_rows") >= at_least) & F.col("useful")).drop("useful")
    out = common.spread_join(rows, sizes, key, F.xxhash64(member)).withColumn("parts", F.ceil(F.col("group_rows") / part_rows).cast("int"))
    out = out.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other")).drop("other", "parts", "group_rows")


def by_block(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks from batches sorted by columns, many small ones at a time: a table and where its blocks begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 4096 and sum(b.nbytes for b in held) < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held)
        begins = _begins(table, columns)
        if begins[-1] == 0:
            continue
        yield table.slice(0, begins[-1]), begins[:-1]
        held = table.slice(begins[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _begins(table, columns)


def _begins(table: pa.Table, columns: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in columns:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges (node, smallest node of its component) that connect what the edges (a, b) over 0 .. n - 1 connect."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def pairs_within(begins: np.ndarray, n: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of one block that pass test(rows, other rows); blocks begin at begins."""
    end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    a_all, b_all, kept = [], [], 0
    rows = np.arange(n)
    for d in range(1, int((end - rows).max()) if n else 0):
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        hit = rows[test(rows, rows + d)]
        a_all.append(hit)
        b_all.append(hit + d)
        kept += len(hit)
        if kept > 4 * n + (1 << 16):
            a, b = forest(np.concatenate(a_all), np.concatenate(b_all), n)
            a_all, b_all, kept = [a], [b], len(a)
    if not a_all:
        return np.zeros(0, int), np.zeros(0, int)
    return forest(np.concatenate(a_all), np.concatenate(b_all), n)
