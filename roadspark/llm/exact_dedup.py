"""Exact deduplication over an extendible-hash index on shared files.

1. Map tasks fold equal texts of a bounded stretch of rows into one representative (hash, then bytes), so that a text
   with any number of copies reaches the index once per stretch, and not once per row.
2. Representatives that share a SHA-256 with another are dealt by hash and part (SPREAD parts of each), and each part folds
   them again by their bytes as they come. So a text with a third of all rows reaches its owner SPREAD times at most, and texts without any
   copy aren't moved.
3. Owner tasks take key ranges: the leading bits of SHA-256. Each builds the extendible-hash directory of its range: a
   bucket that overflows splits on its next bit, and the directory doubles when that bucket is as deep as the directory.
   Entries with one hash but different bytes are chained. Bucket pages go to shared files, and the groups are read back from them.
4. Every row reads its group from its representative.

Null text counts as empty. Of equal texts the row with the largest doc_id stays (null ids rank lowest; among rows with
the same id one stays). Repeated rows count as copies. Very long texts are held one by one where they are compared. Empty tables give empty
results; extra columns, whatever their names, travel along untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm import common

#: Bytes of distinct text that a map task holds before it passes its representatives on.
STRETCH_BYTES = 24 << 20
#: Parts into which the representatives of one hash are dealt before they reach their owner.
SPREAD = 16
#: Entries in one owner's key range, on average.
OWNER_ENTRIES = 100_000
BUCKET = 512
LOWEST = -(1 << 63)


class ExtendibleIndex:
    """Directory of buckets over the key bits that follow the owner's prefix. Values are [text, keep, size, members]."""

    def __init__(self, skip_bits: int = 0, capacity: int = BUCKET) -> None:
        self.skip, self.capacity, self.depth = skip_bits, capacity, 0
        first: dict = {"depth": 0, "chains": {}}
        self.directory = [first]

    def _slot(self, key: bytes) -> int:
        bits = int.from_bytes(key[:16], "big") << self.skip & (1 << 128) - 1
        return bits >> (128 - self.depth) if self.depth else 0

    def find(self, key: bytes, text: bytes) -> list | None:
        return next((e for e in self.directory[self._slot(key)]["chains"].get(key, ()) if e[0] == text), None)

    def add(self, key: bytes, text: bytes, best: tuple, count: int, member: int) -> None:
        bucket = self.directory[self._slot(key)]
        chain = bucket["chains"].setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1], entry[2] = max(entry[1], best), entry[2] + count
                entry[3].append(member)
                return
        chain.append([text, best, count, [member]])
        while len(bucket["chains"]) > self.capacity and bucket["depth"] < 128 - self.skip:
            self._split(bucket)
            bucket = self.directory[self._slot(key)]

    def _split(self, bucket: dict) -> None:
        if bucket["depth"] == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        deeper = bucket["depth"] + 1
        halves = [{"depth": deeper, "chains": {}}, {"depth": deeper, "chains": {}}]
        for key, chain in bucket["chains"].items():
            bits = int.from_bytes(key[:16], "big") << self.skip & (1 << 128) - 1
            halves[bits >> (128 - deeper) & 1]["chains"][key] = chain
        for slot, b in enumerate(self.directory):
            if b is bucket:
                self.directory[slot] = halves[slot >> (self.depth - deeper) & 1]

    def buckets(self) -> Iterator[tuple[int, dict]]:
        """Each bucket once, with its first directory slot."""
        last = None
        for slot, bucket in enumerate(self.directory):
            if bucket is not last:
                yield slot, bucket
            last = bucket


def _combine(field: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rep, n, best_id, best_row to (row, sha, id), where row has the text; all but rep stand on representatives only."""
    context = TaskContext.get()
    serial = ((context.partitionId() if context else 0) << 36) + 1

    def flush() -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in held:
            n = batch.num_rows
            own, at = reps[at : at + n], at + n
            first = [stats[r] if new else None for r, new in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("sha"),
                    pa.array([first_row + r for r, _ in own], pa.int64()),
                    pa.array([s and s[0] for s in first], pa.int64()),
                    pa.array([s and (s[1][0] if s[1][0] != LOWEST else None) for s in first], pa.int64()),
                    pa.array([s and s[1][1] for s in first], pa.int64()),
                    pa.array(own_rows[at - n : at], pa.int64()),
                ],
                ["row", "sha", "rep", "n", "best_id", "best_row", "row_key"],
            )

    held: list = []
    chains: dict = {}
    stats: list = []
    reps: list = []
    own_rows: list = []
    size, first_row = 0, serial
    for batch in batches:
        shas, texts, ids = batch.column("sha").to_pylist(), common.texts_of(batch, field), batch.column("id").to_pylist()
        for i, (sha, doc) in enumerate(zip(shas, ids, strict=True)):
            best = (LOWEST if doc is None else doc, serial)
            own_rows.append(serial)
            serial += 1
            chain = chains.setdefault(sha, [])
            found = None
            for other, j, r in chain:
                if other[j].as_py() == texts[i].as_py():
                    found = r
                    break
            if found is None:
                chain.append((texts, i, len(stats)))
                reps.append((len(stats), True))
                stats.append([1, best])
            else:
                reps.append((found, False))
                stats[found][0] += 1
                stats[found][1] = max(stats[found][1], best)
        held.append(batch.select(["row", "sha"]))
        size += batch.nbytes
        if size >= STRETCH_BYTES:
            yield from flush()
            held, chains, stats, reps, own_rows, size, first_row = [], {}, [], [], [], 0, serial
    yield from flush()
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives sorted by (sha, part): for each its leader, the first with equal bytes in its part; leaders carry text and sums."""
    key, chain = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        for text, best, n, members in chain:
            first = [True] + [False] * (len(members) - 1)
            pick = lambda v: [v if f else None for f in first]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(members)), pa.array(pick(text), pa.string()), pa.array(pick(n), pa.int64()), pa.array(pick(best[0] if best[0] != LOWEST else None), pa.int64()), pa.array(pick(best[1]), pa.int64()), pa.array(members, pa.int64()), pa.array([members[0]] * len(members), pa.int64())], FOLDED)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("sha", "part", "n", "best_id", "best_row", "rep")]
        for i, (sha, part, n, best, row, rep) in enumerate(zip(*columns, strict=True)):
            if key != (sha, part):
                yield from flush()
                key, chain = (sha, part), []
            text, best = batch.column("text")[i].as_py(), (LOWEST if best is None else best, row)
            for entry in chain:
                if entry[0] == text:
                    entry[1], entry[2] = max(entry[1], best), entry[2] + n
                    entry[3].append(rep)
                    break
            else:
                chain.append([text, best, n, [rep]])
    if key is not None:
        yield from flush()


FOLDED = ["sha", "text", "n", "best_id", "best_row", "rep", "lead"]


def _owner(folder: str, bits: int):
    def build(group: pa.Table) -> pa.Table:
        owner = group.column("owner")[0].as_py()
        index = ExtendibleIndex(bits)
        for sha, text, n, best, row, lead in zip(*(group.column(c).to_pylist() for c in ("sha", "text", "n", "best_id", "best_row", "lead")), strict=True):
            index.add(bytes.fromhex(sha), text if text is None else text.encode(), (LOWEST if best is None else best, row), n, lead)
        page: dict[str, list] = {k.name: [] for k in PAGE}
        for slot, bucket in index.buckets():
            for sha, chain in bucket["chains"].items():
                for link, (_, (doc, row), size, members) in enumerate(chain):
                    for k, v in zip(page, (slot, bucket["depth"], sha, link, None if doc == LOWEST else doc, row, size, members), strict=True):
                        page[k].append(v)
        meta = {"owner": str(owner), "owner_bits": str(bits), "depth": str(index.depth)}
        path = f"{folder}/owner-{owner:08d}.parquet"
        common.put(path, lambda to: pq.write_table(pa.table(page, schema=PAGE.with_metadata(meta)), to))
        return pa.table({"path": [path], "entries": [len(page["sha"])]}, schema=pa.schema([("path", pa.string()), ("entries", pa.int64())]))

    return build


PAGE = pa.schema([("slot", pa.int64()), ("depth", pa.int32()), ("sha", pa.binary()), ("chained", pa.int32()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("members", pa.list_(pa.int64()))])
PAGE_SQL = "slot long, depth int, sha binary, chained int, keep_id long, keep_row long, group_size long, members array<long>"


def group_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index_folder: str | None = None) -> DataFrame:
    """(row, sha, keep_id, group_size, kept): every row of docs as a struct, with its group of equal texts.

    index_folder gets the bucket pages, one Parquet file for each key range: slot, depth, sha, chained, keep_id, keep_row, group_size, members.
    """
    spark = docs.sparkSession
    folder = index_folder or common.work_folder(spark, "exact-index")
    rows, field = common.rows_and_text(docs, text)
    rows = rows.select("row", F.sha2(F.coalesce(F.col("row")[text], F.lit("")).cast("binary"), 256).alias("sha"), F.col("row")[doc_id].cast("long").alias("id"))
    kind = T.StructType([rows.schema["row"], rows.schema["sha"], *(T.StructField(c, T.LongType()) for c in ("rep", "n", "best_id", "best_row", "row_key"))])
    rows = common.keep(rows.mapInArrow(partial(_combine, field), kind), "exact-rows")

    reps = rows.filter("n is not null")
    part = F.pmod(F.xxhash64("rep"), F.lit(SPREAD)).cast("int").alias("part")
    often = reps.groupBy("sha", part).agg(F.count("*").alias("reps")).groupBy("sha").agg(F.sum("reps").alias("reps"))
    often = common.keep(often, "exact-often")
    several = common.spread_join(reps.withColumn("text", F.coalesce(F.col("row")[text], F.lit(""))).drop("row"), often.filter("reps > 1").select("sha"), "sha", F.col("rep"))
    dealt = several.select("sha", part, "text", "n", "best_id", "best_row", "rep").repartition("sha", "part").sortWithinPartitions("sha", "part")
    folded = common.keep(dealt.mapInArrow(_fold, "sha string, text string, n long, best_id long, best_row long, rep long, lead long"), "exact-folded")
    alone = common.spread_join(reps.select("sha", "n", "best_id", "best_row", "rep"), often.filter("reps = 1").select("sha"), "sha", F.col("rep"))
    entries = alone.select("sha", F.lit(None).cast("string").alias("text"), "n", "best_id", "best_row", F.col("rep").alias("lead"))
    entries = entries.unionByName(folded.filter("n is not null").select("sha", "text", "n", "best_id", "best_row", "lead"))

    bits = max(0, (often.count() // OWNER_ENTRIES).bit_length())
    owner = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    owner = F.shiftright(owner, 60 - bits) if bits else F.lit(0).cast("long")
    made = entries.withColumn("owner", owner).groupBy("owner").applyInArrow(_owner(folder, bits), "path string, entries long")
    common.keep(made, "exact-pages")
    pages = read_index(spark, folder) if often.limit(1).count() else spark.createDataFrame([], PAGE_SQL)
    found = pages.select(F.explode("members").alias("lead"), "keep_id", "keep_row", "group_size")
    led = folded.select("rep", "lead").join(found, "lead").drop("lead")
    found = found.join(folded.select("lead").distinct(), "lead", "left_anti").withColumnRenamed("lead", "rep").unionByName(led.select("rep", "keep_id", "keep_row", "group_size"))
    return rows.select("row", "sha", "rep", "row_key").join(found, "rep").select("row", "sha", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts."""
    return group_copies(docs, text, doc_id).filter("kept").select("row.*")


def read_index(spark, folder: str) -> DataFrame:
    """The bucket pages written by group_copies(index_folder=...)."""
    return spark.read.schema(PAGE_SQL).parquet(folder)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_copies(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
