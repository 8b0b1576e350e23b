"""SimHash near-duplicates through a byte-position inverted index with count filtering.

The fingerprint of a text has eight bytes. Two fingerprints at Hamming distance d share at least 8 - d of them, position
by position, so pairs within two bits share at least six positional bytes. The index posts every distinct fingerprint
under its positional bytes. As a list for one byte would hold a 256th of the corpus, whatever its size, a posting takes
the bytes of two of the four byte pairs (01, 23, 45, 67) together: six postings with four positional bytes each, and a
pair with six equal bytes meets in one of them at least, since two differing bytes touch two byte pairs at most. Pairs that meet are
tallied over all positions, those with the guaranteed six equal bytes are kept, and their bits verified.

Equal fingerprints are one entry. In a crowded list the other four bytes are cut into three segments, of which a pair within two bits shares
one at least, so each segment's value makes a finer list; lists that are still beyond a bound are compared in blocks, and each block gives a spanning
forest of its links, never all pairs.

Fingerprints: lower-case A-Z, words of bytes other than blank and \\x09-\\x0D, shingles of `shingle` words joined by blanks, repeats
included (a shorter text is one shingle), XXH64 with seed 42; a bit is set if it is set in over half the hashes. Null text and text
without words have fingerprint 0, linked like any other. Null ids are kept; a component's id is the smallest known doc_id in it. Repeated
rows get equal results; other columns travel along untouched. Empty tables give no row. A very long text needs memory in proportion to
its own length: eight bytes a shingle beside the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm import blocks, common

SHINGLE = 3
BITS = 2
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
    hashes = np.fromiter((digest(joined[b:e], 42) for b, e in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of hashes. Counts are held bit-sliced: plane j has bit j of the count of each position."""
    n = len(hashes)
    planes: list[np.ndarray] = []
    level = [hashes]
    # Carry-save addition: three numbers of one weight become one of that weight and one of the next.
    while level:
        numbers, carry = np.concatenate(level), []
        while len(numbers) > 1:
            k = len(numbers) // 3
            if k == 0:
                a, b = numbers[:1], numbers[1:2]
                carry.append(a & b)
                numbers = a ^ b
                break
            a, b, c = numbers[:k], numbers[k : 2 * k], numbers[2 * k : 3 * k]
            half = a ^ b
            carry.append(a & b | c & half)
            numbers = np.concatenate([half ^ c, numbers[3 * k :]])
        planes.append(numbers[0])
        level = carry
    half, more, equal = n // 2, np.uint64(0), ~np.uint64(0)
    for j in range(max(len(planes), half.bit_length()) - 1, -1, -1):
        plane = planes[j] if j < len(planes) else np.uint64(0)
        if half >> j & 1:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return int(more)


def _print(shingle: int, field: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py().encode(), shingle) for t in common.texts_of(batch, field)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints.view(np.int64)), pa.array(np.arange(len(prints)))], ["row", "print", "serial"])

    return run


def _match(bits: int):
    least = 8 - bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in blocks.by_block(batches, ["key", "left", "right"]):
            prints = table.column("print").to_numpy().view(np.uint64)
            as_bytes = prints.view(np.uint8).reshape(-1, 8)

            def near(a: np.ndarray, b: np.ndarray, prints=prints, as_bytes=as_bytes) -> np.ndarray:
                tally = (as_bytes[a] == as_bytes[b]).sum(axis=1)
                enough = tally >= least
                enough[enough] = np.bitwise_count(prints[a[enough]] ^ prints[b[enough]]) <= bits
                return enough

            a, b = blocks.pairs_within(begins, len(prints), near)
            yield pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["u", "v"])

    return run


def link_prints(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (u, v) that connect all distinct values of print within so many differing bits (two at most) of one another."""
    if not 0 <= bits <= 2:
        raise ValueError("postings of two byte pairs are complete for up to two differing bits")
    pair = [F.shiftright("print", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.struct(F.lit(i).alias("list"), (F.shiftleft(pair[a], 16).bitwiseOR(pair[b])).alias("bytes")) for i, (a, b) in enumerate(PAIRS)]
    posted = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("print", (F.shiftleft(F.col("k.list").cast("long"), 32).bitwiseOR(F.col("k.bytes"))).alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = common.spread_join(posted, sizes, "key", F.xxhash64("print"))
    one = F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("part")
    short = listed.filter(F.col("n") <= blocks.PART_ROWS).select("key", "print", *one)
    rest = F.element_at(F.array(*[F.shiftleft(pair[c], 16).bitwiseOR(pair[d]) for c, d in ([k for k in range(4) if k not in p] for p in PAIRS)]), F.shiftright("key", 32).cast("int") + 1)
    segments = [F.xxhash64("key", F.lit(i), F.shiftright(rest, at).bitwiseAND(F.lit((1 << size) - 1))) for i, (at, size) in enumerate(((0, 11), (11, 11), (22, 10)))]
    finer = listed.filter(F.col("n") > blocks.PART_ROWS).select("print", F.explode(F.array(*segments)).alias("key"))
    met = short.unionByName(blocks.dealt(finer, "key", "print").select("key", "print", "left", "right", "part")).select("key", "left", "right", "print")
    met = met.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return met.mapInArrow(_match(bits), "u long, v long")


def group_near(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """(row, print, root, component_id): every row of docs (or some of its columns) as a struct, with its group of near-duplicates: a fingerprint that stands for it, and its smallest doc_id."""
    rows, field = common.rows_and_text(docs, text, columns)
    kind = T.StructType([rows.schema["row"], T.StructField("print", T.LongType()), T.StructField("serial", T.LongType())])
    rows = common.keep(rows.mapInArrow(_print(shingle, field), kind), "prints")
    entries = common.keep(rows.groupBy("print").agg(F.min(F.col("row")[doc_id]).alias("least_id")), "entries")
    label = common.components(link_prints(entries))
    entries = entries.join(label, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("component", "print"))
    low = entries.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = common.spread_join(entries.select("print", "root"), low, "root", F.xxhash64("print")).select("print", "root", "component_id")
    return common.spread_join(rows, found, "print", F.col("serial")).select("row", "print", "root", "component_id")


def drop_near(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the row of smallest doc_id of each group; of rows that share that id, one. Groups without any id keep one row."""
    grouped = group_near(docs, shingle, bits, text, doc_id).filter(F.col("row")[doc_id].eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("root").orderBy(F.col("row")[text])
    return grouped.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = group_near(docs, columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
