"""Packing documents into sequences of bounded length: first-fit decreasing by a tournament tree of bin capacities.

Documents are dealt at random (a seeded hash of doc_id, text and, where a task has both repeatedly, the number of the repeat) to groups of
bounded documents and bytes on average, which are packed independently. A document longer than a sequence is cut into full sequences; its rest, and every shorter document, goes
to the first bin of its group with room, longest rest first. No id is lost, moved out of order within its piece, or
packed twice.

Null text counts as empty and holds the end id alone. Null ids and repeated rows are packed like others, and repeats are spread over groups. Rests
of equal length are taken in the order of doc_id, then ids. A very long text needs memory in proportion to its own length. Empty tables give no
piece. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common, tokens

LENGTH = 1024
GROUP_DOCUMENTS, GROUP_BYTES = 2048, 16 << 20
#: Bytes of text whose groups one task packs.
TASK_BYTES = 64 << 20
SEED = 7


class Bins:
    """A complete binary tree of the most room below each node; the leftmost bin with room is found by descending it."""

    def __init__(self, most: int, length: int) -> None:
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [length] * (2 * self.leaves)
        self.length = length

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)"""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.length - room[node]
        bin_ = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return bin_, offset


def cut_and_place(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0 without gaps."""
    pieces, rests, sequence = [], [], 0
    for doc, size in enumerate(sizes):
        for start in range(0, size - length + 1, length):
            pieces.append((doc, start, length, sequence, 0))
            sequence += 1
        if size % length:
            rests.append((-(size % length), doc, size - size % length))
    bins = Bins(max(1, len(rests)), length)
    for rest, doc, start in sorted(rests):
        bin_, offset = bins.place(-rest)
        pieces.append((doc, start, -rest, sequence + bin_, offset))
    return pieces


def _encode(path: str, bundles: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        end = np.array([tokens.END_ID], f"<u{encode.width}").tobytes()
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [x + end for x in encode.encode(part.column("text").to_pylist())]
                bundle = []
                for h in part.column("hash").to_pylist():
                    # The same repeats get the same numbers in whatever order a task that runs again meets them.
                    seen[h] = repeat = seen.get(h, -1) + 1
                    bundle.append(xxhash.xxh64_intdigest(struct.pack("<qq", h, repeat), SEED) % bundles)
                yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int64()), part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([encode.width] * len(ids), pa.int32())], ["bundle", "doc_id", "ids", "width"])
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return run


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        bundle, width = group.column("bundle")[0].as_py(), group.column("width")[0].as_py()
        docs, ids = group.column("doc_id").to_pylist(), group.column("ids").to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i] or 0, ids[i]))
        docs, ids = [docs[i] for i in order], [ids[i] for i in order]
        out: dict[str, list] = {k.name: [] for k in PIECES}
        for doc, start, n, sequence, offset in cut_and_place([len(x) // width for x in ids], length):
            piece = np.frombuffer(ids[doc], f"<u{width}", n, start * width).astype("<u4").tobytes()
            row = (docs[doc], start, n, zlib.crc32(piece), len(ids[doc]) // width, (bundle << 32) + sequence, offset, piece)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return pa.table(out, schema=PIECES)

    return run


PIECES = pa.schema([*((k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total = total or 0
    bundles = max(1, -(-n // group_documents), -(-total // GROUP_BYTES))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    encoded = rows.mapInArrow(_encode(tokenizer or tokens.default_path(), bundles), "bundle long, doc_id long, ids binary, width int")
    kind = ", ".join(f"{k.name} {'binary' if k.name == 'ids' else 'long'}" for k in PIECES)
    if (tasks := total // TASK_BYTES) > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        encoded = encoded.repartition(tasks, "bundle")
    return encoded.groupBy("bundle").applyInArrow(_pack(length), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")
