"""Token ids in length-delimited binary records, with an offset index beside each record file.

A record file holds frames: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload
(4), all little-endian. The payload of a document is a flag byte (1: doc_id is null; 2: ids take four bytes, else two),
doc_id (8 bytes), and its ids with the end id. Beside shard-N.rec lies shard-N.idx: for each record the offset (8 bytes), doc_id (8)
and number of ids (8), so that a reader can shuffle records and fetch each with one seek.

Documents are dealt to shards by ranges of doc_id and the first characters of the text, and sorted within them; null ids come first, equal ids
are ordered by text, so many rows that share an id are spread. Rows are written as they come, some at a time: a shard of many rows takes 24 bytes of
memory for each, a very long text as much as itself and its ids. Null text counts as empty and holds the end id alone. Repeated rows are records
of their own, and ties make no difference. An empty table gives no shard. Other columns are not read. Files appear by a rename, so a task that runs
twice leaves one whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm import common, tokens

#: Bytes of text in one shard, on average.
SHARD_BYTES = 32 << 20
#: Texts encoded, or payload bytes read, at a time.
BATCH_TEXTS, READ_BYTES = 1024, 8 << 20
#: Characters of a text that, after its doc_id, decide on its shard.
PREFIX = 64
CASTAGNOLI = 0x82F63B78
CHUNK = 256
NULL_ID, WIDE = 1, 2
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n", "<u8")])


@cache
def _tables() -> tuple[np.ndarray, ...]:
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(CASTAGNOLI), byte >> 1).astype(np.uint32)

    def shifted(state: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            state = byte[state & 255] ^ state >> 8
        return state

    half = np.arange(1 << 16, dtype=np.uint32)
    low, high = shifted(half, 4), shifted(half << 16, 4)
    far_low, far_high = shifted(half, CHUNK), shifted(half << 16, CHUNK)
    start = [np.array([0xFFFFFFFF], np.uint32)]
    for _ in range(CHUNK):
        start.append(shifted(start[-1], 1))
    return low, high, far_low, far_high, np.concatenate(start)


def crc32c(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each piece of the bytes data; ends: where the pieces end, in order."""
    low, high, far_low, far_high, start = _tables()
    ends = np.asarray(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - begins
    first, more = size % CHUNK, size // CHUNK
    heads = np.zeros((len(ends), CHUNK), np.uint8)
    for i in np.flatnonzero(first):
        heads[i, CHUNK - first[i] :] = data[begins[i] : begins[i] + first[i]]
    tails = np.empty((int(more.sum()), CHUNK), np.uint8)
    at = np.concatenate([[0], np.cumsum(more)])
    for i in np.flatnonzero(more):
        tails[at[i] : at[i + 1]] = data[begins[i] + first[i] : ends[i]].reshape(-1, CHUNK)

    def plain(rows: np.ndarray) -> np.ndarray:
        words, state = rows.view("<u4"), np.zeros(len(rows), np.uint32)
        for j in range(words.shape[1]):
            state = state ^ words[:, j]
            state = low[state & 0xFFFF] ^ high[state >> 16]
        return state

    state, tail = start[first] ^ plain(heads), plain(tails)
    order = np.argsort(-more, kind="stable")
    longest = int(more.max()) if len(more) else 0
    left = np.searchsorted(-more[order], -np.arange(longest), side="left") if longest else []
    for k, n in enumerate(left):
        on = order[:n]
        s = state[on]
        state[on] = far_low[s & 0xFFFF] ^ far_high[s >> 16] ^ tail[at[on] + k]
    return ~state


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    sizes = np.array([len(p) for p in payloads], np.int64)
    heads = np.frombuffer(sizes.astype("<u8").tobytes(), np.uint8)
    of_length = masked(crc32c(heads, 8 * np.arange(1, len(payloads) + 1)))
    of_data = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.cumsum(sizes)))
    return [struct.pack("<QI", n, a) + p + struct.pack("<I", b) for n, a, p, b in zip(sizes.tolist(), of_length.tolist(), payloads, of_data.tolist(), strict=True)]


def _writer(folder: str, path: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        index: list[np.ndarray] = []
        encode = tokens.encoder(path)
        end = np.array([tokens.END_ID], f"<u{encode.width}").tobytes()
        rows = (r for b in batches for at in range(0, b.num_rows, BATCH_TEXTS) for r in [b.slice(at, BATCH_TEXTS)])
        first = next((r for r in rows if r.num_rows), None)
        if first is None:
            return

        def body(out: pa.NativeFile) -> None:
            part, offset = first, 0
            while part is not None:
                ids = encode.encode(part.column("text").to_pylist())
                docs = part.column("doc_id").to_pylist()
                wide = WIDE if encode.width == 4 else 0
                payloads = [struct.pack("<Bq", wide | (NULL_ID if d is None else 0), d or 0) + x + end for d, x in zip(docs, ids, strict=True)]
                framed = frames(payloads)
                sizes = np.array([len(f) for f in framed])
                entries = np.empty(len(framed), INDEX)
                entries["offset"], entries["doc_id"], entries["n"] = offset + np.cumsum(sizes) - sizes, [d or 0 for d in docs], [len(x) // encode.width + 1 for x in ids]
                index.append(entries)
                offset += int(sizes.sum())
                for frame in framed:
                    out.write(frame)
                part = next(rows, None)

        name = f"{folder}/shard-{shard:08d}"
        common.put(f"{name}.rec", body)
        entries = np.concatenate(index)
        common.put(f"{name}.idx", lambda out: out.write(entries.tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{name}.rec"], "n_docs": [len(entries)], "n_ids": [int(entries["n"].sum())]}, schema=MANIFEST)

    return write


MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and write docs to folder in ascending doc_id order; gives the manifest (shard, path, n_docs, n_ids)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(total // SHARD_BYTES + 1, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = dealt.mapInArrow(_writer(folder, tokenizer or tokens.default_path()), "shard long, path string, n_docs long, n_ids long")
    return common.keep(made, "manifest")


def read_shard(uri: str, offset: int = 0) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record from an offset on; a bad checksum or a cut file raises."""
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        rest, sizes = b"", []
        while True:
            block = f.read(READ_BYTES)
            data = rest + block
            at, frame_at = 0, []
            while len(data) - at >= 12 and len(data) - at >= 16 + (n := int.from_bytes(data[at : at + 8], "little")):
                frame_at.append((at, n))
                at += 16 + n
            if frame_at:
                raw = np.frombuffer(data, np.uint8)
                starts = np.array([a for a, _ in frame_at])
                sizes = np.array([n for _, n in frame_at])
                heads = raw[starts[:, None] + np.arange(8)].reshape(-1)
                body = np.concatenate([raw[a + 12 : a + 12 + n] for a, n in frame_at])
                said = np.array([(struct.unpack_from("<I", data, a + 8)[0], struct.unpack_from("<I", data, a + 12 + n)[0]) for a, n in frame_at], np.uint32)
                if (masked(crc32c(heads, 8 * np.arange(1, len(starts) + 1))) != said[:, 0]).any() or (masked(crc32c(body, np.cumsum(sizes))) != said[:, 1]).any():
                    raise ValueError(f"checksum mismatch in {uri}")
                for a, n in frame_at:
                    flag, doc = struct.unpack_from("<Bq", data, a + 12)
                    yield None if flag & NULL_ID else doc, np.frombuffer(data, "<u4" if flag & WIDE else "<u2", (n - 9) // (4 if flag & WIDE else 2), a + 21)
            rest = data[at:]
            if not block:
                if rest:
                    raise ValueError(f"{uri} ends within a record")
                return


def read_index(uri: str) -> np.ndarray:
    fs, path = common.filesystem(uri.removesuffix(".rec") + ".idx")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), INDEX)


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for doc, ids in read_shard(path):
                for k, v in zip(out, (doc, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    out[k].append(v)
                base += len(ids)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, read back from the files; the window runs over shards, not documents."""
    based = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    based = based.withColumn("base", F.coalesce("base", F.lit(0)).cast("long")).select("shard", "path", "base")
    return based.repartition(max(1, manifest.count()), "shard").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(spark, write(docs, common.work_folder(spark, "records")))
