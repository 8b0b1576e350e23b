"""Removal of repeated passages by prefix-free parsing.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id.

1. Triggers: of the rolling hashes of the 16-byte strings inside a window of `length` bytes the smallest is the window's
   trigger. Equal windows have equal triggers, wherever they are.
2. Phrases: a run of windows with one trigger is a phrase, from its first window's first byte to its last window's last.
   Phrases overlap by length - 1 bytes, so every window lies in one phrase. A text's phrases are its parse, the distinct
   (trigger, phrase) pairs the dictionary.
3. Dictionary: phrases are brought together by trigger. A trigger in one document alone settles its windows: they
   are unique. A trigger with one phrase settles them too: all but the smallest document lose them all.
4. Where a trigger leads more than one phrase, equal phrases are brought together: all but the smallest document with a
   phrase lose its windows.
5. Along with them, of all phrases led by such triggers the strings of length - STEP + 1 bytes at a few fixed distances from the
   trigger are brought together. Every window holds one of them, so a window whose string is in one document only is unique. These strings cut
   the phrases that are left into shorter ones (pieces of up to length + STEP - 1 bytes, each with the windows that hold its string), and split
   what a frequent trigger leads over all tasks.
6. Suffix arrays: pieces with one string meet, as bytes. Where they meet, the distinct ones are sorted into the dictionary, and the parse is the
   sequence of their ranks. The suffix array of the dictionary puts its windows into the order of their `length` bytes; the suffix array of the
   parse puts the occurrences of each rank into the order of documents; together they give the windows of the corpus in order, copies of a window
   side by side, the smallest document first. As no window reaches beyond its phrase, a parse suffix never has to be compared beyond its first rank.

What settles windows in steps 3 to 5 are hashes (96 bits and more together) of whole phrases and of strings; in step 6 bytes decide. The corpus
is put in order string by string, not as a whole, as only neighbours with `length` equal bytes matter.

Texts are stored in blocks of bounded size in the shared folder; what leaves a block was folded to one entry for each trigger, string
or piece first, so that a passage in a third of all documents sends one entry from each block. Long texts are parsed in pieces that overlap.

Null text counts as empty. A null doc_id is smaller than all others; rows with equal ids (repeated rows too) never take from each
other. Texts shorter than `length` are kept whole. A very long text takes memory in proportion to its length. Empty tables give no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common

LENGTH = 50
GRAM = 16
#: Windows of a phrase that are judged by one string of length - STEP + 1 bytes.
STEP = 10
#: Bytes of text in a stored block, and of text whose parse meets in one bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: Windows parsed at a time.
PIECE = 1 << 18
LOWEST = -(1 << 63)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
U = np.uint64


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    h = (h ^ h >> U(29)) * U(0xBF58476D1CE4E5B9)
    return h ^ h >> U(32)


class Sums:
    """Prefix sums of bytes times powers of a base: the hash of any stretch of them in two steps."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        up, self.down = _powers(base, max(4 * PIECE, len(data) + 1))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


class Parse:
    """The phrases of a block: trigger, phrase hash, first window, place of the trigger, number of windows, document."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int) -> None:
        self.ids, self.texts, self.length = ids, texts, length
        pieces = [(d, at, min(len(t), at + PIECE + length - 1)) for d, t in enumerate(texts) for at in range(0, len(t) - length + 1, PIECE)]
        self.segments: list[list[tuple[int, int, int]]] = []
        held = PIECE
        for p in pieces:
            if held >= PIECE:
                self.segments.append([])
                held = 0
            self.segments[-1].append(p)
            held += p[2] - p[1]
        parts = [self._segment(s) for s in self.segments]
        self.counts = [len(p[0]) for p in parts]
        columns = zip(zip(*parts, strict=True) if parts else [()] * 6, (U, U, np.int64, np.int64, np.int64, np.int64), strict=True)
        self.trigger, self.phrase, self.first, self.at, self.windows, doc = (np.concatenate(c) if parts else np.zeros(0, kind) for c, kind in columns)
        self.doc_id = ids[doc] if len(doc) else np.zeros(0, np.int64)

    def data(self, segment: list[tuple[int, int, int]]) -> np.ndarray:
        return np.frombuffer(b"".join(self.texts[d][b:e] for d, b, e in segment), np.uint8)

    def _segment(self, segment: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        data, length = self.data(segment), self.length
        sums = Sums(data, BASES[0])
        grams = _mix(sums.every(GRAM))
        low = U((1 << 24) - 1)
        ranked = grams & ~low | np.arange(len(grams), dtype=U)
        span = length - GRAM + 1  # grams in a window
        least, covered = ranked, 1
        while covered * 2 <= span:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < span:
            least = np.minimum(least[: len(least) - (span - covered)], least[span - covered :])
        sizes = np.array([e - b for _, b, e in segment])
        base = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(segment)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + base[owner]
        at = (least[start] & low).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(start)))
        begin, trigger_at, owner = start[first], at[first], owner[first]
        phrase = _mix(sums.of(begin, begin + windows + length - 1) ^ U(0xA5A5A5A5) * (windows.astype(U) * U(64) + (trigger_at - begin).astype(U)))
        trigger = _mix(grams[trigger_at] + U(BASES[1]))  # the smallest of many hashes are small numbers
        return trigger, phrase, begin, trigger_at, windows, np.array([d for d, _, _ in segment])[owner]

    def _chosen(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[Sums, Sums]]]:
        """For each segment the chosen phrases, its bytes and the sums over them; both are empty where there is no such phrase."""
        at, none = 0, np.zeros(0, np.uint8)
        for segment, count in zip(self.segments, self.counts, strict=True):
            own = np.flatnonzero(chosen[at : at + count]) + at
            at += count
            data = self.data(segment) if len(own) else none
            yield own, data, tuple(Sums(data, base) for base in BASES)

    @property
    def slots(self) -> int:
        return -(-(self.length - GRAM + 1) // STEP)

    def _cut(self, own: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases that have windows in a slot: which, where the slot's string begins, and the first window and how many there are."""
        low = self.at[own] + slot * STEP - (self.length - GRAM)
        begin = np.maximum(self.first[own], low)
        windows = np.minimum(self.first[own] + self.windows[own], low + STEP) - begin
        has = windows > 0
        return np.flatnonzero(has), low[has] + STEP - 1, begin[has], windows[has]

    def strings_of(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each string that judges windows of the chosen phrases: number of the phrase, slot, and two hashes (the second of 31 bits)."""
        out, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.uint32))], self.length - STEP + 1
        for own, _, sums in self._chosen(chosen):
            for slot in range(self.slots):
                rows, at, _, _ = self._cut(own, slot)
                a, b = (_mix(s.of(at, at + size) ^ U(slot + 1)) for s in sums)
                out.append((own[rows], np.full(len(at), slot), a, (b >> U(33)).astype(np.uint32)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def pieces_of(self, chosen: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each piece of the chosen phrases whose string is shared (phrase, slot): number of the phrase, first byte, windows, hash of the string, hash of it all, record; and how many there are in each segment."""
        width = self.length + STEP - 1
        out, counts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros((0, width + 2), np.uint8))], []
        for own, data, sums in self._chosen(chosen & shared.any(axis=1)):
            counts.append(0)
            for slot in range(self.slots):
                rows, at, begin, windows = self._cut(own, slot)
                on = shared[own[rows], slot]
                rows, at, begin, windows = rows[on], at[on], begin[on], windows[on]
                if not len(rows):
                    continue
                record, place = np.zeros((len(rows), width + 2), np.uint8), np.arange(width)
                record[:, 0], record[:, 1] = begin - (at - STEP + 1), windows
                inside = place < (windows + self.length - 1)[:, None]
                record[:, 2:] = np.where(inside, data[np.minimum(begin[:, None] + place, len(data) - 1)], 0)
                string, whole = sums[0].of(at, at + self.length - STEP + 1), sums[1].of(begin, begin + windows + self.length - 1)
                out.append((own[rows], begin, windows, _mix(string ^ U(slot + 1)), _mix(whole + string * U(BASES[0]) + (at - begin).astype(U)), record))
                counts[-1] += len(rows)
        return *(np.concatenate(c) for c in zip(*out, strict=True)), np.array(counts, np.int64)


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big numbers, whose order is that of the bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return [c.astype(U) for c in padded.view(">u8").T]


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their bytes, and which of them in that order differ from the one before."""
    words = words_of(rows)
    order = np.lexsort(words[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    return order, new


def ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the rank of each row among them."""
    order, new = sorted_rows(rows)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rows[order[new]], rank


def corpus_order(records: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For pieces as records (offset, windows, bytes) in documents: the smallest document with each of their windows, a row of STEP for each piece."""
    dictionary, parse = ranks(records)
    # The parse's suffix array: occurrences of each rank by document, the smallest first.
    occurrences = np.lexsort((docs, parse))
    least = docs[occurrences[np.flatnonzero(np.diff(parse[occurrences], prepend=-1))]]
    # The dictionary's suffix array, as far as suffixes have `length` bytes.
    windows = dictionary[:, 1].astype(np.int64)
    entry = np.repeat(np.arange(len(dictionary)), windows)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = np.lib.stride_tricks.sliding_window_view(dictionary[:, 2:], length, axis=1)[entry, at]
    order, new = sorted_rows(suffixes)
    # Both together: of each run of equal suffixes, the first occurrence of any of its entries.
    begin = np.flatnonzero(new)
    smallest = np.full((len(dictionary), STEP), np.iinfo(np.int64).max)
    if len(order):
        smallest[entry[order], at[order]] = np.repeat(np.minimum.reduceat(least[entry[order]], begin), np.diff(np.append(begin, len(order))))
    return smallest[parse]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by keys, and where each group of equal ones begins in it."""
    order = np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    first = keys[0][order]
    new[1:] = first[1:] != first[:-1]
    for k in keys[1:]:
        k = k[order]
        differ = (k[1:] != k[:-1]) & ~new[1:]
        if differ.any():
            if k.dtype != U:  # equal first hashes with unequal second ones are rare
                order = np.lexsort(keys[::-1])
                return order, np.flatnonzero(np.append(True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])))
            # Many phrases may share a trigger: order them within their group.
            group = np.cumsum(new)
            inner = np.lexsort((k, group))
            order, k, group = order[inner], k[inner], group[inner]
            new[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
    return order, np.flatnonzero(new)


def _least_of_group(order: np.ndarray, begin: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, the least value of its group."""
    out = np.empty_like(value)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(value[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    order = np.argsort(values)  # searching in order is several times faster
    out, values = np.empty(len(values), bool), values[order]
    out[order] = sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values
    return out


def _pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


TRIGGERS, WINDOWS = ["<u8", "<u4", "<u2"], ["<u8", "<u4"]
MESSAGES = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("base", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])
MESSAGE_SQL = "kind int, bucket long, block long, path string, base long, width int, data binary"


def _messages(kind: int, block: int, path: str, key: np.ndarray, columns: list[np.ndarray], doc: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: columns, sorted by key, and doc as its distance from the least one, in 2, 4 or 8 bytes."""
    if not len(key):
        return
    base = int(doc.min())
    away = (doc.view(U) - U(base % (1 << 64)))
    width = 2 if away.max() < 1 << 16 else 4 if away.max() < 1 << 32 else 8
    away = away.astype(f"<u{width}")
    bucket = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets), side="right")
    begins = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > begins)
    for at in range(0, len(full), 256):
        part = full[at : at + 256]
        data = [_pack([*(c[b:e] for c in (key, *columns)), away[b:e]]) for b, e in zip(begins[part], ends[part], strict=True)]
        k = len(part)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(part), pa.array([block] * k), pa.array([path] * k), pa.array([base] * k), pa.array([width] * k, pa.int32()), pa.array(data, pa.binary())], schema=MESSAGES)


def _gather(group: pa.Table, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns of all messages of a bucket, documents, and the number of each row's message."""
    parts, docs, message = [], [], []
    for i, (base, width, data) in enumerate(zip(*(group.column(c).to_pylist() for c in ("base", "width", "data")), strict=True)):
        *columns, away = _unpack(data, [*kinds, f"<u{width}"])
        parts.append(columns)
        docs.append((away.astype(U) + U(base % (1 << 64))).view(np.int64))
        message.append(np.full(len(away), i, np.int32))
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(docs), np.concatenate(message)


ANSWERS = pa.schema([("block", pa.int64()), ("path", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])
ANSWER_SQL = "block long, path string, kind int, data binary"
GONE, SPLIT, GONE_PHRASE, SHARED, GONE_WINDOW = 1, 2, 3, 4, 5


def _answers(group: pa.Table, message: np.ndarray, marks: list[tuple[int, np.ndarray, list[np.ndarray]]]) -> pa.Table:
    blocks, paths = group.column("block").to_pylist(), group.column("path").to_pylist()
    out: list[tuple] = []
    for kind, marked, columns in marks:
        rows = np.flatnonzero(marked)
        rows = rows[np.argsort(message[rows], kind="stable")]
        cut = np.searchsorted(message[rows], np.arange(len(blocks) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            own = rows[cut[i] : cut[i + 1]]
            out.append((blocks[i], paths[i], kind, _pack([c[own] for c in columns])))
    return pa.table([list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []], schema=ANSWERS)


def _store(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, size = TaskContext.get().partitionId() << 20, [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/block-{serial:012x}.parquet"
            table = pa.Table.from_batches(held)
            common.put(path, lambda out: pq.write_table(table, out, compression="zstd", use_dictionary=False))
            return pa.RecordBatch.from_pydict({"block": [serial], "path": [path], "n_bytes": [size]}, schema=pa.schema([("block", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())]))

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            at = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > BLOCK_BYTES:
                    held.append(batch.slice(at, i - at).select(["doc_id", "text"]))
                    yield flush()
                    serial, held, size, at = serial + 1, [], 0, i
                size += n
            held.append(batch.slice(at).select(["doc_id", "text"]))
        if sum(b.num_rows for b in held):
            yield flush()

    return run


def _load(path: str, length: int) -> tuple[list, Parse]:
    fs, at = common.filesystem(path)
    table = pq.read_table(at, filesystem=fs)
    ids = table.column("doc_id").to_pylist()
    known = np.array([LOWEST if i is None else i for i in ids], np.int64)
    return ids, Parse(known, table.column("text").to_pylist(), length)


def _send_triggers(buckets: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist(), strict=True):
                _, p = _load(path, length)
                if not len(p.trigger):
                    continue
                order, begin = _groups(p.trigger)
                docs, phrase = p.doc_id[order], p.phrase[order]
                least, most = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
                one = np.minimum.reduceat(phrase, begin) == np.maximum.reduceat(phrase, begin)
                code = np.where(one, phrase[begin] >> U(17) << U(1) | U(1) << U(47), U(0)) & U((1 << 48) - 2) | (most > least).astype(U)
                yield from _messages(SPLIT, block, path, p.trigger[order][begin], [(code & U(0xFFFFFFFF)).astype(np.uint32), (code >> U(32)).astype(np.uint16)], least, buckets)

    return run


def _meet_triggers(group: pa.Table) -> pa.Table:
    (trigger, low, high), docs, message = _gather(group, TRIGGERS)
    code = low.astype(U) | high.astype(U) << U(32)
    phrase, several = code >> U(1), (code & U(1)).astype(bool)
    order, begin = _groups(trigger)
    size = np.diff(np.append(begin, len(order)))
    spread = lambda values: np.repeat(values, size)
    docs_, phrase_ = docs[order], phrase[order]
    least = spread(np.minimum.reduceat(docs_, begin))
    shared = (spread(np.maximum.reduceat(docs_, begin)) > least) | spread(np.logical_or.reduceat(several[order], begin))
    lowest = spread(np.minimum.reduceat(phrase_, begin))
    same = (lowest == spread(np.maximum.reduceat(phrase_, begin))) & (lowest != 0)
    gone, split = np.empty(len(order), bool), np.empty(len(order), bool)
    gone[order], split[order] = shared & same & (docs_ > least), shared & ~same
    return _answers(group, message, [(GONE, gone, [trigger]), (SPLIT, split, [trigger])])


def _phrase_keys(p: Parse, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    return _mix(p.trigger[rows] * U(BASES[1]) ^ p.phrase[rows]), (p.phrase[rows] >> U(32)).astype(np.uint32)


def _settle(p: Parse, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases lose all windows by what is known, and which of the others are still to be compared."""
    order, begin = _groups(*_phrase_keys(p, slice(None)))
    lost = _within(p.trigger, _known(group, GONE)) | (p.doc_id > _least_of_group(order, begin, p.doc_id))
    rows = np.flatnonzero(_within(p.trigger, _known(group, SPLIT)) & ~lost)
    lost[rows] = _told(group, GONE_PHRASE, *_phrase_keys(p, rows))
    compare = np.zeros(len(lost), bool)
    compare[rows] = ~lost[rows]
    return lost, compare


def _told(group: pa.Table, kind: int, key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which (key, check) are among the answers of a kind."""
    out = np.zeros(len(key), bool)
    answers = [_unpack(d, ["<u8", "<u4"]) for k, d in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True) if k == kind]
    if answers and len(key):
        told, told_check = (np.concatenate(c) for c in zip(*answers, strict=True))
        order = np.argsort(told)
        told, told_check = told[order], told_check[order]
        at = np.searchsorted(told, key)
        on = np.arange(len(key))
        while len(on := on[at[on] < len(told)]) and len(on := on[told[at[on]] == key[on]]):
            out[on] |= told_check[at[on]] == check[on]
            at[on] += 1  # another answer with the same first hash
    return out


def _known(group: pa.Table, kind: int) -> np.ndarray:
    parts = [np.frombuffer(d, "<u8") for k, d in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True) if k == kind]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U)


def _send(buckets: int, length: int, kinds: list[int]):
    """Messages of some kinds: two hashes, and the least document in the block."""

    def run(group: pa.Table) -> pa.Table:
        block, path = group.column("block")[0].as_py(), group.column("path")[0].as_py()
        if SPLIT not in group.column("kind").to_pylist():
            return MESSAGES.empty_table()
        _, p = _load(path, length)
        compare = _settle(p, group)[1]
        out: list[pa.RecordBatch] = []
        for kind in kinds:
            key, check, docs = SENT[kind](p, group, compare)
            out += _messages(kind, block, path, key, [check], docs, buckets)
        return pa.Table.from_batches(out, MESSAGES)

    return run


def _folded(key: np.ndarray, check: np.ndarray, docs: np.ndarray, flagged: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each (key, check), with its least document; flagged puts into the lowest bit of check whether it has several."""
    if not len(key):
        return key, check, docs
    order, begin = _groups(key, check)
    first, docs = order[begin], docs[order]
    least, key, check = np.minimum.reduceat(docs, begin), key[first], check[first]
    if flagged:
        check = check << np.uint32(1) | (np.maximum.reduceat(docs, begin) > least).astype(np.uint32)
    order = np.argsort(key)
    return key[order], check[order], least[order]


def _phrases_sent(p: Parse, group: pa.Table, compare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.flatnonzero(compare)
    return _folded(*_phrase_keys(p, rows), p.doc_id[rows])


def _strings_sent(p: Parse, group: pa.Table, compare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number, _, key, check = p.strings_of(compare)
    return _folded(key, check, p.doc_id[number], flagged=True)


class Pieces:
    """The pieces of a block that are still to be compared, each distinct one once: serial number, hash of its string, record and least document."""

    def __init__(self, p: Parse, group: pa.Table, compare: np.ndarray) -> None:
        number, slot, key, check = p.strings_of(compare)
        shared = np.zeros((len(compare), p.slots), bool)
        shared[number, slot] = _told(group, SHARED, key, check)
        number, self.begin, self.windows, key, whole, record, self.counts = p.pieces_of(compare, shared)
        self.docs = p.doc_id[number]
        # Sorted by hash, told apart by bytes: equal hashes of unlike pieces can only make a piece be sent twice.
        order = np.argsort(whole)
        sorted_ = record[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.record, self.key = sorted_[first], key[order][first]
        self.least = np.minimum.reduceat(self.docs[order], first) if len(order) else self.docs

    def removed(self, group: pa.Table) -> np.ndarray:
        """For each piece and window whether it goes."""
        gone = np.zeros(len(self.key), np.uint16)
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
            if kind == GONE_WINDOW:
                serial, bits = _unpack(data, ["<u4", "<u2"])
                gone[serial] = bits
        bits = np.where(self.docs > self.least[self.of], np.uint16((1 << STEP) - 1), gone[self.of])
        return (bits[:, None] >> np.arange(STEP, dtype=np.uint16) & 1).astype(bool) & (np.arange(STEP) < self.windows[:, None])


def _send_pieces(buckets: int, length: int):
    def run(group: pa.Table) -> pa.Table:
        block, path = group.column("block")[0].as_py(), group.column("path")[0].as_py()
        if SHARED not in group.column("kind").to_pylist():
            return MESSAGES.empty_table()
        _, p = _load(path, length)
        pieces = Pieces(p, group, _settle(p, group)[1])
        order = np.argsort(pieces.key, kind="stable")
        record = np.ascontiguousarray(pieces.record[order]).view(f"V{length + STEP + 1}").reshape(-1)
        return pa.Table.from_batches(list(_messages(GONE_WINDOW, block, path, pieces.key[order], [order.astype(np.uint32), record], pieces.least[order], buckets)), MESSAGES)

    return run


def _meet_pieces(length: int):
    def run(group: pa.Table) -> pa.Table:
        width = length + STEP + 1
        (_, serial, record), docs, message = _gather(group, ["<u8", "<u4", f"V{width}"])
        record = np.ascontiguousarray(record).view(np.uint8).reshape(-1, width)
        gone = docs[:, None] > corpus_order(record, docs, length)
        bits = (gone * (1 << np.arange(STEP))).sum(axis=1).astype(np.uint16)
        return _answers(group, message, [(GONE_WINDOW, bits > 0, [serial, bits])])

    return run


SENT = {GONE_PHRASE: _phrases_sent, SHARED: _strings_sent}


def _meet(group: pa.Table) -> pa.Table:
    return pa.concat_tables([_meet_kind(k, group.filter(pc.equal(group.column("kind"), k))) for k in set(group.column("kind").to_pylist())])


def _meet_kind(kind: int, group: pa.Table) -> pa.Table:
    (key, check), docs, message = _gather(group, WINDOWS)
    several = check & np.uint32(1) if kind == SHARED else None
    check = check >> np.uint32(1) if kind == SHARED else check
    order, begin = _groups(key, check)
    marked = docs > _least_of_group(order, begin, docs)
    if kind == SHARED:
        marked = _least_of_group(order, begin, (~(marked | several.astype(bool))).astype(np.int8)) == 0
    return _answers(group, message, [(kind, marked, [key, check])])


def _finish(length: int):
    def run(group: pa.Table) -> pa.Table:
        ids, p = _load(group.column("path")[0].as_py(), length)
        lost, compare = _settle(p, group)
        pieces = Pieces(p, group, compare)
        at = (pieces.begin[:, None] + np.arange(STEP)).reshape(-1)
        spans = _spans(p, lost, at, pieces.removed(group).reshape(-1), pieces.counts * STEP)
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "spans", "kept")}
        for doc, text, cut in zip(ids, p.texts, spans, strict=True):
            at, kept = 0, []
            for b, e in cut:
                kept.append(text[at:b])
                at = e
            kept.append(text[at:])
            for k, v in zip(rows, (doc, len(text), sum(e - b for b, e in cut), [{"begin": b, "end": e} for b, e in cut], b"".join(kept)), strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=RESULT)

    return run


def _spans(p: Parse, lost: np.ndarray, begin: np.ndarray, out: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The removed runs of each document, as begin and end: those of lost phrases, and of windows that are out."""
    spans: list[list[tuple[int, int]]] = [[] for _ in p.texts]
    at, window = 0, 0
    for segment, count, n in zip(p.segments, p.counts, counts.tolist(), strict=True):
        own = slice(at, at + count)
        at += count
        some = begin[window : window + n][out[window : window + n]]
        window += n
        if not lost[own].any() and not len(some):
            continue
        sizes = np.array([e - b for _, b, e in segment])
        base = np.cumsum(sizes) - sizes
        covered = np.zeros(int(sizes.sum()) + 1, np.int32)
        first, windows = p.first[own], p.windows[own]
        np.add.at(covered, first[lost[own]], 1)
        np.add.at(covered, (first + windows + p.length - 1)[lost[own]], -1)
        np.add.at(covered, some, 1)
        np.add.at(covered, some + p.length, -1)
        on = (np.cumsum(covered)[:-1] > 0).astype(np.int8)
        for (doc, offset, _), b, size in zip(segment, base.tolist(), sizes.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(on[b : b + size], prepend=0, append=0))
            for s, e in edge.reshape(-1, 2).tolist():
                own_spans = spans[doc]
                if own_spans and own_spans[-1][1] >= s + offset:  # pieces of a long text overlap
                    own_spans[-1] = (own_spans[-1][0], max(own_spans[-1][1], e + offset))
                else:
                    own_spans.append((s + offset, e + offset))
    return spans


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
RESULT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row: the removed runs of bytes, and the bytes that are left."""
    if length < GRAM + STEP:
        raise ValueError(f"length must be at least {GRAM + STEP}")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_or_empty(text).cast("binary").alias("text"))
    rows = rows.withColumn("size", F.length("text"))
    stored = common.keep(rows.mapInArrow(_store(common.work_folder(spark, "blocks")), "block long, path string, n_bytes long"), "block-list")
    n, total = stored.agg(F.count("*"), F.sum("n_bytes")).first()
    n, buckets = max(1, n), max(1, (total or 0) // BUCKET_BYTES)

    sent = stored.repartition(n).mapInArrow(_send_triggers(buckets, length), MESSAGE_SQL)
    told = common.keep(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet_triggers, ANSWER_SQL), "trigger-answers")
    for send, meet in ((_send(buckets, length, [GONE_PHRASE, SHARED]), _meet), (_send_pieces(buckets, length), _meet_pieces(length))):
        sent = told.repartition(n, "block").groupBy("block").applyInArrow(send, MESSAGE_SQL)
        found = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, ANSWER_SQL)
        told = told.unionByName(common.keep(found, "answers"))
    each = stored.select("block", "path", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("data"))
    return each.unionByName(told).repartition(n, "block").groupBy("block").applyInArrow(_finish(length), RESULT_SQL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
