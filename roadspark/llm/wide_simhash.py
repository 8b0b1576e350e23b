"""SimHash near-duplicates at a similarity of shingle sets: wide fingerprints, a byte-position inverted index, count filtering, verification.

The 64-bit fingerprints of simhash.py differ in some ten bits where two texts have similarity 0.8, so no count of equal bytes is guaranteed
there. This is the same operator with a wider fingerprint of the same counters. Each shingle of five words (lower-case A-Z, words of bytes
other than blank and \\x09-\\x0D; a shorter text is one shingle; repeats count once) adds a seeded sign to one of 16,384 counters, and two rounds
of seeded signs and a Hadamard transform spread every shingle over all of them. The counters form 128 positions of 128; a position's byte
is the number and the sign of its strongest counter. Two texts of similarity 0.8 agree in a byte with a chance of 0.40, of 0.9 with 0.56, unequal
ones with 1/256.

The inverted index posts each distinct text under TUPLES sets of four positional bytes (32 bits, so that unlike texts meet by chance once or so
in 10^7 texts). Of pairs that meet, the shared positional bytes are tallied over all positions, those with LEAST_EQUAL or more are kept (a pair of
similarity 0.8 has 53 on average, and fell below it in no trial), and whole shingle sets decide: similarity 0.8 or more, exactly. In trials, pairs of similarity 0.8
met in 97 of 100 cases, of 0.85 in 99.8, of 0.9 in all but 1 of 3,000.

The rows of a posting are compared with one of them, its leader (the least hash): first each text with the leader that it shares most postings with,
which takes out large groups of copies at one comparison a text; then those that are left with their other leaders, TUPLES at most; and what is
near none of them is tallied in blocks of bounded size, where only pairs that pass the count are sent on. As a group's texts spread over TUPLES postings, and
over several lists of each, no list holds more than a small part of all rows. Texts are fetched once, for those that share a posting with another.

What the index leaves out is found exactly. A text of which more than a fifth of the shingles stand in no other text is similar to none, and needs no further look: the
shingles that a hash picks, a third, are enough to tell this of most texts (short ones post all of theirs). For those that are left: in one order of all shingles, rare ones first, two sets of similarity 0.8 share a shingle among the first fifth
of each, and so many of these that the rest can't make up for it. Texts of different groups that meet in such a list are compared by parity bits, one for each
remainder of the shingles' hashes: two sets differ in as many shingles at least as in bits, so no pair goes that the bound allows, and of most families of texts with much, but less, in
common none is sent on. What is left is counted, and whole shingle sets decide again. So the groups are those of all pairs of similarity 0.8, however these were found. The order is learnt from a bounded sample of texts,
which changes the length of lists but no result; long lists are compared in blocks.

Texts of equal words are one entry, known by a 64-bit hash. Null text counts as empty, and texts without words are alike. Repeated rows and null
ids are kept apart as rows; other columns, whatever their names, travel along untouched. An empty table gives no row. A very long text costs
memory in proportion to its own length alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.llm import blocks, common

SHINGLE = 5
#: Similarity bound, as a fraction.
LEAST = (4, 5)
POSITIONS, EACH = 128, 128
WIDTH, TUPLES = 4, 160
LEAST_EQUAL = 30
#: Texts on average that tell which shingles are frequent, and frequent ones that every task knows (16 bytes each).
SAMPLE_TEXTS, FREQUENT = 16_000, 1 << 17
#: One shingle in so many tells whether a text has too many of its own to be similar to another; texts with fewer shingles than SHORT tell it by all.
PICKED, SHORT = 3, 60
#: Pairs that are looked at together, and those whose parity bits are.
PAIRS, PAIRS_OF_BITS = 1 << 20, 1 << 14
#: Parity bits of a text. The more, the longer the texts of which unlike pairs are told; no number changes a result.
BITS = 2048
#: Texts whose counters are computed together.
TOGETHER = 32
_DRAWN = np.random.default_rng(8)
SIGNS = [_DRAWN.choice(np.array([-1, 1], np.float32), (POSITIONS, EACH)) for _ in range(2)]
_PER = 5  # orders of the positions, each cut into disjoint sets
SETS = np.concatenate([_DRAWN.permutation(POSITIONS)[: TUPLES // _PER * WIDTH].reshape(-1, WIDTH) for _ in range(_PER)])


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


ACROSS, ALONG = _hadamard(POSITIONS), _hadamard(EACH)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(n, POSITIONS) bytes of shingle sets."""
    out = np.empty((len(sets), POSITIONS), np.uint8)
    for at in range(0, len(sets), TOGETHER):
        part = sets[at : at + TOGETHER]
        x = np.zeros((len(part), POSITIONS * EACH), np.float32)
        for i, hashes in enumerate(part):
            signs = 1 - 2 * (hashes >> np.uint64(63)).astype(np.float32)
            x[i] = np.bincount((hashes % np.uint64(POSITIONS * EACH)).astype(np.int64), signs, POSITIONS * EACH)
        x = x.reshape(-1, POSITIONS, EACH)
        for signs in SIGNS:
            x = ACROSS @ (x * signs) @ ALONG
        strongest = np.abs(x).argmax(axis=2)
        out[at : at + TOGETHER] = strongest * 2 + (np.take_along_axis(x, strongest[..., None], 2)[..., 0] > 0)
    return out


def _sign(shingle: int, field: int | None):
    """For each row the hash of its words, its fingerprint, a hash of its text, and a key of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.encode() for t in common.texts_of(part, field).to_pylist()]
                hashes = [np.array([xxhash.xxh64_intdigest(t, 7) for t in some], np.uint64).view(np.int64) for some in ([b" ".join(t.lower().split()) for t in texts], texts)]
                prints = pa.array([p.tobytes() for p in fingerprints([shingles(t, shingle) for t in texts])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(hashes[0]), prints, pa.array(hashes[1]), pa.array(np.arange(key, key + len(texts)))], SIGNED)
                key += len(texts)
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return run


SIGNED = ["row", "node", "print", "text_hash", "row_key"]


def _as_bytes(prints: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each entry and set of positions."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            prints = _as_bytes(part.column("print")).astype(np.int64)
            keys = np.arange(len(SETS), dtype=np.int64)
            for j in range(WIDTH):
                keys = keys << 8 | prints[:, SETS[:, j]]
            nodes = np.repeat(part.column("node").to_numpy(), len(SETS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], ["key", "node"])


def _count_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of each block, the pairs with enough equal positional bytes."""
    for table, begins in blocks.by_block(batches, ["key", "left", "right"]):
        prints, nodes, n = _as_bytes(table.column("print")), table.column("node").to_numpy(), table.num_rows
        end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
        rows = np.arange(n)
        for d in range(1, int((end - rows).max())):
            rows = rows[rows + d < end[rows]]
            if not len(rows):
                break
            hit = rows[(prints[rows] == prints[rows + d]).sum(axis=1) >= LEAST_EQUAL]
            if len(hit):
                u, v = nodes[hit], nodes[hit + d]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _verify(shingle: int, least: tuple[int, int], equal: int):
    """The pairs with enough equal positional bytes whose shingle sets are at least as similar as the bound."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_as_bytes(batch.column("u_print")) == _as_bytes(batch.column("v_print"))).sum(axis=1) >= equal
            for at in np.flatnonzero(near).tolist():  # a pair at a time, as texts may be long
                x, y = (shingles(batch.column(c)[at].as_py().encode(), shingle) for c in ("u_text", "v_text"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near[at] = both * least[1] >= (len(x) + len(y) - both) * least[0]
            yield batch.select(["u", "v"]).filter(pa.array(near))

    return run


def _near(pairs: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int], equal: int = LEAST_EQUAL) -> DataFrame:
    """The pairs (u, v) that _verify() keeps; texts has (node, print, text)."""
    side = lambda end: texts.select(F.col("node").alias(end), F.col("print").alias(f"{end}_print"), F.col("text").alias(f"{end}_text"))
    both = common.spread_join(pairs.join(side("u"), "u"), side("v"), "v", F.xxhash64("u"))  # a v in very many pairs is spread
    return common.keep(both.select("u", "v", "u_print", "v_print", "u_text", "v_text").mapInArrow(_verify(shingle, least, equal), "u long, v long"), "near")


def _texts(pairs: DataFrame, entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, print, text) of the nodes in pairs."""
    ends = [pairs.select(F.col(end).alias("node")).distinct() for end in ("u", "v")]  # each first by itself, as a v is in many pairs
    used = common.keep(ends[0].unionByName(ends[1]).distinct(), "used")
    texts = rows.join(used, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return common.keep(texts.join(entries.select("node", "print"), "node"), "texts")


def indexed_pairs(entries: DataFrame, rows: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """Verified pairs (u, v) of nodes among entries (node, print) that the inverted index finds; their texts are in rows (node, text)."""
    posted = entries.select("print", "node").mapInArrow(_post, "key long, node long").repartition("key")
    first = posted.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    stars = common.keep(posted.join(first, "key").filter("node <> v").select("key", F.col("node").alias("u"), "v"), "stars")
    shared = common.keep(stars.groupBy("u", "v").agg(F.count("*").alias("n")), "shared")
    texts = _texts(shared, entries, rows)
    most = shared.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    found = _near(most, texts, shingle, least)
    left = shared.select("u", "v").join(found.select("u"), "u", "left_anti").join(most, ["u", "v"], "left_anti")
    found = found.unionByName(_near(left, texts, shingle, least))
    alone = stars.select("key", "u").join(found.select("u").distinct(), "u", "left_anti").select("key", F.col("u").alias("node"))
    dealt = blocks.dealt(alone, "key", "node").select("key", "left", "right", "node").join(texts.select("node", "print"), "node")
    dealt = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return found.unionByName(_near(common.keep(dealt.mapInArrow(_count_blocks, "u long, v long").distinct(), "counted"), texts, shingle, least))


def _rest(size: int, least: tuple[int, int]) -> int:
    """Of a set of a size, how many of its last shingles need no list: one less than it shares at least with a set as similar as the bound."""
    return -(-size * least[0] // least[1]) - 1


def _hash_all(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = [shingles(t.as_py().encode(), shingle) for t in batch.column("text").slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], ["key"])

    return run


def _pick(shingle: int):
    """A row for each text and picked shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py().encode(), shingle).view(np.int64) for t in part.column("text")]
                sizes = np.array([len(s) for s in sets], np.int32)
                picked = [s if len(s) < SHORT else s[s % PICKED == 0] for s in sets]
                each = [len(s) for s in picked]
                columns = [np.concatenate(picked), np.repeat(part.column("node").to_numpy(), each), np.repeat(sizes, each)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "size"])

    return run


def _settled(rows: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(node) of rows (node, text) whose own shingles, which no other text has, are too many for any text to be as similar as the bound.

    Of a text that is not short, only picked shingles count, which every text posts. A short one counts all, as each text of a size that the bound
    allows beside it is shorter than SHORT and posts all.
    """
    a, b = least
    posted = rows.select("node", "text").mapInArrow(_pick(shingle), "key long, node long, size int").repartition("key")
    own = posted.groupBy("key").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.max("size").alias("size")).filter("node = last")
    own = own.filter((F.pmod("key", F.lit(PICKED)) == 0) | (F.col("size") * b < SHORT * a)).groupBy("node", "size").agg(F.count("*").alias("n"))
    return own.filter(F.col("size") - F.col("n") < F.ceil(F.col("size").cast("long") * a / b)).select("node")


def _parity(hashes: np.ndarray) -> bytes:
    """BITS bits: whether the shingles of each remainder are odd in number. What two sets share changes the same bits of both, so they differ in as many shingles at least as in bits."""
    return np.packbits(np.bincount((hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1).tobytes()


def _list_first(shingle: int, least: tuple[int, int], frequent):
    """For each text, once in a task, the shingles that come first in it, and its parity bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, nodes, sizes, bits = [], [], [], []
                for node, text in zip(part.column("node").to_pylist(), part.column("text"), strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    hashes = shingles(text.as_py().encode(), shingle).view(np.int64)
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    often = np.where(known[place] == hashes, counts[place], 0)
                    keys.append(hashes[np.lexsort((hashes, often))[: len(hashes) - _rest(len(hashes), least)]])
                    nodes.append(node)
                    sizes.append(len(hashes))
                    bits.append(_parity(hashes))
                if nodes:
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(k) for k in keys])), pa.int32()), pa.array(np.concatenate(keys)))
                    columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "size", "bits", "keys"])

    return run


def _across(least: tuple[int, int]):
    """Of the rows of each block, sorted by group, the pairs of different groups whose sizes and parity bits allow the bound."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in blocks.by_block(batches, ["key", "left", "right"]):
            n = table.num_rows
            node, size, group, part, left, right = (table.column(c).to_numpy() for c in ("node", "size", "group", "part", "left", "right"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(n, -1)
            end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
            new = np.append(True, group[1:] != group[:-1])
            new[begins] = True
            starts = np.flatnonzero(new)
            after = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))  # where the next group begins
            step = np.cumsum(end - after) // PAIRS
            for rows in np.split(np.arange(n), np.flatnonzero(np.diff(step)) + 1):
                each = (end - after)[rows]
                a = np.repeat(rows, each)
                b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each - after[rows], each)
                fit = (left[a] == right[a]) | (part[a] != part[b])
                fit &= np.minimum(size[a], size[b]).astype(np.int64) * least[1] >= np.maximum(size[a], size[b]).astype(np.int64) * least[0]
                a, b = a[fit], b[fit]
                total = size[a].astype(np.int64) + size[b]
                differ = total - 2 * ((total * least[0] + sum(least) - 1) // sum(least))  # the most shingles that are in one of both alone
                fit = np.zeros(len(a), bool)
                for k in range(0, len(a), PAIRS_OF_BITS):
                    some = np.s_[k : k + PAIRS_OF_BITS]
                    fit[some] = np.bitwise_count(bits[a[some]] ^ bits[b[some]]).sum(axis=1, dtype=np.int64) <= differ[some]
                a, b = a[fit], b[fit]
                if len(a):
                    a, b = np.where(node[a] > node[b], a, b), np.where(node[a] > node[b], b, a)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[a], node[b], size[a], size[b])], ["u", "v", "u_size", "v_size"])

    return run


def other_pairs(entries: DataFrame, rows: DataFrame, label: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """All pairs (u, v) at least as similar as the bound of nodes in different groups of label (node, component); a node without a row there is its own."""
    every = max(1, -(-entries.count() // SAMPLE_TEXTS))
    settled = common.keep(_settled(rows, shingle, least), "settled", tidy=True)
    still = common.keep(entries.select("node").join(settled, "node", "left_anti"), "still")
    counted = rows.filter(F.pmod("node", F.lit(every)) == 0).select("text").mapInArrow(_hash_all(shingle), "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    often = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow().sort_by("key")
    # A shingle that no text has stands where none is frequent, so that there is always one to compare with: its count is that of unknown ones.
    known, counts = (often[c].to_numpy() for c in ("key", "n")) if often.num_rows else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    frequent = rows.sparkSession.sparkContext.broadcast((known, counts))
    first = rows.join(still, "node", "left_semi").select("node", "text").mapInArrow(_list_first(shingle, least, frequent), "node long, size int, bits binary, keys array<long>")
    first = common.keep(first, "first", tidy=True)
    posted = first.select(F.explode("keys").alias("key"), "node", "size").repartition("key")
    one = F.struct("node", "size")  # all columns, so that both sides of the join read one exchange
    several = posted.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("key")
    met = common.keep(posted.join(several, "key").join(label.select("node", "component"), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("group")), "met")
    dealt = blocks.dealt(met, "key", "node", useful=F.min("group") != F.max("group")).select("key", "left", "right", "part", "group", "node", "size")
    dealt = dealt.join(first.groupBy("node").agg(F.first("bits").alias("bits")), "node")
    dealt = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "group")
    shared = dealt.mapInArrow(_across(least), "u long, v long, u_size int, v_size int").groupBy("u", "v", "u_size", "v_size").agg(F.count("*").alias("n"))
    a, b = least
    total = F.col("u_size").cast("long") + F.col("v_size")
    needed = F.floor((total * a + (a + b - 1)) / (a + b))
    rest = F.ceil(F.greatest("u_size", "v_size").cast("long") * a / b) - 1  # the larger set has the larger rest
    pairs = common.keep(shared.filter(F.col("n") + rest >= needed).select("u", "v"), "others")
    return _near(pairs, _texts(pairs, entries, rows), shingle, least, equal=0)


def groups(entries: DataFrame, rows: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(node, component) as components() gives it, of all pairs at least as similar as the bound, among entries (node, print) with texts in rows (node, text)."""
    work = common.Workspace(rows.sparkSession)
    with common.inside(work):
        found = indexed_pairs(entries, rows, shingle, least)
        label = common.components(found)
    label = common.keep(label, "indexed")
    work.close()
    # Further pairs connect groups, so only their least nodes are looked at again.
    pairs = other_pairs(entries, rows, label, shingle, least)
    for end in ("u", "v"):
        pairs = pairs.join(label.withColumnsRenamed({"node": end, "component": f"{end}_root"}), end, "left")
    moved = common.components(pairs.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    after = label.join(moved.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    return after.select("node", F.coalesce("root", "component").alias("component")).unionByName(moved)


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """docs with the row of smallest doc_id of each group; of rows that share that id, the one of least text hash. Groups without any id keep one row."""
    rows, field = common.rows_and_text(docs, text)
    kind = T.StructType([rows.schema["row"], *(T.StructField(c, T.BinaryType() if c == "print" else T.LongType()) for c in SIGNED[1:])])
    rows = common.keep(rows.mapInArrow(_sign(shingle, field), kind), "signs")
    entries = common.keep(rows.groupBy("node").agg(F.min("print").alias("print"), F.count("*").alias("n")), "entries")
    texts = rows.select("node", F.coalesce(F.col("row")[text], F.lit("")).alias("text"))
    label = common.keep(groups(entries, texts, shingle, least), "labels")

    # Only rows of groups with several rows can go: few columns of those find the ones that do.
    several = label.select("node", F.col("component").alias("root")).unionByName(label.select(F.col("component").alias("node"), F.col("component").alias("root")).distinct())
    alike = entries.filter("n > 1").select("node").join(several, "node", "left_anti").select("node", F.col("node").alias("root"))
    several = common.keep(several.unionByName(alike), "grouped")
    place = F.struct(F.col("row")[doc_id].isNull().alias("none"), F.col("row")[doc_id].alias("id"), "text_hash", "row_key")
    grouped = common.keep(common.spread_join(rows.select("node", "row_key", place.alias("place")), several, "node", F.col("row_key")).select("root", "row_key", "place"), "members")
    first = grouped.groupBy("root").agg(F.min("place").alias("first")).select("root", F.col("first.row_key").alias("stays"))
    gone = common.keep(common.spread_join(grouped.select("root", "row_key"), first, "root", F.col("row_key")).filter("row_key <> stays").select("row_key"), "gone")
    return rows.join(gone, "row_key", "left_anti").select("row.*")
