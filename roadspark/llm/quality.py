"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. In each chunk, learned filters slide over embedded
bytes, each filter keeps its highest response, and a small layer turns the responses into a hidden vector. The document
is the mean of its chunks' vectors, and a logistic unit gives the probability of label 1.

The network is trained on the driver from a bounded sample: `sample` labelled rows, drawn by a hash of doc_id, and of a text longer than
`sample_chars` as many characters in STRETCHES stretches spread evenly from its begin to its end. Scoring covers every byte of every text. Null or
empty text is one chunk of padding and has a score like any other; a very long text needs memory in proportion to its own length. Without labelled
rows of both labels the score is the share of label 1 among them, or 0.5. Repeated rows get equal scores, as all blocks have one shape and a
document's chunks are summed in order; of several labels of one doc_id the larger counts. Empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common

SAMPLE_DOCUMENTS = 4000
SAMPLE_CHARS, STRETCHES = 16 << 10, 8
THRESHOLD = 0.3
CHUNK, STEP = 256, 224
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 12, 4, 8, 32, 16
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks scored at a time.
BLOCK = 512
PAD = 256


def chunks_of(text: bytes, first: int = 0, most: int | None = None) -> np.ndarray:
    """Rows of CHUNK byte values, STEP apart, the last one padded: `most` of them from `first` on."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    last = n if most is None else min(n, first + most)
    padded = np.full((last - first - 1) * STEP + CHUNK, PAD, np.int16)
    own = np.frombuffer(text, np.uint8)[first * STEP : first * STEP + len(padded)]
    padded[: len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def count_chunks(text: bytes) -> int:
    return max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))


class Network:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (257, EMBED)).astype(np.float32),
            "filter": rng.normal(0, (WIDTH * EMBED) ** -0.5 * 2, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "mix": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "mix_bias": np.zeros(HIDDEN, np.float32),
            "out": np.zeros(HIDDEN, np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        flat = self.p["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def _pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each chunk, and where."""
        windows = np.ascontiguousarray(self._windows(chunks)).reshape(-1, WIDTH * EMBED)
        response = (windows @ self.p["filter"]).reshape(len(chunks), POSITIONS, FILTERS)
        return response, windows

    def hidden(self, chunks: np.ndarray) -> np.ndarray:
        top = self._pooled(chunks)[0].max(axis=1) + self.p["bias"]
        return np.tanh(np.maximum(top, 0) @ self.p["mix"] + self.p["mix_bias"])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        sums, counts = np.zeros((len(texts), HIDDEN)), np.array([count_chunks(t) for t in texts])
        block, owner, filled = np.full((BLOCK, CHUNK), PAD, np.int16), np.zeros(BLOCK, np.int64), 0
        for i, text in enumerate(texts):
            at = 0
            while at < counts[i]:
                rows = chunks_of(text, at, BLOCK - filled)
                block[filled : filled + len(rows)], owner[filled : filled + len(rows)] = rows, i
                at, filled = at + len(rows), filled + len(rows)
                if filled == BLOCK:
                    np.add.at(sums, owner, self.hidden(block))
                    filled = 0
        if filled:
            np.add.at(sums, owner[:filled], self.hidden(block)[:filled])
        logit = (sums / counts[:, None] * self.p["out"]).sum(axis=1) + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-logit))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, least_steps: int = 650, batch: int = 48, per_document: int = 6, rate: float = 4e-3, seed: int = 1) -> Network:
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        rows = [chunks_of(t) for t in texts]
        self.p["out_bias"][0] = np.log(y.mean() / (1 - y.mean()))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        each = -(-len(y) // batch)
        epochs = max(epochs, -(-least_steps // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at : at + batch]
                picked = [rows[d][rng.choice(len(rows[d]), min(per_document, len(rows[d])), replace=False)] for d in docs]
                owner = np.repeat(np.arange(len(docs)), [len(p) for p in picked])
                gradient = self._gradient(np.concatenate(picked), owner, y[docs])
                step += 1
                pace = rate * min(1, step / 20) * (1 - 0.95 * step / steps)
                for k, g in gradient.items():
                    a, b = moment[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.p[k] -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        return self

    def _gradient(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(chunks)
        response, windows = self._pooled(chunks)
        where = response.argmax(axis=1)
        top = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + p["bias"]
        active = np.maximum(top, 0)
        hidden = np.tanh(active @ p["mix"] + p["mix_bias"])
        count = np.bincount(owner, minlength=len(y)).astype(np.float32)
        mean = np.zeros((len(y), HIDDEN), np.float32)
        np.add.at(mean, owner, hidden)
        mean /= count[:, None]
        d_logit = (1 / (1 + np.exp(-(mean @ p["out"] + p["out_bias"][0]))) - y) / len(y)
        d_hidden = (d_logit[:, None] * p["out"])[owner] / count[owner, None] * (1 - hidden**2)
        d_top = (d_hidden @ p["mix"].T) * (top > 0)
        rows = (np.arange(n)[:, None] * POSITIONS + where).reshape(-1)  # a window for each chunk and filter
        best = windows[rows].reshape(n, FILTERS, WIDTH * EMBED)
        d_filter = np.einsum("nf,nfw->wf", d_top, best, optimize=True)
        d_window = (d_top[:, :, None] * p["filter"].T).reshape(-1, EMBED)
        spots = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
        used = np.take_along_axis(chunks, spots.reshape(n, -1), axis=1).reshape(-1)
        d_embed = np.stack([np.bincount(used, d_window[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
        return {"embed": d_embed, "filter": d_filter, "bias": d_top.sum(0), "mix": active.T @ d_hidden, "mix_bias": d_hidden.sum(0), "out": mean.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def stretches(text: str, chars: int, parts: int = STRETCHES) -> Column:
    """The whole text if it has so many characters at most; else so many of it in stretches spread evenly from begin to end."""
    each = chars // parts
    begin = lambda i: F.floor(i * (F.length(text) - each) / (parts - 1)).cast("int") + 1
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substr(F.col(text), begin(i), F.lit(each))), "")
    return F.when(F.length(text) > chars, cut).otherwise(F.col(text))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """docs (doc_id, text) and labels (doc_id, quality); held-out and null ids and null labels are left out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # the limit bounds what is sent
    rows = rows.select("doc_id", "label", stretches("text", sample_chars).alias("text")).orderBy(F.xxhash64("doc_id", F.lit(12)), "text").limit(sample).collect()
    return Network().fit([r.text.encode() for r in rows], [r.label for r in rows])


def score(docs: DataFrame, network: Network, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """(row, score): every row of docs (or some of its columns) as a struct with the probability of label 1."""
    weights = pickle.dumps(network)
    rows, field = common.rows_and_text(docs, text, columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = own.score([t.encode() for t in common.texts_of(part, field).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores, pa.float64())], ["row", "score"])
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def keep_good(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, network).filter(F.col("score") >= threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, network, columns=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
