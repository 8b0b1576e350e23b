"""Language identification with spans for mixed texts.

Words are runs of letters. The script of a word's first letter narrows the candidates to languages that use the script
in the training texts. Each candidate scores the word by the summed log-probabilities of its letter trigrams (with word
ends), and Viterbi decoding with a penalty for each switch of language labels the words. Runs of one label are spans; the
language with the most letters in them is the document's.

Decoding is exact and runs over many words at once: the words of all texts of a batch form one sequence, in which the
switch at the start of a text is free, and which is cut into stretches. Each stretch is solved for every language
before it, and the stretches are chained.

The model is fitted on a bounded sample: `per_language` texts of each language (fewer if there are so many languages that all of them together
would be more than `sample_texts`, but one at least), drawn by a hash of doc_id, and of a text longer than `sample_chars` as many characters in stretches spread
over all of it. Every language that occurs is learned; a language takes 256 KB of the model. Whole texts are labelled: one longer than PIECE_CHARS
in pieces cut between words (inside a run of letters only where it is longer than that), whose best paths are chained, so the result is that
of the text as one. Word scores are multiples of 1/512, so sums are exact and equal texts get equal results in whatever company.

Null text, and text without a letter, is `und` with score 0; so is every text if nothing could be learned. Ties go to the language that is
first by name. Empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm import common
from roadspark.llm.quality import stretches

PER_LANGUAGE, SAMPLE_TEXTS = 1200, 12_000
SAMPLE_CHARS = 8192
#: Up to so many languages, counts by language are sent to every task.
SMALL_COUNTS = 100_000
UNKNOWN = "und"
SWITCH = 12.0
BITS = 16
STRETCH = 128
#: Characters labelled at a time for four languages; fewer for more.
BLOCK_CHARS = 2 << 20
#: Characters of a long text labelled at a time.
PIECE_CHARS = 1 << 19
#: Up to so many languages, stretches are solved side by side; more are solved word by word.
SIDE_BY_SIDE = 16
#: First code points of blocks of letters and the script each begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one letter."""
    points = range(0x110000)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        if len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    return letter, lower


class Words:
    """Words of a list of texts: text number, first and end character, script, and the trigram buckets of each."""

    def __init__(self, texts: list[str]) -> None:
        letter, lower = _letters()
        whole = " " + " ".join(texts) + " "
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        is_letter = letter[points]
        edge = np.flatnonzero(np.diff(is_letter.astype(np.int8)))
        self.begin, self.end = edge[::2] + 1, edge[1::2] + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])[:-1]
        self.text = np.searchsorted(self.base, self.begin, side="right") - 1
        self.letters = self.end - self.begin
        self.script = SCRIPT_OF[np.searchsorted(STARTS, points[self.begin], side="right") - 1] if len(self.begin) else np.zeros(0, int)
        small = np.where(is_letter, lower[points], np.uint32(32))
        # One trigram ends at every letter and one at the character after the word.
        self.grams = self.letters + 1
        self.first = np.concatenate([[0], np.cumsum(self.grams)])[:-1]
        at = np.repeat(self.begin - self.first, self.grams) + np.arange(int(self.grams.sum()))
        mix = small[np.maximum(at - 2, 0)] * np.uint32(0x9E3779B1) ^ small[at - 1] * np.uint32(0x85EBCA77) ^ small[at] * np.uint32(0xC2B2AE3D)
        inside = at - 2 >= np.repeat(self.begin, self.grams) - 1
        mix = np.where(inside, mix, small[at] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1))
        self.bucket = (mix ^ mix >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)


class Model:
    def __init__(self) -> None:
        self.languages: list[str] = []

    def fit(self, texts: list[str], languages: list[str]) -> Model:
        self.languages = sorted(set(languages))
        number = {k: i for i, k in enumerate(self.languages)}
        n = len(self.languages)
        counts, scripts = np.zeros((n, 1 << BITS)), np.zeros((n, len(NAMES)))
        for at in range(0, len(texts), 256):
            words = Words(texts[at : at + 256])
            of = np.array([number[k] for k in languages[at : at + 256]])[words.text] if len(words.begin) else np.zeros(0, int)
            np.add.at(scripts, (of, words.script), words.letters)
            key = np.repeat(of, words.grams) * (1 << BITS) + words.bucket
            counts += np.bincount(key, minlength=n << BITS).reshape(n, -1)
        self.table = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * (1 << BITS))).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        allowed = share >= 0.001
        self.barred = np.where(allowed | ~allowed.any(0), 0, -1000).T.astype(np.float32)
        return self

    def word_scores(self, words: Words) -> np.ndarray:
        scores = np.add.reduceat(self.table[words.bucket], words.first, axis=0)
        return np.rint((scores + self.barred[words.script]) * 512) / np.float32(512)

    def label(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """The words of texts and the number of each word's language."""
        words = Words(texts)
        if not self.languages or not len(words.begin):
            return words, np.zeros(len(words.begin), int)
        starts = np.concatenate([[True], words.text[1:] != words.text[:-1]])
        return words, viterbi(self.word_scores(words), np.where(starts, 0, SWITCH).astype(np.float32))[0]

    def _label_long(self, text: str) -> Iterator[tuple[int, Words, np.ndarray]]:
        """(first character, words, labels) of each piece of a long text, last piece first."""
        pieces = _pieces(text)
        enter, entered, through = np.zeros(len(self.languages)), [], []
        for number, (b, e) in enumerate(pieces):
            words = Words([text[b:e]])
            entered.append(enter)
            through.append(None)
            if self.languages and len(words.begin):
                penalty = np.full(len(words.begin), SWITCH, np.float32)
                penalty[0] *= number > 0
                _, through[-1], enter = viterbi(self.word_scores(words), penalty, enter)
        state = int(enter.argmax())
        for number, (b, e) in reversed(list(enumerate(pieces))):
            words = Words([text[b:e]])
            if through[number] is None:
                yield b, words, np.zeros(len(words.begin), int)
                continue
            penalty = np.full(len(words.begin), SWITCH, np.float32)
            penalty[0] *= number > 0
            yield b, words, viterbi(self.word_scores(words), penalty, entered[number], state)[0]
            state = int(through[number][state])

    def _letters(self, texts: list[str]) -> np.ndarray:
        """Letters of each text in each language."""
        n = max(1, len(self.languages))
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE_CHARS]
        words, labels = self.label([texts[i] for i in short])
        out = np.zeros((len(texts), n))
        if len(labels):
            out[short] = np.bincount(words.text * n + labels, words.letters, len(short) * n).reshape(len(short), n)
        for i in set(range(len(texts))) - set(short):
            for _, words, labels in self._label_long(texts[i]):
                out[i] += np.bincount(labels, words.letters, n)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        letters = self._letters([t or "" for t in texts])
        for row, best, total in zip(letters, letters.argmax(1), letters.sum(1), strict=True):
            out.append((self.languages[best], float(row[best] / total)) if total and self.languages else (UNKNOWN, 0.0))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(first character, end, language) of each run of words of one language."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not self.languages:
            return out
        whole = [t or "" for t in texts]
        short = [i for i, t in enumerate(whole) if len(t) <= PIECE_CHARS]
        words, labels = self.label([whole[i] for i in short])
        _grow([out[i] for i in short], 0, words, labels, self.languages)
        for i in set(range(len(texts))) - set(short):
            for at, words, labels in reversed(list(self._label_long(whole[i]))):
                _grow([out[i]], at, words, labels, self.languages)
        return out


def _grow(spans: list[list[tuple[int, int, str]]], at: int, words: Words, labels: np.ndarray, languages: list[str]) -> None:
    """Add the words of each text to its spans."""
    for t, b, e, k in zip(words.text.tolist(), (words.begin - words.base[words.text]).tolist(), (words.end - words.base[words.text]).tolist(), labels.tolist(), strict=True):
        own = spans[t]
        if own and own[-1][2] == languages[k]:
            own[-1] = (own[-1][0], at + e, own[-1][2])
        else:
            own.append((at + b, at + e, languages[k]))


def _pieces(text: str) -> list[tuple[int, int]]:
    """Stretches of a text of PIECE_CHARS at most, cut where no letter adjoins on one side, if there is such a place."""
    out, at = [], 0
    while at < len(text):
        end = cut = min(len(text), at + PIECE_CHARS)
        while cut < len(text) and cut > at and text[cut - 1].isalpha() and text[cut].isalpha():
            cut -= 1
        out.append((at, cut if cut > at else end))
        at = out[-1][1]
    return out


def viterbi(scores: np.ndarray, penalty: np.ndarray, enter: np.ndarray | None = None, leave: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best label of each row: the sum of scores less penalty[i] where label i differs from the one before.

    enter is what each label before the first row is worth, leave the last row's label where it is given. Along with the labels: for each last
    label the label before the first row, and what each last label is worth.
    """
    k = scores.shape[1]
    enter = np.zeros(k) if enter is None else enter
    return (_side_by_side if k <= SIDE_BY_SIDE else _word_by_word)(scores, penalty, enter, leave)


def _word_by_word(scores: np.ndarray, penalty: np.ndarray, enter: np.ndarray, leave: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = scores.shape
    came, moved, value, origin = np.empty(n, np.int32), np.empty((n, k), bool), enter.astype(np.float64), np.arange(k)
    for t in range(n):
        came[t] = value.argmax()
        best = value[came[t]] - penalty[t]
        moved[t] = value < best
        origin = np.where(moved[t], origin[came[t]], origin)
        value = np.maximum(value, best) + scores[t]
    labels, state = np.empty(n, int), int(value.argmax()) if leave is None else leave
    for t in range(n - 1, -1, -1):
        labels[t] = state
        state = int(came[t]) if moved[t, state] else state
    return labels, origin, value - value.max()


def _side_by_side(scores: np.ndarray, penalty: np.ndarray, enter: np.ndarray, leave: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = scores.shape
    m = max(1, -(-n // STRETCH))
    length = -(-n // m)
    s = np.zeros((m * length, k), np.float32)
    s[:n] = scores
    p = np.zeros(m * length, np.float32)
    p[:n], p[n:] = penalty, 1e30  # the rows that fill the last stretch keep their label
    s, p = s.reshape(m, length, k), p.reshape(m, length)
    value = np.full((m, k, k), -1e30, np.float32)
    value[:, np.arange(k), np.arange(k)] = 0
    came, moved = np.empty((length, m, k), np.uint8), np.empty((length, m, k, k), bool)
    for t in range(length):
        best = value.max(axis=2) - p[:, t, None]
        came[t] = value.argmax(axis=2)
        moved[t] = value < best[:, :, None]
        value = np.maximum(value, best[:, :, None]) + s[:, t, None, :]
    enter, choice, origin = enter.astype(np.float64), np.empty((m, k), np.uint8), np.arange(k)
    for i in range(m):
        through = enter[:, None] + value[i]
        choice[i] = through.argmax(axis=0)
        origin = origin[choice[i]]
        enter = through.max(axis=0)
        enter -= enter.max()
    last, first = np.empty(m, int), np.empty(m, int)
    state = int(enter.argmax()) if leave is None else leave
    for i in range(m - 1, -1, -1):
        last[i], first[i] = state, choice[i, state]
        state = int(first[i])
    labels, rows, state = np.empty((m, length), int), np.arange(m), last
    for t in range(length - 1, -1, -1):
        labels[:, t] = state
        state = np.where(moved[t, rows, first, state], came[t, rows, first], state)
    return labels.reshape(-1)[:n], origin, enter


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """docs (doc_id, text, lang); held-out rows, and rows without id, text or language, are left out."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    counts = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return Model()
    each = max(1, min(per_language, sample_texts // languages))
    # Twice as many as wanted are drawn, and forty more, so that no language is missed; of those the first by hash are taken.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.join(F.broadcast(counts) if languages <= SMALL_COUNTS else counts, F.col("lang") == F.col("of")).filter(draw * F.col("n") < 2 * each + 40)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id", "text")
    taken = drawn.select("lang", "doc_id", stretches("text", sample_chars).alias("text")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    rows = taken.orderBy("lang", "place").select("lang", "text").collect()
    return Model().fit([r.text for r in rows], [r.lang for r in rows])


def _mapped(docs: DataFrame, model: Model, kind: str, make) -> DataFrame:
    weights = pickle.dumps(model)
    most = max(1 << 14, BLOCK_CHARS * 16 // max(16, len(model.languages) ** 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(weights)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < most):
                    chars += len(texts[end] or "")
                    end += 1
                yield make(own, batch.column("doc_id").slice(at, end - at), texts[at:end])
                at = end

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the most letters and its share of them."""

    def make(own: Model, ids: pa.Array, texts: list) -> pa.RecordBatch:
        found = own.predict(texts)
        return pa.RecordBatch.from_arrays([ids, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return _mapped(docs, model, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", make)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans): runs of words of one language, as characters begin to end."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def make(own: Model, ids: pa.Array, texts: list) -> pa.RecordBatch:
        spans = [[{"begin": b, "end": e, "lang": k} for b, e, k in row] for row in own.spans(texts)]
        return pa.RecordBatch.from_arrays([ids, pa.array(spans, kind)], ["doc_id", "spans"])

    return _mapped(docs, model, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<begin: long, end: long, lang: string>>", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
