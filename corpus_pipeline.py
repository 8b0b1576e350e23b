"""From documents to packed training sequences: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir), and its result is written and read again as the next one's docs. The work folders of a stage belong to
its run: run() has its own, and stages called one by one over one sf_dir are a run, which begins with the first. A stage deletes the
folders of the stage before it in the same run, whose result is written by then, and no others.

Null texts count as empty, null ids and sources are values like others, repeated rows are rows of their own until the stages for copies, which keep
one of them; other columns travel along untouched up to packing, which doesn't read them. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from roadspark.llm import common, exact_dedup, mixing, packing, quality, wide_simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that go to Python at once. With Spark's own 10,000 a batch of texts holds tens of MB, of pairs of texts twice that, in the executor and again in Python.
BATCH_ROWS = 2_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_RUN: ContextVar[str] = ContextVar("run", default="")
_OPEN: dict[tuple[str, str, str], common.Workspace] = {}


def _owning(stage: Stage) -> Stage:
    @wraps(stage)
    def owned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, _RUN.get())
        before = _OPEN.pop(key, None)
        if before is not None and stage.__name__ != "keep_good":  # a run that begins anew leaves pending results of the last one alone
            before.close()
        _OPEN[key] = common.Workspace(spark)
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:  # stays set, as the last stage's result is computed when it is read
            spark.conf.set(BATCH, str(BATCH_ROWS))
        with common.inside(_OPEN[key]):
            return stage(spark, docs, sf_dir)

    return owned


@_owning
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


@_owning
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@_owning
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return wide_simhash.drop_near(docs)


@_owning
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Natively, so the quality weights are the operator's own."""
    return mixing.materialise(docs)


@_owning
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences, and their ids."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("mixing", mix), ("packing", pack)]
#: The classifier, shingle hashes and tokenizer are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; of the run's folders, those that it is derived from stay until the workspace it was called in ends."""
    token = _RUN.set(uuid.uuid4().hex)
    try:
        docs, before = common.table(spark, sf_dir, "documents"), None
        for name, stage in STAGES[:-1]:
            work = common.Workspace(spark)
            made = stage(spark, docs, sf_dir)
            with common.inside(work):
                docs = common.keep(made, f"stage-{name}")
            if before is not None:
                before.close()
            before = work
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _OPEN.pop((spark.sparkContext.applicationId, sf_dir, _RUN.get()), None)
        _RUN.reset(token)
