"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis), in DataFrame functions only.

Every source has a target number of words: the total shared by weight, at most `most` times the source's own size, and
the excess shared anew by weight among the others (water-filling, solved by one running sum over sources sorted by the
level at which they are full). The source is then taken in complete epochs, and the rest of its target from documents
in the order of -ln(u) / quality, where u is a seeded hash of doc_id and text: a weighted sample without replacement.
The document at which the rest ends is taken in part. The quality is a column, where one is named, else a function of the mean length of words.

No source is sorted as a whole: its keys fall into buckets by value, sums per bucket find the one bucket in which the
rest ends, and only that bucket's rows are put in order.

Null text has size 0 and is taken zero times. Null sources form one source, last in order. Rows that repeat both id
and text share a key and are ordered among themselves by size alone, so which of them is taken makes no difference. Of a very long
text only the size and a digest are kept. Empty tables give no row; other columns, whatever their names, travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A weight between 0.5 and 1: highest where words have about six letters on average, as running prose has."""
    mean = (F.length(text).cast("double") + 1.0) / (size.cast("double") + 1.0)
    return F.coalesce(1.0 / (1.0 + F.least(F.abs(mean - 7.0) / 7.0, F.lit(1.0))), F.lit(0.5))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source, so windows over all of them are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    full = sizes.select("source", "source_size", weight.alias("weight"))
    full = full.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    full = full.select(
        "*",
        (share * F.sum("source_size").over(whole).cast("double")).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    full = full.withColumn("water", (F.col("total") - F.col("capped")) / F.col("open"))
    water = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(whole)["water"]
    return full.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * water), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, quality: str | None = None) -> DataFrame:
    """(row, size, source_size, target, taken): every row of docs as a struct, with the words the mix takes from it, repeats counted.

    quality names a column with each document's quality weight (a classifier's score, say); what is null or not positive counts as 0.001.
    """
    raw = common.packed_rows(docs)
    body = F.col("row")[text]
    rows = raw.withColumn("size", size_of(body))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("row")[doc_id].cast("string"), F.lit("")), F.md5(F.coalesce(body, F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    good = quality_of(body, F.col("size")) if quality is None else F.greatest(F.coalesce(F.nanvl(F.col("row")[quality].cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.001))
    rows = rows.select("row", "size", F.col("row")[source].alias("source"), (-F.log(u) / good).alias("key"), digest.alias("tie"))

    buckets = max(1, round(docs.count() ** 0.5))  # the sums of a source, and the rows of its last bucket, both grow with the root only
    rows = rows.withColumn("bucket", F.floor((1.0 - F.exp(-0.7 * F.col("key"))) * buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = common.keep(sums, "bucket-sums")
    of = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    of = of.withColumn("quota", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0))
    of = of.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket")
    until = sums.withColumn("until", F.sum("words").over(running)).join(of.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edge = until.filter(F.col("until") - F.col("words") < F.col("rest")).groupBy("source").agg(F.max(F.struct("bucket", F.col("until") - F.col("words"))).alias("edge"))
    edge = edge.select(F.col("source").alias("s"), F.col("edge.bucket").alias("edge_bucket"), F.col("edge.col2").alias("edge_from"))
    plan = of.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "edge_bucket", "edge_from")
    return _taken(rows, common.keep(plan, "source-plan"))


#: Sources up to this number are sent to every task; more are joined by a shuffle.
SMALL_PLAN = 10_000


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    if plan.count() <= SMALL_PLAN:
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    first = F.col("bucket") < F.col("edge_bucket")
    at_edge = rows.filter("bucket = edge_bucket")
    before = Window.partitionBy("source").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = at_edge.withColumn("before", F.col("edge_from") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    at_edge = at_edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
    others = rows.filter("edge_bucket is null or bucket <> edge_bucket").withColumn("more", F.when(first, F.col("size")).otherwise(0))
    columns = ["row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken")]
    return others.select(*columns).unionByName(at_edge.select(*columns))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """docs, each row repeated as often as the mix takes it; the one document of a source that is taken in part counts as whole from one half on. Documents without words stay once."""
    mixed = mix(docs, **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor((F.col("taken") / F.col("size")) + 0.5)).cast("int")
    return mixed.withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), -1) AS chars,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS tie
  FROM documents
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(tie, 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE)
            / CASE WHEN chars < 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + least(abs((chars + 1.0::DOUBLE) / (size + 1.0::DOUBLE) - 7.0::DOUBLE) / 7.0::DOUBLE, 1.0::DOUBLE)) END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size::DOUBLE AS cap, 3 * source_size::DOUBLE / weight AS level, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(3 * source_size::DOUBLE) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
  FROM s WINDOW b AS (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), w AS (SELECT arg_min((total - capped) / open, level) AS water FROM f WHERE (total - capped) / open <= level
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT water FROM w), cap)) AS target FROM f
), q AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS quota, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
)
SELECT k.doc_id, k.size, q.source_size, q.target,
       CAST(epochs * k.size + greatest(0, least(k.size, quota - epochs * source_size - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, tie, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source
"""
