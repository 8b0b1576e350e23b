"""Ways, nodes, stops and fleets derived from the star-schema tables, the same rows on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import expr

#: All drivable classes, and two that aren't.
CLASSES = [*expr.DEFAULT_KPH, "footway", "cycleway"]
SPEEDS = [None, "60", "55 mph", "RU:urban", "none", "50;70", "130"]
ONEWAYS = [None, "yes", "-1", "no", "true"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select((k * 7 + 1000000007).alias("osm_id"), (55.0 + (k % 50).cast("double") / 1000.0).alias("lat"), (37.0 + F.floor(k.cast("double") / 50.0).cast("double") / 1000.0).alias("lon"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, highway, maxspeed, oneway, nodes): one row for each way, its nodes in order."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("refs"))
    k = F.col("way_id")
    refs = F.transform("refs", lambda r: r["l_partkey"] * 7 + 1000000007)
    return rows.select("way_id", _pick([*CLASSES, None], k % 18).alias("highway"), _pick(SPEEDS, k % 7).alias("maxspeed"), _pick(ONEWAYS, k % 5).alias("oneway"), refs.alias("nodes"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(k.alias("id"), (55.0 + ((k * 37 % 50).cast("double") + 0.3) / 1000.0).alias("lat"), (37.0 + ((k * 53 % 40).cast("double") + 0.2) / 1000.0).alias("lon"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop for each nation: the places that a matrix or tour joins."""
    k = F.col("n_nationkey").cast("long")
    return _table(spark, sf_dir, "nation").select(k.alias("id"), (55.0 + ((k * 37 % 50).cast("double") + 0.3) / 1000.0).alias("lat"), (37.0 + ((k * 53 % 4).cast("double") + 0.2) / 1000.0).alias("lon"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("vehicle_id"), (150 + 25 * (F.col("r_regionkey") % 3)).cast("long").alias("capacity"))


def vrp_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    base = k == 0
    return stops(spark, sf_dir).select("*", F.when(base, 0).otherwise(1 + k % 40).cast("int").alias("demand"), F.when(base, 0).otherwise(k % 4 * 3600).cast("int").alias("tw_start"), F.when(base, 86400).otherwise(k % 4 * 3600 + 43200).cast("int").alias("tw_end"))


def _case(values: list, by: str) -> str:
    return "CASE " + by + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


#: The same tables as SQL.
SQL = f"""
osm_nodes AS (SELECT p_partkey * 7 + 1000000007 AS osm_id, 55::DOUBLE + (p_partkey % 50)::DOUBLE / 1000::DOUBLE AS lat, 37::DOUBLE + floor(p_partkey::DOUBLE / 50::DOUBLE) / 1000::DOUBLE AS lon FROM part),
way_nodes AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey * 7 + 1000000007 AS osm_id FROM lineitem),
way_tags AS (SELECT DISTINCT l_orderkey AS way_id, {_case(CLASSES, "l_orderkey % 18")} AS highway, {_case(SPEEDS, "l_orderkey % 7")} AS maxspeed, {_case(ONEWAYS, "l_orderkey % 5")} AS oneway FROM lineitem),
stops AS (SELECT n_nationkey::BIGINT AS id, 55::DOUBLE + ((n_nationkey * 37 % 50)::DOUBLE + 0.3::DOUBLE) / 1000::DOUBLE AS lat, 37::DOUBLE + ((n_nationkey * 53 % 4)::DOUBLE + 0.2::DOUBLE) / 1000::DOUBLE AS lon FROM nation),
points AS (SELECT c_custkey AS id, 55::DOUBLE + ((c_custkey * 37 % 50)::DOUBLE + 0.3::DOUBLE) / 1000::DOUBLE AS lat, 37::DOUBLE + ((c_custkey * 53 % 40)::DOUBLE + 0.2::DOUBLE) / 1000::DOUBLE AS lon FROM customer)
"""
