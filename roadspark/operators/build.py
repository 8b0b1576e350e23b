"""From ways and nodes to a directed graph: vertices (vid, osm_id, lat, lon) and edges (src, dst, speed_mps)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.functions import expr
from roadspark.operators import storage

#: Rows that one bucket of an ordered numbering holds, on average.
BUCKET_ROWS = 1_000_000
#: Vertices up to which edges find their ends in arrays that every task has (24 bytes a vertex); beyond that they are joined.
BROADCAST_VERTICES = 2_000_000


def flat_tags(ways: DataFrame) -> DataFrame:
    """ways(way_id, tags map, nodes) with the three tags that matter as columns, so that the map isn't carried further."""
    return ways.select("way_id", *[F.col("tags")[k].alias(k) for k in ("highway", "maxspeed", "oneway")], "nodes")


def drivable_ways(ways: DataFrame) -> DataFrame:
    """Ways of a drivable class with two nodes at least, with speed_mps and direction."""
    kept = ways.filter(expr.drivable(F.col("highway")) & (F.size("nodes") >= 2))
    return kept.select("way_id", "highway", expr.way_speed(F.col("highway"), F.col("maxspeed")).alias("speed_mps"), expr.direction(F.col("oneway")).alias("direction"), "nodes")


def segments(drivable: DataFrame) -> DataFrame:
    """Consecutive nodes of each way; the pairs come from the array itself, so nothing is shuffled."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(i.alias("pos"), F.get("nodes", i - 1).alias("a"), F.get("nodes", i).alias("b")))
    return drivable.select("way_id", "speed_mps", "direction", F.explode(pairs).alias("p")).select("way_id", "p.pos", "p.a", "p.b", "speed_mps", "direction")


def directed(pairs: DataFrame) -> DataFrame:
    forth, back = F.struct(F.col("a").alias("from_osm"), F.col("b").alias("to_osm")), F.struct(F.col("b").alias("from_osm"), F.col("a").alias("to_osm"))
    ends = F.when(F.col("direction") == 1, F.array(forth)).when(F.col("direction") == -1, F.array(back)).otherwise(F.array(forth, back))
    return pairs.select("speed_mps", F.explode(ends).alias("e")).select("e.from_osm", "e.to_osm", "speed_mps")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their rank by the key, from 0: ranks within ranges of about BUCKET_ROWS rows plus the sizes of the ranges before, so no task holds all rows.

    The ranges come from a sample of the keys, so they are even however the keys are spread. Equal keys stay in one range.
    """
    inside = lambda w: F.row_number().over(w.orderBy(key))
    rows = storage.keep(rows)
    n = rows.count()
    if n <= BUCKET_ROWS:
        return rows.withColumn(name, (inside(Window.partitionBy()) - 1).cast("long"))
    ranged = storage.keep(rows.repartitionByRange(-(-n // BUCKET_ROWS), key).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = ranged.withColumn("__inside", inside(Window.partitionBy("__range"))).join(before, "__range")
    return ranked.withColumn(name, (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__range", "__inside", "__before")


def looked_up(rows: DataFrame, table: DataFrame, key: str, ends: dict[str, dict[str, str]]) -> DataFrame:
    """rows joined to table by each of ends, {column of rows: {column of table: its name}}; rows without a match at an end go.

    The key is unique in the table. Up to BROADCAST_VERTICES rows of it go to all tasks as arrays, so that many rows aren't shuffled; larger ones are joined.
    """
    columns = list(dict.fromkeys(c for names in ends.values() for c in names))
    arrays = table.__dict__.setdefault("arrays", {}) if hasattr(table, "kept_in") else {}  # a written table doesn't change, so it is fetched once
    table = table.select(key, *columns)
    if (key, *columns) not in arrays and table.limit(BROADCAST_VERTICES + 1).count() > BROADCAST_VERTICES:
        for end, names in ends.items():
            rows = rows.join(table.select(F.col(key).alias(end), *[F.col(c).alias(n) for c, n in names.items()]), end)
        return rows
    if (key, *columns) not in arrays:
        known = table.filter(F.col(key).isNotNull()).toArrow().sort_by(key)
        arrays[key, *columns] = rows.sparkSession.sparkContext.broadcast([known[c].to_numpy() for c in (key, *columns)])
    shared = arrays[key, *columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = shared.value
        for batch in batches:
            batch = batch.filter(pc.and_kleene(*[pc.is_valid(batch[e]) for e in ends]) if len(ends) > 1 else pc.is_valid(batch[next(iter(ends))]))
            at = {e: np.searchsorted(keys, batch[e].to_numpy()) for e in ends}
            there = np.ones(batch.num_rows, bool)
            for e, place in at.items():
                there &= keys[np.minimum(place, len(keys) - 1)] == batch[e].to_numpy() if len(keys) else False
            batch = batch.filter(pa.array(there))
            for e, names in ends.items():
                for c, n in names.items():
                    batch = batch.append_column(n, pa.array(values[columns.index(c)][at[e][there]]))
            yield batch
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    kind = T.StructType([*rows.schema.fields, *(T.StructField(n, table.schema[c].dataType) for names in ends.values() for c, n in names.items())])
    return rows.mapInArrow(run, kind)


def used_nodes(drivable: DataFrame) -> DataFrame:
    return drivable.select(F.explode("nodes").alias("osm_id")).distinct()


def known_nodes(nodes: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """One valid location for each node (of used, if given); where a node is repeated, the first by file order if there is a column `seq`, else the least."""
    valid = nodes.filter("lat between -90 and 90 and lon between -180 and 180 and osm_id is not null")
    if used is not None:  # most nodes of an extract are no road's, and need not be aggregated
        valid = valid.join(used, "osm_id", "left_semi")
    order = F.struct(*[c for c in ("seq",) if c in nodes.columns], "lat", "lon")
    return valid.groupBy("osm_id").agg(F.min(order).alias("first")).select("osm_id", "first.lat", "first.lon")


def missing_coordinates(used: DataFrame, nodes: DataFrame) -> DataFrame:
    return used.join(known_nodes(nodes, used), "osm_id", "left_anti")


def vertices(used: DataFrame, nodes: DataFrame) -> DataFrame:
    return numbered(known_nodes(nodes, used), "osm_id", "vid").select("vid", "osm_id", "lat", "lon")


def fastest_edges(arcs: DataFrame, vertex: DataFrame) -> DataFrame:
    """Of parallel arcs the fastest. Arcs are reduced by their own ids first, so that the joins carry each pair once.

    Those of a node meet in one task, so a file has few different ends at one side and takes less disk.
    """
    best = arcs.repartition("from_osm").groupBy("from_osm", "to_osm").agg(F.max("speed_mps").alias("speed_mps"))
    return looked_up(best, vertex, "osm_id", {"from_osm": {"vid": "src"}, "to_osm": {"vid": "dst"}}).select("src", "dst", "speed_mps")


def offsets(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, degree, end_offset): how many edges leave each vertex, and the running total with it."""
    degree = vertex.select("vid").join(edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree")), "vid", "left").na.fill(0, ["degree"])
    degree = degree.withColumn("part", F.floor(F.col("vid") / BUCKET_ROWS))
    totals = degree.groupBy("part").agg(F.sum("degree").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("degree").over(Window.partitionBy("part").orderBy("vid").rowsBetween(Window.unboundedPreceding, 0))
    return degree.withColumn("inside", inside).join(before, "part").select("vid", "degree", (F.col("before") + F.col("inside")).alias("end_offset"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "speed_mps")


def in_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("vid")).agg(F.sort_array(F.collect_list("src")).alias("sources"))


def with_costs(edges: DataFrame, vertex: DataFrame) -> DataFrame:
    """edges(src, dst, speed_mps, and others) with dist_m and time_s."""
    at = lambda prefix: {c: f"{prefix}_{c}" for c in ("lat", "lon")}
    both = looked_up(edges, vertex, "vid", {"src": at("a"), "dst": at("b")})
    both = both.withColumn("dist_m", expr.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return both.select(*edges.columns, "dist_m", expr.edge_seconds(F.col("dist_m"), F.col("speed_mps")).alias("time_s"))


def written_costs(edges: DataFrame, vertex: DataFrame) -> DataFrame:
    """with_costs(), written. The edges are written before, so that no task looks up both numbers and places, with a Python worker for each."""
    store = storage.Store(edges.sparkSession)
    kept = store.keep(edges)
    return store.keep(with_costs(kept, vertex), instead_of=kept)


def searchable(edges: DataFrame, vertex: DataFrame, for_good: bool = False) -> DataFrame:
    """with_costs() for searches. Where places are looked up in arrays, costs are not written, as they take more disk than the edges.

    They are added to what `bare`, the written edges, is read for, by the function `cost`. for_good deletes what the edges are made from, where that is known,
    and the arrays of numbers that they were looked up in, of which each executor has a file.
    """
    if vertex.limit(BROADCAST_VERTICES + 1).count() > BROADCAST_VERTICES:
        return written_costs(edges, vertex)
    kept = storage.Store(edges.sparkSession).keep(edges, instead_of=getattr(edges, "made_from", None) if for_good else None)
    if for_good and (numbers := vertex.__dict__.get("arrays", {}).pop(("osm_id", "vid"), None)):
        numbers.destroy()
    out = with_costs(kept, vertex)
    out.kept_in, out.bare, out.cost = kept.kept_in, kept, lambda rows: with_costs(rows, vertex)
    return out


def build_graph(ways: DataFrame, nodes: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of ways(way_id, highway, maxspeed, oneway, nodes) and nodes(osm_id, lat, lon)."""
    drivable = storage.keep(drivable_ways(ways))  # read for the check, the vertices and the edges
    used = used_nodes(drivable)
    vertex = storage.keep(vertices(used, nodes))
    if strict and (n := used.join(vertex, "osm_id", "left_anti").count()):
        raise ValueError(f"{n} nodes of ways have no coordinates")
    edges = fastest_edges(directed(segments(drivable)), vertex)
    edges.made_from = drivable
    return vertex, edges
