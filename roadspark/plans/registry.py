"""Registered queries over the road network, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.functions import expr
from roadspark.graph import RoadGraph
from roadspark.operators import build, overlay, paths, storage, tiles, tours
from roadspark.sources import files, fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CLASSES = ", ".join(f"'{k}'" for k in expr.DEFAULT_KPH)
DEFAULTS = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in expr.DEFAULT_KPH.items()) + f" ELSE {expr.OTHER_KPH} END"
DIGITS = "TRY_CAST(nullif(regexp_extract(maxspeed, '([0-9]+)', 1), '') AS BIGINT)"
POSTED = f"CASE WHEN maxspeed LIKE '%mph%' THEN CAST(trunc(CAST({DIGITS} AS DOUBLE) * 1.60934::DOUBLE) AS BIGINT) ELSE {DIGITS} END"
SPEED = f"CAST(CAST(CASE WHEN {POSTED} > 0 THEN {POSTED} ELSE {DEFAULTS} END AS DOUBLE) / 3.6::DOUBLE AS FLOAT)"
HAVERSINE = "2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
GRAPH = f"""{fixtures.SQL.strip()},
sizes AS (SELECT way_id, count(*) AS n FROM way_nodes GROUP BY way_id),
drivable AS (SELECT way_id, highway, {SPEED} AS speed_mps, CASE WHEN oneway IN ('yes', '1', 'true') THEN 1 WHEN oneway = '-1' THEN -1 ELSE 0 END AS direction FROM way_tags JOIN sizes USING (way_id) WHERE n >= 2 AND highway IN ({CLASSES})),
segs AS (SELECT way_id, pos::INT AS pos, a, b, speed_mps, direction FROM (SELECT way_id, pos, lag(osm_id) OVER (PARTITION BY way_id ORDER BY pos) AS a, osm_id AS b FROM way_nodes) JOIN drivable USING (way_id) WHERE a IS NOT NULL),
arcs AS (SELECT a AS from_osm, b AS to_osm, speed_mps FROM segs WHERE direction >= 0 UNION ALL SELECT b, a, speed_mps FROM segs WHERE direction <= 0),
used AS (SELECT DISTINCT osm_id FROM way_nodes JOIN drivable USING (way_id)),
vertices AS MATERIALIZED (SELECT row_number() OVER (ORDER BY osm_id) - 1 AS vid, osm_id, lat, lon FROM used JOIN osm_nodes USING (osm_id)),
edges AS MATERIALIZED (SELECT a.vid AS src, b.vid AS dst, max(speed_mps) AS speed_mps FROM arcs JOIN vertices a ON a.osm_id = from_osm JOIN vertices b ON b.osm_id = to_osm GROUP BY 1, 2),
costs AS MATERIALIZED (SELECT src, dst, speed_mps, {HAVERSINE} AS dist_m, ({HAVERSINE}) / greatest(speed_mps, 0.1::FLOAT)::DOUBLE AS time_s FROM edges JOIN vertices a ON a.vid = src JOIN vertices b ON b.vid = dst)"""
WITH = f"WITH {GRAPH} "
MERCATOR = f"{GRAPH}, pts AS (SELECT vid, lon * (pi() / 180) AS x, -ln(tan(pi() / 4 + lat * (pi() / 360))) AS y FROM vertices), box AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts)"
ROADS = f"""{MERCATOR}, pairs AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(speed_mps, (src, dst)) AS speed_mps FROM edges WHERE src <> dst GROUP BY 1, 2),
roads AS (SELECT lo, hi, speed_mps, CASE WHEN speed_mps <= 0 THEN 0 WHEN speed_mps * 3.6::FLOAT >= 90 THEN 4 WHEN speed_mps * 3.6::FLOAT >= 70 THEN 3 WHEN speed_mps * 3.6::FLOAT >= 50 THEN 2 WHEN speed_mps * 3.6::FLOAT >= 30 THEN 1 ELSE 0 END AS tier, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM pairs JOIN pts a ON a.vid = lo JOIN pts b ON b.vid = hi)"""
#: The middle of the map in Mercator coordinates, as a view.
VIEW = (0.6458, -1.1555, 0.6460, -1.1548)
CLAMP = "greatest(0, least(greatest(1, ceil((max_{0} - min_{0}) / {2})) - 1, floor(({1}::DOUBLE - min_{0}) / {2})))"
SEEN = "NOT ((x1 < {0} AND x2 < {0}) OR (x1 > {2} AND x2 > {2}) OR (y1 < {1} AND y2 < {1}) OR (y1 > {3} AND y2 > {3}))".format(*(f"{v}::DOUBLE" for v in VIEW))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return build.build_graph(fixtures.ways(spark, d), fixtures.nodes(spark, d), strict=False)


def costed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vertex, edges = graph(spark, d)
    return vertex, build.with_costs(edges, vertex)


def searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same, with the edges written once for all searches."""
    vertex, edges = graph(spark, d)
    return vertex, build.searchable(edges, vertex, for_good=True)


@query(f"WITH {fixtures.SQL} SELECT way_id, highway, maxspeed, {SPEED} AS speed_mps FROM way_tags")
def way_speed(spark, d):
    return fixtures.ways(spark, d).select("way_id", "highway", "maxspeed", expr.way_speed(F.col("highway"), F.col("maxspeed")).alias("speed_mps"))


@query(f"WITH {fixtures.SQL} SELECT way_id, CASE WHEN oneway IN ('yes', '1', 'true') THEN 1 WHEN oneway = '-1' THEN -1 ELSE 0 END AS direction FROM way_tags")
def way_direction(spark, d):
    return fixtures.ways(spark, d).select("way_id", expr.direction(F.col("oneway")).alias("direction"))


@query(WITH + "SELECT way_id, highway, speed_mps, direction FROM drivable")
def drivable_ways(spark, d):
    return build.drivable_ways(fixtures.ways(spark, d)).drop("nodes")


@query(WITH + "SELECT * FROM segs")
def segments(spark, d):
    return build.segments(build.drivable_ways(fixtures.ways(spark, d)))


@query(WITH + "SELECT * FROM arcs")
def directed_edges(spark, d):
    return build.directed(segments(spark, d))


@query(WITH + "SELECT * FROM vertices")
def vertices_dense(spark, d):
    return graph(spark, d)[0]


@query(WITH + "SELECT osm_id FROM (SELECT DISTINCT osm_id FROM way_nodes) WHERE osm_id NOT IN (SELECT osm_id FROM osm_nodes WHERE osm_id % 2 = 1)")
def missing_coords(spark, d):
    odd = fixtures.nodes(spark, d).filter("osm_id % 2 = 1")
    return build.missing_coordinates(build.used_nodes(fixtures.ways(spark, d)), odd)


@query(WITH + "SELECT * FROM edges")
def edges_fastest(spark, d):
    return graph(spark, d)[1]


@query(WITH + ", deg AS (SELECT vid, count(src) AS degree FROM vertices LEFT JOIN edges ON src = vid GROUP BY vid) SELECT vid, degree, CAST(sum(degree) OVER (ORDER BY vid) AS BIGINT) AS end_offset FROM deg")
def degree_offsets(spark, d):
    return build.offsets(*graph(spark, d))


@query(WITH + "SELECT dst AS src, src AS dst, speed_mps FROM edges")
def reverse_edges(spark, d):
    return build.reverse(graph(spark, d)[1])


@query(WITH + "SELECT dst AS vid, list_sort(list(src)) AS sources FROM edges GROUP BY dst")
def in_lists(spark, d):
    return build.in_lists(graph(spark, d)[1])


@query(WITH + "SELECT src, dst, speed_mps, round(dist_m, 3) AS dist_m, round(time_s, 3) AS time_s FROM costs")
def edge_costs(spark, d):
    return costed(spark, d)[1].withColumns({c: F.round(c, 3) for c in ("dist_m", "time_s")})


def _sssp_sql(cost: str, sources: str = "SELECT 0::BIGINT AS src", last: str = "SELECT src, v, round(g, 3) AS cost FROM d") -> str:
    return f"""WITH RECURSIVE {GRAPH}, starts AS ({sources}),
d(src, v, g) USING KEY (src, v) AS (SELECT src, src, 0::DOUBLE FROM starts UNION SELECT d.src, e.dst, min(d.g + e.{cost}) FROM d JOIN costs e ON e.src = d.v LEFT JOIN recurring.d r ON r.v = e.dst AND r.src = d.src
WHERE r.g IS NULL OR d.g + e.{cost} < r.g GROUP BY d.src, e.dst) {last}"""


def _sssp(spark, d, metric, method="auto"):
    vertex, cost = searched(spark, d)
    start = spark.range(1).select(F.col("id").alias("src"))
    return paths.from_sources(cost, start, metric, method).select("src", "v", F.round("cost", 3).alias("cost"))


@query(_sssp_sql("dist_m"))
def sssp_distance(spark, d):
    return _sssp(spark, d, "distance")


@query(_sssp_sql("time_s"))
def sssp_time(spark, d):
    return _sssp(spark, d, "time")


@query(_sssp_sql("time_s"))
def sssp_fixpoint(spark, d):
    return _sssp(spark, d, "time", "parts")


ROUTED = "SELECT s_suppkey AS qid, CASE WHEN s_suppkey % 11 = 10 THEN -1 ELSE (s_suppkey * 13) % 97 END AS src, (s_suppkey * 31) % 89 AS dst FROM supplier"


def _queries(spark, d):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("qid"), F.when(k % 11 == 10, -1).otherwise(k * 13 % 97).cast("long").alias("src"), (k * 31 % 89).alias("dst"))


@query(_sssp_sql("dist_m", f"SELECT DISTINCT q.src FROM ({ROUTED}) q JOIN vertices ON vid = q.src", f"SELECT q.qid, q.src, q.dst, round(g, 3) AS dist_m FROM ({ROUTED}) q LEFT JOIN d ON d.src = q.src AND d.v = q.dst"))
def route_batch(spark, d):
    vertex, cost = searched(spark, d)
    return paths.routes(cost, vertex, _queries(spark, d), "distance", full=False).select("qid", "src", "dst", F.round("dist_m", 3).alias("dist_m"))


@query(_sssp_sql("time_s", f"SELECT DISTINCT q.src FROM ({ROUTED}) q JOIN vertices ON vid = q.src", f"SELECT q.qid, round(g, 3) AS time_s FROM ({ROUTED}) q JOIN d ON d.src = q.src AND d.v = q.dst"))
def route_totals(spark, d):
    """Paths by time, their totals added up from the edges again."""
    vertex, cost = searched(spark, d)
    found = paths.routes(cost, vertex, _queries(spark, d), "time")
    return paths.path_totals(found, cost).select("qid", F.round("time_s", 3).alias("time_s"))


@query(WITH + ", e AS (SELECT src, dst FROM edges WHERE src <> dst), h AS (SELECT 0 AS v, 0 AS hops UNION ALL SELECT dst, 1 FROM e WHERE src = 0 UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 0) SELECT 0::BIGINT AS src, v, min(hops)::INT AS hops FROM h GROUP BY v")
def k_hop_neighbours(spark, d):
    return paths.k_hops(graph(spark, d)[1], spark.range(1).select(F.col("id").alias("src")), 2)


NEAREST = "(SELECT p.id, arg_min(vid, ((v.lon - p.lon) * (v.lon - p.lon) + (v.lat - p.lat) * (v.lat - p.lat), vid)) AS vid FROM {} p, vertices v GROUP BY p.id)"


@query(WITH + "SELECT * FROM " + NEAREST.format("points"))
def nearest_vertex(spark, d):
    return paths.nearest(fixtures.points(spark, d), graph(spark, d)[0]).select("id", "vid")


def _stops(spark, d):
    vertex, cost = searched(spark, d)
    return cost, paths.nearest(fixtures.stops(spark, d), vertex).select(F.col("id").alias("i"), "vid")


def _matrix_sql(cost: str, name: str) -> str:
    milli = "CASE WHEN a.id = b.id THEN 0 ELSE CAST(round(g * 1000000) AS BIGINT) // 1000 END"
    near = NEAREST.format("stops")
    return _sssp_sql(cost, f"SELECT DISTINCT vid AS src FROM {near}", f"SELECT a.id AS i, b.id AS j, {milli} AS {name} FROM {near} a, {near} b, d WHERE d.src = a.vid AND d.v = b.vid")


@query(_matrix_sql("time_s", "time_ms"))
def od_matrix(spark, d):
    """Between a stop for each nation, by least time."""
    cost, stops = _stops(spark, d)
    return paths.matrix(cost, stops).filter("time_ms is not null").select("i", "j", "time_ms")


@query(_matrix_sql("dist_m", "dist_mm"))
def od_matrix_distance(spark, d):
    """The same by least distance."""
    cost, stops = _stops(spark, d)
    return paths.matrix(cost, stops, "distance").filter("dist_mm is not null").select("i", "j", "dist_mm")


@query("SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, TRUE AS same_time, TRUE AS same_distance FROM nation a, nation b")
def od_matrix_totals(spark, d):
    """Whether both totals of each cell are those of the route that is found for it alone (to a thousandth)."""
    vertex, cost = searched(spark, d)
    stops = storage.keep(paths.nearest(fixtures.stops(spark, d), vertex).select(F.col("id").alias("i"), "vid"))
    cells = storage.keep(paths.matrix(cost, stops))
    at = lambda end, name: stops.select(F.col("i").alias(end), F.col("vid").alias(name))
    asked = cells.select("i", "j").join(at("i", "src"), "i").join(at("j", "dst"), "j").select((F.col("i") * 1000 + F.col("j")).alias("qid"), "src", "dst")
    found = paths.routes(cost, vertex, asked, "time", full=False)
    both = cells.withColumn("qid", F.col("i") * 1000 + F.col("j")).join(found, "qid")
    same = lambda cell, total: ((F.col(cell).isNull() & F.col(total).isNull()) | (F.abs(F.col(cell) - F.col(total) * 1000) <= 1.001))
    return both.select("i", "j", same("time_ms", "time_s").alias("same_time"), same("dist_mm", "dist_m").alias("same_distance"))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("problem", F.lit(0).cast("long"))


@query("SELECT count(*) AS stops, count(DISTINCT n_nationkey) AS distinct_stops, min(n_nationkey)::BIGINT AS first_stop, TRUE AS total_is_sum, TRUE AS not_above_order_of_ids FROM nation")
def tsp_heuristic(spark, d):
    """What must hold of the tour of all stops: each once, from the first, its total that of its legs, and not above the tour in the order of ids."""
    cost, stops = _stops(spark, d)
    cells = storage.keep(_one(paths.matrix(cost, stops)))
    tour = storage.keep(tours.tours(cells))
    legs = tours.tour_totals(tour, cells).select(F.col("time_ms").alias("legs"))
    n = F.lit(cells.agg(F.max("i")).first()[0] + 1)
    plain = cells.filter(F.col("j") == F.pmod(F.col("i") + 1, n)).agg(F.sum("time_ms").alias("plain"))
    seen = tour.agg(F.count("*").alias("stops"), F.count_distinct("stop").alias("distinct_stops"), F.min_by("stop", "pos").alias("first_stop"), F.max("total").alias("total"))
    row = seen.join(legs, F.lit(True)).join(plain, F.lit(True))  # a row each
    return row.select("stops", "distinct_stops", "first_stop", (F.col("total") == F.col("legs")).alias("total_is_sum"), (F.col("total") <= F.col("plain")).alias("not_above_order_of_ids"))


FIVE = "SELECT r_regionkey AS i, r_regionkey * 17 % 7 AS x, r_regionkey * 11 % 5 AS y FROM region"


@query(f"""WITH p AS ({FIVE}), c AS (SELECT a.i, b.i AS j, CAST(1000 * (abs(a.x - b.x) + abs(a.y - b.y)) AS BIGINT) AS c FROM p a, p b)
SELECT CAST(min(c1.c + c2.c + c3.c + c4.c + c5.c) AS BIGINT) AS total FROM c c1 JOIN c c2 ON c2.i = c1.j JOIN c c3 ON c3.i = c2.j JOIN c c4 ON c4.i = c3.j JOIN c c5 ON c5.i = c4.j
WHERE c1.i = 0 AND c5.j = 0 AND len(list_distinct([c1.i, c2.i, c3.i, c4.i, c5.i])) = 5""")
def tsp_exact(spark, d):
    """A tour of five places, one for each region, by city blocks."""
    k = F.col("r_regionkey").cast("long")
    p = spark.read.parquet(f"{d}/region.parquet").select(k.alias("i"), (k * 17 % 7).alias("x"), (k * 11 % 5).alias("y"))
    q = p.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    block = (1000 * (F.abs(F.col("x") - F.col("xj")) + F.abs(F.col("y") - F.col("yj")))).cast("long")
    cells = p.join(q, F.lit(True)).select(F.lit(0).cast("long").alias("problem"), "i", "j", block.alias("time_ms"), block.alias("dist_mm"))
    return tours.tours(cells).select("total").distinct()


def _plan(spark, d):
    """The plan for the orders of all nations, with what it was made from. The graph goes once the matrix is written."""
    store = storage.Store(spark)
    with storage.passing():
        cost, stops = _stops(spark, d)
        cells = store.keep(_one(paths.matrix(cost, stops)))
    orders = _one(fixtures.vrp_orders(spark, d).withColumnRenamed("id", "i"))
    fleet = _one(fixtures.fleet(spark, d))
    return storage.keep(tours.plans(cells, orders, fleet)), cells, orders, fleet


ORDERS = "SELECT n_nationkey::BIGINT AS stop, (1 + n_nationkey % 40)::INT AS demand FROM nation WHERE n_nationkey > 0"


@query(f"SELECT stop, demand, 1::BIGINT AS served FROM ({ORDERS})")
def vrp_plan(spark, d):
    """How often the plan serves each order."""
    plan, _, orders, _ = _plan(spark, d)
    served = plan.filter("stop <> 0").groupBy("stop").agg(F.count("*").alias("served"))
    return orders.filter("i <> 0").select(F.col("i").alias("stop"), "demand").join(served, "stop", "left")


@query(f"SELECT sum(demand)::BIGINT AS load, TRUE AS fits, TRUE AS load_is_sum FROM ({ORDERS})")
def vrp_load(spark, d):
    """The load of all vehicles of the plan together, whether each fits, and whether each is the sum of its orders."""
    plan, _, orders, fleet = _plan(spark, d)
    summed = plan.join(orders.select(F.col("i").alias("stop"), "demand"), "stop").groupBy("vehicle_id").agg(F.sum("demand").alias("load"), F.max_by("load", "pos").alias("said"))
    each = summed.join(fleet, "vehicle_id")
    return each.agg(F.sum("load").alias("load"), F.every(F.col("load") <= F.col("capacity")).alias("fits"), F.every(F.col("load") == F.col("said")).alias("load_is_sum"))


@query(f"SELECT stop, TRUE AS in_window, TRUE AS follows FROM ({ORDERS})")
def vrp_schedule_check(spark, d):
    """Whether each order is reached in its window, and at the time that follows from the stop before."""
    plan, cells, orders, _ = _plan(spark, d)
    legs = tours.plan_legs(plan).join(cells.select("i", "j", "time_ms"), ["i", "j"])
    windows = orders.select(F.col("i").alias("j"), "tw_start", "tw_end")
    before = plan.select("vehicle_id", (F.col("pos") + 1).alias("pos"), F.col("arrive_s").alias("left_s"))
    rows = legs.join(plan.select("vehicle_id", "pos", "arrive_s"), ["vehicle_id", "pos"]).join(before, ["vehicle_id", "pos"], "left").join(windows, "j").filter("j <> 0")
    due = F.greatest(F.coalesce("left_s", F.lit(0.0)) + F.col("time_ms") / 1000, F.col("tw_start").cast("double"))
    return rows.select(F.col("j").alias("stop"), F.col("arrive_s").between(F.col("tw_start"), F.col("tw_end")).alias("in_window"), (F.abs(F.col("arrive_s") - due) < 1e-6).alias("follows"))


@query("""WITH o AS (SELECT n_nationkey::BIGINT AS problem, (1 + n_nationkey % 40)::INT AS demand, n_nationkey % 4 * 3600 AS tw_start, 100 + n_nationkey * 37 AS there, 200 + n_nationkey * 11 AS back FROM nation)
SELECT problem, problem AS vehicle_id, 0 AS pos, 1::BIGINT AS stop, greatest(there, tw_start)::DOUBLE AS arrive_s, demand::BIGINT AS load FROM o UNION ALL SELECT problem, problem, 1, 0, (greatest(there, tw_start) + back)::DOUBLE, demand FROM o""")
def vrp_single(spark, d):
    """A problem for each nation: one order, and a vehicle that just holds it."""
    k = F.col("n_nationkey").cast("long")
    base = spark.read.parquet(f"{d}/nation.parquet").select(k.alias("problem"), (1 + k % 40).cast("int").alias("demand"), (k % 4 * 3600).cast("int").alias("tw_start"), ((100 + k * 37) * 1000).alias("there"), ((200 + k * 11) * 1000).alias("back"))
    zero = F.lit(0).cast("long")
    cell = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.alias("time_ms"), v.alias("dist_mm"))
    cells = base.select("problem", F.inline(F.array(cell(0, 0, zero), cell(1, 1, zero), cell(0, 1, F.col("there")), cell(1, 0, F.col("back")))))
    need = lambda i, n, b, e: F.struct(F.lit(i).cast("long").alias("i"), n.cast("int").alias("demand"), b.cast("int").alias("tw_start"), F.lit(e).alias("tw_end"))
    needs = base.select("problem", F.inline(F.array(need(0, zero, zero, 10**6), need(1, F.col("demand"), F.col("tw_start"), 10**6))))
    return tours.plans(cells, needs, base.select("problem", F.col("problem").alias("vehicle_id"), F.col("demand").cast("long").alias("capacity")))


@query(f"WITH {MERCATOR} SELECT round(min_x, 9) AS min_x, round(max_x, 9) AS max_x, round(min_y, 9) AS min_y, round(max_y, 9) AS max_y FROM box")
def mercator_bounds(spark, d):
    return tiles.bounds(tiles.projected(graph(spark, d)[0])).select(*[F.round(c, 9).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query(f"WITH {MERCATOR}, c AS (SELECT *, greatest(greatest(max_x - min_x, max_y - min_y) / 350, 2e-5::DOUBLE) AS cell FROM box) SELECT vid, CAST(greatest(0, least(ceil((max_x - min_x) / cell), floor((x - min_x) / cell))) AS INT) AS cell_x, CAST(greatest(0, least(ceil((max_y - min_y) / cell), floor((y - min_y) / cell))) AS INT) AS cell_y FROM pts, c")
def vertex_grid(spark, d):
    return tiles.grid(tiles.projected(graph(spark, d)[0]))


def _roads(spark, d):
    vertex, edges = graph(spark, d)
    points = tiles.projected(vertex)
    return tiles.roads(edges, points), points


@query(f"WITH {ROADS} SELECT lo, hi, speed_mps FROM pairs")
def roads_undirected(spark, d):
    return tiles.undirected(graph(spark, d)[1])


@query(f"WITH {ROADS}, c AS (SELECT tier, count(*) AS roads FROM roads GROUP BY tier) SELECT tier, roads, CAST(sum(roads) OVER (ORDER BY tier DESC) AS BIGINT) AS from_tier FROM c")
def road_tiers(spark, d):
    return tiles.tier_counts(_roads(spark, d)[0])


@query(f"""WITH {ROADS}, levels AS (SELECT * FROM (VALUES (0, 16, 4), (1, 32, 3), (2, 64, 2), (3, 128, 1), (4, 256, 0)) t(level, tiles, least_tier)),
s AS (SELECT roads.*, level, greatest(greatest(max_x - min_x, max_y - min_y) / tiles, 1e-12::DOUBLE) AS size, min_x, max_x, min_y, max_y FROM roads, box, levels WHERE tier >= least_tier),
i AS (SELECT level, lo, hi, tier, CAST(greatest(0, least(greatest(1, ceil((max_x - min_x) / size)) - 1, floor((least(x1, x2) - min_x) / size))) AS INT) AS xa, CAST(greatest(0, least(greatest(1, ceil((max_x - min_x) / size)) - 1, floor((greatest(x1, x2) - min_x) / size))) AS INT) AS xb,
CAST(greatest(0, least(greatest(1, ceil((max_y - min_y) / size)) - 1, floor((least(y1, y2) - min_y) / size))) AS INT) AS ya, CAST(greatest(0, least(greatest(1, ceil((max_y - min_y) / size)) - 1, floor((greatest(y1, y2) - min_y) / size))) AS INT) AS yb FROM s)
SELECT level, tier, count(*) AS roads, CAST(sum((xb - xa + 1) * (yb - ya + 1)) AS BIGINT) AS entries FROM i GROUP BY level, tier""")
def tile_index(spark, d):
    """Roads and index entries of each level and tier; runs are counted by their length."""
    road, points = _roads(spark, d)
    each = tiles.tile_runs(road, points).groupBy("level", "tier", "lo", "hi").agg(F.sum(F.col("x_to") - F.col("x_from") + 1).alias("n"))
    return each.groupBy("level", "tier").agg(F.count("*").alias("roads"), F.sum("n").alias("entries"))


@query(f"WITH {ROADS} SELECT tier, lo, hi FROM roads WHERE {SEEN} AND tier >= 2")
def roads_in_view(spark, d):
    return tiles.roads_in_view(_roads(spark, d)[0], VIEW, 20_000.0).select("tier", "lo", "hi")


def _in_cells(out: str) -> str:
    """SQL over directed edges in view whose first vertex lies in the cells that the view covers."""
    cell = lambda f, a: f"greatest(0, least(ceil((max_{a} - min_{a}) / cell), floor(({f} - min_{a}) / cell)))"
    inside = " AND ".join(f"{cell('a.' + a, a)} BETWEEN {cell(f'{VIEW[i]}::DOUBLE', a)} AND {cell(f'{VIEW[i + 2]}::DOUBLE', a)}" for i, a in enumerate("xy"))
    return f"""WITH {MERCATOR}, c AS (SELECT *, greatest(greatest(max_x - min_x, max_y - min_y) / 350, 2e-5::DOUBLE) AS cell FROM box),
e AS (SELECT speed_mps, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges JOIN pts a ON a.vid = src JOIN pts b ON b.vid = dst, c WHERE {inside}),
n AS (SELECT count(*) AS from_0, {", ".join(f"count(*) FILTER (speed_mps * 3.6::FLOAT >= {k}) AS from_{k}" for k in (30, 50, 70, 90))} FROM e WHERE {SEEN}) {out}"""


@query(_in_cells("SELECT * FROM n"))
def visible_counts(spark, d):
    vertex, edges = graph(spark, d)
    return tiles.visible_counts(edges, tiles.projected(vertex), VIEW)


@query(_in_cells(", p AS (SELECT *, CASE " + " ".join(f"WHEN from_{k} <= 500000 THEN {k}" for k in (0, 30, 50, 70)) + " ELSE 90 END AS min_kph FROM n) SELECT CAST(min_kph AS INT) AS min_kph, CASE min_kph " + " ".join(f"WHEN {k} THEN from_{k}" for k in (0, 30, 50, 70, 90)) + " END AS roads FROM p"))
def adaptive_speed(spark, d):
    """The least speed that leaves few enough edges in view, and how many it leaves."""
    counts = storage.keep(visible_counts(spark, d))
    return counts.join(tiles.adaptive_min_kph(counts), F.lit(True)).select("min_kph", tiles.count_from(F.col("min_kph")).alias("roads"))  # a row each


TILES = ", ".join(f"CAST({CLAMP.format(a, VIEW[i], 'size')} AS INT) AS {a}_{n}" for i, (a, n) in enumerate((a, n) for n in ("from", "to") for a in "xy"))


@query(f"WITH {MERCATOR}, levels AS (SELECT * FROM (VALUES (0, 16), (1, 32), (2, 64), (3, 128), (4, 256)) t(level, tiles)), s AS (SELECT *, greatest(greatest(max_x - min_x, max_y - min_y) / tiles, 1e-12::DOUBLE) AS size FROM box, levels) SELECT level, {TILES} FROM s")
def tile_ranges(spark, d):
    """The tiles of each level that the view covers."""
    points = tiles.projected(graph(spark, d)[0])
    out = [tiles.tile_range(points, VIEW, level).select(F.lit(level).alias("level"), "*") for level, _, _ in tiles.LEVELS]
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {ROADS} SELECT tier, lo, hi FROM roads WHERE {SEEN} AND tier >= 1")
def roads_by_tiles(spark, d):
    """Roads of the view at a zoom, through the tile index."""
    road, points = _roads(spark, d)
    road = storage.keep(road)
    return tiles.draw_roads(tiles.tile_runs(road, points), road, points, VIEW, 50_000.0).select("tier", "lo", "hi")


CELLS = f"""WITH {ROADS}, g AS (SELECT *, greatest(greatest(max_x - min_x, max_y - min_y) / 350, 2e-5::DOUBLE) AS cell FROM box),
cells AS (SELECT lo, hi, tier, """ + ", ".join(f"greatest(0, least(ceil((max_{a} - min_{a}) / cell), floor(({f}({a}1, {a}2) - min_{a}) / cell))) AS {a}_{n}" for a in "xy" for n, f in (("from", "least"), ("to", "greatest"))) + " FROM roads, g)"
COVERED = ", ".join(f"{CLAMP.format(a, VIEW[i], 'cell')} AS {a}{n}" for i, (a, n) in enumerate((a, n) for n in (1, 2) for a in "xy"))


@query(f"{CELLS} SELECT tier, count(*) AS roads, CAST(sum((x_to - x_from + 1) * (y_to - y_from + 1)) AS BIGINT) AS entries FROM cells GROUP BY tier")
def cell_index(spark, d):
    """Roads and index entries of each tier over the vertex grid."""
    return tiles.cell_index(*_roads(spark, d)).groupBy("tier", "lo", "hi").agg(F.count("*").alias("n")).groupBy("tier").agg(F.count("*").alias("roads"), F.sum("n").alias("entries"))


@query(f"""{CELLS}, v AS (SELECT {COVERED} FROM g), n AS (SELECT tier, (least(x_to, x2) - greatest(x_from, x1) + 1) * (least(y_to, y2) - greatest(y_from, y1) + 1) AS k FROM cells, v WHERE x_to >= x1 AND x_from <= x2 AND y_to >= y1 AND y_from <= y2),
t AS (SELECT t.tier, CAST(coalesce(sum(k), 0) AS BIGINT) AS candidates FROM range(5) t(tier) LEFT JOIN n ON n.tier >= t.tier GROUP BY t.tier)
SELECT CAST(tier AS INT) AS tier, candidates FROM t WHERE tier >= 2 AND (candidates <= 500000 OR tier = 4) ORDER BY tier LIMIT 1""")
def view_tier(spark, d):
    """The tier that keeps the middle of the map light enough, at a zoom that begins with tier 2."""
    road, points = _roads(spark, d)
    b = tiles.bounds(points).first()
    size = max(max(b.max_x - b.min_x, b.max_y - b.min_y) / tiles.GRID_CELLS, tiles.LEAST_CELL)
    return tiles.view_tier(tiles.cell_index(road, points), tiles.range_of_view(tiles.bounds(points), VIEW, size), 20_000.0)


@query(f"WITH {ROADS} SELECT tier, lo, hi FROM roads WHERE {SEEN} AND speed_mps * 3.6::FLOAT >= 50 AND pow((x1 - x2) * 200000, 2) + pow((y1 - y2) * 200000, 2) >= 400")
def drawn_roads(spark, d):
    """Roads in view from 50 km/h and from 20 pixels on."""
    return tiles.drawn_roads(_roads(spark, d)[0], VIEW, 200_000.0, 50, 20).select("tier", "lo", "hi")


@query(f"WITH {MERCATOR} SELECT " + ", ".join(f"CAST({CLAMP.format(a, VIEW[i], '(512 / 2000000::DOUBLE)')} AS INT) AS {a}_{n}" for i, (a, n) in enumerate((a, n) for n in ("from", "to") for a in "xy")) + f" FROM box WHERE max_x > min_x AND max_y > min_y AND max_x >= {VIEW[0]} AND min_x <= {VIEW[2]} AND max_y >= {VIEW[1]} AND min_y <= {VIEW[3]}")
def raster_tiles(spark, d):
    return tiles.raster_range(tiles.bounds(tiles.projected(graph(spark, d)[0])), VIEW, 2_000_000.0)


def _drawn(spark, d):
    """Ways as routes over the map: the way's nodes are its path."""
    return fixtures.ways(spark, d).select(F.col("way_id").alias("route"), F.col("nodes").alias("path"))


DRAWN = f"WITH {fixtures.SQL}, hops AS (SELECT way_id AS route, lag(osm_id) OVER (PARTITION BY way_id ORDER BY pos) AS u, osm_id AS v FROM way_nodes), e AS (SELECT DISTINCT route, least(u, v) AS lo, greatest(u, v) AS hi FROM hops WHERE u <> v)"


@query(f"{DRAWN} SELECT lo, hi, list_sort(list(route)) AS routes FROM e GROUP BY lo, hi")
def shared_edges(spark, d):
    return overlay.shared_edges(_drawn(spark, d))


@query(f"{DRAWN} SELECT route, lo, hi, round(4.4::DOUBLE + (count(*) OVER w - row_number() OVER (PARTITION BY lo, hi ORDER BY route)) * 5.8::DOUBLE, 6) AS band, round(4.4::DOUBLE + (count(*) OVER w - 1) * 5.8::DOUBLE + 2.8::DOUBLE, 6) AS casing FROM e WINDOW w AS (PARTITION BY lo, hi)")
def band_widths(spark, d):
    return overlay.bands(_drawn(spark, d)).withColumns({c: F.round(c, 6) for c in ("band", "casing")})


@query(f"WITH {fixtures.SQL}, r AS (SELECT way_id AS route, count(*) AS n FROM way_nodes GROUP BY way_id ORDER BY way_id LIMIT 12) SELECT route, format('Route {{}}: {{}} nodes | {{:.1f}} m | {{:02d}}:{{:02d}}:{{:02d}}', route + 1, n, n * 100::DOUBLE, n * 1111 // 3600, n * 1111 % 3600 // 60, n * 1111 % 60) AS label FROM r")
def route_legend(spark, d):
    """The first twelve ways, each node counting for 100 m and 1,111 s."""
    rows = _drawn(spark, d).select("route", F.size("path").alias("n_nodes"))
    return overlay.legend(rows.withColumn("dist_m", F.col("n_nodes") * 100.0).withColumn("time_s", F.col("n_nodes") * 1111.0))


@query("SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr((65 + p_partkey)::INT) WHEN p_partkey < 702 THEN chr((65 + p_partkey // 26 - 1)::INT) || chr((65 + p_partkey % 26)::INT) ELSE chr((65 + (p_partkey - 702) // 676 )::INT) || chr((65 + (p_partkey - 702) // 26 % 26)::INT) || chr((65 + p_partkey % 26)::INT) END AS label FROM part")
def marker_labels(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", expr.marker_label(F.col("p_partkey")).alias("label"))


PLACED = "SELECT osm_id AS vid, lon * (pi() / 180) AS x, -ln(tan(pi() / 4 + lat * (pi() / 360))) AS y FROM osm_nodes"


def _placed(spark, d):
    return tiles.projected(fixtures.nodes(spark, d).withColumnRenamed("osm_id", "vid"))


@query(f"{DRAWN}, p AS ({PLACED}), r AS (SELECT route, lo, hi, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e JOIN p a ON a.vid = lo JOIN p b ON b.vid = hi) SELECT route, lo, hi FROM r WHERE {SEEN}")
def visible_segments(spark, d):
    return overlay.visible_segments(_drawn(spark, d), _placed(spark, d), VIEW)


@query(f"WITH {fixtures.SQL}, p AS ({PLACED}) SELECT round(x, 9) AS x, round(y, 9) AS y, 180000::DOUBLE AS zoom FROM way_nodes w JOIN p ON p.vid = w.osm_id ORDER BY way_id, pos LIMIT 1")
def initial_view(spark, d):
    return overlay.initial_view(_drawn(spark, d), _placed(spark, d)).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "zoom")


@query(f"WITH {fixtures.SQL} SELECT format('... and {{}} more routes', count(DISTINCT way_id) - 12) AS label FROM way_nodes")
def legend_rest(spark, d):
    return overlay.legend_rest(_drawn(spark, d))


def _letters(n: str) -> str:
    return f"CASE WHEN {n} < 26 THEN chr((65 + {n})::INT) WHEN {n} < 702 THEN chr((64 + {n} // 26)::INT) || chr((65 + {n} % 26)::INT) ELSE chr((65 + ({n} - 702) // 676)::INT) || chr((65 + ({n} - 702) // 26 % 26)::INT) || chr((65 + ({n} - 702) % 26)::INT) END"


@query(f"WITH w AS (SELECT s_suppkey % 3 AS plan, s_suppkey AS seq, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier) SELECT plan, seq, CAST(n AS INT) AS number, {_letters('(n - 1)')} AS letter FROM w")
def waypoint_markers(spark, d):
    """Three plans, a waypoint for each supplier."""
    rows = fixtures._table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("plan"), F.col("s_suppkey").alias("seq"))
    return overlay.numbered_waypoints(rows)


@query(f"{DRAWN}, c AS (SELECT lo, hi, 4.4::DOUBLE + (count(*) - 1) * 5.8::DOUBLE + 2.8::DOUBLE AS casing FROM e GROUP BY lo, hi), t AS (SELECT lo, hi, casing, row_number() OVER (ORDER BY casing DESC, lo, hi) AS place FROM c) SELECT place::INT AS place, lo, hi, round(casing, 6) AS casing FROM t WHERE place <= 50")
def draw_order(spark, d):
    """The fifty casings that are drawn first."""
    casings, _ = overlay.draw_order(_drawn(spark, d))
    first = casings.limit(50)
    return first.select(F.row_number().over(Window.orderBy(F.desc("casing"), "lo", "hi")).alias("place"), "lo", "hi", F.round("casing", 6).alias("casing"))


@query(f"WITH {fixtures.SQL}, p AS ({PLACED}), w AS (SELECT id AS waypoint, lon * (pi() / 180) AS x, -ln(tan(pi() / 4 + lat * (pi() / 360))) AS y FROM points), m AS (SELECT waypoint, arg_min(vid, ((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y), vid)) AS vid, min((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) AS d2 FROM w, p GROUP BY waypoint) SELECT waypoint, vid FROM m WHERE d2 < 1e-8::DOUBLE")
def waypoint_leaders(spark, d):
    """The node nearest to each customer on the map, within reach."""
    way = tiles.projected(fixtures.points(spark, d).withColumnRenamed("id", "vid")).withColumnRenamed("vid", "waypoint")
    return overlay.leaders(way, _placed(spark, d))


ENDS = "SELECT s_suppkey % 7 AS plan, s_suppkey AS seq, (s_suppkey * 37 % 50)::DOUBLE * 0.00001::DOUBLE AS x, (s_suppkey * 53 % 40)::DOUBLE * 0.00001::DOUBLE AS y, s_suppkey % 5 = 0 AS depot, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS pos FROM supplier"
HIT = "list_position(list_transform(s.places, lambda p: (p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y) < 5e-10::DOUBLE), true)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({ENDS}),
s(plan, pos, seq, depot, places, cluster) AS (SELECT plan, pos, seq, depot, [{{'x': x, 'y': y}}], 0::BIGINT FROM e WHERE pos = 1
UNION ALL SELECT e.plan, e.pos, e.seq, e.depot, CASE WHEN coalesce({HIT}, 0) > 0 THEN s.places ELSE list_append(s.places, {{'x': e.x, 'y': e.y}}) END, CASE WHEN coalesce({HIT}, 0) > 0 THEN {HIT} - 1 ELSE len(s.places) END FROM s JOIN e ON e.plan = s.plan AND e.pos = s.pos + 1)
SELECT plan, seq, CAST(cluster AS INT) AS cluster, bool_or(depot) OVER (PARTITION BY plan, cluster) AS cluster_depot FROM s""")
def endpoint_clusters(spark, d):
    """Seven plans, an end for each supplier."""
    k = F.col("s_suppkey")
    ends = fixtures._table(spark, d, "supplier").select((k % 7).alias("plan"), k.alias("seq"), ((k * 37 % 50).cast("double") * 0.00001).alias("x"), ((k * 53 % 40).cast("double") * 0.00001).alias("y"), (k % 5 == 0).alias("depot"))
    return overlay.clusters(ends).select("plan", "seq", "cluster", "cluster_depot")


@query(f"WITH {fixtures.SQL}, p AS ({PLACED}), b AS (SELECT way_id AS route, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM way_nodes w JOIN p ON p.vid = w.osm_id GROUP BY way_id) SELECT route, " + ", ".join(f"round({a}{n} {s} greatest(({a}2 - {a}1) * 0.12::DOUBLE, 0.0005::DOUBLE), 9) AS {m}_{a}" for a in "xy" for n, s, m in ((1, "-", "min"), (2, "+", "max"))) + " FROM b")
def route_bounds(spark, d):
    return overlay.bounds(_drawn(spark, d), _placed(spark, d)).select("route", *[F.round(f"{n}_{a}", 9).alias(f"{n}_{a}") for a in "xy" for n in ("min", "max")])


@query(f"""{DRAWN}, p AS ({PLACED}), s AS (SELECT route, lo, hi, a.x * 2000000 AS x1, a.y * 2000000 AS y1, (b.x - a.x) * 2000000 AS dx, (b.y - a.y) * 2000000 AS dy FROM e JOIN p a ON a.vid = lo JOIN p b ON b.vid = hi),
h AS (SELECT *, x1 + dx * 0.6::DOUBLE AS hx, y1 + dy * 0.6::DOUBLE AS hy, atan2(dy, dx) AS angle FROM s WHERE sqrt(dx * dx + dy * dy) >= 28)
SELECT route, lo, hi, round(hx, 4) AS head_x, round(hy - sin(angle + 0.5::DOUBLE) * 7, 4) AS left_y, round(hx - cos(angle - 0.5::DOUBLE) * 7, 4) AS right_x, round(hx - cos(angle) * 4.2::DOUBLE, 4) AS notch_x, round(hy - sin(angle) * 12.6::DOUBLE, 4) AS tail_y FROM h""")
def route_arrows(spark, d):
    """Arrows on the edges of all ways."""
    points = _placed(spark, d)
    at = lambda end, n: points.select(F.col("vid").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    rows = overlay.route_edges(_drawn(spark, d)).join(at("lo", 1), "lo").join(at("hi", 2), "hi")
    return overlay.arrows(rows, 2_000_000.0).select("route", "lo", "hi", *[F.round(c, 4).alias(c) for c in ("head_x", "left_y", "right_x", "notch_x", "tail_y")])


@query(f"""WITH {fixtures.SQL}, w AS (SELECT way_id, count(*) AS n, list(osm_id - 1 ORDER BY pos) AS nodes FROM way_nodes GROUP BY way_id)
SELECT way_id % 100 AS text, 'Route ' || row_number() OVER t AS label, CAST((row_number() OVER t - 1) % 10 AS INT) AS colour, n * 1111.5::DOUBLE AS time_s, n * 100.25::DOUBLE AS dist_m, nodes FROM w WINDOW t AS (PARTITION BY way_id % 100 ORDER BY way_id)""")
def result_texts(spark, d):
    """A hundred result texts of searches, a line for each way, read back."""
    rows = _drawn(spark, d).select("route", F.size("path").alias("n_nodes"), (F.size("path") * 1111.5).alias("time_s"), (F.size("path") * 100.25).alias("dist_m"), F.transform("path", lambda v: v - 1).alias("path"), F.col("route").alias("qid"))
    lines = files.search_lines(rows, full=True).withColumn("text", F.col("qid") % 100)
    texts = lines.groupBy("text").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("qid", "line"))), lambda x: x["line"]), "\n").alias("value"))
    return files.parse_texts(texts).select("text", "label", "colour", "time_s", "dist_m", "nodes")


@query(WITH + f"SELECT a.id AS qid, a.vid AS src, b.vid AS dst FROM {NEAREST.format('points')} a JOIN points p ON p.id = a.id JOIN {NEAREST.format('points')} b ON b.id = p.id * 7 % (SELECT count(*) FROM points)")
def geocoded_pairs(spark, d):
    """Pairs of places, a customer and another one, as pairs of vertices."""
    here = fixtures.points(spark, d)
    n = here.count()
    there = here.select((F.col("id")).alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = here.withColumn("other", F.col("id") * 7 % n).join(there, "other").select(F.col("id").alias("qid"), "lat", "lon", "lat2", "lon2")
    return RoadGraph(*graph(spark, d)).pairs(pairs)


@query(WITH + "SELECT vid + 1 AS dense_id, osm_id, format('{:.6g}', lat + vid::DOUBLE / 7919) AS lat, format('{:.6g}', (lon - 37::DOUBLE) * (vid % 11)::DOUBLE / 977) AS lon FROM vertices")
def id_map(spark, d):
    """The id map of the vertices, moved so that their coordinates have many digits."""
    vertex = graph(spark, d)[0]
    moved = vertex.withColumn("lat", F.col("lat") + F.col("vid").cast("double") / 7919).withColumn("lon", (F.col("lon") - 37.0) * (F.col("vid") % 11).cast("double") / 977)
    return files.id_map(moved)


def _palette_sql(index: str, palette: list) -> str:
    return "CASE " + index + " % " + str(len(palette)) + " " + " ".join(f"WHEN {i} THEN '{r},{g},{b}'" for i, (r, g, b) in enumerate(palette)) + " END"


@query(f"WITH {fixtures.SQL} SELECT way_id, {_palette_sql('way_id', expr.ROUTE_PALETTE)} AS listed, {_palette_sql('way_id', expr.DRAWN_PALETTE)} AS drawn FROM way_tags")
def route_colours(spark, d):
    """The colour of each way in both palettes."""
    rgb = lambda c: F.concat_ws(",", c["r"], c["g"], c["b"])
    return fixtures.ways(spark, d).select("way_id", rgb(expr.palette_colour(F.col("way_id"))).alias("listed"), rgb(expr.palette_colour(F.col("way_id"), expr.DRAWN_PALETTE)).alias("drawn"))


TIER = "CASE WHEN speed_mps * 3.6::FLOAT >= 90 THEN 4 WHEN speed_mps * 3.6::FLOAT >= 70 THEN 3 WHEN speed_mps * 3.6::FLOAT >= 50 THEN 2 WHEN speed_mps * 3.6::FLOAT >= 30 THEN 1 ELSE 0 END"


@query(WITH + f"SELECT way_id, {TIER} AS tier, CASE {TIER} WHEN 4 THEN 90 WHEN 3 THEN 70 WHEN 2 THEN 50 WHEN 1 THEN 30 ELSE 0 END AS min_kph, CASE {TIER} WHEN 4 THEN 1.35::DOUBLE WHEN 3 THEN 1.15::DOUBLE WHEN 2 THEN 0.95::DOUBLE WHEN 1 THEN 0.78::DOUBLE ELSE 0.62::DOUBLE END AS width, CASE {TIER} " + " ".join(f"WHEN {k} THEN {c[0]}" for k, c in expr.TIER_COLOURS.items()) + " END AS red FROM drivable")
def tier_styles(spark, d):
    """Tier, least speed, width and colour of each drivable way."""
    rows = build.drivable_ways(fixtures.ways(spark, d)).select("way_id", expr.speed_tier(F.col("speed_mps")).alias("tier"))
    return rows.select("way_id", "tier", expr.tier_min_kph(F.col("tier")).alias("min_kph"), expr.tier_width(F.col("tier")).alias("width"), expr.tier_colour(F.col("tier"))["r"].alias("red"))


@query(f"""WITH {MERCATOR} SELECT vid, round((x - 0.6459::DOUBLE) * 200000 + 400, 4) AS screen_x, round((x - 0.6459::DOUBLE) * 200000 + 400, 4) AS back_x, round((y - min_y) * 200000, 4) AS local_y, round((y - min_y) * 200000) + 0.5::DOUBLE AS pixel_y FROM pts, box""")
def screen_places(spark, d):
    """Vertices on screen and back, and in a raster tile that begins at the bounds, snapped to pixels."""
    points = tiles.projected(graph(spark, d)[0])
    both = points.join(F.broadcast(tiles.bounds(points)), F.lit(True))  # one row
    screen = lambda c: expr.to_screen(c, 0.6459, 200_000.0, 800.0)
    local = expr.tile_local(F.col("y"), F.col("min_y"), 200_000.0)
    return both.select("vid", F.round(screen(F.col("x")), 4).alias("screen_x"), F.round(screen(expr.to_world(screen(F.col("x")), 0.6459, 200_000.0, 800.0)), 4).alias("back_x"), F.round(local, 4).alias("local_y"), expr.snapped(local).alias("pixel_y"))


_TO = lambda a, b: HAVERSINE.replace("b.", "@").replace("a.l", f"{a}.l").replace("@", f"{b}.")


@query(WITH + f"""SELECT src, dst, (least(src, dst) * 4294967296 + greatest(src, dst))::BIGINT AS key, round(to_goal, 3) AS metres, round(to_goal / 30.5::DOUBLE, 3) AS seconds, round((to_goal - from_start) * 0.5::DOUBLE, 3) AS potential
FROM edges JOIN (SELECT v.vid, {_TO('v', 'g')} AS to_goal, {_TO('s', 'v')} AS from_start FROM vertices v, vertices g, vertices s WHERE g.vid = 0 AND s.vid = 1) h ON h.vid = src""")
def search_bounds(spark, d):
    """Each edge's undirected key, and the bounds and potential of its first end in a search from vertex 1 to vertex 0."""
    vertex, edges = graph(spark, d)
    at = lambda vid, n: vertex.filter(F.col("vid") == vid).select(F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon"))
    both = vertex.join(F.broadcast(at(0, "g")), F.lit(True)).join(F.broadcast(at(1, "s")), F.lit(True))  # a row each
    metres = lambda a, b: expr.haversine(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    bounds = both.select(F.col("vid").alias("src"), metres("", "g_").alias("to_goal"), metres("s_", "").alias("from_start"))
    rows = edges.join(bounds, "src")
    return rows.select(
        "src", "dst", expr.undirected_key(F.col("src"), F.col("dst")).alias("key"), F.round(expr.heuristic(F.col("to_goal"), "distance"), 3).alias("metres"),
        F.round(expr.heuristic(F.col("to_goal"), "time"), 3).alias("seconds"), F.round(expr.potential(F.col("to_goal"), F.col("from_start")), 3).alias("potential"),
    )


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS pos, TRUE AS begins, TRUE AS leads_on, TRUE AS same_time FROM nation")
def tsp_legs(spark, d):
    """Whether each leg of the tour of all stops begins at its stop, leads to the next one, and takes the time that its edges add up to."""
    vertex, cost = searched(spark, d)
    road = RoadGraph(vertex, cost.select("src", "dst", "speed_mps"), _costed=cost)
    tour = storage.keep(road.tsp(fixtures.stops(spark, d), full=True))
    after = tour.select(F.pmod(F.col("pos") - 1, F.lit(tour.count())).cast("int").alias("pos"), F.col("vid").alias("next"))
    summed = paths.path_totals(tour.select(F.col("pos").alias("qid"), "path"), road.costed()).select(F.col("qid").alias("pos"), "time_s")
    rows = tour.join(after, "pos").join(summed, "pos")
    last = F.element_at("path", -1)
    return rows.select("pos", (F.get("path", F.lit(0)) == F.col("vid")).alias("begins"), (last == F.col("next")).alias("leads_on"), (F.abs(F.col("leg_time_ms") - F.col("time_s") * 1000) <= 1.001).alias("same_time"))


@query("SELECT count(*) - 1 AS visited, TRUE AS closed, TRUE AS timed FROM nation")
def plan_texts(spark, d):
    """The text of the plan for all orders, read back: its visits, and whether each route ends where it begins and has its time."""
    text = RoadGraph(*graph(spark, d)).vrp_report(fixtures.vrp_orders(spark, d), fixtures.fleet(spark, d))
    routes = files.parse_texts(spark.createDataFrame([(text,)], "value string"))
    visits = F.size(F.filter("targets", lambda t: ~t["depot"]))
    return routes.agg(F.sum(visits).alias("visited"), F.every(F.get("nodes", F.lit(0)) == F.element_at("nodes", -1)).alias("closed"), F.every(F.col("time_s") > 0).alias("timed"))
