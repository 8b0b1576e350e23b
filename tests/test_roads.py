"""Unit, property, differential and round-trip tests of the road network operators, and of every registered query against its SQL."""

import contextlib
import itertools
import math
import os
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadspark.functions import expr
from roadspark.graph import RoadGraph
from roadspark.operators import build, overlay, paths, storage, tiles, tours
from roadspark.plans import registry
from roadspark.sources import files, fixtures, pbf

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("RU:60", 60), ("50;70", 50), ("5.5", 5), ("none", None), ("", None)])
def test_first_digits(spark, text, want):
    assert one(spark, expr.first_digits(F.col("t")), t=text) == want


@pytest.mark.parametrize(("highway", "maxspeed", "kph"), [("motorway", None, 110), ("motorway", "0", 110), ("road", "0 mph", 40), ("track", "none", 50), ("service", "55 mph", 88), ("primary", "50;70", 50), (None, None, 50)])
def test_way_speed(spark, highway, maxspeed, kph):
    got = spark.createDataFrame([(highway, maxspeed)], "h string, m string").select(expr.way_speed(F.col("h"), F.col("m")).alias("x")).first().x
    assert got == pytest.approx(kph / 3.6, rel=1e-6)


@pytest.mark.parametrize(("oneway", "want"), [("yes", 1), ("1", 1), ("true", 1), ("-1", -1), ("reverse", 0), ("no", 0)])
def test_direction(spark, oneway, want):
    assert one(spark, expr.direction(F.col("o")), o=oneway) == want


@pytest.mark.parametrize(("seconds", "want"), [(-5.0, "00:00:00"), (59.9, "00:00:59"), (3661.0, "01:01:01"), (360000.0, "100:00:00")])
def test_hms(spark, seconds, want):
    assert one(spark, expr.hms(F.col("s")), s=seconds) == want


@pytest.mark.parametrize(("number", "want"), [(-1, ""), (0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_marker_label(spark, number, want):
    assert one(spark, expr.marker_label(F.col("n")), n=number) == want


@pytest.mark.parametrize(("kph", "tier"), [(None, 0), (0.0, 0), (29.0, 0), (31.0, 1), (51.0, 2), (71.0, 3), (120.0, 4)])
def test_tier(spark, kph, tier):
    got = spark.createDataFrame([(kph,)], "k double").select(expr.speed_tier((F.col("k") / 3.6).cast("float")).alias("x")).first().x
    assert got == tier


def test_levels(spark):
    got = spark.createDataFrame([(z,) for z in (1.0, 7000.0, 20000.0, 50000.0, 1e6)], "z double").select(expr.level_of_zoom(F.col("z")).alias("a"), expr.tier_of_zoom(F.col("z")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0, 4), (1, 3), (2, 2), (3, 1), (4, 0)]


def test_geometry(spark):
    assert one(spark, expr.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111194.926, abs=0.01)
    assert one(spark, expr.undirected_key(F.lit(7), F.lit(2))) == (2 << 32) + 7
    assert one(spark, expr.edge_seconds(F.lit(10.0), F.lit(0.0).cast("float"))) == pytest.approx(100, rel=1e-6)
    assert one(spark, expr.to_world(expr.to_screen(F.lit(3.0), 1.0, 50.0, 800.0), 1.0, 50.0, 800.0)) == pytest.approx(3)


@pytest.fixture(scope="module")
def graph(spark):
    vertex, edges = registry.graph(spark, DATA)
    return RoadGraph(vertex.cache(), edges.cache())


def test_missing_node_is_an_error(spark):
    ways = spark.createDataFrame([(1, "road", None, None, [1, 2, 3])], "way_id long, highway string, maxspeed string, oneway string, nodes array<long>")
    nodes = spark.createDataFrame([(1, 1.0, 1.0, 0), (2, 1.0, 2.0, 1), (2, 9.0, 9.0, 2), (3, 95.0, 0.0, 3)], "osm_id long, lat double, lon double, seq long")
    with pytest.raises(ValueError, match="1 nodes"):
        build.build_graph(ways, nodes)
    vertex, edges = build.build_graph(ways, nodes, strict=False)
    assert sorted(map(tuple, vertex.collect())) == [(0, 1, 1.0, 1.0), (1, 2, 1.0, 2.0)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (1, 0)]


def test_numbering_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(build, "BUCKET_ROWS", 7)
    ids = [3, 5, 8, 1000, 1001, *range(20, 60)]
    got = build.numbered(spark.createDataFrame([(i,) for i in ids], "k long"), "k", "n").collect()
    assert {r.k: r.n for r in got} == {k: n for n, k in enumerate(sorted(ids))}


@pytest.mark.parametrize(("part", "places"), [(20_000, False), (30, False), (30, True)])
def test_parts_equal_kernel(spark, graph, monkeypatch, part, places):
    monkeypatch.setattr(paths, "PART_VERTICES", part)
    monkeypatch.setattr(paths, "SOURCES_AT_A_TIME", 1)
    start = spark.createDataFrame([(0,), (17,)], "src long")
    cost = graph.costed()
    for metric in ("time", "distance"):
        a = {(r.src, r.v): round(r.cost, 6) for r in paths.by_parts(cost, start, metric, graph.vertices if places else None).collect()}
        b = {(r.src, r.v): round(r.cost, 6) for r in paths.from_sources(cost, start, metric).collect()}
        assert a == b and len(a) > 200


def test_routes(spark, graph):
    q = spark.createDataFrame([(1, 0, 50), (2, 7, 7), (3, 0, 10**9), (4, None, 3)], "qid long, src long, dst long")
    got = {r.qid: r for r in graph.route(q, "time", full=True).collect()}
    assert got[2].path == [7] and got[2].time_s == 0 and got[3].path is None and got[4].time_s is None
    assert got[1].path[0] == 0 and got[1].path[-1] == 50
    edges = {(r.src, r.dst): r.time_s for r in graph.costed().collect()}
    assert sum(edges[h] for h in zip(got[1].path, got[1].path[1:], strict=False)) == pytest.approx(got[1].time_s)
    lines = {r.qid: r.line for r in files.search_lines(graph.route(q, "time", full=True), True).collect()}
    assert lines[2] == "0.000000 0.000000 1 8" and lines[3] == "-1 -1 0"
    parsed = files.parse_results("\n".join([files.SEARCH_TITLE, lines[1], lines[3]]))
    assert [p["nodes"] for p in parsed] == [got[1].path]


def test_routes_beyond_the_kernel(spark, graph, monkeypatch):
    vids = [r.vid for r in graph.vertices.orderBy("vid").limit(6).collect()]
    q = spark.createDataFrame([(i * 6 + j, a, b) for i, a in enumerate(vids) for j, b in enumerate(vids)] + [(99, vids[0], -5)], "qid long, src long, dst long")
    for metric in ("time", "distance"):
        kernel = {r.qid: r for r in graph.route(q, metric, full=True).collect()}
        with monkeypatch.context() as m:
            m.setattr(paths, "KERNEL_EDGES", 0)
            m.setattr(paths, "_broadcast_graph", None)
            far = {r.qid: r for r in graph.route(q, metric, full=True).collect()}
        assert far.keys() == kernel.keys()
        column = paths.COST[metric]
        for i, r in far.items():
            assert (r[column] is None) == (kernel[i][column] is None) and (r[column] is None or r[column] == pytest.approx(kernel[i][column]))
            assert r.path is None or (r.path[0], r.path[-1], len(r.path)) == (r.src, r.dst, r.n_nodes)


def test_nearest_far_away(spark, graph):
    points = spark.createDataFrame([(1, 10.0, -70.0), (2, 55.0101, 37.0001)], "id long, lat double, lon double")
    v = graph.vertices.collect()
    want = {p.id: min((r.lat - p.lat) ** 2 + (r.lon - p.lon) ** 2 for r in v) for p in points.collect()}
    got = {r.id: r.d2 for r in graph.nearest(points).collect()}
    assert got == pytest.approx(want)


def every_tour(cost, n):
    return min(tours.tour_cost(cost, [0, *p]) for p in itertools.permutations(range(1, n)))


def test_tours():
    rng = random.Random(3)
    for n in range(2, 8):
        cost = {(i, j): rng.randint(1, 99) for i in range(n) for j in range(n)}
        order = tours.solve_tour(cost, n)
        assert sorted(order) == list(range(n)) and order[0] == 0
        assert tours.tour_cost(cost, order) == every_tour(cost, n)
    assert tours.solve_tour({}, 1) == [0]


@pytest.mark.parametrize("n", [3, 5, 14, 25])
def test_improve_goes_on_until_no_move_helps(n):
    rng = random.Random(n)
    cost = {(i, j): rng.randint(1, 999) for i in range(n) for j in range(n)}
    best = tours.improve(cost, list(range(n)))
    value = tours.tour_cost(cost, best)
    assert sorted(best) == list(range(n)) and best[0] == 0 and value <= tours.tour_cost(cost, list(range(n)))
    for i in range(1, n):
        for j in range(i, n):
            assert tours.tour_cost(cost, best[:i] + best[i : j + 1][::-1] + best[j + 1 :]) >= value
            if j - i < 3:
                rest = best[:i] + best[j + 1 :]
                assert min(tours.tour_cost(cost, rest[:k] + best[i : j + 1] + rest[k:]) for k in range(1, len(rest) + 1)) >= value


def test_large_tour_ends_soon():
    rng = random.Random(1)
    places = [(rng.random(), rng.random()) for _ in range(300)]
    cost = {(i, j): int(1e6 * math.dist(a, b)) for i, a in enumerate(places) for j, b in enumerate(places)}
    began = time.time()
    assert tours.tour_cost(cost, tours.solve_tour(cost, 300)) < 16e6 and time.time() - began < 60


def test_sample_tour_and_plan(spark, graph):
    stops = spark.createDataFrame([(1, 55.001, 37.001), (2, 55.012, 37.002), (3, 55.03, 37.0), (4, 55.044, 37.003)], "id int, lat double, lon double")
    tour = [r.stop for r in graph.tsp(stops).orderBy("pos").collect()]
    assert sorted(tour) == [0, 1, 2, 3] and tour[0] == 0
    orders = stops.withColumn("id", F.col("id") - 1).withColumn("demand", F.when(F.col("id") == 1, 0).otherwise(20)).withColumn("tw_start", F.lit(0)).withColumn("tw_end", F.lit(86400))
    fleet = spark.createDataFrame([(1, 50), (2, 30)], "vehicle_id int, capacity long")
    plan = graph.vrp(orders, fleet).collect()
    assert sorted(r.stop for r in plan if r.stop) == [1, 2, 3]
    assert max(r.load for r in plan if r.vehicle_id == 1) <= 50 and max((r.load for r in plan if r.vehicle_id == 2), default=0) <= 30
    routes = files.parse_results(graph.vrp_report(orders, fleet))
    assert len(routes) == len({r.vehicle_id for r in plan}) and all(r["nodes"][0] == r["nodes"][-1] == r["targets"][0][0] for r in routes)
    with pytest.raises(Exception, match="fits no vehicle"):
        graph.vrp(orders, spark.createDataFrame([(1, 10)], "vehicle_id int, capacity long")).collect()


def test_both_totals_are_of_one_path(spark, graph):
    points = spark.createDataFrame([(k, 55 + k * 0.007 + 0.0003, 37.0003 + (k % 3) / 1000) for k in range(6)], "id int, lat double, lon double")
    stops = {r.i: r.vid for r in graph.stops(points).collect()}
    for metric in ("time", "distance"):
        q = spark.createDataFrame([(10 * i + j, a, b) for i, a in stops.items() for j, b in stops.items()], "qid long, src long, dst long")
        own = {(r.qid // 10, r.qid % 10): r for r in graph.route(q, metric).collect()}
        for r in graph.matrix(points, metric).collect():
            route = own[r.i, r.j]
            cell, total = (r.time_ms, route.time_s) if metric == "time" else (r.dist_mm, route.dist_m)
            assert abs(cell - 1000 * total) <= 1.001 or r.i == r.j
    tour = graph.tsp(points, "distance", full=True).orderBy("pos").collect()
    assert sum(r.leg_dist_mm for r in tour) == tour[0].total and all(a.path[-1] == b.path[0] for a, b in zip(tour, [*tour[1:], tour[0]], strict=True))
    cells = graph.matrix(points, "distance").withColumn("problem", F.lit(0).cast("long"))
    totals = tours.tour_totals(graph.tsp(points, "distance").withColumn("problem", F.lit(0).cast("long")), cells).first()
    assert totals.dist_mm == tour[0].total and totals.time_ms == sum(r.leg_time_ms for r in tour)
    text = graph.tsp_report(points, "distance", full=True)
    routes = files.parse_results(text)
    assert [r["nodes"] for r in routes] == [r.path for r in tour] and [t[0] for t in routes[0]["targets"]] == [r.vid for r in tour]
    assert "Optimized by: DISTANCE" in text and "Full routes" not in graph.tsp_report(points)


def test_meeting_searches_equal_trees(spark, graph):
    key, shared = paths._broadcast_graph(graph.costed(), "time", graph.vertices)
    for metric, cost in (("time", "time_s"), ("distance", "dist_m")):
        arrays = list(shared.value)
        arrays[2] = arrays[4 if metric == "time" else 3]
        csr = paths.Csr(*arrays)
        for source in range(0, csr.size, 17):
            done, _ = csr.tree(source)
            for goal in range(0, csr.size, 13):
                edges = csr.meet(source, goal, metric)
                assert (edges is None) == (goal not in done)
                if edges is not None:
                    assert sum(csr.cost[e] for e in edges) == pytest.approx(done[goal])
                    assert not edges or csr.src[edges[0]] == source
                    assert all(csr.dst[a] == csr.src[b] for a, b in zip(edges, edges[1:], strict=False)) and (not edges or csr.dst[edges[-1]] == goal)


def test_time_needs_speeds(spark):
    vertex = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.1)], "vid long, osm_id long, lat double, lon double")
    g = RoadGraph(vertex, spark.createDataFrame([(0, 1, None)], "src long, dst long, speed_mps float"))
    q = spark.createDataFrame([(1, 0, 1)], "qid long, src long, dst long")
    with pytest.raises(ValueError, match="without speed"):
        g.route(q)
    with pytest.raises(ValueError, match="time or distance"):
        g.route(q, "hops")
    assert g.route(q, "distance").first().dist_m > 10_000


def test_coordinate_pairs(spark, graph):
    pairs = spark.createDataFrame([(7, 55.0, 37.0, 55.01, 37.001), (8, None, None, 55.0, 37.0), (9, 55.01, 37.001, 55.0, 37.0)], "qid long, lat double, lon double, lat2 double, lon2 double")
    got = {r.qid: r for r in graph.route(pairs, "distance", full=True).collect()}
    assert sorted(got) == [7, 8, 9] and got[8].path is None and got[7].path[0] == got[9].path[-1] and got[7].path[-1] == got[9].path[0]
    assert graph.route(pairs.drop("qid").repartition(3), "distance").filter("dist_m is not null").count() == 2


def test_unreachable_pair(spark):
    vertex = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.1)], "vid long, osm_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 10.0)], "src long, dst long, speed_mps float")
    g = RoadGraph(vertex, edges)
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.1)], "id int, lat double, lon double")
    cells = {(r.i, r.j): r.time_ms for r in g.matrix(points).collect()}
    assert cells[1, 0] is None and cells[0, 0] == 0 and cells[0, 1] > 0
    assert {(r.i, r.j): r.time_ms for r in g.matrix(points, compat_unreachable=True).collect()}[1, 0] == -1000
    with pytest.raises(Exception, match="from stop 1 to stop 0"):
        g.tsp(points).collect()


def test_graph_file_round_trip(spark, graph, tmp_path):
    graph.write_binary(str(tmp_path / "graph.bin"))
    back = RoadGraph.read_binary(spark, str(tmp_path / "graph.bin"))
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, graph.edges.select("src", "dst", "speed_mps").collect()))
    assert sorted((r.vid, r.lat, r.lon) for r in back.vertices.collect()) == sorted((r.vid, r.lat, r.lon) for r in graph.vertices.collect())
    with pytest.raises(ValueError, match="invalid N"):
        files.decode_graph(b"GBIN" + (2).to_bytes(4, "little") + bytes(12))


def test_pbf(spark, tmp_path):
    nodes = [(10, 55.0, 37.0), (5, 55.001, 37.0), (7, -3.5, -70.25)]
    ways = [(1, {"highway": "primary", "oneway": "yes"}, [10, 5]), (2, {"highway": "road", "maxspeed": "30 mph"}, [5, 7, 10]), (3, {"highway": "footway"}, [5, 7])]
    (tmp_path / "x.pbf").write_bytes(pbf.encode(nodes, ways))
    path = str(tmp_path / "x.pbf")
    assert [(r.way_id, r.tags, r.nodes) for r in pbf.read(spark, path, "way").collect()] == ways
    assert [(r.osm_id, round(r.lat, 7), round(r.lon, 7)) for r in pbf.read(spark, path, "node").collect()] == nodes
    assert {r.entity: r.rows for r in pbf.info(spark, path).collect()} == {"node": 3, "way": 3}
    g = RoadGraph.from_pbf(spark, path)
    assert g.vertices.count() == 3 and sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 1), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_lists(spark, tmp_path):
    (tmp_path / "stops.csv").write_text("id, lat,lon\n1, 55.7558,37.6173\n2,55.5714, 37.6856\n")
    assert [tuple(r) for r in files.read_stops(spark, str(tmp_path / "stops.csv")).collect()] == [(1, 55.7558, 37.6173), (2, 55.5714, 37.6856)]
    (tmp_path / "q.txt").write_text("1 2\nx y\n 3\t4 \n")
    assert [(r.src, r.dst) for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, 1), (None, None), (2, 3)]
    (tmp_path / "c.txt").write_text("55.1 37.2 55.3 37.4\n9 9\n")
    assert files.read_coordinates(spark, str(tmp_path / "c.txt")).count() == 2
    (tmp_path / "bad.txt").write_text("55.1 37.2 55.3\n")
    with pytest.raises(ValueError):
        files.read_coordinates(spark, str(tmp_path / "bad.txt"))


def test_pairs_orders_and_fleets(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("lat,lon,lat2,lon2\n52.595, 38.408,57.2603,32.7003\n55.555,35.555,56.666,34.444\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "pairs.csv")).collect()] == [(52.595, 38.408, 57.2603, 32.7003), (55.555, 35.555, 56.666, 34.444)]
    (tmp_path / "orders.csv").write_text("id,lat,lon,demand,tw_start,tw_end\n0,55.755826,37.617299,0,0,86400\n3, 55.741511,37.612033, 25,10000,50400\n")
    assert [tuple(r) for r in files.read_orders(spark, str(tmp_path / "orders.csv")).collect()] == [(0, 55.755826, 37.617299, 0, 0, 86400), (3, 55.741511, 37.612033, 25, 10000, 50400)]
    (tmp_path / "fleet.csv").write_text("vehicle_id,capacity\n1,50\n2, 100\n")
    assert [tuple(r) for r in files.read_fleet(spark, str(tmp_path / "fleet.csv")).collect()] == [(1, 50), (2, 100)]


def test_written_lists(spark, graph, tmp_path):
    files.write_id_map(graph.vertices, str(tmp_path / "map"))
    rows = [line for p in sorted((tmp_path / "map").glob("*.csv")) for line in p.read_text().splitlines() if not line.startswith("dense_id")]
    assert len(rows) == graph.vertices.count() and rows[0].split(",")[0] == "1"
    q = spark.createDataFrame([(2, 0, 50), (1, 7, 7), (3, 0, 10**9)], "qid long, src long, dst long")
    files.write_search(graph.route(q, "distance", full=True), str(tmp_path / "found"), full=True)
    lines = next((tmp_path / "found").glob("*.txt")).read_text().splitlines()
    assert lines[0] == files.SEARCH_TITLE and lines[1] == "0.000000 0.000000 1 8" and lines[3] == "-1 -1 0"
    assert [r.nodes[0] for r in files.read_results(spark, str(tmp_path / "found")).filter("size(nodes) > 0").collect()] == [7, 0]


def test_old_graph_files_have_no_speeds(spark, tmp_path):
    n = 2
    body = (n).to_bytes(8, "little") + np.arange(n, dtype="<u4").tobytes() + np.array([[1.0, 1.0], [1.0, 1.1]], "<f8").tobytes() + np.array([1, 1], "<u4").tobytes() + np.array([1], "<u4").tobytes()
    (tmp_path / "old.bin").write_bytes(body)
    g = RoadGraph.read_binary(spark, str(tmp_path / "old.bin"))
    q = spark.createDataFrame([(1, 0, 1)], "qid long, src long, dst long")
    assert g.route(q, "distance").first().n_nodes == 2
    with pytest.raises(ValueError, match="without speed"):
        g.route(q, "time")


def test_reports_are_read_back(spark, tmp_path):
    text = files.tour_report([(55.7, 37.6, 4), (55.5, 37.7, 9)], [0, 1], 12.5, 300.0, "time", [(6.0, 150.0, [4, 6, 9]), (6.5, 150.0, [9, 4])])
    routes = files.parse_results(text)
    assert [r["nodes"] for r in routes] == [[4, 6, 9], [9, 4]] and routes[0]["targets"] == [(4, None, True), (9, None, False)]
    (tmp_path / "plan.txt").write_text(files.plan_report([(1, [(4, 0.0, True), (9, 60.0, False)], 70.0, 900.0, [4, 9, 4])]))
    row = files.read_results(spark, str(tmp_path / "plan.txt")).first()
    assert row.nodes == [4, 9, 4] and [tuple(t) for t in row.targets] == [(4, 0.0, True), (9, 60.0, False)]


def test_overlay(spark):
    routes = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 2]), (2, [2, 2])], "route int, path array<long>")
    assert {(r.lo, r.hi): r.routes for r in overlay.shared_edges(routes).collect()} == {(1, 2): [0], (2, 3): [0, 1]}
    casings, bands = overlay.draw_order(routes)
    assert casings.first().casing == pytest.approx(4.4 + 5.8 + 2.8) and bands.first().route == 0
    ends = spark.createDataFrame([(0, 0, 0.0, 0.0, False), (0, 1, 1e-6, 0.0, True), (0, 2, 1.0, 1.0, False)], "plan int, seq int, x double, y double, depot boolean")
    assert [(r.cluster, r.cluster_depot) for r in overlay.clusters(ends).orderBy("seq").collect()] == [(0, True), (0, True), (1, False)]
    way = spark.createDataFrame([(0, 0.00005, 0.0), (1, 5.0, 5.0)], "waypoint int, x double, y double")
    assert [tuple(r) for r in overlay.leaders(way, spark.createDataFrame([(8, 0.0, 0.0), (9, 0.00004, 0.0)], "vid long, x double, y double")).collect()] == [(0, 9)]


def test_adaptive_speed(spark):
    rows = spark.createDataFrame([(900_000, 600_000, 400_000, 5, 1)], [f"from_{k}" for k in tiles.FILTERS])
    assert tiles.adaptive_min_kph(rows).first().min_kph == 50


def test_view_through_tiles(spark, graph):
    road, points = graph.roads(), tiles.projected(graph.vertices)
    view, box = registry.VIEW, tiles.bounds(tiles.projected(graph.vertices))
    b = box.first()
    size = max(b.max_x - b.min_x, b.max_y - b.min_y) / 256
    runs = tiles.tile_runs(road, points)
    assert tiles.tile_index(road, points).count() == runs.selectExpr("sum(x_to - x_from + 1) as n").first().n
    found = tiles.roads_by_tiles(runs, road, tiles.range_of_view(box, view, size), 4, view)
    assert sorted((r.lo, r.hi) for r in found.collect()) == sorted((r.lo, r.hi) for r in road.filter(tiles.in_view(*view)).collect())
    one = spark.createDataFrame([(0.0, 10.0, 0.0, 1.0)], "min_x double, max_x double, min_y double, max_y double")
    assert [tuple(r) for r in tiles.raster_range(one, (0.6, -3.0, 20.0, 0.9), 1024.0).collect()] == [(1, 19, 0, 1)]
    assert tiles.raster_range(one, (11.0, 0.0, 12.0, 1.0), 1024.0).count() == 0
    assert tuple(tiles.raster_extent(one, 1, 1, 1024.0).first()) == (0.5, 0.5, 1.0, 1.0)
    routes = spark.createDataFrame([(1, [5, 6]), (0, [10**9, 7])], "route int, path array<long>")
    first = overlay.initial_view(routes, points).first()
    assert (first.x, first.y) == tuple(points.filter("vid = 7").select("x", "y").first())
    lost = spark.createDataFrame([(0, [10**9])], "route int, path array<long>")
    corners = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 1.0)], "vid long, x double, y double")
    assert tuple(overlay.initial_view(lost, corners, width=1000, height=1000).first()) == (1.0, 0.5, pytest.approx(410.0))
    assert tuple(overlay.initial_view(lost, corners.limit(0)).first()) == (0.0, 0.0, 18_000.0)


def test_heavy_view_shows_fewer_tiers(spark, monkeypatch):
    index = spark.createDataFrame([(0, 0, t, t, t + 1) for t in (0, 0, 1, 2, 3, 3, 4)] + [(5, 5, 4, 8, 9)], "cell_x int, cell_y int, tier int, lo long, hi long")
    cells = spark.createDataFrame([(0, 1, 0, 1)], "x_from int, x_to int, y_from int, y_to int")
    for most, want in ((7, (0, 7)), (4, (2, 4)), (0, (4, 1))):
        monkeypatch.setattr(tiles, "MOST_ROADS", most)
        assert tuple(tiles.view_tier(index, cells, 100_000.0).first()) == want


def test_legend(spark):
    rows = spark.createDataFrame([(i, 3, 12.34, 61.0, 0.0, 3600.0 * (i % 2)) for i in range(14)], "route int, n_nodes int, dist_m double, time_s double, first_s double, last_s double")
    lines = [r.label for r in overlay.legend(rows).orderBy("route").collect()]
    assert len(lines) == 12 and lines[0] == "Route 1: 3 nodes | 12.3 m | 00:01:01" and lines[1].endswith("00:01:01 [00:00:00 \u2192 01:00:00]")
    assert [r.label for r in overlay.legend_rest(rows).collect()] == ["... and 2 more routes"] and overlay.legend_rest(rows.limit(12)).count() == 0


def test_fixture_tables(spark):
    assert fixtures.ways(spark, DATA).count() == 1473 and fixtures.nodes(spark, DATA).count() == 200


def tidy(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(tidy, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(registry.ORACLE_SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    got = df.select(*columns).collect()
    assert sorted((tuple(map(tidy, r)) for r in got), key=repr) == sorted((tuple(map(tidy, r)) for r in want), key=repr)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize(("value", "want"), [(5.123456, "5.12346"), (100.0, "100"), (0.0, "0"), (-55.7558, "-55.7558"), (0.00001234567, "1.23457e-05"), (1234567.0, "1.23457e+06"), (37.0, "37"), (0.5, "0.5"), (123456.0, "123456"), (-0.000123456789, "-0.000123457")])
def test_six_digits(spark, value, want):
    assert one(spark, expr.six_digits(F.col("v")), v=value) == want == f"{value:.6g}"


def test_default_outputs():
    assert files.default_outputs("/maps/city.osm.pbf") == ("/maps/graph.bin", "/maps/id_map.csv")


def test_view_keeps_its_index(spark, graph):
    view = registry.VIEW
    assert sorted((r.lo, r.hi) for r in graph.view(view, 1e6).collect()) == sorted((r.lo, r.hi) for r in graph.roads().filter(tiles.in_view(*view)).collect())
    held = graph._drawn
    graph.view(view, 5000.0).collect()
    assert graph._drawn is held


def test_edges_find_their_ends_without_a_shuffle(spark, graph, monkeypatch):
    """od_matrix and what is built like it: edges were shuffled four times for the numbers and places of their ends."""
    arcs = spark.createDataFrame([(r.osm_id, r.osm_id + 7, 1.0) for r in graph.vertices.collect()] + [(5, 6, 1.0), (None, 6, 1.0)], "from_osm long, to_osm long, speed_mps float")

    def made():
        edges = build.fastest_edges(arcs, graph.vertices)
        return edges, build.with_costs(graph.edges, graph.vertices)

    edges, cost = made()
    assert not any("Join" in df._jdf.queryExecution().sparkPlan().toString() for df in (edges, cost))
    want = [sorted(map(tuple, df.collect())) for df in (edges, cost)]
    monkeypatch.setattr(build, "BROADCAST_VERTICES", 10)
    assert [sorted(map(tuple, df.collect())) for df in made()] == want and len(want[0]) > 100 and len(want[1]) == graph.edges.count()


def test_shuffle_files_go_with_a_write(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files_of = lambda: {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files_of()
    kept = storage.keep(spark.range(1000).withColumn("k", F.col("id") % 10).groupBy("k").count())
    deadline = time.time() + 10
    while files_of() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files_of() - before and kept.count() == 10


def test_a_part_holds_few_bytes_a_label():
    """route_batch, route_totals: labels were Python objects of some 500 bytes each."""
    n, m = 4000, 16
    rng = np.random.default_rng(1)
    src, dst = np.repeat(np.arange(n), 5), rng.integers(0, n, 5 * n)
    edges = pa.table({"src": src, "dst": dst, "to": np.zeros(5 * n, np.int64), "cost": rng.random(5 * n), "other": np.ones(5 * n)})
    none = pa.array([None] * m, pa.int64())
    state = pa.table({"src": np.arange(m), "v": np.arange(m), "u": none, "cost": np.zeros(m), "other": np.zeros(m), "hops": np.zeros(m, np.int32), "inner": np.zeros(m, bool)})
    tracemalloc.start()
    out = paths._search_part((pa.scalar(0),), state, edges)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > 0.9 * n * m and peak < 300 * n * m
    for r in out.filter(pa.array(np.arange(out.num_rows) % 501 == 0)).to_pylist():
        assert r["other"] == r["hops"] and r["inner"]


def test_totals_read_few_edges(spark, graph):
    q = spark.createDataFrame([(1, 0, 50), (2, 7, 7)], "qid long, src long, dst long")
    found = graph.route(q, "time", full=True)
    totals = paths.path_totals(found, graph.costed())
    assert "BroadcastHashJoin" in totals._jdf.queryExecution().sparkPlan().toString()
    assert {r.qid: r.time_s for r in totals.collect()} == pytest.approx({r.qid: r.time_s for r in found.collect()})


def test_a_graph_is_written_and_cut_once(spark, graph):
    """od_matrix_totals, tsp_legs, plan_texts: each search wrote the edges again."""
    cost = RoadGraph(graph.vertices, graph.edges).costed()
    assert paths.stored(cost, "time") is cost and paths._parted(cost, "time", None)[1] is paths._parted(cost, "time", graph.vertices)[1]


def test_a_task_looks_up_once(spark, graph, monkeypatch):
    """route_totals: a task with two Python steps has two workers, which stay beside those of later steps."""
    plans, keep = [], storage.Store.keep
    monkeypatch.setattr(storage.Store, "keep", lambda self, df, **old: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or keep(self, df, **old))
    vertex = storage.Store(spark).keep(graph.vertices)
    plans.clear()
    cost = build.written_costs(build.fastest_edges(spark.createDataFrame([(1000000007, 1000000014, 1.0)], "from_osm long, to_osm long, speed_mps float"), vertex), vertex)
    assert [p.count("MapInArrow") for p in plans] == [1, 1] and cost.count() == 1


@pytest.mark.parametrize(("number", "want"), [(18_277, "ZZZ"), (18_278, "AAAA"), (18_304, "AABA")])
def test_marker_label_has_no_bound(spark, number, want):
    """As the reference's marker_label."""
    assert one(spark, expr.marker_label(F.col("n")), n=number) == want


def test_costs_take_no_disk_beside_edges(spark):
    """Only edges are written, what they are made from goes, and searches by parts and totals of paths are those of written costs."""
    d = "/root/testdata/sf0.001"
    vertex, edges = registry.graph(spark, d)
    made_from = edges.made_from.kept_in.removeprefix("file:")
    whole = storage.keep(build.with_costs(edges, vertex))
    cost = build.searchable(edges, vertex, for_good=True)
    assert not os.path.exists(made_from)
    assert spark.read.parquet(cost.kept_in).columns == ["src", "dst", "speed_mps"]
    sources = spark.createDataFrame([(0,), (7,)], "src long")
    found = lambda c, metric: sorted(paths.by_parts(c, sources, metric, vertex).select("src", "v", "cost", "time_s", "dist_m").collect())
    for metric in ("time", "distance"):
        assert found(cost, metric) == found(whole, metric)
    way = whole.select(F.lit(1).cast("long").alias("qid"), F.array("src", "dst").alias("path")).limit(1)
    way = spark.createDataFrame(way.collect(), way.schema)
    assert paths.path_totals(way, cost).collect() == paths.path_totals(way, whole).collect()


def test_a_plan_keeps_its_matrix_alone(spark):
    """The graph, its edges by parts and labels go once the matrix is written, and so do the arrays of numbers once the edges are."""
    at = storage.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    plan, cells, _, _ = registry._plan(spark, DATA)
    held = {n for n in set(os.listdir(at)) - before if not n.startswith(".")}
    assert len(held) == 2 and all(any(n in t.kept_in for t in (plan, cells)) for n in held)
    assert plan.filter("stop <> 0").count() == 24 and cells.count() == 625
    vertex, edges = registry.graph(spark, DATA)
    build.searchable(edges, vertex, for_good=True)
    assert ("osm_id", "vid") not in vertex.arrays


def test_edges_of_parts_take_no_costs_to_disk(spark, monkeypatch):
    """The edges by parts are written once for both metrics, without costs, and places are fetched for their ends once."""
    vertex, edges = registry.graph(spark, DATA)
    cost = build.searchable(edges, vertex)
    whole = storage.keep(build.with_costs(edges, vertex))
    sources = spark.createDataFrame([(0,), (7,)], "src long")
    monkeypatch.setattr(paths, "PART_VERTICES", 20)
    found = lambda c, metric: sorted(paths.by_parts(c, sources, metric).select("src", "v", "cost", "time_s", "dist_m").collect())
    for metric in ("time", "distance"):
        assert found(cost, metric) == found(whole, metric)
    written = {m: paths._parted(cost, m, None)[1] for m in ("time", "distance")}
    assert written["time"] is written["distance"]
    assert not {"cost", "other", "time_s", "dist_m"} & set(spark.read.parquet(written["time"].kept_in).columns)
    assert len([k for k in vertex.arrays if "lat" in k]) == 1


@pytest.mark.parametrize("by_files", [True, False])
def test_searches_beyond_the_kernel(spark, graph, monkeypatch, by_files):
    """Trees, searches for goals and routes, from mapped files of few edges and by parts, are those of the kernel."""
    q = spark.createDataFrame([(i, i % 4, i * 31 % 89) for i in range(30)] + [(98, 3, 3), (99, 4, -5)], "qid long, src long, dst long")
    sources, goals = spark.createDataFrame([(0,), (17,), (10**7,)], "src long"), spark.createDataFrame([(5,), (17,), (10**7,), (10**8,)], "v long")

    def found(metric):
        cost = RoadGraph(graph.vertices, graph.edges).costed()
        trees = [{(r.src, r.v): (r.cost, r.time_s, r.dist_m) for r in paths.from_sources(cost, sources, metric, goals=g).collect()} for g in (None, goals)]
        return *trees, {r.qid: (r.time_s, r.dist_m, r.n_nodes, r.path) for r in paths.routes(cost, graph.vertices, q, metric).collect()}

    for metric in ("time", "distance"):
        kernel = found(metric)
        with monkeypatch.context() as m:
            m.setattr(paths, "KERNEL_EDGES", 0)
            for name, value in (("FILE_EDGES", 1000), ("SHUFFLED_EDGES", 2000), ("EDGES_A_STEP", 40)) if by_files else (("MAPPED_EDGES", 0),):
                m.setattr(paths, name, value)
            m.setattr(paths, "by_parts" if by_files else "Mapped", None)
            far = found(metric)
        for a, b in zip(kernel, far, strict=True):
            assert a.keys() == b.keys() and len(a) > 4
            for k in a:  # of equal paths by the metric either may be found
                at = int(metric == "distance") if len(a[k]) == 4 else 0
                assert b[k][at] == (a[k][at] if a[k][at] is None else pytest.approx(a[k][at]))
                assert len(b[k]) < 4 or b[k][3] is None or (b[k][3][0], b[k][3][-1], len(b[k][3])) == (k % 4 if k < 98 else 3, k * 31 % 89 if k < 98 else 3, b[k][2])


def test_searches_from_many_sources_write_no_labels(spark, monkeypatch):
    """od_matrix and what searches like it, on a graph without near and far: labels of each source, and offers over all edges between parts, went to disk."""
    n = 400
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (10 * n, 2))}
    cost = storage.keep(spark.createDataFrame([(a, b, float(abs(a - b)) + 0.5, 1.0) for a, b in edges], "src long, dst long, dist_m double, time_s double"))
    stops = spark.createDataFrame([(i, 7 * i) for i in range(25)], "i long, vid long")
    want = sorted(paths.matrix(cost, stops, "distance").collect())
    written, keep = [], storage.Store.keep

    def counted(self, df, **old):
        out = keep(self, df, **old)
        written.append(out.count())
        return out

    monkeypatch.setattr(storage.Store, "keep", counted)
    monkeypatch.setattr(paths, "KERNEL_EDGES", 0)
    monkeypatch.setattr(paths, "PART_VERTICES", 20)
    assert [(r.i, r.j, r.dist_mm) for r in sorted(paths.matrix(cost, stops, "distance").collect())] == [(r.i, r.j, r.dist_mm) for r in want]
    assert sum(written) < n


def test_mapped_files_are_not_held(spark, graph, monkeypatch):
    """vrp_plan and what clears its graph: a worker that goes on would keep deleted files on disk."""
    monkeypatch.setattr(paths, "KERNEL_EDGES", 0)
    with storage.passing():
        cost = RoadGraph(graph.vertices, graph.edges).costed()
        paths.from_sources(cost, spark.createDataFrame([(0,)], "src long")).collect()
        folder = cost.mapped.folder
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    for process in filter(str.isdigit, os.listdir("/proc")):
        with contextlib.suppress(OSError), open(f"/proc/{process}/maps", errors="replace") as maps:
            assert folder not in maps.read()
