"""Routes drawn over the map: shared edges, bands, legend, markers. Routes are (route, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.functions import expr
from roadspark.operators import tiles

# Fixed drawing values: bands and casings, legend, reach of clusters and leaders, arrows (shortest segment, place, size, opening, notch, tail).
BAND, STEP, CASING = 4.4, 5.8, 2.8
LEGEND_ROWS = 12
CLUSTER, LEADER = 5e-10, 1e-8
ARROW_SEGMENT, ARROW_AT, ARROW_SIZE, ARROW_OPENING, ARROW_NOTCH, ARROW_TAIL = 28.0, 0.6, 7.0, 0.5, 0.6, 1.8


def route_edges(routes: DataFrame) -> DataFrame:
    """(route, lo, hi) of each distinct edge of a route, without self-loops; hops come from the array itself."""
    hops = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("u"), F.get("path", i).alias("v")))
    rows = routes.filter(F.size("path") > 1).select("route", F.explode(hops).alias("h")).filter("h.u <> h.v")
    return rows.select("route", F.least("h.u", "h.v").alias("lo"), F.greatest("h.u", "h.v").alias("hi")).distinct()


def shared_edges(routes: DataFrame) -> DataFrame:
    return route_edges(routes).groupBy("lo", "hi").agg(F.sort_array(F.collect_list("route")).alias("routes"))


def bands(routes: DataFrame) -> DataFrame:
    """(route, lo, hi, band, casing): the drawn widths, broader for the routes that come first on a shared edge."""
    place = Window.partitionBy("lo", "hi").orderBy("route")
    rows = route_edges(routes).withColumn("order", F.row_number().over(place) - 1).withColumn("n", F.count("*").over(Window.partitionBy("lo", "hi")))
    return rows.select("route", "lo", "hi", (BAND + (F.col("n") - 1 - F.col("order")) * STEP).alias("band"), (BAND + (F.col("n") - 1) * STEP + CASING).alias("casing"))


def draw_order(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Casings, one for each edge, and bands, in the order in which they are drawn."""
    rows = bands(routes)
    return rows.select("lo", "hi", "casing").distinct().orderBy(F.desc("casing"), "lo", "hi"), rows.orderBy(F.desc("band"), "route", "lo", "hi")


def legend(routes: DataFrame) -> DataFrame:
    """The first twelve of routes(route, n_nodes, dist_m, time_s), as text.

    Where the routes carry first_s and last_s, the arrivals at their first and last target, and these differ, both are shown.
    """
    span = F.lit("")
    if {"first_s", "last_s"} <= set(routes.columns):
        text = F.concat(F.lit(" ["), expr.hms(F.col("first_s")), F.lit(" \u2192 "), expr.hms(F.col("last_s")), F.lit("]"))
        span = F.when(F.col("last_s") - F.col("first_s") > 1e-12, text).otherwise("")
    line = F.concat(F.format_string("Route %d: %d nodes | %.1f m | %s", F.col("route") + 1, F.col("n_nodes"), F.col("dist_m"), expr.hms(F.col("time_s"))), span)
    return routes.orderBy("route").limit(LEGEND_ROWS).select("route", line.alias("label"))


def legend_rest(routes: DataFrame) -> DataFrame:
    """(label): a line for the routes that the legend doesn't list; no row where it lists all."""
    more = routes.agg((F.count("*") - LEGEND_ROWS).alias("k")).filter("k > 0")
    return more.select(F.format_string("... and %d more routes", "k").alias("label"))


def visible_segments(routes: DataFrame, points: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """(route, lo, hi) of the distinct edges of routes that lie in a view."""
    at = lambda end, n: points.select(F.col("vid").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return route_edges(routes).join(at("lo", 1), "lo").join(at("hi", 2), "hi").filter(tiles.in_view(*view)).select("route", "lo", "hi")


def numbered_waypoints(waypoints: DataFrame, first: int = 1) -> DataFrame:
    """waypoints(plan, seq, ...) with their number in the plan's order and its letter; the number counts from first."""
    place = F.row_number().over(Window.partitionBy("plan").orderBy("seq"))
    return waypoints.withColumn("number", place + (first - 1)).withColumn("letter", expr.marker_label(place - 1))


def bounds(routes: DataFrame, points: DataFrame) -> DataFrame:
    """(route, min_x, max_x, min_y, max_y) padded by 12 percent, at least 0.0005."""
    rows = routes.select("route", F.explode("path").alias("vid")).join(points, "vid").groupBy("route").agg(*[f(a).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    pad = lambda a: F.greatest((F.col(f"max_{a}") - F.col(f"min_{a}")) * 0.12, F.lit(0.0005))
    return rows.select("route", *[(F.col(f"min_{a}") - pad(a)).alias(f"min_{a}") for a in "xy"], *[(F.col(f"max_{a}") + pad(a)).alias(f"max_{a}") for a in "xy"])


def leaders(waypoints: DataFrame, ends: DataFrame) -> DataFrame:
    """(waypoint, vid): the nearest end node of each waypoint(waypoint, x, y) within 1e-8 squared Mercator units, by cells of that reach."""
    reach = LEADER**0.5
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    probe = waypoints.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("waypoint", F.col("x").alias("px"), F.col("y").alias("py"), (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))
    both = probe.join(ends.select("vid", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")), ["cx", "cy"])
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return both.withColumn("d2", d2).filter(F.col("d2") < LEADER).groupBy("waypoint").agg(F.min(F.struct("d2", "vid")).alias("m")).select("waypoint", "m.vid")


def clusters(ends: DataFrame) -> DataFrame:
    """ends(plan, seq, x, y, depot) with cluster numbers: each end in order joins the first cluster within reach, or begins one. Greedy and ordered, so one task a plan."""

    def run(pdf):
        places: list[list] = []
        out = []
        for x, y, depot in zip(*(pdf.sort_values("seq")[c] for c in ("x", "y", "depot")), strict=True):
            at = next((i for i, p in enumerate(places) if (p[0] - x) ** 2 + (p[1] - y) ** 2 < CLUSTER), None)
            if at is None:
                at = len(places)
                places.append([x, y, False])
            places[at][2] |= bool(depot)
            out.append(at)
        ordered = pdf.sort_values("seq")
        return ordered.assign(cluster=out, cluster_depot=[places[i][2] for i in out])

    kind = T.StructType([*ends.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("cluster_depot", T.BooleanType())])
    return ends.groupBy("plan").applyInPandas(run, kind)


def initial_view(routes: DataFrame, points: DataFrame, zoom: float = 180_000.0, width: int = 1280, height: int = 800) -> DataFrame:
    """(x, y, zoom), one row: the first known node of the first route; where no route has one, all points fit into width x height pixels.

    Where the points have no extent either, the centre is (0, 0) at zoom 18,000.
    """
    rows = routes.select("route", F.posexplode("path").alias("pos", "vid")).join(points, "vid")
    start = rows.agg(F.min_by(F.struct("x", "y"), F.struct("route", "pos")).alias("p"))
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    fit = F.struct(((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), (F.least(F.try_divide(F.lit(float(width)), wide), F.try_divide(F.lit(float(height)), high)) * 0.82).alias("zoom"))
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(18_000.0).alias("zoom"))
    first = F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(float(zoom)).alias("zoom"))
    both = start.join(F.broadcast(tiles.bounds(points)), F.lit(True))  # a row each
    return both.select(F.when(F.col("p").isNotNull(), first).when((wide > 0) & (high > 0), fit).otherwise(none).alias("v")).select("v.*")


def arrows(segments: DataFrame, zoom: float) -> DataFrame:
    """segments(route, x1, y1, x2, y2) on screen, with the points of an arrow: head, two sides, notch and tail; none on short segments."""
    dx, dy = (F.col("x2") - F.col("x1")) * zoom, (F.col("y2") - F.col("y1")) * zoom
    rows = segments.withColumn("dx", dx).withColumn("dy", dy).filter(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) >= ARROW_SEGMENT)
    angle = F.atan2("dy", "dx")
    head = {a: F.col(f"{a}1") * zoom + F.col(f"d{a}") * ARROW_AT for a in "xy"}
    back = lambda a, turn, length: head[a] - (F.cos if a == "x" else F.sin)(angle + turn) * length
    points = {"head": (0.0, 0.0), "left": (ARROW_OPENING, ARROW_SIZE), "right": (-ARROW_OPENING, ARROW_SIZE), "notch": (0.0, ARROW_SIZE * ARROW_NOTCH), "tail": (0.0, ARROW_SIZE * ARROW_TAIL)}
    return rows.select(*segments.columns, *[back(a, *p).alias(f"{n}_{a}") for n, p in points.items() for a in "xy"])
