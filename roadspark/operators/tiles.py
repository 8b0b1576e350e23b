"""Spatial index and view queries over the road graph, in Mercator coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import expr

# Fixed values of the index: cells across the longer side, smallest cell; tiles along the longer axis and least tier by level.
GRID_CELLS, LEAST_CELL = 350, 2e-5
LEVELS = [(0, 16, 4), (1, 32, 3), (2, 64, 2), (3, 128, 1), (4, 256, 0)]
MOST_ROADS = 500_000
FILTERS = (0, 30, 50, 70, 90)


def projected(vertex: DataFrame) -> DataFrame:
    return vertex.select("vid", expr.mercator_x(F.col("lon")).alias("x"), expr.mercator_y(F.col("lat")).alias("y"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def _index(value: Column, least: Column, cell: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(count - 1, F.floor((value - least) / cell))).cast("int")


def _grid_box(points: DataFrame) -> DataFrame:
    """One row: the bounds, the cell size and the cells on each axis."""
    b = bounds(points).withColumn("cell", F.greatest(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / GRID_CELLS, F.lit(LEAST_CELL)))
    count = lambda a: F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.col("cell")) + 1
    return b.withColumn("cols", count("x")).withColumn("rows", count("y"))


def grid(points: DataFrame) -> DataFrame:
    """(vid, cell_x, cell_y). The bounds are one row, so they are broadcast."""
    both = points.join(F.broadcast(_grid_box(points)), F.lit(True))
    return both.select("vid", _index(F.col("x"), F.col("min_x"), F.col("cell"), F.col("cols")).alias("cell_x"), _index(F.col("y"), F.col("min_y"), F.col("cell"), F.col("rows")).alias("cell_y"))


def undirected(edges: DataFrame) -> DataFrame:
    """(lo, hi, speed_mps): one road for each pair of ends; the edge that comes first by (src, dst) gives the speed."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.struct("src", "dst", "speed_mps").alias("e"))
    return pairs.groupBy("lo", "hi").agg(F.min("e").alias("e")).select("lo", "hi", F.col("e.speed_mps").alias("speed_mps"))


def roads(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Undirected roads with tier and both ends' coordinates."""
    at = lambda end, n: points.select(F.col("vid").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    out = undirected(edges).withColumn("tier", expr.speed_tier(F.col("speed_mps")))
    return out.join(at("lo", 1), "lo").join(at("hi", 2), "hi").select("lo", "hi", "speed_mps", "tier", "x1", "y1", "x2", "y2")


def tile_runs(road: DataFrame, points: DataFrame) -> DataFrame:
    """(level, tile_y, x_from, x_to, lo, hi, tier): the tiles that a road's bounding box touches, at each level that shows its tier, as a run for each row of tiles."""
    b = bounds(points).withColumn("longer", F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("tiles"), F.lit(t).alias("least")) for k, n, t in LEVELS])
    rows = road.join(F.broadcast(b), F.lit(True)).withColumn("l", F.explode(F.filter(levels, lambda k: k["least"] <= F.col("tier"))))
    size = F.greatest(F.col("longer") / F.col("l.tiles"), F.lit(1e-12))
    span = lambda low, high: F.greatest(F.lit(1), F.ceil((F.col(high) - F.col(low)) / size))
    place = lambda f, a, low, high: _index(f(F.col(f"{a}1"), F.col(f"{a}2")), F.col(low), size, span(low, high))
    rows = rows.select("lo", "hi", "tier", F.col("l.level").alias("level"), *[place(f, a, f"min_{a}", f"max_{a}").alias(n) for n, f, a in (("x_from", F.least, "x"), ("x_to", F.greatest, "x"), ("y_from", F.least, "y"), ("y_to", F.greatest, "y"))])
    return rows.select("level", F.explode(F.sequence("y_from", "y_to")).alias("tile_y"), "x_from", "x_to", "lo", "hi", "tier")


def tile_index(road: DataFrame, points: DataFrame) -> DataFrame:
    """(level, tile_x, tile_y, lo, hi, tier): the runs tile by tile."""
    runs = tile_runs(road, points).withColumn("tile_x", F.explode(F.sequence("x_from", "x_to")))
    return runs.select("level", "tile_x", "tile_y", "lo", "hi", "tier")


def in_view(x1: float, y1: float, x2: float, y2: float) -> Column:
    """Not both ends beyond the same side."""
    out = lambda a, low, high: ((F.col(f"{a}1") < low) & (F.col(f"{a}2") < low)) | ((F.col(f"{a}1") > high) & (F.col(f"{a}2") > high))
    return ~(out("x", x1, x2) | out("y", y1, y2))


def roads_in_view(road: DataFrame, view: tuple[float, float, float, float], zoom: float) -> DataFrame:
    """Roads of a view, weak ones first: those whose tier the zoom shows."""
    least = expr.tier_of_zoom(F.lit(zoom))
    return road.filter(in_view(*view) & (F.col("tier") >= least)).orderBy("tier", "lo", "hi")


def visible_counts(edges: DataFrame, points: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Directed edges in view that leave a vertex of the grid cells it covers: all, and those from each minimum speed on."""
    r = F.broadcast(view_cells(points, view))  # one row
    cells = grid(points).join(r, F.col("cell_x").between(F.col("x_from"), F.col("x_to")) & F.col("cell_y").between(F.col("y_from"), F.col("y_to"))).select("vid")
    at = lambda rows, end, n: rows.select(F.col("vid").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    seen = edges.join(at(points.join(cells, "vid", "left_semi"), "src", 1), "src").join(at(points, "dst", 2), "dst").filter(in_view(*view))
    return seen.agg(F.count("*").alias("from_0"), *[F.count_if(expr.passes_min_speed(F.col("speed_mps"), k)).alias(f"from_{k}") for k in FILTERS[1:]])


def count_from(kph: Column) -> Column:
    """Of visible_counts() the one for a minimum speed: the least filter that isn't below it."""
    out = F.when(kph <= 0, F.col("from_0"))
    for k in FILTERS[1:]:
        out = out.when(kph <= k, F.col(f"from_{k}"))
    return out.otherwise(F.col(f"from_{FILTERS[-1]}"))


def adaptive_min_kph(counts: DataFrame) -> DataFrame:
    """The smallest minimum speed that leaves few enough roads, else the highest."""
    out = F.when(F.col("from_0") <= MOST_ROADS, 0)
    for k in FILTERS[1:]:
        out = out.when(F.col(f"from_{k}") <= MOST_ROADS, k)
    return counts.select(out.otherwise(FILTERS[-1]).alias("min_kph"))


def tier_counts(road: DataFrame) -> DataFrame:
    """(tier, roads, from_tier): roads of each tier, and of it and all above."""
    return road.groupBy("tier").agg(F.count("*").alias("roads")).withColumn("from_tier", F.sum("roads").over(Window.orderBy(F.desc("tier"))))


def view_cells(points: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """(x_from, x_to, y_from, y_to): the cells of the vertex grid that a view covers."""
    at = lambda v, a, n: _index(F.lit(v), F.col(f"min_{a}"), F.col("cell"), F.col(n))
    return _grid_box(points).select(at(view[0], "x", "cols").alias("x_from"), at(view[2], "x", "cols").alias("x_to"), at(view[1], "y", "rows").alias("y_from"), at(view[3], "y", "rows").alias("y_to"))


def range_of_view(box: DataFrame, view: tuple[float, float, float, float], cell: float | Column) -> DataFrame:
    """(x_from, x_to, y_from, y_to): the cells or tiles of size cell that a view covers, clamped to the bounds; box is one row of bounds()."""
    cell = F.lit(cell) if isinstance(cell, float) else cell
    span = lambda a: F.greatest(F.lit(1), F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / cell))
    at = lambda v, a: _index(F.lit(v), F.col(f"min_{a}"), cell, span(a))
    return box.select(at(view[0], "x").alias("x_from"), at(view[2], "x").alias("x_to"), at(view[1], "y").alias("y_from"), at(view[3], "y").alias("y_to"))


def roads_by_tiles(runs: DataFrame, road: DataFrame, tile_range: DataFrame, level: int, view: tuple[float, float, float, float]) -> DataFrame:
    """Roads of a view through the tile runs: those that meet the range at one level, each road once, weak tiers first."""
    r = F.broadcast(tile_range.select(*[F.col(c).alias(f"view_{c}") for c in ("x_from", "x_to", "y_from", "y_to")]))  # one row
    hits = runs.filter(F.col("level") == level).join(r, F.col("tile_y").between(F.col("view_y_from"), F.col("view_y_to")) & (F.col("x_from") <= F.col("view_x_to")) & (F.col("x_to") >= F.col("view_x_from")))
    return hits.select("lo", "hi").distinct().join(road, ["lo", "hi"]).filter(in_view(*view)).orderBy("tier", "lo", "hi")


def tile_range(points: DataFrame, view: tuple[float, float, float, float], level: int) -> DataFrame:
    """(x_from, x_to, y_from, y_to): the tiles of a level of tile_index() that a view covers."""
    tiles = next(n for k, n, _ in LEVELS if k == level)
    longer = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return range_of_view(bounds(points), view, F.greatest(longer / tiles, F.lit(1e-12)))


def draw_roads(runs: DataFrame, road: DataFrame, points: DataFrame, view: tuple[float, float, float, float], zoom: float, has_speeds: bool = True) -> DataFrame:
    """The roads of a view at a zoom, weak tiers first: the zoom picks the level, the view its tiles, and these the roads."""
    level = next((k for k, edge in enumerate(expr.LEVEL_ZOOMS) if zoom < edge), 4) if has_speeds else 4
    least = next(t for k, _, t in LEVELS if k == level)
    return roads_by_tiles(runs.filter(F.col("tier") >= least), road, tile_range(points, view, level), level, view)


def raster_range(box: DataFrame, view: tuple[float, float, float, float], zoom: float, pixels: int = 512) -> DataFrame:
    """(x_from, x_to, y_from, y_to): the raster tiles that a view touches at a zoom, counted from the bounds and clamped to them; no row outside. box is one row of bounds()."""
    size = pixels / zoom
    sides = [("x", view[0], view[2]), ("y", view[1], view[3])]
    touched = [(F.col(f"max_{a}") > F.col(f"min_{a}")) & (F.col(f"max_{a}") >= low) & (F.col(f"min_{a}") <= high) for a, low, high in sides]
    tiles = lambda a: F.greatest(F.lit(1), F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / size))
    at = lambda v, a: _index(F.lit(v), F.col(f"min_{a}"), F.lit(size), tiles(a))
    return box.filter(touched[0] & touched[1]).select(*[at(v, a).alias(f"{a}_{n}") for a, low, high in sides for n, v in (("from", low), ("to", high))])


def raster_extent(box: DataFrame, tile_x: int, tile_y: int, zoom: float, pixels: int = 512) -> DataFrame:
    """(x1, y1, x2, y2) of a raster tile in Mercator coordinates; box is one row of bounds()."""
    size = pixels / zoom
    return box.select(*[(F.col(f"min_{a}") + (k + e) * size).alias(f"{a}{e + 1}") for e in (0, 1) for a, k in (("x", tile_x), ("y", tile_y))])


def cell_index(road: DataFrame, points: DataFrame) -> DataFrame:
    """(cell_x, cell_y, tier, lo, hi): every cell of the vertex grid that a road's bounding box touches."""
    both = road.join(F.broadcast(_grid_box(points)), F.lit(True))
    place = lambda f, a, count: _index(f(F.col(f"{a}1"), F.col(f"{a}2")), F.col(f"min_{a}"), F.col("cell"), F.col(count))
    span = lambda a, count: F.explode(F.sequence(place(F.least, a, count), place(F.greatest, a, count)))
    return both.withColumn("cell_x", span("x", "cols")).withColumn("cell_y", span("y", "rows")).select("cell_x", "cell_y", "tier", "lo", "hi")


def view_tier(index: DataFrame, cell_range: DataFrame, zoom: float) -> DataFrame:
    """(tier, candidates): the least tier from the zoom's on whose cells in view, of it and all tiers above, hold at most MOST_ROADS entries, else the highest.

    index is cell_index(), where a road counts once for each cell; cell_range is one row of range_of_view().
    """
    r = F.broadcast(cell_range)  # one row
    seen = index.join(r, F.col("cell_x").between(F.col("x_from"), F.col("x_to")) & F.col("cell_y").between(F.col("y_from"), F.col("y_to")))
    counts = seen.agg(*[F.count_if(F.col("tier") >= k).alias(f"from_{k}") for k in range(5)])
    levels = F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"from_{k}").alias("candidates")) for k in range(5)])
    light = F.filter(levels, lambda k: (k["tier"] >= expr.tier_of_zoom(F.lit(zoom))) & ((k["candidates"] <= MOST_ROADS) | (k["tier"] == 4)))
    return counts.select(F.get(light, F.lit(0)).alias("k")).select("k.*")


def drawn_roads(road: DataFrame, view: tuple[float, float, float, float], zoom: float, least_kph: float = 0.0, least_pixels: float = 0.0) -> DataFrame:
    """Roads of a view that pass a minimum speed and aren't shorter on screen than a minimum length."""
    along = lambda a: (F.col(f"{a}1") - F.col(f"{a}2")) * zoom
    long = along("x") * along("x") + along("y") * along("y") >= least_pixels * least_pixels
    return road.filter(in_view(*view) & expr.passes_min_speed(F.col("speed_mps"), least_kph) & long).orderBy("tier", "lo", "hi")
