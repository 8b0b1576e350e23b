"""Column expressions: geometry, speeds, costs, labels. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the road model.
EARTH_M = 6_371_000.0
MAX_SPEED_MPS = 30.5
MIN_SPEED_MPS = 0.1
DEFAULT_KPH = {
    "motorway": 110, "motorway_link": 70, "trunk": 90, "trunk_link": 60, "primary": 80, "primary_link": 50,
    "secondary": 70, "secondary_link": 45, "tertiary": 60, "tertiary_link": 40, "residential": 50, "unclassified": 50,
    "road": 40, "living_street": 10, "service": 20,
}
OTHER_KPH = 50
TIER_MIN_KPH = {4: 90, 3: 70, 2: 50, 1: 30, 0: 0}
LEVEL_ZOOMS = (6000, 14000, 35000, 90000)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def edge_seconds(metres: Column, speed: Column) -> Column:
    return metres / F.greatest(F.coalesce(speed, F.lit(1.0).cast("float")), F.lit(MIN_SPEED_MPS).cast("float")).cast("double")


def heuristic(metres: Column, metric: str, fastest_mps: float = MAX_SPEED_MPS) -> Column:
    """A lower bound of the cost over a great circle; for time at the given highest speed."""
    return metres if metric == "distance" else metres / fastest_mps


def potential(to_goal: Column, from_start: Column) -> Column:
    """Half the difference of two bounds: consistent forwards, and with the other sign backwards."""
    return (to_goal - from_start) * 0.5


def z_order(lat: Column, lon: Column, bits: int = 24) -> Column:
    """The place along a space-filling curve: the bits of both coordinates in turn."""
    y, x = (F.floor((c + half) / (2 * half) * (1 << bits)).cast("long") for c, half in ((lat, 90.0), (lon, 180.0)))

    def spread(c: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(y) * 2 + spread(x)


def degrees_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)


def mercator_x(lon: Column) -> Column:
    return lon * (math.pi / 180.0)


def mercator_y(lat: Column) -> Column:
    return -F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360.0)))


def first_digits(text: Column) -> Column:
    """The first run of digits anywhere; null if there is none."""
    found = F.regexp_extract(text, "([0-9]+)", 1)
    return F.when(found != "", F.try_to_number(found, F.lit("9" * 18)).cast("long"))


def default_kph(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DEFAULT_KPH.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(highway, F.lit(""))), F.lit(OTHER_KPH))


def way_speed(highway: Column, maxspeed: Column) -> Column:
    """Metres a second as a float: the posted number (miles are converted and truncated), else the default of the class."""
    digits = first_digits(maxspeed)
    posted = F.when(maxspeed.contains("mph"), (digits.cast("double") * 1.60934).cast("long")).otherwise(digits)
    kph = F.when(posted > 0, posted).otherwise(default_kph(highway).cast("long"))
    return (kph.cast("double") / 3.6).cast("float")


def direction(oneway: Column) -> Column:
    return F.when(oneway.isin("yes", "1", "true"), 1).when(oneway == "-1", -1).otherwise(0)


def drivable(highway: Column) -> Column:
    return F.coalesce(highway.isin(*DEFAULT_KPH), F.lit(False))


def undirected_key(u: Column, v: Column) -> Column:
    return F.shiftleft(F.least(u, v).cast("long"), 32).bitwiseOR(F.greatest(u, v).cast("long"))


def hms(seconds: Column) -> Column:
    """Hours, minutes and seconds; negative counts as zero, hours are unbounded."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def marker_label(number: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; negative is empty."""
    def grow(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        return F.when(rest < 0, acc).otherwise(F.struct((F.floor(rest / 26) - 1).cast("long").alias("rest"), F.concat(F.char(65 + rest % 26), acc["text"]).alias("text")))

    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, grow, lambda acc: acc["text"])


def speed_or_zero(speed: Column) -> Column:
    return F.coalesce(speed, F.lit(0.0).cast("float"))


def speed_tier(speed: Column) -> Column:
    kph = speed_or_zero(speed) * F.lit(3.6).cast("float")
    out = F.when(speed_or_zero(speed) <= 0, 0)
    for tier, least in TIER_MIN_KPH.items():
        out = out.when(kph >= least, tier)
    return out.otherwise(0)


def tier_min_kph(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TIER_MIN_KPH.items() for x in p]), tier), F.lit(0))


def level_of_zoom(zoom: Column, has_speeds: bool = True) -> Column:
    if not has_speeds:
        return F.lit(4)
    out = F.when(zoom < LEVEL_ZOOMS[0], 0)
    for level, edge in enumerate(LEVEL_ZOOMS[1:], 1):
        out = out.when(zoom < edge, level)
    return out.otherwise(4)


def tier_of_zoom(zoom: Column, has_speeds: bool = True) -> Column:
    return 4 - level_of_zoom(zoom) if has_speeds else F.lit(0)


# Fixed drawing values: width and colour (red, green, blue) by tier, and the two route palettes.
TIER_WIDTHS = {4: 1.35, 3: 1.15, 2: 0.95, 1: 0.78, 0: 0.62}
TIER_COLOURS = {4: (126, 130, 140), 3: (108, 112, 122), 2: (92, 96, 106), 1: (72, 76, 86), 0: (55, 58, 67)}
ROUTE_PALETTE = [
    (74, 144, 226), (80, 190, 170), (156, 120, 210), (230, 145, 72), (105, 185, 110), (214, 105, 135), (88, 170, 205), (218, 190, 85),
    (170, 135, 100), (130, 160, 230),
]
DRAWN_PALETTE = [(74, 144, 226), (64, 196, 178), (155, 119, 212), (241, 159, 84), (112, 173, 96), (226, 116, 116), (91, 170, 216), (226, 198, 74)]
ROUTE_COLOURS, DRAWN_COLOURS = len(ROUTE_PALETTE), len(DRAWN_PALETTE)


def _rgb(colour: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("r", "g", "b"), colour, strict=True)])


def tier_width(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in TIER_WIDTHS.items() for x in p]), F.greatest(F.lit(0), F.least(F.lit(4), tier)))


def tier_colour(tier: Column) -> Column:
    """(r, g, b) of a tier."""
    return F.get(F.array(*[_rgb(TIER_COLOURS[k]) for k in range(5)]), F.greatest(F.lit(0), F.least(F.lit(4), tier)))


def route_colour(index: Column, colours: int = ROUTE_COLOURS) -> Column:
    """The number of a route's colour in its palette."""
    return F.pmod(index, F.lit(colours)).cast("int")


def palette_colour(index: Column, palette: list[tuple[int, int, int]] = ROUTE_PALETTE) -> Column:
    """(r, g, b) of a route in a palette."""
    return F.get(F.array(*[_rgb(c) for c in palette]), route_colour(index, len(palette)))


def six_digits(value: Column) -> Column:
    """A number with six significant digits, without zeros at the end; beyond 0.0001 to 999,999 with an exponent of two digits at least."""
    rounded = F.format_string("%.5e", value)
    exponent = F.substring_index(rounded, "e", -1).cast("int")
    bare = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    plain = bare(rounded.cast("decimal(38,12)").cast("string"))
    power = F.format_string("%s%se%s%02d", bare(F.substring_index(rounded, "e", 1)), F.lit(""), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))
    return F.when(value == 0, "0").when(exponent.between(-4, 5), F.when(plain.contains("."), plain).otherwise(rounded.cast("decimal(38,0)").cast("string"))).otherwise(power)


def to_screen(world: Column, centre: float, zoom: float, size: float) -> Column:
    return (world - centre) * zoom + size / 2


def to_world(screen: Column, centre: float, zoom: float, size: float) -> Column:
    return (screen - size / 2) / zoom + centre


def tile_local(p: Column, origin: float, zoom: float) -> Column:
    return (p - origin) * zoom


def snapped(pixel: Column) -> Column:
    return F.round(pixel) + 0.5


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def passes_min_speed(speed: Column, least_kph: float) -> Column:
    if least_kph <= 0:
        return F.lit(True)
    return F.coalesce(speed * F.lit(3.6).cast("float") >= least_kph, F.lit(False))
