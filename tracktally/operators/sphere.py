"""Nearest polygon by great-circle distance, for positions and polygons anywhere on the globe.

Positions and edges are unit vectors, so neither the antimeridian nor a pole is a border, and
longitudes may run past 180. Edges are great-circle arcs of less than half a turn. They lie in
cells of a cube grid by their middle; a cell has the box of its arcs. A position's nearest edge
can only be in a cell whose least distance is not above the smallest of all largest ones. The
list of cells, those of a sphere's surface at most, is cut down once for each cell with
positions and again for each position; what is left meets its edges by the cell's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.session import written_once
from tracktally.sources.polygons import edges

#: Side of a cell, a twentieth of the globe's radius: some 13,000 cells touch the surface.
SIDE = 0.05
MAX_BROADCAST_EDGES = 1_000_000
AXES = ("x", "y", "z")
#: Distances are rounded to so many digits of a degree; a bound leaves room for that.
DIGITS, ROOM = 9, 1e-9


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    along, up = F.radians(lon), F.radians(lat)
    return [F.cos(up) * F.cos(along), F.cos(up) * F.sin(along), F.sin(up)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle(a: list[Column], b: list[Column]) -> Column:
    """Between two unit vectors; by the chord, which keeps the digits of short ones."""
    apart = [x - y for x, y in zip(a, b, strict=True)]
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(dot(apart, apart)) / 2))


def arc_distance(p: list[Column], a: list[Column], b: list[Column], n: list[Column], across: list[Column]) -> Column:
    """Degrees from a unit vector to the arc from a to b, with normal ``n`` and ``across`` = (n x a, b x n)."""
    beside = (dot(p, across[:3]) > 0) & (dot(p, across[3:]) > 0)
    foot = F.asin(F.least(F.lit(1.0), F.abs(dot(p, n))))
    return F.round(F.degrees(F.when(beside, foot).otherwise(F.least(angle(p, a), angle(p, b)))), DIGITS)


def arcs(polygons: DataFrame) -> DataFrame:
    """Edges as unit vectors, with what the distance needs, their boxes and cells."""
    named = {f"a{k}": v for k, v in zip(AXES, unit_vector(F.col("x1"), F.col("y1")), strict=True)}
    named |= {f"b{k}": v for k, v in zip(AXES, unit_vector(F.col("x2"), F.col("y2")), strict=True)}
    ends = edges(polygons).filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    ends = ends.select("poly_id", *(v.alias(k) for k, v in named.items()))
    a, b = ([F.col(s + k) for k in AXES] for s in "ab")
    normal = cross(a, b)
    length = F.sqrt(dot(normal, normal))
    ends = ends.withColumns({f"n{k}": F.when(length > 0, v / length).otherwise(0.0) for k, v in zip(AXES, normal, strict=True)})
    n = [F.col("n" + k) for k in AXES]
    # how far an arc rises over its chord widens the box of its ends
    middle = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    rise = 1 - F.least(F.lit(1.0), F.sqrt(dot(middle, middle)))
    made = {f"u{i}": v for i, v in enumerate([*cross(n, a), *cross(b, n)])}
    for k, x, y, m in zip(AXES, a, b, middle, strict=True):
        made |= {f"low{k}": F.least(x, y) - rise, f"high{k}": F.greatest(x, y) + rise, f"c{k}": F.floor(m / SIDE).cast("int")}
    return ends.withColumns(made)


def _gap(c: Column, low: list[Column], high: list[Column]) -> Column:
    """Least squared distance of a cell's box and another."""
    parts = [F.greatest(F.lit(0.0), c[f"low{k}"] - h, l - c[f"high{k}"]) for k, l, h in zip(AXES, low, high, strict=True)]
    return dot(parts, parts)


def _reach(c: Column, low: list[Column], high: list[Column]) -> Column:
    """Largest squared distance of two boxes."""
    parts = [F.greatest(F.abs(c[f"high{k}"] - l), F.abs(h - c[f"low{k}"])) for k, l, h in zip(AXES, low, high, strict=True)]
    return dot(parts, parts)


def _able(cells: Column, low: list[Column], high: list[Column]) -> Column:
    bound = F.sqrt(F.array_min(F.transform(cells, lambda c: _reach(c, low, high)))) + ROOM
    # as a lambda's variable the bound is computed once, not for each cell
    kept = F.transform(F.array(bound), lambda b: F.filter(cells, lambda c: F.sqrt(_gap(c, low, high)) <= b))
    return F.get(kept, F.lit(0))


def nearest_on_sphere(positions: DataFrame, polygons: DataFrame, lon: str = "LON", lat: str = "LAT") -> DataFrame:
    """Nearest polygon of each distinct position: ``lon, lat, near_id, near_distance`` in degrees of arc.

    Distance is to the outline, also for positions inside. Equally near polygons: the least id.
    Positions without a longitude or a latitude on the globe, and all where there is no edge,
    have NULL.
    """
    sides = written_once(arcs(polygons), "arcs")
    key = [f"c{k}" for k in AXES]
    boxes = [f(f"{s}{k}").alias(f"{s}{k}") for s, f in (("low", F.min), ("high", F.max)) for k in AXES]
    cells = sides.groupBy(*key).agg(*boxes)
    listed = cells.agg(F.collect_list(F.struct(*cells.columns))).scalar()  # cells of a sphere's surface
    p = [F.col(f"p{k}") for k in AXES]
    valid = F.col(lat).between(-90, 90) & F.col(lon).between(-360, 360)
    vectors = {f"p{k}": F.when(valid, v) for k, v in zip(AXES, unit_vector(F.col(lon), F.col(lat)), strict=True)}
    placed = positions.select(lon, lat).distinct().withColumns(vectors)
    placed = placed.withColumns({f"g{k}": F.floor(v / SIDE).cast("int") for k, v in zip(AXES, p, strict=True)})
    grid = [f"g{k}" for k in AXES]
    low, high = [F.col(g) * SIDE for g in grid], [(F.col(g) + 1) * SIDE for g in grid]
    places = placed.filter("gx is not null").select(*grid).distinct().withColumn("all", listed)
    places = places.select(*grid, _able(F.col("all"), low, high).alias("near"))
    chosen = F.transform(_able(F.col("near"), p, p), lambda c: F.struct(*(c[k].alias(k) for k in key)))
    met = placed.join(places, grid, "left").select(lon, lat, *(f"p{k}" for k in AXES), F.explode_outer(chosen).alias("e"))
    small = sides.limit(MAX_BROADCAST_EDGES + 1).count() <= MAX_BROADCAST_EDGES
    met = met.select(lon, lat, *(f"p{k}" for k in AXES), *(F.col(f"e.{k}").alias(k) for k in key))
    both = met.join(F.broadcast(sides) if small else sides.hint("merge"), key, "left")
    side = lambda s: [F.col(s + k) for k in AXES]
    distance = arc_distance(p, side("a"), side("b"), side("n"), [F.col(f"u{i}") for i in range(6)])
    best = F.min(F.when(F.col("poly_id").isNotNull(), F.struct(distance.alias("d"), "poly_id"))).alias("best")
    return both.groupBy(lon, lat).agg(best).select(
        lon, lat, F.col("best.poly_id").alias("near_id"), F.col("best.d").alias("near_distance")
    )
