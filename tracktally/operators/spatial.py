"""Point-in-polygon and nearest-polygon lookup through grid cells.

Containment uses planar longitude/latitude and the even-odd rule; a point on an edge or
corner, of a hole too, meets the polygon, and one that several polygons meet goes to the
smallest id. Distances are
planar in degrees after scaling longitudes by the cosine of the point's latitude.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.operators.sphere import nearest_on_sphere
from tracktally.session import written_once
from tracktally.sources.polygons import edges

MAX_CELLS = 200_000
MAX_PACKED_EDGES = 2_000_000
MAX_CELL_EDGES = 4_096
MAX_BROADCAST_EDGES = 1_000_000
MAX_NEAR = 200_000
ID_BITS = 24
COARSE = 4.0  # degrees of the cells that far positions choose from


def on_globe(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the eastward ray from the point cross this edge? Never where it is level."""
    return ((y1 > py) != (y2 > py)) & (px < x1 + F.try_divide((py - y1) * (x2 - x1), y2 - y1))


def _touches(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Is the point on this edge?"""
    boxed = px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    return boxed & ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1))


def edge_cells(edge_rows: DataFrame, size: float) -> DataFrame:
    """Edges that can decide containment, keyed by cell.

    A cell gets the edges of its latitude band that end in or east of it; a level edge,
    which matters to the points on it only, goes to the cells it passes.
    ``spans`` marks edges wholly east of the cell that cover the band: every point
    of the cell crosses them, so a count is enough. ``size`` is a power of two.
    """
    sides = edge_rows
    west = sides.groupBy("poly_id").agg(
        F.floor(F.min(F.least("x1", "x2")) / size).cast("int").alias("west")
    )
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = sides.join(west, "poly_id").withColumn(
        "cy", F.explode(F.sequence(cell_of(low, size), cell_of(high, size)))
    )
    keyed = banded.withColumn(
        "cx", F.explode(F.sequence(
            F.when(low == high, cell_of(F.least("x1", "x2"), size)).otherwise(F.col("west")),
            cell_of(F.greatest("x1", "x2"), size),
        ))
    )
    spans = (
        (F.least("x1", "x2") >= (F.col("cx") + 1) * size)
        & (low <= F.col("cy") * size)
        & (high >= (F.col("cy") + 1) * size)
    )
    return keyed.withColumn("spans", spans).drop("west")


def packed_cells(keyed: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per cell with its candidate polygons, their edges and attributes."""
    per_polygon = keyed.groupBy("cx", "cy", "poly_id").agg(
        (F.count_if("spans") % 2).cast("int").alias("base"),
        F.collect_list(F.when(~F.col("spans"), F.struct("x1", "y1", "x2", "y2"))).alias("sides"),
    ).filter("base = 1 OR size(sides) > 0")
    others = [c for c in attributes.columns if c != "poly_id"]
    return per_polygon.join(attributes, "poly_id").groupBy("cx", "cy").agg(
        F.collect_list(F.struct("poly_id", *others, "base", "sides")).alias("candidates")
    )


def contained(points: DataFrame, polygons: DataFrame, attributes: list[str], row_id: str,
              lon: str = "LON", lat: str = "LAT", size: float = 1.0,
              sides: DataFrame | None = None) -> DataFrame:
    """Left join of points to the polygon that holds them: adds ``poly_id`` and attributes.

    The cell table is measured first. While it is small and no cell is crowded, each
    point looks its cell up once and decides in the same row, without a shuffle of
    the points. Otherwise distinct positions meet edge rows on the cell key, parity is
    an aggregation, and points look their position up; the answer is the same, also
    where ``row_id`` repeats. ``sides`` may hold saved edge rows.
    """
    keyed = edge_cells(edges(polygons) if sides is None else sides, size)
    # a polygon that covers a cell without an edge in it is a candidate too
    load = keyed.groupBy("cx", "cy", "poly_id").agg(
        F.greatest(F.count_if(~F.col("spans")), F.lit(1)).alias("n")
    ).groupBy("cx", "cy").agg(F.sum("n").alias("n"))
    cells, total, most = load.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)),
                                  F.coalesce(F.max("n"), F.lit(0))).first()
    px, py = F.col(lon), F.col(lat)
    valid = on_globe(px, py)
    placed = points.withColumns({
        "cx": F.when(valid, cell_of(px, size)), "cy": F.when(valid, cell_of(py, size)),
    })
    names = polygons.select("poly_id", *attributes)
    if most <= MAX_CELL_EDGES:
        table = packed_cells(keyed, names)
        small = cells <= MAX_CELLS and total <= MAX_PACKED_EDGES
        # the planner's estimate ignores the exploded cells, so the choice is made here
        table = F.broadcast(table) if small else table.hint("merge")
        def inside(c: Column) -> Column:
            crossings = F.aggregate(
                c["sides"], c["base"],
                lambda n, e: n + _crosses(px, py, e["x1"], e["y1"], e["x2"], e["y2"]).cast("int"),
            )
            on_edge = F.exists(c["sides"], lambda e: _touches(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
            return (crossings % 2 == 1) | on_edge

        kept = ["poly_id", *attributes]
        hit = F.array_min(F.transform(
            F.filter("candidates", inside), lambda c: F.struct(*[c[k].alias(k) for k in kept])
        ))
        return (
            placed.join(table, ["cx", "cy"], "left")
            .withColumn("__hit", hit)
            .withColumns({k: F.col("__hit")[k] for k in kept})
            .drop("cx", "cy", "candidates", "__hit")
        )
    met = placed.filter(valid).select(lon, lat, "cx", "cy").distinct().join(keyed, ["cx", "cy"])
    edge = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    crossing = F.col("spans") | _crosses(px, py, *edge)
    holders = (
        met.groupBy(lon, lat, "poly_id")
        .agg(F.count_if(crossing).alias("n"), F.count_if(_touches(px, py, *edge)).alias("on_edge"))
        .filter((F.col("n") % 2 == 1) | (F.col("on_edge") > 0))
        .groupBy(lon, lat).agg(F.min("poly_id").alias("poly_id"))
        .join(names, "poly_id")
    )
    return placed.drop("cx", "cy").join(holders, [lon, lat], "left").select(
        *points.columns, "poly_id", *attributes
    )


def _distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    scale = F.cos(F.radians(py))
    ax, ay = (x1 - px) * scale, y1 - py
    dx, dy = (x2 - x1) * scale, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, -(ax * dx + ay * dy) / length).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.round(F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)), 9)


def nearest(positions: DataFrame, polygons: DataFrame, lon: str = "LON", lat: str = "LAT",
            radii: tuple[float, ...] = (1.0, 4.0, 16.0), sides: DataFrame | None = None) -> DataFrame:
    """Nearest polygon of each distinct position: ``lon, lat, near_id, near_distance``.

    Each round compares the positions still open with the edges whose box, widened by the
    radius, meets the position's cell. A best distance within the radius is final, since
    every edge left out lies farther. What is open after the last radius, far from all
    edges or near a pole, meets only the edges of coarse cells that can hold its nearest
    one. Edges and the answers of each round are saved once.
    """
    sides = written_once(edges(polygons), "edges") if sides is None else sides
    px, py = F.col(lon), F.col(lat)
    boxes = [F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")]

    def reach(low: Column, high: Column, r: float) -> Column:
        return F.sequence(cell_of(low - r, r), cell_of(high + r, r))

    def copies(r: float) -> Column:
        return F.sum(F.size(reach(*boxes[:2], r)).cast("bigint") * F.size(reach(*boxes[2:], r)))

    facts = sides.agg(
        F.min("poly_id").alias("low"), F.max("poly_id").alias("high"), F.count(F.lit(1)).alias("n"),
        *[copies(r).alias(f"r{i}") for i, r in enumerate(radii)],
    ).first()
    compact = (facts["low"] or 0) >= 0 and (facts["high"] or 0) < 1 << ID_BITS

    def code(distance: Column) -> Column:
        """Distance, then id, as one comparable value; a long keeps hash aggregation."""
        if compact:
            nano = F.round(distance * 1e9).cast("bigint")
            return F.shiftleft(nano, ID_BITS) + F.col("poly_id")
        return F.struct(distance.alias("d"), F.col("poly_id").alias("id"))

    def distance_of(best: Column) -> Column:
        return F.shiftright(best, ID_BITS) / 1e9 if compact else best["d"]

    def id_of(best: Column) -> Column:
        return best.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int") if compact else best["id"]

    def sized(keyed: DataFrame, rows: int | None) -> DataFrame:
        """A broadcast keeps the positions where they are."""
        return F.broadcast(keyed) if (rows or 0) <= MAX_BROADCAST_EDGES else keyed.hint("merge")

    def closest(placed: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
        found = code(_distance(px, py, *[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
        best = F.min(F.when(F.col("poly_id").isNotNull(), found)).alias("__best")
        return placed.join(keyed, on, "left").groupBy(lon, lat).agg(best)

    waiting = positions.select(lon, lat).distinct()
    final = []
    for i, radius in enumerate(radii):
        keyed = sides.withColumn("cx", F.explode(reach(*boxes[:2], radius)))
        keyed = keyed.withColumn("cy", F.explode(reach(*boxes[2:], radius)))
        placed = waiting.withColumns({"cx": cell_of(px, radius), "cy": cell_of(py, radius)})
        state = closest(placed, sized(keyed, facts[f"r{i}"]), ["cx", "cy"])
        within = F.coalesce(distance_of(F.col("__best")) <= radius * F.cos(F.radians(py)), F.lit(False))
        # saved, as its two parts go different ways
        state = written_once(state.withColumn("__open", ~within), "round")
        final.append(state.filter(~F.col("__open")).drop("__open"))
        waiting = state.filter("__open").select(lon, lat)
        if waiting.isEmpty():
            break
    else:
        coarse = sized(_coarse(sides), facts["n"])
        final.append(closest(_far_cells(waiting, sides, lon, lat), coarse, ["ex", "ey"]))
    return reduce(DataFrame.unionByName, final).select(
        lon, lat, id_of(F.col("__best")).alias("near_id"),
        distance_of(F.col("__best")).alias("near_distance"),
    )


def _coarse(sides: DataFrame) -> DataFrame:
    """Edges with the coarse cell of their first end; what is off the globe goes to a border cell."""
    def cell(value: str, most: int) -> Column:
        return F.greatest(F.lit(-most), F.least(F.lit(most), cell_of(F.col(value), COARSE)))

    return sides.withColumns({"ex": cell("x1", int(180 / COARSE)), "ey": cell("y1", int(90 / COARSE))})


def _far_cells(waiting: DataFrame, sides: DataFrame, lon: str, lat: str) -> DataFrame:
    """Each position with the coarse cells whose edges can be nearest, one row per cell.

    A coarse cell has the box of its edges and the box of their first ends: no edge is
    nearer than the one, at least one is as near as the far corner of the other. The list
    of cells, at most 91 x 45 whatever the data, is one value; it is cut down once per
    place of ``COARSE`` by one degree, then for the position itself.
    """
    cells = _coarse(sides).groupBy("ex", "ey").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
        F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"),
        F.min("x1").alias("end_x"), F.max("x1").alias("end_xx"),
        F.min("y1").alias("end_y"), F.max("y1").alias("end_yy"),
    )
    listed = cells.agg(F.collect_list(F.struct(*cells.columns)).alias("c")).scalar()

    def able(candidates: Column, x: Column, xx: Column, y: Column, yy: Column) -> Column:
        """Cells whose least distance from the box is not above the smallest of the largest."""
        ends = [F.cos(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), v)))) for v in (y, yy)]
        narrow, wide = F.least(*ends), F.greatest(*ends)  # no box lies on both sides of the equator

        def nearest_end(c: Column) -> Column:
            dx = F.greatest(F.abs(c["end_xx"] - x), F.abs(xx - c["end_x"])) * wide
            dy = F.greatest(F.abs(c["end_yy"] - y), F.abs(yy - c["end_y"]))
            return F.hypot(dx, dy)

        def apart(c: Column) -> Column:
            dx = F.greatest(F.lit(0.0), c["west"] - xx, x - c["east"]) * narrow
            dy = F.greatest(F.lit(0.0), c["south"] - yy, y - c["north"])
            return F.hypot(dx, dy)

        bound = F.array_min(F.transform(candidates, nearest_end)) + 1e-6  # distances are rounded
        return F.filter(candidates, lambda c: apart(c) <= bound)

    px, py = F.col(lon), F.col(lat)
    placed = waiting.withColumns({"gx": cell_of(px, COARSE), "gy": cell_of(py, 1.0)})
    x, y = F.col("gx") * COARSE, F.col("gy").cast("double")
    places = placed.select("gx", "gy").distinct().withColumn("all", listed).select(
        "gx", "gy", able(F.col("all"), x, x + COARSE, y, y + 1.0).alias("near")
    )
    chosen = able(F.col("near"), px, px, py, py)
    return (
        placed.join(places, ["gx", "gy"], "left")
        .select(lon, lat, F.explode_outer(F.transform(chosen, lambda c: F.struct(c["ex"], c["ey"]))).alias("e"))
        .select(lon, lat, "e.*")
    )


def locate(points: DataFrame, polygons: DataFrame, attributes: dict[str, str], row_id: str,
           lon: str = "LON", lat: str = "LAT", size: float = 1.0, sphere: bool = False) -> DataFrame:
    """Containing polygon's attributes, else the nearest polygon's; one row per point.

    ``sphere`` measures great-circle distances, which wrap at 180 degrees.

    Only positions without a container are searched, each distinct position once,
    so a place that holds many rows costs one search. Points with a container are
    not moved for the answers of the others.
    """
    kept = list(attributes)
    sides = written_once(edges(polygons), "edges")
    inside = contained(points, polygons, kept, row_id, lon, lat, size, sides)
    outside = inside.filter(F.col("poly_id").isNull() & on_globe(F.col(lon), F.col(lat)))
    near = nearest_on_sphere(outside, polygons, lon, lat) if sphere else nearest(outside, polygons, lon, lat, sides=sides)
    names = polygons.select(
        F.col("poly_id").alias("near_id"), *[F.col(k).alias(f"near_{k}") for k in kept]
    )
    # saved, so that the search runs once and its size is known
    named = written_once(near.join(names, "near_id").drop("near_id", "near_distance"), "near")
    if named.limit(MAX_NEAR + 1).count() <= MAX_NEAR:
        answer = {new: F.coalesce(k, f"near_{k}") for k, new in attributes.items()}
        return inside.join(F.broadcast(named), [lon, lat], "left").select(
            *points.columns, *[a.alias(new) for new, a in answer.items()]
        )
    held = inside.filter(F.col("poly_id").isNotNull()).select(
        *points.columns, *[F.col(k).alias(new) for k, new in attributes.items()]
    )
    searched = inside.filter(F.col("poly_id").isNull()).join(named, [lon, lat], "left").select(
        *points.columns, *[F.col(f"near_{k}").alias(new) for k, new in attributes.items()]
    )
    return held.unionByName(searched)
