import json
import math
import random

import pytest

from tracktally.operators import spatial, sphere
from tracktally.operators.counts import bounding_box
from tracktally.plans.wrangle import enrich_landfalls
from tracktally.sources import polygons as shapes

SCHEMA = f"poly_id int, sovereignt string, name_long string, continent string, rings {shapes.RINGS}"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


FIXTURE = [
    (1, "S1", "holed", "North America", [box(0, 0, 4, 4), box(1, 1, 1, 1)]),
    (2, "S2", "left", "North America", [box(10, 0, 2, 2)]),
    (3, "S3", "right", "South America", [box(12, 0, 2, 2)]),
    (4, "S4", "island", "Europe", [box(20, 20, 0.1, 0.1)]),
]


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                 "id long, LON double, LAT double")


def test_hole_border_and_island(spark):
    polygons = spark.createDataFrame(FIXTURE, SCHEMA)
    xy = [(0.5, 0.5), (1.5, 1.5), (5, 5), (11, 1), (13, 1), (12, 1), (20.05, 20.05), (2.5, 1.5), (500, 0)]
    out = spatial.contained(points(spark, xy), polygons, ["name_long"], "id")
    got = {r.id: r.name_long for r in out.collect()}
    assert got == {0: "holed", 1: None, 2: None, 3: "left", 4: "right", 5: "left", 6: "island",
                   7: "holed", 8: None}


@pytest.mark.parametrize("crowded", [False, True])
def test_borders_and_corners_belong_to_every_side(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(spatial, "MAX_CELL_EDGES", 0)
    slope = ring((30, 30), (34, 32), (34, 28))
    shared = ring((30, 30), (34, 32), (30, 34))
    polygons = spark.createDataFrame([*FIXTURE, (6, "S6", "east", "Asia", [slope]), (5, "S5", "north", "Asia", [shared])], SCHEMA)
    want = {(12, 1): "left", (12, 0): "left", (12, 2): "left", (10, 0): "left", (11, 2): "left", (14, 1): "right",
            (14, 2): "right", (13, 2): "right", (1, 1): "holed", (1.5, 1): "holed", (2, 1.5): "holed", (1.5, 2): "holed",
            (0, 4): "holed", (2, 4): "holed", (32, 31): "north", (30, 30): "north", (34, 32): "north", (34, 28): "east",
            (32, 29): "east", (34, 30): "east", (14.0001, 1): None, (12, 2.0001): None, (1.5, 1.5): None, (9.9999, 0): None}
    got = {(r.LON, r.LAT): r.name_long for r in spatial.contained(points(spark, list(want)), polygons, ["name_long"], "id").collect()}
    assert got == want


def star(rng, x, y, size, n):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.2, 1) * math.cos(t), y + size * rng.uniform(0.2, 1) * math.sin(t))
            for t in turn]


def crossings(p, rings):
    inside = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


def apart(p, rings):
    best = math.inf
    k = math.cos(math.radians(p[1]))
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            ax, ay, dx, dy = (x1 - p[0]) * k, y1 - p[1], (x2 - x1) * k, y2 - y1
            size = dx * dx + dy * dy
            t = 0.0 if size == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / size))
            best = min(best, math.hypot(ax + t * dx, ay + t * dy))
    return best


@pytest.fixture(scope="module")
def stars(spark):
    rng = random.Random(5)
    made = {i: [star(rng, rng.uniform(-60, 60), rng.uniform(-50, 50), rng.choice([0.3, 3, 15]), 40)]
            for i in range(25)}
    made[3].append(star(rng, 0, 0, 4, 30))
    table = spark.createDataFrame(
        [(i, f"s{i}", f"n{i}", "c", [ring(*r) for r in rings]) for i, rings in made.items()], SCHEMA
    )
    xy = [(rng.uniform(-90, 90), rng.uniform(-70, 70)) for _ in range(600)] + [(-179.0, 85.0), (179.0, -85.0)]
    return made, table, xy


@pytest.mark.parametrize("size", [0.5, 4.0])
@pytest.mark.parametrize("crowded", [False, True])
def test_containment_matches_brute_force(spark, stars, monkeypatch, size, crowded):
    made, table, xy = stars
    if crowded:  # forces the path for crowded cells
        monkeypatch.setattr(spatial, "MAX_CELL_EDGES", -1)
    out = spatial.contained(points(spark, xy), table, ["name_long"], "id", size=size)
    got = {r.id: r.poly_id for r in out.collect()}
    want = {i: min((k for k, rings in made.items() if crossings(p, rings)), default=None)
            for i, p in enumerate(xy)}
    assert got == want


@pytest.mark.parametrize("large_ids", [False, True])
def test_nearest_matches_brute_force(spark, stars, monkeypatch, large_ids):
    made, table, xy = stars
    if large_ids:
        monkeypatch.setattr(spatial, "ID_BITS", 2)
        monkeypatch.setattr(spatial, "MAX_BROADCAST_EDGES", 0)
    out = spatial.nearest(points(spark, xy), table)
    got = {(r.LON, r.LAT): (r.near_id, r.near_distance) for r in out.collect()}
    for p in xy:
        distance, poly = min((round(apart(p, rings), 9), k) for k, rings in made.items())
        assert got[p][0] == poly
        assert got[p][1] == pytest.approx(distance, abs=2e-9)


def test_far_positions_meet_few_edges(spark):
    """All polygons in one region, positions far away, at the poles and on cell borders."""
    rng = random.Random(11)
    made = {i: [star(rng, rng.uniform(-120, -70), rng.uniform(20, 60), rng.choice([0.2, 2]), 30)] for i in range(40)}
    table = spark.createDataFrame(
        [(i, f"s{i}", f"n{i}", "c", [ring(*r) for r in rings]) for i, rings in made.items()], SCHEMA
    )
    xy = [(rng.uniform(0, 180), rng.uniform(-90, 90)) for _ in range(300)]
    xy += [(180.0, 90.0), (-180.0, -90.0), (180.0, 0.0), (100.0, -4.0), (-100.0, 89.999), (-100.0, 90.0)]
    got = {(r.LON, r.LAT): (r.near_id, r.near_distance) for r in spatial.nearest(points(spark, xy), table).collect()}
    for p in xy:
        distance, poly = min((round(apart(p, rings), 9), k) for k, rings in made.items())
        assert got[p][1] == pytest.approx(distance, abs=2e-9)
        assert got[p][0] == poly or round(apart(p, made[got[p][0]]), 8) == round(distance, 8)
    sides = shapes.edges(table)
    far = spatial._far_cells(points(spark, xy[:300]).select("LON", "LAT"), sides, "LON", "LAT")
    met = far.join(spatial._coarse(sides), ["ex", "ey"]).count()
    assert met < 300 * sides.count() / 5
    nothing = spatial.nearest(points(spark, [(1, 2), (100, 80)]), table.limit(0)).collect()
    assert [(r.near_id, r.near_distance) for r in nothing] == [(None, None)] * 2


def test_locate_gives_each_point_one_place(spark):
    polygons = shapes.on_continents(spark.createDataFrame(FIXTURE, SCHEMA), "North America", "South America")
    xy = [(0.5, 0.5), (1.5, 1.5), (9.5, 1), (12, 1), (19, 19), (1.5, 1.5)]
    tracks = points(spark, xy).selectExpr("*", "'L' AS RECORD_ID")
    out = {r.id: (r.COUNTRY, r.LOCATION) for r in enrich_landfalls(tracks, polygons, "id").collect()}
    assert out == {0: ("S1", "holed"), 1: ("S1", "holed"), 2: ("S2", "left"), 3: ("S2", "left"),
                   4: ("S3", "right"), 5: ("S1", "holed")}
    assert bounding_box(tracks, "LON", "LAT", 0, 2, 0, 2).count() == 3


def test_a_place_with_most_rows_is_searched_once(spark):
    polygons = spark.createDataFrame(FIXTURE, SCHEMA)
    xy = [(5.0, 5.0)] * 700 + [(0.5, 0.5)] * 200 + [(30.0 + i, -20.0) for i in range(100)]
    tracks = points(spark, xy).selectExpr("*", "'L' AS RECORD_ID")
    out = enrich_landfalls(tracks, polygons, "id").collect()
    assert sorted(r.id for r in out) == list(range(1000))
    assert {r.LOCATION for r in out if r.id < 900} == {"holed"}
    outside = tracks.filter("id < 700")
    assert spatial.nearest(outside, polygons).count() == 1


def test_readers_agree(spark, tmp_path):
    wkt = tmp_path / "p.csv"
    wkt.write_text('poly_id,sovereignt,name_long,continent,wkt\n'
                   '0,S,N,C,"POLYGON ((0 0, 4 0, 4 4, 0 4), (1 1, 2 1, 2 2, 1 2))"\n'
                   '1,S,M,C,"MULTIPOLYGON (((9 9, 10 9, 10 10)), ((-1 -1.5, 0 -1, 0 0)))"\n')
    geo = tmp_path / "p.json"
    rings = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]
    parts = [[[[9, 9], [10, 9], [10, 10]]], [[[-1, -1.5], [0, -1], [0, 0]]]]
    geo.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"sovereignt": "S", "name_long": n, "continent": "C"},
         "geometry": {"type": t, "coordinates": c}}
        for n, t, c in (("N", "Polygon", rings), ("M", "MultiPolygon", parts))]}))
    a = shapes.read_wkt_table(spark, str(wkt))
    b = shapes.read_geojson(spark, str(geo))
    assert sorted(shapes.edges(a).collect()) == sorted(shapes.edges(b).collect())
    assert shapes.edges(a).count() == 14
    corners = shapes.outline(b).filter("poly_id = 1").orderBy("group", "ord").collect()
    assert [(r.group, r.ord, r.long, r.lat) for r in corners][3] == (1, 0, -1.0, -1.5)


def test_repeated_row_ids_do_not_change_the_answer(spark, monkeypatch):
    square = spark.sql("SELECT 1 AS poly_id, array(array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 4D, 'lat', 0D), "
                       "named_struct('lon', 4D, 'lat', 4D), named_struct('lon', 0D, 'lat', 4D))) AS rings, 'one' AS name")
    points = spark.createDataFrame([(7, 1.5, 1.5), (7, 2.5, 2.5), (8, 9.0, 9.0), (8, None, 1.0)], "id int, LON double, LAT double")

    def answers():
        out = spatial.contained(points, square, ["name"], "id").select("id", "LON", "poly_id", "name").collect()
        return sorted(map(tuple, out), key=str)

    packed = answers()
    assert [r[2] for r in packed].count(1) == 2 and len(packed) == 4
    monkeypatch.setattr(spatial, "MAX_CELL_EDGES", 0)
    assert answers() == packed


def test_many_searched_positions_give_the_same_answer(spark, monkeypatch):
    two = spark.sql("SELECT id AS poly_id, array(array(named_struct('lon', 10D * id, 'lat', 0D), named_struct('lon', 10D * id + 4, 'lat', 0D), "
                    "named_struct('lon', 10D * id + 4, 'lat', 4D), named_struct('lon', 10D * id, 'lat', 4D))) AS rings, "
                    "concat('n', id) AS name FROM (SELECT explode(array(0, 1)) AS id)")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 6.0, 1.0), (3, 9.0, 1.0), (3, 9.0, 1.0), (4, None, 1.0)],
                                   "id int, LON double, LAT double")

    def answers():
        return sorted(map(tuple, spatial.locate(points, two, {"name": "PLACE"}, "id").collect()), key=str)

    few = answers()
    assert [r[3] for r in few] == ["n0", "n0", "n1", "n1", None]
    monkeypatch.setattr(spatial, "MAX_NEAR", 0)
    assert answers() == few


def on_globe(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return (math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b))


def steps_to_arc(p, a, b, n=4000):
    """Degrees to the nearest of many places of an arc."""
    turn = math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)))))
    best = 9.0
    for i in range(n + 1):
        f, g = (math.sin((1 - i / n) * turn), math.sin(i / n * turn)) if turn else (1, 0)
        q = [(f * x + g * y) / (math.sin(turn) if turn else 1) for x, y in zip(a, b)]
        best = min(best, math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(p, q))))))
    return math.degrees(best)


def test_great_circles_wrap_and_pass_the_pole(spark):
    shapes_ = [(1, "S", "west", "X", [box(170, 10, 9, 5)]), (2, "S", "east", "X", [box(-175, 10, 9, 5)]),
               (3, "S", "north", "X", [ring((0, 80), (120, 80), (240, 80))]), (4, "S", "far", "X", [box(20, -40, 30, 1)])]
    polygons = spark.createDataFrame(shapes_, SCHEMA)
    xy = [(179.9, 12), (-179.9, 12), (-176, 11), (181, 12), (10, 85), (-160, 89.9), (35, -39), (35, -60), (60, 70), (0, -90), (35, -34)]
    rows = points(spark, xy + xy)
    got = {(r.LON, r.LAT): (r.near_id, r.near_distance) for r in sphere.nearest_on_sphere(rows, polygons).collect()}
    assert len(got) == len(xy)
    for lon, lat in xy:
        apart_ = {}
        for i, _, _, _, rings in shapes_:
            vs = [on_globe(v["lon"], v["lat"]) for v in rings[0]]
            apart_[i] = min(steps_to_arc(on_globe(lon, lat), a, b) for a, b in zip(vs, vs[1:] + vs[:1]))
        near, distance = got[float(lon), float(lat)]
        assert near == min(apart_, key=apart_.get) and distance == pytest.approx(apart_[near], abs=2e-3)
    assert got[179.9, 12.0][0] == 1 and got[-179.9, 12.0][0] == 1 and got[-179.9, 12.0][1] < 1.1
    odd = spark.createDataFrame([(None, 1.0), (5.0, 91.0), (5.0, None)], "LON double, LAT double")
    assert all(r.near_id is None for r in sphere.nearest_on_sphere(odd, polygons).collect())
    assert [r.near_id for r in sphere.nearest_on_sphere(rows, polygons.limit(0)).collect()] == [None] * len(xy)
    out = spatial.locate(points(spark, xy[:2]), polygons, {"name_long": "place"}, "id", sphere=True)
    assert [r.place for r in out.collect()] == ["west", "west"]
