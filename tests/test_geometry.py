import math
import random

import pytest
from pyspark.sql import functions as F

from aquila.functions.geometry import Shape, area, contains, distance, from_region, intersects, stored
from aquila.functions.stcs import parse_region, parse_system, system_pattern


def dist(a, b):
    (l1, b1), (l2, b2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((b2 - b1) / 2) ** 2 + math.cos(b1) * math.cos(b2) * math.sin((l2 - l1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def S(kind, *xs):
    return Shape(kind, tuple(f"({float(x)!r}D)" for x in xs))


def ask(spark, sql):
    return list(spark.sql("SELECT " + ", ".join(f"({s}) AS c{i}" for i, s in enumerate(sql))).first())


def test_regions_as_text():
    for text in ("POSITION ICRS 1.0 2.0", "CIRCLE FK5 GEOCENTER 1.0 -2.0 0.5", "NOT (BOX 1.0 2.0 3.0 4.0)", "UNION ICRS (POLYGON 0.0 0.0 1.0 0.0 0.0 1.0 INTERSECTION (CIRCLE 1.0 2.0 3.0 CIRCLE 1.0 2.0 4.0))"):
        assert parse_region(text.lower()).text() == text
    assert parse_region("circle 1 2 3").text(True) == "CIRCLE UNKNOWNFRAME UNKNOWNREFPOS SPHERICAL2 1.0 2.0 3.0"
    for wrong in ("", "BLOB 1 2", "CIRCLE 1 2", "POLYGON 1 2 3 4", "UNION (CIRCLE 1 2 3)", "NOT CIRCLE 1 2 3", "CIRCLE 1 2 3 4", "POSITION ICRS FK4 1 2"):
        with pytest.raises(ValueError):
            parse_region(wrong)


def test_systems():
    assert parse_system("icrs topocenter").text() == "ICRS TOPOCENTER" and parse_system("").text(True).count("UNKNOWN") == 2
    for wrong in ("GEOCENTER ICRS", "ICRS CARTESIAN2", "x"):
        with pytest.raises(ValueError):
            parse_system(wrong)
    assert system_pattern("(fk4|fk5) GEOCENTER *").match("FK5 GEOCENTER SPHERICAL2") and not system_pattern("ICRS").match("FK4 UNKNOWNREFPOS SPHERICAL2")
    with pytest.raises(ValueError):
        system_pattern("HOME * *")


def test_pairs_of_shapes(spark):
    yes = [
        contains(S("point", 10, 20), S("circle", 11, 20, 1)), contains(S("point", 359, 1), S("box", 1, 0, 6, 4)), contains(S("circle", 10, 10, 1), S("circle", 10, 12, 3)), contains(S("circle", 0, 0, 1), S("box", 0, 0, 4, 4)),
        contains(S("box", 0, 0, 2, 2), S("circle", 0, 0, 2)), contains(S("box", 359, 0, 2, 2), S("box", 0, 0, 6, 6)), contains(S("circle", 30, 30, 2), S("polygon", 0, 0, 90, 0, 0, 90)), contains(S("polygon", 1, 1, 2, 1, 2, 2), S("polygon", 0, 0, 9, 0, 0, 9)),
        intersects(S("circle", 0, 0, 2), S("box", 4, 0, 5, 2)), intersects(S("circle", 45, -1, 2), S("polygon", 0, 0, 90, 0, 0, 90)), intersects(S("polygon", -1, 1, 5, 1, 5, 2), S("polygon", 0, 0, 9, 0, 0, 9)), intersects(S("box", 358, 0, 6, 2), S("box", 3, 0, 6, 2)),
        intersects(S("polygon", 0, 0, 2, 0, 0, 2), S("box", 0, 0, 1, 1)), contains(S("point", 5, 5), from_region(parse_region("INTERSECTION (CIRCLE 5 5 3 NOT (CIRCLE 8 5 1))"))), contains(S("point", 0, 5), S("polygon", 0, 0, 90, 0, 0, 90)),
    ]
    no = [
        contains(S("point", 10, 20), S("circle", 12, 20, 1)), contains(S("circle", 10, 10, 2), S("circle", 10, 12, 3)), contains(S("circle", 0, 0, 3), S("box", 0, 0, 4, 4)), contains(S("box", 0, 0, 4, 4), S("circle", 0, 0, 2)), contains(S("circle", 1, 1, 2), S("polygon", 0, 0, 90, 0, 0, 90)),
        contains(S("circle", 0, 0, 1), S("point", 0, 0)), intersects(S("circle", 0, 0, 1), S("box", 4, 0, 5, 2)), intersects(S("circle", 45, -3, 2), S("polygon", 0, 0, 90, 0, 0, 90)), intersects(S("box", 0, 0, 2, 2), S("box", 3, 0, 2, 2)), contains(S("polygon", 1, 1, 12, 1, 2, 2), S("polygon", 0, 0, 9, 0, 0, 9)),
        contains(S("point", 225, -45), S("polygon", 0, 0, 90, 0, 0, 90)), contains(S("point", 8, 5), from_region(parse_region("INTERSECTION (CIRCLE 5 5 4 NOT (CIRCLE 8 5 1))"))),
    ]
    assert ask(spark, yes) == [True] * len(yes)
    assert ask(spark, no) == [False] * len(no)


def test_points_in_polygons_against_half_spaces(spark):
    r = random.Random(4)
    corners = [(350, -10), (20, -12), (30, 25), (5, 40), (345, 20)]  # convex
    unit = lambda p: (math.cos(math.radians(p[1])) * math.cos(math.radians(p[0])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[0])), math.sin(math.radians(p[1])))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    points = [(r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(120)] + [(r.uniform(-20, 40), r.uniform(-20, 50)) for _ in range(120)]
    want = [all(sum(x * y for x, y in zip(cross(unit(a), unit(b)), unit(p))) >= 0 for a, b in zip(corners, corners[1:] + corners[:1])) for p in points]
    df = spark.createDataFrame(points, "lon double, lat double")
    got = [x[0] for x in df.selectExpr(contains(Shape("point", ("lon", "lat")), S("polygon", *sum(corners, ())))).collect()]
    assert got == want and any(want)


def test_areas(spark):
    got = ask(spark, [area(S("circle", 10, 80, 180)), area(S("box", 0, 0, 360, 180)), area(S("polygon", 0, 0, 90, 0, 0, 90)), area(S("polygon", 350, 0, 80, 0, 0, 90))])
    whole = 4 * math.pi * (180 / math.pi) ** 2
    assert got == pytest.approx([whole, whole, whole / 8, whole / 8], rel=1e-6)


def test_cone_join_finds_all_pairs_once(spark):
    from aquila.session import Config, Engine
    from aquila.sources.catalog import Catalog

    r = random.Random(8)
    stars = [(i, r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(250)] + [(250, 0.0, 90.0), (251, 180.0, -90.0), (252, 0.0, 0.0), (253, 359.999, 0.0), (254, None, 3.0), (255, 77.0, 89.9)]
    catalog = Catalog()
    catalog.add("sky", spark.createDataFrame(stars, "id int, lon double, lat double"))
    for radius in (0.5, 7.0, 95.0):
        df = Engine(spark, catalog, Config()).sql(f"SELECT a.id AS a, b.id AS b FROM sky AS a JOIN sky AS b ON 1 = CONTAINS(POINT('', a.lon, a.lat), CIRCLE('', b.lon, b.lat, {radius}))")
        assert "NestedLoop" not in df._jdf.queryExecution().optimizedPlan().toString() and "explode" in df._jdf.queryExecution().analyzed().toString()
        got = sorted(map(tuple, df.collect()))
        assert got == sorted((i, j) for i, l, b in stars for j, m, c in stars if None not in (l, m) and dist((l, b), (m, c)) <= radius)


def test_stored_regions(spark):
    from aquila.session import Config, Engine
    from aquila.sources.catalog import Catalog

    regions = [(1, "Circle ICRS 10 10 5"), (2, "box 10 10 4 4"), (3, "POLYGON ICRS GEOCENTER 0 0 90 0 0 90"), (4, "Position 12 13"), (5, None)]
    catalog = Catalog()
    catalog.add("r", spark.createDataFrame(regions, "id int, s string"), types={"s": "REGION"})
    engine = Engine(spark, catalog, Config())
    inside = lambda lon, lat: [x[0] for x in engine.sql(f"SELECT id FROM r WHERE CONTAINS(POINT('', {lon}, {lat}), s) = 1 ORDER BY id").collect()]
    assert [inside(*p) for p in ((10, 10), (12, 13), (80, 5), (10, 350), (200, -50))] == [[1, 2, 3], [1, 3, 4], [3], [], []]
    got = engine.sql("SELECT id, s, COORDSYS(s) AS c FROM r WHERE INTERSECTS(s, POINT('', 0, 0)) = 1").collect()
    assert [tuple(x) for x in got] == [(3, regions[2][1], "ICRS GEOCENTER")]
    areas = [x[0] for x in engine.sql("SELECT AREA(s) AS a FROM r WHERE id < 3 ORDER BY id").collect()]
    assert areas == ask(spark, [area(S("circle", 10, 10, 5)), area(S("box", 10, 10, 4, 4))])
    catalog.add("bad", spark.createDataFrame([("NOT (Circle 1 2 3)",)], "s string"), types={"s": "REGION"})
    with pytest.raises(Exception, match="not supported in a column"):
        engine.sql("SELECT CONTAINS(POINT('', 1, 2), s) AS x FROM bad").collect()


def test_columns_of_regions_by_kind(spark):
    """What a column of regions holds is computed with as shapes of numbers are."""
    r = random.Random(9)
    sizes = {"point": 2, "circle": 3, "box": 4, "polygon": 8}

    def shape(kind):
        lon, lat, w = r.uniform(-3, 6), r.uniform(-3, 6), r.uniform(0.5, 4)
        return {"point": [lon, lat], "circle": [lon, lat, w], "box": [lon, lat, w, w + 1], "polygon": [lon, lat, lon + w, lat, lon + w, lat + w, lon, lat + w + 1]}[kind]

    rows = [(k, x, f"{'Position' if k == 'point' else k} ICRS {' '.join(map(repr, x))}") for k in sizes for x in (shape(k) for _ in range(15))]
    df = spark.createDataFrame([*rows, ("none", None, None)], "kind string, x array<double>, a string").coalesce(1)
    for y in (S("circle", 1, 2, 3), S("box", 1, 2, 5, 4), S("polygon", -1, -1, 5, 0, 4, 6)):
        questions = lambda s, y=y: [contains(s, y), contains(y, s), intersects(s, y)]
        got = {(row[0], tuple(row[1] or ())): list(row)[2:] for row in df.select("kind", "x", *(F.expr(q) for q in questions(stored("a")))).collect()}
        assert got.pop(("none", ())) == [None] * 3
        want = {}
        for kind, n in sizes.items():
            flat = Shape(kind, tuple(f"element_at(x, {i + 1})" for i in range(n)))
            want |= {(row[0], tuple(row[1])): list(row)[2:] for row in df.where(F.col("kind") == kind).select("kind", "x", *(F.expr(q) for q in questions(flat))).collect()}
        assert got == want and {x[2] for x in want.values()} == {True, False}
    for kind, n in sizes.items():
        flat, one = Shape(kind, tuple(f"element_at(x, {i + 1})" for i in range(n))), stored("a")
        for row in df.where(F.col("kind") == kind).selectExpr(*(f"{e} AS c{i}" for i, e in enumerate((area(one), area(flat), one.centre[0], flat.centre[0], one.centre[1], flat.centre[1])))).collect():
            assert all(row[i] == pytest.approx(row[i + 1], rel=1e-12) for i in (0, 2, 4))
    for two in (contains, intersects):
        with pytest.raises(ValueError, match="another column"):
            two(stored("a"), stored("b"))


def test_joins_by_varying_radius_match_all_pairs(spark):
    from aquila.session import Config, Engine
    from aquila.sources.catalog import Catalog

    r = random.Random(12)
    radii = [0.0, 0.004, 0.01, 0.02, 1.0, 2.56, 2.5600001, 33.0, 90.0, 163.9, 180.0, 181.0, 500.0, -1.0, -1000.0, None]
    places = [(r.uniform(-360, 720), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(60)] + [(0.0, 90.0), (180.0, -90.0), (0.0, 0.0), (359.999, 0.0), (0.0, 1.0), (180.0, 0.0), (None, 3.0), (3.0, None), (77.0, 89.9), (257.0, 89.9)]
    catalog = Catalog()
    sky = spark.createDataFrame([(i, i % 7, *p, r.choice(radii)) for i, p in enumerate(places * 2)], "id int, k int, lon double, lat double, r double")
    catalog.add("sky", sky)
    engine = Engine(spark, catalog, Config())
    a, b = (sky.select(*(F.col(c).alias(f"{s}_{c}") for c in sky.columns)) for s in "ab")
    whole = "a_lon IS NOT NULL AND a_lat IS NOT NULL AND b_lon IS NOT NULL AND b_lat IS NOT NULL"
    apart = distance(("a_lon", "a_lat"), ("b_lon", "b_lat"))
    for radius, of in (("b.r", "b_r"), ("MOD(b.k, 5) + 0.5", "b_k % 5 + 0.5D"), ("1", "1D"), ("180", "180D"), ("0", "0D"), ("MOD(b.k, 4) * 60", "b_k % 4 * 60")):
        for how in ("", "LEFT ", "RIGHT "):
            for word, condition in (("<=", f"CONTAINS(POINT('', a.lon, a.lat), CIRCLE('', b.lon, b.lat, {radius})) = 1"), ("<", f"DISTANCE(POINT('', a.lon, a.lat), POINT('', b.lon, b.lat)) < {radius}")):
                if how and word == "<":
                    continue
                df = engine.sql(f"SELECT a.id AS a, b.id AS b FROM sky AS a {how}JOIN sky AS b ON {condition}")
                want = a.join(b, F.expr(f"{whole} AND {apart} {word} {of}"), how.strip().lower() or "inner").select("a_id", "b_id")
                key = lambda x: (x[0] is None, x[1] is None, x[0] or 0, x[1] or 0)
                assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, want.collect()), key=key), (radius, how, word)
