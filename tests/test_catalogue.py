"""Every query of the catalogue against its SQL in DuckDB."""

import re
from collections import Counter

import duckdb
import pytest

from aquila.catalogue import CASES, QUERIES, TABLES, catalog, oracle, run
from aquila.session import Engine

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", CASES)
def test_query(spark, duck, name):
    df = run(spark, FOLDER, QUERIES[name])
    got = Counter(rounded(r) for r in df.collect())
    if sql := oracle(name):
        q = duck.execute(sql)
        assert [c[0] for c in q.description] == df.columns
        assert got == Counter(map(rounded, q.fetchall()))
    else:
        assert got


#: Queries whose filters must split the rows of the table that they read.
SPLITTING = "filter_cmp filter_time not_group in_subquery not_in_subquery exists_correlated not_exists is_null is_not_null geo_cone geo_not_in_cone geo_box geo_intersects geo_circle_in_circle geo_polygon geo_region geo_centroid".split()


def test_no_query_is_empty(spark):
    empty = [name for name in CASES if name != "top_zero" and run(spark, "/root/testdata/sf0.01", QUERIES[name]).isEmpty()]
    assert empty == []


@pytest.mark.parametrize("name", SPLITTING)
def test_filters_split_their_rows(spark, name):
    source = "sky" if name.startswith("geo") else "orders" if name.startswith("filter") else "part" if name == "not_group" else "customer"
    rows = run(spark, FOLDER, f"SELECT COUNT(*) AS n FROM {source}").first()["n"]
    assert 0 < run(spark, FOLDER, QUERIES[name]).count() != rows


def test_scans_are_pruned_and_filtered(spark):
    df = run(spark, FOLDER, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_orderpriority" not in plan


KEYED = "cone_join distance_join radius_join cone_left_join radius_left_join radius_right_join three_sky_join point_column_join interval_join interval_left_join theta_join".split()


@pytest.mark.parametrize("name", KEYED)
def test_joins_have_keys(spark, name):
    plan = run(spark, FOLDER, QUERIES[name])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan
    physical = run(spark, FOLDER, QUERIES[name])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


@pytest.mark.parametrize("name", KEYED)
def test_keyed_joins_are_not_broadcast(spark, name):
    """A small file can hold many rows with several keys each: such a side filled the driver, and few tasks did the join."""
    physical = run(spark, FOLDER, QUERIES[name])._jdf.queryExecution().executedPlan().toString()
    keyed = [x for x in physical.splitlines() if "Join" in x and re.search(r"\bkey#", x)]
    assert keyed and all("SortMergeJoin" in x for x in keyed)


def compiled(spark, name, folder=FOLDER):
    """The query, and its joined rows before the exact condition."""
    sql = Engine(spark, catalog(spark, folder, QUERIES[name])).compile(QUERIES[name])[0].sql
    source = sql.split(" FROM ", 1)[1]
    return sql, re.sub(" (LEFT|RIGHT) JOIN ", " JOIN ", source[: source.rindex(".key AND ") + 4])


def count(spark, source):
    return spark.sql(f"SELECT count(*) FROM {source}").first()[0]


SPATIAL = [x for x in KEYED if x not in ("interval_join", "interval_left_join", "theta_join")]


@pytest.mark.parametrize("name", SPATIAL)
def test_distances_are_decided_by_vectors(spark, name):
    """Trigonometry for each pair, not for each row, took all the time of joins with many pairs."""
    plan = run(spark, FOLDER, QUERIES[name])._jdf.queryExecution().executedPlan().toString()
    (join,) = [x for x in plan.splitlines() if re.search(r"SortMergeJoin \[key#\d+L\], \[key#\d+L\]", x)]
    assert "CASE WHEN" in join and join.index("CASE WHEN") < join.index("ASIN")


@pytest.mark.parametrize("name", [*SPATIAL, "interval_join"])
def test_rows_are_dealt_before_they_get_several_keys(spark, name):
    """One task reads a small file, and gave all of its rows their keys."""
    assert "RoundRobinPartitioning" in run(spark, FOLDER, QUERIES[name])._jdf.queryExecution().executedPlan().toString()


def test_points_as_text_are_taken_apart_once_a_row(spark):
    """Keys of points were filtered at the scan by an expression that took their text apart dozens of times, in one task."""
    plan = run(spark, FOLDER, QUERIES["point_column_join"])._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "split(" in x and "SortMergeJoin" not in x]
    assert [x.count("split(") for x in lines] == [2, 2] and plan.count("Exchange RoundRobinPartitioning") == 2


def test_a_kept_circle_meets_few_points(spark):
    """Points had a row for every cell in reach in classes four times as high as the one before, up to circles around the sphere."""
    joined = compiled(spark, "radius_left_join")[1]
    rows = run(spark, FOLDER, "SELECT COUNT(*) AS n FROM sky").first()["n"]
    assert rows < count(spark, joined[joined.index(" JOIN (") + 7 :].rsplit(") ON ", 1)[0]) < 120 * rows
    within = "SELECT a.id AS a, b.id AS b FROM sky AS a JOIN sky AS b ON DISTANCE(POINT('', b.lon, b.lat), POINT('', a.lon, a.lat)) < MOD(a.id, 6)"
    assert count(spark, joined) < 8 * run(spark, FOLDER, within).count()


def test_circles_around_kept_points_have_few_cells(spark):
    """They had cells of one degree, whatever their radius: thousands for large ones."""
    exploded = compiled(spark, "radius_right_join")[0].split(" FROM ", 1)[1].split(" RIGHT JOIN ")[0]
    rows = run(spark, FOLDER, "SELECT COUNT(*) AS n FROM sky").first()["n"]
    assert rows < count(spark, exploded) < 30 * rows


def test_bounds_of_radii(spark):
    """A bound that an expression shows sets the cells' height; without one they keep theirs."""
    sql = lambda r: Engine(spark, catalog(spark, FOLDER)).compile(f"SELECT a.id AS a, b.id AS b FROM sky AS a RIGHT JOIN sky AS b ON CONTAINS(POINT('', b.lon, b.lat), CIRCLE('', a.lon, a.lat, {r})) = 1")[0].sql
    for radius, h in (("MOD(a.id, 170) + 3", "86.5D"), ("(MOD(a.id, 3) + 2.5)", "2.75D"), ("MOD(a.lon, 3)", "1.0D"), ("a.id", "1.0D"), ("MOD(a.id, 3) - a.lat", "1.0D")):
        assert f"/ {h}) AS zone" in sql(radius), radius


def test_circles_of_varying_radius_meet_few_points(spark):
    """Classes four times as high as the one before let in 5,652 pairs for the 1,945 that are near."""
    folder = "/root/testdata/sf0.01"
    assert count(spark, compiled(spark, "radius_join", folder)[1]) < 1.6 * run(spark, folder, QUERIES["radius_join"]).count()
