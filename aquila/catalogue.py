"""Queries in the language for the driver's tables, each with the SQL that DuckDB answers alike.

sky is made from customer: longitudes and latitudes spread over the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.functions.udf import declare
from aquila.plans.nodes import Table, walk
from aquila.plans.parser import parse
from aquila.session import Config, Engine
from aquila.sources.catalog import Catalog, parquet_catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SKY = "SELECT c_custkey AS id, (CAST(c_custkey AS DOUBLE) * CAST(137.50776405 AS DOUBLE)) % CAST(360 AS DOUBLE) AS lon, degrees(asin(CAST(2 AS DOUBLE) * ((CAST(c_custkey AS DOUBLE) * CAST(0.7548776662 AS DOUBLE)) % CAST(1 AS DOUBLE)) - CAST(1 AS DOUBLE))) AS lat FROM customer"
_D = "2 * degrees(asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def _distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return _D.format(lon1=lon1, lat1=lat1, lon2=lon2, lat2=lat2)


_OWN = ", ".join(f"'{t}'" for t in TABLES)
_LISTED_TABLES = (
    f"SELECT NULL::VARCHAR AS schema_name, table_name, 'table' AS table_type FROM information_schema.tables WHERE table_name IN ({_OWN}) UNION ALL SELECT NULL, 'sky', 'table'"
    " UNION ALL SELECT 'TAP_SCHEMA', 'TAP_SCHEMA.' || unnest(['schemas', 'tables', 'columns', 'keys', 'key_columns']), 'table'"
)
_LISTED_COLUMNS = (
    f"SELECT table_name, column_name, CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE data_type END AS datatype FROM information_schema.columns WHERE table_name IN ({_OWN})"
    " UNION ALL SELECT * FROM (VALUES ('sky', 'id', 'BIGINT'), ('sky', 'lon', 'DOUBLE'), ('sky', 'lat', 'DOUBLE'))"
)

#: name: (query, SQL for DuckDB, or None where there is none)
CASES: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "SELECT TOP 10 c.c_mktsegment, COUNT(*) AS n, SUM(o.o_totalprice) AS revenue FROM customer AS c JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 1 ORDER BY revenue DESC",
        "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1 ORDER BY revenue DESC LIMIT 10",
    ),
    "scan_star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "table_star": ("SELECT n.* FROM nation n, \"region\" r WHERE n.n_regionkey = r.r_regionkey", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "projection_alias": ("SELECT n_name AS Name, n_regionkey FROM nation", "SELECT n_name AS name, n_regionkey FROM nation"),
    "delimited_alias": ('SELECT "n_name" AS "Name Of" FROM "nation"', 'SELECT n_name AS "Name Of" FROM nation'),
    "arith_expr": ("SELECT l_orderkey, l_extendedprice*(1-l_discount) AS rev FROM lineitem", "SELECT l_orderkey, l_extendedprice*(1-l_discount) AS rev FROM lineitem"),
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 2 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_orderkey // 2 AS r FROM orders"),
    "left_assoc": ("SELECT l_orderkey, l_linenumber, l_quantity - l_tax - l_discount AS d, l_quantity / 2.0 / l_linenumber AS e FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity - l_tax - l_discount AS d, l_quantity / 2.0 / l_linenumber AS e FROM lineitem"),
    "unary_minus": ("SELECT -l_quantity AS q, l_quantity - -1 AS r FROM lineitem", "SELECT -l_quantity AS q, l_quantity - (-1) AS r FROM lineitem"),
    "concat": ("SELECT n_name || '-' || n_name AS nn FROM nation", "SELECT n_name || '-' || n_name AS nn FROM nation"),
    "concat_number": ("SELECT n_name || ':' || n_nationkey AS nn FROM nation", "SELECT n_name || ':' || n_nationkey AS nn FROM nation"),
    "string_literals": ("SELECT 'it''s' 'so' AS a, 'back\\slash' AS b FROM \"region\"", "SELECT 'it''sso' AS a, 'back\\slash' AS b FROM region"),
    "numeric_literals": ("SELECT 1 AS a, 2. AS b, .5 AS c, 1.5e3 AS d FROM \"region\"", "SELECT 1 AS a, 2.0::DOUBLE AS b, 0.5::DOUBLE AS c, 1500.0::DOUBLE AS d FROM region"),
    "default_names": ("SELECT n_nationkey + 1, -n_nationkey, n_name || 'x', SQRT(n_nationkey) FROM nation", 'SELECT n_nationkey + 1 AS "SUM", -n_nationkey AS "NEG_n_nationkey", n_name || \'x\' AS concat, sqrt(n_nationkey) AS "SQRT" FROM nation'),
    "distinct": ("SELECT DISTINCT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    "select_all": ("SELECT ALL o_orderstatus FROM orders", "SELECT o_orderstatus FROM orders"),
    "filter_cmp": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'F' AND o_orderkey != 5", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'F' AND o_orderkey != 5"),
    "filter_time": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"),
    "and_or_prec": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 100000)"),
    "not_group": ("SELECT p_partkey FROM part WHERE NOT (p_size > 25 OR p_retailprice < 910)", "SELECT p_partkey FROM part WHERE NOT (p_size > 25 OR p_retailprice < 910)"),
    "like": ("SELECT n_name FROM nation WHERE n_name LIKE 'NATION_1%'", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION_1%'"),
    "not_like": ("SELECT n_name FROM nation WHERE n_name NOT LIKE '%1_'", "SELECT n_name FROM nation WHERE n_name NOT LIKE '%1_'"),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20"),
    "in_list": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 2, 3)", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2, 3)"),
    "not_in_list": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 1 + 1)", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 2)"),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 460000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 460000)"),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "in_subquery_top": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT TOP 7 o_custkey FROM orders ORDER BY o_custkey)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_custkey LIMIT 7)"),
    "in_correlated": ("SELECT c.c_custkey FROM customer AS c WHERE 'F' IN (SELECT o_orderstatus FROM orders WHERE o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer c WHERE 'F' IN (SELECT o_orderstatus FROM orders WHERE o_custkey = c.c_custkey)"),
    "exists_correlated": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 460000)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 460000)"),
    "not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders AS O WHERE o.o_custkey = customer.c_custkey AND o.o_totalprice > 400000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "is_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL"),
    "is_not_null": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NOT NULL", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NOT NULL"),
    "comma_join": ("SELECT n_name, r_name FROM nation, \"region\" WHERE n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "inner_on": ("SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON c_custkey = o_custkey", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "left_on": ("SELECT c_name, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000"),
    "right_on": ("SELECT c_name, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey", "SELECT c_name, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey"),
    "full_on": ("SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey + 50", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50"),
    "join_using": ("SELECT * FROM orders JOIN (SELECT o_orderkey, o_totalprice AS p FROM orders) AS t USING(o_orderkey)", "SELECT * FROM orders JOIN (SELECT o_orderkey, o_totalprice AS p FROM orders) AS t USING (o_orderkey)"),
    "using_sides": ("SELECT o_orderkey, orders.o_orderkey AS a, t.o_orderkey AS b FROM orders LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AS t USING(o_orderkey)", "SELECT o.o_orderkey, o.o_orderkey AS a, t.o_orderkey AS b FROM orders o LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) t ON o.o_orderkey = t.o_orderkey"),
    "natural_join": ("SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) AS b", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b"),
    "natural_left": ("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_acctbal > 5000) AS b", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_acctbal > 5000) b"),
    "right_using": ("SELECT k, x, y FROM (SELECT s_suppkey AS k, s_name AS x FROM supplier) AS a RIGHT JOIN (SELECT c_custkey AS k, c_name AS y FROM customer) AS b USING(k)", "SELECT b.k, x, y FROM (SELECT s_suppkey AS k, s_name AS x FROM supplier) a RIGHT JOIN (SELECT c_custkey AS k, c_name AS y FROM customer) b ON a.k = b.k"),
    "full_using": ("SELECT k, x, y FROM (SELECT s_suppkey AS k, s_name AS x FROM supplier) AS a FULL JOIN (SELECT c_custkey + 50 AS k, c_name AS y FROM customer) AS b USING(k)", "SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT s_suppkey AS k, s_name AS x FROM supplier) a FULL JOIN (SELECT c_custkey + 50 AS k, c_name AS y FROM customer) b ON a.k = b.k"),
    "nested_join": ("SELECT c_name, n_name, r_name FROM (nation JOIN \"region\" ON n_regionkey = r_regionkey) JOIN customer ON c_nationkey = n_nationkey", "SELECT c_name, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"),
    "nested_right_join": ("SELECT c_name, n_name FROM customer LEFT JOIN (nation JOIN \"region\" ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", "SELECT c_name, n_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey"),
    "theta_join": ("SELECT r_name, n_name FROM \"region\" JOIN nation ON n_nationkey BETWEEN r_regionkey AND r_regionkey + 2", "SELECT r_name, n_name FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey AND r_regionkey + 2"),
    "three_way_join": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY 1"),
    "group_agg": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS a, MAX(l_quantity) AS b, COUNT(l_tax) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS a, max(l_quantity) AS b, count(l_tax) AS c FROM lineitem GROUP BY 1, 2"),
    "group_alias": ("SELECT o_orderstatus AS Status, COUNT(*) AS n FROM orders GROUP BY status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "group_qualified": ("SELECT o.o_orderstatus, COUNT(*) AS n FROM orders AS o GROUP BY o.o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "global_agg": ("SELECT COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS a, ROUND(SUM(o_totalprice), 2) AS s FROM orders", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS a, round(sum(o_totalprice), 2) AS s FROM orders"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 1000"),
    "having_global": ("SELECT MAX(o_orderkey) AS m FROM orders HAVING COUNT(*) > 3", "SELECT max(o_orderkey) AS m FROM orders HAVING count(*) > 3"),
    "count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS a, COUNT(ALL o_custkey) AS b FROM orders", "SELECT count(DISTINCT o_custkey) AS a, count(o_custkey) AS b FROM orders"),
    "count_star_distinct": ("SELECT COUNT(DISTINCT *) AS n FROM nation", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM nation)"),
    "count_star_distinct_nulls": (
        "SELECT COUNT(DISTINCT *) AS n FROM (SELECT c_nationkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000) AS t",
        "SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000)",
    ),
    "sum_distinct": ("SELECT SUM(DISTINCT p_size) AS s FROM part", "SELECT sum(DISTINCT p_size)::BIGINT AS s FROM part"),
    "avg_distinct": ("SELECT AVG(DISTINCT p_size) AS s FROM part", "SELECT avg(DISTINCT p_size) AS s FROM part"),
    "min_string": ("SELECT MIN(n_name) AS a, MAX(n_name) AS b FROM nation", "SELECT min(n_name) AS a, max(n_name) AS b FROM nation"),
    "agg_in_expr": ("SELECT ABS(COUNT(*)) AS a, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS b FROM orders", "SELECT abs(count(*)) AS a, round(sum(o_totalprice) / count(*), 4) AS b FROM orders"),
    "order_ordinal": ("SELECT TOP 20 o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2", "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 20"),
    "order_alias": ("SELECT TOP 20 o_orderkey AS K, o_custkey * 2 AS twice FROM orders ORDER BY twice, k", "SELECT o_orderkey AS k, o_custkey * 2 AS twice FROM orders ORDER BY 2, 1 LIMIT 20"),
    "order_desc": ("SELECT TOP 15 o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"),
    "order_nulls": ("SELECT TOP 30 c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 ORDER BY o_orderkey DESC, c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 ORDER BY o_orderkey DESC NULLS FIRST, c_custkey NULLS LAST LIMIT 30"),
    "top_zero": ("SELECT TOP 0 n_name FROM nation", "SELECT n_name FROM nation LIMIT 0"),
    "top_in_subquery": ("SELECT t.k, t.v FROM (SELECT TOP 5 o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY v DESC, k) AS t", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY 2 DESC, 1 LIMIT 5"),
    "derived_case": ('SELECT T.oK FROM (SELECT o_orderkey AS OK, o_custkey AS "Cust" FROM orders) AS t WHERE "Cust" > 10', "SELECT o_orderkey AS ok FROM orders WHERE o_custkey > 10"),
    "math_basic": (
        "SELECT ABS(-p_size) AS a, CEILING(p_retailprice) AS b, FLOOR(p_retailprice) AS c, ROUND(EXP(p_size / 10.0), 6) AS d, ROUND(LOG(p_retailprice), 8) AS e, ROUND(LOG10(p_retailprice), 8) AS f, MOD(p_size, 7) AS g, ROUND(POWER(p_size, 2), 4) AS h, ROUND(SQRT(p_size), 8) AS i, ROUND(p_retailprice) AS j, TRUNCATE(p_retailprice / 3.0, 1) AS k, TRUNCATE(-p_retailprice) AS l, PI() AS m FROM part",
        "SELECT abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round(exp(p_size / 10.0::DOUBLE), 6) AS d, round(ln(p_retailprice), 8) AS e, round(log10(p_retailprice), 8) AS f, p_size % 7 AS g, round(pow(p_size, 2), 4) AS h, round(sqrt(p_size), 8) AS i, round(p_retailprice, 0) AS j, sign(p_retailprice / 3) * floor(abs(p_retailprice / 3.0::DOUBLE) * 10) / 10 AS k, trunc(-p_retailprice) AS l, pi() AS m FROM part",
    ),
    "truncate": (
        "SELECT TRUNCATE(1.15, 2) AS a, TRUNCATE(0.29, 2) AS b, TRUNCATE(-1.15, 2) AS c, TRUNCATE(1234.5, -2) AS d, TRUNCATE(1e30, 2) AS e, TRUNCATE(-2.7) AS f FROM \"region\"",
        "SELECT 1.15::DOUBLE AS a, 0.29::DOUBLE AS b, -1.15::DOUBLE AS c, 1200::DOUBLE AS d, 1e30::DOUBLE AS e, -2::DOUBLE AS f FROM region",
    ),
    "trig": (
        "SELECT ROUND(ACOS(x), 8) AS a, ROUND(ASIN(x), 8) AS b, ROUND(ATAN(x), 8) AS c, ROUND(ATAN2(x, y), 8) AS d, ROUND(COS(y), 8) AS e, ROUND(COT(y), 6) AS f, ROUND(SIN(y), 8) AS g, ROUND(TAN(x), 8) AS h, ROUND(DEGREES(x), 8) AS i, ROUND(RADIANS(y), 8) AS j FROM (SELECT p_size / 51.0 AS x, p_size + 0.25 AS y FROM part) AS t",
        "SELECT round(acos(x), 8) AS a, round(asin(x), 8) AS b, round(atan(x), 8) AS c, round(atan2(x, y), 8) AS d, round(cos(y), 8) AS e, round(cot(y), 6) AS f, round(sin(y), 8) AS g, round(tan(x), 8) AS h, round(degrees(x), 8) AS i, round(radians(y), 8) AS j FROM (SELECT p_size / 51.0::DOUBLE AS x, p_size + 0.25::DOUBLE AS y FROM part) AS t",
    ),
    "rand": ("SELECT COUNT(*) AS n FROM (SELECT RAND() AS r, RAND(3) AS s FROM nation) AS t WHERE r >= 0 AND r < 1 AND s >= 0 AND s < 1", "SELECT count(*) AS n FROM nation"),
    "geo_distance": ("SELECT id, ROUND(DISTANCE(POINT('ICRS', lon, lat), POINT('ICRS', 10, -20)), 6) AS d FROM sky", f"SELECT id, round({_distance('lon', 'lat', '10', '-20')}, 6) AS d FROM sky"),
    "geo_cone": ("SELECT id FROM sky WHERE CONTAINS(POINT('ICRS', lon, lat), CIRCLE('ICRS', 350, 25, 30)) = 1", f"SELECT id FROM sky WHERE {_distance('lon', 'lat', '350', '25')} <= 30"),
    "geo_not_in_cone": ("SELECT id FROM sky WHERE 0 = CONTAINS(POINT('ICRS', lon, lat), CIRCLE('ICRS', 350, 25, 30))", f"SELECT id FROM sky WHERE NOT {_distance('lon', 'lat', '350', '25')} <= 30"),
    "geo_box": ("SELECT id FROM sky WHERE 1 = CONTAINS(POINT('', lon, lat), BOX('', 355, 10, 30, 40))", "SELECT id FROM sky WHERE lat BETWEEN -10 AND 30 AND (lon >= 340 OR lon <= 10)"),
    "geo_number": ("SELECT id, CONTAINS(POINT('', lon, lat), CIRCLE('', 0, 0, 40)) AS inside FROM sky", f"SELECT id, ({_distance('lon', 'lat', '0', '0')} <= 40)::INT AS inside FROM sky"),
    "geo_area": (
        "SELECT TOP 1 ROUND(AREA(CIRCLE('', 10, 20, 5)), 6) AS c, ROUND(AREA(BOX('', 10, 20, 4, 6)), 6) AS b, ROUND(AREA(POLYGON('', 0, 0, 90, 0, 0, 90)), 4) AS p FROM sky",
        "SELECT round(2 * pi() * (1 - cos(radians(5))) * pow(180 / pi(), 2), 6) AS c, round(radians(4) * (sin(radians(23)) - sin(radians(17))) * pow(180 / pi(), 2), 6) AS b, round(pi() / 2 * pow(180 / pi(), 2), 4) AS p",
    ),
    "geo_coord": ("SELECT id, COORD1(POINT('ICRS GEOCENTER', lon, lat)) AS a, COORD2(POINT('ICRS GEOCENTER', lon, lat)) AS b, COORDSYS(POINT('ICRS GEOCENTER', lon, lat)) AS s FROM sky", "SELECT id, lon AS a, lat AS b, 'ICRS GEOCENTER' AS s FROM sky"),
    "geo_centroid": ("SELECT id FROM sky WHERE DISTANCE(POINT('', lon, lat), CENTROID(CIRCLE('', 120, 40, 3))) < 25", f"SELECT id FROM sky WHERE {_distance('lon', 'lat', '120', '40')} < 25"),
    "geo_intersects": ("SELECT id FROM sky WHERE INTERSECTS(CIRCLE('', lon, lat, 10), CIRCLE('', 40, 10, 15)) = 1", f"SELECT id FROM sky WHERE {_distance('lon', 'lat', '40', '10')} <= 25"),
    "geo_circle_in_circle": ("SELECT id FROM sky WHERE CONTAINS(CIRCLE('', lon, lat, 4), CIRCLE('', 40, 10, 25)) = 1", f"SELECT id FROM sky WHERE {_distance('lon', 'lat', '40', '10')} + 4 <= 25"),
    "geo_polygon": ("SELECT id FROM sky WHERE CONTAINS(POINT('', lon, lat), POLYGON('', 0, 0, 90, 0, 0, 90)) = 1", "SELECT id FROM sky WHERE lon BETWEEN 0 AND 90 AND lat >= 0"),
    "geo_region": ("SELECT id FROM sky WHERE CONTAINS(POINT('', lon, lat), REGION('UNION ICRS (CIRCLE 10 10 20 NOT (CIRCLE 100 0 60))')) = 1", f"SELECT id FROM sky WHERE {_distance('lon', 'lat', '10', '10')} <= 20 OR NOT {_distance('lon', 'lat', '100', '0')} <= 60"),
    "geo_region_column": (
        "SELECT id, ROUND(AREA(g), 6) AS a, ROUND(COORD2(CENTROID(g)), 6) AS b FROM (SELECT id, CIRCLE('', lon, lat, 3) AS g FROM sky) AS t WHERE INTERSECTS(g, CIRCLE('', 40, 10, 15)) = 1",
        f"SELECT id, round(2 * pi() * (1 - cos(radians(3))) * pow(180 / pi(), 2), 6) AS a, round(lat, 6) AS b FROM sky WHERE {_distance('lon', 'lat', '40', '10')} <= 18",
    ),
    "geo_stcs": ("SELECT TOP 1 POINT('ICRS', 1, 2) AS p, CIRCLE('', 1, 2, 3) AS c FROM sky", "SELECT 'Position ICRS 1.0 2.0' AS p, 'Circle 1.0 2.0 3.0' AS c"),
    "cone_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a JOIN sky AS b ON CONTAINS(POINT('', a.lon, a.lat), CIRCLE('', b.lon, b.lat, 5)) = 1", f"SELECT a.id AS a, b.id AS b FROM sky a JOIN sky b ON {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 5"),
    "distance_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a, sky AS b WHERE a.id < b.id AND DISTANCE(POINT('', a.lon, a.lat), POINT('', b.lon, b.lat)) < 2", f"SELECT a.id AS a, b.id AS b FROM sky a JOIN sky b ON a.id < b.id AND {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 2"),
    "radius_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a JOIN sky AS b ON 1 = CONTAINS(POINT('', a.lon, a.lat), CIRCLE('', b.lon, b.lat, MOD(b.id, 4)))", f"SELECT a.id AS a, b.id AS b FROM sky a JOIN sky b ON {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= b.id % 4"),
    "cone_left_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a LEFT JOIN sky AS b ON a.id <> b.id AND CONTAINS(POINT('', b.lon, b.lat), CIRCLE('', a.lon, a.lat, 3)) = 1", f"SELECT a.id AS a, b.id AS b FROM sky a LEFT JOIN sky b ON a.id <> b.id AND {_distance('b.lon', 'b.lat', 'a.lon', 'a.lat')} <= 3"),
    "radius_left_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a LEFT JOIN sky AS b ON a.id < b.id AND DISTANCE(POINT('', b.lon, b.lat), POINT('', a.lon, a.lat)) < MOD(a.id, 6)", f"SELECT a.id AS a, b.id AS b FROM sky a LEFT JOIN sky b ON a.id < b.id AND {_distance('b.lon', 'b.lat', 'a.lon', 'a.lat')} < a.id % 6"),
    "radius_right_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a RIGHT JOIN sky AS b ON a.id < b.id AND CONTAINS(POINT('', b.lon, b.lat), CIRCLE('', a.lon, a.lat, MOD(a.id, 3) + 2.5)) = 1", f"SELECT a.id AS a, b.id AS b FROM sky a RIGHT JOIN sky b ON a.id < b.id AND {_distance('b.lon', 'b.lat', 'a.lon', 'a.lat')} <= a.id % 3 + 2.5"),
    "three_sky_join": ("SELECT n.n_name, a.id AS a, b.id AS b FROM customer AS c, sky AS a, nation AS n, sky AS b WHERE c.c_custkey = a.id AND c.c_nationkey = n.n_nationkey AND a.id < b.id AND DISTANCE(POINT('', a.lon, a.lat), POINT('', b.lon, b.lat)) < 3", f"SELECT n_name, a.id AS a, b.id AS b FROM customer c JOIN sky a ON c.c_custkey = a.id JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN sky b ON a.id < b.id AND {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 3"),
    "point_column_join": ("SELECT a.id AS a, b.id AS b FROM (SELECT id, POINT('', lon, lat) AS p FROM sky) AS a JOIN (SELECT id, POINT('', lon, lat) AS p FROM sky) AS b ON a.id < b.id AND DISTANCE(a.p, b.p) <= 2", f"SELECT a.id AS a, b.id AS b FROM sky a JOIN sky b ON a.id < b.id AND {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2"),
    "interval_join": ("SELECT a.id AS a, b.id AS b FROM sky AS a JOIN sky AS b ON a.id <> b.id AND a.lat BETWEEN b.lat - 0.05 AND b.lat + 0.05", "SELECT a.id AS a, b.id AS b FROM sky a JOIN sky b ON a.id <> b.id AND a.lat BETWEEN b.lat - 0.05::DOUBLE AND b.lat + 0.05::DOUBLE"),
    "interval_left_join": ("SELECT p.p_partkey, s.s_suppkey FROM part AS p LEFT JOIN supplier AS s ON p.p_retailprice BETWEEN s.s_acctbal - 1 AND s.s_acctbal + 1.5", "SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON p_retailprice BETWEEN s_acctbal - 1 AND s_acctbal + 1.5::DOUBLE"),
    "udf_pattern": ("SELECT n_name, twice(n_nationkey) AS t, tag(n_name, 'x') AS u FROM nation", "SELECT n_name, n_nationkey * 2 AS t, n_name || '$' || 'x' AS u FROM nation"),
    "tap_schema_tables": ("SELECT schema_name, table_name, table_type FROM TAP_SCHEMA.tables", _LISTED_TABLES),
    "tap_schema_columns": ("SELECT table_name, column_name, datatype FROM TAP_SCHEMA.columns WHERE std = 0", _LISTED_COLUMNS),
}
QUERIES = {name: query for name, (query, _) in CASES.items()}
FUNCTIONS = [declare("twice(x INTEGER) -> INTEGER", "($1 * 2)"), declare("tag(a VARCHAR, b VARCHAR) -> VARCHAR", "concat($1, '$$', $2)")]


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arithmetic as in SKY, column by column."""
    k = F.col("c_custkey").cast("double")
    one = lambda x: F.lit(float(x))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), ((k * one(137.50776405)) % one(360)).alias("lon"), F.degrees(F.asin(one(2) * ((k * one(0.7548776662)) % one(1)) - one(1))).alias("lat"))


def catalog(spark: SparkSession, sf_dir: str, query: str | None = None) -> Catalog:
    """All tables, or those alone that a query reads: opening a table reads its files' schema."""
    named = {x.name.parts[-1].text.lower() for x in walk(parse(query)) if isinstance(x, Table)} if query and "TAP_SCHEMA" not in query else None
    wanted = lambda name: named is None or name in named
    out = parquet_catalog(spark, sf_dir, filter(wanted, TABLES))
    if wanted("sky"):
        out.add("sky", sky(spark, sf_dir))
    return out


def run(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    tables = catalog(spark, sf_dir, query)
    if "TAP_SCHEMA" in query:
        tables.describe(spark)
    return Engine(spark, tables, Config(functions=FUNCTIONS)).sql(query)


def oracle(name: str) -> str | None:
    sql = CASES[name][1]
    return f"WITH sky AS ({SKY}) {sql}" if sql and "sky" in QUERIES[name] else sql
