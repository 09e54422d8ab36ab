import base64
import io
import json
import threading
import time
from datetime import UTC, datetime, timedelta

import pytest

from aquila.__main__ import main
from aquila.plans.lexer import ParseError
from aquila.session import Config, Engine
from aquila.sources.catalog import Catalog, Coosys, ForeignKey, jdbc_catalog, read_tap_schema
from aquila.sources.formats import separated
from aquila.sources.tableset import read_tableset, write_tableset
from aquila.sources.uploads import UploadError
from aquila.sources.votable import VotableError, parse_votable
from aquila.streaming.jobs import Jobs, Phase, PhaseError, destruction_time

ROWS = [(1, "a,b", 1.5, b"\x01\x02"), (2, 'say "x"', float("nan"), None), (3, None, None, b"")]


@pytest.fixture
def engine(spark):
    catalog = Catalog()
    catalog.add("t", spark.createDataFrame(ROWS, "i int, s string, d double, b binary").coalesce(1), "public")
    return Engine(spark, catalog, Config())


def written(engine, format_, query="SELECT i, s, d FROM t", **options):
    out = io.BytesIO()
    over = engine.query(query, **options).write(out, format_)
    return out.getvalue(), over


def test_csv(engine):
    text, over = written(engine, "csv", maxrec=2)
    assert text.decode() == 'i,s,d\n1,"a,b",1.5\n2,"say \'x\'",NaN\n' and over
    text, over = written(engine, "text/tab-separated-values")
    assert text.decode().splitlines()[3] == "3\t\t" and not over


def test_json(engine):
    text, over = written(engine, "JSON", maxrec=3)
    got = json.loads(text)
    assert [c["name"] for c in got["metadata"]] == ["i", "s", "d"] and got["data"] == [[1, "a,b", 1.5], [2, 'say "x"', None], [3, None, None]] and not over


def test_text_and_html(engine):
    text, over = written(engine, "text", maxrec=1)
    assert b"OVERFLOW" in text and over and b"a,b" in text and b"say" not in text
    text, _ = written(engine, "html", maxrec=2)
    assert b"<th>i</th>" in text and b"&quot;x&quot;" in text and b"OVERFLOW" in text


@pytest.mark.parametrize("form", ["votable/td", "votable", "votable/b2"])
def test_votable_round_trip(engine, form):
    text, over = written(engine, form, maxrec=2)
    assert over and b'value="OVERFLOW"' in text
    columns, rows = parse_votable(text)
    rows = list(rows)
    assert columns == [("i", "INTEGER"), ("s", "VARCHAR"), ("d", "DOUBLE")] and rows[0] == [1, "a,b", 1.5] and rows[1] == [2, 'say "x"', None]


def test_maxrec_zero(engine):
    for form in ("csv", "votable/td"):
        text, over = written(engine, form, maxrec=0)
        assert over and b"a,b" not in text


def test_fits(engine):
    raw, _ = written(engine, "fits")
    assert len(raw) % 2880 == 0 and raw.startswith(b"SIMPLE  =") and b"TTYPE2  = 's" in raw and b"XTENSION= 'BINTABLE'" in raw


def test_upload(engine):
    text, _ = written(engine, "votable/td")
    got = engine.query("SELECT u.s, t.i FROM TAP_UPLOAD.mine AS u JOIN t ON u.i = t.i WHERE u.d > 1", uploads={"mine": text}).rows()
    assert got == ([("a,b", 1)], False)
    with pytest.raises(ValueError, match="Unknown table"):
        engine.query("SELECT * FROM TAP_UPLOAD.mine")
    with pytest.raises(UploadError, match="file:"):
        engine.query("SELECT * FROM TAP_UPLOAD.mine", uploads="mine,file:///etc/passwd")
    with pytest.raises(UploadError, match="would be the table"):
        engine.query("SELECT * FROM t", uploads={"a": text, "A": text})
    with pytest.raises(VotableError, match="no FIELD"):
        parse_votable(b"<VOTABLE><RESOURCE><TABLE></TABLE></RESOURCE></VOTABLE>")
    from aquila.sources.uploads import Limits

    with pytest.raises(UploadError, match="more than 1 rows"):
        engine.with_config(upload=Limits(rows=1)).query("SELECT * FROM t", uploads={"a": text})
    with pytest.raises(UploadError, match="bytes"):
        engine.with_config(upload=Limits(bytes=10)).query("SELECT * FROM t", uploads={"a": text})


def test_upload_types(spark):
    doc = b"""<VOTABLE><RESOURCE><TABLE><FIELD name="p" datatype="char" arraysize="*" xtype="adql:POINT"/><FIELD name="b" datatype="boolean"/><FIELD name="n" datatype="short"><VALUES null="-32768"/></FIELD>
    <FIELD name="w" datatype="char" arraysize="*" xtype="timestamp"/><FIELD name="_x" datatype="unsignedByte" arraysize="*"/><DATA><TABLEDATA>
    <TR><TD>Position ICRS 10 20</TD><TD>true</TD><TD>-32768</TD><TD>2020-01-02T03:04:05</TD><TD>1 2</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""
    engine = Engine(spark, Catalog(), Config())
    got = engine.query("SELECT COORD1(p) AS lon, b, n, w, \"_x\" FROM TAP_UPLOAD.u WHERE CONTAINS(p, CIRCLE('ICRS', 11, 20, 2)) = 1", uploads={"u": doc}).rows()[0]
    assert got == [(10.0, 1, None, datetime(2020, 1, 2, 3, 4, 5), bytearray(b"\x01\x02"))]


def test_maxrec_and_fix(engine):
    c = Config(default_maxrec=10, max_maxrec=100)
    assert [c.maxrec(x) for x in (None, -1, 5, 500)] == [10, 100, 5, 100] and Config().maxrec(-3) is None
    with pytest.raises(ParseError):
        engine.query("SELECT i AS date FROM public.t")
    r = engine.with_config(fix_on_fail=True).query("SELECT i AS date FROM public.t WHERE i = 1")
    assert r.fixed == 'SELECT i AS "date" FROM "public".t WHERE i = 1' and r.rows()[0] == [(1,)]


def test_self_description(engine, spark):
    engine.catalog.describe(spark)
    got = engine.query("SELECT column_name, datatype FROM TAP_SCHEMA.columns WHERE table_name = 'public.t'").rows()[0]
    assert sorted(got) == [("b", "VARBINARY"), ("d", "DOUBLE"), ("i", "INTEGER"), ("s", "VARCHAR")]
    again = read_tableset(write_tableset(engine.catalog).encode())
    t = next(t for t in again.tables if t.name == "t")
    assert t.schema == "public" and [(c.name, c.type) for c in t.columns] == [("i", "INTEGER"), ("s", "VARCHAR"), ("d", "DOUBLE"), ("b", "VARBINARY")]


def test_lateral_and_backslashes(engine):
    assert engine.query(r"SELECT i FROM t WHERE s NOT LIKE 'a\%'").rows()[0] == [(1,), (2,)]
    assert engine.query("SELECT a.i FROM t AS a WHERE EXISTS (SELECT * FROM (SELECT b.i FROM t AS b WHERE b.i = a.i) AS c WHERE c.i > 2)").rows()[0] == [(3,)]


def test_jobs(engine):
    jobs = Jobs(engine)
    job = jobs.add("SELECT i FROM t", format="csv")
    assert job.phase is Phase.PENDING and jobs.list([Phase.PENDING]) == [job]
    with pytest.raises(PhaseError):
        job.move(Phase.COMPLETED)
    jobs.start(job)
    while job.phase not in (Phase.COMPLETED, Phase.ERROR):
        job.wait(5)
    assert job.phase is Phase.COMPLETED and job.result == b"i\n1\n2\n3\n"
    bad = jobs.add("SELECT nothing FROM t", start=True)
    while bad.wait(5) not in (Phase.COMPLETED, Phase.ERROR):
        pass
    assert bad.phase is Phase.ERROR and "nothing" in bad.error
    assert jobs.list(last=1) == [bad] and jobs.list() == [job, bad]
    job.destruction = datetime.now(UTC) - timedelta(1)
    assert jobs.sweep() == 1 and job.job_id not in jobs.jobs
    jobs.close()


def test_abort_and_duration(engine):
    gate = threading.Event()
    jobs = Jobs(engine.with_config(workers=1, max_duration=1), run=lambda job: gate.wait(10))
    job, queued = jobs.add("x", start=True, duration=100), jobs.add("y", start=True)
    assert job.duration == 1 and queued.phase is Phase.QUEUED
    jobs.abort(queued)
    for _ in range(60):
        if job.phase is Phase.ABORTED:
            break
        time.sleep(0.1)
    gate.set()
    assert job.phase is Phase.ABORTED and "1 seconds" in job.error and queued.phase is Phase.ABORTED
    jobs.close()
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert destruction_time(None, timedelta(2), timedelta(1), now) == now + timedelta(1) and destruction_time(None, None, None, now) is None


@pytest.fixture
def described(spark):
    catalog = Catalog(schemas={"sea": {"description": "Buoys & ships", "utype": None}}, coosys=[Coosys("sys1", "ICRS", None, "2015.5"), Coosys("sys2", "FK5", "J2000", None)])
    buoy = catalog.add("buoy", spark.createDataFrame([(1, 2.5), (2, None)], "id int, lon double"), "sea", description="Floats")
    buoy.columns[1].description, buoy.columns[1].unit, buoy.columns[1].ucd, buoy.columns[1].utype, buoy.columns[1].coosys = "Longitude < 360", "deg", "pos.eq.ra", "x:lon", "sys1"
    catalog.keys.append(ForeignKey("k1", "sea.buoy", "sea.buoy", [("id", "id")], "itself"))
    return Engine(spark, catalog, Config(provider=("harbour", "Of a small harbour"), formats={"psv": separated("|")}))


def test_results_tell_of_their_columns(described):
    query = "SELECT l AS a, l + 1 AS b FROM (SELECT lon AS l FROM sea.buoy) AS t ORDER BY a"
    meta = json.loads(written(described, "json", query)[0])["metadata"]
    assert meta[0] == {"name": "a", "description": "Longitude < 360", "datatype": "double", "unit": "deg", "ucd": "pos.eq.ra", "utype": "x:lon"}
    assert meta[1] == {"name": "b", "datatype": "double"}
    text = written(described, "votable/td", query)[0].decode()
    assert '<COOSYS ID="sys1" system="ICRS" epoch="2015.5"/>' in text and "sys2" not in text
    assert '<FIELD name="a" datatype="double" unit="deg" ucd="pos.eq.ra" utype="x:lon" ref="sys1"><DESCRIPTION>Longitude &lt; 360</DESCRIPTION></FIELD>' in text
    assert '<FIELD name="b" datatype="double"/>' in text and '<INFO name="PROVIDER" value="harbour">Of a small harbour</INFO>' in text


def test_own_separator_and_fits_in_votable(described):
    assert written(described, "PSV", "SELECT id, lon FROM buoy ORDER BY id", maxrec=1) == (b"id|lon\n1|2.5\n", True)
    text, over = written(described, "votable/fits", "SELECT id, lon FROM buoy ORDER BY id", maxrec=1)
    inside = text.partition(b'<STREAM encoding="base64">')[2].partition(b"</STREAM>")[0]
    raw = base64.b64decode(inside)
    assert over and raw.startswith(b"SIMPLE  =") and len(raw) % 2880 == 0 and b'value="OVERFLOW"' in text


def test_catalog_from_its_own_description(spark, described):
    described.catalog.describe(spark)
    frames = {t.name: t.df for t in described.catalog.tables if t.schema == "TAP_SCHEMA"}
    assert {"coosys", "keys"} <= set(frames)
    rows = next(t.df for t in described.catalog.tables if t.name == "buoy")
    got = read_tap_schema(frames.get, lambda table: rows.withColumnRenamed("lon", "LON"))
    assert [(t.full_name, t.description) for t in got.tables] == [("sea.buoy", "Floats")] and got.coosys == described.catalog.coosys
    assert [(c.name, c.type, c.unit, c.ucd) for c in got.tables[0].columns] == [("id", "INTEGER", None, None), ("lon", "DOUBLE", "deg", "pos.eq.ra")]
    assert got.keys == described.catalog.keys and got.schemas["sea"]["description"] == "Buoys & ships"
    assert Engine(spark, got).query("SELECT lon FROM sea.buoy WHERE id = 1").rows()[0] == [(2.5,)]
    assert read_tap_schema(lambda name: None).tables == []
    with pytest.raises(ValueError, match="lacks the columns lon"):
        read_tap_schema(frames.get, lambda table: rows.drop("lon"))


def test_jdbc_options(monkeypatch, spark):
    asked = []

    class Reader:
        def format(self, name):
            assert name == "jdbc"
            return self

        def options(self, **options):
            asked.append(options)
            return self

        def load(self):
            return spark.range(3)

    monkeypatch.setattr(type(spark), "read", property(lambda self: Reader()))
    got = jdbc_catalog(spark, "jdbc:x", ["public.a", "b"], fetch_size=500, ranges={"b": ("id", 0, 90, 4)}, user="me")
    assert [t.name for t in got.tables] == ["a", "b"] and asked[0] == {"url": "jdbc:x", "dbtable": "public.a", "fetchsize": "500", "user": "me"}
    assert asked[2] == {"partitionColumn": "id", "lowerBound": "0", "upperBound": "90", "numPartitions": "4"}


def test_command_line(tmp_path, capsys, described):
    query, tables = tmp_path / "q", tmp_path / "t.xml"
    query.write_text("SELECT id  FROM sea.buoy WHERE lon>1;")
    tables.write_text(write_tableset(described.catalog))
    assert main([str(query)]) == 0 and capsys.readouterr().out == ""
    assert main(["-s", "-t", str(tables), str(query)]) == 0 and "sea.buoy AS s1" in capsys.readouterr().out
    assert main(["-a", str(query)]) == 0 and capsys.readouterr().out.startswith("SELECT")
    assert main(["-a", "-s", str(query)]) == 1 and main(["-s", str(query)]) == 1 and main([str(tmp_path / "none")]) == 2
    query.write_text("SELECT mast FROM sea.buoy")
    assert main(["-t", str(tables), str(query)]) == 3
    query.write_text("SELECT FROM")
    assert main([str(query)]) == 3
