"""Archives and their index."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from aquila.llm import warc

PAGES = "page_id bigint, url string, html string, offset int"


def brute(rows):
    first = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            first[h].append(i)
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        most = max((x for x in first.get(h, ()) if x is not None), default=None)
        refers = most if len(raw) >= 1000 and most is not None and (i is None or i < most) else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def rows():
    big, other = "é" * 600, "y" * 1000
    return [(1, "http://A.com/x", big), (2, "https://b.a.com/?q", big), (9, None, big), (9, None, big), (None, "odd url\r\nX: 1", big), (3, "", None), (4, "u", ""), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "http://a.com/x", other + "\r\n\r\nWARC/1.1\r\n"), (-8, "u", other), (None, "n", "z" * 2000)]


def test_archive(spark, monkeypatch):
    pages = spark.createDataFrame([(*r, 0) for r in rows()], PAGES).repartition(3)
    got = warc.archive(pages).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute(rows())
    keys = [warc.order(tuple(r)) for r in got]
    assert keys == sorted(keys)
    assert warc.archive(pages.limit(0)).collect() == []


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 0) for r in rows()], PAGES).repartition(2)
    paths = warc.export_archives(warc.write_archives(pages), str(tmp_path))
    raw = b"".join(gzip.open(p).read() for p in paths)
    assert raw.count(b"WARC-Type: ") == len(rows()) and b"%0D%0AX:%201" in raw
    records = [(h, b) for p in paths for _, _, h, b in warc.read_records(open(p, "rb").read())]
    assert {h["WARC-Type"] for h, _ in records} == {"response", "revisit"}
    assert sorted(b.partition(b"\r\n\r\n")[2] for h, b in records if h["WARC-Type"] == "response").count(("é" * 600).encode()) == 2


def test_damage_is_noticed():
    one = gzip.compress(warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, warc.FIRST_CAPTURE), mtime=0)
    assert warc.capture("s", *next(warc.read_records(one)))[2:6] == (1, 7, hashlib.sha1(b"payload").hexdigest(), "response")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(one[:-12]))
    wrong = gzip.compress(warc.record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None, warc.FIRST_CAPTURE))
    with pytest.raises(ValueError, match="digest"):
        warc.capture("s", *next(warc.read_records(wrong)))


def test_keys_and_ids():
    assert warc.url_key("http://u@B.A.com:80/x?y#z") == "com,a,b)/x?y" and warc.url_key("https://a.com") == "com,a)/" and warc.url_key(None) == "" and warc.url_key("no url") == "no url"
    assert [warc.page_of(warc.record_id(x)) for x in (0, 7, -3, None, 2**62)] == [0, 7, -3, None, 2**62]


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(50), j) for _ in range(r.randrange(9))) for j in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(sum(runs, []))


def test_runs_are_found_again():
    row = lambda k: (k, "t", 1, 1, "d", "response", None, "s", 0, 1)
    runs = []
    for batch in (["b", "d"], ["d", "e", "a"], ["a", "c"], ["b"]):
        warc.take_runs(map(row, batch), runs)
    assert [[r[0] for r in run] for run in runs] == [["b", "d", "d", "e"], ["a", "a", "c"], ["b"]]


def test_captures_reach_the_merge_as_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 4000)
    pages = spark.createDataFrame([(i, f"http://h{i * 7919 % 1000}.net/", f"page {i}", 0) for i in range(300)], PAGES).repartition(2)
    captures = warc.written(warc.read_archives(warc.write_archives(pages)), "captures")
    segments = captures.select("segment").distinct().count()

    def run(batches):
        runs, rows = [], 0
        for b in batches:
            warc.take_runs(warc._rows(b), runs)
        yield pa.record_batch([pa.array([len(runs)], pa.int64()), pa.array([sum(map(len, runs))], pa.int64())], ["runs", "rows"])

    dealt = captures.repartitionByRange(2, "url_key", "capture_time", "page_id", "segment", "offset").mapInArrow(run, "runs bigint, rows bigint").collect()
    assert segments > 5 and sum(r["rows"] for r in dealt) == 300 and all(r["runs"] <= segments for r in dealt)


@pytest.mark.parametrize("fan_in", [2, 3, 100])
def test_merge_spills(monkeypatch, fan_in):
    monkeypatch.setattr(warc, "HELD_ROWS", 30)
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "READ_ROWS", 7)
    r = random.Random(2)
    data = [(f"k{r.randrange(5)}", f"t{r.randrange(5)}", r.choice([None, *range(9)]), 1, "d", "response", None, "s", r.randrange(999), 1) for _ in range(200)]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*data[i : i + 12]), kinds)], warc.NAMES) for i in range(0, 200, 12)]
    out = [row for b in warc.merge_runs(batches) for row in warc._rows(b)]
    assert [warc.order(x) for x in out] == sorted(map(warc.order, data)) and Counter(out) == Counter(data)
    assert list(warc.merge_runs([])) == []


def test_times_are_written_in_utc():
    from datetime import UTC, datetime, timedelta, timezone

    local = datetime(2023, 11, 14, 17, 13, 20, tzinfo=timezone(timedelta(hours=-5)))
    for time in (local, local.astimezone(UTC), datetime(2023, 11, 14, 22, 13, 20)):
        assert b"WARC-Date: 2023-11-14T22:13:20Z" in warc.record(1, "http://a/", b"x", "00" * 20, None, time)
