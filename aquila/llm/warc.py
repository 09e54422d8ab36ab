"""WARC archives and their index.

Archives are sequences of records, each a gzip member of its own, kept in segments of bounded size: rows of a Parquet
table, which Spark commits whole or not at all on whatever store it uses. The index is merged externally: every task reads
its segments into locally sorted runs, the keys are dealt by range, and each range merges its runs with a loser tree,
spilling runs that don't fit. The ranges in turn are the captures of all archives by URL key and time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from pathlib import Path
from uuid import UUID

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.batches import chunks
from aquila.llm.tables import load, ship, written

#: Shorter payloads are always stored.
LEAST_REVISITED = 1000
#: Compressed bytes from which a segment is closed.
SEGMENT_BYTES = 8_000_000
#: Rows of a range that are held in memory before runs are spilled, and rows read at once from a spilled run.
HELD_ROWS, READ_ROWS = 100_000, 2_000
#: Files of one level that are merged at once.
FAN_IN = 32
#: Compressed bytes that are given to the decompressor at once.
READ_BYTES = 16_384
#: The time of capture of a page without one: its id in seconds after this.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OWN, _OWN_NULL = 0x61717569_6C615741, 0x61717569_6C615742
CAPTURE = "url_key string, capture_time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, segment string, offset bigint, length bigint"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{UUID(int=(_OWN_NULL << 64) if page_id is None else (_OWN << 64) | (page_id & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    number = UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (2**64 - 1)
    return None if number >> 64 == _OWN_NULL else low - 2**64 if low >> 63 else low


def url_key(url: str | None) -> str:
    """The host's parts in reverse, then the path and query: http://b.A.com/x?y#z is com,a,b)/x?y."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").partition("#")[0]
    host = m[1].rpartition("@")[2].lower().partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def utc(time: datetime) -> datetime:
    """Without a zone it is UTC already."""
    return time.astimezone(UTC) if time.tzinfo else time.replace(tzinfo=UTC)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, time: datetime) -> bytes:
    """An uncompressed record; a revisit if it refers to a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {utc(time):%Y-%m-%dT%H:%M:%SZ}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(segment: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and block of each record of a segment."""
    at, view = 0, memoryview(segment)
    while at < len(segment):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(segment):  # in steps, as what follows the member is copied
            parts.append(member.decompress(view[end : end + READ_BYTES]))
            end = min(len(segment), end + READ_BYTES)
        raw = b"".join(parts)
        if not member.eof:
            raise ValueError(f"record at {at} is cut off")
        length = end - at - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has another length than it says")
        yield at, length, headers, rest[:size]
        at += length


def capture(segment: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index row of a record; a stored payload is held against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of the record at {offset} of {segment} is not what its digest says")
    return (url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], page_of(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None, segment, offset, length)


class LoserTree:
    """Merges sorted iterators: every inner place holds the loser of its match, so a new head plays one match a level."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.n = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.n)
        for i in range(self.n):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        place = (winner + self.n) // 2
        while place:
            other = self.losers[place]
            if other < 0:  # as the tree is set up: waits here for its opponent
                self.losers[place] = winner
                return
            if self._before(other, winner):
                self.losers[place], winner = winner, other
            place //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = head = next(self.runs[w], None)
            self.keys[w] = None if head is None else self.key(head)
            self._play(w)


def order(row: tuple) -> tuple:
    """By URL key, time and page, nulls first, then place in the archive."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def take_runs(rows: Iterable[tuple], runs: list[list[tuple]]) -> None:
    """Appends rows to sorted runs: a row goes on with the last run if it isn't before its end, else it begins another. What a
    task of the sorted captures sent comes in order, so its runs are found again as they were."""
    last = order(runs[-1][-1]) if runs else None
    for row in rows:
        key = order(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key


def merge_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sorted runs that come in; those beyond HELD_ROWS are merged into a file. FAN_IN files of one level are merged
    into one of the next, so no merge reads more than FAN_IN files of a level."""
    with tempfile.TemporaryDirectory() as folder:
        held, levels, n, files, schema = [], [[]], 0, 0, None

        def spilled(path: Path) -> Iterator[tuple]:
            with pa.OSFile(str(path)) as file, pa.ipc.open_stream(file) as reader:
                for part in reader:
                    yield from _rows(part)

        def parts(runs: list[Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
            merged = iter(LoserTree(runs, order))
            while rows := list(itertools.islice(merged, READ_ROWS)):
                yield _batch(rows, schema)

        def spill(runs: list[Iterator[tuple]], level: int) -> None:
            nonlocal files
            path, files = Path(folder, f"{files}.arrow"), files + 1
            with pa.OSFile(str(path), "w") as file, pa.ipc.new_stream(file, schema) as writer:
                for part in parts(runs):
                    writer.write_batch(part)
            if level == len(levels):
                levels.append([])
            levels[level].append(path)
            if len(full := levels[level]) == FAN_IN:
                spill([spilled(p) for p in full], level + 1)
                for old in full:
                    old.unlink()
                full.clear()

        for batch in batches:
            schema = schema or pa.schema([(f.name, f.type) for f in batch.schema])
            take_runs(_rows(batch), held)
            n += batch.num_rows
            if n > HELD_ROWS:
                spill([iter(h) for h in held], 0)
                held.clear()
                n = 0
        yield from parts([*(spilled(p) for level in levels for p in level), *(iter(h) for h in held)])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = LEAST_REVISITED) -> DataFrame:
    """Segments (segment, data) of archives with one record a row of ``pages``, as a written table.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others revisit
    it; other rows are responses. A null payload is empty. A null id is smaller than all others, and a response if its
    group has no other. A null url leaves WARC-Target-URI out. Rows that repeat an id each get a record.
    """
    ship(pages.sparkSession)
    # a null time is the default's too
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"), (F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")).alias("time"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("d", "first")
    rows = rows.join(written(groups, "equal-payloads"), F.col("digest") == F.col("d"), "left")
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first")).alias("refers_to"), "time")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n = [], 0, 0
        task = TaskContext.get().partitionId()
        segment = lambda: pa.record_batch([pa.array([f"{task:06}-{n:06}"]), pa.array([b"".join(parts)], pa.binary())], ["segment", "data"])
        for batch in chunks(batches, "html"):
            for page_id, url, text, digest, refers_to, time in _rows(batch):
                time = time or FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)
                member = gzip.compress(record(page_id, url, text.encode(), digest, refers_to, time), 1, mtime=0)
                if parts and size + len(member) > SEGMENT_BYTES:
                    yield segment()
                    parts, size, n = [], 0, n + 1
                parts.append(member)
                size += len(member)
        if parts:
            yield segment()

    return written(rows.mapInArrow(run, "segment string, data binary"), "archives")


def export_archives(segments: DataFrame, folder: str) -> list[str]:
    """The segments as .warc.gz files in a folder of the driver; returns their paths."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in segments.orderBy("segment").toLocalIterator():
        path = Path(folder, f"{r['segment']}.warc.gz")
        path.write_bytes(r["data"])
        out.append(str(path))
    return out


def read_archives(segments: DataFrame) -> DataFrame:
    """Captures of all records, sorted within each segment: url_key, capture_time, page_id, payload_bytes, payload_digest,
    record_type, refers_to, segment, offset and length (of the compressed record)."""
    ship(segments.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = sorted((capture(name, *r) for r in read_records(data.as_py())), key=order)
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

    return segments.select("segment", "data").mapInArrow(run, CAPTURE)


def merge_index(captures: DataFrame) -> DataFrame:
    """``captures`` in the order of URL key, time and page over all partitions: histories that several ranges share go on
    in the next."""
    return captures.repartitionByRange("url_key", "capture_time", "page_id", "segment", "offset").mapInArrow(merge_runs, CAPTURE)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of ``pages``, reads them and merges their index. An empty table gives an empty index; other columns
    are ignored; see write_archives for nulls and repeats."""
    return merge_index(written(read_archives(write_archives(pages, **options)), "captures"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d),
r AS (SELECT p.*, CASE WHEN n >= 1000 AND (page_id IS NULL OR page_id < first) THEN first END AS refers_to FROM p LEFT JOIN g ON p.d = g.d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
