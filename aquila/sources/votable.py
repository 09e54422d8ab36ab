"""VOTables: XML documents of one table."""

from __future__ import annotations

import base64
import io
import struct
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import IO, Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aquila.functions.stcs import parse_region
from aquila.sources.catalog import SPARK_TYPES, Column, Coosys

# Types of the format, and of the language.
NUMBERS = {"short": ("SMALLINT", ">h"), "int": ("INTEGER", ">i"), "long": ("BIGINT", ">q"), "float": ("REAL", ">f"), "double": ("DOUBLE", ">d"), "unsignedByte": ("SMALLINT", ">B")}
OUT = {"SMALLINT": "short", "INTEGER": "int", "BIGINT": "long", "REAL": "float", "DOUBLE": "double", "UNKNOWN_NUMERIC": "double"}
ROW_BATCH = 20_000


class VotableError(ValueError):
    pass


def field_type(datatype: str, arraysize: str | None, xtype: str | None) -> str:
    """The language's type of a field. Numeric arrays are binaries, booleans small integers."""
    if arraysize and "x" in arraysize:
        raise VotableError(f"Multi-dimensional arrays are not supported: {arraysize}")
    if xtype and (word := xtype.lower().rpartition(":")[2]) in ("timestamp", "point", "region", "clob", "blob"):
        return word.upper()
    if datatype == "boolean":
        return "SMALLINT"
    if datatype in NUMBERS:
        if arraysize in (None, "1"):
            return NUMBERS[datatype][0]
        return "VARBINARY" if arraysize.endswith("*") or datatype != "unsignedByte" else "BINARY"
    if arraysize in (None, "1") or arraysize.isdigit():
        return "CHAR"
    return "VARCHAR"


def _value(type_: str, spark_type: T.DataType) -> Callable[[str], Any]:
    if type_ in ("SMALLINT", "INTEGER", "BIGINT"):
        return lambda s: {"t": 1, "true": 1, "1": 1, "f": 0, "false": 0, "0": 0}.get(s.lower()) if s.lower() in ("t", "f", "true", "false") else int(s, 0)
    if type_ in ("REAL", "DOUBLE"):
        return lambda s: float(s.replace("+Inf", "inf").replace("-Inf", "-inf"))
    if type_ == "TIMESTAMP":
        return lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")).replace(tzinfo=None)
    if type_ in ("POINT", "REGION"):
        return lambda s: (parse_region(s), s)[1]
    if isinstance(spark_type, T.BinaryType):
        return lambda s: bytes(int(x) & 255 for x in s.split())
    return lambda s: s.replace("\0", "")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _binary_rows(data: bytes, fields: list[dict[str, str]], null_flags: bool) -> Iterator[list[Any]]:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise VotableError("the stream ends within a row")
        at += n
        return data[at - n : at]

    while at < len(data):
        flags = take(-(-len(fields) // 8)) if null_flags else b""
        row = []
        for i, f in enumerate(fields):
            kind, size = f["datatype"], f.get("arraysize")
            width = {"boolean": 1, "char": 1, "unicodeChar": 2}.get(kind) or struct.calcsize(NUMBERS[kind][1])
            count = struct.unpack(">i", take(4))[0] if size and size.endswith("*") else int(size or 1)
            raw = take(width * count)
            if kind in ("char", "unicodeChar"):
                value: Any = raw.decode("utf-8" if kind == "char" else "utf-16-be").rstrip("\0") or None
            elif size not in (None, "1"):
                value = raw
            elif kind == "boolean":
                value = {b"T": 1, b"t": 1, b"1": 1, b"F": 0, b"f": 0, b"0": 0}.get(raw)
            else:
                value = struct.unpack(NUMBERS[kind][1], raw)[0]
                if value != value or "null" in f and value == int(f["null"]):
                    value = None
            row.append(None if flags and flags[i // 8] >> (7 - i % 8) & 1 else value)
        yield row


def parse_votable(data: bytes) -> tuple[list[tuple[str, str]], Iterator[list[Any]]]:
    """The first table's columns as (name, type), and its rows: TABLEDATA as it is read, BINARY and BINARY2."""
    fields: list[dict[str, str]] = []
    events = ElementTree.iterparse(io.BytesIO(data), ("start", "end"))
    form = None
    try:
        for event, e in events:
            tag = _local(e.tag)
            if tag == "FIELD" and event == "start":
                fields.append(dict(e.attrib))
            elif tag == "VALUES" and event == "start" and fields and "null" in e.attrib:
                fields[-1]["null"] = e.attrib["null"]
            elif tag in ("TABLEDATA", "BINARY", "BINARY2") and event == "start":
                form = tag
                break
            elif tag == "TABLE" and event == "end":
                break
    except ElementTree.ParseError as problem:
        raise VotableError(f"no VOTable: {problem}") from None
    if not fields:
        raise VotableError("No VOTable: no FIELD can be found!")
    columns = [(f.get("name", f"col{i}"), field_type(f["datatype"], f.get("arraysize"), f.get("xtype"))) for i, f in enumerate(fields, 1)]

    def rows() -> Iterator[list[Any]]:
        if form is None:
            return
        if form != "TABLEDATA":
            for event, e in events:
                if event == "end" and _local(e.tag) == "STREAM":
                    types = [t for _, t in columns]
                    for row in _binary_rows(base64.b64decode(e.text or ""), fields, form == "BINARY2"):
                        yield [_value(t, SPARK_TYPES[t])(v) if isinstance(v, str) and t in ("TIMESTAMP", "POINT", "REGION") else v for v, t in zip(row, types)]
                    return
            return
        convert = [_value(t, SPARK_TYPES[t]) for _, t in columns]
        for event, e in events:
            if event == "end" and _local(e.tag) == "TR":
                cells = [c.text or "" for c in e]
                row = []
                for cell, f, to in zip(cells, fields, convert):
                    s = cell if f["datatype"] in ("char", "unicodeChar") else cell.strip()
                    value = None if s == "" or s == f.get("null") else to(s)
                    row.append(None if value != value else value)
                yield row
                e.clear()
            elif event == "end" and _local(e.tag) == "TABLEDATA":
                return

    return columns, rows()


def read_votable(spark: SparkSession, data: bytes, max_rows: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A DataFrame, and the columns' types in the language. Rows go to Spark in batches."""
    from aquila.sources.uploads import UploadError

    columns, rows = parse_votable(data)
    schema = T.StructType([T.StructField(name, SPARK_TYPES[t]) for name, t in columns])
    parts, batch, n = [], [], 0
    for row in rows:
        batch.append(row)
        n += 1
        if max_rows is not None and n > max_rows:
            raise UploadError(f"Data overflow: the upload has more than {max_rows} rows")
        if len(batch) == ROW_BATCH:
            parts.append(spark.createDataFrame(batch, schema))
            batch = []
    if batch or not parts:
        parts.append(spark.createDataFrame(batch, schema))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df, dict(columns)


def field_attributes(type_: str) -> str:
    if type_ in OUT:
        return f'datatype="{OUT[type_]}"'
    if type_ in ("BINARY", "VARBINARY", "BLOB"):
        return 'datatype="unsignedByte" arraysize="*"' + (' xtype="adql:BLOB"' if type_ == "BLOB" else "")
    xtype = f' xtype="adql:{type_}"' if type_ in ("TIMESTAMP", "POINT", "REGION", "CLOB") else ""
    return f'datatype="char" arraysize="*"{xtype}'


def cell(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "NaN" if value != value else {float("inf"): "+Inf", float("-inf"): "-Inf"}.get(value, repr(value))
    if isinstance(value, (bytes, bytearray)):
        return " ".join(map(str, value))
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


def binary_cell(value: Any, type_: str) -> bytes:
    if type_ in OUT:
        code = dict(NUMBERS.values())[type_] if type_ != "UNKNOWN_NUMERIC" else ">d"
        if value is None:
            value = float("nan") if code in (">f", ">d") else 0
        return struct.pack(code, value)
    raw = bytes(value or b"") if type_ in ("BINARY", "VARBINARY", "BLOB") else cell(value).encode()
    return struct.pack(">i", len(raw)) + raw


def write_header(out: IO[bytes], infos: list[tuple[str, str, str]], columns: list[tuple[str, str, Column | None]], systems: Iterable[Coosys] = ()) -> None:
    """Of the coordinate systems those that columns refer to."""
    write = lambda s: out.write((s + "\n").encode())
    write('<?xml version="1.0" encoding="UTF-8"?>')
    write('<VOTABLE version="1.3" xmlns="http://www.ivoa.net/xml/VOTable/v1.3">')
    write('<RESOURCE type="results">')
    for name, value, text in infos:
        write(f"<INFO name={quoteattr(name)} value={quoteattr(value)}{f'>{escape(text)}</INFO>' if text else '/>'}")
    used = {c.coosys for _, _, c in columns if c}
    systems = [s for s in systems if s.id in used]
    for s in systems:
        write(f"<COOSYS ID={quoteattr(s.id)}" + "".join(f" {k}={quoteattr(v)}" for k in ("system", "equinox", "epoch") if (v := getattr(s, k))) + "/>")
    write("<TABLE>")
    for name, type_, more in columns:
        extra = "".join(f" {k}={quoteattr(v)}" for k in ("unit", "ucd", "utype") if (v := getattr(more, k, None)))
        if more and any(s.id == more.coosys for s in systems):
            extra += f" ref={quoteattr(more.coosys)}"
        text = more.description if more else None
        write(f"<FIELD name={quoteattr(name)} {field_attributes(type_)}{extra}{f'><DESCRIPTION>{escape(text)}</DESCRIPTION></FIELD>' if text else '/>'}")
