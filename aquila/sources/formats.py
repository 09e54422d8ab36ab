"""Results as text and files. Rows are streamed partition by partition; all formats stop at MAXREC and tell an overflow.
With MAXREC 0 none writes a row."""

from __future__ import annotations

import base64
import html
import json
import math
import struct
import tempfile
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import IO, TYPE_CHECKING, Any
from xml.sax.saxutils import escape

from pyspark.sql import types as T

from aquila.sources.catalog import type_of
from aquila.sources.votable import binary_cell, cell, write_header
from aquila.streaming.rows import Limited

if TYPE_CHECKING:
    from aquila.session import Result

Writer = Callable[["Result", IO[bytes]], bool]


def columns_of(result: Result) -> list[tuple[str, str]]:
    """Names, and types: those that resolution found, else what the DataFrame has."""
    out = []
    for o, f in zip(result.compiled.outputs, result.df.schema.fields):
        out.append((o.name, o.type if o.type not in ("UNKNOWN", "UNKNOWN_NUMERIC") else type_of(f.dataType)))
    return out


def plain(value: Any, type_: str = "") -> Any:
    """Times as ISO-8601, booleans as 0 and 1, points as STC-S."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime):
        return value.isoformat()
    if type_ == "POINT" and isinstance(value, T.Row):
        return f"Position {value['lon']!r} {value['lat']!r}"
    return value


def _rows(result: Result) -> Limited:
    return Limited(result.df, result.maxrec)


def separated(separator: str) -> Writer:
    """Names, then rows. Strings stand in double quotes, with inner ones as single quotes; other values only if they hold the
    separator; nulls are empty."""

    def write(result: Result, out: IO[bytes]) -> bool:
        text = lambda s: '"' + s.replace('"', "'") + '"'
        columns = columns_of(result)
        out.write((separator.join(n if separator not in n and '"' not in n else text(n) for n, _ in columns) + "\n").encode())
        rows = _rows(result)
        for row in rows:
            cells = []
            for v, (_, t) in zip(row, columns):
                v = plain(v, t)
                s = cell(v)
                cells.append(text(s) if isinstance(v, str) or separator in s else s)
            out.write((separator.join(cells) + "\n").encode())
        return rows.overflow

    return write


def write_json(result: Result, out: IO[bytes]) -> bool:
    columns = columns_of(result)
    meta = []
    for (n, t), o in zip(columns, result.compiled.outputs):
        kind = {"SMALLINT": "short", "INTEGER": "int", "BIGINT": "long", "REAL": "float", "DOUBLE": "double"}.get(t)
        one: dict[str, Any] = {"name": n}
        if o.source and o.source.description:
            one["description"] = o.source.description
        one["datatype"] = kind or "char"
        if not kind:
            one["arraysize"] = "*"
            if t in ("TIMESTAMP", "POINT", "REGION"):
                one["xtype"] = f"adql:{t}"
        one |= {k: v for k in ("unit", "ucd", "utype") if (v := getattr(o.source, k, None))}
        meta.append(one)
    out.write(b'{"metadata":' + json.dumps(meta, ensure_ascii=False).encode() + b',"data":[')
    rows = _rows(result)
    for i, row in enumerate(rows):
        values = [plain(v, t) for v, (_, t) in zip(row, columns)]
        values = [None if isinstance(v, float) and not math.isfinite(v) else cell(v) if isinstance(v, (bytes, bytearray)) else v for v in values]
        out.write((",\n" if i else "\n").encode() + json.dumps(values, ensure_ascii=False, default=str).encode())
    out.write(b"\n]}")
    return rows.overflow


def write_text(result: Result, out: IO[bytes]) -> bool:
    """Aligned columns. Widths need all rows, which wait in a file beyond a megabyte."""
    columns = columns_of(result)
    width = [len(n) for n, _ in columns]
    rows = _rows(result)
    with tempfile.SpooledTemporaryFile(max_size=1_000_000, mode="w+", encoding="utf-8") as kept:
        for row in rows:
            cells = [cell(plain(v, t)).replace("\n", " ") for v, (_, t) in zip(row, columns)]
            width = [max(w, len(c)) for w, c in zip(width, cells)]
            kept.write(json.dumps(cells) + "\n")
        line = lambda cells: ("|".join(f" {c:<{w}} " for c, w in zip(cells, width)).rstrip() + "\n").encode()
        out.write(line([n for n, _ in columns]))
        out.write(("+".join("-" * (w + 2) for w in width) + "\n").encode())
        kept.seek(0)
        for raw in kept:
            out.write(line(json.loads(raw)))
    if rows.overflow:
        out.write(b"\nOVERFLOW: the row limit was reached, rows beyond it are left out\n")
    return rows.overflow


def write_html(result: Result, out: IO[bytes]) -> bool:
    columns = columns_of(result)
    out.write(b"<table>\n<caption>Query result</caption>\n<thead><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n, _ in columns).encode() + b"</tr></thead>\n<tbody>\n")
    rows = _rows(result)
    for row in rows:
        out.write(("<tr>" + "".join(f"<td>{html.escape(cell(plain(v, t)))}</td>" for v, (_, t) in zip(row, columns)) + "</tr>\n").encode())
    if rows.overflow:
        out.write(f'<tr class="overflow"><td colspan="{len(columns)}"><em><strong>OVERFLOW</strong>: the row limit was reached, rows beyond it are left out</em></td></tr>\n'.encode())
    out.write(b"</tbody>\n</table>\n")
    return rows.overflow


def votable(form: str = "BINARY") -> Writer:
    """form: TABLEDATA, BINARY, BINARY2 or FITS."""

    def write(result: Result, out: IO[bytes]) -> bool:
        columns = columns_of(result)
        infos = [("QUERY_STATUS", "OK", ""), *([("PROVIDER", *result.provider)] if result.provider else []), ("QUERY", result.query, "")]
        if result.fixed:
            infos.append(("QUERY_AFTER_AUTO_FIX", result.fixed, ""))
        write_header(out, infos, [(n, t, o.source) for (n, t), o in zip(columns, result.compiled.outputs)], result.systems)
        if form == "FITS":
            with tempfile.SpooledTemporaryFile(max_size=1_000_000) as kept:
                over = write_fits(result, kept)
                kept.seek(0)
                out.write(b'<DATA><FITS><STREAM encoding="base64">\n')
                for raw in iter(lambda: kept.read(5700), b""):
                    out.write(base64.b64encode(raw) + b"\n")
                out.write(b"</STREAM></FITS></DATA>\n")
            _close(out, over)
            return over
        rows = _rows(result)
        if form == "TABLEDATA":
            out.write(b"<DATA><TABLEDATA>\n")
            for row in rows:
                out.write(("<TR>" + "".join(f"<TD>{escape(cell(plain(v, t)))}</TD>" for v, (_, t) in zip(row, columns)) + "</TR>\n").encode())
            out.write(b"</TABLEDATA></DATA>\n")
        else:
            out.write(f'<DATA><{form}><STREAM encoding="base64">\n'.encode())
            for raw in _whole_lines(_binary(rows, columns, form == "BINARY2")):
                out.write(base64.b64encode(raw) + b"\n")
            out.write(f"</STREAM></{form}></DATA>\n".encode())
        _close(out, rows.overflow)
        return rows.overflow

    return write


def _close(out: IO[bytes], overflow: bool) -> None:
    out.write(b"</TABLE>\n")
    if overflow:
        out.write(b'<INFO name="QUERY_STATUS" value="OVERFLOW"/>\n')
    out.write(b"</RESOURCE>\n</VOTABLE>\n")


def _binary(rows: Limited, columns: list[tuple[str, str]], null_flags: bool) -> Iterator[bytes]:
    for row in rows:
        values = [plain(v, t) for v, (_, t) in zip(row, columns)]
        flags = bytearray(-(-len(columns) // 8) if null_flags else 0)
        for i, v in enumerate(values):
            if v is None and null_flags:
                flags[i // 8] |= 128 >> (i % 8)
        yield bytes(flags) + b"".join(binary_cell(v, t) for v, (_, t) in zip(values, columns))


def _whole_lines(parts: Iterator[bytes], size: int = 5700) -> Iterator[bytes]:
    """Pieces of a multiple of three bytes, so that their base64 can be joined."""
    held = b""
    for part in parts:
        held += part
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def write_fits(result: Result, out: IO[bytes]) -> bool:
    """A binary table extension. Widths of strings and the number of rows come first, so rows wait in a file."""
    columns = columns_of(result)
    codes = {"SMALLINT": ("I", ">h"), "INTEGER": ("J", ">i"), "BIGINT": ("K", ">q"), "REAL": ("E", ">f"), "DOUBLE": ("D", ">d")}
    width = [1] * len(columns)
    rows, n = _rows(result), 0
    with tempfile.SpooledTemporaryFile(max_size=1_000_000) as kept:
        for row in rows:
            n += 1
            for i, (v, (_, t)) in enumerate(zip(row, columns)):
                if t in codes:
                    v = (float("nan") if t in ("REAL", "DOUBLE") else 0) if v is None else v
                    kept.write(struct.pack(codes[t][1], v))
                else:
                    raw = cell(plain(v, t)).encode("ascii", "replace")
                    width[i] = max(width[i], len(raw))
                    kept.write(struct.pack(">i", len(raw)) + raw)
        size = sum(struct.calcsize(codes[t][1]) if t in codes else w for w, (_, t) in zip(width, columns))

        def header(cards: list[tuple[str, Any]]) -> bytes:
            lines = []
            for k, v in cards:
                text = ("T" if v else "F") if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{str(v)[:66].replace(chr(39), chr(39) * 2):<8}'"
                lines.append(f"{k:<8}= {text:>20}" if not isinstance(v, str) else f"{k:<8}= {text}")
            raw = "".join(f"{x:<80}"[:80] for x in [*lines, "END"]).encode("ascii", "replace")
            return raw + b" " * (-len(raw) % 2880)

        out.write(header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]))
        cards: list[tuple[str, Any]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", size), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
        for i, (w, (name, t)) in enumerate(zip(width, columns), 1):
            cards += [(f"TTYPE{i}", name), (f"TFORM{i}", f"1{codes[t][0]}" if t in codes else f"{w}A")]
        out.write(header(cards))
        kept.seek(0)
        for _ in range(n):
            for w, (_, t) in zip(width, columns):
                if t in codes:
                    out.write(kept.read(struct.calcsize(codes[t][1])))
                else:
                    out.write(kept.read(struct.unpack(">i", kept.read(4))[0]).ljust(w))
        out.write(b"\0" * (-(size * n) % 2880))
    return rows.overflow


_CSV, _TSV = separated(","), separated("\t")
FORMATS: dict[str, Writer] = {
    "votable": votable(), "application/x-votable+xml": votable(), "text/xml": votable(), "votable/b": votable(), "votable/b2": votable("BINARY2"), "votable/td": votable("TABLEDATA"), "votable/fits": votable("FITS"), "application/x-votable+xml;serialization=fits": votable("FITS"),
    "application/x-votable+xml;serialization=binary": votable(), "application/x-votable+xml;serialization=binary2": votable("BINARY2"), "application/x-votable+xml;serialization=tabledata": votable("TABLEDATA"),
    "fits": write_fits, "application/fits": write_fits, "csv": _CSV, "text/csv": _CSV, "tsv": _TSV, "text/tab-separated-values": _TSV, "json": write_json, "application/json": write_json,
    "text": write_text, "text/plain": write_text, "html": write_html, "text/html": write_html,
}


def find_format(name: str | None, own: dict[str, Writer] | None = None) -> Writer:
    """By short name or MIME type, whatever its case, the service's own formats first; VOTable if there is none of that name."""
    known = FORMATS | {k.lower(): v for k, v in (own or {}).items()}
    return known.get("".join((name or "").lower().split()), FORMATS["votable"])
