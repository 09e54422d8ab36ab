"""Tables that users bring with a query."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

from aquila.plans.lexer import REGULAR
from aquila.sources.catalog import Catalog, Table

_numbers = itertools.count()
SCHEMA = "TAP_UPLOAD"


@dataclass(frozen=True)
class Limits:
    rows: int | None = 1_000_000
    bytes: int | None = 250 * 2**20


class UploadError(ValueError):
    pass


def parse_spec(text: str) -> dict[str, str]:
    """label,uri[;label,uri...]"""
    out: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        label, comma, uri = part.partition(",")
        if not comma or not uri:
            raise UploadError(f"Incorrect UPLOAD syntax: {part!r} is no label,uri pair")
        out[label.strip()] = uri.strip()
    return out


def _fetch(uri: str, limits: Limits) -> bytes:
    parts = urlparse(uri)
    if parts.scheme == "file":
        raise UploadError("URIs of the scheme file: are not allowed")
    if parts.scheme not in ("http", "https", "ftp"):
        raise UploadError(f"URIs of the scheme {parts.scheme}: are not supported here")
    with urlopen(uri) as source:  # noqa: S310
        return _bounded(source.read(-1 if limits.bytes is None else limits.bytes + 1), limits)


def _bounded(data: bytes, limits: Limits) -> bytes:
    if limits.bytes is not None and len(data) > limits.bytes:
        raise UploadError(f"Data overflow: an upload holds more than {limits.bytes} bytes")
    return data


def load_uploads(spark: SparkSession, uploads: str | dict[str, object] | None, limits: Limits) -> list[Table]:
    """Files are VOTables. Labels and column names must be unique, whatever their case."""
    from aquila.sources.votable import read_votable

    given = parse_spec(uploads) if isinstance(uploads, str) else dict(uploads or {})
    parts = {k: v for k, v in given.items() if not (isinstance(v, str) and v.startswith("param:"))}
    catalog, seen = Catalog(), set()
    for label, source in given.items():
        if label not in parts:  # another part of the same request
            name = source.removeprefix("param:")
            if name not in parts:
                raise UploadError(f"there is no part {name!r}")
            source = parts[name]
        if not REGULAR.match(label):
            raise UploadError(f"{label!r} is no name of a table")
        if label.lower() in seen:
            raise UploadError(f"two uploads would be the table {label!r}, whatever the case of their names")
        seen.add(label.lower())
        types: dict[str, str] = {}
        if isinstance(source, DataFrame):
            df = source
        else:
            data = source if isinstance(source, bytes) else _fetch(source, limits) if isinstance(source, str) and "://" in source else Path(str(source)).read_bytes()
            df, types = read_votable(spark, _bounded(data, limits), limits.rows)
        names = [c.lower() for c in df.columns]
        if len(set(names)) < len(names):
            raise UploadError(f"two columns of {label!r} differ in the case of their names alone")
        if limits.rows is not None and isinstance(source, DataFrame) and df.limit(limits.rows + 1).count() > limits.rows:
            raise UploadError(f"Data overflow: {label!r} has more than {limits.rows} rows")
        catalog.add(label, df, SCHEMA, types=types)
    return catalog.tables
