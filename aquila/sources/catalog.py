"""Published tables: metadata, their DataFrames, and the schema that describes them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aquila.plans.nodes import Ident

_views = itertools.count()
# The language's types and the Spark type of each.
SPARK_TYPES = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "BLOB": T.BinaryType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "UNICODECHAR": T.StringType(), "CLOB": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "POINT": T.StringType(), "REGION": T.StringType(),
}
_KINDS = {**dict.fromkeys("SMALLINT INTEGER BIGINT REAL DOUBLE BINARY VARBINARY BLOB UNKNOWN_NUMERIC".split(), "N"), **dict.fromkeys("CHAR VARCHAR UNICODECHAR CLOB TIMESTAMP".split(), "S"), "POINT": "G", "REGION": "G"}
_BINARY = {"BINARY", "VARBINARY", "BLOB"}


def kind(type_: str) -> str:
    """N(umeric), S(tring), G(eometry) or U(nknown). Binaries count as numeric and timestamps as strings."""
    return _KINDS.get(type_, "U")


def compatible(a: str, b: str) -> bool:
    """Whether columns of these types may be merged by NATURAL or USING: not a binary with something that isn't numeric, and
    not a large binary with another."""
    if a == b or "U" in (kind(a), kind(b)):
        return True
    if (a in _BINARY) == (b in _BINARY):
        return "BLOB" not in (a, b)
    return kind(a) == kind(b)


def type_of(t: T.DataType) -> str:
    match t:
        case T.ByteType() | T.ShortType() | T.BooleanType():
            return "SMALLINT"
        case T.IntegerType():
            return "INTEGER"
        case T.LongType():
            return "BIGINT"
        case T.FloatType():
            return "REAL"
        case T.DoubleType() | T.DecimalType():
            return "DOUBLE"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "TIMESTAMP"
        case T.BinaryType():
            return "VARBINARY"
        case T.CharType():
            return "CHAR"
        case T.StringType() | T.VarcharType():
            return "VARCHAR"
        case T.StructType() if {f.name for f in t.fields} == {"lon", "lat"}:
            return "POINT"
    return "UNKNOWN"


@dataclass
class Column:
    name: str
    type: str = "UNKNOWN"
    physical: str = ""
    description: str | None = None
    unit: str | None = None
    ucd: str | None = None
    utype: str | None = None
    length: int | None = None
    indexed: bool = False
    principal: bool = False
    std: bool = False
    struct: bool = False  # a point stored as struct<lon, lat>
    coosys: str | None = None  # the id of a coordinate system

    def __post_init__(self) -> None:
        self.physical = self.physical or self.name


@dataclass(frozen=True)
class Coosys:
    """A coordinate system that columns refer to."""

    id: str
    system: str | None = None
    equinox: str | None = None
    epoch: str | None = None


@dataclass
class ForeignKey:
    key_id: str
    from_table: str
    target_table: str
    columns: list[tuple[str, str]]
    description: str | None = None
    utype: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    schema: str | None = None
    catalog: str | None = None
    df: DataFrame | None = None
    kind: str = "table"
    description: str | None = None
    utype: str | None = None
    view: str = ""

    @property
    def full_name(self) -> str:
        return ".".join(x for x in (self.catalog, self.schema, self.name) if x)

    def matches(self, parts: tuple[Ident, ...]) -> bool:
        """From the right: name, schema, catalog; a part that the table lacks matches nothing."""
        own = [self.name, self.schema, self.catalog]
        return len(parts) <= 3 and all(o is not None and p.matches(o) for p, o in zip(reversed(parts), own))


@dataclass
class Catalog:
    tables: list[Table] = field(default_factory=list)
    keys: list[ForeignKey] = field(default_factory=list)
    schemas: dict[str, dict[str, str | None]] = field(default_factory=dict)
    coosys: list[Coosys] = field(default_factory=list)

    def add(self, name: str, df: DataFrame, schema: str | None = None, catalog: str | None = None, types: dict[str, str] | None = None, **more) -> Table:
        """Publishes a DataFrame; types: columns of another type than their Spark type tells, such as POINT."""
        columns = [Column(f.name, (types or {}).get(f.name) or type_of(f.dataType), struct=isinstance(f.dataType, T.StructType)) for f in df.schema.fields]
        table = Table(name, columns, schema, catalog, df, view=f"aquila_{next(_views)}", **more)
        df.createOrReplaceTempView(table.view)
        self.tables.append(table)
        return table

    def bind(self, table: Table, df: DataFrame) -> None:
        """Gives the rows to a table of which only the metadata was there. Columns are found by name, whatever its case."""
        fields = {f.name.lower(): f for f in df.schema.fields}
        if missing := [c.name for c in table.columns if c.physical.lower() not in fields]:
            raise ValueError(f"{table.full_name} lacks the columns {', '.join(missing)}")
        for c in table.columns:
            f = fields[c.physical.lower()]
            c.physical, c.struct = f.name, isinstance(f.dataType, T.StructType)
            c.type = type_of(f.dataType) if c.type == "UNKNOWN" else c.type
        table.df, table.view = df, f"aquila_{next(_views)}"
        df.createOrReplaceTempView(table.view)

    def drop(self, table: Table) -> None:
        self.tables.remove(table)
        if table.df is not None:
            table.df.sparkSession.catalog.dropTempView(table.view)

    def find(self, parts: tuple[Ident, ...]) -> list[Table]:
        return [t for t in self.tables if t.matches(parts)]

    # what the catalog says of itself

    def describe(self, spark: SparkSession) -> None:
        """Publishes TAP_SCHEMA: schemas, tables, columns, keys, key_columns and, if the catalog has coordinate systems, coosys;
        itself included."""
        for old in [t for t in self.tables if t.schema == "TAP_SCHEMA"]:
            self.drop(old)
        for name, ddl in _SELF.items():
            if name == "coosys" and not self.coosys:
                continue
            table = self.add(name, spark.createDataFrame([], ddl), "TAP_SCHEMA")
            for c in table.columns:
                c.std = True
        rows = self._own_rows()
        for table in [t for t in self.tables if t.schema == "TAP_SCHEMA"]:
            table.df = spark.createDataFrame(rows[table.name], _SELF[table.name])
            table.df.createOrReplaceTempView(table.view)

    def _own_rows(self) -> dict[str, list[tuple]]:
        names = list(dict.fromkeys(t.schema for t in self.tables if t.schema))
        schemas = [(i, s, self.schemas.get(s, {}).get("description"), self.schemas.get(s, {}).get("utype")) for i, s in enumerate(names)]
        full = lambda t: ".".join(x for x in (t.schema, t.name) if x)
        tables = [(i, t.schema, full(t), t.kind, t.description, t.utype) for i, t in enumerate(self.tables)]
        columns = [
            (i, full(t), c.name, c.type, c.length, c.length, c.description, c.utype, c.unit, c.ucd, int(c.indexed), int(c.principal), int(c.std))
            for t in self.tables for i, c in enumerate(t.columns)
        ]
        keys = [(k.key_id, k.from_table, k.target_table, k.description, k.utype) for k in self.keys]
        return {"schemas": schemas, "tables": tables, "columns": columns, "keys": keys, "key_columns": [(k.key_id, a, b) for k in self.keys for a, b in k.columns], "coosys": [(c.id, c.system, c.equinox, c.epoch) for c in self.coosys]}


# The standard columns.
_SELF: dict[str, str] = {
    "schemas": "schema_index int, schema_name string, description string, utype string",
    "tables": "table_index int, schema_name string, table_name string, table_type string, description string, utype string",
    "columns": "column_index int, table_name string, column_name string, datatype string, arraysize int, size int, description string, utype string, unit string, ucd string, indexed int, principal int, std int",
    "keys": "key_id string, from_table string, target_table string, description string, utype string",
    "key_columns": "key_id string, from_column string, target_column string",
    "coosys": "id string, system string, equinox string, epoch string",
}


def parquet_catalog(spark: SparkSession, folder: str, names: Iterable[str], schema: str | None = None) -> Catalog:
    catalog = Catalog()
    for name in names:
        catalog.add(name, spark.read.parquet(f"{folder}/{name}.parquet"), schema)
    return catalog


def jdbc_catalog(spark: SparkSession, url: str, names: Iterable[str], schema: str | None = None, fetch_size: int = 10_000, ranges: dict[str, tuple[str, object, object, int]] | None = None, **options: str) -> Catalog:
    """Tables of a database. ``ranges``: for a table the column, its least and greatest value and the number of partitions that
    read it at once; other tables are read by one task, ``fetch_size`` rows at a time. Rows outside the range are read
    too. Filters and columns are pushed into the database's query."""
    catalog = Catalog()
    for name in names:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=str(fetch_size), **options)
        if ranges and name in ranges:
            column, low, high, n = ranges[name]
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
        catalog.add(name.rpartition(".")[2], reader.load(), schema)
    return catalog


def read_tap_schema(read: Callable[[str], DataFrame | None], open_table: Callable[[Table], DataFrame | None] | None = None) -> Catalog:
    """The catalog that tables as those of TAP_SCHEMA describe. ``read`` gives them by name (schemas, tables, columns, keys,
    key_columns, coosys), None for one that isn't there; columns that older versions lack count as null. ``open_table`` gives the
    rows of a table; without it, or where it gives None, the table stays metadata. Tables of TAP_SCHEMA itself are left
    out: ``describe`` publishes them."""

    def rows(name: str, *order: str) -> list[dict]:
        df = read(name)
        found = [] if df is None else [{k.lower(): v for k, v in r.asDict().items()} for r in df.toLocalIterator()]  # metadata: as many rows as columns are published
        return sorted(found, key=lambda r: [(r.get(k) is None, r.get(k) or 0) for k in order])

    out = Catalog()
    out.schemas = {r["schema_name"]: {"description": r.get("description"), "utype": r.get("utype")} for r in rows("schemas", "schema_index") if r["schema_name"] != "TAP_SCHEMA"}
    out.coosys = [Coosys(r["id"], r.get("system"), r.get("equinox"), r.get("epoch")) for r in rows("coosys")]
    columns: dict[str, list[Column]] = {}
    for r in rows("columns", "column_index"):
        length = r.get("arraysize") if r.get("arraysize") is not None else r.get("size")
        flags = {k: bool(r.get(k)) for k in ("indexed", "principal", "std")}
        type_ = (r.get("datatype") or "UNKNOWN").upper().removeprefix("ADQL:").partition("(")[0]
        columns.setdefault(r["table_name"], []).append(Column(r["column_name"].strip('"'), type_, description=r.get("description"), unit=r.get("unit"), ucd=r.get("ucd"), utype=r.get("utype"), length=length if isinstance(length, int) else None, **flags))
    for r in rows("tables", "table_index"):
        schema, full = r.get("schema_name"), r["table_name"]
        if schema == "TAP_SCHEMA":
            continue
        table = Table(full.removeprefix(f"{schema}.") if schema else full, columns.get(full, []), schema, kind=r.get("table_type") or "table", description=r.get("description"), utype=r.get("utype"))
        out.tables.append(table)
        df = open_table(table) if open_table else None
        if df is not None:
            out.bind(table, df)
    pairs: dict[str, list[tuple[str, str]]] = {}
    for r in rows("key_columns"):
        pairs.setdefault(r["key_id"], []).append((r["from_column"], r["target_column"]))
    out.keys = [ForeignKey(r["key_id"], r["from_table"], r["target_table"], pairs.get(r["key_id"], []), r.get("description"), r.get("utype")) for r in rows("keys")]
    return out
