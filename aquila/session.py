"""The engine: text in, DataFrame or formatted result out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import IO, TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from aquila.functions.udf import Function
from aquila.plans.compiler import Compiled, Compiler, Settings
from aquila.plans.lexer import ParseError
from aquila.plans.parser import parse
from aquila.plans.quickfix import quick_fix
from aquila.sources.catalog import Catalog, Coosys, Table
from aquila.sources.uploads import Limits, load_uploads

if TYPE_CHECKING:
    from aquila.sources.formats import Writer


@dataclass
class Config:
    """What a service allows. None: no limit, or anything goes."""

    default_maxrec: int | None = None
    max_maxrec: int | None = None
    fix_on_fail: bool = False
    functions: list[Function] | None = field(default_factory=list)
    geometries: list[str] | None = None
    systems: list[str] | None = None
    upload: Limits = field(default_factory=Limits)
    default_duration: int | None = None
    max_duration: int | None = None
    workers: int = 4
    provider: tuple[str, str] | None = None  # a name and a description, for VOTables
    formats: dict[str, Writer] = field(default_factory=dict)  # own ones, as {"psv": separated("|")}

    def maxrec(self, asked: int | None) -> int | None:
        """Negative is unlimited, which is the most allowed."""
        asked = self.default_maxrec if asked is None else asked
        if asked is None or asked < 0:
            return self.max_maxrec
        return asked if self.max_maxrec is None else min(asked, self.max_maxrec)

    def duration(self, asked: int | None) -> int | None:
        """Seconds, the same way."""
        asked = self.default_duration if asked is None else asked
        if asked is None or asked <= 0:
            return self.max_duration
        return asked if self.max_duration is None else min(asked, self.max_duration)


@dataclass
class Result:
    """df has up to maxrec + 1 rows: formats stop at maxrec and tell the overflow."""

    df: DataFrame
    compiled: Compiled
    query: str
    fixed: str | None
    maxrec: int | None
    provider: tuple[str, str] | None = None
    systems: list[Coosys] = field(default_factory=list)
    formats: dict[str, Writer] = field(default_factory=dict)

    def write(self, out: IO[bytes], format_: str = "votable") -> bool:
        """Writes the rows and tells whether there were more."""
        from aquila.sources.formats import find_format

        return find_format(format_, self.formats)(self, out)

    def rows(self) -> tuple[list[tuple], bool]:
        rows = [tuple(r) for r in self.df.toLocalIterator()]
        over = self.maxrec is not None and len(rows) > self.maxrec
        return rows[: self.maxrec] if over else rows, over


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, config: Config | None = None):
        self.spark, self.catalog, self.config = spark, catalog, config or Config()

    def compile(self, query: str, tables: Iterable[Table] = ()) -> tuple[Compiled, str | None]:
        """The compiled query, and its text after repairs if it needed some."""
        fixed = None
        try:
            tree = parse(query)
        except ParseError:
            if not self.config.fix_on_fail:
                raise
            fixed = quick_fix(query)
            tree = parse(fixed)
        catalog = Catalog([*self.catalog.tables, *tables])
        c = self.config
        return Compiler(catalog, Settings(c.functions, c.geometries, c.systems)).compile(tree), fixed

    def sql(self, query: str, tables: Iterable[Table] = ()) -> DataFrame:
        return self.spark.sql(self.compile(query, tables)[0].sql)

    def query(self, query: str, maxrec: int | None = None, uploads: str | dict[str, object] | None = None) -> Result:
        """uploads: label,uri pairs separated by ; or label to a file, a path or a DataFrame, seen as TAP_UPLOAD.label by this
        query alone. MAXREC 0 gives no rows, and overflow if there are any."""
        loaded = load_uploads(self.spark, uploads, self.config.upload)
        compiled, fixed = self.compile(query, loaded)
        limit = self.config.maxrec(maxrec)
        df = self.spark.sql(compiled.sql)
        for t in loaded:  # the plan is bound; the names go
            self.spark.catalog.dropTempView(t.view)
        return Result(df if limit is None else df.limit(limit + 1), compiled, query, fixed, limit, self.config.provider, self.catalog.coosys, self.config.formats)

    def with_config(self, **changes) -> Engine:
        return Engine(self.spark, self.catalog, replace(self.config, **changes))
