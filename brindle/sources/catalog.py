"""Relations: their columns, keys, constraints and versions of their rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column as Column_
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import Kind, kind_from_spark


@dataclass
class Column:
    name: str
    kind: Kind
    nullable: bool = False
    references: str | None = None
    policy: str | None = None
    stored: str = ""  # its name in files, which no renaming changes

    def __post_init__(self):
        self.stored = self.stored or self.name


@dataclass
class Assertion:
    """At most ``bound`` rows, or at most that sum of ``column``, for every value of ``group``."""

    name: str
    table: str
    group: list[str]
    column: str | None
    bound: int


class Part(NamedTuple):
    """Rows of a version: a Parquet path, and the paths of keys that were removed from it since."""

    path: str
    gone: tuple[str, ...] = ()


@dataclass
class Relation:
    """``versions``: the parts of each committed version, newest last; ``view``: an outside DataFrame, which can't be written."""

    oid: int
    name: str
    columns: list[Column]
    storage: str = "heap"
    mode: str = "assigned"
    view: DataFrame | None = None
    unique: bool = True
    next_id: int = 1
    indexes: dict[str, list[str]] = field(default_factory=dict)
    covering: dict[str, list[str]] = field(default_factory=dict)
    sorted_paths: dict[tuple[str, str], str] = field(default_factory=dict)  # an index and a part's path: its columns, sorted
    cabins: dict[str, int] = field(default_factory=dict)
    versions: list[tuple[Part, ...]] = field(default_factory=lambda: [()])
    dead: list[tuple[str, ...]] = field(default_factory=lambda: [()])  # keys of deleted rows, by version
    written: list[set[int] | None] = field(default_factory=lambda: [set()])  # keys each version changed
    source: DataFrame | None = None  # of a view: its rows before doubles become decimals
    doubles: dict[str, int] = field(default_factory=dict)  # those columns, and their scales
    batches: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each stream that is in the rows

    @property
    def key(self) -> str:
        return self.columns[0].name

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark, True) for c in self.columns])

    def indexed(self, index: str) -> list[Column]:
        """The columns that an index holds, the key first."""
        held = {self.key, *self.indexes[index], *self.covering[index]}
        return [c for c in self.columns if c.name in held]

    def read(self, spark: SparkSession, files: tuple[str, ...], columns: list[Column] | None = None) -> DataFrame:
        if self.view is not None:
            return self.view
        columns = columns or self.columns
        if not files:
            return spark.createDataFrame([], T.StructType([T.StructField(c.name, c.kind.spark, True) for c in columns]))
        kept = T.StructType([T.StructField(c.stored, c.kind.spark, True) for c in columns])
        return spark.read.schema(kept).parquet(*files).toDF(*(c.name for c in columns))

    def narrowed(self, bounds: list[tuple[str, str, object]]) -> DataFrame:
        """The rows of a view, most of those left out that fail a bound (column, operator, value) on a column that the files hold as doubles.

        The bound is widened by half a unit, so that it is safe, and reaches the
        scan as a filter on the double; the exact test is still to be made.
        """
        rows = self.source
        for name, op, value in bounds:
            half = 0.5 * 10.0 ** -self.doubles[name]
            if op in ("=", ">", ">="):
                rows = rows.where(F.col(f"`{name}`") >= float(value) - half)
            if op in ("=", "<", "<="):
                rows = rows.where(F.col(f"`{name}`") <= float(value) + half)
        return rows.select(*self.view_columns)

    @property
    def view_columns(self) -> list[Column_]:
        return [exact(self.name, c.name, self.doubles[c.name]) if c.name in self.doubles else F.col(f"`{c.name}`").cast(c.kind.spark).alias(c.name) for c in self.columns]

    def stored(self, df: DataFrame) -> DataFrame:
        """Rows, or their keys alone, under the names they have in files."""
        names = {c.name: c.stored for c in self.columns}
        return df.toDF(*(names[c] for c in df.columns))


def exact(relation: str, column: str, scale: int) -> Column_:
    """A double as decimal(15, scale); one that isn't the nearest to such a decimal fails the statement."""
    wide = F.col(f"`{column}`").cast("double")
    same = F.rint(wide * 10**scale) / 10**scale == wide
    kind = f"decimal(15,{scale})"
    return F.when(same | wide.isNull(), wide.cast(kind)).otherwise(F.raise_error(F.lit(f"a value of {relation}.{column} has more than {scale} digits after the point")).cast(kind)).alias(column)


class Catalog:
    """Relations by name, without regard to case, and what is declared over them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._relations: dict[str, Relation] = {}
        self._unread: dict[str, Callable[[], None]] = {}  # declared, not opened yet
        self.assertions: dict[str, Assertion] = {}
        self.patterns: dict[str, dict] = {}
        self.next_oid = 4096

    @property
    def relations(self) -> dict[str, Relation]:
        """All of them; opens those that are only declared."""
        for name in list(self._unread):
            self._unread.pop(name)()
        return self._relations

    def find(self, name: str) -> Relation | None:
        if name.lower() in self._unread:
            self._unread.pop(name.lower())()
        return self._relations.get(name.lower())

    def oid(self) -> int:
        self.next_oid += 1
        return self.next_oid - 1

    def register(self, name: str, df: DataFrame, unique: bool = True, storage: str = "btree", scale: int = 2, oid: int | None = None) -> Relation:
        """An outside DataFrame as a relation; its first column is the key.

        Doubles are read as decimal(15, ``scale``) and must be the nearest
        doubles to such decimals: another value fails the statement that reads
        it.  A column of a type outside the dialect is refused; select the others first.
        """
        columns, doubles = [], {}
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                kind = Kind("decimal", 15, scale)
                doubles[f.name] = scale
            else:
                kind = kind_from_spark(f.dataType)
            columns.append(Column(f.name, kind, f.nullable and bool(columns)))
        out = Relation(oid or self.oid(), name, columns, storage, "explicit", None, unique, source=df, doubles=doubles)
        out.view = df.select(*out.view_columns)
        self._relations[name.lower()] = out
        return out

    def parquet(self, folder: str, *names: str, unique: dict[str, bool] | None = None) -> None:
        """Declare ``folder``/name.parquet for each name; a file is opened when a statement first names it."""
        for n in names:
            open_ = lambda n=n, oid=self.oid(): self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"), (unique or {}).get(n, True), oid=oid)
            self._unread[n.lower()] = open_

    # ---- views of the catalog itself
    def view(self, name: str) -> DataFrame | None:
        """sys.tables, columns, objects, types or patterns."""
        rels = sorted(self.relations.values(), key=lambda r: r.oid)
        if name == "tables":
            rows, schema = [(r.oid, r.name, r.storage, r.mode, len(r.columns)) for r in rels], "oid long, name string, storage string, key_mode string, columns int"
        elif name == "columns":
            rows = [(r.oid, i, c.name, str(c.kind), c.nullable, c.references) for r in rels for i, c in enumerate(r.columns)]
            schema = "rel_oid long, pos int, name string, type string, nullable boolean, references string"
        elif name == "objects":
            rows = [(r.oid, "table", r.name) for r in rels] + [(r.oid, "index", n) for r in rels for n in r.indexes] + [(r.oid, "cabin", f"{r.name}({c})") for r in rels for c in r.cabins]
            rows += [(self.relations[a.table.lower()].oid, "assertion", a.name) for a in self.assertions.values()]
            schema = "rel_oid long, kind string, name string"
        elif name == "types":
            rows, schema = [(n,) for n in ("int8", "int16", "int32", "int64", "uint64", "bool", "char", "varchar", "date", "timestamp", "decimal", "decimal128", "float")], "name string"
        elif name == "patterns":
            rows = [(f"{p['id']:016x}", n, p["pinned"], p["expected_instances"], p["sql"]) for n, p in sorted(self.patterns.items())]
            schema = "pattern_id string, name string, pinned boolean, expected_instances long, body string"
        else:
            return None
        return self.spark.createDataFrame(rows, schema)
