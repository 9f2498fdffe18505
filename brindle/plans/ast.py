"""Statements as parsed.  Every part that can be refused later keeps its byte position."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.types import Kind


@dataclass(frozen=True)
class Name:
    qualifier: str | None
    name: str
    byte: int

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    """value: int, str or None; quoted: a string or a number with a point; named: a pattern's parameter."""

    value: object
    quoted: bool
    byte: int
    named: str | None = None
    kind: object = None  # a parameter's declared type


@dataclass(frozen=True)
class Item:
    """A select item: a column, or an aggregate ``func`` over it (column None: ``*``)."""

    column: Name | None
    func: str | None = None
    distinct: bool = False
    byte: int = 0

    @property
    def label(self) -> str:
        if not self.func:
            return str(self.column)
        return f"{self.func}({'distinct ' * self.distinct}{self.column or '*'})"


@dataclass(frozen=True)
class Compare:
    left: Name
    op: str
    right: object  # Literal, Name or Select


@dataclass(frozen=True)
class Between:
    column: Name
    low: Literal
    high: Literal


@dataclass(frozen=True)
class IsNull:
    column: Name
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: Select
    negated: bool


@dataclass(frozen=True)
class InQuery:
    column: Name
    query: Select
    negated: bool


@dataclass(frozen=True)
class Relation:
    table: str
    alias: str
    byte: int
    schema: str | None = None
    on: tuple[Name, Name] | None = None


@dataclass(frozen=True)
class Order:
    column: Name
    descending: bool


@dataclass
class Select:
    items: list[Item]
    star: bool
    relations: list[Relation]
    where: list
    group: list[Name] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    byte: int = 0
    star_byte: int = 0


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: Kind
    nullable: bool
    references: str | None
    policy: str | None
    byte: int


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    storage: str | None
    mode: str | None
    byte: int
    mode_byte: int = 0


@dataclass
class Drop:
    what: str
    name: str
    byte: int
    column: str | None = None


@dataclass
class Rename:
    table: str
    column: str | None
    to: str
    byte: int


@dataclass
class CreateIndex:
    name: str
    table: str
    keys: list[Name]
    covering: list[Name]
    byte: int


@dataclass
class CreateCabin:
    table: str
    column: Name
    byte: int


@dataclass
class CreatePattern:
    name: str
    params: list[tuple[str, str]]
    options: dict
    body: Select
    sql: str
    byte: int


@dataclass
class CreateAssertion:
    name: str
    table: str
    group: list[Name]
    column: Name | None  # None: COUNT(*)
    bound: int  # inclusive
    byte: int


@dataclass
class Insert:
    table: str
    rows: list[list[Literal]]
    byte: int


@dataclass
class Update:
    table: str
    assignments: list[tuple[Name, Literal]]
    where: list
    byte: int


@dataclass
class Delete:
    table: str
    where: list
    byte: int


@dataclass
class Control:
    """BEGIN, COMMIT, ROLLBACK, SYNC, PING, STOP, SHOW x, DESCRIBE t, SET x; ``args``: its words."""

    verb: str
    args: list[str]
    byte: int


@dataclass
class Analyze:
    query: Select
