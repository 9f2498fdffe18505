"""Compiled statements: names resolved to places, literals typed, predicates placed; nothing here touches Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.types import Kind


@dataclass(frozen=True)
class Ref:
    """A column of relation ``slot`` of the block at nesting ``level``."""

    level: int
    slot: int
    name: str
    kind: Kind
    nullable: bool
    is_key: bool

    @property
    def at(self) -> str:
        """Its column's name in a frame."""
        return f"c{self.level}_{self.slot}_{self.name}"


@dataclass(frozen=True)
class Test:
    """ref op value, or ref op other; ``never``: known to hold for no row."""

    ref: Ref
    op: str
    value: object = None
    other: Ref | None = None
    never: bool = False

    @property
    def refs(self) -> list[Ref]:
        return [self.ref] + [self.other] * (self.other is not None)


@dataclass(frozen=True)
class NullTest:
    ref: Ref
    negated: bool

    @property
    def refs(self) -> list[Ref]:
        return [self.ref]


@dataclass(frozen=True)
class Sub:
    """A subquery predicate. kind: exists, in or scalar; ``ref``: what it is compared with."""

    kind: str
    block: Block
    negated: bool = False
    ref: Ref | None = None
    op: str = "="


@dataclass(frozen=True)
class Slot:
    table: str
    alias: str


@dataclass
class Step:
    """How a relation is reached, for ANALYZE; the plan itself is Catalyst's."""

    kind: str
    detail: str = ""


@dataclass
class Fold:
    func: str | None
    ref: Ref | None
    distinct: bool
    label: str


@dataclass
class Block:
    level: int
    slots: list[Slot]
    joins: list[tuple[Ref, Ref]] = field(default_factory=list)
    tests: list = field(default_factory=list)  # of this block's own columns
    links: list[Test] = field(default_factory=list)  # with columns of outer blocks
    subs: list[Sub] = field(default_factory=list)
    output: list[tuple[Ref, str]] = field(default_factory=list)
    folds: list[Fold] = field(default_factory=list)
    group: list[Ref] = field(default_factory=list)
    order: list[tuple[Ref, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    steps: list[Step] = field(default_factory=list)

    @property
    def folded(self) -> bool:
        return bool(self.folds)

    @property
    def refs(self) -> list[Ref]:
        """All columns that this block names, and its subqueries."""
        out = [r for pair in self.joins for r in pair] + [r for t in (*self.tests, *self.links) for r in t.refs]
        out += [r for r, _ in (*self.output, *self.order)] + [f.ref for f in self.folds if f.ref] + self.group
        for s in self.subs:
            out += s.block.refs + [s.ref] * (s.ref is not None)
        return out

    @property
    def outermost(self) -> int:
        """The outermost level that this block's predicates name, its own if none."""
        levels = [r.level for t in self.links for r in t.refs]
        for s in self.subs:
            levels.append(s.block.outermost)
            levels += [s.ref.level] * (s.ref is not None)
        return min([self.level, *levels])

    @property
    def kind(self) -> str:
        """PointSelect, RangeSelect or JoinSelect, from the steps alone."""
        if len(self.slots) > 1:
            return "JoinSelect"
        return "PointSelect" if self.steps and self.steps[0].kind == "Lookup" else "RangeSelect"
