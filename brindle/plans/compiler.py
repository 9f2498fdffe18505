"""From statements to chains.  Pure: the same statement and catalog give the same chain."""

from __future__ import annotations

from ..errors import InvalidArgument, NotFound, Unsupported
from ..functions.types import MISMATCH, coerce, stored
from . import ast as A
from .chain import Block, Fold, NullTest, Ref, Slot, Step, Sub, Test

_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class Compiler:
    def __init__(self, catalog):
        self.catalog = catalog
        self.scopes: list[list] = []  # per level: (alias, relation)

    def select(self, q: A.Select) -> Block:
        """A compiled SELECT; also of subqueries, one level further in."""
        level = len(self.scopes)
        scope: list = []
        self.scopes.append(scope)
        try:
            block = Block(level, [])
            for r in q.relations:
                if any(a.lower() == r.alias.lower() for a, _ in scope):
                    raise InvalidArgument(f"relation '{r.alias}' is named twice", r.byte)
                if r.schema:
                    raise Unsupported("catalog views can't be joined or nested", r.byte)
                scope.append((r.alias, self.relation(r.table, r.byte)))
                block.slots.append(Slot(r.table, r.alias))
                if r.on:
                    self.join(block, r)
            for p in q.where:
                self.predicate(block, p)
            self.output(block, q)
            block.limit, block.offset = q.limit, q.offset
            block.steps = self.steps(block)
            return block
        finally:
            self.scopes.pop()

    def relation(self, name: str, byte: int):
        found = self.catalog.find(name)
        if not found:
            raise NotFound(f"unknown relation '{name}'", byte)
        return found

    def resolve(self, n: A.Name) -> Ref:
        for level in range(len(self.scopes) - 1, -1, -1):
            hits = [(slot, c, rel) for slot, (alias, rel) in enumerate(self.scopes[level]) if n.qualifier is None or alias.lower() == n.qualifier.lower() for c in rel.columns if c.name.lower() == n.name.lower()]
            if len(hits) > 1:
                raise InvalidArgument(f"column '{n}' is ambiguous", n.byte)
            if hits:
                slot, c, rel = hits[0]
                return Ref(level, slot, c.name, c.kind, c.nullable, c is rel.columns[0])
            if n.qualifier and any(a.lower() == n.qualifier.lower() for a, _ in self.scopes[level]):
                raise InvalidArgument(f"unknown column '{n}'", n.byte)
        raise InvalidArgument(f"unknown {'relation' if n.qualifier else 'column'} '{n.qualifier or n.name}'", n.byte)

    def test(self, left: Ref, op: str, right, byte: int) -> Test:
        if isinstance(right, Ref):
            a, b = left.kind, right.kind
            if a.is_decimal and b.is_decimal and (a.scale, a.wide) != (b.scale, b.wide):
                raise Unsupported(f"{a} and {b} differ in scale or width and can't be compared", byte)
            return Test(left, op, other=right, never=a.family != b.family)
        if right.kind is not None:  # a pattern's parameter: any value of its type must do
            if (right.kind.family, right.kind.scale if right.kind.is_decimal else 0) != (left.kind.family, left.kind.scale if left.kind.is_decimal else 0):
                raise InvalidArgument(f"parameter '${right.named}' is {right.kind}, the column {left.kind}", right.byte)
            return Test(left, op, None, never=True)
        value = coerce(right.value, right.quoted, left.kind, right.byte)
        return Test(left, op, None, never=True) if value is None or value is MISMATCH else Test(left, op, value)

    def join(self, block: Block, r: A.Relation) -> None:
        a, b = (self.resolve(n) for n in r.on)
        here = len(block.slots) - 1
        if {a.slot, b.slot} == {here} or here not in (a.slot, b.slot) or {a.level, b.level} != {block.level}:
            raise InvalidArgument(f"ON must compare '{r.alias}' with a relation before it", r.byte)
        old, new = (b, a) if a.slot == here else (a, b)
        test = self.test(old, "=", new, r.on[0].byte)
        if test.never:
            block.tests.append(test)
        block.joins.append((old, new))

    def predicate(self, block: Block, p) -> None:
        if isinstance(p, A.Between):
            self.predicate(block, A.Compare(p.column, ">=", p.low))
            self.predicate(block, A.Compare(p.column, "<=", p.high))
        elif isinstance(p, A.IsNull):
            self.place(block, NullTest(self.resolve(p.column), p.negated))
        elif isinstance(p, A.Exists):
            block.subs.append(Sub("exists", self.select(p.query), p.negated))
        elif isinstance(p, A.InQuery):
            block.subs.append(self.value(p.column, "=", p.query, "in", p.negated))
        elif isinstance(p.right, A.Select):
            block.subs.append(self.value(p.left, p.op, p.right, "scalar", False))
        else:
            right = self.resolve(p.right) if isinstance(p.right, A.Name) else p.right
            self.place(block, self.test(self.resolve(p.left), p.op, right, p.left.byte))

    def value(self, column: A.Name, op: str, q: A.Select, kind: str, negated: bool) -> Sub:
        if q.star or len(q.items) != 1:
            raise Unsupported("a subquery that stands for a value has exactly one column", q.star_byte or q.byte)
        ref, block = self.resolve(column), self.select(q)
        out = block.output[0][0]
        if self.test(ref, op, out, column.byte).never:
            # kinds that never compare: a set without a match, unless it is empty or negated
            block.tests.append(Test(out, "=", never=True)) if kind == "scalar" else None
            if kind == "in":
                raise Unsupported(f"{ref.kind} and {out.kind} can't be compared", column.byte)
        return Sub(kind, block, negated, ref, op)

    def place(self, block: Block, t) -> None:
        """A conjunct with an outer column is a link; with outer columns only, still a link: it is tested where they are known."""
        if all(r.level == block.level for r in t.refs):
            block.tests.append(t)
        elif isinstance(t, Test) and t.other is not None and t.other.level == block.level:
            block.links.append(Test(t.other, _FLIP[t.op], other=t.ref, never=t.never))
        else:
            block.links.append(t)

    def output(self, block: Block, q: A.Select) -> None:
        folded = bool(q.group) or any(i.func for i in q.items)
        if q.star:
            if len(block.slots) > 1:
                raise Unsupported(f"'*' is ambiguous across {len(block.slots)} relations", q.star_byte)
            if folded:
                raise InvalidArgument("'*' can't be grouped", q.star_byte)
            rel = self.scopes[-1][0][1]
            block.output = [(Ref(block.level, 0, c.name, c.kind, c.nullable, i == 0), c.name) for i, c in enumerate(rel.columns)]
        block.group = [self.own(n) for n in q.group]
        for n, r in enumerate(block.group):
            if r in block.group[:n]:
                raise InvalidArgument(f"'{q.group[n]}' is grouped by twice", q.group[n].byte)
        for i in q.items:
            ref = self.own(i.column) if i.column else None
            if not folded:
                block.output.append((ref, i.label))
                continue
            if i.func:
                self.foldable(i, ref)
            elif ref not in block.group:
                raise InvalidArgument(f"column '{i.column}' must appear in GROUP BY or in an aggregate", i.byte)
            block.folds.append(Fold(i.func, ref, i.distinct, i.label))
        block.order = [(self.own(o.column), o.descending) for o in q.order]

    def own(self, n: A.Name) -> Ref:
        ref = self.resolve(n)
        if ref.level != len(self.scopes) - 1:
            raise Unsupported(f"'{n}' belongs to an outer query", n.byte)
        return ref

    def foldable(self, i: A.Item, ref: Ref | None) -> None:
        if i.func in ("count", "min", "max"):
            return
        k = ref.kind
        if i.func == "avg" and not k.is_decimal:
            raise Unsupported(f"AVG takes decimals; '{i.column}' is {k}", i.byte)
        if i.func == "sum" and not (k.is_int or k.is_decimal):
            raise Unsupported(f"SUM of {k} is not supported", i.byte)

    # ---- what ANALYZE says of each relation
    def steps(self, block: Block) -> list[Step]:
        out = []
        for slot, s in enumerate(block.slots):
            rel = self.catalog.find(s.table)
            own = [t for t in block.tests if isinstance(t, Test) and t.other is None and not t.never and t.ref.slot == slot]
            joins = [(a, b) for a, b in block.joins if b.slot == slot]
            linked = [t for t in block.links if isinstance(t, Test) and t.op == "=" and t.ref.level == block.level and t.ref.slot == slot]
            equal = {t.ref.name for t in own if t.op == "="}
            known = {b.name for _, b in joins} | {t.ref.name for t in linked}
            key = rel.columns[0].name
            bounds = {t.op[0] for t in own if t.ref.name == key and t.op in ("<", "<=", ">", ">=")}
            index = next((n for n, keys in rel.indexes.items() if keys[0] in equal), None)
            correlated = next((n for n, keys in rel.indexes.items() if keys[0] in known), None)
            if key in equal:
                out.append(Step("Lookup", key))
            elif key in known:
                out.append(Step("Probe", key))
            elif bounds:
                out.append(Step("Range", key))
            elif index or correlated:
                ranged = index and any(t.op != "=" and t.op != "!=" and t.ref.name in rel.indexes[index][1:2] for t in own)
                out.append(Step("IndexRange" if ranged else "IndexProbe", index or correlated))
            elif (equal | known) & set(rel.cabins):
                out.append(Step("CabinProbe", min((equal | known) & set(rel.cabins))))
            elif equal:
                out.append(Step("FilterScan", min(equal)))
            else:
                out.append(Step("Scan", "build" if known else ""))
        return out

    # ---- UPDATE and DELETE
    def change(self, table: str, byte: int, where: list, assignments=()):
        """(block, {column: value}) of an UPDATE or DELETE: the block finds the rows by the rules of SELECT."""
        rel = self.relation(table, byte)
        block = Block(0, [Slot(table, table)])
        self.scopes.append([(table, rel)])
        try:
            for p in where:
                self.predicate(block, p)
            values = {}
            for n, literal in assignments:
                ref = self.resolve(n)
                if ref.is_key:
                    raise Unsupported(f"primary-key column '{n}' cannot be updated: it is the row's identity", n.byte)
                if ref.name in values:
                    raise InvalidArgument(f"column '{n}' is assigned twice", n.byte)
                value = stored(literal.value, literal.quoted, ref.kind, ref.name, literal.byte)
                if value is None and not ref.nullable:
                    raise InvalidArgument(f"column '{n}' is NOT NULL", literal.byte)
                values[ref.name] = value
            block.output = [(Ref(0, 0, c.name, c.kind, c.nullable, i == 0), c.name) for i, c in enumerate(rel.columns)]
            return block, values
        finally:
            self.scopes.pop()
