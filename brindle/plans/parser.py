"""Statements from tokens, by recursive descent; what is declined is declined here or by the compiler, with its position."""

from __future__ import annotations

from ..errors import InvalidArgument, Unsupported
from ..functions.types import Kind, kind_of
from . import ast as A
from .lexer import Token, tokens

#: Fixed values of the dialect.
AGGREGATES = ("count", "sum", "min", "max", "avg")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=")
MAX_NESTING, MAX_ORDER_KEYS, MAX_INSERT_ROWS, MAX_INDEX_KEYS, MAX_COVERED = 4, 8, 1024, 4, 8


def parse(sql: str):
    """The statement in ``sql``; a trailing semicolon is ignored."""
    return Parser(sql).statement()


class Parser:
    def __init__(self, sql: str, in_pattern: bool = False):
        self.sql, self.list, self.at, self.depth, self.in_pattern = sql, tokens(sql), 0, 0, in_pattern
        self.params: dict[str, Kind] = {}

    # ---- helpers
    @property
    def now(self) -> Token:
        return self.list[self.at]

    def next(self) -> Token:
        self.at += 1
        return self.list[self.at - 1]

    def accept(self, *texts: str) -> Token | None:
        return self.next() if self.now.is_(*texts) else None

    def expect(self, *texts: str) -> Token:
        if not self.now.is_(*texts):
            raise InvalidArgument(f"expected '{texts[0].upper()}' but found '{self.now.text or 'end of statement'}'", self.now.byte)
        return self.next()

    def word(self, what: str) -> Token:
        if self.now.kind != "word":
            raise InvalidArgument(f"expected {what} but found '{self.now.text or 'end of statement'}'", self.now.byte)
        return self.next()

    def number(self, what: str, most: int = (1 << 64) - 1) -> int:
        if self.now.kind != "int" or not 0 <= int(self.now.text) <= most:
            raise InvalidArgument(f"{what} needs a whole number", self.now.byte)
        return int(self.next().text)

    def name(self) -> A.Name:
        first = self.word("a column name")
        if self.accept("."):
            return A.Name(first.text, self.word("a column name").text, first.byte)
        return A.Name(None, first.text, first.byte)

    def names(self, most: int, what: str) -> list[A.Name]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        if len(out) > most:
            raise InvalidArgument(f"{what} takes at most {most} columns", out[most].byte)
        return out

    def literal(self) -> A.Literal:
        t = self.next()
        if t.kind == "int":
            return A.Literal(int(t.text), False, t.byte)
        if t.kind in ("num", "str"):
            return A.Literal(t.text, True, t.byte)
        if t.kind == "null":
            return A.Literal(None, False, t.byte)
        if t.kind == "named" and self.in_pattern:
            return A.Literal(None, False, t.byte, t.text[1:], self.params.get(t.text[1:]))
        if t.kind == "named":
            raise InvalidArgument(f"'{t.text}' is only allowed in a pattern's body", t.byte)
        if t.kind == "param":
            raise Unsupported("bind parameters are not supported", t.byte)
        raise InvalidArgument(f"expected a literal but found '{t.text or 'end of statement'}'", t.byte)

    # ---- statements
    def statement(self):
        head = self.now
        verb = head.text.lower() if head.kind == "word" else ""
        found = {
            "select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete,
            "create": self.create, "drop": self.drop, "alter": self.alter, "analyze": self.analyze,
        }.get(verb)
        if verb == "with":
            raise Unsupported("common table expressions (WITH) are not supported; subqueries are allowed in predicate position only", head.byte)
        if found:
            out = found()
        elif verb in ("begin", "start", "commit", "rollback", "abort", "sync", "ping", "stop", "show", "describe", "desc", "set"):
            self.next()
            args = []
            while self.now.kind != "end" and not self.now.is_(";"):
                args.append(self.next().text)
            out = A.Control({"start": "begin", "abort": "rollback", "desc": "describe"}.get(verb, verb), args, head.byte)
        else:
            raise InvalidArgument(f"unknown SQL keyword '{head.text}' (supported: CREATE, DROP, ALTER, INSERT, SELECT, UPDATE, DELETE)", head.byte)
        self.accept(";")
        if self.now.kind != "end":
            raise InvalidArgument(f"unexpected token '{self.now.text}' after end of statement", self.now.byte)
        return out

    def analyze(self):
        self.next()
        if not self.now.is_("select"):
            raise Unsupported("ANALYZE takes a SELECT", self.now.byte)
        return A.Analyze(self.select())

    def select(self, nested: bool = False) -> A.Select:
        start = self.expect("select").byte
        items, star, star_byte = [], False, 0
        if self.now.is_("*"):
            star, star_byte = True, self.next().byte
        else:
            items.append(self.item(nested))
            while self.accept(","):
                items.append(self.item(nested))
        self.expect("from")
        relations = [self.relation()]
        while True:
            if self.now.is_("left", "right", "full", "outer"):
                raise Unsupported("outer joins are not supported", self.now.byte)
            if self.now.is_(","):
                raise Unsupported("relations are joined by JOIN ... ON, not by a comma", self.now.byte)
            if not self.accept("join"):
                break
            relations.append(self.relation(joined=True))
        where = self.where()
        out = A.Select(items, star, relations, where, byte=start, star_byte=star_byte)
        if self.accept("group"):
            if nested:
                raise Unsupported("GROUP BY in a subquery is not supported", self.list[self.at - 1].byte)
            self.expect("by")
            out.group.append(self.name())
            while self.accept(","):
                out.group.append(self.name())
        folded = bool(out.group) or any(i.func for i in items)
        if self.now.is_("having"):
            raise Unsupported("HAVING is not supported: filter before the fold with WHERE, or filter the result", self.now.byte)
        if self.now.is_("order", "limit", "offset") and (nested or folded):
            where_ = "in a subquery" if nested else "over aggregated output"
            raise Unsupported(f"{self.now.text.upper()} {where_} is not supported", self.now.byte)
        if self.accept("order"):
            self.expect("by")
            while True:
                column = self.name()
                down = bool(self.accept("desc"))
                if not down:
                    self.accept("asc")
                out.order.append(A.Order(column, down))
                if not self.accept(","):
                    break
            if len(out.order) > MAX_ORDER_KEYS:
                raise Unsupported(f"ORDER BY takes at most {MAX_ORDER_KEYS} keys", out.order[MAX_ORDER_KEYS].column.byte)
        if self.accept("limit"):
            out.limit = self.number("LIMIT")
        if self.accept("offset"):
            out.offset = self.number("OFFSET")
        return out

    def item(self, nested: bool) -> A.Item:
        t = self.word("a column name")
        if self.now.is_("("):
            func = t.text.lower()
            if func not in AGGREGATES:
                raise Unsupported(f"function '{t.text}' is not supported", t.byte)
            if nested:
                raise Unsupported("an aggregate in a subquery is not supported", t.byte)
            self.next()
            distinct = bool(self.accept("distinct"))
            column = None
            if self.now.is_("*"):
                if func != "count":
                    raise InvalidArgument(f"{func.upper()}(*) has no meaning", self.now.byte)
                if distinct:
                    raise Unsupported("COUNT(DISTINCT *) is not supported", self.now.byte)
                self.next()
            else:
                column = self.name()
            self.expect(")")
            return A.Item(column, func, distinct, t.byte)
        self.at -= 1
        column = self.name()
        if self.now.is_("as"):
            raise Unsupported("a select item can't be renamed", self.now.byte)
        return A.Item(column, byte=column.byte)

    def relation(self, joined: bool = False) -> A.Relation:
        if self.now.is_("("):
            raise Unsupported("a subquery cannot appear in FROM", self.now.byte)
        t = self.word("a relation name")
        schema, table = None, t.text
        if self.accept("."):
            schema, table = t.text, self.word("a relation name").text
            if schema.lower() != "sys":
                raise Unsupported(f"there is no schema '{schema}'", t.byte)
        alias = self.word("an alias").text if self.accept("as") else table
        if self.now.kind == "word" and not self.now.is_("where", "group", "order", "limit", "offset", "having"):
            raise InvalidArgument(f"unexpected '{self.now.text}': an alias is written with AS", self.now.byte)
        on = None
        if joined:
            self.expect("on")
            left = self.name()
            self.expect("=")
            right = self.name()
            for side in (left, right):
                if not side.qualifier:
                    raise InvalidArgument("both sides of ON must be qualified", side.byte)
            on = (left, right)
        return A.Relation(table, alias, t.byte, schema, on)

    def where(self) -> list:
        if not self.accept("where"):
            return []
        out = [self.predicate()]
        while self.accept("and"):
            out.append(self.predicate())
        if self.now.is_("or"):
            raise Unsupported("OR is not supported", self.now.byte)
        return out

    def subquery(self) -> A.Select:
        t = self.expect("(")
        if not self.now.is_("select"):
            raise Unsupported("expected a subquery", self.now.byte)
        if self.depth == MAX_NESTING:
            raise Unsupported(f"nesting deeper than {MAX_NESTING} is not supported", t.byte)
        self.depth += 1
        out = self.select(nested=True)
        self.depth -= 1
        self.expect(")")
        return out

    def predicate(self):
        if self.now.is_("not"):
            t = self.next()
            if not self.accept("exists"):
                raise Unsupported("NOT is supported only before EXISTS and IN", t.byte)
            return A.Exists(self.subquery(), True)
        if self.accept("exists"):
            return A.Exists(self.subquery(), False)
        if self.now.is_("("):
            raise Unsupported("predicates can't be grouped", self.now.byte)
        column = self.name()
        if self.now.is_("not"):
            self.next()
            self.expect("in")
            return A.InQuery(column, self.subquery(), True)
        if self.accept("in"):
            return A.InQuery(column, self.subquery(), False)
        if self.accept("is"):
            negated = bool(self.accept("not"))
            if self.now.kind != "null":
                raise InvalidArgument("IS is followed by NULL or NOT NULL", self.now.byte)
            self.next()
            return A.IsNull(column, negated)
        if self.accept("between"):
            low = self.literal()
            self.expect("and")
            return A.Between(column, low, self.literal())
        t = self.next()
        if t.text not in OPERATORS or t.kind != "op":
            raise InvalidArgument(f"expected a comparison but found '{t.text or 'end of statement'}'", t.byte)
        if self.now.is_("("):
            return A.Compare(column, t.text, self.subquery())
        return A.Compare(column, t.text, self.name() if self.now.kind == "word" else self.literal())

    # ---- changes
    def insert(self):
        start = self.next().byte
        self.expect("into")
        table = self.word("a relation name").text
        self.expect("values")
        rows = []
        while True:
            at = self.expect("(").byte
            row = [self.literal()]
            while self.accept(","):
                row.append(self.literal())
            self.expect(")")
            rows.append(row)
            if len(rows) > MAX_INSERT_ROWS:
                raise ResourceLimit(at)
            if not self.accept(","):
                return A.Insert(table, rows, start)

    def update(self):
        start = self.next().byte
        table = self.word("a relation name").text
        self.expect("set")
        sets = []
        while True:
            column = self.name()
            self.expect("=")
            sets.append((column, self.literal()))
            if not self.accept(","):
                return A.Update(table, sets, self.where(), start)

    def delete(self):
        start = self.next().byte
        self.expect("from")
        return A.Delete(self.word("a relation name").text, self.where(), start)

    # ---- definitions
    def create(self):
        start = self.next().byte
        what = self.word("what to create")
        make = {"table": self.table, "index": self.index, "cabin": self.cabin, "pattern": self.pattern, "assertion": self.assertion}.get(what.text.lower())
        if what.is_("unique"):
            raise Unsupported("UNIQUE indexes are not supported", what.byte)
        if not make:
            raise InvalidArgument(f"can't create a '{what.text}'", what.byte)
        return make(start)

    def table(self, start: int):
        name = self.word("a relation name").text
        self.expect("(")
        columns = []
        while True:
            column = self.word("a column name")
            kind = self.word("a type")
            args = []
            if self.accept("("):
                args.append(self.number("a type"))
                while self.accept(","):
                    args.append(self.number("a type"))
                self.expect(")")
            nullable = False
            if self.accept("not"):
                self.expect("null")
            elif self.accept("null"):
                nullable = True
            references = policy = None
            if self.accept("references"):
                references = self.word("a relation name").text
                if self.now.is_("("):
                    raise Unsupported("REFERENCES names a relation only: the parent's column is its key", self.now.byte)
            if self.accept("no"):
                self.expect("cabin")
                policy = "no"
            elif self.accept("cabin"):
                policy = "auto" if self.accept("auto") else "yes"
            columns.append(A.ColumnDef(column.text, kind_of(kind.text, args, column.text, kind.byte), nullable, references, policy, column.byte))
            if not self.accept(","):
                break
        self.expect(")")
        storage = mode = None
        mode_byte = 0
        while self.now.is_("heap", "btree", "assigned", "explicit"):
            t = self.next()
            if t.is_("heap", "btree"):
                if storage:
                    raise InvalidArgument("the storage clause is written twice", t.byte)
                storage = t.text.lower()
            else:
                if mode:
                    raise InvalidArgument("the key mode is written twice", t.byte)
                mode, mode_byte = t.text.lower(), t.byte
        return A.CreateTable(name, columns, storage, mode, start, mode_byte)

    def index(self, start: int):
        name = self.word("an index name").text
        self.expect("on")
        table = self.word("a relation name").text
        keys = self.names(MAX_INDEX_KEYS, "an index")
        covering = self.names(MAX_COVERED, "COVERING") if self.accept("covering") else []
        return A.CreateIndex(name, table, keys, covering, start)

    def cabin(self, start: int):
        self.expect("on")
        table = self.word("a relation name").text
        columns = self.names(1, "a cabin")
        return A.CreateCabin(table, columns[0], start)

    def pattern(self, start: int):
        name = self.word("a pattern name").text
        params: list[tuple[str, Kind]] = []
        self.expect("(")
        while not self.accept(")"):
            if params:
                self.expect(",")
            if self.now.kind != "named":
                raise InvalidArgument("a pattern's parameter is written $name type", self.now.byte)
            at = self.next().text[1:]
            kind, args = self.word("a type"), []
            if self.accept("("):
                args.append(self.number("a precision"))
                if self.accept(","):
                    args.append(self.number("a scale"))
                self.expect(")")
            params.append((at, kind_of(kind.text, args, "$" + at, kind.byte)))
        options: dict = {"pinned": False, "expected_instances": None}
        if self.accept("with"):
            self.expect("(")
            while True:
                key = self.word("an option")
                self.expect("=")
                if key.is_("pinned"):
                    options["pinned"] = self.next().text.lower() == "on"
                elif key.is_("expected_instances"):
                    options["expected_instances"] = self.number("expected_instances")
                else:
                    raise InvalidArgument(f"unknown option '{key.text}'", key.byte)
                if not self.accept(","):
                    break
            self.expect(")")
        self.expect("of")
        at = self.now.byte
        self.in_pattern, self.params = True, dict(params)
        body = self.select()
        return A.CreatePattern(name, params, options, body, self.sql.encode()[at:].decode(), start)

    def assertion(self, start: int):
        name = self.word("an assertion name").text
        self.expect("on")
        table = self.word("a relation name").text
        self.expect("group")
        self.expect("by")
        group = self.names(8, "GROUP BY")
        self.expect("check")
        func = self.word("COUNT or SUM")
        self.expect("(")
        if func.is_("count"):
            self.expect("*")
            column = None
        elif func.is_("sum"):
            column = self.name()
        else:
            raise Unsupported("CHECK takes COUNT(*) or SUM(column)", func.byte)
        self.expect(")")
        op = self.next()
        if op.text not in ("<", "<="):
            raise Unsupported("an assertion is an upper bound: < or <=", op.byte)
        if self.now.kind != "int":
            raise InvalidArgument("a bound is a whole number", self.now.byte)
        bound = int(self.next().text) - (op.text == "<")
        return A.CreateAssertion(name, table, group, column, bound, start)

    def drop(self):
        start = self.next().byte
        what = self.expect("table", "index", "cabin", "pattern", "assertion").text.lower()
        if what == "cabin":
            self.expect("on")
            table = self.word("a relation name").text
            return A.Drop(what, table, start, self.names(1, "a cabin")[0].name)
        return A.Drop(what, self.word("a name").text, start)

    def alter(self):
        start = self.next().byte
        self.expect("table")
        table = self.word("a relation name").text
        if not self.accept("rename"):
            raise Unsupported("ALTER TABLE renames only", self.now.byte)
        column = None
        if self.accept("column"):
            column = self.word("a column name").text
        self.expect("to")
        return A.Rename(table, column, self.word("a new name").text, start)


def ResourceLimit(byte: int):
    from ..errors import ResourceExhausted

    return ResourceExhausted(f"INSERT takes at most {MAX_INSERT_ROWS} rows", byte)
