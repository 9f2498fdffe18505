"""Statements in, rows or replies out: the engine's front."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
from contextlib import suppress
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .functions.types import KEY_MAX, MISMATCH, coerce, render, stored
from .operators.lower import TOO_MANY, Lowering, both, compare, condition
from .plans import ast as A
from .plans import observe
from .plans.chain import Block
from .plans.compiler import Compiler
from .plans.fingerprint import fingerprint
from .plans.parser import parse
from .sources.catalog import Assertion, Catalog, Column, Relation
from .sources.store import Pending, Store


#: SELECTs between two snapshots of the structure optimizer, and the bytes it counts as a page.
TUNE_EVERY, PAGE = 64, 8192


@dataclass
class Reply:
    """``df`` with columns named by position, and their ``labels``; or a ``message``."""

    df: DataFrame | None = None
    labels: tuple[str, ...] = ()
    message: str | None = None
    key: tuple[int, int] | None = None

    def text(self) -> str:
        """A header line and a line a row; gathers the rows, so for results of a screen or so."""
        if self.df is None:
            return self.message or ""
        return "\n".join([",".join(self.labels), *(",".join(map(render, r)) for r in self.df.collect())])


@dataclass
class Options:
    """Settings; limits refuse, they never cut."""

    default_mode: str = "assigned"
    half_life_s: int = 600
    # Spark spills, so there is no cap unless one is set
    max_groups: int | None = None  # a fold's groups
    max_distinct: int | None = None  # a DISTINCT fold's entries, groups counted apart
    sort_max_rows: int | None = None  # rows that ORDER BY sorts
    max_touched: int | None = None  # rows that a statement's steps look at


class Engine:
    """Shared by sessions: relations, their versions, and what was observed."""

    def __init__(self, spark: SparkSession, folder: str | None = None, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.catalog = Catalog(spark)
        self.store = Store(spark, folder or self._folder())
        self.access = observe.Access()
        self.trails = observe.TrailRecorder()
        self.values = observe.ObservedValues()
        self.optimizer = observe.StructureOptimizer()
        self.optimizer_on = True
        self.statements = 0  # SELECTs of all sessions

    def _folder(self) -> str:
        found = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
        if found:
            return found
        master = self.spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise E.InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        return found

    def session(self) -> Session:
        return Session(self)


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.catalog, self.store = engine, engine.catalog, engine.store
        self.isolation = "read committed"
        self.open: dict[str, Pending] | None = None
        self.pinned: dict[str, int] | None = None
        self.poisoned = False

    # ---- entry points
    def sql(self, text: str) -> DataFrame:
        """The rows of a SELECT, with its columns' labels as names (numbered where they repeat)."""
        got = self.execute(text)
        if got.df is None:
            raise E.InvalidArgument("not a statement that returns rows")
        names: list[str] = []
        for label in got.labels:
            names.append(label if label not in names else f"{label}#{len(names)}")
        return got.df.toDF(*names)

    def reply(self, text: str) -> str:
        """The text reply of any statement; errors become their line."""
        try:
            with translated():
                return self.execute(text).text()
        except E.EngineError as e:
            return E.reply(e)

    def execute(self, text: str) -> Reply:
        s = parse(text)
        control = isinstance(s, A.Control) and s.verb in ("commit", "rollback")
        if self.poisoned and not control:
            raise E.InvalidArgument("this transaction has failed: only ROLLBACK is taken")
        try:
            with translated():
                return self.run(s, text)
        except E.EngineError:
            self.poisoned = self.open is not None and not control
            raise

    def run(self, s, text: str) -> Reply:
        if isinstance(s, A.Select):
            return self.select(s, text)
        if isinstance(s, A.Analyze):
            return self.analyze(s.query)
        if isinstance(s, A.Control):
            return getattr(self, f"do_{s.verb}")(s)
        return getattr(self, "do_" + type(s).__name__.lower())(s)

    # ---- reading
    def version(self, rel: Relation) -> int:
        newest = len(rel.versions) - 1
        if self.open is None or self.pinned is None:
            return newest
        return self.pinned.setdefault(rel.name.lower(), newest)

    def seen(self, name: str, latest: bool = False) -> DataFrame:
        rel = self.catalog.find(name)
        own = (self.open or {}).get(rel.name.lower())
        return self.store.seen(rel, len(rel.versions) - 1 if latest else self.version(rel), own)

    def clean(self, rel: Relation) -> bool:
        """Whether what this session sees of a relation is a committed version of it."""
        return rel.view is None and rel.name.lower() not in (self.open or {})

    def learn(self, block: Block) -> None:
        """Record the keys of rows with a value that a cabin's column is compared with, the first time at a version; long lists aren't."""
        low, store = self.lowering(), self.engine.values
        for slot, s in enumerate(block.slots):
            rel = self.catalog.find(s.table)
            for t in block.tests if rel.cabins and self.clean(rel) else ():
                if len(t.refs) == 1 and t.ref.slot == slot and t.ref.name in rel.cabins and getattr(t, "op", "") == "=" and not t.never:
                    at = (rel.oid, rel.column(t.ref.name).stored, t.value, self.version(rel))
                    if store.rows(at) is None:
                        for old in [k for k in store.values if k[:3] == at[:3]]:
                            store.forget(old)
                        found = low.scan(block, slot).where(condition(t)).select(f"c{block.level}_{slot}_{rel.key}").limit(observe.OBSERVED_ENTRIES + 1).collect()
                        store.observe(at, {r[0] for r in found})
        for s in block.subs:
            self.learn(s.block)

    def tune(self, now: int | None = None) -> list[observe.Action]:
        """One snapshot for the structure optimizer, of the scans that sessions ran on one column; what it decides is done.

        A scan is taken to read its relation's files in pages of PAGE bytes.
        """
        engine, now = self.engine, time.time_ns() if now is None else now
        if not engine.optimizer_on:
            return []
        shapes, stored = [], {r.oid: r for r in self.catalog._relations.values() if r.view is None}
        for (kind, name, columns), score in engine.access.scores.items():
            rel = self.catalog._relations.get(name)
            column = rel and rel.oid in stored and len(columns) == 1 and rel.column(columns[0])
            if not column or kind not in ("FilterScan", "CabinProbe") or column.name == rel.key or column.policy == "no":
                continue
            often, served = score.read(now, engine.options.half_life_s * 10**9), rel.cabins.get(column.name, 0)
            pages = 1 if served else max(1, sum(self.store.sizes(p.path for p in rel.versions[-1])) // PAGE)
            shapes.append(observe.Shape(rel.oid, rel.columns.index(column), often, often * pages, served))
        actions = engine.optimizer.decide(shapes, [], now)
        for a in actions:
            rel = stored.get(a.relation)
            if rel is None:
                engine.optimizer.dropped(a.relation, a.column)
            elif a.what == "CREATE":
                rel.cabins[rel.columns[a.column].name] = oid = self.catalog.oid()
                engine.optimizer.built(a.relation, a.column, oid, engine.optimizer.entries[a.relation, a.column].pages)
            elif a.what == "DROP":
                rel.cabins.pop(rel.columns[a.column].name, None)
                engine.optimizer.dropped(a.relation, a.column)
        return actions

    def trail(self, block: Block, text: str) -> dict[int, tuple[int, ...]]:
        """The keys that an instance of a statement over one relation touched before, at this version; records them from its second sighting, or the first if its pattern is declared."""
        if len(block.slots) != 1 or block.subs or not block.tests or not text:
            return {}
        rel, key, trails = self.catalog.find(block.slots[0].table), fingerprint(text), self.engine.trails
        if not key or not self.clean(rel):
            return {}
        instance = (key.pattern_id, key.arg_hash, rel.oid, self.version(rel))
        if instance not in trails.trails:
            declared = any(p["id"] == key.pattern_id for p in self.catalog.patterns.values())
            if trails.seen[instance] + 1 < (1 if declared else 2):
                trails.offer(instance, [])
                return {}
            found = self.lowering().frame(block).select(f"c{block.level}_0_{rel.key}").limit(observe.TRAIL_ENTRIES + 1).collect()
            trails.offer(instance, [r[0] for r in found], declared)
        return {rel.oid: trails.trails[instance]} if instance in trails.trails else {}

    def lowering(self, trail: dict | None = None) -> Lowering:
        out = Lowering(self.seen, self.store.keep, self.engine.options.max_groups)
        out.keyed = lambda t: self.catalog.find(t).unique

        def narrowed(table, bounds, named):
            rel = self.catalog.find(table)
            keys = (trail or {}).get(rel.oid)
            for name, op, value in bounds:
                if keys is None and op == "=" and name in rel.cabins and self.clean(rel):
                    keys = self.engine.values.rows((rel.oid, rel.column(name).stored, value, self.version(rel)))
            index = next((n for n, by in rel.indexes.items() if any(b[:2] == (by[0], "=") for b in bounds)), None) if keys is None and rel.view is None else None
            if index:
                held = self.store.through(rel, index, self.version(rel), (self.open or {}).get(rel.name.lower()))
                if named <= set(held.columns):
                    return held
                tests = both(compare(op, F.col(name), value, rel.column(name).kind) for name, op, value in bounds if name in held.columns)
                found = held.where(tests).select(rel.key).limit(observe.OBSERVED_ENTRIES + 1).collect()
                keys = [r[0] for r in found] if len(found) <= observe.OBSERVED_ENTRIES else None
            if keys is not None:  # the tests are still made: this only reads less
                return self.seen(table).where(F.col(rel.key).isin(*sorted(keys)) if keys else F.lit(False))
            known = [b for b in bounds if b[0] in rel.doubles]
            return rel.narrowed(known) if known else self.seen(table)

        out.narrowed = narrowed
        return out

    def select(self, q: A.Select, text: str = "") -> Reply:
        if q.relations[0].schema:
            return self.catalog_view(q)
        block = Compiler(self.catalog).select(q)
        self.observe(block)
        self.within_limits(block)
        labels = tuple(f.label for f in block.folds) if block.folded else tuple(label for _, label in block.output)
        key = fingerprint(text) if text else None
        if self.engine.optimizer_on:
            self.engine.statements += 1
            if self.engine.statements % TUNE_EVERY == 0:
                self.tune()
            self.learn(block)
        return Reply(self.lowering(self.trail(block, text)).rows(block), labels, key=(key.pattern_id, key.arg_hash) if key else None)

    def examined(self, block: Block) -> list[int]:
        """Rows that each step of a block looks at: those that its key or index leads to, else all there are."""
        low, out = self.lowering(), []
        for slot, (s, step) in enumerate(zip(block.slots, block.steps)):
            frame = low.scan(block, slot)
            by = {"Lookup": [step.detail], "Range": [step.detail]}.get(step.kind) or self.catalog.find(s.table).indexes.get(step.detail, ()) if step.kind in ("Lookup", "Range", "IndexProbe", "IndexRange") else ()
            own = [t for t in block.tests if len(t.refs) == 1 and t.ref.slot == slot and t.ref.name in by]
            out.append((frame.where(both(map(condition, own))) if own else self.seen(s.table)).count())
        return out

    def touched(self, block: Block) -> int:
        return sum(self.examined(block)) + sum(self.touched(s.block) for s in block.subs)

    def within_limits(self, block: Block) -> None:
        """Refuses a statement beyond a limit that is set, before any of its rows is returned."""
        o = self.engine.options
        if o.max_touched is not None and (n := self.touched(block)) > o.max_touched:
            raise E.ResourceExhausted(f"the statement looks at {n} rows, {o.max_touched} are allowed")
        if o.sort_max_rows is not None and block.order and (n := self.lowering().frame(block).count()) > o.sort_max_rows:
            raise E.ResourceExhausted(f"ORDER BY would sort {n} rows, {o.sort_max_rows} are allowed")
        for f in block.folds if o.max_distinct is not None else ():
            if f.distinct:
                n = self.lowering().frame(block).select(*(F.col(r.at) for r in block.group), F.col(f.ref.at)).distinct().count()
                if n > o.max_distinct:
                    raise E.ResourceExhausted(f"DISTINCT would hold {n} entries, {o.max_distinct} are allowed")

    def observe(self, block: Block) -> None:
        now, half = time.time_ns(), self.engine.options.half_life_s * 10**9
        for slot, step in zip(block.slots, block.steps):
            columns = tuple(sorted({r.name for t in block.tests for r in t.refs if block.slots[r.slot] is slot}))
            self.engine.access.record(step.kind, slot.table, columns, now, half)
        for s in block.subs:
            self.observe(s.block)

    def catalog_view(self, q: A.Select) -> Reply:
        """sys.*: WHERE on its columns, LIMIT and OFFSET; nothing else."""
        r = q.relations[0]
        df = self.catalog.view(r.table.lower())
        if df is None:
            raise E.NotFound(f"unknown catalog view 'sys.{r.table}'", r.byte)
        if len(q.relations) > 1 or q.order or q.group or any(i.func for i in q.items):
            raise E.Unsupported("a catalog view takes WHERE, LIMIT and OFFSET only", r.byte)
        view = Relation(0, r.table, [], view=df)
        temporary = Catalog(self.engine.spark)
        temporary.register(r.table, view.view, unique=False)
        q.relations[0] = A.Relation(r.table, r.alias, r.byte)
        block = Compiler(temporary).select(q)
        low = Lowering(lambda n: temporary.find(n).view, self.store.keep)
        low.keyed = lambda t: False
        return Reply(low.rows(block), tuple(label for _, label in block.output))

    def analyze(self, q: A.Select) -> Reply:
        """Runs the query and reports its class, steps, counted rows and Spark's plan."""
        block = Compiler(self.catalog).select(q)
        df = self.lowering().rows(block)
        n = df.count()
        lines = [f"rows={n} class={block.kind} steps={len(block.steps)}" + f" groups={n}" * block.folded + " sorted=1" * bool(block.order)]

        def show(b: Block, indent: int) -> None:
            for slot, step, looked in zip(b.slots, b.steps, self.examined(b)):
                tests = sum(any(r.slot == b.slots.index(slot) for r in t.refs) for t in b.tests)
                lines.append("  " * indent + f"{step.kind} {slot.table}" + f" as {slot.alias}" * (slot.alias != slot.table) + f" {step.detail}".rstrip() + f" examined={looked} residual={tests}")
            for s in b.subs:
                hoisted = s.kind == "exists" and not s.block.links
                lines.append("  " * (indent + 1) + ("not " * s.negated) + s.kind + " once" * hoisted)
                show(s.block, indent + 2)

        show(block, 1)
        lines.append(df._jdf.queryExecution().toString())
        return Reply(message="\n".join(lines))

    # ---- transactions
    def do_begin(self, s) -> Reply:
        if self.open is not None:
            raise E.InvalidArgument("BEGIN inside a transaction: end the open one first")
        self.open = {}
        self.pinned = {n: len(r.versions) - 1 for n, r in self.catalog._relations.items()} if self.isolation == "repeatable read" else None
        self.store.pending.append(self.open)
        return Reply(message="BEGIN")

    def _end(self) -> dict:
        if self.open is None:
            raise E.InvalidArgument("no transaction is open")
        changes, self.open, self.pinned, self.poisoned = self.open, None, None, False
        self.store.pending = [p for p in self.store.pending if p is not changes]
        return changes

    def do_commit(self, s) -> Reply:
        failed = self.poisoned
        changes = self._end()
        if failed:
            return Reply(message="ROLLBACK")
        self.store.commit({n: self.catalog.find(n) for n in changes}, changes)
        return Reply(message="COMMIT")

    def do_rollback(self, s) -> Reply:
        self._end()
        return Reply(message="ROLLBACK")

    def do_set(self, s) -> Reply:
        words = [a.lower() for a in s.args]
        if words[:2] == ["isolation", "level"] and " ".join(words[2:]) in ("read committed", "repeatable read"):
            if self.open is not None:
                raise E.InvalidArgument("the isolation level can't change inside a transaction")
            self.isolation = " ".join(words[2:])
        elif words[:1] == ["cabin_optimizer"] and words[-1] in ("on", "off"):
            self.engine.optimizer_on = words[-1] == "on"
        else:
            raise E.InvalidArgument(f"unknown setting '{' '.join(s.args)}'", s.byte)
        return Reply(message="OK")

    def do_ping(self, s) -> Reply:
        return Reply(message="PONG")

    def do_sync(self, s) -> Reply:
        return Reply(message="SYNCED")  # a commit is durable once its files are written

    def do_stop(self, s) -> Reply:
        with suppress(E.EngineError):
            self._end()
        return Reply(message="BYE")

    # ---- changing rows
    def change(self, rel: Relation, made) -> Reply:
        """Run ``made(pending)`` as part of the open transaction, or as one of its own; nothing of it stays if it fails."""
        single = self.open is None
        if single:
            self.do_begin(None)
        name = rel.name.lower()
        own = self.open.setdefault(name, Pending(self.version(rel)))
        before = (list(own.added), list(own.removed), list(own.dead))
        try:
            out = made(own)
        except BaseException:
            own.added, own.removed, own.dead = before
            if single:
                self._end()
            raise
        if single:
            self.do_commit(None)
        return out

    def writable(self, name: str, byte: int) -> Relation:
        rel = self.catalog.find(name)
        if not rel:
            raise E.NotFound(f"unknown relation '{name}'", byte)
        if rel.view is not None:
            raise E.Unsupported(f"relation '{name}' is outside data and can't be written", byte)
        return rel

    def do_insert(self, s: A.Insert) -> Reply:
        rel = self.writable(s.table, s.byte)
        columns = rel.columns if rel.mode == "explicit" else rel.columns[1:]
        rows = []
        for n, row in enumerate(s.rows, 1):
            if len(row) != len(columns):
                if rel.mode == "assigned" and len(row) == len(columns) + 1:
                    raise E.InvalidArgument(f"row {n} names a value for '{rel.key}', whose values the engine assigns")
                if rel.mode == "explicit" and len(row) == len(columns) - 1:
                    raise E.InvalidArgument(f"row {n} lacks a value for '{rel.key}': keys of an EXPLICIT relation come with the row")
                raise E.InvalidArgument(f"row {n} has {len(row)} values, {len(columns)} are expected", row[0].byte)
            values = []
            for c, x in zip(columns, row):
                if x.value is None and not c.nullable:
                    raise E.InvalidArgument(f"column '{c.name}' is NOT NULL (row {n})", x.byte)
                values.append(stored(x.value, x.quoted, c.kind, c.name, x.byte))
            rows.append(values)
        return self.insert_rows(rel, rows)

    def insert_rows(self, rel: Relation, rows: list[list]) -> Reply:
        """Insert rows of Python values, all or none; with the key first if the relation is EXPLICIT."""
        if rel.mode == "assigned":
            if rel.next_id + len(rows) - 1 > KEY_MAX:
                raise E.OutOfRange("the key space is exhausted")
            first = rel.next_id
            rel.next_id += len(rows)  # ids aren't given back
            rows = [[first + i, *r] for i, r in enumerate(rows)]
        else:
            for r in rows:
                if not 1 <= r[0] <= KEY_MAX:
                    raise E.InvalidArgument(f"primary key {r[0]} is outside 1..{KEY_MAX}" + ": 0 is reserved for 'unset'" * (r[0] == 0))
        return self.change(rel, lambda own: self.insert_frame(rel, self.engine.spark.createDataFrame(rows, rel.schema), own))

    def insert_frame(self, rel: Relation, df: DataFrame, own: Pending) -> Reply:
        path = self.store.write(df, rel)
        df = rel.read(self.engine.spark, (path,))
        n = df.count()
        if rel.mode == "explicit":
            twice = df.groupBy(rel.key).count().where("count > 1").first() or df.join(self.store.used_keys(rel, own), rel.key, "left_semi").first()
            if twice:
                raise E.AlreadyExists(f"duplicate primary key {twice[0]} already present")
            held = df.join(self.store.added_elsewhere(rel, self.open), rel.key, "left_semi").first()
            if held:
                raise E.TxnConflict(f"row id={held[0]} is being added by another transaction")
        self.check_parents(rel, df)
        own.added.append(path)
        self.check_assertions(rel, df, None)
        return Reply(message=f"INSERTED {n}")

    def matched(self, rel: Relation, block: Block) -> DataFrame:
        frame = self.lowering().frame(block)
        return frame.select(*(F.col(f"c0_0_{c.name}").alias(c.name) for c in rel.columns))

    def do_update(self, s: A.Update) -> Reply:
        rel = self.writable(s.table, s.byte)
        block, values = Compiler(self.catalog).change(rel.name, s.byte, s.where, s.assignments)

        def made(own):
            old = self.store.keep(self.matched(rel, block))
            n = old.count()
            if not n:
                return Reply(message="UPDATED 0")
            self.store.conflicts(rel, old.select(rel.key), self.version(rel), self.open)
            new = old.select(*(F.lit(values[c.name]).cast(c.kind.spark).alias(c.name) if c.name in values else F.col(c.name) for c in rel.columns))
            path = self.store.write(new, rel)
            new = rel.read(self.engine.spark, (path,))
            self.check_parents(rel, new, set(values))
            self.replace(rel, own, old, path)
            self.check_assertions(rel, new, old)
            return Reply(message=f"UPDATED {n}")

        return self.change(rel, made)

    def replace(self, rel: Relation, own: Pending, old: DataFrame, path: str | None) -> None:
        """Remove the rows ``old``, those the transaction itself added included, and add those at ``path``."""
        keys = old.select(rel.key)
        if own.added:
            rest = rel.read(self.engine.spark, tuple(own.added)).join(keys, rel.key, "left_anti")
            own.added[:] = [self.store.write(rest, rel)]
        own.removed.append(self.store.write(keys, rel))
        if path:
            own.added.append(path)

    def do_delete(self, s: A.Delete) -> Reply:
        rel = self.writable(s.table, s.byte)
        block, _ = Compiler(self.catalog).change(rel.name, s.byte, s.where)

        def made(own):
            old = self.store.keep(self.matched(rel, block))
            n = old.count()
            if n:
                self.store.conflicts(rel, old.select(rel.key), self.version(rel), self.open)
                self.check_children(rel, old.select(rel.key))
                self.replace(rel, own, old, None)
                own.dead.append(own.removed[-1])
            return Reply(message=f"DELETED {n}")

        return self.change(rel, made)

    # ---- constraints: against the newest committed rows and the transaction's own
    def check_parents(self, rel: Relation, rows: DataFrame, only: set[str] | None = None) -> None:
        for c in rel.columns:
            if c.references and (only is None or c.name in only):
                parent = self.catalog.find(c.references)
                keys = self.seen(parent.name, latest=True).select(F.col(parent.key).alias("_key"))
                lost = rows.where(F.col(c.name).isNotNull()).join(keys, F.col(c.name) == F.col("_key"), "left_anti").first()
                if lost:
                    raise E.FkViolation(f"{rel.name}.{c.name}={lost[c.name]} has no row in {parent.name}")

    def check_children(self, parent: Relation, keys: DataFrame) -> None:
        for child in self.catalog.relations.values():
            for c in child.columns:
                if c.references and c.references.lower() == parent.name.lower():
                    held = self.seen(child.name, latest=True).join(keys.withColumnRenamed(parent.key, "_key"), F.col(c.name) == F.col("_key"), "left_semi").first()
                    if held:
                        raise E.FkViolation(f"row {held[0]} of {child.name} refers to {parent.name} {held[c.name]}")

    def check_assertions(self, rel: Relation, new: DataFrame, old: DataFrame | None) -> None:
        for a in self.catalog.assertions.values():
            if a.table.lower() == rel.name.lower():
                bad = self.violations(a, self.seen(rel.name, latest=True), new, old).first()
                if bad:
                    raise E.AssertionViolation(f"assertion '{a.name}': {', '.join(f'{g}={render(bad[g])}' for g in a.group)} would exceed bound {a.bound} ({bad['_value']})")

    @staticmethod
    def violations(a: Assertion, rows: DataFrame, new: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
        """Groups above their bound; with ``new`` rows only groups that grew by them (over ``old`` ones)."""
        value = F.sum(F.coalesce(F.col(a.column), F.lit(0))) if a.column else F.count(F.lit(1))
        per = lambda df, name: df.groupBy(*(F.col(g) for g in a.group)).agg(value.alias(name))
        out = per(rows, "_value")
        if new is not None:
            grown = per(new, "_plus").toDF(*(f"_g{i}" for i in range(len(a.group))), "_plus")
            same = lambda p: both(F.col(g).eqNullSafe(F.col(f"{p}{i}")) for i, g in enumerate(a.group))
            out = out.join(grown, same("_g"))
            if old is not None:
                was = per(old, "_minus").toDF(*(f"_h{i}" for i in range(len(a.group))), "_minus")
                out = out.join(was, same("_h"), "left").where(F.col("_plus") > F.coalesce(F.col("_minus"), F.lit(0)))
            else:
                out = out.where(F.col("_plus") > 0)
        return out.where(F.col("_value") > a.bound)

    # ---- definitions
    def do_createtable(self, s: A.CreateTable) -> Reply:
        found = self.catalog.find(s.name)
        if found:
            return Reply(message=f"EXISTS oid={found.oid}")
        mode = s.mode or self.engine.options.default_mode
        storage = s.storage or ("btree" if mode == "explicit" and not s.mode else "heap")
        key = s.columns[0]
        if not key.kind.is_int:
            raise E.InvalidArgument(f"primary-key column '{key.name}' needs an integer type", key.byte)
        if key.nullable:
            raise E.InvalidArgument(f"primary-key column '{key.name}' can't be NULL", key.byte)
        if mode == "explicit" and storage != "btree":
            raise E.Unsupported("an EXPLICIT relation must be BTREE", s.mode_byte)
        names = [c.name.lower() for c in s.columns]
        cabins = {}
        for i, c in enumerate(s.columns):
            if c.name.lower() in names[:i]:
                raise E.InvalidArgument(f"column '{c.name}' is declared twice", c.byte)
            if i == 0 and (c.policy or c.references):
                raise E.Unsupported("the primary key carries neither a cabin nor a reference", c.byte)
            if c.references:
                parent = self.catalog.find(c.references)
                if not parent:
                    raise E.NotFound(f"unknown relation '{c.references}'", c.byte)
                if parent.storage != "btree":
                    raise E.Unsupported(f"'{c.references}' is HEAP; a referenced relation must be BTREE", c.byte)
                if not c.kind.is_int:
                    raise E.InvalidArgument(f"column '{c.name}' refers to a key and needs an integer type", c.byte)
            if c.policy == "yes":
                cabins[c.name] = self.catalog.oid()
        rel = Relation(self.catalog.oid(), s.name, [Column(c.name, c.kind, c.nullable, c.references, c.policy) for c in s.columns], storage, mode, cabins=cabins)
        self.catalog._relations[s.name.lower()] = rel
        return Reply(message=f"CREATED oid={rel.oid}")

    def _named(self, table: str, byte: int) -> Relation:
        rel = self.catalog.find(table)
        if not rel:
            raise E.NotFound(f"unknown relation '{table}'", byte)
        return rel

    def _column(self, rel: Relation, n: A.Name) -> Column:
        c = rel.column(n.name)
        if not c:
            raise E.InvalidArgument(f"unknown column '{n}'", n.byte)
        return c

    def do_createindex(self, s: A.CreateIndex) -> Reply:
        rel = self._named(s.table, s.byte)
        if any(s.name in r.indexes for r in self.catalog.relations.values()):
            raise E.AlreadyExists(f"index '{s.name}' exists", s.byte)
        if rel.storage != "btree":
            raise E.Unsupported("only a BTREE relation carries an index", s.byte)
        names = []
        for n in [*s.keys, *s.covering]:
            c = self._column(rel, n)
            if c.name == rel.key or c.nullable or c.name in names:
                raise E.InvalidArgument(f"column '{n}' can't be part of an index: it is the key, nullable or repeated", n.byte)
            names.append(c.name)
        rel.indexes[s.name], rel.covering[s.name] = names[: len(s.keys)], names[len(s.keys) :]
        if rel.view is None:
            self.store.index(rel)
        return Reply(message=f"CREATED INDEX {s.name}")

    def do_createcabin(self, s: A.CreateCabin) -> Reply:
        rel = self._named(s.table, s.byte)
        c = self._column(rel, s.column)
        if c.name == rel.key:
            raise E.Unsupported("the primary key carries no cabin", s.column.byte)
        if c.policy == "no":
            raise E.Unsupported(f"column '{c.name}' is declared NO CABIN", s.column.byte)
        if c.name in rel.cabins:
            raise E.AlreadyExists(f"'{rel.name}({c.name})' has a cabin", s.byte)
        rel.cabins[c.name] = self.catalog.oid()
        return Reply(message=f"CREATED CABIN {rel.cabins[c.name]}")

    def do_createpattern(self, s: A.CreatePattern) -> Reply:
        if s.name.lower() in self.catalog.patterns:
            raise E.AlreadyExists(f"pattern '{s.name}' exists", s.byte)
        declared = dict(s.params)
        used: list[str] = []

        def literals(q):
            for p in q.where:
                for x in (getattr(p, "right", None), getattr(p, "low", None), getattr(p, "high", None)):
                    if isinstance(x, A.Literal) and x.named:
                        if x.named not in declared:
                            raise E.InvalidArgument(f"parameter '${x.named}' is not declared", x.byte)
                        used.append(x.named)
                sub = getattr(p, "query", None) or (p.right if isinstance(getattr(p, "right", None), A.Select) else None)
                if sub:
                    literals(sub)

        literals(s.body)
        for name in declared:
            if name not in used:
                raise E.InvalidArgument(f"parameter '${name}' is not used", s.byte)
        Compiler(self.catalog).select(s.body)
        self.catalog.patterns[s.name.lower()] = {"id": fingerprint(s.sql).pattern_id, "sql": s.sql, "params": s.params, **s.options}
        return Reply(message=f"CREATED PATTERN {s.name} id={self.catalog.patterns[s.name.lower()]['id']:016x}")

    def pattern(self, name: str, **values) -> DataFrame:
        """Run a declared pattern with its parameters bound."""
        found = self.catalog.patterns.get(name.lower())
        if not found:
            raise E.NotFound(f"unknown pattern '{name}'")
        spelled = {}
        for p, kind in found["params"]:
            if p not in values:
                raise E.InvalidArgument(f"parameter '${p}' has no value")
            v = values[p]
            if isinstance(v, str) and "'" in v:
                raise E.Unsupported("a text literal can't hold a quote")
            spelled["$" + p] = "NULL" if v is None else str(int(v)) if isinstance(v, int) else f"'{v}'"
            if coerce(v if v is None or isinstance(v, int) else str(v), not isinstance(v, int), kind) is MISMATCH:
                raise E.InvalidArgument(f"parameter '${p}' is {kind}, not {v!r}")
        if extra := set(values) - {p for p, _ in found["params"]}:
            raise E.InvalidArgument(f"pattern '{name}' has no parameter '${min(extra)}'")
        # whole tokens; what stands in quotes is none
        return self.sql(re.sub(r"'[^']*'|\$[A-Za-z_][A-Za-z0-9_]*", lambda m: spelled.get(m[0], m[0]), found["sql"]))

    def do_createassertion(self, s: A.CreateAssertion) -> Reply:
        rel = self._named(s.table, s.byte)
        if s.name.lower() in self.catalog.assertions:
            raise E.AlreadyExists(f"assertion '{s.name}' exists", s.byte)
        column = None
        if s.column:
            column = self._column(rel, s.column)
            if column.kind.name == "uint64":
                raise E.Unsupported("SUM over uint64 is not supported", s.column.byte)
            if column.kind.name != "int64":
                raise E.InvalidArgument("SUM takes an int64 column", s.column.byte)
        if any(rel.name.lower() in p for p in self.store.pending if p is not self.open):
            raise E.TxnConflict(f"relation '{rel.name}' has a writer that hasn't committed")
        a = Assertion(s.name, rel.name, [self._column(rel, g).name for g in s.group], column.name if column else None, s.bound)
        if self.violations(a, self.seen(rel.name, latest=True)).first():
            raise E.AssertionViolation(f"assertion '{s.name}' doesn't hold for the rows there are")
        self.catalog.assertions[s.name.lower()] = a
        return Reply(message=f"CREATED ASSERTION {s.name}")

    def do_drop(self, s: A.Drop) -> Reply:
        if s.what == "table":
            rel = self._named(s.name, s.byte)
            for other in self.catalog.relations.values():
                if other is not rel and any((c.references or "").lower() == rel.name.lower() for c in other.columns):
                    raise E.InvalidArgument(f"'{other.name}' refers to '{rel.name}'", s.byte)
            if any(a.table.lower() == rel.name.lower() for a in self.catalog.assertions.values()):
                raise E.InvalidArgument(f"an assertion names '{rel.name}'", s.byte)
            del self.catalog._relations[rel.name.lower()]
            return Reply(message=f"DROPPED {s.name}")
        if s.what == "index":
            rel = next((r for r in self.catalog.relations.values() if s.name in r.indexes), None)
            holder, name = rel.indexes if rel else {}, s.name
            if rel:
                del rel.covering[name]
                rel.sorted_paths = {k: p for k, p in rel.sorted_paths.items() if k[0] != name}
        elif s.what == "cabin":
            rel = self._named(s.name, s.byte)
            holder, name = rel.cabins, s.column
        else:
            holder, name = {"pattern": self.catalog.patterns, "assertion": self.catalog.assertions}[s.what], s.name.lower()
        if name not in holder:
            raise E.NotFound(f"unknown {s.what} '{s.name}'", s.byte)
        del holder[name]
        return Reply(message=f"DROPPED {s.what.upper()} {s.name}")

    def do_rename(self, s: A.Rename) -> Reply:
        rel = self.writable(s.table, s.byte)
        if any(a.table.lower() == rel.name.lower() for a in self.catalog.assertions.values()):
            raise E.InvalidArgument(f"an assertion names '{rel.name}'", s.byte)
        if s.column is None:
            if self.catalog.find(s.to):
                raise E.AlreadyExists(f"relation '{s.to}' exists", s.byte)
            del self.catalog._relations[rel.name.lower()]
            for other in self.catalog.relations.values():
                for c in other.columns:
                    if (c.references or "").lower() == rel.name.lower():
                        c.references = s.to
            rel.name = s.to
            self.catalog._relations[s.to.lower()] = rel
            return Reply(message=f"RENAMED {s.to}")
        c = rel.column(s.column)
        if not c:
            raise E.InvalidArgument(f"unknown column '{s.column}'", s.byte)
        if rel.column(s.to):
            raise E.AlreadyExists(f"column '{s.to}' exists", s.byte)
        if any((self.open or {}).get(rel.name.lower(), Pending(0)).added):
            raise E.Unsupported("a relation with pending rows can't be renamed", s.byte)
        old, c.name = c.name, s.to  # files keep the name they have, in every version
        for held in (rel.indexes, rel.covering):
            for k, v in held.items():
                held[k] = [s.to if n == old else n for n in v]
        rel.cabins = {s.to if n == old else n: i for n, i in rel.cabins.items()}
        return Reply(message=f"RENAMED {s.to}")

    # ---- reports
    def table_of(self, rows: list[tuple], schema: str) -> Reply:
        df = self.engine.spark.createDataFrame(rows, schema)
        return Reply(df, tuple(df.columns))

    def do_describe(self, s) -> Reply:
        rel = self._named("".join(s.args), s.byte)
        rows = [(c.name, str(c.kind), "NULL" if c.nullable else "NOT NULL", "PK " + rel.mode.upper() if i == 0 else c.references and f"REFERENCES {c.references}", c.policy) for i, c in enumerate(rel.columns)]
        return self.table_of(rows, "column string, type string, nullable string, key string, cabin string")

    def do_show(self, s) -> Reply:
        what, rels = " ".join(s.args).lower(), sorted(self.catalog.relations.values(), key=lambda r: r.oid)
        now, half = time.time_ns(), self.engine.options.half_life_s * 10**9
        if what == "tables":
            return self.table_of([(r.oid, r.name, r.storage, r.mode) for r in rels], "oid long, name string, storage string, mode string")
        if what == "meta":
            return self.table_of([("relations", len(rels)), ("patterns", len(self.catalog.patterns)), ("assertions", len(self.catalog.assertions)), ("versions", sum(len(r.versions) for r in rels))], "name string, value long")
        if what == "patterns":
            return self.table_of([(n, f"{p['id']:016x}", p["pinned"]) for n, p in sorted(self.catalog.patterns.items())], "name string, pattern_id string, pinned boolean")
        if what == "access":
            return self.table_of(self.engine.access.rows(now, half), "kind string, relation string, columns string, use_count long, last_seen long, score double")
        if what == "budget":
            rows = [(r.name, *observe.id_budget(r.next_id - 1).values()) for r in rels]
            return self.table_of(rows, "relation string, capacity long, used long, left long, warn boolean")
        if what == "cabins":
            return self.table_of([(i, r.name, c) for r in rels for c, i in r.cabins.items()], "oid long, relation string, column string")
        if what == "indexes":
            return self.table_of([(n, r.name, ",".join(k), ",".join(r.covering[n])) for r in rels for n, k in r.indexes.items()], "name string, relation string, keys string, covering string")
        if what == "fkeys":
            return self.table_of([(r.name, c.name, c.references) for r in rels for c in r.columns if c.references], "relation string, column string, parent string")
        if what == "assertions":
            return self.table_of([(a.name, a.table, ",".join(a.group), f"SUM({a.column})" if a.column else "COUNT(*)", a.bound) for a in self.catalog.assertions.values()], "name string, relation string, group_by string, checked string, bound long")
        if what.startswith("relayout"):
            chosen = [r for r in rels if what in ("relayout", f"relayout {r.name.lower()}") and r.view is None]
            rows = [(r.name, x["action"], x["files"], x["files_after"], float(x["benefit"]), x["blocked"]) for r in chosen for x in observe.relayout(self.store.sizes(p.path for p in r.versions[-1]), walks=self.engine.access.walks(r.name, now, half))]
            return self.table_of(rows, "relation string, action string, files long, files_after long, benefit double, blocked string")
        if what == "cabin_optimizer":
            rows = [(k[0], k[1], e.state, e.pages) for k, e in sorted(self.engine.optimizer.entries.items())]
            return self.table_of(rows, "rel_oid long, col_pos int, state string, pages long")
        if what.startswith("page"):
            raise E.Unsupported("there are no pages here: rows are in Parquet files", s.byte)
        raise E.InvalidArgument(f"unknown report '{what}'", s.byte)


class translated:
    """Turns Spark's run-time errors into the engine's."""

    def __enter__(self):
        return self

    def __exit__(self, kind, e, trace):
        if e is None or isinstance(e, E.EngineError):
            return False
        text = str(e)
        if TOO_MANY in text:
            raise E.CardinalityViolation(TOO_MANY) from e
        if isinstance(e, PySparkException) or "Py4JJavaError" in kind.__name__:
            if "ARITHMETIC_OVERFLOW" in text or "NUMERIC_VALUE_OUT_OF_RANGE" in text:
                raise E.OutOfRange("a sum is out of range") from e
        return False
