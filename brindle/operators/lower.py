"""From chains to DataFrames: scans, inner joins, predicates, subqueries, folds, sorts and pages.

A frame is a DataFrame whose columns are named by level, slot and column, so
frames of nested blocks join without clashes.  What Catalyst can do (pushdown,
pruning, join order and strategy) is left to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chain import Block, NullTest, Ref, Sub, Test
from .fold import fold

_OPS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
#: The largest number that Spark's LIMIT and OFFSET take.
INT = 2**31 - 1
#: Joins that may multiply rows are left to Catalyst up to so many pairs; beyond, a cell has about CELL rows of a value from either side.
PAIRS, CELL = 1 << 24, 1024
#: What of a relation joined to a join may be broadcast, at so many bytes a column, and the rows that a join is taken to have: counting it would run it.
BROADCAST_BYTES, COLUMN_BYTES, JOINED_ROWS = 32 << 20, 32, 1 << 18
TOO_MANY = "a scalar subquery returned more than one row"


def condition(t) -> Column:
    c = F.col(t.ref.at)
    if isinstance(t, NullTest):
        return c.isNotNull() if t.negated else c.isNull()
    if t.never:
        return F.lit(False)
    if t.other is not None:
        return _OPS[t.op](c, F.col(t.other.at))
    return compare(t.op, c, t.value, t.ref.kind)


def compare(op: str, c: Column, value, kind) -> Column:
    return _OPS[op](c, F.lit(value) if kind.is_int else F.lit(value).cast(kind.spark))


def whole(n: int) -> Column:
    """A number of up to 64 bits without a sign."""
    return F.lit(str(n)).cast("decimal(20,0)")


def both(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


class Lowering:
    """``read``: a relation's name to its DataFrame; ``scratch``: writes a frame to the shared folder and reads it again."""

    def __init__(self, read, scratch, max_groups: int | None = None):
        self.read, self.scratch, self.max_groups = read, scratch, max_groups

    def narrowed(self, table: str, bounds: list[tuple[str, str, object]], named: set[str]) -> DataFrame:
        """The relation's rows, or fewer if the bounds (column, operator, value) tell early which fail; of columns at least the key and those ``named``."""
        return self.read(table)

    # ---- frames
    def scan(self, block: Block, slot: int) -> DataFrame:
        bounds = [(t.ref.name, t.op, t.value) for t in block.tests if isinstance(t, Test) and t.other is None and not t.never and (t.ref.level, t.ref.slot) == (block.level, slot)]
        named = {r.name for r in block.refs if (r.level, r.slot) == (block.level, slot)}
        df = self.narrowed(block.slots[slot].table, bounds, named) if bounds else self.read(block.slots[slot].table)
        return df.select(*(F.col(f"`{c}`").alias(f"c{block.level}_{slot}_{c}") for c in df.columns))

    def own(self, block: Block) -> DataFrame:
        """The block's relations joined and filtered by its own tests; no subqueries, no outer columns."""
        frame = self.scan(block, 0)
        single = {0} if self.unique(block.slots[0].table) else set()  # slots whose key no two rows of the frame share
        for slot in range(1, len(block.slots)):
            pairs, right, keyed = [(a, b) for a, b in block.joins if b.slot == slot and not self.mixed(a, b)], self.scan(block, slot), self.unique(block.slots[slot].table)
            to_one = keyed and any(b.is_key for _, b in pairs)
            from_one = any(a.is_key and a.slot in single for a, _ in pairs)
            frame = frame.join(right, both(F.col(a.at) == F.col(b.at) for a, b in pairs), "inner") if to_one or from_one or not pairs else self.many(frame, right, pairs, block)
            single = (single if to_one else set()) | ({slot} if keyed and from_one else set())
        return frame.where(both(map(condition, block.tests))) if block.tests else frame

    @staticmethod
    def mixed(a: Ref, b: Ref) -> bool:
        return a.kind.family != b.kind.family

    def many(self, left: DataFrame, right: DataFrame, pairs: list[tuple[Ref, Ref]], block: Block) -> DataFrame:
        """A join of two frames neither of which has its columns as a key; ``right`` is one relation.

        Spark sizes tasks by the bytes they read, and here a few MB may make
        10^9 rows.  So two relations are cut into cells; the rows of a join are
        dealt evenly to all cores and meet the next relation as a broadcast.
        """
        on = both(F.col(a.at) == F.col(b.at) for a, b in pairs)
        slot, n_right = pairs[0][1].slot, right.count()
        if (left.count() if slot == 1 else JOINED_ROWS) * n_right <= PAIRS:
            return left.join(right, on, "inner")
        spark = left.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        if slot == 1:
            return self.cells(left, right, pairs, block, tasks)
        named = {r.at for r in block.refs if (r.level, r.slot) == (block.level, slot)}
        if n_right * COLUMN_BYTES * len(named) <= BROADCAST_BYTES:
            return left.repartition(tasks).join(F.broadcast(right), on, "inner")
        return left.join(right, on, "inner")

    def cells(self, left: DataFrame, right: DataFrame, pairs: list[tuple[Ref, Ref]], block: Block, tasks: int) -> DataFrame:
        """The join of two relations, with the pairs of a frequent value laid out as a grid of about CELL by CELL rows; a row goes to all cells of its row or column."""
        lefts, rights, kept = list(dict.fromkeys(a.at for a, _ in pairs)), list(dict.fromkeys(b.at for _, b in pairs)), [*left.columns, *right.columns]
        on = both(F.col(a.at) == F.col(b.at) for a, b in pairs)
        n = F.count(F.lit(1))
        across = lambda c: F.ceil(F.col(c) / CELL).alias(c)
        # few values: each has more than CELL rows on one side
        frequent = left.groupBy(*lefts).agg(n.alias("_down")).join(right.groupBy(*rights).agg(n.alias("_along")), on).where((F.col("_down") > CELL) | (F.col("_along") > CELL))
        frequent = frequent.select(*lefts, *rights, across("_down"), across("_along"))

        def dealt(frame: DataFrame, slot: int, keys: list[str], own: str, other: str, at: str, copied: str) -> DataFrame:
            # by the rows' values, so that a task that runs again deals alike
            row = frame.columns[:1] if self.unique(block.slots[slot].table) else frame.columns
            out = frame.join(F.broadcast(frequent.select(*keys, "_down", "_along").distinct()), keys, "left")
            cell = F.pmod(F.xxhash64(*row), F.coalesce(own, F.lit(1))).alias(at)
            return out.select(*frame.columns, cell, F.explode(F.sequence(F.lit(1), F.coalesce(other, F.lit(1)))).alias(copied)).withColumn(copied, F.col(copied) - 1).repartition(tasks, *keys, *sorted((at, copied)))

        left = dealt(left, 0, lefts, "_down", "_along", "_row_l", "_way_l")
        right = dealt(right, 1, rights, "_along", "_down", "_way_r", "_row_r")
        return left.join(right, on & (F.col("_row_l") == F.col("_row_r")) & (F.col("_way_l") == F.col("_way_r")), "inner").select(*kept)

    def frame(self, block: Block) -> DataFrame:
        return self.apply(self.own(block), block)

    def apply(self, frame: DataFrame, block: Block) -> DataFrame:
        """``frame``, which holds all columns that the block's subqueries may name, without the rows that fail one."""
        for s in block.subs:
            frame = self.reduce(frame, s)
        return frame

    # ---- subqueries
    def reduce(self, frame: DataFrame, s: Sub) -> DataFrame:
        b = s.block
        deep = any(x.block.outermost < b.level or (x.ref is not None and x.ref.level < b.level) for x in b.subs)
        equal = all(isinstance(t, Test) and t.op == "=" and t.ref.level == b.level and not t.never for t in b.links)
        if deep or not equal and s.kind == "scalar":
            return self.unnested(frame, s)
        inner = self.frame(b)
        if s.kind == "exists":
            return self.linked(frame, inner, b, s.negated)
        value, ref = F.col(b.output[0][0].at), F.col(s.ref.at)
        keys = [F.col(n) for n in dict.fromkeys(t.ref.at for t in b.links)]
        link = both(map(condition, b.links))
        if s.kind == "in" and not s.negated:
            return frame.join(inner, link & (ref == value), "left_semi")
        if s.kind == "in" and not equal:
            # no linked row that is equal, none that is null, and for a null no linked row at all
            out = frame.join(inner, link & (ref == value), "left_anti")
            if b.output[0][0].nullable:
                out = self.linked(out, inner.where(value.isNull()), b, True)
            if s.ref.nullable:
                out = out.where(ref.isNotNull()).unionByName(self.linked(frame.where(ref.isNull()), inner, b, True))
            return out
        if s.kind == "in":
            # NOT IN: no row equal; and, unless the set is empty, no null on either side
            flags = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(value.isNull(), 1)).alias("_nulls"))
            frame = frame.join(inner.where(value.isNotNull()), link & (ref == value), "left_anti")
            kept = frame.columns
            frame = frame.join(flags, link, "left") if keys else frame.crossJoin(F.broadcast(flags))  # one row
            empty = F.coalesce(F.col("_n"), F.lit(0)) == 0
            return frame.where(empty | (ref.isNotNull() & (F.col("_nulls") == 0))).select(*kept)
        single = F.when(F.col("_n") > 1, F.raise_error(F.lit(TOO_MANY)).cast(b.output[0][0].kind.spark)).otherwise(F.col("_v"))
        flags = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
        kept = frame.columns
        frame = frame.join(flags, link) if keys else frame.crossJoin(F.broadcast(flags))  # one row
        return frame.where(_OPS[s.op](F.col(s.ref.at), single)).select(*kept)

    def linked(self, frame: DataFrame, inner: DataFrame, b: Block, negated: bool) -> DataFrame:
        """The frame's rows that some row of ``inner`` is linked with; ``negated``: those that none is.

        If a single link isn't an equality, the least and the largest of its
        column tell, for each value of the others: no pairs are formed.
        """
        how = "left_anti" if negated else "left_semi"
        if not b.links:
            inner = inner.select(F.lit(1).alias("_one")).limit(1)
        told = all(isinstance(t, Test) and t.other is not None and not t.never and t.ref.level == b.level for t in b.links)
        ranged = [t for t in b.links if isinstance(t, Test) and t.op != "="]
        if not told or len(ranged) != 1:
            return frame.join(inner, both(map(condition, b.links)), how)
        (t,), equal = ranged, [x for x in b.links if x.op == "="]
        keys = dict.fromkeys(x.ref.at for x in equal)
        ends = inner.groupBy(*keys).agg(F.min(t.ref.at).alias("_least"), F.max(t.ref.at).alias("_most"))
        outer, least, most = F.col(t.other.at), F.col("_least"), F.col("_most")
        test = {"<": least < outer, "<=": least <= outer, ">": most > outer, ">=": most >= outer, "!=": (least != outer) | (most != outer)}[t.op]
        return frame.join(ends if keys else F.broadcast(ends), both(map(condition, equal)) & test, how)  # without keys one row

    def unnested(self, frame: DataFrame, s: Sub) -> DataFrame:
        """Any nesting: the outer frame's rows get an id, are joined with the block's, and are judged by what is left."""
        b, kept = s.block, frame.columns
        rid = f"_rid{b.level}"
        # the id must be the same on every branch: kept in the shared folder
        frame = self.scratch(frame.withColumn(rid, F.monotonically_increasing_id()))
        link, inner = both(map(condition, b.links)), self.own(b)
        if s.kind == "exists":
            wide = self.apply(frame.join(inner, link, "inner"), b)
            return frame.join(wide.select(rid).distinct(), rid, "left_anti" if s.negated else "left_semi").select(*kept)
        value, ref = F.col(b.output[0][0].at), F.col(s.ref.at)
        if s.kind == "in":
            # pairs that are equal and, for NOT IN, those with a null on either side
            pairs = frame.join(inner, link & (ref == value), "inner")
            if s.negated and b.output[0][0].nullable:
                pairs = pairs.unionByName(frame.join(inner.where(value.isNull()), link, "inner"))
            if s.negated and s.ref.nullable:
                pairs = pairs.unionByName(frame.where(ref.isNull()).join(inner.where(value.isNotNull()), link, "inner"))
            hit = self.apply(pairs, b).select(rid).distinct()
            return frame.join(hit, rid, "left_anti" if s.negated else "left_semi").select(*kept)
        wide = self.apply(frame.join(inner, link, "inner"), b)
        one = wide.groupBy(rid).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
        single = F.when(F.col("_n") > 1, F.raise_error(F.lit(TOO_MANY)).cast(b.output[0][0].kind.spark)).otherwise(F.col("_v"))
        return frame.join(one, rid).where(_OPS[s.op](ref, single)).select(*kept)

    # ---- results
    def order(self, block: Block, frame: DataFrame) -> list[Column]:
        """ORDER BY's keys, null largest, then the order rows are emitted in: relation by relation, by key."""
        keys = [F.col(r.at).desc_nulls_first() if down else F.col(r.at).asc_nulls_last() for r, down in block.order]
        for slot, s in enumerate(block.slots):
            columns = [c for c in frame.columns if c.startswith(f"c{block.level}_{slot}_")]
            if self.unique(s.table):
                columns = columns[:1]
            keys += [F.col(c).asc_nulls_last() for c in columns]
        return keys

    def unique(self, table: str) -> bool:
        return getattr(self, "keyed", lambda t: True)(table)

    def page(self, frame: DataFrame, offset: int, limit: int | None) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of a sorted frame, where the numbers are beyond what Spark's own operators take.

        The sorted partitions are written with each row's place in its own; the
        rows before a partition are the sum of a count for each one before it.
        """
        place, kept = "_place", frame.columns
        frame = self.scratch(frame.withColumn(place, F.monotonically_increasing_id()))
        part = F.shiftright(place, 33)
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
        counts = frame.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
        nth = F.col(place).bitwiseAND((1 << 33) - 1) + F.col("before")
        inside = (nth >= whole(offset)) if limit is None else (nth >= whole(offset)) & (nth - whole(offset) < whole(limit))
        return frame.join(F.broadcast(counts), part == F.col("part")).where(inside).orderBy(place).select(*kept)

    def rows(self, block: Block, emitted: bool = False) -> DataFrame:
        """The result, columns by position o0, o1, ...; ordered where the order can be told."""
        frame = self.frame(block)
        if block.folded:
            return fold(frame, block.folds, block.group, self.max_groups, self.scratch)
        if block.order or block.limit is not None or block.offset or emitted:
            frame = frame.orderBy(*self.order(block, frame))
        if max(block.offset or 0, block.limit or 0) > INT:
            frame = self.page(frame, block.offset or 0, block.limit)
        else:
            frame = frame.offset(block.offset) if block.offset else frame
            frame = frame.limit(block.limit) if block.limit is not None else frame
        return frame.select(*(F.col(r.at).alias(f"o{i}") for i, (r, _) in enumerate(block.output)))
