"""Aggregates with exact arithmetic: checked sums, and averages rounded half to even at the column's scale."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ResourceExhausted
from ..functions.types import Kind
from ..plans.chain import Fold, Ref

_INT64 = T.DecimalType(38, 0)


def unscaled(c: Column, kind: Kind) -> Column:
    """A narrow decimal as its whole number of smallest units."""
    return (c * F.lit(Decimal(10) ** kind.scale)).cast("bigint")


def scaled(units: Column, kind: Kind) -> Column:
    return (units.cast(_INT64) * F.lit(Decimal(1).scaleb(-kind.scale))).cast(T.DecimalType(max(18, kind.precision), kind.scale))


def half_even(units: Column, n: Column) -> Column:
    """units / n in whole units, ties to the even one; both bigint."""
    # div and % both cut toward zero
    q, r = F.call_function("div", units, n), F.abs(units % n)
    up = (2 * r > n) | ((2 * r == n) & (q % 2 != 0))
    return q + F.when(up, F.when(units < 0, F.lit(-1)).otherwise(F.lit(1))).otherwise(F.lit(0)).cast("bigint")


@F.pandas_udf(T.StringType())
def _wide_average(total: pd.Series, n: pd.Series, scale: pd.Series) -> pd.Series:
    """One row a group: exact averages of wide decimals, whose quotients Spark's own division would round; as text, which takes any scale."""

    def one(t, c, s):
        if t is None or not c:
            return None
        with localcontext() as own:
            own.prec = 80
            return f"{(Decimal(t) / int(c)).quantize(Decimal(1).scaleb(-int(s)), ROUND_HALF_EVEN):f}"

    return pd.Series([one(*x) for x in zip(total, n, scale)], dtype=object)


def column_of(f: Fold, prefix: str) -> tuple[list[Column], Column]:
    """(aggregates to compute, expression over them) of one fold item."""
    if f.func is None:
        return [], F.col(f.ref.at)
    if f.ref is None:
        return [F.count(F.lit(1)).alias(prefix)], F.col(prefix)
    c, k = F.col(f.ref.at), f.ref.kind
    if f.func == "count":
        return [(F.count_distinct(c) if f.distinct else F.count(c)).alias(prefix)], F.col(prefix)
    if f.func in ("min", "max"):
        return [getattr(F, f.func)(c).alias(prefix)], F.col(prefix)
    total = F.sum_distinct if f.distinct else F.sum
    if f.func == "sum":
        if k.is_int:
            return [total(c.cast("bigint")).alias(prefix)], F.col(prefix)
        if k.wide:
            return [total(c).cast(T.DecimalType(38, k.scale)).alias(prefix)], F.col(prefix)
        return [total(unscaled(c, k)).alias(prefix)], scaled(F.col(prefix), k)
    n = (F.count_distinct(c) if f.distinct else F.count(c)).alias(prefix + "n")
    if k.wide:
        value = _wide_average(F.col(prefix).cast("string"), F.col(prefix + "n"), F.lit(k.scale))
        return [total(c).alias(prefix), n], value.cast(T.DecimalType(k.precision, k.scale))
    value = F.when(F.col(prefix + "n") > 0, half_even(F.col(prefix), F.col(prefix + "n")))
    return [total(unscaled(c, k)).alias(prefix), n], scaled(value, k).cast(T.DecimalType(k.precision, k.scale))


def fold(frame: DataFrame, folds: list[Fold], group: list[Ref], max_groups: int | None = None, keep=None) -> DataFrame:
    """The folded frame, columns o0, o1, ...; without a group one row, even over no rows.

    With ``max_groups`` the groups are written by ``keep`` and counted: more are refused, never cut.
    """
    aggregates, out = [], []
    for i, f in enumerate(folds):
        needed, value = column_of(f, f"a{i}")
        aggregates += needed
        out.append(value.alias(f"o{i}"))
    if not group:
        return frame.agg(*aggregates).select(*out)
    keys = [F.col(r.at) for r in group]
    folded = frame.groupBy(*keys).agg(*aggregates) if aggregates else frame.select(*keys).distinct()
    if max_groups is not None:
        folded = keep(folded)
        if folded.count() > max_groups:
            raise ResourceExhausted(f"more than {max_groups} groups")
    return folded.select(*out)
