"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of the whole budget, in words.  Within a source a
document's expected copies e grow with its size, in strata of sizes of as many
binary digits: e = min(MOST, level * digits), where the level makes the
expected words the target.  floor(e) copies are certain and whole; the rest is
the document's own inclusion probability f for one copy more.  The documents
of a source are ranked by the Pareto variable

    q = (u / (1 - u)) / (f / (1 - f)),    u uniform from a hash of the document,

random odds over inclusion odds, and the lowest ranks are taken, up to the fixed size that is left: words, not
rows, since documents are of very unequal length.  The cut is made where the
running sum of sizes stays within the budget; then the one document beyond it
whose size comes nearest to what is still missing closes the gap.  Documents
are never cut, so a source misses its target by less than that one document.

No source is brought together to be ranked.  Ranks are counted in bins, then
the one bin a source's cut falls in is counted in finer bins, and only the rows
of that finer bin are sorted: about one in ``BINS`` squared of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
#: No document is taken more often than this.
MOST = 3


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the MD5 of the columns' text: the same in every run and engine (52 bits)."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("-")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def stratum_of(size: Column) -> Column:
    """Binary digits of a size, 1 for 0."""
    return F.length(F.bin(size)).cast("long")


def targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0) -> DataFrame:
    """(source, source_size, target): what each source is to give, from rows (source, size).

    Sources by code point, null last, weigh ``weights``, repeating.  Targets sum
    to ``share`` of all sizes; none is above MOST times its source's size: with
    t = min(MOST * size, level * weight), the level is found among the sources
    in order of size / weight, those before it being full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((at - 1) % len(weights) + 1).cast("int")))
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - full) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    over = F.col("level") * F.col("weight") > MOST * F.col("source_size")
    # the level that holds is that of the first source which isn't above its bound
    holds = F.min(F.when(~over, F.struct(F.col("source_size") / F.col("weight"), F.col("level"))))
    per = per.withColumn("level", F.coalesce(holds.over(everything)["level"], F.lit(float("inf"))))
    target = F.least(F.col("level") * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    per = per.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    return per.select("source", "source_size", "target")


def expected(strata: DataFrame, per: DataFrame) -> DataFrame:
    """(source, stratum, source_size, target, whole, part, room): copies of a stratum's documents, and words left to sample in a source.

    ``strata`` (source, stratum, words), ``per`` (source, source_size, target).
    The largest strata are full, at MOST copies, as long as the level found
    without them would be above that for the next one.
    """
    p = per.withColumnRenamed("source", "_source")
    rows = strata.join(p, strata["source"].eqNullSafe(p["_source"])).drop("_source")
    own = W.partitionBy("source")  # a row a binary digit
    fill = own.orderBy(F.desc("stratum"))
    full = F.coalesce(F.sum("words").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * MOST
    rest = F.sum(F.col("words") * F.col("stratum")).over(fill.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("target") - full) / F.nullif(rest, F.lit(0)))
    holds = F.col("level") * F.col("stratum") <= MOST
    level = F.max(F.when(holds, F.struct("stratum", "level"))).over(own)["level"]
    e = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("stratum") * F.coalesce(level, F.lit(float("inf"))))).otherwise(0.0)
    rows = rows.withColumn("e", e)
    room = F.col("target") - F.sum(F.floor("e") * F.col("words")).over(own)
    return rows.select("source", "stratum", "source_size", "target", F.floor("e").alias("whole"), (F.col("e") - F.floor("e")).alias("part"), room.alias("room"))


def _cut(rows: DataFrame, bin_of: Column, have: Column) -> DataFrame:
    """(source, bin, have, room): the bin in which a source's running sum passes its room, and the sum before that bin."""
    per = rows.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first(have).alias("start"))
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # BINS rows a source at most
    per = per.withColumn("have", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    return per.where("have <= room and have + words > room").groupBy("source").agg(F.min("bin").alias("bin"), F.min_by("have", "bin").alias("have"))


def mix(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, seed: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, source and the text).

    ``taken`` is the words that the mix takes of the row, copies counted: a
    multiple of its size, MOST times at most.  Null text: size 0, taken 0.  Null
    source: a source of its own, last.  Rows are told apart by (doc_id, source,
    size); repeated rows tie and are taken together.  A text of any length is
    one document, taken whole.  Other columns are not looked at, whatever their
    names.  An empty table gives no rows.  One row a source meets in one task,
    to find the targets.
    """
    base = docs.select("doc_id", "source", size_of(F.col(text)).alias("size"))
    base = table(base, "mix-sizes")
    base = base.withColumn("stratum", stratum_of(F.col("size")))
    strata = table(base.groupBy("source", "stratum").agg(F.sum("size").alias("words")), "mix-strata")
    per = table(expected(strata, targets(strata.withColumnRenamed("words", "size"), weights, share)), "mix-targets")
    # a row a source and stratum; Catalyst sees the files' size and broadcasts them if they are small
    p = per.withColumnsRenamed({"source": "_source", "stratum": "_stratum"})
    rows = base.join(p, base["source"].eqNullSafe(p["_source"]) & (base["stratum"] == p["_stratum"])).drop("_source", "_stratum")
    u = uniform(F.col("doc_id"), F.col("source"), seed=seed)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    # what has no remainder to sample ranks last
    rank = F.when(F.col("part") > 0, odds / (1 + odds)).otherwise(1.0)
    rows = rows.withColumn("rank", rank)
    n = F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1))
    finer = F.least(F.floor((F.col("rank") * BINS - n) * BINS), F.lit(BINS - 1))
    rows = rows.withColumn("b1", n).withColumn("b2", finer)
    live = rows.where("part > 0 and size > 0")

    first = table(_cut(live, F.col("b1"), F.lit(0.0)), "mix-bins")
    f = first.select(F.col("source").alias("_s"), F.col("bin").alias("c1"), F.col("have").alias("have1"))
    inside = live.join(f, live["source"].eqNullSafe(f["_s"]) & (live["b1"] == f["c1"])).drop("_s")
    second = table(_cut(inside, F.col("b2"), F.col("have1")), "mix-finer")
    s = second.select(F.col("source").alias("_s"), F.col("bin").alias("c2"), F.col("have").alias("have2"))
    edge = inside.join(s, inside["source"].eqNullSafe(s["_s"]) & (inside["b2"] == s["c2"])).drop("_s")
    run = W.partitionBy("source").orderBy("rank", "doc_id", "size")
    edge = edge.withColumn("sum", F.col("have2") + F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("sum") <= F.col("room")
    last = edge.groupBy("source").agg(
        F.max(F.when(fits, F.struct("rank", "doc_id", "size"))).alias("last"),
        F.coalesce(F.max(F.when(fits, F.col("sum"))), F.first("have2")).alias("got"),
    )
    last = last.join(f, last["source"].eqNullSafe(f["_s"]), "left").drop("_s").join(s, last["source"].eqNullSafe(s["_s"]), "left").drop("_s", "have1", "have2")
    last = table(last, "mix-cuts").withColumnRenamed("source", "_s")

    marked = rows.join(last, rows["source"].eqNullSafe(last["_s"]), "left").drop("_s")
    key = F.struct("rank", "doc_id", "size")
    upto = F.struct("last.rank", "last.doc_id", "last.size")
    within = F.when((F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")), F.coalesce(key <= upto, F.lit(False))).otherwise((F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))))
    # a source without a cut has all its remainder within the room
    within = (F.col("part") > 0) & (F.col("size") > 0) & F.coalesce(within, F.col("c1").isNull())
    marked = marked.withColumn("in", within)
    gap = F.col("room") - F.coalesce(F.col("got"), F.col("room"))
    miss = F.abs(gap - F.col("size"))
    open_ = (~F.col("in")) & (F.col("part") > 0) & (F.col("size") > 0) & (miss < gap)
    close = marked.where(open_).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))).alias("close"))
    close = table(close, "mix-closing").withColumnRenamed("source", "_s")
    marked = marked.join(close, marked["source"].eqNullSafe(close["_s"]), "left").drop("_s")
    closing = F.coalesce(F.struct("rank", "doc_id", "size") == F.struct("close.rank", "close.doc_id", "close.size"), F.lit(False))
    copies = F.least(F.col("whole") + (F.col("in") | closing).cast("long"), F.lit(MOST).cast("long"))
    return marked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
