"""Line dedup: cross-site boilerplate is found by how many sites a line is spread over.

Only DataFrame functions.  Lines are compared by a 128-bit hash of their text
without the white space at either end.  A line that occurs at least
``min_sites`` times is sketched: one HyperLogLog sketch of its sites per line,
merged by aggregation, so a line on a third of all pages costs a small buffer a
task.  Estimates clearly above the threshold decide, those clearly below
acquit, and only lines near it get an exact distinct count of their sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, fresh, scratch, table

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors of a sketch of 2**LG_K.
NEAR = 0.12


def lines_of(text: Column) -> Column:
    """The lines of a text, split at line feeds; a null text has none, an empty one a single empty line."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def spread(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first_doc): the lines of ``rows`` (h1, h2, site, doc_id) on at least ``min_sites`` sites."""
    seen = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_sites)
    seen = table(seen, "lines-frequent")
    frequent = rows.join(seen.select("h1", "h2"), ["h1", "h2"], "left_semi")
    sketched = frequent.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.xxhash64("site"), F.lit(LG_K)).alias("sketch"))
    sketched = table(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "lines-sketched")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    # small thresholds: a whole site to either side
    near = F.col("sites").between(min(low, min_sites - 1), max(high, min_sites + 1))
    close = sketched.where(near).select("h1", "h2")
    exact = frequent.join(close, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    chosen = sketched.where(~near & (F.col("sites") > min_sites)).select("h1", "h2").unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))
    return seen.select("h1", "h2", "first_doc").join(chosen, ["h1", "h2"], "left_semi")


def dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, source, text and any more) with boilerplate taken out of ``text``, and ``n_lines``, ``n_removed``.

    A line of visible text that occurs under at least ``min_sites`` distinct
    sources stays in the document with the smallest doc_id that has it, at its
    first place there, and goes from everywhere else.  Blank lines stay.  A null
    source counts as one site; a null doc_id comes after all others (where all are null, the line goes from all).
    Rows that repeat in doc_id and text are treated alike, each keeping what
    one would.  Null text: stays null, no lines.  Empty text: stays, one line.
    A text of any length is split whole, in time that grows with its lines.
    Columns named n_lines or n_removed are replaced, others pass through,
    whatever their names.  An empty table gives no rows.
    """
    text = F.col("text")
    site = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    key = F.xxhash64(text)
    line = trimmed(F.col("line"))
    rows = docs.select("doc_id", key.alias("k"), site.alias("site"), F.posexplode(lines_of(text)).alias("pos", "line"))
    rows = rows.where(line != "").select("doc_id", "k", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    with scratch(docs.sparkSession):
        rows = table(rows, "lines")
        found = table(spread(rows, min_sites), "lines-spread")
        # AQE broadcasts the lines found if they are small and splits a hot line's rows otherwise
        hits = rows.join(found, ["h1", "h2"])
        stays = F.coalesce(F.col("doc_id") == F.col("first_doc"), F.lit(False))
        hits = hits.groupBy("doc_id", "k", "h1", "h2", stays.alias("stays")).agg(F.min("pos").alias("first_pos"), F.collect_set("pos").alias("at"))
        gone = F.when(F.col("stays"), F.array_remove(F.col("at"), F.col("first_pos"))).otherwise(F.col("at"))
        hits = hits.groupBy("doc_id", "k").agg(F.flatten(F.collect_list(gone)).alias("gone"))
        hits = table(hits.where(F.size("gone") > 0), "lines-removed", keep=True)

    rest = docs.drop("n_lines", "n_removed")
    doc, k, gone, lines, new = fresh(rest, "_doc", "_k", "_gone", "_lines", "_text")
    n, places = hits.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    hits = hits.toDF(doc, k, gone)
    # a row takes about 96 bytes and 8 a line in memory; beyond the bound texts and lists are shuffled
    hits = F.broadcast(hits) if 96 * n + 8 * (places or 0) <= BROADCAST_BYTES else hits
    out = rest.join(hits, rest["doc_id"].eqNullSafe(hits[doc]) & (F.xxhash64(rest["text"]) == hits[k]), "left")
    # a column that is used more than once, so that it is split once
    out = out.withColumn(lines, lines_of(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.transform(left, lambda i: F.get(lines, i))
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = out.select(*rest.columns, F.size(lines).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"), cleaned.alias(new))
    return out.select(*(F.col(new).alias("text") if c == "text" else c for c in rest.columns), "n_lines", "n_removed")
