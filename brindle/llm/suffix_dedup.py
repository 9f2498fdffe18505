"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, by distributed prefix doubling.

Two positions tie at a length if they tie at a shorter one and so do the
positions as far on as that length, or less: ranks of long strings are pairs of
ranks of shorter ones.  Doubling over every byte would sort the corpus several
times over, so ranks are kept for *anchors*: a start's anchor is the position
with the least hash of its next GRAM bytes among the WINDOW positions from it.
It depends on the start's own string alone, so equal strings have anchors at
equal distance, and about 1 position in WINDOW / 2 is one.

1. An anchor's first rank is the name of the ``length`` - WINDOW bytes from it,
   all of which lie in the string of every start that has this anchor.  Anchors
   whose rank is unique fall away, and their starts with them.
2. Rounds at growing offsets.  A row (position, rank) is paired with the rank of
   a position as far on as its own string reaches, or as is needed; the pair and
   its offset are the new rank, of a string about twice as long.  Rows whose new
   rank is unique fall away.  A row stops past the threshold: when its string
   holds every string of a group of starts with one anchor.  What still ties
   then is repeated, with all the starts in it.
3. Groups that fell away in 2 hold the ends of repeated passages.  Their starts
   are ranked singly, among the groups whose anchors tie in 1 (of settled ones
   that are alike, one stands for all): a start's rank is the name of its whole
   string, from names at offsets of GRAM.

Names are 64-bit and made by doubling, too.  Only steps 1 and 3 read texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_tables, eights, give_back, joined, lean, pieces, scratch, sized, stir, table

LENGTH = 400
GRAM, WINDOW = 64, 160
#: Rounds after which every string is past the threshold, for any length of LENGTH at least.
ROUNDS = 3
#: Bytes a worker looks at together.
SLICE = 1 << 19
#: Longer texts are searched in parts of this size, with what lies around them.
PART = 1 << 19
#: Starts that a task ranks singly, about.
STARTS = 1 << 19
#: A class of up to so many members is ranked together in one task (5 MB of context at most), a larger one as rows, by aggregation.
HOT = 8192
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def grams(data: bytes) -> np.ndarray:
    """The name of the GRAM bytes from every position, by doubling from 8 bytes on (fewer near the end)."""
    h = stir(eights(data).copy())
    step = 8
    while step < GRAM:
        h = joined(h[:-step], h[step:])
        step *= 2
    return h


def names(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the strings of n >= GRAM bytes at the positions ``at``, from those of GRAM bytes."""
    out = h[at]
    for off in [*range(GRAM, n - GRAM, GRAM), n - GRAM] if n > GRAM else ():
        out = joined(out, h[at + off])
    return out


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, pos, rank, hops, group) of the positions with a rank in texts laid end to end; group is -1 for none.

    Positions: the anchors, and a text's first position and the last that has a
    rank, all counted from the text's begin.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    reach = length - WINDOW
    begins = np.concatenate([[0], ends[:-1]])
    starts = len(data) - length + 1
    if starts <= 0:
        return none
    h = grams(data)
    n = len(h)
    key = (h & ~_LOW) | np.arange(n, dtype=_U)
    blocks = np.concatenate([key, np.full(-n % WINDOW, ~_U(0))]).reshape(-1, WINDOW)
    del key
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    of = (np.minimum(behind[:starts], ahead[WINDOW - 1 : WINDOW - 1 + starts]) & _LOW).astype(np.int32)
    del blocks, ahead, behind
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)[:starts]
    p = np.flatnonzero(np.arange(starts) + length <= ends[doc])
    if not len(p):
        return none
    of, doc = of[p], doc[p]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])]))
    first, last, a = p[new], p[np.concatenate([new[1:], [len(p)]]) - 1], of[new].astype(np.int64)
    long = np.flatnonzero(ends - begins >= length)
    pos = np.unique(np.concatenate([a, begins[long], ends[long] - reach]))
    # from which position a group is settled, and how far that must reach
    pred = np.searchsorted(pos, first, "right") - 1
    need = np.zeros(len(pos), np.int64)
    np.maximum.at(need, pred, last + length)
    need = np.maximum.accumulate(need)
    cover, hops = pos + reach, []
    for _ in range(ROUNDS):
        on = np.minimum(np.searchsorted(cover, need), np.searchsorted(pos, cover, "right") - 1)
        go = cover < need
        hops.append(np.where(go, pos[on] - pos, 0))
        cover = np.where(go, cover[on], cover)
    group = np.full(len(pos), -1)
    group[np.searchsorted(pos, a)] = _packed(a - pos[pred], a - first, a - last)
    doc = np.searchsorted(ends, pos, "right")
    return doc, pos - begins[doc], names(h, pos, reach).view(np.int64), _packed(*hops), group


#: Bits of an offset in a packed column.
BITS = 20
_MASK = (1 << BITS) - 1
_KINDS = "k long, pos long, rank long, hops long, group long"


def _packed(*offsets: np.ndarray) -> np.ndarray:
    return sum(x << (BITS * i) for i, x in enumerate(offsets))


def _offset(column: str, i: int):
    return F.shiftrightunsigned(column, BITS * i).bitwiseAND(_MASK)


def survey(keyed: DataFrame, length: int) -> DataFrame:
    """The positions with a rank of every text of ``keyed`` (k, text), each once.

    hops: the offset to pair with in each round, 0 for none; group: how far
    before the position its settling position, first and last start are (null
    where it is no start's anchor).
    """

    def batch_of(ks, found):
        doc, pos, rank, hops, group = found
        return pa.RecordBatch.from_arrays([ks.take(pa.array(doc)), pa.array(pos), pa.array(rank), pa.array(hops), pa.array(group, mask=group < 0)], ["k", "pos", "rank", "hops", "group"])

    @lean
    def run(batches):
        for batch in batches:
            texts, ks = batch.column("text"), batch.column("k")
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
            for i, j in pieces(sizes, SLICE):
                if j - i > 1 or sizes[i] <= 2 * PART:
                    data = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[i:j])
                    yield batch_of(ks[i:j], anchors(data, np.cumsum(sizes[i:j]), length))
                    continue
                whole = texts[i].as_buffer()
                for at in range(0, sizes[i], PART):  # a long text is a piece of its own
                    low = max(0, at - 4 * WINDOW)
                    part = whole.slice(low, min(sizes[i], at + PART + 3 * length + 4 * WINDOW) - low).to_pybytes()
                    doc, pos, *rest = anchors(part, np.array([len(part)]), length)
                    own = np.flatnonzero((pos + low >= at) & (pos + low < at + PART))
                    yield batch_of(ks[i:j], (doc[own], pos[own] + low, *(x[own] for x in rest)))

    return keyed.mapInArrow(run, _KINDS)


def _tied(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a scratch table whose rank isn't theirs alone."""
    ties = table(rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"), name)
    return rows.join(ties, "rank", "left_semi")


def doubled(rows: DataFrame) -> DataFrame:
    """(k, pos, rank): the rows (k, pos, rank, hops) that still tie past the threshold."""
    spark = rows.sparkSession
    rows = rows.select("k", "pos", "rank", "hops")
    for n in range(ROUNDS):
        hop = F.col("hops").bitwiseAND(_MASK)
        far = rows.select(F.col("k").alias("_k"), F.col("pos").alias("_pos"), F.col("rank").alias("_rank"))
        near = rows.where(hop > 0).withColumn("to", F.col("pos") + hop)
        # a partner that fell away is unique, and so is a string that holds its string
        pairs = near.join(far, (F.col("k") == F.col("_k")) & (F.col("to") == F.col("_pos")))
        pairs = table(pairs.select("k", "pos", F.xxhash64("rank", hop, "_rank").alias("rank"), F.shiftrightunsigned("hops", BITS).alias("hops")), "suffix-pairs")
        # who is done has no hops left
        after = table(rows.where(hop == 0).unionByName(_tied(pairs, "suffix-ties").select(*rows.columns)), "suffix-round")
        drop_tables(spark, pairs, *([rows] if n else []))
        rows = after
    return rows.select("k", "pos", "rank")


def _open_starts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(k, cls, first, off, n, bytes) of each group in ``wanted`` (k, list): its first start, the anchor's distance, the starts, and the bytes of their strings."""
    rows = keyed.join(wanted, "k").select("k", "text", "list")

    @lean
    def contexts(batches):
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("list")
            for i, j in pieces(pa.compute.list_value_length(lists).to_pylist(), 1024):
                out: list[list] = [[] for _ in range(6)]
                for r in range(i, j):
                    b = texts[r].as_buffer()
                    for x in lists[r].as_py():
                        first, last = (x["pos"] - (x["group"] >> (BITS * i) & _MASK) for i in (1, 2))
                        for column, value in zip(out, (r, x["cls"], first, x["pos"] - first, last - first + 1, b.slice(first, last + length - first).to_pybytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(out[5], pa.binary())], ["k", "cls", "first", "off", "n", "bytes"])

    return rows.mapInArrow(contexts, "k long, cls long, first long, off long, n long, bytes binary")


def ranks(frame: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, rank) of every start of the contexts in ``frame``: equal ranks for equal strings at equal distance from tied anchors."""
    sizes, n = frame["bytes"].map(len).to_numpy(), frame["n"].to_numpy()
    row = np.repeat(np.arange(len(frame), dtype=np.int32), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rank = np.empty(len(row), _U)
    cut = np.concatenate([[0], np.cumsum(n)])
    data = frame["bytes"].to_list()
    for i, j in pieces(sizes.tolist(), SLICE // 2):  # a few contexts at a time, to hold little
        part, begin = slice(cut[i], cut[j]), np.cumsum(sizes[i:j]) - sizes[i:j]
        own = row[part] - i
        away = frame["off"].to_numpy()[i:j][own] - step[part]
        rank[part] = joined(names(grams(b"".join(data[i:j])), begin[own] + step[part], length), joined(frame["cls"].to_numpy()[i:j].view(_U)[own], away.astype(_U)))
    return row, frame["first"].to_numpy()[row] + step, rank


def repeated(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, start, stop): byte ranges that strings which also start elsewhere cover, for rows (k, text).

    No two rows agree in k; ranges may overlap.  ``length``: LENGTH at least.
    """
    if length < LENGTH:
        raise ValueError(f"strings of at least {LENGTH} bytes can be searched for")
    keyed = keyed.select("k", "text")
    spark = keyed.sparkSession
    found = table(survey(keyed, length), "suffix-positions")
    some = table(_tied(found, "suffix-first").select("k", "pos", "rank", "hops", "group"), "suffix-open")
    drop_tables(spark, found)
    settled = doubled(some)
    # the groups of starts, with the rank at which they are settled or none
    by = settled.select(F.col("k").alias("_k"), F.col("pos").alias("_pos"), F.col("rank").alias("run"))
    groups = some.where("group is not null").select("k", "pos", F.col("rank").alias("cls"), "group", (F.col("pos") - _offset("group", 0)).alias("from"))
    known = table(groups.join(by, (F.col("k") == F.col("_k")) & (F.col("from") == F.col("_pos")), "left").select("k", "pos", "cls", "group", "run"), "suffix-groups")
    drop_tables(spark, some, settled)
    covered = known.where("run is not null").select("k", (F.col("pos") - _offset("group", 1)).alias("start"), (F.col("pos") - _offset("group", 2) + length).alias("stop"))
    # classes with an open group, each start by itself; of groups that are settled alike one will do
    opened = known.where("run is null").select("cls", "k", "pos", "group")
    left = table(opened.select("cls").distinct(), "suffix-classes")
    alike = known.where("run is not null").join(left, "cls", "left_semi").groupBy("cls", "run", "group").agg(F.min(F.struct("k", "pos")).alias("one"))
    rest = table(opened.unionByName(alike.select("cls", "one.k", "one.pos", "group")), "suffix-rest")
    members = table(rest.groupBy("cls").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "suffix-members")
    rest = rest.join(members, "cls")
    listed = lambda rows: table(rows.groupBy("k").agg(F.collect_list(F.struct("pos", "group", "cls")).alias("list")), "suffix-lists")
    few, many = listed(rest.where(F.col("members") <= HOT)), listed(rest.where(F.col("members") > HOT))
    n_few = few.agg(F.sum(F.size("list"))).first()[0] or 0
    tasks = max(1, math.ceil(n_few * WINDOW / 2 / STARTS))

    def meet(key, frame):
        row, start, rank = ranks(frame, length)
        k = frame["k"].to_numpy()
        del frame
        order = np.argsort(rank, kind="stable")
        same = rank[order][1:] == rank[order][:-1]
        tied = np.zeros(len(rank), bool)
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        del order, same, rank
        hit = np.flatnonzero(tied)
        row, start = row[hit], start[hit]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(hit) else np.empty(0, int)
        end = start[np.concatenate([new[1:], [len(hit)]]) - 1] if len(hit) else start
        own = pd.DataFrame({"k": k[row[new]], "start": start[new], "stop": end + length}, dtype="int64")
        give_back()
        return own

    spans = "k long, start long, stop long"
    # lists grow with the texts, too: joined alike at every size
    by_task = _open_starts(keyed, few, length).withColumn("task", F.pmod(F.xxhash64("cls"), F.lit(tasks)))
    exact = by_task.groupBy("task").applyInPandas(meet, spans)

    def listing(frames):
        for frame in frames:
            for i, j in pieces(frame["n"].to_list(), STARTS // 4):
                part = frame.iloc[i:j]
                row, start, rank = ranks(part, length)
                yield pd.DataFrame({"k": part["k"].to_numpy()[row], "start": start, "rank": rank.view(np.int64)}, dtype="int64")

    single = table(_open_starts(keyed, many, length).mapInPandas(lean(listing), "k long, start long, rank long"), "suffix-starts")
    hot = _tied(single, "suffix-common").select("k", "start", (F.col("start") + length).alias("stop"))
    return covered.unionByName(exact).unionByName(hot)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs`` (doc_id, text).

    ``spans``: the maximal runs of bytes covered by a string of ``length`` bytes
    that also starts anywhere else, in this or another row, as array<struct<start,
    stop>>; ``kept``: the other bytes, which may break a character.  Strings are
    judged on the input, never across rows.  Null text: as empty, with no spans.
    Rows that repeat are rows of their own: each repeats the other, so all of a
    text of at least ``length`` bytes goes.  A text of any length is searched in
    parts.  Other columns are not looked at; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # tells rows apart, but for equal ones
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("k"), text.alias("text"))
    with scratch(keyed.sparkSession):
        again = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text").cast("long")).alias("stop")).where("n > 1")
        again, once = table(again.select("k", "stop"), "suffix-again"), keyed
        if again.head(1):
            marks = sized(again.drop("stop"), 32)
            once = keyed.join(marks, "k", "left_anti").unionByName(keyed.join(marks, "k", "left_semi").select(keyed.columns).dropDuplicates(["k"]))
        found = repeated(once, length).unionByName(again.where(F.col("stop") >= length).select("k", F.lit(0).cast("long").alias("start"), "stop"))
        spans = table(found.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans", keep=True)
    # spans grow with the texts: no hint, so the plan is the same at any size that matters
    paired = keyed.join(spans, "k", "left").select("doc_id", "text", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    @lean
    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("spans")
            for i, j in pieces([len(x.as_buffer()) for x in texts], SLICE):
                sizes, merged, kept = [], [], []
                for r in range(i, j):
                    b, runs = texts[r].as_buffer().to_pybytes(), []
                    for x in sorted((x["start"], x["stop"]) for x in lists[r].as_py() or ()):
                        if runs and x[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x[1])
                        else:
                            runs.append([*x])
                    edges = [0, *(y for x in runs for y in x), len(b)]
                    sizes.append(len(b))
                    merged.append([{"start": x, "stop": y} for x, y in runs])
                    kept.append(b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return paired.mapInArrow(run, schema)
