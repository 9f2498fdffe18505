"""Exact top-k search by inner product: tiled matrix products and tree merging.

Candidates are packed into shards, queries into blocks, both by hash and of a
fixed number of vectors.  Each block meets each shard once, in a tile: a task
multiplies the two matrices, keeps each query's k best of the tile by partial
selection, and emits one short list a query.  Lists are then merged in a tree
of fixed fan-in, so no task ever holds more than FAN lists of k of a query.

Products are exact: integers in floating point while every sum stays below
2**53, Python's own integers otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, lean, table

#: Vectors in a shard of candidates and in a block of queries.
SHARD, BLOCK = 1024, 1024
#: Lists merged at a step of the tree.
FAN = 16
_PACKED = "dim int, pack int, ids binary, rows binary, vectors binary"


def _packed(rows: DataFrame, packs: int) -> DataFrame:
    """Rows dealt to packs by their own number, so one id in many rows fills many packs; within a pack in order of id."""

    def run(key, frame):
        frame = frame.sort_values(["id", "row"], kind="stable")
        vectors = np.stack(frame["v"].to_list()) if key[0] else np.empty((len(frame), 0))
        out = pd.DataFrame({"dim": [key[0]], "pack": [key[1]], "ids": [frame["id"].to_numpy("<i8").tobytes()], "rows": [frame["row"].to_numpy("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()]})
        give_back()
        return out

    return rows.withColumn("dim", F.size("v")).withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int")).groupBy("dim", "pack").applyInPandas(run, _PACKED)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of rows of integers held as doubles, exact; beyond 64 bits they stay at its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    as_int = lambda m: np.array([[int(x) for x in row] for row in m], object)
    got = as_int(q) @ as_int(c).T
    return np.clip(got, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """(scores, ids) of the k best but where ``own`` holds, ties to the smaller id; ``ids`` ascend."""
    keep = np.flatnonzero(~own)
    s = scores[keep]
    if len(s) > k:
        bound = np.partition(s, len(s) - k)[len(s) - k]
        sure, tied = np.flatnonzero(s > bound), np.flatnonzero(s == bound)
        pick = np.concatenate([sure, tied[: k - len(sure)]])
        keep, s = keep[pick], s[pick]
    order = np.lexsort((ids[keep], -s))
    return s[order].tolist(), ids[keep][order].tolist()


def search(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row where ``is_query`` holds.

    Components become floor(scale * x).  Rows with a null id, or a vector that is
    null or holds null, NaN or infinite components, take no part; vectors of
    different length are not compared.  Rows that share an id are rows of their
    own: each is a candidate for all others, those of its id included, and each
    query row gets a list.  An empty table gives no rows; queries without
    another row to find give none.  Ties go to the smaller id.  Other columns
    are not looked at, whatever their names.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite)
    # floor follows in the tiles: Spark's own floor would be cut to 64 bits
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    # written out, so that the numbers stay
    rows = rows.select(F.col(id).cast("long").alias("id"), scaled.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = table(rows, "topk-rows")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(counted["n"] / SHARD)), max(1, math.ceil(counted["q"] / BLOCK))
    shard = _packed(rows.select("id", "row", "v"), shards)
    block = _packed(rows.where("q").select("id", "row", "v"), blocks)
    block = block.select("dim", F.col("pack").alias("block"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("vectors").alias("query_vectors"))
    tiles = block.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(shard, ["dim", "pack"])

    @lean
    def run(frames):
        for frame in frames:
            for t in frame.itertuples(index=False):
                q, c = (np.floor(np.frombuffer(x, "<f8").reshape(-1, t.dim)) if t.dim else np.empty((len(x_rows) // 8, 0)) for x, x_rows in ((t.query_vectors, t.query_rows), (t.vectors, t.rows)))
                q_ids, q_rows, c_ids, c_rows = (np.frombuffer(x, "<i8") for x in (t.query_ids, t.query_rows, t.ids, t.rows))
                lists = [best(s, c_ids, c_rows == row, k) for s, row in zip(products(q, c), q_rows)]
                yield pd.DataFrame({"query": q_rows, "query_id": q_ids, "node": np.int32(t.pack), "top": [[{"neg": -a, "vec_id": b} for a, b in zip(*x)] for x in lists]})

    lists = tiles.select("dim", "pack", "query_ids", "query_rows", "query_vectors", "ids", "rows", "vectors").mapInPandas(run, "query long, query_id long, node int, top array<struct<neg: long, vec_id: long>>")
    nodes = shards
    while nodes > 1:  # FAN lists of k meet in a node
        lists = lists.groupBy("query", "query_id", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        nodes = math.ceil(nodes / FAN)
    out = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
