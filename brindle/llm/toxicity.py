"""Toxicity: a character n-gram linear classifier with naive Bayes scaling (NB-SVM style).

A document's features are the distinct character n-grams (n in ``NS``) of its
lower-cased whole text, hashed to ``DIM`` slots.  For every slot the log-count
ratio r = log((p + a)/|p|) - log((q + a)/|q|) compares in how many toxic and
clean training documents it occurs.  Slots are kept whose counts differ
significantly between the labels (G-test); a kept slot's feature is its
presence times r, and a logistic regression on those scaled features gives the
weights.  The cut that is best for F1 in cross-validation on the training rows
gets the score CUT, so that deciding there doesn't hang on how rare the label
is.  Scoring adds up the kept slots' weights, each once a document, however
long the text: the slots that say nothing are skipped before anything is made
distinct.

Per-slot document counts are summed by Spark from per-task vectors of fixed
size; the kept slots of at most ``max_rows`` documents come to the driver for
the regression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, pieces, split_mod

NS = (3, 4, 5, 6)
DIM = 1 << 20
#: Labelled documents that the model is fitted on, at most.
MAX_ROWS = 20_000
#: Slots looked at, at most: the most significant ones.  Those of a document come to the driver while fitting.
MAX_SLOTS = 4_000
#: Critical values of the G-test with one degree of freedom: at 1 % a slot is looked at, at 0.1 % it is kept.
LOOK, KEEP = 6.63, 10.83
#: What a document at the best cut scores.
CUT = 0.7
FOLDS = 4
SLICE = 1 << 19
_MULT = np.uint32(0x01000193)


def slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every n-gram of every text, and the number of its text; a text is framed by blanks, its white space made blanks."""
    parts = [f" {(x or '').lower()} " for x in texts]
    ends = np.cumsum([len(x) for x in parts])
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where((chars >= 9) & (chars <= 13), np.uint32(32), chars)
    owner = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    out, whose = [], []
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(NS) + 1):
        # h: hash of the n characters from each position
        h = h[: len(chars) - n + 1] * _MULT + chars[n - 1 :]
        if n in NS:
            inside = owner[: len(h)] == owner[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(n)
            out.append((mixed >> np.uint32(12))[inside])
            whose.append(owner[: len(h)][inside])
    return np.concatenate(out), np.concatenate(whose)


def present(texts: list[str | None], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) pairs, each once, in order; only slots where ``among`` is true, if given."""
    slot, owner = slots(texts)
    if among is not None:
        keep = among[slot]
        slot, owner = slot[keep], owner[keep]
    both = np.unique(owner.astype(np.int64) * DIM + slot)
    return both // DIM, both % DIM


def _groups(batch, text):
    texts = batch.column(text)
    for a, b in pieces([len(x.as_buffer()) if x.is_valid else 0 for x in texts], SLICE):
        yield a, b, texts[a:b].to_pylist()


def counts(rows: DataFrame) -> np.ndarray:
    """2 x DIM: in how many documents of each label (columns text, label) a slot occurs.

    A task adds up its own rows in a vector of fixed size and sends a row for
    each block of slots; Spark adds the blocks.
    """
    block = 1 << 12

    @lean
    def own(batches):
        total = np.zeros((2, DIM), np.int64)
        for batch in batches:
            for a, b, texts in _groups(batch, "text"):
                doc, slot = present(texts)
                y = batch.column("label")[a:b].to_numpy()[doc]
                total += np.bincount(y.astype(np.int64) * DIM + slot, minlength=2 * DIM).reshape(2, DIM)
        for label in (0, 1):
            for at in range(0, DIM, block):
                part = total[label, at : at + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([label * (DIM // block) + at // block], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["block", "n"])

    def add(key, frame):
        import pandas as pd

        total = np.zeros(block, np.int64)
        for x in frame["n"]:
            total += np.frombuffer(x, "<i8")
        return pd.DataFrame({"block": [key[0]], "n": [total.tobytes()]})

    out = np.zeros(2 * DIM, np.int64)
    found = rows.select("text", "label").mapInArrow(own, "block int, n binary").groupBy("block").applyInPandas(add, "block int, n binary")
    for row in found.toLocalIterator():  # 2 * DIM numbers in all, whatever the input
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["n"], "<i8")
    return out.reshape(2, DIM)


@dataclass
class Model:
    """weight: of every slot, naive Bayes ratio included; base: the intercept."""

    weight: np.ndarray
    base: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text."""
        z = np.full(len(texts), self.base)
        doc, slot = present(texts, self.weight != 0)
        z += np.bincount(doc, self.weight[slot], len(texts))
        return 1 / (1 + np.exp(-z))


def regress(doc: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float = 3.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by accelerated gradient descent; labels are weighted so that both count equally."""
    n = len(y)
    weight = np.where(y == 1, n / 2 / max(1, y.sum()), n / 2 / max(1, n - y.sum()))
    w, b = np.zeros(width), 0.0
    vw, vb, t = w.copy(), b, 1.0
    u = np.ones(width)
    for _ in range(20):  # the largest eigenvalue of the loss's bound, for the step
        u /= np.linalg.norm(u) or 1.0
        u = np.bincount(col, value * (weight * (np.bincount(doc, value * u[col], n) + 1))[doc], width)
    rate = 1 / (0.3 * (np.linalg.norm(u) + weight.sum()) / n + l2 / n)
    for _ in range(steps):
        z = np.bincount(doc, value * vw[col], n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        nw, nb = vw - rate * (np.bincount(col, value * g[doc], width) + l2 / n * vw), vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def significance(n: np.ndarray, docs: tuple[int, int]) -> np.ndarray:
    """G of every slot: how far the documents of either label (2 x slots) that have it are from independence of the label."""
    part = lambda seen, awaited: seen * np.log(np.maximum(seen, 1e-300) / np.maximum(awaited, 1e-300))
    have, all_ = n.sum(0), sum(docs)
    return 2 * sum(part(n[y], have * docs[y] / all_) + part(docs[y] - n[y], (all_ - have) * docs[y] / all_) for y in (0, 1))


def ratios(n: np.ndarray, docs: tuple[int, int], alpha: float = 1.0) -> np.ndarray:
    """Log-count ratios of slots, smoothed."""
    q, p = n
    return np.log((p + alpha) / (docs[1] + 2 * alpha)) - np.log((q + alpha) / (docs[0] + 2 * alpha))


def fit(doc: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights by column, intercept) from the columns that each document has; not significant ones get 0."""
    sizes = (int((y == 0).sum()), int((y == 1).sum()))
    n = np.bincount(y[doc].astype(int) * width + col, minlength=2 * width).reshape(2, width)
    ratio = np.where(significance(n, sizes) >= KEEP, ratios(n, sizes), 0.0)
    some = ratio[col] != 0
    w, base = regress(doc[some], col[some], ratio[col[some]], y, width, steps=steps)
    return w * ratio, base


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The z between two documents' from which on label 1 is best said, by F1; of cuts that are as good within 2 % the lowest, which misses least."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    # only where z changes can a cut be
    s = z[order]
    can = np.append(s[1:] < s[:-1], True)
    f1 = np.where(can, f1, -1)
    at = int(np.flatnonzero(f1 >= 0.98 * f1.max())[-1])
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at]) - 1.0


def cross_cut(doc: np.ndarray, col: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int) -> float:
    """The best cut for documents scored by models that haven't seen them; 0 where labels are too few for that."""
    z = np.zeros(len(y))
    for f in range(FOLDS):
        own, rest = fold == f, fold != f
        if not own.any() or min(y[rest].sum(), (1 - y[rest]).sum()) < 5:
            return 0.0
        some = rest[doc]
        renumber = np.cumsum(rest) - 1
        w, base = fit(renumber[doc[some]], col[some], y[rest], width, steps=120)
        z += np.where(own, np.bincount(doc, w[col], len(y)) + base, 0)
    return best_cut(z, y)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents, those outside the held-out third, and ``max_slots`` slots.

    If more are labelled, the share taken is those whose hashed id is small, so
    reruns agree.  Rows with a null id, text or label take no part; repeated
    labels or documents count as often as they meet.  With one label only, the
    model says its smoothed share everywhere.  More slots than the default fit
    chance: on 2,600 rows, 20,000 find fewer held-out documents than 4,000.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (split_mod(F.col("doc_id")) != 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_rows / n))
    # max_rows pairs of numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")
    by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    sizes = (by.get(0, 0), by.get(1, 0))
    share = (sizes[1] + 0.5) / (sum(sizes) + 1)
    flat = Model(np.zeros(DIM), float(np.log(share / (1 - share))))
    if not all(sizes):
        return flat
    g = significance(counts(rows), sizes)
    keep = np.sort(np.argsort(-g, kind="stable")[:max_slots])
    keep = keep[g[keep] >= LOOK]
    if not len(keep):
        return flat
    among = np.zeros(DIM, bool)
    among[keep] = True

    @lean
    def sparse(batches):
        for batch in batches:
            for a, b, texts in _groups(batch, "text"):
                doc, slot = present(texts, among)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32)))], ["doc_id", "label", "slots"])

    got = rows.mapInArrow(sparse, T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType()))])).toPandas()
    got = got.assign(n=got["slots"].map(len)).sort_values(["doc_id", "label", "n"], kind="stable")
    doc = np.repeat(np.arange(len(got)), got["slots"].map(len))
    col = np.searchsorted(keep, np.concatenate(got["slots"].to_list()).astype(np.int64))
    y = got["label"].to_numpy(float)
    w, base = fit(doc, col, y, len(keep))
    fold = got["doc_id"].map(lambda i: zlib.crc32(f"fold {i}".encode()) % FOLDS).to_numpy()
    weight = np.zeros(DIM)
    weight[keep] = w
    return Model(weight, base - cross_cut(doc, col, y, fold, len(keep)) + float(np.log(CUT / (1 - CUT))))


def score(docs: DataFrame, model: Model, *carry: str, text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``carry`` of ``docs`` and a double named ``out``, for every row; a null text is scored as an empty one.

    Every row by itself: equal texts score alike, repeated rows repeat, an empty
    table stays empty.  A text of any length is looked at whole.  Of the other
    columns only ``carry`` pass; one of them named like ``out`` needs another ``out``.
    """
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.DoubleType())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((np.flatnonzero(model.weight).astype(np.int32), model.weight[model.weight != 0], model.base))

    @lean
    def run(batches):
        at, value, base = shared.value
        own = Model(np.zeros(DIM), base)
        own.weight[at] = value
        for batch in batches:
            for a, b, texts in _groups(batch, text):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(own.score(texts))], [*carry, out])

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)
