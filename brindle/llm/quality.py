"""Quality classifier: a generalised additive model with pairwise interactions.

Every document becomes a row of a few numbers (``FEATURES``), each cut into
bins at quantiles of the training rows.  Boosting visits the features in turn,
round after round; each visit fits a tree of a few leaves to the gradient over
that feature's bins alone and adds a small step of it to the feature's lookup
table.  Then the pairs whose joint residual is largest get a table each,
fitted the same way, by trees that split both features.  A score is the sum of
one entry a table, passed through the logistic function: a few vectorised
additions a document, and the tables say what each feature did.

Features are computed in the executors from whole texts.  Only they, of at
most ``max_rows`` labelled rows, come to the driver, where the model is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, pieces, split_mod

FEATURES = [
    "log_words", "mean_word", "sd_word", "long_word", "upper", "punct", "digit", "symbol", "nonascii", "space",
    "distinct_words", "top_word", "same_as_last", "distinct_lines", "mean_line", "sentence_end", "word_symbol", "entropy",
]
BINS = 32
#: Labelled rows that the model is fitted on, at most: the features of so many fit in 10 MB.
MAX_ROWS = 20_000
SLICE = 1 << 20

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence punctuation, 6 symbol, 7 part of a non-ASCII character
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[*b"0123456789"]] = 3
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 4
_CLASS[[*b".,;:!?'\"()-"]] = 5
_CLASS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7


def describe(text: str | None) -> list[float]:
    """The FEATURES of one whole text; null is as empty."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    b = np.frombuffer(data, np.uint8)
    counts = np.bincount(b, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8) / len(b)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = b"".join([w[-1:] for w in words])
    end_kinds = np.bincount(_CLASS[np.frombuffer(ends, np.uint8)], minlength=8) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    p = counts[counts > 0] / len(b)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), (lengths > 20).mean(), kinds[2], kinds[5], kinds[3], kinds[6], kinds[7], kinds[4],
        len(tally) / n, max(tally.values()) / n, same, len(set(lines)) / len(lines), np.log1p(n / len(lines)), end_kinds[5], end_kinds[6], -(p * np.log2(p)).sum(),
    ]


def _described(docs: DataFrame, carry: tuple[str, ...], text: str, field: T.StructField, make) -> DataFrame:
    """``carry`` of ``docs`` and a column that ``make`` gets from the rows of features of their texts."""
    schema = T.StructType([*(docs.schema[c] for c in carry), field])

    @lean
    def run(batches):
        for batch in batches:
            texts = batch.column(text)
            for a, b in pieces([len(x.as_buffer()) if x.is_valid else 0 for x in texts], SLICE):
                x = np.array([describe(x) for x in texts[a:b].to_pylist()], float).reshape(-1, len(FEATURES))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), make(x)], schema.names)

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def feature_table(docs: DataFrame, *carry: str, text: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``features`` array<double>, in the order of FEATURES."""

    def lists(x):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))

    return _described(docs, carry, text, T.StructField("features", T.ArrayType(T.DoubleType())), lists)


@dataclass
class Model:
    """cuts: inner bin edges a feature; single: a table a feature; pairs: {(i, j): table of BINS x BINS}."""

    base: float = 0.0
    cuts: list = field(default_factory=list)
    single: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for i, t in enumerate(self.single):
            z += t[b[:, i]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton values per bin of the best tree over ordered bins with so many leaves: the best split of any leaf, repeatedly."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
            gain[(ch[m] - ch[a] < least) | (ch[b] - ch[m] < least)] = 0
            if gain[at := int(gain.argmax())] > best[0]:
                best = (gain[at], k, m[at])
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best tree that splits one feature once and each half once on the other: its gain and its values per cell."""
    best, table = 0.0, np.zeros_like(g)
    for flip in (False, True):
        G, H = (g.T, h.T) if flip else (g, h)
        cg, ch = np.zeros((len(G) + 1, G.shape[1] + 1)), np.zeros((len(G) + 1, G.shape[1] + 1))
        cg[1:, 1:], ch[1:, 1:] = G.cumsum(0).cumsum(1), H.cumsum(0).cumsum(1)
        half = []
        for cgs, chs in ((cg, ch), (cg[-1] - cg, ch[-1] - ch)):
            left = np.where(chs >= least, cgs**2 / (chs + 1), 0)
            rg, rh = cgs[:, -1:] - cgs, chs[:, -1:] - chs
            gain = left + np.where(rh >= least, rg**2 / (rh + 1), 0)
            gain[(chs < least) | (rh < least)] = 0
            at = gain.argmax(1)
            half.append((gain[np.arange(len(gain)), at], at))
        total = half[0][0] + half[1][0]
        r = int(total.argmax())
        if total[r] > best:
            best, table = float(total[r]), np.zeros_like(G)
            for (lo, hi), c in (((0, r), half[0][1][r]), ((r, len(G)), half[1][1][r])):
                for a, b in ((0, c), (c, G.shape[1])):
                    table[lo:hi, a:b] = G[lo:hi, a:b].sum() / (H[lo:hi, a:b].sum() + 1)
            table = table.T if flip else table
    return best, table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, leaves: int = 4, pairs: int = 8, pair_rounds: int = 40, least: float = 3.0) -> Model:
    """Fit the tables to features ``x`` and labels ``y`` (0 or 1).

    Without rows, or with one label only, the model says that label's smoothed share everywhere.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return m
    m.cuts = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) for i in range(x.shape[1])]
    m.single = [np.zeros(BINS) for _ in m.cuts]
    b = m.bins(x)
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        for i in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[:, i], y - p, BINS), np.bincount(b[:, i], p * (1 - p), BINS), leaves, least)
            m.single[i] += step
            z += step[b[:, i]]
    p = 1 / (1 + np.exp(-z))
    cells = lambda i, j, v: np.bincount(b[:, i] * BINS + b[:, j], v, BINS * BINS).reshape(BINS, BINS)
    gains = {(i, j): _pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)), least)[0] for i in range(x.shape[1]) for j in range(i)}
    for i, j in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]:
        m.pairs[i, j] = np.zeros((BINS, BINS))
    for _ in range(pair_rounds):
        for (i, j), t in m.pairs.items():
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)), least)[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents, those outside the held-out third.

    If more are labelled, the share taken is those whose hashed id is small, so
    reruns agree.  Rows with a null id, text or label take no part; repeated
    labels or documents count as often as they meet.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (split_mod(F.col("doc_id")) != 1)).select("doc_id", F.col(label).cast("double").alias("_label"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_rows / n))
    # max_rows pairs of numbers: a bounded broadcast
    rows = feature_table(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id"), "doc_id", "_label").orderBy("doc_id", "features").select("_label", "features").toPandas()
    return fit(np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES)), rows["_label"].to_numpy(float))


def score(docs: DataFrame, model: Model, *carry: str, text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``carry`` of ``docs`` and a double named ``out``, for every row; null and empty texts are scored by their features, all 0.

    Every row by itself: equal texts score alike, repeated rows repeat, an empty
    table stays empty.  A text of any length is looked at whole.  Of the other
    columns only ``carry`` pass; one of them named like ``out`` needs another ``out``.
    """
    return _described(docs, carry, text, T.StructField(out, T.DoubleType()), lambda x: pa.array(model.score(x)))
