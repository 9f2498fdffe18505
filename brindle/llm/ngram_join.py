"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word shingles as 63-bit hashes with one bit
above them for *common* shingles, so that the numbers' order is one global
order of all shingles: rare ones by hash, then common ones.  What counts as
common only moves work about; any set of shingles gives right results.

1. Documents with equal sets form a class; classes stand for them from here on.
2. Two sets of a Jaccard similarity of t share one of the first
   n - ceil(t n) + 1 elements of each.  Those prefixes are dealt out by hash
   range, and shingles that only one class has there fall away.  What remains
   are groups of classes, equal groups taken once.
3. A group's pairs are candidates if their sizes allow a link, and their parity
   bitmaps too: the bits in which two sets' parities differ are at most as many
   as the elements in which the sets do, so a pair beyond the bound is none.
   They are dealt out in shards and joined by prefix trees: the sets on one
   side of a shard's candidates are stored in tries, and all sets of the other
   side go down a trie together.  What they share with a node's path is counted
   once for all sets below it, and a set leaves a subtree as soon as its overlap
   so far and the elements that remain can't reach the bound of any set there.
   First some classes of a group are anchors of the others: its hub, and those
   that come first by each of ``ANCHORS`` - 1 hashes.  The links found give components, and another round of
   anchors follows between components.  Then all pairs of a group in different
   components follow, in tiles, but for those decided already.
4. Components over all links.

Links inside a component that is found already aren't looked for: they change
no component.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import eights, fresh, give_back, lean, pieces, scratch, sized, stir, table

SHINGLE = 5
#: Similarity of linked sets, in per cent.
PERCENT = 75
#: Bytes a worker looks at together.
SLICE = 1 << 19
#: Shingles a task counts at a time, how often one must come up there to be called common, and how many are called so at most (8 MB).
BLOCK, COMMON, MOST_COMMON = 1 << 19, 6, 1 << 20
#: Prefix elements dealt to a task, about; sets in a trie; classes of a group in a tile, and in a task's tiles, about.
DEAL, LEAVES, TILE, TILES = 1 << 18, 128, 512, 4096
#: Bytes of sets that one set meets in a shard, and that a task's shards hold together, about.
SHARD, TASK = 1 << 20, 4 << 20
#: Sets that go down a trie together.
PROBES = 256
#: Anchors of a group in a round, and rounds, before all pairs that are left.
ANCHORS, ROUNDS = 4, 2
#: Groups from this size on are merged if the same class stands out in them.
LARGE = 64

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_COMMON_BIT = _U(1) << _U(63)
#: What is left of eight bytes when only the first n count.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Longer words are named by BLAKE2.
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word; a hash takes in eight bytes at a time and is stirred after each, so it isn't linear in them."""
    data = data.lower()  # of bytes: A to Z alone
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    eight, left = eights(data), ends - starts
    h = stir(left.astype(_U) * _U(_BASE))
    word, at = np.arange(len(starts)), starts
    for _ in range(_LONG // 8):
        if not len(word):
            break
        h[word] = stir(h[word] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        on = left > 8
        word, at, left = word[on], at[on] + 8, left[on] - 8
    for i in word.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, h


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, A-Z lower-cased; long data in parts cut at white space."""
    if len(data) <= 2 * SLICE:
        return _words(data)
    b = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(b):
        stop = min(len(b), at + SLICE)
        while stop < len(b):
            gap = np.flatnonzero(_SPACE[b[stop : stop + SLICE]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(b), stop + SLICE)
        s, h = _words(data[at:stop])
        out.append((s + at, h))
        at = stop
    return np.concatenate([s for s, _ in out]), np.concatenate([h for _, h in out])


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 63-bit hashes."""
    ends = np.cumsum([len(x) + 1 for x in texts])
    start, h = words(b"\n".join([*texts, b""]))
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    s = np.zeros(max(0, len(h) - SHINGLE + 1), _U)
    for j in range(SHINGLE):
        s += h[j : len(h) - SHINGLE + 1 + j] * _U(pow(_BASE, 2 * j + 3, 1 << 64))
    s = mixed(s) >> _U(1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            few = sum(int(x) * pow(_BASE, 2 * j + 3, 1 << 64) for j, x in enumerate(h[a:b])) + (b - a)
            out.append(mixed(np.array([few & ((1 << 64) - 1)], _U)) >> _U(1))
        else:
            out.append(np.empty(0, _U))
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name for a set; sets of different size or content get different ones but for hash collisions."""
    total = (int(mixed(s + _U(1)).sum(dtype=_U)) + len(s) * _BASE) % (1 << 64)
    return int(mixed(np.array([total], _U)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def needed(a: int, b: int) -> int:
    """Common elements that sets of sizes a and b need to be linked."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the global order: common shingles get the top bit."""
    if len(common) and len(s):
        s = np.where(common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s, s | _COMMON_BIT, s)
        s.sort()
    return s


def parities(s: np.ndarray) -> bytes:
    """Parities of how many elements fall on each bit; n to 2n bits, a power of two of at least 64."""
    bits = 1 << min(16, max(6, len(s).bit_length()))
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps as they would be with ``size`` bytes."""
    while bitmaps.shape[-1] > size:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] ^ bitmaps[..., half:]
    return bitmaps


def most_apart(both):
    """In how many elements two linked sets of ``both`` elements together may differ."""
    return both - 2 * -(-PERCENT * both // (100 + PERCENT))


def may_link(one: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Which of the ``others`` (bitmaps of one length, and their sets' sizes) may be linked with a set of n elements."""
    size = min(one.shape[-1], others.shape[-1])
    differ = np.bitwise_count(folded(others, size) ^ folded(one, size)).sum(1)
    return differ <= most_apart(n + sizes)


def _slices(batch, name):
    texts = batch.column(name)
    for a, b in pieces([len(x.as_buffer()) if x.is_valid else 0 for x in texts], SLICE):
        yield a, b, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[a:b]]


def survey(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, k, n, cls, bits) for documents, and (common, n) for shingles that came up often in a block of one task."""

    names = ["doc_id", "k", "n", "cls", "bits", "common"]

    @lean
    def run(batches):
        block, held = [], 0

        def often():
            found, n = np.unique(np.concatenate(block), return_counts=True)
            found, n = found[n >= COMMON], n[n >= COMMON]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(n, pa.int64()), none, pa.nulls(len(found), pa.binary()), pa.array(found.view(np.int64))], names)

        for batch in batches:
            for a, b, texts in _slices(batch, "text"):
                own = sets(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("k")[a:b], pa.array([len(s) for s in own], pa.int64()), pa.array([class_of(s) for s in own], pa.int64()), pa.array([parities(s) for s in own], pa.binary()), pa.nulls(len(own), pa.int64())], names)
                block += own
                held += sum(map(len, own))
                if held > BLOCK:
                    yield often()
                    block, held = [], 0
        if block:
            yield often()

    return docs.select("doc_id", "k", "text").mapInArrow(run, "doc_id long, k long, n long, cls long, bits binary, common long")


def common_shingles(surveyed: DataFrame) -> np.ndarray:
    """The most often reported shingles, at most MOST_COMMON, ascending."""
    top = surveyed.where("common is not null").groupBy("common").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "common").limit(MOST_COMMON)
    return np.sort(top.select("common").toPandas()["common"].to_numpy(np.int64).view(_U))


def groups(docs: DataFrame, common, deals: int) -> DataFrame:
    """(sig, cls): classes that share an element of their prefixes; groups of the same classes are taken once.

    Rare elements are dealt out in blocks of bytes and meet in tasks by hash.  A
    common one may be in the prefix of any number of classes (those of common
    elements alone), so its owners are dealt out by their own hashes, too, and
    come out as rows, which Spark aggregates.  Groups of one may come with them.
    """

    @lean
    def deal(batches):
        for batch in batches:
            for _, _, texts in _slices(batch, "text"):
                tokens, cls, seen = [], [], set()
                for s in sets(texts):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        tokens.append(ordered(s, common.value)[: prefix_length(len(s))])
                        cls.append(np.full(len(tokens[-1]), c, np.int64))
                if not tokens:
                    continue
                token, owner = np.concatenate(tokens), np.concatenate(cls)
                to = mixed(np.where(token < _COMMON_BIT, token, token ^ mixed(owner.view(_U))))
                to = (to % _U(deals)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                token, owner, to = token[order], owner[order], to[order]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                ends = [*cut[1:].tolist(), len(to)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array([token[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["deal", "tokens", "owners"])

    def meet(key, frame):
        token = np.concatenate([np.frombuffer(x, _U) for x in frame["tokens"]])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in frame["owners"]])
        del frame
        often = token >= _COMMON_BIT
        apart = pd.DataFrame({"sig": mixed(token[often]).view(np.int64), "cls": owner[often]}).drop_duplicates()
        token, owner = token[~often], owner[~often]
        order = np.argsort(token, kind="stable")
        order = order[np.isin(token[order], _repeated(token[order]), assume_unique=False)] if len(order) else order
        token, owner = token[order], owner[order]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, int)
        size = np.diff(at, append=len(token))
        sig = np.add.reduceat(mixed(owner.view(_U) + _U(77)), at) if len(at) else np.empty(0, _U)
        sig = mixed(sig + size.astype(_U)).view(np.int64)
        _, keep = np.unique(sig, return_index=True)
        keep = keep[size[keep] > 1]
        rows = np.concatenate([np.arange(at[k], at[k] + size[k]) for k in keep]) if len(keep) else np.empty(0, int)
        out = pd.concat([pd.DataFrame({"sig": np.repeat(sig[keep], size[keep]), "cls": owner[rows]}), apart])
        give_back()
        return out

    dealt = docs.select("text").mapInArrow(deal, "deal long, tokens binary, owners binary")
    return dealt.groupBy("deal").applyInPandas(meet, "sig long, cls long").dropDuplicates(["sig", "cls"])


def _repeated(sorted_tokens: np.ndarray) -> np.ndarray:
    return np.unique(sorted_tokens[1:][sorted_tokens[1:] == sorted_tokens[:-1]])


@dataclass
class Node:
    """A trie node: the elements on the edge to it, its children, the sets that end here, and bounds over its subtree."""

    edge: np.ndarray
    depth: int
    children: list = field(default_factory=list)
    ends: list = field(default_factory=list)
    shortest: int = 0
    longest: int = 0


def build(members: list[np.ndarray]) -> Node:
    """A trie of sets in the global order; ``ends`` holds their positions in ``members``."""
    root = Node(np.empty(0, _U), 0)
    path, last = [root], np.empty(0, _U)
    for i in sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes()):
        s = members[i]
        n = min(len(s), len(last))
        differ = np.flatnonzero(s[:n] != last[:n])
        shared = int(differ[0]) if len(differ) else n
        while path[-1].depth > shared:
            node = path.pop()
            if path[-1].depth < shared:  # split the edge where the sets part
                middle = Node(node.edge[: shared - path[-1].depth], shared, [node])
                node.edge = node.edge[shared - path[-1].depth :]
                path[-1].children[-1] = middle
                path.append(middle)
        if len(s) > shared:
            leaf = Node(s[shared:], len(s))
            path[-1].children.append(leaf)
            path.append(leaf)
        path[-1].ends.append(i)
        last = s
    # bounds, children first
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    for node in reversed(order):
        own = [node.depth] * bool(node.ends)
        node.shortest = min(own + [c.shortest for c in node.children], default=0)
        node.longest = max(own + [c.longest for c in node.children], default=0)
    return root


def probe(root: Node, sets_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): set i of ``sets_`` is linked with the trie's set j.  All sets go down together; every path is walked once."""
    n = np.array([len(s) for s in sets_])
    owner = np.repeat(np.arange(len(n)), n)
    token = np.concatenate(sets_)
    known = np.unique(token)
    # elements by set and rank, to say how many a set has up to an element; and by element, to say who has it
    ranked = owner * (len(known) + 1) + np.searchsorted(known, token)
    begin = np.cumsum(n) - n
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    found: list[tuple[np.ndarray, int]] = []
    stack = [(root, np.arange(len(n)), np.zeros(len(n), np.int64))]
    while stack:
        node, who, overlap = stack.pop()
        depth, edge = node.depth - len(node.edge), node.edge
        for at in range(0, len(edge), 64):  # long edges in steps, to leave early
            part = edge[at : at + 64]
            low, high = np.searchsorted(token, part), np.searchsorted(token, part, "right")
            some = high > low
            low, many = low[some], (high - low)[some]
            hits = owner[np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)]
            overlap = overlap + np.bincount(hits, minlength=len(n))[who]
            depth += len(part)
            gone = np.searchsorted(ranked, who * (len(known) + 1) + np.searchsorted(known, part[-1], "right")) - begin[who]
            on = overlap + np.minimum(node.longest - depth, n[who] - gone) >= needed(n[who], node.shortest)
            who, overlap = who[on], overlap[on]
            if not len(who):
                break
        if len(who):
            linked = who[overlap >= needed(n[who], node.depth)] if node.ends else who[:0]
            found += [(linked, j) for j in node.ends if len(linked)]
            stack += [(c, who, overlap) for c in node.children]
    i = np.concatenate([np.empty(0, np.int64), *(who for who, _ in found)])
    return i, np.repeat([j for _, j in found], [len(who) for who, _ in found]).astype(np.int64)


def stars(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(smallest, other) for every other member of each component of links: as many as members, not as links."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(root) if find(x) != x]


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of the links among the candidates ``pairs`` (a, b, probe, weight), by tries of the sets in ``members`` (cls, tokens).

    probe is the one of a pair that goes down the trie which holds the other, of
    weight elements.  A probe's partners are dealt to shards of about SHARD
    bytes, shards to tasks of about TASK bytes, so that no task holds more than
    a few of them, or one very long set.  A shard gives the ``stars`` of its
    links, those included that weren't candidates.
    """
    pairs = pairs.withColumn("other", F.when(F.col("probe") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    count = pairs.groupBy("probe").agg(F.ceil(F.sum("weight") * 8 / SHARD).alias("shards"))
    total = pairs.agg(F.sum("weight")).first()[0] or 0
    tasks = max(1, math.ceil(total * 8 / TASK))
    task = F.pmod(F.xxhash64("probe", F.pmod(F.xxhash64("other"), F.col("shards"))), F.lit(tasks)).alias("task")
    dealt = pairs.join(count, "probe").select(task, "probe", "other")
    rows = dealt.select("task", F.explode(F.array(F.struct(F.col("probe").alias("cls"), F.lit(True).alias("down")), F.struct(F.col("other").alias("cls"), F.lit(False).alias("down")))).alias("x"))
    rows = rows.select("task", "x.cls", "x.down").groupBy("task", "cls").agg(F.max("down").alias("down"), F.max(~F.col("down")).alias("held")).join(members, "cls").select("task", "cls", "down", "held", "tokens")

    def run(key, frame):
        names, sets_ = frame["cls"].to_numpy(), [np.frombuffer(t, _U) for t in frame["tokens"]]
        held = sorted(np.flatnonzero(frame["held"]).tolist(), key=lambda i: sets_[i].astype(">u8").tobytes())
        down = np.flatnonzero(frame["down"])
        down = down[np.argsort([len(sets_[i]) for i in down], kind="stable")]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(held), LEAVES):
            own = np.array(held[at : at + LEAVES])
            root = build([sets_[i] for i in own])
            for on in range(0, len(down), PROBES):
                i, j = probe(root, [sets_[i] for i in down[on : on + PROBES]])
                a.append(names[down[on + i]])
                b.append(names[own[j]])
        out = pd.DataFrame(stars(np.concatenate(a), np.concatenate(b)), columns=["a", "b"], dtype="int64")
        del sets_, frame
        give_back()
        return out

    return rows.groupBy("task").applyInPandas(run, "a long, b long").distinct()


def merged(group: DataFrame, left: DataFrame) -> DataFrame:
    """(sig, cls, n, hub): the groups of more than one, large ones with the same hub made one.

    A group's hub is the class that shares the largest part of its prefix with
    any other: edited copies are nearer to their original than to each other.
    Each element of the original makes a group of almost the same copies; as
    one group their pairs come up once.
    """
    shared = group.groupBy("cls").agg(F.count(F.lit(1)).alias("shared")).join(left.select("cls", "n"), "cls")
    part = shared.select("cls", "n", (F.col("shared") / (F.col("n") * (100 - PERCENT) / 100 + 1)).alias("part"))
    group = group.join(part, "cls")
    hubs = group.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("part", "cls")).alias("top")).where("size > 1")
    hubs = hubs.select("sig", F.col("top.cls").alias("hub"), F.when(F.col("size") >= LARGE, F.xxhash64("top.cls")).otherwise(F.col("sig")).alias("to"))
    return group.join(hubs, "sig").select(F.col("to").alias("sig"), "cls", "n", "hub").distinct()


def allowed(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb, probe) whose bitmaps, in ``left`` (cls, bits), allow a link, as (a, b, probe, weight): that of the other."""
    for side in "ab":
        pairs = pairs.join(left.select(F.col("cls").alias(side), F.col("bits").alias("bits" + side)), side)

    def run(frames):
        for f in frames:
            keep, both = np.zeros(len(f), bool), (f["na"] + f["nb"]).to_numpy()
            sizes = np.stack([f["bitsa"].map(len), f["bitsb"].map(len)], 1)
            for m, n in np.unique(sizes, axis=0).tolist():
                own = np.flatnonzero((sizes == (m, n)).all(1))
                x, y = (np.frombuffer(b"".join(f[c].iloc[own]), np.uint8).reshape(len(own), -1) for c in ("bitsa", "bitsb"))
                differ = np.bitwise_count(folded(x, min(m, n)) ^ folded(y, min(m, n))).sum(1)
                keep[own] = differ <= most_apart(both[own])
            yield f.loc[keep, ["a", "b", "probe"]].assign(weight=np.where(f["probe"] == f["a"], f["nb"], f["na"])[keep])

    return pairs.select("a", "b", "probe", "na", "nb", "bitsa", "bitsb").mapInPandas(lean(run), "a long, b long, probe long, weight long")


def anchored(group: DataFrame, comp: DataFrame | None, step: int) -> DataFrame:
    """Pairs (a, b, na, nb, probe), a < b, of each group's anchors (probe) of this round with its other classes in other components, if their sizes na and nb allow a link."""
    order = [(F.col("cls") != F.col("hub")).cast("long"), *(F.xxhash64("cls", F.lit(step * ANCHORS + i)) for i in range(1, ANCHORS))]
    rows = group
    if comp is None:
        rows = rows.withColumn("root", F.col("cls"))
    else:
        rows = rows.join(comp, rows["cls"] == comp["node"], "left").select("sig", "cls", "n", "hub", F.coalesce("root", "cls").alias("root"))
        several = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
        rows = rows.join(several, "sig", "left_semi")
    firsts = rows.groupBy("sig").agg(F.array_distinct(F.array(*(F.min_by(F.struct("cls", "n", "root"), o) for o in order))).alias("firsts"))
    # between two anchors a pair comes up once
    near = lambda m, n: 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)
    other = F.filter("firsts", lambda x: (x["root"] != F.col("root")) & near(x["n"], F.col("n")) & ((x["cls"] < F.col("cls")) | ~F.exists("firsts", lambda y: y["cls"] == F.col("cls"))))
    pairs = rows.join(firsts, "sig").select("cls", "n", F.explode(other).alias("first"))
    low = F.col("cls") < F.col("first.cls")
    ends = (F.when(low, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("cls", "first.cls", "a"), ("first.cls", "cls", "b"), ("n", "first.n", "na"), ("first.n", "n", "nb")))
    return pairs.select(*ends, F.col("first.cls").alias("probe")).groupBy("a", "b", "na", "nb").agg(F.min("probe").alias("probe"))


def crossing(group: DataFrame, comp: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs (a, b, probe, weight) of classes in a group but in different components whose sizes and bitmaps allow a link.

    Groups of one component fall away by aggregation; the others are dealt out
    in tiles of two blocks of about TILE classes, so none is in one task.
    """
    rows = group.join(comp, group["cls"] == comp["node"], "left").select("sig", "cls", "n", F.coalesce("root", "cls").alias("root"))
    several = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")).where("lo <> hi").select("sig", "blocks")
    rows = rows.join(several, "sig").join(left.select("cls", "bits"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = table(rows, "join-crossing")
    tasks = max(1, math.ceil(rows.count() / TILES))
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("sig", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "root", "n", "bits")
    # several small tiles to a task
    tiles = tiles.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("sig"), F.lit(tasks))).otherwise(F.xxhash64("sig", "i", "j")))

    def run(key, frame):
        out = [np.empty((0, 2), np.int64)]
        for (_, i, j), t in frame.groupby(["sig", "i", "j"], sort=False):
            t = t.sort_values("n", kind="stable")
            cls, root, n, block = (t[c].to_numpy() for c in ("cls", "root", "n", "block"))
            maps = [np.frombuffer(x, np.uint8) for x in t["bits"]]
            size = np.array([len(x) for x in maps])
            by = {b: np.stack([m for m in maps if len(m) == b]) for b in set(size.tolist())}
            place = np.zeros(len(t), int)
            for b in by:
                place[size == b] = np.arange((size == b).sum())
            last = np.searchsorted(n, n * 100 // PERCENT, side="right")
            for x in range(len(cls)):
                y = np.arange(x + 1, last[x])
                y = y[root[y] != root[x]]
                if i != j:
                    y = y[block[y] != block[x]]
                for b in by if len(y) else ():
                    some = y[size[y] == b]
                    if len(some):
                        some = some[may_link(maps[x], by[b][place[some]], n[x], n[some])]
                        out.append(np.stack([np.minimum(cls[x], cls[some]), np.maximum(cls[x], cls[some])], 1))
        both = np.unique(np.concatenate(out), axis=0)
        del frame
        give_back()
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    pairs = tiles.drop("blocks").groupBy("task").applyInPandas(run, "a long, b long").distinct()
    return pairs.join(left.select(F.col("cls").alias("b"), F.col("n").alias("weight")), "b").select("a", "b", F.col("a").alias("probe"), "weight")


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n, root, component_id) for every row of ``docs`` (doc_id, text).

    k = xxhash64(text) tells rows of one doc_id apart; n is the set's size; root
    names the component (null without a set); component_id is as ``near_duplicates`` says.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    with scratch(spark):
        surveyed = table(survey(docs), "join-survey", keep=True)
        own = surveyed.where("common is null").select("doc_id", "k", "n", "cls")
        common = spark.sparkContext.broadcast(common_shingles(surveyed))
        total = own.agg(F.sum("n")).first()[0] or 0
        group = table(groups(docs, common, max(1, math.ceil(total * (100 - PERCENT) / 100 / DEAL))), "join-groups")
        # the classes that are left, and one document of each to read its set from
        classes = surveyed.where("common is null and n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bits").alias("bits"))
        classes = table(classes, "join-classes")
        left = table(classes.join(group.select("cls").distinct(), "cls", "left_semi"), "join-left")
        group = table(merged(group, left), "join-merged")

        @lean
        def collect(batches):
            for batch in batches:
                for _, _, some in _slices(batch, "text"):
                    got = {class_of(s): ordered(s, common.value) for s in sets(some) if len(s)}
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([s.tobytes() for s in got.values()], pa.binary())], ["cls", "tokens"])

        held: list[DataFrame] = []  # sets read so far

        def links(pairs: DataFrame) -> DataFrame:
            """The linked ones of a scratch table of candidates; reads the sets of their classes, each once."""
            named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
            own = left.join(named, "cls", "left_semi").select("cls", "doc_id", "n")
            for h in held:
                own = own.join(h.select("cls"), "cls", "left_anti")
            own = table(own, "join-wanted")
            if n_own := own.count():
                wanted = sized(own.select(F.col("doc_id").alias("_doc")).distinct(), 16, n_own)
                texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")
                found = texts.mapInArrow(collect, "cls long, tokens binary").join(sized(own.select("cls"), 16, n_own), "cls", "left_semi")
                held.append(table(found.groupBy("cls").agg(F.first("tokens").alias("tokens")), "join-members"))
            members = held[0]
            for h in held[1:]:
                members = members.unionByName(h)
            return table(verified(pairs, members), "join-links")

        tried = linked = comp = None
        for step in range(ROUNDS + 1):
            if step < ROUNDS:
                pairs = allowed(anchored(group, comp, step), left)
            else:
                pairs = crossing(group, comp, left.select("cls", "n", "bits"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = table(pairs, "join-pairs")
            n = pairs.count()
            if n:
                found = links(pairs)
                linked = found if linked is None else linked.unionByName(found)
                tried = pairs if tried is None else tried.unionByName(pairs)
            if n or comp is None:
                comp = table(components(linked if linked is not None else pairs), "join-components")

        rooted = classes.select("cls", F.col("doc_id").alias("least")).join(comp, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
        roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = table(rooted.join(roots, "root").select(F.col("cls").alias("_cls"), "root", "component_id"), "join-named", keep=True)
    out = own.join(named, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "k", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and 9 to 13; A-Z count as a-z.  A
    text with one to four words has those as its one shingle; a null, empty or
    blank text has none and is linked with nothing, itself excepted:
    component_id is then its doc_id.  Otherwise it is the smallest doc_id of the
    component, nulls left out.  Rows that repeat are rows of one class; an empty
    table gives no rows; other columns are not looked at.
    """
    return components_of(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any more) without all but one of each component.

    The row with the smallest doc_id stays, null last, then the smallest hash of
    its text; rows that agree in both are one.  Rows without a set (null, empty
    or blank text) all stay.  Texts of any length are read whole; other columns
    pass through, whatever their names; an empty table gives no rows.
    """
    found = table(components_of(docs).where("n > 0"), "join-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k")).alias("first")
    kept = found.groupBy("root").agg(first)
    rows = found.groupBy("doc_id", "k", "root").agg(F.count(F.lit(1)).alias("rows")).join(kept, "root")
    stays = F.struct("doc_id", "k").eqNullSafe(F.struct("first.doc_id", "first.k"))
    marks = table(rows.select("doc_id", "k", "rows", stays.alias("stays")), "join-marks")
    k = F.xxhash64("text")

    def without(side: DataFrame, marked: DataFrame, how: str) -> DataFrame:
        m = sized(table(marked.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")), "join-list"), 32)
        return side.join(m, side["doc_id"].cast("long").eqNullSafe(m["_d"]) & (k == m["_k"]), how)

    out = without(docs, marks.where("not stays"), "left_anti")
    again = marks.where("stays and rows > 1")
    if again.head(1):
        (name,) = fresh(out, "_k")
        one = without(out, again, "left_semi").withColumn(name, k).dropDuplicates(["doc_id", name]).drop(name)
        out = without(out, again, "left_anti").unionByName(one)
    return out
