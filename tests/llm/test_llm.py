"""Each operator on small tables with nulls, empty and long texts, ties, repeats, clashing columns and no rows."""

import collections
import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from brindle.llm import bpe, graph, line_dedup, media, mix, ngram_join, quality, suffix_dedup, topk, toxicity, warc
from brindle.llm.shared import scratch_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    (1, "It's a don't 12 café\n  naïve  … text end "), (2, ""), (3, None), (4, "x" * 5000 + " " * 4000 + "y 1" * 50), (5, "one two three"), (5, "one two three"),
    (None, "without an id"), (6, "a b c d e f g h " * 300), (7, "\x1c tab\tand \x85 odd   \n\n spaces   "),
]


def docs(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def texts(spark, **more):
    return docs(spark, [(i, t, "s") for i, t in TEXTS], **more)


def ranks():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# ---- 1
def test_bpe_matches_tiktoken_and_round_trips(spark):
    own = bpe.Codec(*ranks())
    df = texts(spark, token_ids="clash", n_tokens=9)
    out = bpe.decode(bpe.encode(df, *ranks()), *ranks())
    assert out.columns == [*(c for c in df.columns if c != "token_ids"), "token_ids", "decoded"]
    for r in out.collect():
        assert r.token_ids == own.encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert collections.Counter(map(str, bpe.round_trip(df, *ranks()).collect())) == collections.Counter(map(str, out.collect()))
    assert bpe.encode(df.limit(0), *ranks()).count() == 0


@pytest.mark.parametrize("text", ["word " * 30_000, "a" * 200_000, " " * 300_000 + "x", "ab1 " * 20_000 + "é" * 150_000 + "\n " * 9000, "x\t" * 50_000 + "'s " * 40_000])
def test_bpe_long_texts_split_safely(text):
    own = bpe.Codec(*ranks())
    ids = own.encode(text)
    assert own.decode(ids) == text.encode()
    pieces = [own.encoding._encode_single_piece(m.group().encode()) for m in own.match.finditer(text)]
    assert ids.tolist() == [i for p in pieces for i in p]


def test_bpe_decodes_parts_of_characters(spark):
    own = bpe.Codec(*ranks())
    assert own.decode(np.empty(0, int)) == b""
    (a,) = own.encoding._encode_single_piece("é".encode()[:1]),
    df = spark.createDataFrame([(a,), (None,), ([],)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, *ranks()).collect()] == ["é".encode()[:1], b"", b""]


# ---- 2
def test_png_and_damage():
    payload = media.pad(bytes(range(256)) * 3)
    image = media.to_png(payload)
    assert media.from_png(image) == payload and media.pad(b"") == bytes(64) and len(media.pad(b"a" * 64)) == 64
    assert struct.unpack(">II", image[16:24]) == (64, len(payload) // 64)
    with pytest.raises(ValueError):
        media.from_png(image[:60] + b"\x00" + image[61:])


def test_media_archives(spark):
    path = scratch_path(spark, "media-test")
    rows = [("a", b"1" * 100), (None, b"2"), ("a", b"3" * 7000), ("null", None)]
    media.write(spark.createDataFrame(rows, "key string, media binary"), path)
    uri = media.qualified(spark, path)
    got = [(r.key, None if r.media is None else bytes(r.media)) for r in media.read(spark, path).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    import pyarrow.fs as pafs

    fs, top = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(f"{top}/part-lost.zip") as f:  # of a task that never committed
        f.write(b"PK")
    assert media.read(spark, path).count() == 4
    empty = scratch_path(spark, "media-test")
    media.write(spark.createDataFrame([], "key string, media binary"), empty)
    assert media.read(spark, empty).count() == 0


def test_media_member_retries(spark, monkeypatch):
    path = scratch_path(spark, "media-test")
    media.write(spark.createDataFrame([("k", b"abc")], "key string, media binary"), path)
    reader = media.ArchiveReader({"path": media.qualified(spark, path), "retries": "2"})
    (span,) = reader.partitions()
    fs, _ = media._fs(reader.uri)
    import zipfile

    with fs.open_input_file(span.uri) as f:
        (info,) = zipfile.ZipFile(f).infolist()
    fails = iter([True, True, False])

    class Flaky:
        def open_input_file(self, p):
            if next(fails):
                raise OSError("gone")
            return fs.open_input_file(p)

    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert reader.member(Flaky(), span.uri, info) == b"abc"


def test_media_round_trip_of_texts(spark):
    df = texts(spark, media="clash", key=3)
    path = scratch_path(spark, "media-test")
    media.write(media.images(df, "text", "doc_id"), path)
    got = collections.Counter((r.key, bytes(r.payload)) for r in media.features(media.read(spark, path)).collect())
    assert got == collections.Counter((None if i is None else str(i), media.pad((t or "").encode())) for i, t in TEXTS)


# ---- 3
def test_mix_targets_and_nearness(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 400)), s) for i, s in enumerate(["a"] * 400 + ["b"] * 200 + ["c"] * 20 + [None] * 100)]
    got = mix.mix(docs(spark, rows, size="clash", rank=1, target=2)).toPandas()
    assert len(got) == len(rows)
    per = got.groupby(got["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    total = per["size"].sum()
    assert abs(per["target"].sum() - total) < 1e-6 * total and (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert per.loc["c", "target"] == 3 * per.loc["c", "size"] and per.loc["c", "taken"] == 3 * per.loc["c", "size"]
    free = per.drop("c")
    assert np.allclose((free["target"] / [1, 2, 1]).to_numpy(), (free["target"] / [1, 2, 1]).iloc[0])  # a 1, b 2, c 3, null 1
    assert ((per["taken"] - per["target"]).abs() < 0.01 * per["target"] + 5).all()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    again = mix.mix(docs(spark, rows[::-1])).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mix_probabilities_follow_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(n), "a") for i, n in enumerate(rng.choice([3, 20, 150, 900], 1200, p=[0.4, 0.3, 0.2, 0.1]))] + [(5000, "w " * 100_000, "b")]
    df = docs(spark, rows)
    got = {s: mix.mix(df, seed=s).where("source = 'a'").toPandas() for s in range(5)}
    own = got[0]
    digits = own["size"].map(lambda n: len(f"{n:b}"))
    # the one big document takes all it may, the rest of the target is below 3 copies of every stratum here or capped there
    e = np.minimum(3, digits * next(x for x in np.linspace(0, 3, 300_001) if (own["size"] * np.minimum(3, digits * x)).sum() >= own["target"].iloc[0] - 1e-6))
    mean = sum(g.set_index("doc_id")["copies"] for g in got.values()) / len(got)
    per = np.array([(mean.to_numpy()[own.index[digits == d]].mean(), e[digits == d].mean()) for d in sorted(set(digits))])
    assert len(set(np.round(per[:, 1], 3))) > 1 and np.abs(per[:, 0] - per[:, 1]).max() < 0.08
    assert all((g["copies"].to_numpy() >= np.floor(e - 1e-3)).all() for g in got.values())  # the certain copies


def test_mix_edges(spark):
    assert mix.mix(texts(spark).limit(0)).count() == 0
    got = mix.mix(texts(spark)).collect()
    assert len(got) == len(TEXTS) and all(r.taken == 0 for r in got if r.size == 0)
    assert all(r.taken == 0 and r.target == 0 for r in mix.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect())


# ---- 4
def test_topk_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 2]) for i in range(1, 1301)] + [(2001, None), (2020, [1.0, None] * 4), (2040, [float("nan")] * 8), (2060, [1e300] * 8), (None, [1.0] * 8), (40, [9.0] * 8), (2080, [1.0, 2.0]), (2081, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit("x")})
    got = collections.defaultdict(list)
    for r in topk.search(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    own = [(i, [int(np.floor(64 * x)) if abs(x) < 1e18 else int(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for n, (q, x) in enumerate(own):
        if q % 20 == 0:
            want[q] += sorted(((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c) for m, (c, y) in enumerate(own) if m != n and len(y) == len(x)))[:5]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted((c, -s) for s, c in x) for q, x in want.items() if x}
    same = spark.createDataFrame([(20, [1.0]), (20, [2.0]), (1, [1.0]), (1, [3.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    lists = collections.Counter((r.query_id, r.rank, r.vec_id, r.score // 4096) for r in topk.search(same, F.col("vec_id") == 20).collect())
    assert lists == collections.Counter([(20, n, i, s) for one in ([(1, 3), (1, 3), (20, 2), (1, 1)], [(1, 6), (1, 6), (1, 2), (20, 2)]) for n, (i, s) in enumerate(one, 1)])
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


# ---- 5
def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sets, [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def variants(seed, n):
    """Texts that share passages and are edited copies of each other, at similarities about the bound."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeABC"), 4))
    shared = [" ".join(word() for _ in range(25)) for _ in range(3)]
    out = []
    for _ in range(n):
        w = [word() for _ in range(int(rng.integers(3, 120)))]
        base = (shared[int(rng.integers(3))] + "\n" + " ".join(w)).split(" ")
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = word()
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return out


def test_join_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "LEAVES", 4)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(variants(5, 60))] + [(2000, ""), (2001, None), (2002, " \n\t"), (2003, "One TWO"), (2004, "one two"), (2005, "one two "), (None, "one two"), (2006, "one two"), (2006, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "cls": F.lit(1), "n": F.lit(2)})
    sets, want = components_by_force(rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == collections.Counter((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, want))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter({c for s, c in zip(sets, want) if s} | {i for (i, _), s in zip(rows, sets) if not s})
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_trie_probe_brute_force():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    members = [np.sort(np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(30, 60))], rng.integers(0, 1 << 62, int(rng.integers(0, 20))).astype(np.uint64)]))) for _ in range(80)] + [base, base]
    for leaves in (members, members[:1]):
        i, j = ngram_join.probe(ngram_join.build(leaves), [base, *members[:40]])
        linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x, a in enumerate([base, *members[:40]]) for y, b in enumerate(leaves) if linked(a, b)]
    for m in members:
        one = np.frombuffer(ngram_join.parities(m), np.uint8)
        other = np.frombuffer(ngram_join.parities(base), np.uint8)
        if 100 * len(np.intersect1d(m, base)) >= 75 * len(np.union1d(m, base)):
            assert ngram_join.may_link(one, other[None], len(m), np.array([len(base)]))[0]


def test_regular_words_do_not_collide():
    """Thue-Morse words and their complements, of any length, and the same as strings of op 9."""
    for a, b in ((b"a", b"b"), (b"x", b"q"), (b"0", b"1")):
        one, other = a, b
        for _ in range(11):
            one, other = one + other, other + one
            assert len(set(ngram_join.words(one + b" " + other)[1].tolist())) == 2
            if len(one) >= suffix_dedup.GRAM:
                h = [int(suffix_dedup.names(suffix_dedup.grams(x), np.array([0]), len(x))[0]) for x in (one, other)]
                assert h[0] != h[1]
    assert len(set(ngram_join.words(b"a\0 a A b" + b" " + b"z" * 300 + b" " + b"z" * 301)[1].tolist())) == 5


def test_words_in_parts(monkeypatch):
    data = ("ab  cd\n" * 1000 + "x" * 900).encode()
    whole = ngram_join.words(data)
    monkeypatch.setattr(ngram_join, "SLICE", 100)
    parts = ngram_join.words(data)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_graph_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(-5, 200), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, -5: -5, 200: -5}


# ---- 6
def test_warc_chains(spark):
    fake = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    long = bytes(range(256)) * 400
    rows = [(1, "http://a/\r\nX: y", fake * 5), (2, None, b""), (3, "u", None), (4, "u", b"z" * 99), (5, "u", b"z" * 99), (7, "u", b"q" * 100), (6, "u", b"q" * 100), (None, "u", b"q" * 100), (8, "u", long), (9, "u", long), (9, "u", long), (10, "u", b"WARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary").withColumns({"digest": F.lit(1), "d": F.lit(2)})
    path = scratch_path(spark, "warc-test")
    warc.write(df.repartition(2), path)
    for span in (8, 0.0005):  # ranges shorter than a record, too
        got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, path, span).collect())
        first = {b"q" * 100: 6, long: 8}
        want = collections.Counter()
        for i, _, p in rows:
            p = p or b""
            to = first.get(p) if i is not None and i != first.get(p) else None
            want[i, "response" if to is None else "revisit", to, len(p), hashlib.sha256(p).hexdigest(), p if to is None else None] += 1
        assert got == want
    # one id with two payloads: each keeps its own
    twice = scratch_path(spark, "warc-test")
    a, b = b"A" * 200, b"B" * 200
    warc.write(spark.createDataFrame([(3, None, a), (7, None, a), (7, None, b)], "page_id long, url string, payload binary"), twice)
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, twice).collect())
    assert got == [(3, "response", 0, a), (7, "response", 0, b), (7, "revisit", 3, None)]
    empty = scratch_path(spark, "warc-test")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# ---- 7 and 10
SF = "/root/testdata/sf0.01"


def labelled(spark, name):
    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return d, l, {r.doc_id: r[name] for r in l.collect()}


# a third of the 51 toxic documents there are in languages other than English, with few of their words among the training rows
@pytest.mark.parametrize("module, name, cut, precision, recall", [(quality, "quality", 0.5, 0.97, 0.95), (toxicity, "toxic", 0.7, 0.85, 0.75)])
def test_classifiers_held_out(spark, module, name, cut, precision, recall):
    d, l, truth = labelled(spark, name)
    model = module.train(d, l)
    out = {r.doc_id: r.score for r in module.score(d, model, "doc_id").collect()}
    assert len(out) == d.count() and all(0 <= s <= 1 for s in out.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    said, true = np.array([out[i] >= cut for i in held]), np.array([truth[i] == 1 for i in held])
    assert (said & true).sum() >= precision * said.sum() and (said & true).sum() >= recall * true.sum()
    # labels of held-out rows change nothing
    flipped = l.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(name)).otherwise(F.col(name)))
    again = {r.doc_id: r.score for r in module.score(d, module.train(d, flipped), "doc_id").collect()}
    assert again == out


@pytest.mark.parametrize("module, name", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, name):
    df = texts(spark, score="clash", features=1)
    none = spark.createDataFrame([], f"doc_id long, {name} int")
    for labels in (none, spark.createDataFrame([(1, 1), (6, None), (None, 0)], f"doc_id long, {name} int")):
        got = module.score(df, module.train(df, labels), "doc_id").collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert module.score(df.limit(0), module.train(df, none), "doc_id").count() == 0


# ---- 8
def lines_by_force(rows, least):
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n") if t is not None else ():
            if b := x.strip(" \t\r\x0b\x0c"):
                sites[b].add(s)
                if i is not None:
                    first[b] = min(first.get(b, i), i)
    out = collections.Counter()
    for i, t, _ in rows:
        if t is None:
            out[i, None, 0, 0] += 1
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            b = x.strip(" \t\r\x0b\x0c")
            boiler = b and len(sites[b]) >= least
            if not boiler or (i is not None and i == first.get(b) and b not in seen):
                kept.append(x)
            seen.add(b)
        n = len(t.split("\n"))
        out[i, "\n".join(kept), n, n - len(kept)] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_lines_brute_force(spark, least):
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(f"line {int(x)}" + " " * int(x % 3) for x in rng.integers(0, 30, 6)), f"s{int(rng.integers(14))}") for i in range(80)]
    rows += [(100, None, "a"), (101, "", None), (None, "line 3\n\n \nline 3", None), (102, "line 3\n" * 50, "z"), (102, "line 3\n" * 50, "z"), (-1, "\n\nline 3\n", None)]
    df = docs(spark, rows, n_lines="clash", h1=1, site=2, pos=3)
    got = line_dedup.dedup(df, least)
    assert got.columns == [*(c for c in df.columns if c != "n_lines"), "n_lines", "n_removed"]
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == lines_by_force(rows, least)
    assert line_dedup.dedup(df.limit(0)).count() == 0


# ---- 9
def spans_by_force(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out[i, len(b), tuple(edges.tolist()), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])] += 1
    return out


def test_suffix_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passages = [noise(n) for n in (395, 400, 401, 450, 900)]
    rows = []
    for i in range(40):
        rows.append((i, noise(int(rng.integers(0, 300))) + passages[int(rng.integers(5))] + noise(int(rng.integers(0, 500))) + passages[int(rng.integers(5))][: int(rng.integers(1, 900))]))
    rows += [(50, ""), (51, None), (52, "ab" * 600), (53, "z" * 399), (54, "y" * 400), (55, "y" * 400), (56, "x" * 401), (57, passages[4]), (57, passages[4]), (None, passages[3] + "!"), (58, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "spans": F.lit(1), "n": F.lit(2)})
    for hot, part in ((512, 1 << 20), (3, 600)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "PART", part)
        monkeypatch.setattr(suffix_dedup, "SLICE", part)
        got = collections.Counter((r.doc_id, r.n_bytes, tuple(x for s in r.spans for x in (s.start, s.stop)), bytes(r.kept)) for r in suffix_dedup.dedup(df).collect())
        assert got == spans_by_force(rows, 400)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_scratch_tables_are_shared(spark):
    path = table(spark.range(3).toDF("a"), "test").inputFiles()[0]
    assert spark.conf.get("spark.checkpoint.dir") in path
