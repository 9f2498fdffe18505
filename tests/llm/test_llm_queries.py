"""The registered queries against DuckDB where SQL says them, and the pipeline's stages against brute force."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle.llm import bpe, media, quality, toxicity
from brindle.llm import queries as Q
from tests.llm.test_llm import components_by_force, lines_by_force, spans_by_force
from tests.test_entry import SF, same

#: With enough labels for the classifier to be judged.
LABELLED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    same(Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mix", "tokens"]
    stage = {}
    for name, f in P.STAGES:
        before = docs
        docs = P.table(f(spark, docs, LABELLED), f"test-{name}")
        stage[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == before.columns
    # quality: most stay, those labelled good above all
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    kept = {r.doc_id for r in stage["quality"][1]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and any(i not in kept for i, q in labels.items() if q == 0)
    # lines
    before, after = stage["lines"]
    want = lines_by_force([(r.doc_id, r.text, r.source) for r in before], 10)
    assert {(r.doc_id, r.text) for r in after} == {(i, t) for i, t, _, gone in want if not gone or t.strip()}
    assert all(r.n_chars == len(r.text) for r in after)
    # near-duplicates
    before, after = stage["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before]
    sets, comp = components_by_force(rows)
    assert sorted(r.doc_id for r in after) == sorted(i for (i, _), s, c in zip(rows, sets, comp) if not s or i == c)
    # mix: whole copies, near the targets
    before, after = stage["mix"]
    copies = collections.Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in before}
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - words(before)) < 0.1 * words(before)
    tokens = stage["tokens"][1]
    assert len(tokens) == len(after)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in tokens) == collections.Counter((r.doc_id, sha(r.text.encode())) for r in after)
    # the whole run is the stages one after the other
    assert collections.Counter(P.run(spark, LABELLED).collect()) == collections.Counter(tokens)


# ---- registered queries that SQL can't say, whole, by brute force
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1_rows(spark):
    ranks, pattern = Q.tokenizer()
    own = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    want = []
    for i, t in documents()[["doc_id", "text"]].itertuples(index=False):
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(tuple(r) for r in Q.QUERIES["op1_bpe"](spark, SF).collect()) == sorted(want)


def test_op2_rows(spark):
    got = {r.doc_id: r for r in Q.QUERIES["op2_media"](spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for i, t in docs[["doc_id", "text"]].itertuples(index=False):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        image = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), sha(image), media.feature(payload))


def test_op9_rows(spark):
    rows = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    want = sorted((i, n, sum(b - a for a, b in zip(edges[::2], edges[1::2])), len(edges) // 2, sha(kept)) for (i, n, edges, kept), times in spans_by_force(rows, 400).items() for _ in range(times))
    assert sorted(tuple(r) for r in Q.QUERIES["op9_suffix_dedup"](spark, SF).collect()) == want


@pytest.mark.parametrize("name, module, label, cut", [("op7_toxicity", toxicity, "toxic", 0.7), ("op10_quality", quality, "quality", 0.5)])
def test_classifier_rows(spark, name, module, label, cut):
    """Of every document: its fold, a score that the model gives its text alone, and the cut."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    given = [texts[i] for i in ids]
    scores = model.score(given) if module is toxicity else model.score(np.array([quality.describe(t) for t in given]))
    want = [(i, zlib.crc32(str(i).encode()) % 3 == 1, round(float(s), 9), int(s >= cut)) for i, s in zip(ids, scores)]
    got = sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in Q.QUERIES[name](spark, LABELLED).collect())
    assert got == want


EDGES = [(1, None, "s"), (2, "", None), (None, "one two three four five six", "s"), (3, "same line\n" * 3 + "x", "s"), (3, "same line\n" * 3 + "x", "s"), (4, " \n\t", "t"), (5, "word " * 20_000, "t"), (6, "w" * 50_000, "t")]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_edges(spark, name, stage):
    """Nulls, blanks, very long texts, repeated rows, columns with the names that operators use, and no rows."""
    more = ["score", "copies", "n_lines", "n_removed", "_doc", "_k", "_source", "_size", "k", "n", "cls", "root", "rank", "spans", "_lines"]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(c) for c in more})
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, LABELLED)
        rows = out.collect()
        if name == "tokens":
            assert len(rows) == docs.count() and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
            continue
        assert out.columns == docs.columns and all(r[c] == c for r in rows for c in more)
        given = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        kept = collections.Counter((r.doc_id, r.text) for r in rows)
        if name == "lines":
            assert kept == given  # no line is spread over ten sites
        elif name == "near_duplicates":
            assert kept == collections.Counter(dict.fromkeys(given, 1))
        elif name == "mix":
            assert all(n <= 3 * given[k] for k, n in kept.items())
        else:
            assert not kept - given
