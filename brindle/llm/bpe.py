"""Byte-level BPE encoding and decoding.

The merges are those of a local rank file, applied by tiktoken.  Texts longer
than ``CHUNK`` characters are cut first, where no match of the pattern can
reach across: between a character that isn't white space and a space or line
feed.  (Every match that holds a visible character ends with the last visible
character it holds, and no alternative looks behind.)  A stretch without such a
place, such as one huge word or run of blanks, is split into its matches by the
``regex`` module instead and each match is merged by itself.  So neither the
regex engine's backtracking nor its stack sees a long text.

Decoding works on raw bytes: ids need not form whole characters.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import os
import shutil
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import lean, pieces

#: Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 15
#: A piece that came out longer than this holds a stretch without a safe boundary.
STRETCH = 4 * CHUNK
#: Bytes of text taken from an Arrow batch at a time; bounds a worker's memory.
SLICE = 1 << 20
#: Ids decoded together.
PART = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes texts to ids and ids to bytes; made once per Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.match = regex.compile(pattern)
        self.safe = regex.compile(r"[^\s\x1c-\x1f][ \n]")

    def cuts(self, text: str) -> list[str]:
        """``text`` in parts that can be encoded apart."""
        out, at = [], 0
        while len(text) - at > CHUNK:
            found = self.safe.search(text, at + CHUNK)
            if not found:
                break
            out.append(text[at : found.end() - 1])
            at = found.end() - 1
        out.append(text[at:])
        return out

    def part(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as uint32; null is as empty."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= CHUNK:
            return self.part(text)
        out = []
        for x in self.cuts(text):
            if len(x) <= STRETCH:
                out.append(self.part(x))
            else:
                out += [np.array(self.encoding._encode_single_piece(m.group().encode()), np.uint32) for m in self.match.finditer(x)]
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.encoding.decode_bytes(ids[a : a + PART].tolist()) for a in range(0, len(ids), PART))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(SparkFiles.get(path), pattern)


def local(spark: SparkSession, ranks: str) -> str:
    """Send the rank file to the executors, once an application; the name by which a worker finds it."""
    sent = spark.sparkContext.__dict__.setdefault("_brindle_ranks", {})
    if ranks not in sent:
        name = f"{hashlib.sha256(ranks.encode()).hexdigest()[:16]}-{os.path.basename(ranks)}"
        copy = os.path.join(tempfile.mkdtemp(prefix="brindle-ranks-"), name)  # addFile tells files apart by their last name
        shutil.copyfile(ranks, copy)
        spark.sparkContext.addFile(copy)
        atexit.register(shutil.rmtree, os.path.dirname(copy), ignore_errors=True)  # the driver serves it till then
        sent[ranks] = name
    return sent[ranks]


def _with(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    """The schema of ``df`` with these columns put last (replaced if there)."""
    names = [n for n, _ in added]
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(*x) for x in added)])


def _put(batch: pa.RecordBatch, name: str, column) -> pa.RecordBatch:
    rest = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), column], [*rest, name])


def _encoded(batches, own: Codec, text: str, out: str):
    for batch in batches:
        texts = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for a, b in pieces(sizes, SLICE):
            ids = [own.encode(x) for x in texts[a:b].to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield _put(batch.slice(a, b - a), out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))


def _decoded(batches, own: Codec, ids: str, out: str):
    for batch in batches:
        lists = batch.column(ids)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()
        for a, b in pieces(sizes, SLICE // 4):
            decoded = [own.decode(x.values.to_numpy()) if x.is_valid else b"" for x in lists[a:b]]
            yield _put(batch.slice(a, b - a), out, pa.array(decoded, pa.binary()))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each whole text as array<int> in column ``out``.

    Null and empty texts give an empty array; a column named like ``out`` is
    replaced, all others pass through; every row is encoded by itself, so
    repeated rows repeat and an empty table stays empty.
    """
    path = local(df.sparkSession, ranks)
    return df.mapInArrow(lean(lambda batches: _encoded(batches, codec(path, pattern), text, out)), _with(df, (out, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of ids stands for, as binary in column ``out``.

    A null array gives empty bytes.  Bytes, not text: ids cut inside a
    character still decode.  An id outside the rank file, or a null one, fails
    the query.  A column named like ``out`` is replaced, all others pass
    through; repeated rows repeat; an array of any length is decoded in parts; an empty table stays empty.
    """
    path = local(df.sparkSession, ranks)
    return df.mapInArrow(lean(lambda batches: _decoded(batches, codec(path, pattern), ids, out)), _with(df, (out, T.BinaryType())))


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """What ``decode`` makes of what ``encode`` makes of ``df``, in one pass through one worker."""
    path = local(df.sparkSession, ranks)

    def run(batches):
        own = codec(path, pattern)
        return _decoded(_encoded(batches, own, text, ids), own, ids, out)

    return df.mapInArrow(lean(run), _with(df, (ids, T.ArrayType(T.IntegerType())), (out, T.BinaryType())))
