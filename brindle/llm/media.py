"""Media columns: payloads as 8-bit grey images in archives that Spark reads by byte range.

``MediaArchive`` is a Spark data source, ``media_archive``.  Writing, each task
streams its rows into ZIP archives of about ``archive_mb`` below a folder; an
archive counts only once its task has committed, when the driver lists it in
the folder's manifest, so retried and speculative tasks leave no duplicates.
Reading, the driver lists archives and sizes alone and plans byte ranges over
them; a task opens an archive's central directory, takes the members whose
headers start in its range and streams them as Arrow batches.  A member that
can't be read is tried again by itself, from its own offset, on a newly opened
file.  Members are stored, not deflated (images are compressed already), so
each is one contiguous range.

The image: PNG, 8-bit grey, 64 samples wide, one filter byte of 0 a line.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import lean, pieces

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 4
#: Payload bytes in an Arrow batch, about.
BATCH = 4 << 20
MANIFEST = "manifest"


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image whose samples are ``payload``, a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; ValueError if it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, height, data = 8, 0, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of the expected width")
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that to_png doesn't use")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and range of the samples, mean step between neighbours and a histogram of 8 bins in per mille."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};sd={x.std():.4f};min={x.min()};max={x.max()};step={step:.4f};hist=" + ",".join(map(str, bins))


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


def committed(uri: str) -> list:
    """What the folder's manifests list: path and size of each archive."""
    fs, top = _fs(uri)
    found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))
    listed = set()
    for x in found:
        if x.base_name.startswith(MANIFEST):
            with fs.open_input_stream(x.path) as f:
                listed |= {x.partition(" ")[2] for x in f.read().decode().splitlines()}
    return sorted((x for x in found if x.base_name in listed), key=lambda x: x.path)


@dataclass
class Done(WriterCommitMessage):
    files: list


@dataclass
class Span(InputPartition):
    def __init__(self, uri: str, start: int, stop: int):
        self.uri, self.start, self.stop = uri, start, stop


class MediaArchive(DataSource):
    """``media_archive``: rows (key string, media binary) in ZIP archives.

    Options: path (a URI), archive_mb (64), range_mb (16), retries (3).  A null
    key or media is read back as null; repeated keys stay separate members; an
    empty table makes no archive and reads as no rows.
    """

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return T.StructType([T.StructField("key", T.StringType()), T.StructField("media", T.BinaryType())])

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.uri, self.most = options["path"], int(options.get("archive_mb", 64)) << 20

    def write(self, batches):
        fs, top = _fs(self.uri)
        fs.create_dir(top, recursive=True)
        files, out, archive, size, n = [], None, None, 0, 0
        try:
            for batch in batches:
                for key, media in zip(batch.column("key"), batch.column("media")):
                    if archive is None or size > self.most:
                        if archive is not None:
                            archive.close()
                            files[-1] += (out.tell(),)
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.zip"
                        files.append((name,))
                        out = fs.open_output_stream(f"{top}/{name}")
                        archive, size, n = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0, 0
                    key, media = key.as_py(), media.as_buffer() if media.is_valid else None
                    # the name: a number that is unique in the archive, marks for nulls, the key
                    name = f"{n:08d}{'-' if media is None else '+'}" + ("" if key is None else "=" + key)
                    archive.writestr(zipfile.ZipInfo(name), b"" if media is None else memoryview(media))
                    size += 0 if media is None else media.size
                    n += 1
        finally:
            if archive is not None:
                archive.close()
                files[-1] += (out.tell(),)
                out.close()
        return Done(files)

    def commit(self, messages):
        fs, top = _fs(self.uri)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{MANIFEST}-{uuid.uuid4().hex}") as f:
            f.write("".join(f"{size} {name}\n" for m in messages if m for name, size in m.files).encode())

    def abort(self, messages):
        fs, top = _fs(self.uri)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{top}/{x[0]}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.span, self.retries = options["path"], int(options.get("range_mb", 16)) << 20, int(options.get("retries", 3))

    def partitions(self):
        return [Span(x.path, a, min(a + self.span, x.size)) for x in committed(self.uri) for a in range(0, x.size, self.span)] or [Span("", 0, 0)]

    def member(self, fs, path: str, info: zipfile.ZipInfo, f=None) -> bytes:
        """A member's bytes, checked against its CRC, from the open file ``f`` if there is one; retried by itself, from its offset, on a newly opened file."""
        for tried in range(self.retries + 1):
            try:
                if f is not None and not tried:
                    return self._bytes(f, path, info)
                with fs.open_input_file(path) as again:
                    return self._bytes(again, path, info)
            except OSError:
                if tried == self.retries:
                    raise
                time.sleep(0.1 * 2**tried)
        raise AssertionError

    def _bytes(self, f, path: str, info: zipfile.ZipInfo) -> bytes:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {info.header_offset} of {path}")
        f.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
        data = f.read(info.file_size)
        if zlib.crc32(data) != info.CRC:
            raise OSError(f"damaged member at {info.header_offset} of {path}")
        return data

    def read(self, span):
        if not span.uri:
            return
        fs, _ = _fs(self.uri)
        with fs.open_input_file(span.uri) as f:
            with zipfile.ZipFile(f) as archive:
                own = [x for x in archive.infolist() if span.start <= x.header_offset < span.stop]
            for a, b in pieces([x.file_size for x in own], BATCH):
                keys, media = [], []
                for x in own[a:b]:
                    mark, key = x.filename[8], x.filename[9:]
                    keys.append(key[1:] if key else None)
                    media.append(None if mark == "-" else self.member(fs, span.uri, x, f))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary())], ["key", "media"])


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, for readers outside the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def images(df: DataFrame, data: str, key: str) -> DataFrame:
    """(key, media): column ``data`` (string as UTF-8, or binary; null as empty), padded, as an image.

    A text of any length is one image, made by itself; repeated rows make
    repeated images; an empty table stays empty; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts, keys = batch.column("media"), batch.column("key")
            for a, b in pieces([len(x.as_buffer()) if x.is_valid else 0 for x in texts], BATCH):
                out = pa.array([to_png(pad(x or b"")) for x in texts[a:b].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([keys[a:b], out], ["key", "media"])

    kinds = T.StructType([T.StructField("key", T.StringType()), T.StructField("media", T.BinaryType())])
    return df.select(F.col(key).cast("string").alias("key"), F.col(data).cast("binary").alias("media")).mapInArrow(run, kinds)


def write(df: DataFrame, path: str) -> None:
    """Store (key, media) rows in archives below ``path``."""
    spark = df.sparkSession
    spark.dataSource.register(MediaArchive)
    df.write.format("media_archive").mode("append").save(qualified(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, media) of every member of every committed archive below ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(qualified(spark, path))


def features(media: DataFrame) -> DataFrame:
    """(key, media, payload, feature): the stored image, its samples and what ``feature`` says of them.

    Row by row: equal images get equal features, repeated rows repeat, an empty
    table stays empty, other columns are left out.  A null or damaged image fails the query.
    """

    def run(batches):
        for batch in batches:
            for a, b in pieces([len(x.as_buffer()) for x in batch.column("media")], BATCH // 4):
                part = batch.slice(a, b - a)
                payloads = [from_png(x) for x in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("media"), pa.array(payloads, pa.binary()), pa.array([feature(x) for x in payloads])], ["key", "media", "payload", "feature"])

    return media.select("key", "media").mapInArrow(run, "key string, media binary, payload binary, feature string")
