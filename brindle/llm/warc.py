"""WARC archives: writing with revisit records, and reading by verified chains of record boundaries.

``warc_archive`` is a Spark data source for writing; each task streams records
into files of about ``archive_mb``, and only files that their task committed
are listed in the folder's manifest (see ``media``).

Reading splits every file into byte ranges.  A task finds each place in its
range that looks like a record, reads the length in its header and so knows
where that record's successor would start; it emits, per such candidate, where
the chain from it leaves the range.  A candidate may lie inside a payload.  So
the chains are followed from byte 0 of each file by pointer jumping: every
round joins the links with themselves, which doubles the ranges they span, and
adds what the places reached so far lead to.  Only the places reached are then
read as records; text that looks like a record but isn't on the chain never is.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from . import media
from .shared import scratch, sized, table

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Payloads shorter than this are never stored as a revisit.
LEAST = 100
#: A header may not be longer.
HEADER = 1 << 16
RANGE_MB = 8
#: Bytes of archives that a task reads when there are many.
TASK_MB = 64
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "2000-01-01T00:00:00Z"


def clean(value: str) -> str:
    """A header's value without line ends and other control characters: percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (of page ``refers_to``) has no payload of its own but says its length and digest."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + clean(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    return MAGIC + "\r\n".join(head).encode() + END + body + END


def header(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the body, start of the successor) if a record's header starts at ``at`` of ``data``; else None."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    stop = data.find(END, at, at + HEADER)
    if stop < 0:
        return None
    fields = dict(x.partition(": ")[::2] for x in data[at + len(MAGIC) : stop].decode("utf-8", "replace").split("\r\n"))
    length = fields.get("Content-Length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return None
    body = stop + len(END)
    return fields, body, body + int(length) + len(END)


class WarcArchive(DataSource):
    """``warc_archive``, for writing rows (page_id, url, payload, digest, refers_to); options path, archive_mb (64)."""

    @classmethod
    def name(cls):
        return "warc_archive"

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


class WarcWriter(media.ArchiveWriter):
    def write(self, batches):
        fs, top = media._fs(self.uri)
        fs.create_dir(top, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    if out is None or size > self.most:
                        if out is not None:
                            out.close()
                            files[-1] += (size,)
                        files.append((f"part-{uuid.uuid4().hex}.warc",))
                        out, size = fs.open_output_stream(f"{top}/{files[-1][0]}"), 0
                    page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                    out.write(x := record(page_id, url, payload, digest, refers_to))
                    size += len(x)
        finally:
            if out is not None:
                out.close()
                files[-1] += (size,)
        return media.Done(files)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, d, refers_to) of the pages (page_id, payload) that repeat the payload, of SHA-256 d, of one with a smaller id.

    Payloads under ``least`` bytes and pages with a null id refer to nothing.
    """
    own = pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha2("payload", 256)).alias("d"))
    own = table(own, "warc-digests")
    first = own.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return own.join(first, "d").where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archive ``pages`` (page_id, url, payload binary) below ``path``: a record each.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    smallest id is a response, others revisit it.  Null payload: as empty.  Null
    url: no such field.  Rows that repeat an id and a payload share a role; with
    different payloads each has its own.  Other columns are not looked at.  An empty table writes no file.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcArchive)
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    again = table(revisits(pages, least), "warc-revisits")
    rows = pages.withColumn("d", F.unhex(F.sha2("payload", 256))).join(sized(again, 128), ["page_id", "d"], "left")
    rows = rows.select("page_id", "url", "payload", F.lower(F.hex("d")).alias("digest"), "refers_to")
    rows.write.format("warc_archive").mode("append").save(media.qualified(spark, path))


def archives(spark: SparkSession, uri: str) -> DataFrame:
    """(file, size) of every archive that the folder's manifests list."""
    fs, top = media._fs(uri)
    if not any(x.base_name.startswith(media.MANIFEST) for x in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))):
        return spark.createDataFrame([], "file string, size long")
    listed = spark.read.text(f"{uri}/{media.MANIFEST}-*").select(F.split("value", " ").alias("x"))
    return listed.select(F.concat(F.lit(top + "/"), F.col("x")[1]).alias("file"), F.col("x")[0].cast("long").alias("size")).where("size > 0")


def links(files: DataFrame, uri: str, span: int, tasks: int) -> DataFrame:
    """(file, at, to): each candidate, and the first place outside its range that the chain from it leads to."""
    plan = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))).alias("start"), "size")
    plan = plan.select("file", "start", F.least(F.col("start") + span, "size").alias("stop")).repartition(tasks, "file", "start")

    @media.lean
    def run(frames):
        fs, _ = media._fs(uri)
        for frame in frames:
            for row in frame.itertuples(index=False):
                with fs.open_input_file(row.file) as f:
                    f.seek(row.start)
                    data = f.read(row.stop - row.start + HEADER + len(MAGIC))
                found = {m.start(): got[2] for m in re.finditer(re.escape(MAGIC), data) if m.start() < row.stop - row.start and (got := header(data, m.start()))}
                leads: dict[int, int | None] = {}
                for at in sorted(found, reverse=True):
                    to = found[at]
                    leads[at] = to if to >= row.stop - row.start else leads.get(to)
                out = [(at, to) for at, to in leads.items() if to is not None]
                yield pd.DataFrame({"file": row.file, "at": [row.start + a for a, _ in out], "to": [row.start + b for _, b in out]}).astype({"at": "int64", "to": "int64"})

    return plan.mapInPandas(run, "file string, at long, to long")


def reached(files: DataFrame, uri: str, span: int, tasks: int, most: int) -> DataFrame:
    """(file, size, at): per range the place where the chain from the file's start enters it, by pointer jumping; most: ranges in a file."""
    hops = table(links(files, uri, span, tasks), "warc-links")
    here = files.select("file", "size", F.lit(0).cast("long").alias("at"))
    for _ in range(math.ceil(math.log2(max(2, most))) + 1):
        step = here.join(hops, ["file", "at"]).select("file", "size", F.col("to").alias("at"))
        here = table(here.unionByName(step).distinct(), "warc-reached")
        after = hops.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        hops = table(hops.join(after, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "warc-hops")
    return table(here.where("at < size"), "warc-entries", keep=True)


class Window:
    """Bytes of a file from any place on, read in large steps; what lies before the last place asked for is let go."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step, self.base, self.data = file, size, step, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place``, fewer at the end."""
        stop = min(self.size, place + n)
        if not self.base <= place <= self.base + len(self.data):
            self.base, self.data = place, b""
        if stop > self.base + len(self.data):
            self.file.seek(self.base + len(self.data))
            more = self.file.read(max(self.step, stop - self.base - len(self.data)))
            self.base, self.data = place, self.data[place - self.base :] + more
        return self.data[place - self.base : stop - self.base]


def read(spark: SparkSession, path: str, range_mb: float = RANGE_MB) -> DataFrame:
    """The records of all archives below ``path``: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    Length and digest are of the full payload: those of the bytes read for a
    response, which must agree with its header, those in the header for a
    revisit, whose ``payload`` is null.  A file whose chain doesn't end with the file fails the query.
    """
    uri, span = media.qualified(spark, path), max(1, int(range_mb * (1 << 20)))
    files = table(archives(spark, uri), "warc-files")
    count, total, largest = files.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    ranges = F.ceil(F.col("size") / span)
    # a range a task for small archives, TASK_MB a task for large ones
    tasks = min(files.agg(F.sum(ranges)).first()[0], max(4 * spark.sparkContext.defaultParallelism, math.ceil(total / (TASK_MB << 20))))
    with scratch(spark):
        entries = reached(files, uri, span, tasks, math.ceil(largest / span))
    # a count that is stated: the places are few bytes, what they stand for isn't
    at = entries.repartition(tasks, "file", "at")
    def number(x):
        found = re.search(r"-?[0-9]+", x or "")
        return int(found[0]) if found else None

    @media.lean
    def run(batches):
        fs, _ = media._fs(uri)
        for batch in batches:
            for row in batch.to_pylist():
                place, stop, out, held = row["at"], min((row["at"] // span + 1) * span, row["size"]), [], 0
                with fs.open_input_file(row["file"]) as f:
                    window = Window(f, row["size"])
                    while place < stop:
                        data = window.at(place, HEADER)
                        got = header(data, 0)
                        if not got or place + got[2] > row["size"]:
                            raise ValueError(f"no whole record at byte {place} of {row['file']}")
                        fields, a, b = got
                        data = window.at(place, b) if b > len(data) else data
                        body, revisit = data[a : b - len(END)], fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                        if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:") or data[b - len(END) : b] != END:
                            raise ValueError(f"damaged record at byte {place} of {row['file']}")
                        out.append((number(fields.get("X-Page-Id")), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), int(fields["X-Payload-Length"]) if revisit else len(body), digest, None if revisit else body))
                        place, held = place + b, held + len(body)
                        if held > media.BATCH:
                            yield _batch(out)
                            out, held = [], 0
                if out:
                    yield _batch(out)

    return at.select("file", "at", "size").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
