"""What several operators need: shared scratch tables, sized broadcasts, row slices."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

#: Rows' keys and values up to this many bytes may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


#: Rows in an Arrow batch to a Python worker, at most: documents are long, and JVM and worker both hold a batch.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """What the queries want of a session: the package on the workers, and batches of few rows unless the session says otherwise."""
    ship(spark)
    if spark.conf.get(key := "spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set(key, BATCH_ROWS)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and Spark runs in this one process (tests) a temporary folder is made, and
    removed at exit; elsewhere its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext.getCheckpointDir()
        if got:
            return got
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls get the same."""
    return f"{scratch_root(spark).rstrip('/')}/brindle/{name}-{uuid.uuid4().hex}"


#: Paths of the tables made in the ``scratch`` blocks that are open, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    ``keep``: the innermost ``scratch`` block leaves it to the next one outside.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if blocks := _OPEN.get()[: -1 if keep else None]:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Scratch tables made in the block are removed at its end, but for those to keep: what is returned mustn't read them."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        remove(spark, own)


def remove(spark: SparkSession, paths) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of scratch tables that no later step reads."""
    remove(spark, {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})


def sized(small: DataFrame, bytes_per_row: int, rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if its counted size stays under BROADCAST_BYTES, else as it is.

    Call it on a scratch table, whose count is read from file footers.
    """
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n * bytes_per_row <= BROADCAST_BYTES else small


def pieces(sizes, most: int):
    """(start, stop) ranges of rows of about ``most`` bytes together, at least a row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def lean(run):
    """``run`` (batches -> batches) for a Python worker, which gives freed memory back when a task ends: workers are used again."""

    @wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# ---- 64-bit names of strings.  No step is linear in the bytes, so regular texts (Thue-Morse words, say) don't collide.
_U = np.uint64
_MULT, _STIR = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them; overwrites ``x``."""
    x ^= x >> _U(32)
    x *= _STIR
    x ^= x >> _U(29)
    x *= _MULT
    x ^= x >> _U(32)
    return x


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of a string from those of its two parts, in order."""
    out = x * _MULT
    out += y
    return stir(out)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from every position as a number; those beyond the end are 0."""
    n = len(data)
    return np.ndarray((n,), "<u8", data + bytes(8), strides=(1,)) if n else np.empty(0, _U)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as ``df`` needs to have no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def split_mod(doc_id) -> "F.Column":
    """crc32 of doc_id as text, modulo 3; rows where it is 1 are held out from all fitting (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3
