"""Versioned rows on immutable Parquet: snapshots, pending changes, commits.

A version is a list of files, each with the files of keys that were removed
from it since.  A transaction's changes to a relation are the files of added
rows and of removed keys; what it sees is its snapshot without the removed
keys, and the added rows.  Committing appends the added files and notes the
removed keys: what a change writes follows the rows it changes.  A version of
many files is written anew.  Keys stay in files and are compared by joins,
however many there are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import TxnConflict
from .catalog import Part, Relation

#: Bytes of a part's files for each file of its index, about.
INDEX_BYTES = 128 << 20
#: Files of a version, those of removed keys included, beyond which the next commit rewrites it as one.
MOST_FILES = 8


@dataclass
class Pending:
    """A transaction's changes to one relation."""

    base: int  # the version they were made against
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)


def changed(parts: tuple[Part, ...], own: Pending | None) -> tuple[Part, ...]:
    """A version's parts under a transaction's changes, whose removed keys don't concern the rows it adds."""
    if not own:
        return parts
    return (*(Part(p.path, (*p.gone, *own.removed)) for p in parts), *map(Part, own.added))


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.pending: list[dict[str, Pending]] = []  # of all open transactions

    def write(self, df: DataFrame, rel: Relation | None = None) -> str:
        """The path of ``df``'s rows; ``rel``: they are rows or keys of that relation."""
        path = f"{self.folder.rstrip('/')}/brindle-rows/{uuid.uuid4().hex}"
        (rel.stored(df) if rel else df).write.parquet(path)
        return path

    def sizes(self, paths) -> list[int]:
        """Bytes of each data file below the paths."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            out += [x.getLen() for x in path.getFileSystem(conf).listStatus(path) if x.getPath().getName().startswith("part-")]
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def keys(self, rel: Relation, files) -> DataFrame:
        schema = T.StructType([T.StructField(rel.columns[0].stored, rel.columns[0].kind.spark)])
        return (self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)).toDF(rel.key)

    def seen(self, rel: Relation, version: int, own: Pending | None) -> DataFrame:
        """The rows of a version under a transaction's own changes."""
        if rel.view is not None:
            return rel.view
        return self.rows(rel, changed(rel.versions[version], own))

    def rows(self, rel: Relation, parts: tuple[Part, ...], read=None) -> DataFrame:
        """The rows of parts; those that lost the same keys are read together.  ``read``: from paths to their rows, or to some columns with the key."""
        read = read or (lambda paths: rel.read(self.spark, paths))
        by_gone: dict[tuple[str, ...], list[str]] = {}
        for p in parts:
            by_gone.setdefault(p.gone, []).append(p.path)
        frames = []
        for gone, paths in by_gone.items():
            df = read(tuple(paths))
            # repeated keys do no harm to an anti join, and keys reach Spark with their files' sizes
            frames.append(df.join(self.keys(rel, gone), rel.key, "left_anti").select(*df.columns) if gone else df)
        return reduce(DataFrame.unionByName, frames) if frames else read(())

    def index(self, rel: Relation) -> None:
        """Write what the relation's indexes lack: for every part of the newest version the index's columns, sorted, so that bounds skip row groups."""
        for name, by in rel.indexes.items():
            for p in rel.versions[-1]:
                if (name, p.path) not in rel.sorted_paths:
                    n = 1 + sum(self.sizes([p.path])) // INDEX_BYTES
                    df = rel.read(self.spark, (p.path,), rel.indexed(name))
                    # by the key too, which parts the rows of a frequent value
                    rel.sorted_paths[name, p.path] = self.write(df.repartitionByRange(n, *by, rel.key).sortWithinPartitions(*by, rel.key), rel)

    def through(self, rel: Relation, index: str, version: int, own: Pending | None) -> DataFrame:
        """The index's columns of the rows that ``seen`` gives; parts that it lacks are read themselves."""
        paths = lambda found: tuple(rel.sorted_paths.get((index, p), p) for p in found)
        return self.rows(rel, changed(rel.versions[version], own), lambda found: rel.read(self.spark, paths(found), rel.indexed(index)))

    def used_keys(self, rel: Relation, own: Pending | None) -> DataFrame:
        """Keys that can't be used again: of live rows and of deleted ones."""
        live = self.seen(rel, len(rel.versions) - 1, own).select(rel.key)
        dead = self.keys(rel, [*rel.dead[-1], *(own.dead if own else ())])
        return live.unionByName(dead)

    def added_elsewhere(self, rel: Relation, own: dict) -> DataFrame:
        """Keys of rows that other open transactions are adding."""
        name = rel.name.lower()
        return self.keys(rel, [f for p in self.pending if p is not own and name in p for f in p[name].added])

    def conflicts(self, rel: Relation, keys: DataFrame, snapshot: int, own: dict) -> None:
        """First updater wins: keys changed since the snapshot, or being changed by an open transaction, are refused."""
        name = rel.name.lower()
        files = [f for w in rel.written[snapshot + 1 :] for f in (w or ())]
        for other in self.pending:
            if other is not own and name in other:
                files += other[name].removed
        if files:
            hit = keys.join(self.keys(rel, files), rel.key, "left_semi").first()
            if hit:
                raise TxnConflict(f"row id={hit[0]} was written by another transaction")

    def commit(self, relations: dict[str, Relation], changes: dict[str, Pending]) -> None:
        for name, p in changes.items():
            rel = relations.get(name)
            if rel is None or not (p.added or p.removed):
                continue
            newest = rel.versions[-1]
            parts = changed(newest, p)
            if rel.mode == "explicit" and p.added and len(rel.versions) - 1 > p.base:
                # others have committed since: the keys must still be new
                taken = rel.read(self.spark, tuple(p.added)).select(rel.key).join(self.keys(rel, p.removed), rel.key, "left_anti")
                taken = taken.join(self.rows(rel, newest).select(rel.key), rel.key, "left_semi").first()
                if taken:
                    raise TxnConflict(f"row id={taken[0]} was added by another transaction")
            if len(parts) + len({g for x in parts for g in x.gone}) > MOST_FILES:
                parts = (Part(self.write(self.rows(rel, parts), rel)),)
            rel.versions.append(parts)
            rel.dead.append((*rel.dead[-1], *p.dead))
            rel.written.append(tuple(p.removed))
            self.index(rel)
