"""Sequenced loads: chunks in order, each once, all or nothing; and the same from a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, ResourceExhausted
from ..functions.types import KEY_MAX, TEXT_MAX
from ..session import Session

#: Bytes of a chunk, and chunks in flight.
CHUNK_BYTES, WINDOW = 256 << 10, 4


class Load:
    """Chunks of rows for one relation in one transaction: ``chunk`` with 1, 2, ...; then ``end`` or ``abort``."""

    def __init__(self, session: Session, table: str):
        if session.open is not None:
            raise InvalidArgument("a load is a transaction of its own")
        self.session, self.rel, self.seq, self.rows = session, session.writable(table, 0), 0, 0
        session.execute("BEGIN")

    def chunk(self, seq: int, rows: list[list]) -> int:
        """The number of rows loaded so far.  A chunk sent again is taken for the same; one out of turn ends the load."""
        if seq <= self.seq:
            return self.rows
        if seq != self.seq + 1:
            self.abort()
            raise InvalidArgument(f"chunk {seq} after chunk {self.seq}")
        if sum(len(str(v)) for r in rows for v in r) > CHUNK_BYTES:
            self.abort()
            raise ResourceExhausted(f"a chunk holds {CHUNK_BYTES} bytes at most")
        try:
            self.session.insert_rows(self.rel, rows)
        except BaseException:
            self.abort()
            raise
        self.seq, self.rows = seq, self.rows + len(rows)
        return self.rows

    def end(self) -> int:
        self.session.execute("COMMIT")
        return self.rows

    def abort(self) -> None:
        self.session.poisoned = False
        if self.session.open is not None:
            self.session.execute("ROLLBACK")


def from_stream(stream: DataFrame, session: Session, table: str, checkpoint: str):
    """A streaming query that appends each micro-batch to an EXPLICIT relation, a transaction a batch.

    A batch that is replayed after a failure, or after the query was started
    again, is known by its checkpoint and id, which the relation keeps beside
    the rows, and is not applied twice.  Keys, NULLs and texts are held to what INSERT asks of them.
    """
    rel = session.writable(table, 0)
    if rel.mode != "explicit":
        raise InvalidArgument(f"'{table}' assigns its keys; a stream brings them")

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= rel.batches.get(checkpoint, -1):
            return
        rows = batch.select(*(batch[c.name].cast(c.kind.spark).alias(c.name) for c in rel.columns))
        key = F.col(rel.key)
        wrong = [key.isNull() | ~key.between(1, KEY_MAX)]
        wrong += [F.col(c.name).isNull() for c in rel.columns[1:] if not c.nullable]
        wrong += [F.octet_length(c.name) > TEXT_MAX for c in rel.columns if c.kind.name == "varchar"]
        bad = rows.where(reduce(lambda a, b: a | b, (F.coalesce(w, F.lit(False)) for w in wrong))).first()
        if bad:
            raise InvalidArgument(f"row {bad[0]} of batch {batch_id} doesn't fit '{table}'")
        session.change(rel, lambda own: session.insert_frame(rel, rows, own))
        rel.batches[checkpoint] = batch_id

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
