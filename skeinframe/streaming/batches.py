"""Bounded pull streams: a producer thread fills a queue of a fixed number of Arrow batches."""

from __future__ import annotations

import queue
import threading
import uuid

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import Cancelled, require
from ..functions.compiler import RID

_END = object()


def _packed(batches):
    """Each Arrow batch of a task as one binary value, so that the driver gets batches and not rows."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def _one(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


class BatchStream:
    """Batches of ``batch_rows`` rows in row order; at most ``capacity`` wait, then the producer does."""

    def __init__(self, lazy, batch_rows: int = 65_536, capacity: int = 2):
        from pyspark import InheritableThread

        require(1 <= batch_rows <= 10_000_000, "batch_rows is 1 to 10000000")
        require(1 <= capacity <= 64, "capacity is 1 to 64")
        self._lazy, self._rows, self._queue = lazy, batch_rows, queue.Queue(capacity)
        self._stop, self._tag, self._error, self._done = threading.Event(), f"skein-{uuid.uuid4().hex}", None, False
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _put(self, item) -> None:
        while not self._stop.is_set():
            try:
                return self._queue.put(item, timeout=0.05)
            except queue.Full:
                continue

    def _run(self):
        df = self._lazy._df
        df = df.orderBy(RID).drop(RID) if RID in df.columns else df
        schema = to_arrow_schema(df.schema)
        try:
            self._lazy.spark.addTag(self._tag)
            held, rows = [], 0
            for row in df.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
                for batch in pa.ipc.open_stream(row[0]):
                    held.append(pa.Table.from_batches([batch]).cast(schema))
                    rows += batch.num_rows
                while rows >= self._rows:
                    whole = pa.concat_tables(held)
                    self._put(_one(whole.slice(0, self._rows)))
                    held, rows = [whole.slice(self._rows)], rows - self._rows
                if self._stop.is_set():
                    return
            if rows:
                self._put(_one(pa.concat_tables(held)))
        except Exception as e:
            self._error = e
        finally:
            self._lazy.spark.removeTag(self._tag)
            self._put(_END)

    def poll(self):
        """(state, batch): pending, batch, complete or cancelled."""
        if self._stop.is_set():
            return "cancelled", None
        if self._done:
            return "complete", None
        try:
            item = self._queue.get_nowait()
        except queue.Empty:
            return "pending", None
        if item is _END:
            self._done = True
            if self._error:
                raise self._error
            return "complete", None
        return "batch", item

    def __iter__(self):
        while not self._done:
            if self._stop.is_set():
                raise Cancelled("the stream was cancelled")
            item = self._queue.get()
            if item is _END:
                self._done = True
                if self._error:
                    raise self._error
                return
            yield item

    def cancel(self) -> None:
        self._stop.set()
        self._lazy.spark.interruptTag(self._tag)
