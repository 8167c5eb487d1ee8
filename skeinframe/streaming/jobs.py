"""Background collection: at most 64 jobs, each with a Spark tag by which it can be cancelled."""

from __future__ import annotations

import threading
import time
import uuid

from ..errors import Cancelled, ComputeError, InvalidRequest, IoError, SkeinError

MOST = 64
_slots = threading.BoundedSemaphore(MOST)
_running = threading.Lock()
_count = 0


def active() -> int:
    """Jobs that run now."""
    return _count


def _changed(by: int) -> None:
    global _count
    with _running:
        _count += by


def guarded(f):
    """Spark's failures as the library's errors."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        return f()
    except SkeinError:
        raise
    except AnalysisException as e:
        raise (IoError if "PATH_NOT_FOUND" in str(e) else InvalidRequest)(str(e)) from e
    except (PySparkException, OSError) as e:
        raise (IoError if isinstance(e, OSError) or "FileNotFound" in str(e) else ComputeError)(str(e)) from e


class Job:
    """A collection in the background: poll, wait, cancel, and take once."""

    def __init__(self, lazy):
        from pyspark import InheritableThread

        if not _slots.acquire(blocking=False):
            raise InvalidRequest(f"{MOST} jobs are active")
        self._lazy, self._tag = lazy, f"skein-{uuid.uuid4().hex}"
        self._state, self._result, self._error = "running", None, None
        _changed(1)
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self):
        spark = self._lazy.spark
        try:
            spark.addTag(self._tag)
            self._result = self._lazy.collect()
            self._state = "complete" if self._state == "running" else "cancelled"
        except Exception as e:
            self._error = e
            self._state = "cancelled" if self._state == "cancelling" else "failed"
        finally:
            spark.removeTag(self._tag)
            _changed(-1)
            _slots.release()

    def poll(self) -> str:
        """running, cancelling, complete, cancelled, failed or taken."""
        return self._state

    def cancel(self) -> None:
        if self._state == "running":
            self._state = "cancelling"
            self._lazy.spark.interruptTag(self._tag)

    def wait(self, timeout: float | None = None) -> str:
        self._thread.join(timeout)
        return self._state

    def take(self):
        """The frame; only once."""
        self.wait()
        if self._state == "cancelled":
            raise Cancelled("the job was cancelled")
        if self._state == "failed":
            raise self._error
        if self._state == "taken":
            raise InvalidRequest("the result was taken")
        self._state, result, self._result = "taken", self._result, None
        return result


def profile(lazy):
    """(frame, timings): timings of plan, run as (node, start, end) in microseconds."""
    start = time.perf_counter()
    lazy._plain._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    frame = lazy.collect()
    done = time.perf_counter()
    us = lambda t: int((t - start) * 1e6)
    return frame, lazy.spark.createDataFrame([("optimize", 0, us(planned)), ("execute", us(planned), us(done))], "node string, start long, end long")
