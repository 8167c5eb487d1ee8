"""SQL over registered frames: temporary views in a session of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import require
from .operators.eager import DataFrame
from .operators.frame import LazyFrame


class SqlContext:
    """A mutable set of named frames; ``execute`` gives a lazy frame, which stays valid afterwards."""

    def __init__(self, spark: SparkSession):
        self._session, self._names = spark.newSession(), {}

    def register(self, name: str, frame: LazyFrame | DataFrame) -> "SqlContext":
        lazy = frame._lazy if isinstance(frame, DataFrame) else frame
        # a view belongs to the session that made its plan: rebind the same logical plan to ours
        jdf = self._session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self._session._jsparkSession, lazy._plain._jdf.queryExecution().logical())
        jdf.createOrReplaceTempView(name)
        self._names[name] = lazy
        return self

    def register_all(self, frames: dict) -> "SqlContext":
        require(len(frames) <= 10_000, "at most 10000 frames at once")
        for name, frame in frames.items():
            self.register(name, frame)
        return self

    def unregister(self, *names: str) -> "SqlContext":
        for n in names:
            self._session.catalog.dropTempView(n)
            self._names.pop(n, None)
        return self

    def tables(self) -> list[str]:
        return sorted(self._names)

    def execute(self, query: str) -> LazyFrame:
        return LazyFrame(self._session.sql(query))
