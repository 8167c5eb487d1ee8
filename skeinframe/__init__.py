"""Typed, lazy and eager dataframes on Apache Spark."""

from .operators.eager import DataFrame, Series, concat
from .operators.frame import LazyFrame
from .plans import dtypes, selectors
from .plans.expr import Expr, coalesce, col, len_, lit, struct, when
from .sources.readers import read_ipc_stream, read_json, scan_csv, scan_ipc, scan_ndjson, scan_parquet
from .sql import SqlContext

__all__ = [
    "DataFrame", "Expr", "LazyFrame", "Series", "SqlContext", "capabilities", "coalesce", "col", "concat", "diagnostics", "dtypes", "len_", "lit", "read_ipc_stream", "read_json", "scan_csv",
    "scan_ipc", "scan_ndjson", "scan_parquet", "selectors", "struct", "when",
]


def capabilities() -> dict[str, list[str]]:
    """The names of the operations that expressions, aggregates and namespaces have."""
    from .functions.compiler import RULES, SIGNATURES
    from .plans.expr import AGGREGATES, BINARY, UNARY

    return {"functions": sorted(set(RULES) - set(SIGNATURES)), "namespaces": sorted(SIGNATURES), "aggregates": sorted(AGGREGATES), "unary": sorted(UNARY), "binary": sorted(BINARY)}


def diagnostics(spark) -> dict[str, int]:
    """Live work of the session: cached frames, background jobs, and Spark jobs and stages that run now."""
    from .streaming import jobs

    status = spark.sparkContext.statusTracker()
    cached = spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
    return {"cached_frames": int(cached), "background_jobs": jobs.active(), "spark_jobs": len(status.getActiveJobsIds()), "spark_stages": len(status.getActiveStageIds())}
