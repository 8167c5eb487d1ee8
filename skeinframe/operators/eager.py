"""Materialised frames and columns.

A ``DataFrame`` is a LazyFrame whose rows have an order column and are cached by
Spark (memory and disk); lost cache blocks are computed again from the plan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import InvalidRequest, require
from ..functions.compiler import RID, quoted
from ..plans.expr import as_expr, col
from .frame import LazyFrame, _numbered


class DataFrame:
    """A frame whose rows are computed and ordered."""

    def __init__(self, lazy: LazyFrame):
        self._lazy = lazy

    @classmethod
    def materialised(cls, lazy: LazyFrame) -> "DataFrame":
        df = lazy._with_order()._df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return cls(LazyFrame(df))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table) -> "DataFrame":
        if not table.num_columns:
            return cls(LazyFrame(spark.range(table.num_rows).select(F.col("id").alias(RID))))
        rid = pa.array(range(table.num_rows), pa.int64())
        table = table.append_column(RID, rid)
        # Times without a zone stay without one.
        return cls(LazyFrame(spark.createDataFrame(table, from_arrow_schema(table.schema, prefer_timestamp_ntz=True))))

    def lazy(self) -> LazyFrame:
        return self._lazy

    @property
    def schema(self): return self._lazy.schema  # noqa: E704
    @property
    def columns(self): return self._lazy.columns  # noqa: E704
    @property
    def width(self) -> int: return len(self.columns)  # noqa: E704
    @property
    def height(self) -> int: return self._lazy._df.count()  # noqa: E704
    @property
    def shape(self) -> tuple[int, int]: return self.height, self.width  # noqa: E704

    def to_arrow(self) -> pa.Table:
        return self._lazy._with_order()._df.orderBy(RID).drop(RID).toArrow()

    def to_dicts(self) -> list[dict]:
        return self.to_arrow().to_pylist() if self.width else [{}] * self.height

    def to_reader(self, max_rows: int = 65_536) -> pa.RecordBatchReader:
        """Sliced batches, for Arrow's C stream interface."""
        table = self.to_arrow()
        return pa.RecordBatchReader.from_batches(table.schema, table.to_batches(max_chunksize=max_rows))

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_reader().__arrow_c_stream__(requested_schema)

    def column(self, name: str) -> "Series":
        require(name in self.columns, f"no column {name}")
        return Series(self._lazy._with_order()._df.select(quoted(name), RID))

    def filter_mask(self, mask: "Series") -> "DataFrame":
        rows = _numbered(self._lazy._with_order()._df).join(mask._placed("__mask"), "__at").filter("__mask").drop("__mask", "__at")
        return DataFrame(LazyFrame(rows))

    def select_columns(self, *names: str) -> "DataFrame":
        return DataFrame(self._lazy.select(*names))

    def transpose(self, include_header: bool = False, header_name: str = "column", column_names: list[str] | None = None) -> "DataFrame":
        """For frames that fit the driver."""
        table = self.to_arrow()
        names = column_names or [f"column_{i}" for i in range(table.num_rows)]
        require(len(names) == table.num_rows, "one name for each row")
        kind = table.schema.field(0).type
        for f in table.schema:
            if f.type != kind:
                kind = pa.string() if pa.types.is_string(f.type) or pa.types.is_string(kind) else pa.float64()
        columns = [c.cast(kind).to_pylist() for c in table.columns]
        out = {header_name: pa.array(table.column_names)} if include_header else {}
        out |= {n: pa.array([c[i] for c in columns], kind) for i, n in enumerate(names)}
        return DataFrame.from_arrow(self._lazy.spark, pa.table(out))

    def reverse(self) -> "DataFrame":
        return DataFrame(self._lazy.reverse())

    def head(self, n: int = 5) -> "DataFrame":
        return self.slice(0, n)

    def tail(self, n: int = 5) -> "DataFrame":
        return DataFrame(self._lazy.tail(n))

    def slice(self, offset: int, length: int | None = None) -> "DataFrame":
        return DataFrame(LazyFrame(self._lazy._with_order()._df.orderBy(RID)).slice(offset, length))

    def __getattr__(self, name: str):
        """The eager twins of lazy operations."""
        if name in ("select", "with_columns", "filter", "sort", "distinct", "drop_nulls", "explode", "unnest", "unpivot", "drop", "rename", "join", "with_row_number"):
            def twin(*args, **kwargs):
                args = [a._lazy if isinstance(a, DataFrame) else a for a in args]
                return DataFrame(getattr(self._lazy, name)(*args, **kwargs))

            return twin
        if name.startswith("write_"):
            from ..sources import writers

            return lambda path, **options: getattr(writers, name)(self._lazy._with_order(), path, **options)
        raise AttributeError(name)


class Series:
    """One named column in order: a (value, order) frame."""

    def __init__(self, df):
        self._df = df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())
        self.name = next(c for c in self._df.columns if c != RID)

    @classmethod
    def from_arrow(cls, spark: SparkSession, name: str, values: pa.Array) -> "Series":
        return DataFrame.from_arrow(spark, pa.table({name: values})).column(name)

    def _placed(self, name: str):
        return _numbered(self._df).select("__at", quoted(self.name).alias(name))

    def _frame(self) -> LazyFrame:
        return LazyFrame(self._df)

    def _of(self, lazy: LazyFrame) -> "Series":
        return Series(lazy._df)

    @property
    def dtype(self): return self._df.schema[self.name].dataType  # noqa: E704
    def __len__(self) -> int: return self._df.count()  # noqa: E704
    @property
    def null_count(self) -> int: return self._df.filter(quoted(self.name).isNull()).count()  # noqa: E704
    @property
    def chunk_count(self) -> int: return self._df.rdd.getNumPartitions()  # noqa: E704

    def info(self) -> dict:
        return {"name": self.name, "dtype": self.dtype, "length": len(self), "null_count": self.null_count, "chunk_count": self.chunk_count}

    def to_arrow(self) -> pa.ChunkedArray:
        return self._df.orderBy(RID).select(quoted(self.name)).toArrow().column(0)

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def to_list(self) -> list: return self.to_arrow().to_pylist()  # noqa: E704
    def to_frame(self) -> DataFrame: return DataFrame(self._frame())  # noqa: E704
    def rename(self, name: str) -> "Series": return Series(self._df.withColumnRenamed(self.name, name))  # noqa: E704
    def cast(self, dtype, strict: bool = True) -> "Series": return self._of(self._frame()._with_order().with_columns(col(self.name).cast(dtype, strict)))  # noqa: E704
    def slice(self, offset: int, length: int | None = None) -> "Series": return self._of(DataFrame(self._frame()).slice(offset, length)._lazy)  # noqa: E704
    def head(self, n: int = 5) -> "Series": return self.slice(0, n)  # noqa: E704
    def tail(self, n: int = 5) -> "Series": return self._of(self._frame().tail(n))  # noqa: E704
    def reverse(self) -> "Series": return self._of(self._frame().reverse())  # noqa: E704
    def drop_nulls(self) -> "Series": return Series(self._df.filter(quoted(self.name).isNotNull()))  # noqa: E704
    def filter(self, mask: "Series") -> "Series": return DataFrame(self._frame()).filter_mask(mask).column(self.name)  # noqa: E704

    def sort(self, descending: bool = False, nulls_last: bool = False, maintain_order: bool = False, multithreaded: bool = True) -> "Series":
        return self._of(self._frame().sort(self.name, descending=descending, nulls_last=nulls_last, maintain_order=maintain_order))

    def append(self, other: "Series") -> "Series":
        a = self._df.select(quoted(self.name), F.lit(0).alias("__s"), RID)
        b = other._df.select(quoted(other.name).alias(self.name), F.lit(1).alias("__s"), RID)
        return Series(a.union(b).orderBy("__s", RID).select(quoted(self.name)))

    def gather(self, indices: list[int]) -> "Series":
        n = len(self)
        require(all(-n <= i < n for i in indices), "index out of range")
        at = self._df.sparkSession.createDataFrame([(k, i % n) for k, i in enumerate(indices)], "__k long, __at long")
        return Series(at.join(self._placed(self.name), "__at").select(quoted(self.name), F.col("__k").alias(RID)))

    def unique(self, maintain_order: bool = False) -> "Series":
        first = self._df.groupBy(quoted(self.name)).agg(F.min(RID).alias(RID))
        return Series(first)

    def _binary(self, op: str, other) -> "Series":
        if isinstance(other, Series):
            rows = self._placed(self.name).join(other._placed("__other"), "__at").withColumnRenamed("__at", RID)
            return self._of(LazyFrame(rows).select(col(self.name).binary(op, col("__other")).alias(self.name)))
        return self._of(self._frame()._with_order().with_columns(col(self.name).binary(op, as_expr(other)).alias(self.name)))

    def __add__(self, o): return self._binary("add", o)  # noqa: E704
    def __sub__(self, o): return self._binary("subtract", o)  # noqa: E704
    def __mul__(self, o): return self._binary("multiply", o)  # noqa: E704
    def __truediv__(self, o): return self._binary("true_divide", o)  # noqa: E704
    def __eq__(self, o): return self._binary("eq", o)  # noqa: E704
    def __ne__(self, o): return self._binary("not_eq", o)  # noqa: E704
    def __lt__(self, o): return self._binary("lt", o)  # noqa: E704
    def __le__(self, o): return self._binary("lt_eq", o)  # noqa: E704
    def __gt__(self, o): return self._binary("gt", o)  # noqa: E704
    def __ge__(self, o): return self._binary("gt_eq", o)  # noqa: E704
    def eq_missing(self, o): return self._binary("eq_validity", o)  # noqa: E704
    def ne_missing(self, o): return self._binary("not_eq_validity", o)  # noqa: E704
    __hash__ = None

    def _reduce(self, op: str):
        if op not in ("count", "n_unique", "sum", "mean", "min", "max", "first", "last"):
            raise InvalidRequest(f"no series aggregate {op}")
        return self._frame().select(col(self.name).aggregate(op)).to_spark().first()[0]

    def count(self): return self._reduce("count")  # noqa: E704
    def n_unique(self): return self._reduce("n_unique")  # noqa: E704
    def sum(self): return self._reduce("sum")  # noqa: E704
    def mean(self): return self._reduce("mean")  # noqa: E704
    def min(self): return self._reduce("min")  # noqa: E704
    def max(self): return self._reduce("max")  # noqa: E704
    def first(self): return self._reduce("first")  # noqa: E704
    def last(self): return self._reduce("last")  # noqa: E704


def concat(frames: list, how: str = "vertical") -> LazyFrame:
    """Stacks frames (vertical, diagonal, and relaxed forms that widen types) or sets them side by side."""
    require(how in ("vertical", "vertical_relaxed", "diagonal", "diagonal_relaxed", "horizontal"), f"no concat {how}")
    lazies = [f._lazy if isinstance(f, DataFrame) else f for f in frames]
    require(bool(lazies), "concat needs a frame")
    out = lazies[0]
    if how == "horizontal":
        rows = _numbered(out._with_order()._df).drop(RID)
        for other in lazies[1:]:
            require(not set(rows.columns) & set(other.columns), "columns given twice")
            rows = rows.join(_numbered(other._with_order()._df).drop(RID), "__at", "full")
        return LazyFrame(rows.orderBy("__at").drop("__at"))
    df = out._plain
    for other in lazies[1:]:
        b = other._plain
        types = {f.name: f.dataType for f in df.schema.fields}
        clash = [f.name for f in b.schema.fields if f.name in types and types[f.name] != f.dataType]
        if how.startswith("vertical"):
            require(df.columns == b.columns, "frames with the same columns")
        require(not clash or how.endswith("relaxed"), f"columns of different types: {clash}")
        df = df.union(b) if how.startswith("vertical") else df.unionByName(b, allowMissingColumns=True)
    return LazyFrame(df)


