"""Scans: CSV, Parquet, JSON lines, JSON arrays, Arrow IPC files and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import require
from ..operators.eager import DataFrame
from ..operators.frame import LazyFrame, _numbered


def _limited(df, n_rows: int | None) -> LazyFrame:
    return LazyFrame(df if n_rows is None else df.limit(n_rows))


def scan_parquet(spark: SparkSession, path: str, n_rows: int | None = None, parallel: bool = True) -> LazyFrame:
    return _limited(spark.read.parquet(path), n_rows)


def scan_csv(spark: SparkSession, path: str, has_header: bool = True, separator: str = ",", skip_rows: int = 0, n_rows: int | None = None, try_parse_dates: bool = False, quoted_lines: bool | None = None) -> LazyFrame:
    """Types are inferred; dates only on request. ``quoted_lines``: whether fields hold line ends, which makes a file
    one task; by default that is looked up: only then does a line hold an odd number of quotes."""
    require(len(separator) == 1, "one separator character")
    if quoted_lines is None:
        quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
        quoted_lines = not skip_rows and spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0
    reader = spark.read.option("sep", separator).option("inferSchema", True).option("header", has_header).option("multiLine", quoted_lines).option("escape", '"')
    reader = reader.option("preferDate", try_parse_dates)
    if skip_rows:
        lines = _numbered(spark.read.text(path)).filter(F.col("__at") >= skip_rows).orderBy("__at").select("value")
        df = reader.option("multiLine", False).csv(lines.rdd.map(lambda r: r[0]))
    else:
        df = reader.csv(path)
        wide = [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in df.schema.fields]
        df = reader.option("inferSchema", False).schema(T.StructType(wide)).csv(path)  # whole numbers have 64 bits
    if not has_header:
        df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    return _limited(df, n_rows)


def scan_ndjson(spark: SparkSession, path: str, n_rows: int | None = None, infer_schema_length: int | None = 100, ignore_errors: bool = False, low_memory: bool = False, rechunk: bool = False) -> LazyFrame:
    reader = spark.read.option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    if infer_schema_length is not None:
        require(infer_schema_length > 0, "infer_schema_length is positive")
        sample = spark.read.text(path).limit(infer_schema_length).rdd.map(lambda r: r[0])
        reader = reader.schema(spark.read.json(sample).schema)
    return _limited(reader.json(path), n_rows)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return DataFrame.materialised(LazyFrame(spark.read.option("multiLine", True).json(path)))


class _Part(InputPartition):
    def __init__(self, path: str, batch: int):
        super().__init__((path, batch))
        self.path, self.batch = path, batch


class ArrowFileSource(DataSource):
    """Arrow IPC files: a partition per record batch, read by position."""

    @classmethod
    def name(cls) -> str:
        return "skein_arrow"

    @staticmethod
    def files(path: str) -> list[str]:
        """The file, or the part files of a folder in order."""
        fs, p = _located(path)
        if fs.get_file_info(p).is_file:
            return [path]
        import pyarrow.fs as pafs

        found = [i for i in fs.get_file_info(pafs.FileSelector(p)) if i.is_file and i.base_name.endswith(".arrow")]
        return [f"{path.rstrip('/')}/{i.base_name}" for i in sorted(found, key=lambda i: i.base_name)]

    @staticmethod
    def open(path: str):
        import pyarrow.ipc as ipc

        fs, p = _located(path)
        return ipc.open_file(fs.open_input_file(p))

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_storable(self.open(self.files(self.options["path"])[0]).schema))

    def reader(self, schema):
        return _ArrowReader(self)


def _located(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _ArrowReader(DataSourceReader):
    def __init__(self, source: ArrowFileSource):
        self._source = source

    def partitions(self):
        s = self._source
        files = s.files(s.options["path"])
        return [_Part(f, i) for f in files for i in range(s.open(f).num_record_batches)] or [_Part(files[0], -1)]

    def read(self, partition):
        if partition.batch >= 0:
            import pyarrow as pa

            f = self._source.open(partition.path)
            table = pa.Table.from_batches([f.get_batch(partition.batch)])
            yield from table.cast(_storable(table.schema)).to_batches()


def _storable(schema):
    """The schema with dictionaries decoded and wide or view types as Spark has them."""
    import pyarrow as pa

    def plain(t):
        if pa.types.is_dictionary(t):
            return plain(t.value_type)
        if pa.types.is_large_string(t) or t == pa.string_view():
            return pa.string()
        if pa.types.is_large_binary(t) or pa.types.is_fixed_size_binary(t) or t == pa.binary_view():
            return pa.binary()
        if pa.types.is_uint8(t):
            return pa.int16()
        if pa.types.is_uint16(t):
            return pa.int32()
        if pa.types.is_uint32(t):
            return pa.int64()
        if pa.types.is_uint64(t):
            return pa.decimal128(20, 0)
        if pa.types.is_float16(t):
            return pa.float32()
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        if pa.types.is_duration(t):
            return pa.duration("us")
        if pa.types.is_date64(t):
            return pa.date32()
        if pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
            return pa.list_(plain(t.value_type))
        return t

    return pa.schema([pa.field(f.name, plain(f.type), True) for f in schema])


def scan_ipc(spark: SparkSession, path: str, n_rows: int | None = None, cache: bool = True, rechunk: bool = False, record_batch_statistics: bool = False) -> LazyFrame:
    spark.dataSource.register(ArrowFileSource)
    return _limited(spark.read.format("skein_arrow").load(path), n_rows)


def read_ipc_stream(spark: SparkSession, path: str, n_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A stream has no index of its batches, so it is read by the driver."""
    import pyarrow as pa

    with pa.ipc.open_stream(path) as r:
        table = r.read_all()
    table = table.select(columns) if columns else table
    table = table if n_rows is None else table.slice(0, n_rows)
    return DataFrame.from_arrow(spark, table.cast(_storable(table.schema)))
