"""Sinks. Spark writes folders of part files and shows them only when all are done;
``single_file=True`` (for results of the driver's size) writes one ordered file through Arrow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..functions.compiler import RID, quoted

COMPRESSIONS = {"none": "none", "snappy": "snappy", "gzip": "gzip", "brotli": "brotli", "zstd": "zstd", "lz4": "lz4_raw"}


def _ordered(frame, maintain_order: bool):
    df = frame._df
    return (df.orderBy(RID) if maintain_order and RID in df.columns else df).drop(RID)


def _storable(df):
    """Null columns can't be written: they become strings."""
    return df.select(*[quoted(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else quoted(f.name) for f in df.schema.fields])


def write_parquet(frame, path: str, compression: str = "zstd", row_group_size: int | None = None, data_page_size: int | None = None, statistics: bool = True, parallel: bool = True, maintain_order: bool = True, mode: str = "overwrite") -> None:
    require(compression in COMPRESSIONS, f"no compression {compression}")
    w = _storable(_ordered(frame, maintain_order)).write.mode(mode).option("compression", COMPRESSIONS[compression])
    if row_group_size:
        w = w.option("parquet.block.size", row_group_size)
    if data_page_size:
        w = w.option("parquet.page.size", data_page_size)
    w.parquet(path)


def write_csv(
    frame, path: str, include_header: bool = True, separator: str = ",", quote: str = '"', quote_style: str = "necessary", null_value: str = "", line_terminator: str = "\n",
    date_format: str | None = None, datetime_format: str | None = None, time_format: str | None = None, float_scientific: bool | None = None, float_precision: int | None = None,
    decimal_comma: bool = False, include_bom: bool = False, maintain_order: bool = True, mode: str = "overwrite",
) -> None:
    require(quote_style in ("necessary", "always", "non_numeric", "never"), f"no quote style {quote_style}")
    require(len(separator) == 1 and len(quote) == 1, "one separator and one quote character")
    require(line_terminator in ("\n", "\r\n", "\r") and not include_bom, "part files end lines by \\n, \\r or \\r\\n and have no byte-order mark")
    from ..functions.namespaces import java_format

    df = _storable(_ordered(frame, maintain_order))
    columns = []
    for f in df.schema.fields:
        c, t = quoted(f.name), f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)) and (float_precision is not None or float_scientific or decimal_comma):
            text = F.format_string(f"%.{6 if float_precision is None else float_precision}{'e' if float_scientific else 'f'}", c) if float_precision is not None or float_scientific else c.cast("string")
            c = F.when(quoted(f.name).isNotNull(), F.translate(text, ".", ",") if decimal_comma else text)
        if quote_style == "non_numeric" and not isinstance(t, T.NumericType):
            c = F.concat(F.lit(quote), F.replace(c.cast("string"), F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        columns.append(c.alias(f.name))
    w = df.select(*columns).write.mode(mode).option("header", include_header).option("sep", separator).option("nullValue", null_value).option("emptyValue", '""' if quote_style == "necessary" else "").option("lineSep", line_terminator).option("escape", quote)
    w = w.option("quote", "" if quote_style in ("never", "non_numeric") else quote).option("quoteAll", quote_style == "always")
    if date_format:
        w = w.option("dateFormat", java_format(date_format))
    if datetime_format:
        w = w.option("timestampFormat", java_format(datetime_format)).option("timestampNTZFormat", java_format(datetime_format))
    w.csv(path)


def write_ndjson(frame, path: str, maintain_order: bool = True, mode: str = "overwrite") -> None:
    _ordered(frame, maintain_order).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json(frame, path: str) -> None:
    """One JSON array; for results of the driver's size."""
    import json

    rows = _ordered(frame, True).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    with open(path, "w") as f:
        json.dump([json.loads(r[0]) for r in rows], f)


def write_ipc(frame, path: str, compression: str | None = None, maintain_order: bool = True, parts: bool = False) -> None:
    """One Arrow IPC file, through the driver, which holds the whole result; with ``parts`` a folder with a file per
    partition, written by the executors and shown when all are done."""
    if parts:
        _ipc_parts(frame, path, compression, maintain_order)
    else:
        _ipc(frame, path, compression, maintain_order, stream=False)


def write_ipc_stream(frame, path: str, compression: str | None = None, maintain_order: bool = True) -> None:
    """One Arrow IPC stream, through the driver, which holds the whole result."""
    _ipc(frame, path, compression, maintain_order, stream=True)


def _ipc_parts(frame, path, compression, maintain_order):
    import uuid

    import pyarrow as pa
    import pyarrow.fs as pafs
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    require(compression in (None, "lz4", "zstd"), f"no compression {compression}")
    df = _storable(_ordered(frame, maintain_order))
    schema, uri = to_arrow_schema(df.schema), path if "://" in path else f"file://{path}"

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.arrow"
        with fs.open_output_stream(name + ".tmp") as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
            for batch in batches:
                w.write_table(pa.Table.from_batches([batch]).cast(schema))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    # Names of the tasks that succeeded, one each; files of repeated or lost attempts keep their ending and are removed.
    done = [r["name"] for r in df.mapInArrow(run, "name string").collect()]
    fs, folder = pafs.FileSystem.from_uri(uri)
    for name in done:
        fs.move(name + ".tmp", name)
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.endswith(".arrow.tmp"):
            fs.delete_file(info.path)


def _ipc(frame, path, compression, maintain_order, stream):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    require(compression in (None, "lz4", "zstd"), f"no compression {compression}")
    df = _storable(_ordered(frame, maintain_order))
    schema = to_arrow_schema(df.schema)
    opener = pa.ipc.new_stream if stream else pa.ipc.new_file
    with pa.OSFile(path, "wb") as out, opener(out, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
        for batch in df.toArrow().cast(schema).to_batches(max_chunksize=65_536):
            w.write_batch(batch)
