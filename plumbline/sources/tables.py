"""Sources and sinks: frames from Spark, pandas, rows and files, and back."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import EngineError
from plumbline.frame import Frame, resolve_mode
from plumbline.functions.terms import quoted

FORMATS = ("parquet", "csv", "json", "orc")


def tbl(data: Any, spark: SparkSession | None = None, lazy: bool | None = None, schema: str | T.StructType | None = None) -> Frame:
    """A table from a frame (whose mode may change), a Spark DataFrame, pandas, a dict of columns, a list of rows, or a path.

    NaN in host data is NULL (arithmetic may make NaN later); pandas categories keep their levels; integers stay exact.
    """
    if isinstance(data, Frame):
        return Frame(data.df, data.groups, data.mode if lazy is None else "lazy" if lazy else "eager", data.computed)
    spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.active())
    if isinstance(data, DataFrame):
        df = data
    elif isinstance(data, (str, Path)):
        return read(spark, str(data), lazy=lazy, schema=schema)
    else:
        df = _host(data, spark, schema)
    return Frame(df, (), resolve_mode(lazy, df))


as_tbl = tbl


def is_tbl(x: Any) -> bool:
    return isinstance(x, Frame)


def _host(data: Any, spark: SparkSession, schema: str | T.StructType | None) -> DataFrame:
    import pandas as pd

    if isinstance(data, dict):
        data = pd.DataFrame(data)
    levels: dict[str, list[str]] = {}
    if isinstance(data, pd.DataFrame):
        levels = {n: [str(x) for x in data[n].cat.categories] for n in data.columns if isinstance(data[n].dtype, pd.CategoricalDtype)}
        if levels:
            data = data.assign(**{n: data[n].astype(object).where(data[n].notna(), None) for n in levels})
        for n in data.columns:
            sample = data[n].dropna()
            if len(sample) and isinstance(sample.iloc[0], (complex, set)):
                raise EngineError("tbl", f"column '{n}' has an unsupported type")
    elif not isinstance(data, (list, tuple)):
        raise EngineError("tbl", f"cannot make a table of a {type(data).__name__}")
    df = spark.createDataFrame(data, schema) if schema is not None else spark.createDataFrame(data)
    none = F.lit(None)
    columns = []
    for f in df.schema:
        x = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.nanvl(x, none.cast(f.dataType))
        columns.append(x.alias(f.name, metadata={"levels": levels[f.name]}) if f.name in levels else x.alias(f.name))
    return df.select(*columns)


def read(spark: SparkSession, path: str, format: str | None = None, lazy: bool | None = None, schema: str | T.StructType | None = None, **options: Any) -> Frame:
    """A table of files. Filters and columns asked for reach the scan; a schema spares the inference pass of text formats."""
    format = format or next((f for f in FORMATS if f".{f}" in path), "parquet")
    if format not in FORMATS:
        raise EngineError("read", f"the format must be one of {', '.join(FORMATS)}")
    reader = spark.read.options(**({"header": True} if format == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv" and "inferSchema" not in options:
        reader = reader.option("inferSchema", True)
    df = reader.format(format).load(path)
    return Frame(df, (), resolve_mode(lazy, df))


def write(frame: Frame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """The table as files, in parallel."""
    if format not in FORMATS:
        raise EngineError("write", f"the format must be one of {', '.join(FORMATS)}")
    writer = frame.df.write.mode(mode).options(**({"header": True} if format == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(format).save(path)


def collect(frame: Frame):
    """The rows at the driver, as pandas; factors come back as categories with their levels, 64-bit integers exact."""
    import pandas as pd

    out = frame.df.toPandas()
    for name in dict.fromkeys(frame.names):
        if frame.names.count(name) == 1 and (levels := frame.levels(name)) is not None:
            out[name] = pd.Categorical(out[name], categories=levels)
    return out
