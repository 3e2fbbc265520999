"""Row-wise verbs on streams.

``filter``, ``select`` and ``mutate`` work on streaming frames as they are, ``summarise`` with a complete or watermarked output.
``arrange``, ``bind_cols`` and masks need a whole table. This module only makes frames of streams and starts their sinks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.errors import EngineError
from plumbline.frame import Frame


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, format: str = "parquet") -> Frame:
    """A lazy frame of the files that are and will be in a folder."""
    return Frame(spark.readStream.schema(schema).format(format).load(path), (), "lazy")


def write_stream(frame: Frame, path: str, checkpoint: str, format: str = "parquet", output_mode: str = "append") -> StreamingQuery:
    """Writes what there is and stops; the checkpoint folder makes a later run go on from there."""
    if not frame.df.isStreaming:
        raise EngineError("write_stream", "the table is no stream")
    return frame.df.writeStream.outputMode(output_mode).format(format).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
