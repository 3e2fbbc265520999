"""What tables and the session use."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from plumbline.frame import Frame, short_type

# Bytes of a value by type; strings are taken to have 32.
WIDTHS = {"double": 8, "float": 4, "bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8, "string": 32}


def memory_usage(frame: Frame, rows: int | None = None) -> int:
    """Estimated bytes: each type's width for each row, and one validity bit for each value."""
    n = frame.df.count() if rows is None else rows
    return sum(WIDTHS.get(kind, 32) * n + (n + 7) // 8 for kind in frame.types.values())


def object_info(frame: Frame) -> dict[str, Any]:
    level = frame.df.storageLevel
    return {"columns": frame.ncol, "types": {k: short_type(v) for k, v in frame.types.items()}, "groups": list(frame.groups), "mode": frame.mode, "computed": frame.computed, "cached": frame.df.is_cached, "memory": level.useMemory, "disk": level.useDisk}


def verify(frame: Frame) -> bool:
    """Whether the plan can be analysed and run."""
    frame.df.limit(1).collect()
    return True


def size_comparison(frame: Frame) -> dict[str, float]:
    """The estimate beside the optimizer's own statistics."""
    own = int(str(frame.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    estimate = memory_usage(frame)
    return {"estimated_bytes": estimate, "plan_bytes": own, "ratio": own / estimate if estimate else float("nan")}


def memory_state(spark: SparkSession) -> dict[str, dict[str, int]]:
    """For each block manager its storage memory and what is left."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    found = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status)
    return {str(k): {"total": int(found[k]._1()), "free": int(found[k]._2())} for k in found}


def gc(spark: SparkSession) -> None:
    """Drops all cached tables of the session."""
    spark.catalog.clearCache()


def session_details(spark: SparkSession) -> dict[str, str | int]:
    return {"version": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}


def has_session() -> bool:
    return SparkSession.getActiveSession() is not None


def show_session(spark: SparkSession) -> None:
    for k, v in session_details(spark).items():
        print(f"{k}: {v}")
