"""Session helpers shared by the operators: tables, lineage cuts, size checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it was measured and has at most this many rows and bytes of values.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Bytes of an Arrow batch that a Python worker gets; rows longer than that are a batch of their own.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session, as in tests, may go without one and gets a temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where:
        return where
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there, and lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What forgets a cache that an operator's tasks leave in a Python worker for its next ones.
CACHES: list[Callable[[], None]] = []
_last: str | None = None


def tidy(operator: str) -> None:
    """At a task's start: where the worker's last task was another operator's, caches are forgotten and free memory goes back to the system. Spark uses workers again, so each would keep what all operators before it held at most."""
    global _last
    if _last not in (None, operator):
        for forget in CACHES:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _last = operator


def in_arrow(df: DataFrame, f: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES (a session setting), so that a worker's memory follows its longest row and not 10,000 rows; a worker that comes from another operator is tidied first."""
    operator = f.__module__

    @wraps(f)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(operator)
        return f(batches)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(task, schema)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _members(values: pd.Series, among: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or a is None else np.isin(v, a) for v, a in zip(values, among, strict=True)], dtype=object)


def members(values: Column, among: Column) -> Column:
    """Which values (longs) of a row's list stand in its other list, place by place; null where none does. Work is in proportion to both lengths (a sort of one): hash sets find the rows with a hit, and only those go to Python."""
    hits = F.array_intersect(values, among)
    some = F.size(hits) > 0
    return _members(F.when(some, values), F.when(some, hits))


def _width(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, T.ArrayType):
        inner = 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1)
        return 16 + F.coalesce(F.size(value), F.lit(0)) * inner
    if isinstance(kind, T.StructType):
        return reduce(add, (_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(0))
    return F.coalesce(F.octet_length(value), F.lit(0)) + 16 if isinstance(kind, T.StringType | T.BinaryType) else F.lit(8)


def quoted(name: str) -> str:
    """A column's name as it stands, dots and backticks in it too."""
    return "`" + name.replace("`", "``") + "`"


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the (saved) table has at most that many rows and bytes; else unchanged, and Spark joins by shuffle and splits skewed keys."""
    width = reduce(add, (_width(f.dataType, F.col(quoted(f.name))) for f in df.schema.fields), F.lit(0)).cast("long")
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= most else df


def row_key() -> list:
    """k_id and k_row: what decides about a document row. Repeated ids may carry other texts or hosts, and a null is neither an empty string nor skipped; rows share a key only if id, text and source are equal (or 64 bits of hash collide under one id). A null id ranks as the least number."""
    parts = [F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce("text", F.lit("")), F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit(""))]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k_id"), F.xxhash64(*parts).alias("k_row")]


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose row_key() is in dropped; all columns of docs are kept as they are."""
    d = small(dropped.select(F.col("k_id").alias("gone_id"), F.col("k_row").alias("gone_row")))
    keyed = docs.select(whole(docs).alias("kept_doc"), *row_key())
    left = keyed.join(d, (F.col("k_id") == F.col("gone_id")) & (F.col("k_row") == F.col("gone_row")), "left_anti")
    return left.select(*(F.col("kept_doc")[c].alias(c) for c in docs.columns))
