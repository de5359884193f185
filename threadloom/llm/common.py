"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and 0x09 to 0x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


#: For DuckDB, which has no CRC: the table of the 256 bytes' remainders as a list, and the expression that folds a text with it.
CRC_SQL = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text in UTF-8; the statement holds CRC_SQL, and the select reads from crc too."""
    digits = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: ('0x' || substr(hex({text}), k, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written since the innermost scratch() began, as (label, path).
_written: ContextVar[list[tuple[str, str]] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may name none (tests); it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append((label, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Removes at its end what materialize() wrote in between, but for the newest table of each label in keep.

    Kept tables belong to the scratch() around this one, if there is one.
    """
    outer = _written.get()
    token = _written.set([])
    try:
        yield
    finally:
        sweep(spark, *keep)
        if outer is not None:
            outer.extend(_written.get())
        _written.reset(token)


def sweep(spark: SparkSession, *keep: str) -> None:
    """Removes what the innermost scratch() holds, but for the newest table of each label in keep."""
    mine = _written.get() or []
    kept = dict(x for x in mine if x[0] in keep)
    for label, path in mine:
        if kept.get(label) != path:
            remove_path(spark, path)
    mine[:] = kept.items()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table through Hadoop's file system, wherever the shared folder lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system, for the operators that share the executor with it.

    What numpy's temporaries took stays with the C library otherwise (glibc; others have no such call, and nothing is done).
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]
