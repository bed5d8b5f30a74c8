"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="isopleth-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A checkpointed table, marked for broadcast only if it is counted and has no more than `most` rows."""
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """Schema of `df` and one more column, for Arrow functions."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def bounded_sample(ids: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of `ids` first in the order of a hash of `key`, fewer if there are not so many.

    A count sets how small a hash must be for about four times n rows to be sorted, so that what the tasks
    hand over is bounded too. This picks what a model is fitted on, never what it is applied to.
    """
    total, hashed = ids.count(), F.xxhash64(key)
    near = ids if total <= 4 * n else ids.where(F.pmod(hashed, F.lit(1_000_000)) < int(4_000_000 * n / total) + 1)
    return near.orderBy(hashed, key).limit(n)


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one object that a Python worker keeps between tasks; asking for another key gives up the one before.

    Workers serve many stages, so what one operator has learnt must not stay beside what the next one learns.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]
