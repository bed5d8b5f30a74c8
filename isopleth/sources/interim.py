"""Tables that a query reads more than once, written out between its steps."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where the setting is missing, local mode takes a temporary folder; on a cluster that is an error, as
    executors could not read each other's.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="isopleth-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so that each use reads it instead of computing it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
