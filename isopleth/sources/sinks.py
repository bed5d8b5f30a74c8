"""Outputs that appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _replace(spark: SparkSession, temporary: str, path: str) -> None:
    """Put the old target aside, take its place, then drop it; a failure in between brings it back, at the next write at the latest."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, temporary, f"{path}.old"))
    store = target.getFileSystem(conf)
    if store.exists(aside):  # left by a write that broke off
        if store.exists(target):
            store.delete(aside, True)
        else:
            store.rename(aside, target)
    held = store.exists(target)
    if held and not store.rename(target, aside):
        raise OSError(f"cannot put {path} aside")
    taken = False
    try:
        taken = store.rename(new, target)
    finally:
        if held and not taken:
            store.rename(aside, target)
    if not taken:
        raise OSError(f"cannot rename {temporary} to {path}")
    if held:
        store.delete(aside, True)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write beside the target, then take its place."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", "zstd").parquet(temporary)
    _replace(df.sparkSession, temporary, path)


def write_csv(df: DataFrame, path: str, *order: Any) -> None:
    """A folder with one sorted CSV file with a header; for reports, which are small."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    (df.orderBy(*order) if order else df).coalesce(1).write.option("header", True).csv(temporary)
    _replace(df.sparkSession, temporary, path)


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON file, written beside the target and put in its place by a rename; for summaries, which are small."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    place = jvm.org.apache.hadoop.fs.Path(temporary)
    stream = place.getFileSystem(conf).create(place)
    try:
        stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    finally:
        stream.close()
    _replace(spark, temporary, path)


def html_report(template: str, token: str, rows: DataFrame, **extras: Any) -> str:
    """A template with its token replaced by the rows of a report, which are few, and extras as JSON."""
    if template.count(token) != 1:
        raise ValueError(f"the template must hold {token} once")
    payload = {"rows": [r.asDict(recursive=True) for r in rows.collect()], **extras}
    text = json.dumps(payload, ensure_ascii=False, default=str, separators=(",", ":"))
    return template.replace(token, text.replace("</", "<\\/"))
