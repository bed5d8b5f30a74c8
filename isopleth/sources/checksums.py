"""Checksums of files of any size: digests of byte ranges, taken in parallel, combined in order to one digest a file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's ranges.
RANGE_BYTES = 128 << 20


def _reading(spark: SparkSession, size: int) -> SparkSession:
    """A session whose scans cut every file at multiples of `size`, whatever the cluster and the other files."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", size)
    own.conf.set("spark.sql.files.openCostInBytes", size)  # else many cores make the ranges shorter
    return own


def _sizes(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files of a glob, named as scans name them; scans leave empty files out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return [(f.getPath().toUri().toString(), f.getLen()) for f in path.getFileSystem(conf).globStatus(path) or [] if f.isFile()]


def range_digests(spark: SparkSession, pattern: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, start, lines, sha256) of every range of `size` bytes of the files of a glob, one task a range and nothing shuffled.

    A range holds the lines that begin after its first byte, up to the one that begins at the next range's first (the
    first range has the file's first line too), each closed by a line feed; any bytes may stand in them, but a line must fit
    into memory. Ranges in which no line begins give no row, nor do empty files. Compressed files are one range of what they unpack to.
    """
    text = _reading(spark, size).read.option("lineSep", "\n").text(pattern)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def row(place: tuple, lines: int, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([lines], pa.int64()), pa.array([digest.hexdigest()])], ["file", "start", "lines", "sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, digest = None, 0, hashlib.sha256()
        for batch in batches:  # lines come in the order of their range, and ranges one after the other
            marks = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
            values, at = batch.column("line").to_pylist(), 0
            while at < len(values):
                end = len(values) if marks[-1] == marks[at] else next(i for i in range(at, len(values)) if marks[i] != marks[at])
                if marks[at] != place:
                    if place is not None:
                        yield row(place, lines, digest)
                    place, lines, digest = marks[at], 0, hashlib.sha256()
                digest.update(b"\n".join(values[at:end]) + b"\n")
                lines += end - at
                at = end
        if place is not None:
            yield row(place, lines, digest)

    return rows.mapInArrow(run, "file string, start long, lines long, sha256 string")


def file_digests(spark: SparkSession, pattern: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, bytes, ranges, lines, sha256) of every file of a glob, empty ones included.

    The digest is that of "<bytes>:<size>:" and the ranges' digests in order, joined by commas, so it tells files apart
    that differ in any byte, in a last line feed or in a mark of byte order at their start. A file's ranges come together in one
    row: 64 bytes for each `size`. `content_digest` of the result names the files as a whole.
    """
    ranges = range_digests(spark, pattern, size)
    by_file = ranges.groupBy("file").agg(F.sum("lines").alias("lines"), F.sort_array(F.collect_list(F.struct("start", "sha256"))).alias("parts"))
    files = ranges.sparkSession.createDataFrame(_sizes(spark, pattern), "file string, bytes long")
    parts = F.coalesce(F.col("parts.sha256"), F.array().cast("array<string>"))
    whole = F.concat(F.col("bytes").cast("string"), F.lit(f":{size}:"), F.array_join(parts, ","))
    return files.join(by_file, "file", "left").select("file", "bytes", F.size(parts).cast("long").alias("ranges"), F.coalesce("lines", F.lit(0)).alias("lines"), F.sha2(whole, 256).alias("sha256"))
