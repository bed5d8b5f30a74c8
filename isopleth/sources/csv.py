"""CSV inputs: united by column name over files, checked for drift against the first file."""

from __future__ import annotations

from csv import reader
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a glob names, on any file system that Spark reads, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def newest_file(spark: SparkSession, pattern: str) -> str:
    """The file of a glob that was changed last; of several, the last by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = [(f.getModificationTime(), f.getPath().toString()) for f in path.getFileSystem(conf).globStatus(path) or [] if f.isFile()]
    if not found:
        raise FileNotFoundError(pattern)
    return max(found)[1]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file: its first line, read without a job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return next(reader([line.removeprefix("\ufeff")])) if line else []


def read_csv(spark: SparkSession, pattern: str, schema: T.StructType | None = None, with_file: bool = False) -> DataFrame:
    """All files of a glob, columns matched by name; without a schema every column is text.

    Files with the same header are scanned together, so the number of scans is that of distinct headers, not
    of files. Columns that a file lacks are null; numbers that do not parse are null.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in list_files(spark, pattern):
        groups.setdefault(tuple(header(spark, path)), []).append(path)
    if not groups:
        raise FileNotFoundError(pattern)
    parts = []
    for names, paths in groups.items():
        text = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths)
        columns = [F.col(f"`{n}`") for n in names]
        if schema:
            columns = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        if with_file:
            columns.append(F.col("_metadata.file_path").alias("source_file"))
        parts.append(text.select(*columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def inferred(spark: SparkSession, path: str | list[str], ratio: float = 1.0, rows: int | None = None) -> T.StructType:
    """Types that Spark infers from whole files, from a share of them, or from the first `rows` lines of one."""
    infer = spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", ratio)
    if rows:  # a bounded number of lines
        path = spark.sparkContext.parallelize([r.value for r in spark.read.text(path).take(rows + 1)], 1)
    return infer.csv(path).schema


# Kinds of values as bits, so that the kinds in a column are summed up by OR, in any order and in any parts.
_KINDS = {"int": 1, "bigint": 2, "double": 4, "date": 8, "string": 16}


def _kind(text: Column) -> Column:
    """Bit of the narrowest type that a value is written in; 0 for one that is missing or blank."""
    value = F.trim(text)
    number, day = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    whole = F.when(value.try_cast("int").isNotNull(), _KINDS["int"]).when(value.try_cast("bigint").isNotNull(), _KINDS["bigint"]).otherwise(_KINDS["double"])
    return (
        F.when(F.coalesce(value == "", F.lit(True)), 0)
        .when(value.rlike(r"^[+-]?\d+$"), whole)
        .when(number, _KINDS["double"])
        .when(day & value.try_cast("date").isNotNull(), _KINDS["date"])
        .otherwise(_KINDS["string"])
    )


def type_of(kinds: Column) -> Column:
    """The narrowest type that holds values of all kinds: void, int, bigint, double, date or string; dates and numbers meet in string only."""
    numbers = kinds.bitwiseAND(_KINDS["int"] | _KINDS["bigint"] | _KINDS["double"])
    return (
        F.when(kinds == 0, "void")
        .when(kinds == _KINDS["date"], "date")
        .when(kinds != numbers, "string")
        .when(kinds >= _KINDS["double"], "double")
        .when(kinds >= _KINDS["bigint"], "bigint")
        .otherwise("int")
    )


def column_kinds(spark: SparkSession, pattern: str, share: float = 1.0) -> DataFrame:
    """(file, place, column, kinds, filled) of every column of every file of a glob, in one job over all of them.

    Files are scanned together by place, whatever their headers, and each one's kinds are summed up where its
    rows are read. `share` under 1 looks at so many of the rows only.
    """
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    headers = [(path, header(spark, path)) for path in files]
    places = [f"c{i}" for i in range(max(1, max(len(names) for _, names in headers)))]
    text = spark.read.option("header", True).option("enforceSchema", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in places])).csv(files)
    rows = text.select(F.col("_metadata.file_path").alias("file"), *places)
    rows = rows.sample(share, seed=1) if share < 1 else rows
    # each value's kind is found once, before it is summed up
    rows = rows.select("file", *(_kind(F.col(c)).alias(c) for c in places))
    told = F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"kinds_{c}").alias("kinds"), F.col(f"filled_{c}").alias("filled")) for i, c in enumerate(places)))
    found = rows.groupBy("file").agg(*(f for c in places for f in (F.bit_or(c).alias(f"kinds_{c}"), F.count_if(F.col(c) > 0).alias(f"filled_{c}")))).select("file", F.inline(told))
    # a row for each column of each file
    names = spark.createDataFrame([(path, i, name) for path, names in headers for i, name in enumerate(names)] or [("", 0, "")], "file string, place int, column string")
    known = names.join(found, ["file", "place"], "left")
    return known.select("file", "place", "column", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("filled", F.lit(0)).alias("filled"))


def column_types(kinds: DataFrame, *by: str) -> DataFrame:
    """The type of each group of column_kinds rows, such as of one file, of a folder or of all: (*by, type, filled, files)."""
    return kinds.groupBy(*by).agg(type_of(F.bit_or("kinds")).alias("type"), F.sum("filled").alias("filled"), F.count_distinct("file").alias("files"))


def read_typed_csv(spark: SparkSession, pattern: str, with_file: bool = False) -> DataFrame:
    """All files of a glob, columns matched by name and typed by what all rows of all files hold; a column of nothing is text."""
    kinds = column_kinds(spark, pattern)
    types = {r["column"]: "string" if r.type == "void" else r.type for r in column_types(kinds, "column").collect()}
    order = dict.fromkeys(n for path in list_files(spark, pattern) for n in header(spark, path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in order]) if not types else T.StructType([T.StructField(n, T._parse_datatype_string(types[n])) for n in order])
    return read_csv(spark, pattern, schema, with_file)


def schema_check(spark: SparkSession, pattern: str, share: float = 1.0) -> list[tuple[str, str]]:
    """(file, problem) for each file whose header, or whose types, differ from the first file's; one job over all files."""
    found: dict[str, list[tuple[str, str]]] = {}
    rows = column_types(column_kinds(spark, pattern, share), "file", "place", "column").orderBy("file", "place").collect()  # a row for each column of each file
    for r in rows:
        found.setdefault(r.file, []).append((r["column"], r.type))
    problems, first = [], None
    for path, columns in found.items():
        names, types = [n for n, _ in columns], dict(columns)
        if first is None:
            first = names, types
        if names != first[0]:
            problems.append((path, f"header {names} differs from {first[0]}"))
        problems += [(path, f"{n} is {t}, not {first[1][n]}") for n, t in columns if n in first[1] and t != first[1][n]]
    return problems


def require_same_schema(spark: SparkSession, pattern: str, share: float = 1.0) -> None:
    """Fail if any file drifts from the first."""
    if problems := schema_check(spark, pattern, share):
        raise ValueError("; ".join(f"{path}: {what}" for path, what in problems))
