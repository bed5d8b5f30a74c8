"""Quality gate over clean events, publication of its result, and the views over published tables."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import is_blank, outside
from ..sources.commits import CommitLog
from .grid import heatmap_cells

PIPELINE = "environmental_hotspot_publish"
RUNS = (
    "run_id string, pipeline_name string, batch_id string, status string, quality_status string, started_at timestamp, finished_at timestamp, duration_seconds decimal(12,3), input_rows long, output_rows long, failed_rows long, error_message string"
)


def _violations(date: str, causes: tuple[str, ...]) -> list[Column]:
    """Conditions of rules 2 to 9 in the order of C.RULE_NAMES."""
    x, y = F.col("victim_position_x"), F.col("victim_position_y")
    return [
        is_blank("event_id"),
        F.col("map").isNull() | ~F.trim("map").isin(*C.MAPS),
        is_blank("match_id"),
        x.isNull() | y.isNull(),
        (x == 0) & (y == 0),
        outside(x, C.COORD_MIN, C.COORD_MAX) | outside(y, C.COORD_MIN, C.COORD_MAX),
        F.col(date).isNull(),
        F.col("killed_by").isNull() | ~F.col("killed_by").isin(*causes),
    ]


def quality_checks(events: DataFrame, date: str | None = None, causes: tuple[str, ...] = C.CAUSES) -> DataFrame:
    """(rule_order, check_name, checked_rows, error_count) of the ten rules, in one pass.

    The date column is match_date if there is one, else date. The first rule takes a null cause for no error,
    the ninth does not. Copies of an event_id beyond the first violate the last rule and the first. They are
    counted by event_id first, so a hot id is pre-aggregated.
    """
    date = date or ("match_date" if "match_date" in events.columns else "date")
    broken = _violations(date, causes)
    any_broken = F.coalesce(~F.col("killed_by").isin(*causes), F.lit(False))
    for rule in broken[:-1]:
        any_broken |= F.coalesce(rule, F.lit(False))
    by_id = events.groupBy("event_id").agg(
        F.count("*").alias("n"),
        F.count_if(any_broken).alias("bad"),
        *(F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(broken, 2)),
    )
    # of n copies one is first; the engine may call any of them first, so one that breaks another rule is preferred
    total = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.greatest(F.col("bad"), F.col("n") - 1 + F.least("bad", F.lit(1)))), F.lit(0)).alias("r1"),
        *(F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(2, 10)),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("r10"),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("rule_order"), F.lit(name).alias("check_name"), F.col("rows").alias("checked_rows"), F.col(f"r{i}").alias("error_count")) for i, name in enumerate(C.RULE_NAMES, 1)))
    return total.select(F.inline(rows))


def content_digest(events: DataFrame) -> str:
    """Digest of a table's rows, whatever their order and partitions: number of rows and sum of row hashes."""
    row = F.xxhash64(*sorted(events.columns)).cast("decimal(38,0)")
    n, total = events.agg(F.count("*"), F.sum(row)).first()
    return hashlib.sha256(f"{n}:{total}".encode()).hexdigest()


@dataclass(frozen=True)
class Store:
    """Folders of the published tables."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def log(self, spark: SparkSession, name: str) -> CommitLog:
        return CommitLog(spark, f"{self.path(name)}_log")

    def commit(self, spark: SparkSession, name: str, seen: int, batch: str, run_id: str) -> str | None:
        """Let a run's partition stand for its batch; return the run that it replaces."""
        return self.log(spark, name).commit(seen, batch, run_id)

    def drop_run(self, spark: SparkSession, name: str, batch: str, run_id: str) -> None:
        """Remove one run's partition of a batch."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/batch_id={batch}/source_run_id={run_id}")
        folder.getFileSystem(conf).delete(folder, True)

    def current(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of the runs that stand for their batches by the log; other partitions are not read."""
        paths = [f"{self.path(name)}/batch_id={batch}/source_run_id={run}" for batch, run in self.log(spark, name).live().items()]
        if not paths:
            raise FileNotFoundError(f"nothing is committed to {name}")
        return spark.read.option("basePath", self.path(name)).parquet(*paths)

    def drop_leftovers(self, spark: SparkSession, name: str, before: datetime) -> int:
        """Remove partitions that no entry names and that were last changed before a time, such as of runs that were broken off; return their number."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/batch_id=*/source_run_id=*")
        files = pattern.getFileSystem(conf)
        live = {f"source_run_id={run}" for run in self.log(spark, name).live().values()}
        stale = [f.getPath() for f in files.globStatus(pattern) or [] if f.getPath().getName() not in live and f.getModificationTime() < before.timestamp() * 1000]
        for place in stale:
            files.delete(place, True)
        return len(stale)


def publish(events: DataFrame, store: Store, now: datetime | None = None) -> str:
    """Gate `events`; if all rules pass, replace their batch of hotspots; return the run's id.

    The batch is named by the table's content. Hotspots go to a partition of their batch and run; an entry in the
    table's log lets it stand for the batch, then the run's final row is written. A run that breaks off anywhere
    leaves the last success as it was, and only after the final row does the run that was replaced go. Of two
    publishers of one batch at a time, the one that commits second fails and removes its own partition. Any error
    is recorded as a failed run and raised again.
    """
    spark, run_id = events.sparkSession, str(uuid.uuid4())
    started = now or datetime.now(timezone.utc)
    batch = "environmental-deaths-" + content_digest(events)[:20]

    def record(status: str, quality: str, rows: int | None = None, out: int | None = None, failed: int | None = None, error: str | None = None) -> None:
        finished = None if status == "RUNNING" else datetime.now(timezone.utc)
        row = spark.createDataFrame([(run_id, PIPELINE, batch, status, quality, started, finished, None, rows, out, failed, error)], RUNS)
        seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
        store.append(row.withColumn("duration_seconds", seconds.cast("decimal(12,3)")), "pipeline_runs")

    table, committed = "environmental_hotspots", False
    seen = store.log(spark, table).version()
    record("RUNNING", "NOT_CHECKED")
    try:
        checks = quality_checks(events).collect()  # ten rows
        results = spark.createDataFrame([(run_id, batch, C.RULE_VERSION, c.check_name, "FAIL" if c.error_count else "PASS", c.checked_rows, c.error_count) for c in checks], "run_id string, batch_id string, rule_version string, check_name string, status string, checked_rows long, error_count long")
        rate = F.when(F.col("checked_rows") > 0, F.col("error_count") / F.col("checked_rows")).otherwise(0.0).cast("decimal(12,9)")
        store.append(results.withColumn("error_rate", rate).withColumn("checked_at", F.current_timestamp()), "quality_check_results")
        rows, failed = checks[0].checked_rows, checks[0].error_count
        if any(c.error_count for c in checks):
            record("FAILED", "FAIL", rows, 0, failed, "quality rules failed")
            return run_id
        cells = heatmap_cells(events).withColumn("source_run_id", F.lit(run_id)).withColumn("published_at", F.current_timestamp()).withColumn("batch_id", F.lit(batch))
        # straight into the run's own folder: an append to the table would share its job folder with other publishers
        mine = f"{store.path(table)}/batch_id={batch}/source_run_id={run_id}"
        cells.drop("batch_id", "source_run_id").write.parquet(mine)
        written = spark.read.parquet(mine).count()
        replaced = store.commit(spark, table, seen, batch, run_id)
        committed = True
        record("SUCCEEDED", "PASS", rows, written, 0)
        if replaced:
            store.drop_run(spark, table, batch, replaced)
    except Exception as fault:
        record("FAILED", "NOT_CHECKED", error=str(fault)[:2000])
        if not committed:
            store.drop_run(spark, table, batch, run_id)
        raise
    return run_id


def current_runs(runs: DataFrame) -> DataFrame:
    """The last state of every run: finished rows come after their RUNNING row."""
    order = Window.partitionBy("run_id").orderBy(F.when(F.col("status") == "RUNNING", 1).otherwise(0), F.col("finished_at").desc_nulls_last())
    return runs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of each pipeline that started last, in its last state."""
    columns = [F.col(c) for c in runs.columns]
    return current_runs(runs).groupBy("pipeline_name").agg(F.max_by(F.struct(*columns), F.struct("started_at", "run_id")).alias("run")).select("run.*")


def latest_hotspots(hotspots: DataFrame, runs: DataFrame, pipeline: str = PIPELINE) -> DataFrame:
    """Hotspots of the last run that succeeded."""
    good = runs.where((F.col("pipeline_name") == pipeline) & (F.col("status") == "SUCCEEDED"))
    last = good.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1).select(F.col("run_id").alias("source_run_id"))
    return hotspots.join(F.broadcast(last), "source_run_id").select(hotspots.columns)


def quality_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Checks, failed checks and errors of every run in its last state; a run without results has none."""
    keyed = results.select("run_id", "check_name", F.col("status").alias("check_status"), "error_count")
    return current_runs(runs).join(keyed, "run_id", "left").groupBy("run_id", "batch_id", "started_at", "quality_status").agg(
        F.count("check_name").alias("check_count"),
        F.count_if(F.col("check_status") == "FAIL").alias("failed_check_count"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("rule_error_count"),
    )
