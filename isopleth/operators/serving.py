"""Publication of gated hotspots to a serving database: one transaction takes a batch from its last state to the next."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.database import Database, Statement
from .grid import heatmap_cells
from .quality import PIPELINE, content_digest, quality_checks

_KEY = ("batch_id", "map", "killed_by", "grid_size_m", "grid_x", "grid_y")
_CELLS = (*_KEY, "source_run_id", "death_count", "match_count", "date_count", "share_pct", "heat_rank", "published_at")
_CELL_COLUMNS = """batch_id varchar(64) not null, source_run_id varchar(36) not null, map varchar(64) not null, killed_by varchar(64) not null, grid_size_m int not null check (grid_size_m > 0),
  grid_x int not null, grid_y int not null, death_count bigint not null, match_count bigint not null, date_count bigint not null, share_pct double not null, heat_rank int not null, published_at timestamp not null"""

#: Serving tables and the staging table, in the order of their references.
TABLES = {
    "pipeline_runs": """run_id varchar(36) primary key, pipeline_name varchar(64) not null, batch_id varchar(64) not null, status varchar(16) not null check (status in ('RUNNING', 'SUCCEEDED', 'FAILED')),
      quality_status varchar(16) not null check (quality_status in ('NOT_CHECKED', 'PASS', 'FAIL')), started_at timestamp not null, finished_at timestamp, input_rows bigint default 0 not null,
      output_rows bigint default 0 not null, failed_rows bigint default 0 not null, error_message varchar(2000)""",
    "quality_check_results": """run_id varchar(36) not null references pipeline_runs (run_id), batch_id varchar(64) not null, check_name varchar(64) not null, rule_version varchar(16) not null, status varchar(8) not null check (status in ('PASS', 'FAIL')),
      checked_rows bigint not null, error_count bigint not null, error_rate double not null, primary key (run_id, check_name)""",
    "environmental_hotspots": f"{_CELL_COLUMNS}, primary key ({', '.join(_KEY)})",
    "staged_hotspots": _CELL_COLUMNS,
}


def _taken_over(run_id: str, batch: str) -> list[Statement]:
    """Replace a batch's hotspots by the staged ones of a run: distinct, as tasks may have staged rows twice, and only cells that are not there."""
    same = " and ".join(f"h.{k} = s.{k}" for k in _KEY)
    columns = ", ".join(_CELLS)
    return [
        ("delete from environmental_hotspots where batch_id = ?", (batch,)),
        (f"insert into environmental_hotspots ({columns}) select distinct {', '.join(f's.{c}' for c in _CELLS)} from staged_hotspots s where s.source_run_id = ? and not exists (select 1 from environmental_hotspots h where {same})", (run_id,)),
    ]


def _ended(run_id: str, status: str, quality: str, rows: int, failed: int, error: str | None) -> Statement:
    """The run's last state; the number of its hotspots is counted where they are."""
    said = ("?", (error[:2000],)) if error else ("null", ())
    text = f"""update pipeline_runs set status = ?, quality_status = ?, finished_at = current_timestamp, input_rows = ?, failed_rows = ?,
      output_rows = (select count(*) from environmental_hotspots where source_run_id = ?), error_message = {said[0]} where run_id = ? and status = 'RUNNING'"""
    return text, (status, quality, rows, failed, run_id, *said[1], run_id)


def replace_batch(db: Database, cells: DataFrame, run_id: str, batch: str, more: list[Statement]) -> list[int]:
    """Stage heatmap cells, then, in one transaction, take them over as the batch's hotspots and run `more`; staged rows go afterwards.

    Rerun or broken off, a batch never has a cell twice nor less than one whole state. Publishers of one batch
    wait for each other in the database; the last one stands.
    """
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = cells.withColumn("batch_id", F.lit(batch)).withColumn("source_run_id", F.lit(run_id)).withColumn("published_at", F.lit(now).cast("timestamp"))
    db.append(rows.select(*_CELLS), "staged_hotspots")
    try:
        return db.transaction([*_taken_over(run_id, batch), *more])
    finally:
        db.transaction([("delete from staged_hotspots where source_run_id = ?", (run_id,))])


def publish(events: DataFrame, db: Database) -> str:
    """Gate `events` and publish their hotspots to the database; return the run's id.

    The run's row is committed first, as RUNNING. Rule results, hotspots and the run's last state then come in one
    transaction; without a pass there are no hotspots. An error is recorded as a failed run, in a transaction of its own,
    and raised again; the batch's last success stands.
    """
    db.create(TABLES)
    run_id, batch = str(uuid.uuid4()), "environmental-deaths-" + content_digest(events)[:20]
    db.transaction([("insert into pipeline_runs (run_id, pipeline_name, batch_id, status, quality_status, started_at) values (?, ?, ?, 'RUNNING', 'NOT_CHECKED', current_timestamp)", (run_id, PIPELINE, batch))])
    try:
        checks = quality_checks(events).collect()  # ten rows
        rows, failed = checks[0].checked_rows, checks[0].error_count
        told = [
            ("insert into quality_check_results values (?, ?, ?, ?, ?, ?, ?, ?)", (run_id, batch, c.check_name, C.RULE_VERSION, "FAIL" if c.error_count else "PASS", c.checked_rows, c.error_count, c.error_count / c.checked_rows if c.checked_rows else 0.0))
            for c in checks
        ]
        ended = partial(_ended, run_id, rows=rows, failed=failed)
        broken = sum(c.error_count > 0 for c in checks)
        if broken:
            db.transaction([*told, ended("FAILED", "FAIL", error=f"{broken} quality rules failed")])
        else:
            replace_batch(db, heatmap_cells(events), run_id, batch, [*told, ended("SUCCEEDED", "PASS", error=None)])
    except BaseException as fault:
        db.transaction([_ended(run_id, "FAILED", "NOT_CHECKED", 0, 0, str(fault) or type(fault).__name__)])
        raise
    return run_id
