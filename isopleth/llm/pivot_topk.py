"""Exact top-k search by pivot-table elimination.

Vectors are floored to integers. A table holds each vector's distances to many pivots; by the triangle
inequality the greatest difference of two rows bounds the distance of their vectors from below, and so their
inner product from above. Every query starts from a threshold, its k-th best score within a bounded sample.
Candidates lie in blocks around their nearest pivots. A block of queries skips the blocks whose extremes of
the table bound them below its weakest threshold; in the others it takes candidates in the order of their
bounds, raises its thresholds and stops once no bound reaches them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint

SCALE, TOP = 64, 20
#: Vectors that thresholds start from, the first in the order of a hash, and how many of them are pivots.
SAMPLE, PIVOTS = 1024, 64
#: Rows of a block of candidates and of queries, about; candidates evaluated, and queries bounded, at once.
CANDIDATE_ROWS, QUERY_ROWS, CHUNK, BOUND_ROWS = 2048, 512, 512, 64
#: Bounds are raised by this share of the squared norms, for rounding in square roots and in single precision.
SLACK = 1e-5
#: Scores are exact in doubles below this, and fit a long below that.
DOUBLE_EXACT, LONG_END = 2**53, 2**63

_ROW = "rid long, vec_id long, asks boolean, v array<double>"


def sound_vectors(vectors: DataFrame, is_query) -> DataFrame:
    """(rid, vec_id, asks, v array<double>) of the rows with an id whose vectors hold finite components only; rid tells rows apart."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"))


def _floors(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x), exact for every finite double."""
    return [int(x) * scale if abs(x) >= DOUBLE_EXACT else math.floor(x * scale) for x in row.tolist()]


class Rows:
    """Vectors of a block: floored components as doubles, shorter vectors filled up with zeros; rows too wide for exact doubles apart."""

    def __init__(self, vectors: list[np.ndarray], width: int, scale: int) -> None:
        self.raw, self.scale = vectors, scale
        self.plain = np.zeros((len(vectors), width))
        for i, row in enumerate(vectors):
            self.plain[i, : len(row)] = row
        largest = np.abs(self.plain).max(1, initial=0)
        self.wide = largest * scale >= math.isqrt(DOUBLE_EXACT // max(width, 1)) - 1
        self.plain[self.wide] = 0
        self.plain = np.floor(self.plain * scale)
        self.norms = (self.plain**2).sum(1)

    def exact(self, i: int) -> list[int]:
        return _floors(self.raw[i], self.scale)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def upper_bounds(queries: Rows, query_table: np.ndarray, rows: Rows, table: np.ndarray) -> np.ndarray:
    """Bound of the score of each query with each row, infinite where one is wide."""
    out = np.empty((len(query_table), len(table)), np.float32)
    by_pivot = np.ascontiguousarray(table.T)
    for at in range(0, len(query_table), BOUND_ROWS):
        some = query_table[at : at + BOUND_ROWS]
        least = np.zeros((len(some), len(table)), np.float32)
        gap = np.empty_like(least)
        for p, far in enumerate(by_pivot):
            np.subtract(far[None], some[:, p, None], out=gap)
            np.maximum(least, np.abs(gap, out=gap), out=least)
        norms = queries.norms[at : at + BOUND_ROWS, None] + rows.norms[None]
        out[at : at + BOUND_ROWS] = (norms - least.astype(float) ** 2) / 2 + SLACK * (norms + 1)
    out[queries.wide] = np.inf
    out[:, rows.wide] = np.inf
    return out


def best_rows(queries: Rows, query_rids: np.ndarray, query_table: np.ndarray, start: np.ndarray, rows: Rows, rids: np.ndarray, ids: np.ndarray, table: np.ndarray, top: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, row, exact score) of each query's up to `top` best rows and ties of the last, and the number of scores computed.

    start: scores that each query's answer is known to reach. Rows are taken in the order of how far their
    bounds reach above the queries' thresholds, which rise on the way, until none reaches one.
    """
    bounds, floor = upper_bounds(queries, query_table, rows, table), start.astype(float)
    over = (bounds - floor[:, None]).max(0, initial=-np.inf)
    order = np.argsort(-over, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    evaluated = 0
    for at in range(0, len(order), CHUNK):
        chunk = order[at : at + CHUNK]
        chunk = chunk[(bounds[:, chunk] >= floor[:, None]).any(0)]
        if not len(chunk):
            if not (bounds[:, order[at:]] >= floor[:, None]).any():
                break
            continue
        scores = queries.plain @ rows.plain[chunk].T
        evaluated += scores.size
        scores[query_rids[:, None] == rids[chunk][None]] = -np.inf
        scores[queries.wide] = -np.inf
        scores[:, rows.wide[chunk]] = -np.inf
        if len(chunk) >= top:
            floor = np.maximum(floor, np.partition(scores, -top, axis=1)[:, -top])
        q, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        found.append((q, chunk[c], scores[q, c]))
    q, r, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    keep = (s >= floor[q]) & (np.arange(len(q)) - np.searchsorted(q, q) < top)
    out = list(zip(q[keep].tolist(), r[keep].tolist(), map(int, s[keep].tolist())))
    if not (queries.wide.any() or rows.wide.any()):
        return out, evaluated
    exact: dict[int, list[int]] = {}
    for i in range(len(query_rids)):
        asked = queries.exact(i)
        for j in range(len(rids)) if queries.wide[i] else np.flatnonzero(rows.wide).tolist():
            if query_rids[i] != rids[j]:
                exact[j] = exact.get(j) or rows.exact(j)
                out.append((i, j, sum(x * y for x, y in zip(asked, exact[j]))))
    out.sort(key=lambda t: (t[0], -t[2], ids[t[1]]))
    return [t for i, t in enumerate(out) if i < top or out[i - top][0] != t[0]], evaluated


def sortable(score: int) -> str | None:
    """A text in the order of whole numbers for scores that a long may not hold, else null."""
    if abs(score) < LONG_END // 2:
        return None
    digits = str(abs(score))
    return f"1{len(digits):06d}{digits}" if score > 0 else f"0{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def _table(rows: DataFrame, sample: list, width: int, pivots: int, top: int, scale: int) -> DataFrame:
    """`rows` with far (distances to the pivots), cell (the nearest), norm (squared) and start (the threshold of rows that ask)."""
    known = Rows([np.array(r.v) for r in sample], width, scale)
    known_rids = np.array([r.rid for r in sample])
    chosen = known.plain[:pivots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = Rows(_lists(batch.column("v")), width, scale)
            far = distances(here.plain, chosen)
            start = np.full(batch.num_rows, -np.inf)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            if asks.any():
                scores = here.plain[asks] @ known.plain.T
                scores[:, known.wide] = -np.inf
                scores[batch.column("rid").to_numpy()[asks][:, None] == known_rids[None]] = -np.inf
                if len(sample) >= top:
                    start[asks] = np.where(here.wide[asks], -np.inf, np.partition(scores, -top, axis=1)[:, -top])
            norm = np.where(here.wide, np.inf, here.norms)
            more = [pa.array(list(far), pa.list_(pa.float32())), pa.array(far.argmin(1), pa.int32()), pa.array(norm), pa.array(start)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "far", "cell", "norm", "start"])

    return rows.mapInArrow(run, _ROW + ", far array<float>, cell int, norm double, start double")


def _blocks(rows: DataFrame, name: str, size: int, pivots: int, extra: list[str]) -> tuple[DataFrame, int]:
    """Rows gathered around their pivots into about `size` a block, (name, rows, low, high, norm, weakest), and the number of blocks.

    A cell of many rows is cut by a hash, so equal vectors spread over blocks. One count a pivot comes to the driver.
    """
    counts = dict(rows.groupBy("cell").count().collect())
    cuts = [-(-counts.get(c, 0) // size) for c in range(pivots)]
    first = np.concatenate([[0], np.cumsum(cuts)]).tolist()
    of_cell = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("cell") + 1)
    placed = rows.withColumn(name, of_cell(first[:-1]) + F.pmod(F.xxhash64("rid"), F.greatest(of_cell(cuts), F.lit(1))).cast("int"))
    ends = [F.array(*(f(F.col("far")[p]) for p in range(pivots))).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return placed.groupBy(name).agg(F.collect_list(F.struct("rid", "vec_id", "v", "far", *extra)).alias("rows"), *ends, F.max("norm").alias("norm"), F.min("start").alias("weakest")), first[-1]


def top_k(vectors: DataFrame, is_query, top: int = TOP, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of `vectors` (vec_id, embedding) that `is_query` selects, over every other row.

    Vectors that are null or hold null or non-finite components, and rows without a vec_id, take no part;
    empty vectors score 0, and vectors of unequal length are compared as if filled up with zeros. Ties rank by
    smaller vec_id; a query with fewer than `top` candidates gets them all. Rows that repeat a vec_id are rows
    of their own: each asks for itself and finds the others. Vectors too wide for exact doubles are scored in
    whole numbers without bound, one by one; a score beyond a long ranks by its true value and is returned as
    the nearest long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    sound = checkpoint(sound_vectors(vectors, is_query))
    # bounded: `sample` vectors come to the driver and go with the tasks
    known = sorted(bounded_sample(sound, "rid", sample).collect(), key=lambda r: r.rid)
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, pivots = max(1, sound.agg(F.max(F.size("v"))).first()[0]), min(pivots, len(known))
    rows = checkpoint(_table(sound, known, width, pivots, top, scale))
    candidates, number = _blocks(rows, "block", CANDIDATE_ROWS, pivots, [])
    queries, parts = _blocks(rows.where("asks"), "part", QUERY_ROWS, pivots, ["start"])
    candidates, queries = checkpoint(candidates), checkpoint(queries)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    ends = candidates.select("block", *(F.col(c).alias(f"block_{c}") for c in ("low", "high", "norm")))
    met = queries.select("part", "low", "high", "norm", "weakest", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block")).join(ends, "block")
    apart = F.zip_with("low", "block_high", lambda x, y: x - y), F.zip_with("block_low", "high", lambda x, y: x - y)
    least = F.greatest(*(F.array_max(a) for a in apart), F.lit(0.0)).cast("double")
    norms = F.col("norm") + F.col("block_norm")
    alive = met.where((norms - least * least) / 2 + SLACK * (norms + 1) >= F.col("weakest")).select("part", "block")
    spread = alive.join(queries.select("part", F.col("rows").alias("asked")), "part")
    # a number of partitions of its own: blocks are few and heavy in work, not in bytes
    pairs = spread.join(candidates.select("block", "rows").repartition(2 * number, "block"), "block")

    def parse(rows: pa.Scalar) -> tuple[pa.Array, Rows, np.ndarray]:
        fields = rows.values
        return fields, Rows(_lists(fields.field("v")), width, scale), np.stack(_lists(fields.field("far")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("rows")):
                mine, asking, mine_far = parse(asked)
                theirs, here, far = parse(held)
                rids, ids, query_rids, query_ids = theirs.field("rid").to_numpy(), theirs.field("vec_id").to_numpy(), mine.field("rid").to_numpy(), mine.field("vec_id").to_numpy()
                found, _ = best_rows(asking, query_rids, mine_far, mine.field("start").to_numpy(), here, rids, ids, far, top)
                q, r = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
                scores = pa.array([max(-LONG_END, min(LONG_END - 1, x[2])) for x in found], pa.int64())
                beyond = pa.array([sortable(x[2]) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(query_rids[q]), pa.array(query_ids[q]), pa.array(ids[r]), scores, beyond], ["rid", "query_id", "vec_id", "score", "beyond"])

    found = pairs.select("asked", "rows").mapInArrow(run, "rid long, query_id long, vec_id long, score long, beyond string")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
