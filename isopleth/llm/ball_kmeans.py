"""Exact centroid clustering by balls.

A cluster is a ball: its centroid and a radius that holds its members. Two clusters are neighbours if half the
gap between their centroids is within a ball's radius. A member nearer to its centroid than half the gap to the
nearest neighbour is in the stable core and stays; the others lie in annuli, and one in the n-th annulus is
compared with the n nearest neighbours only. All of it is whole-number arithmetic, so the result is that of
comparing every vector with every centroid.

A round is one pass: it writes each vector with its cluster, and beside them the sums, numbers and radii of what
the task has assigned, so that nothing but k rows of totals comes to the driver.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder
from .pivot_topk import DOUBLE_EXACT, LONG_END
from .pivot_topk import _floors as whole_numbers

K, ROUNDS, SCALE, WIDTH = 16, 3, 64, 64
#: Tasks that add up what the tasks of a round have written.
MERGERS = 32

Point = list[int]


def _square(a: Sequence[int], b: Sequence[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


class Balls:
    """Centroids with each one's neighbours in the order of their gaps; without radii every other centroid is a neighbour."""

    def __init__(self, centroids: list[Point], radii: list[int] | None = None) -> None:
        self.centroids = centroids
        gaps = [[_square(a, b) for b in centroids] for a in centroids]
        self.near: list[list[int]] = []
        for i, row in enumerate(gaps):
            within = [j for j in range(len(row)) if j != i and (radii is None or row[j] <= 4 * radii[i] ** 2)]
            self.near.append(sorted(within, key=lambda j: (row[j], j)))
        # squared gaps, four times a squared distance and every term of one stay exact in doubles below this
        self.limit = math.isqrt(DOUBLE_EXACT // (16 * max(1, len(centroids[0])))) - 1
        self.plain = all(abs(x) <= self.limit for c in centroids for x in c)
        if self.plain:
            self.table = np.array(centroids, float)
            self.norms = (self.table**2).sum(1)
            self.gaps = [np.array([gaps[i][j] for j in near], float) for i, near in enumerate(self.near)]

    def nearest(self, rows: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of plain rows, and the number of distances computed; `own`: the clusters before."""
        norms = (rows**2).sum(1)
        if own is None:
            square = norms[:, None] - 2 * rows @ self.table.T + self.norms[None]
            best = square.argmin(1)
            return best, square[np.arange(len(rows)), best], square.size
        best, far = own.copy(), norms - 2 * (rows * self.table[own]).sum(1) + self.norms[own]
        computed = len(rows)
        for i in np.unique(own).tolist():
            at = np.flatnonzero(own == i)
            annulus = np.searchsorted(self.gaps[i], 4 * far[at], side="right")  # 0: the stable core
            for ring in np.unique(annulus[annulus > 0]).tolist():
                some = at[annulus == ring]
                met = np.array(sorted([i, *self.near[i][:ring]]))
                square = norms[some, None] - 2 * rows[some] @ self.table[met].T + self.norms[met][None]
                first = square.argmin(1)  # of equal distances the smaller number
                best[some], far[some] = met[first], square[np.arange(len(some)), first]
                computed += square.size - len(some)
        return best, far, computed

    def nearest_of(self, point: Point) -> tuple[int, int]:
        return min((_square(point, c), i) for i, c in enumerate(self.centroids))[::-1]


class Totals:
    """Number, componentwise sum, summed and greatest squared distance of each cluster's vectors."""

    def __init__(self) -> None:
        self.of: dict[int, list] = {}

    def add(self, cluster: int, n: int, sums: Sequence[int], inertia: int, far: int) -> None:
        got = self.of.setdefault(cluster, [0, [0] * len(sums), 0, 0])
        self.of[cluster] = [got[0] + n, [a + b for a, b in zip(got[1], sums)], got[2] + inertia, max(got[3], far)]

    def rows(self) -> list[tuple[int, str]]:
        return [(c, json.dumps(t)) for c, t in self.of.items()]


def _pass(rows: DataFrame, balls: Balls, scale: int, kind: str, first: bool) -> DataFrame:
    """(vec_id, v, cluster, distance, total): every vector assigned, then a row of totals for each cluster that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        schema = None
        for batch in batches:
            v = batch.column("v")
            schema = schema or pa.schema([("vec_id", batch.column("vec_id").type), ("v", v.type), ("cluster", pa.int32()), ("distance", pa.int64()), ("total", pa.string())])
            if not batch.num_rows:
                continue
            raw = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                points = np.floor(raw * scale)
            plain = (np.abs(points) <= balls.limit).all(1) & balls.plain
            own = None if first else batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            if plain.any():
                cluster[plain], square, _ = balls.nearest(points[plain], None if first else own[plain])
                far[plain] = square.astype(np.int64)
                here = points[plain].astype(np.int64)
                for i in np.unique(cluster[plain]).tolist():
                    mine = cluster[plain] == i
                    totals.add(i, int(mine.sum()), here[mine].sum(0).tolist(), int(far[plain][mine].sum()), int(far[plain][mine].max()))
            for at in np.flatnonzero(~plain).tolist():  # too wide for exact doubles: one by one
                point = whole_numbers(raw[at], scale)
                i, square = balls.nearest_of(point)
                cluster[at], far[at] = i, min(square, LONG_END - 1)
                totals.add(i, 1, point, square, square)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(cluster), pa.array(far), pa.nulls(batch.num_rows, pa.string())], schema=schema)
        if totals.of:
            done = totals.rows()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(done), schema.field(0).type), pa.nulls(len(done), schema.field(1).type), pa.array([c for c, _ in done], pa.int32()), pa.nulls(len(done), pa.int64()), pa.array([t for _, t in done])], schema=schema)

    return rows.mapInArrow(run, f"{kind}, cluster int, distance long, total string")


def _totals(state: DataFrame) -> dict[int, list]:
    """Totals of a round; a bounded number of tasks add up the rows of all tasks, so the driver gets k rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        for batch in batches:
            for cluster, text in zip(batch.column("cluster").to_pylist(), batch.column("total").to_pylist()):
                totals.add(cluster, *json.loads(text))
        done = totals.rows()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int32()), pa.array([t for _, t in done], pa.string())], ["cluster", "total"])

    merged = Totals()
    parts = state.where("total is not null").select("cluster", "total")
    for r in parts.repartition(MERGERS).mapInArrow(run, "cluster int, total string").collect():
        merged.add(r.cluster, *json.loads(r.total))
    return merged.of


def sound_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, v) of the rows whose vectors have exactly `width` components, all finite."""
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    v = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == width) & finite).select("vec_id", v.alias("v"))


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, salt: str = "1:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row of `vectors` (vec_id, embedding) with a sound vector.

    Components become floor(scale * x). The k vectors whose sha256 of `salt` and vec_id is least are the first
    centroids (equal ids by their components, rows without an id last); `rounds` times all vectors go to the
    nearest centroid and centroids to the floor of their vectors' mean, then all are assigned once more. Equal
    distances go to the smaller number, a centroid without vectors stays. Vectors that are null, of another
    length or not finite give no row; repeated rows count each; fewer than k vectors make as many clusters, an
    empty table no rows. Other columns are not looked at. Vectors too wide for exact doubles are compared one by
    one in whole numbers with all centroids (as all are, once a centroid is so wide); distances and sums beyond
    a long are returned as the greatest long.
    """
    spark, rows = vectors.sparkSession, sound_vectors(vectors, width)
    chosen = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec_id", "v").limit(k).collect()
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    if not chosen:
        return spark.createDataFrame([], f"{kind.split(',')[0]}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [whole_numbers(np.array(r.v, float), scale) for r in chosen]
    folder, held, radii = f"{shared_folder(spark)}/ball-kmeans-{uuid.uuid4()}", None, None
    for turn in range(rounds + 1):
        path = f"{folder}/{turn}"
        _pass(rows, Balls(centroids, radii), scale, kind, turn == 0).write.parquet(path)
        if held:
            remove_folder(spark, held)
        state, held = spark.read.parquet(path), path
        totals = _totals(state)
        if turn < rounds:
            before = centroids
            centroids = [[x // totals[i][0] for x in totals[i][1]] if i in totals else c for i, c in enumerate(before)]
            # a ball about the new centroid that holds all members: the old radius and the way that the centroid went
            radii = [(math.isqrt(totals[i][3]) + 1 if i in totals else 0) + math.isqrt(_square(c, before[i])) + 1 for i, c in enumerate(centroids)]
            rows = state.where("total is null").select("vec_id", "v", "cluster")
    most = LONG_END - 1
    inertia = min(most, sum(t[2] for t in totals.values()))
    of = [(i, min(most, totals[i][2]) if i in totals else 0, inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # k rows
    told = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.where("total is null").select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
