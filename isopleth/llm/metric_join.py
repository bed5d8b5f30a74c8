"""Exact near-duplicates of embeddings by a metric range join.

Vectors of one label lie on the unit sphere, where a cosine of `least` or more is a distance within a radius.
Pivots partition them: a vector's home is the cell of its nearest pivot. The triangle inequality says which
other cells may hold partners of a vector, so it is sent there too, in one of the two directions between any two
cells. Then every cell joins by itself; a cell with many rows is cut into slots that meet pair by pair. Links
stay in the task: out come each vector's number of links and the least vector that it is connected with there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import components
from .common import bounded_sample, checkpoint, small

LEAST = 0.98
#: Rows of a label for each cell, and the greatest number of cells, powers of two; the pivots come from a sample of this size.
CELL_ROWS, CELLS = 1024, 512
#: Rows of a slot, and rows compared at once.
SLOT_ROWS, CHUNK = 2048, 512
#: Distances are compared with this much to spare; cosines nearer than TIE to the threshold are computed again.
SLACK, TIE = 1e-6, 1e-9

_KEYS = ["label", "width", "cell"]


def units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; their greatest component comes first to 1, so that squares neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def marked(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, h, g) of every row; h and g are digests of label and vector, null for rows that link with nothing."""
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    v = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    known = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    sound = F.coalesce(known & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", v.alias("v"), sound.alias("sound"))
    return rows.select("vec_id", "label", "v", F.when(F.col("sound"), F.xxhash64("label", "v")).alias("h"), F.when(F.col("sound"), F.xxhash64("v", F.lit("second"), "label")).alias("g"))


def spread_pivots(known: list[np.ndarray], apart: float) -> np.ndarray:
    """Those of the known vectors, at length 1, that are farther than `apart` from each one taken before: a dense group gets one pivot."""
    points = np.zeros((len(known), max(map(len, known), default=1)))
    for i, v in enumerate(known):
        points[i, : len(v)] = units(v[None])[0]
    taken: list[int] = []
    for i, point in enumerate(points):
        if not taken or ((points[taken] - point) ** 2).sum(1).min() > apart**2:
            taken.append(i)
    return points[taken]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Cells:
    """The pivots as any number of dimensions sees them, and what is known of the cells of their first m."""

    def __init__(self, pivots: np.ndarray, reach: float, ends: dict[tuple[int, int, int], tuple[float, float]] | None = None) -> None:
        self.pivots, self.reach, self.ends = pivots, reach, ends
        self.seen: dict[tuple[int, int], tuple] = {}

    def _of(self, width: int, m: int) -> tuple:
        if (width, m) not in self.seen:
            points = np.zeros((m, width))
            held = self.pivots[:m, :width]
            points[: len(held), : held.shape[1]] = held
            gaps = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0)) if self.ends is not None else None
            near, far = np.full(m, np.inf), np.full(m, -np.inf)
            for c in range(m) if self.ends else ():
                near[c], far[c] = self.ends.get((width, m, c), (np.inf, -np.inf))
            self.seen[width, m] = points, gaps, near, far
        return self.seen[width, m]

    def home(self, rows: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, the distance to it, and those to all."""
        points = self._of(rows.shape[1], m)[0]
        square = 1 + (points**2).sum(1)[None] - 2 * rows @ points.T
        far = np.sqrt(np.maximum(square, 0))
        home = far.argmin(1)
        return home, far[np.arange(len(rows)), home], far

    def visits(self, rows: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Home, its distance, and (row, cell, distance to its pivot) of each visit.

        A row visits a cell unless every point of it is farther than the radius: because the ball of the cell
        is, or the plane halfway between the two pivots, or by half the difference of the distances to them. Of
        two cells the rows of one only visit the other, by turns.
        """
        _, gaps, near, far_end = self._of(rows.shape[1], m)
        home, away, far = self.home(rows, m)
        cells = np.arange(m)
        turn = (cells[None] - cells[:, None]) % m
        sent = (turn > 0) & ((2 * turn < m) | ((2 * turn == m) & (cells[:, None] < cells[None])))
        between = gaps[home]
        plane = np.divide(far**2 - away[:, None] ** 2, 2 * between, out=np.zeros_like(far), where=between > SLACK)
        apart = np.maximum.reduce([(far - away[:, None]) / 2, plane, far - far_end[None], near[None] - far])
        row, cell = np.nonzero(sent[home] & (apart <= self.reach))
        return home, away, row, cell, far[row, cell]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(width, m, positions, unit vectors) of the rows that are alike in width and number of cells."""
    width, m = batch.column("width").to_numpy(), batch.column("m").to_numpy()
    for w, n in sorted(set(zip(width.tolist(), m.tolist()))):
        at = np.flatnonzero((width == w) & (m == n))
        yield w, n, at, units(_matrix(batch.column("v").take(pa.array(at))))


def _ends(rows: DataFrame, cells: Cells) -> dict[tuple[int, int, int], tuple[float, float]]:
    """Nearest and farthest row of each cell; its number is bounded by that of cells and of widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            for w, m, _, points in _grouped(batch):
                home, away, _ = cells.home(points, m)
                for c in np.unique(home).tolist():
                    some = away[home == c]
                    low, high = found.get((w, m, c), (np.inf, -np.inf))
                    found[w, m, c] = min(low, float(some.min())), max(high, float(some.max()))
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([found[k][i] for k in keys], pa.float64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays(columns, ["width", "m", "cell", "near", "far"])

    merged = rows.select("width", "m", "v").mapInArrow(run, "width int, m int, cell int, near double, far double").groupBy("width", "m", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    return {(r.width, r.m, r.cell): (r.near, r.far) for r in merged.collect()}


def _placed(rows: DataFrame, cells: Cells, element: str, counting: bool) -> DataFrame:
    """Rows in their home and in the cells that they visit, (label, width, cell, home, cid, n, away, v); `counting`: the number of rows alone."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, m, at, points in _grouped(batch):
                home, away, row, cell, far = cells.visits(points, m)
                at = np.concatenate([at, at[row]])
                keys = [batch.column("label").take(pa.array(at)), pa.array(np.full(len(at), w, np.int32)), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(len(at)) < len(home))]
                if counting:
                    counted = pa.table(keys, [*_KEYS, "home"]).group_by([*_KEYS, "home"]).aggregate([([], "count_all")])
                    yield from counted.select([*_KEYS, "home", "count_all"]).rename_columns([*_KEYS, "home", "n"]).to_batches()
                else:
                    rest = [batch.column(c).take(pa.array(at)) for c in ("cid", "n")]
                    yield pa.RecordBatch.from_arrays([*keys, *rest, pa.array(np.concatenate([away, far])), batch.column("v").take(pa.array(at))], [*_KEYS, "home", "cid", "n", "away", "v"])

    keys = f"label {label}, width int, cell int, home boolean"
    return rows.mapInArrow(run, f"{keys}, n long" if counting else f"{keys}, cid long, n long, away double, v array<{element}>")


def pairs_within(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, away_a: np.ndarray, away_b: np.ndarray, least: float, reach: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of a and b whose cosine is `least` or more; `same`: a is b, and each pair counts once.

    Both are in the order of their distance to the pivot. Rows whose distances differ by more than the radius
    are too far apart by the triangle inequality, so a chunk meets a run of b only.
    """
    left, right = [], []
    for at in range(0, len(a), CHUNK):
        some = slice(at, min(at + CHUNK, len(a)))
        lo, hi = np.searchsorted(away_b, (away_a[at] - reach, away_a[some.stop - 1] + reach + SLACK))
        if same:
            lo = max(lo, at)
        cos = a[some] @ b[lo:hi].T
        good = cos >= least + TIE
        for x, y in zip(*np.nonzero((cos >= least - TIE) & ~good)):
            good[x, y] = cosine(raw_a[at + x], raw_b[lo + y]) >= least
        x, y = np.nonzero(good)
        x, y = x + at, y + lo
        if same:
            x, y = x[x < y], y[x < y]
        left.append(x)
        right.append(y)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that each of n is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def _join(groups: DataFrame, least: float, reach: float) -> DataFrame:
    """(cid, links, root) of the rows with links inside a group: copies linked, and the least cid connected there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("rows")):
                fields = rows.values
                order = np.lexsort((fields.field("cid").to_numpy(), fields.field("away").to_numpy()))
                cid, n, away, slot = (fields.field(c).to_numpy()[order] for c in ("cid", "n", "away", "slot"))
                raw = _matrix(fields.field("v").take(pa.array(order)))
                unit = units(raw)
                mine, other = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
                met = [(mine, mine, True)] if i == j else [(mine, other, False)]
                if j < 0:  # the whole cell
                    mine, other = np.flatnonzero(slot == 0), np.flatnonzero(slot != 0)
                    met = [(mine, mine, True), (mine, other, False)]
                found = [(np.zeros(0, np.int64),) * 2]
                for a, b, same in met:
                    if len(a) and len(b):
                        x, y = pairs_within(unit[a], unit[b], raw[a], raw[b], away[a], away[b], least, reach, same)
                        found.append((a[x], b[y]))
                left, right = (np.concatenate(x) for x in zip(*found))
                links = np.zeros(len(cid), np.int64)
                np.add.at(links, left, n[right])
                np.add.at(links, right, n[left])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[roots(len(cid), left, right)[some]])], ["cid", "links", "root"])

    return groups.select("i", "j", "rows").mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors` (vec_id, embedding, label).

    Rows of equal labels link if the cosine of their vectors, in doubles, is `least` (over 0) or more; n_links is
    the number of other rows linked directly, component_id the least vec_id that links reach, kept tells the
    rows whose own it is. Null labels and ids, vectors that are null, empty, zero or not finite, and vectors of unequal
    length link with nothing; a row without an id has no component and is kept. Rows that repeat a vec_id or a
    vector are rows of their own: equal vectors of a label count as one with as many copies, so they are not
    expanded into pairs. An empty table gives no rows; other columns are not looked at. Every link is found:
    nothing is sampled but the pivots, CELLS rows at most.
    """
    rows = marked(vectors)
    element = rows.schema["v"].dataType.elementType.simpleString()
    copies = rows.where("h is not null").groupBy("h", "g").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("id"))
    copies = checkpoint(copies.select(F.monotonically_increasing_id().alias("cid"), "*", F.size("v").alias("width")))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    known = [np.array(r.v, float) for r in bounded_sample(copies, "cid", CELLS).select("v").collect()]
    pivots = spread_pivots(known, 2 * reach)

    # cells of a label and width: a power of two, so that few sets of cells are in use
    log = F.least(F.greatest(F.ceil(F.log2(F.count("*") / CELL_ROWS)), F.lit(0)), F.lit(max(1, len(pivots)).bit_length() - 1))
    sizes = small(copies.groupBy("label", "width").agg(log.cast("int").alias("log")).select("label", "width", F.expr("shiftleft(1, log)").alias("m")))
    sized = copies.join(sizes, ["label", "width"]).select("cid", "label", "width", "v", "n", "m")
    cells = Cells(pivots, reach, _ends(sized, Cells(pivots, reach)))

    # a cell whose rows fit in two slots is one group; any other meets slot by slot, homes with homes and with visitors
    counted = _placed(sized, cells, element, True)
    held = counted.groupBy(*_KEYS).agg(*(F.coalesce(F.sum(F.when(F.col("home") == h, F.col("n"))), F.lit(0)).alias(c) for c, h in (("homes", True), ("guests", False))))
    slots = [F.ceil(F.col(c) / SLOT_ROWS).cast("int") for c in ("homes", "guests")]
    large = held.where((F.col("homes") > 0) & (F.col("homes") + F.col("guests") > 2 * SLOT_ROWS)).select(*_KEYS, slots[0].alias("own"), slots[1].alias("more"))
    placed = _placed(sized, cells, element, False).join(small(large), _KEYS, "left")
    cut, own, here = F.col("own").isNotNull(), F.col("home"), F.col("slot")
    by_hash = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(F.col(n), F.lit(1)))
    dealt = placed.withColumn("slot", F.when(~cut, F.when(own, 0).otherwise(1)).when(own, by_hash("own")).otherwise(F.col("own") + by_hash("more")).cast("int"))
    every = F.when(own, F.sequence(F.lit(0), F.col("own") + F.col("more") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") - 1))
    met = F.when(cut, F.transform(every, lambda o: F.struct(F.least(here, o).alias("i"), F.greatest(here, o).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(-1).alias("j"))))
    sent = dealt.select(*_KEYS, "cid", "n", "away", "v", "slot", F.explode(met).alias("pair")).select(*_KEYS, "pair.i", "pair.j", F.struct("cid", "n", "away", "v", "slot").alias("row"))
    found = checkpoint(_join(sent.groupBy(*_KEYS, "i", "j").agg(F.collect_list("row").alias("rows")), least, reach))

    labels = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("id", "cid").withColumnRenamed("label", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = copies.select("cid", "h", "g", "n", "id").join(links, "cid", "left").join(labels, "cid", "left").where("n > 1 or links is not null")
    told = checkpoint(told.select("h", "g", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "cid").alias("root")))
    first = checkpoint(told.groupBy("root").agg(F.min("id").alias("component")))  # written out, so that a large component's join can be split
    info = checkpoint(told.join(first, "root").select("h", "g", "links", "component"))
    out = rows.select("vec_id", "h", "g").join(info, ["h", "g"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
