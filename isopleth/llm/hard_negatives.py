"""Hard-negative mining by branch and bound over ball trees.

Rows are dealt to partitions of nearby vectors, and each is made into a ball tree: nodes with a centre and a
radius, and so an upper and a lower bound of every inner product with what is below. Blocks of anchors go through
the trees one after another and keep what they have found. A search asks for the first few rows of a window of
scores: a node is left out if its bounds lie outside the window, or strictly beneath the window's current last
place. Positives are such a search over all scores of the anchor's own label, negatives one over the window below each positive among
the other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint
from .pivot_topk import LONG_END, Rows, sortable

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least SHARE[0] / SHARE[1] of the positive's and at most the positive's.
SHARE = (80, 100)
#: Rows of a tree and of a leaf, rows of a block of anchors, trees that one task takes for a block in a row.
TREE_ROWS, LEAF_ROWS, ANCHOR_ROWS, RUN = 4096, 64, 512, 16
#: The most points that rows are gathered around.
PIVOTS = 1024
#: Bounds are raised by this share of their terms, for rounding.
SLACK = 1e-9

_ROW = "rid long, vec_id long, label long, asks boolean, v array<double>"


def sound_rows(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(rid, vec_id, label, asks, v) of the rows with an id, a label and a vector of finite components; rid tells rows apart."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), v.alias("v"))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


class Tree:
    """A ball tree over rows; `order` brings them into the order of the leaves. Rows too wide for exact doubles stay out of it."""

    def __init__(self, rows: Rows) -> None:
        self.rows = rows
        self.order = np.flatnonzero(~rows.wide)
        self.nodes: list[tuple[int, int, int, np.ndarray, float]] = []  # first and last row, right child (0: a leaf), centre, radius
        if len(self.order):
            self._grow(0, len(self.order))
        self.points = rows.plain[self.order]

    def _grow(self, lo: int, hi: int) -> int:
        here = self.rows.plain[self.order[lo:hi]]
        centre = here.mean(0)
        far = ((here - centre) ** 2).sum(1)
        number = len(self.nodes)
        self.nodes.append((lo, hi, 0, centre, float(np.sqrt(far.max()))))
        if hi - lo > LEAF_ROWS and far.max() > 0:
            one = here[far.argmax()]
            other = here[((here - one) ** 2).sum(1).argmax()]
            split = np.argpartition(here @ (other - one), middle := (hi - lo) // 2)
            self.order[lo:hi] = self.order[lo:hi][split]
            self._grow(lo, lo + middle)
            right = self._grow(lo + middle, hi)
            self.nodes[number] = (lo, hi, right, centre, self.nodes[number][4])
        return number


class Windows:
    """Searches of a block of anchors: the windows of scores, and the first `top` places of each so far."""

    def __init__(self, asking: Rows, rids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, exact: list[tuple[int | None, int | None]], same: bool, top: int) -> None:
        self.asking, self.rids, self.labels, self.of, self.low, self.high, self.exact, self.same, self.top = asking, rids, labels, of, low, high, exact, same, top
        self.norms = np.sqrt(asking.norms)
        self.best = np.full((len(of), top), -np.inf)  # scores of the first places, the last one first
        self.found: list[tuple[int, int, int]] = []  # window, id, score of rows too wide for doubles
        self.plain: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = 0

    def meet(self, tree: Tree, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> None:
        """Go through a tree; ids, rids and labels of its rows."""
        if tree.nodes:
            active = np.flatnonzero(~self.asking.wide[self.of])
            places = ids[tree.order], rids[tree.order], labels[tree.order]
            self._visit(tree, 0, active, *places)
        for w, a in enumerate(self.of.tolist()):
            some = range(len(ids)) if self.asking.wide[a] else np.flatnonzero(tree.rows.wide).tolist()
            for r in some:
                if rids[r] != self.rids[a] and (labels[r] == self.labels[a]) == self.same:
                    score = sum(x * y for x, y in zip(self.asking.exact(a), tree.rows.exact(r)))
                    low, high = self.exact[w]
                    if (low is None or score >= low) and (high is None or score <= high):
                        self.found.append((w, int(ids[r]), score))

    def _visit(self, tree: Tree, number: int, active: np.ndarray, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> None:
        lo, hi, right, centre, radius = tree.nodes[number]
        anchors, place = np.unique(self.of[active], return_inverse=True)
        middle, reach = self.asking.plain[anchors] @ centre, self.norms[anchors] * radius
        spare = SLACK * (self.norms[anchors] * np.sqrt((centre**2).sum()) + reach) + 1
        upper, lower = (middle + reach + spare)[place], (middle - reach - spare)[place]
        active = active[(upper >= np.maximum(self.low[active], self.best[active, 0])) & (lower <= self.high[active])]
        if not len(active):
            return
        if right:
            for child in sorted((number + 1, right), key=lambda c: -float((self.asking.plain[anchors] @ tree.nodes[c][3]).sum())):
                self._visit(tree, child, active, ids, rids, labels)
            return
        anchors, place = np.unique(self.of[active], return_inverse=True)
        scores = self.asking.plain[anchors] @ tree.points[lo:hi].T
        self.scored += scores.size
        alike = self.labels[anchors, None] == labels[None, lo:hi]
        usable = (alike if self.same else ~alike) & (self.rids[anchors, None] != rids[None, lo:hi])
        scores = np.where(usable, scores, -np.inf)[place]
        scores[(scores < self.low[active, None]) | (scores > self.high[active, None])] = -np.inf
        w, c = np.nonzero((scores >= self.best[active, :1]) & (scores > -np.inf))
        if len(w):
            self.plain.append((active[w], ids[lo:hi][c], scores[w, c]))
            touched = np.unique(w)
            self.best[active[touched]] = np.sort(np.concatenate([self.best[active[touched]], scores[touched]], axis=1), axis=1)[:, -self.top :]

    def result(self) -> list[tuple[int, int, int]]:
        """(window, id, score) of the first places of each window, ties by the smaller id."""
        w, i, s = (np.concatenate(x) for x in zip(*self.plain)) if self.plain else (np.zeros(0, np.int64),) * 3
        keep = s >= self.best[w, 0] if len(w) else np.zeros(0, bool)
        w, i, s = w[keep], i[keep], s[keep]
        order = np.lexsort((i, -s, w))
        w, i, s = w[order], i[order], s[order]
        first = np.arange(len(w)) - np.searchsorted(w, w) < self.top
        out = list(zip(w[first].tolist(), i[first].tolist(), map(int, s[first].tolist())))
        if self.found:
            out = sorted(out + self.found, key=lambda t: (t[0], -t[2], t[1]))
            out = [t for n, t in enumerate(out) if n < self.top or out[n - self.top][0] != t[0]]
        return out


def _whole(score: int, beyond: str | None) -> int:
    """The score that `sortable` wrote, or that fits a long."""
    if beyond is None:
        return score
    digits = beyond[7:]
    return int(digits) if beyond[0] == "1" else -int(digits.translate(str.maketrans("9876543210", "0123456789")))


def _trees(rows: DataFrame, sample: list, width: int, scale: int) -> tuple[DataFrame, int]:
    """(tree, rows): rows gathered around points of the sample into about TREE_ROWS each, a hash cutting what is more; and the number of trees."""
    total = rows.count()
    points = Rows([np.array(r.v) for r in sample], width, scale).plain[: max(1, min(PIVOTS, -(-total // TREE_ROWS)))]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = Rows(_vectors(batch.column("v")), width, scale).plain
            cell = ((points**2).sum(1)[None] - 2 * here @ points.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    placed = rows.mapInArrow(cells, f"{_ROW}, cell int")
    counts = dict(placed.groupBy("cell").count().collect())  # PIVOTS at most
    cuts = [-(-counts.get(c, 0) // TREE_ROWS) for c in range(len(points))]
    first = np.concatenate([[0], np.cumsum(cuts)]).tolist()
    of_cell = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("cell") + 1)
    tree = of_cell(first[:-1]) + F.pmod(F.xxhash64("rid"), F.greatest(of_cell(cuts), F.lit(1))).cast("int")
    return placed.groupBy(tree.alias("tree")).agg(F.collect_list(F.struct("rid", "vec_id", "label", "v")).alias("rows")), first[-1]


def _search(anchors: DataFrame, trees: DataFrame, number: int, width: int, scale: int, same: bool, top: int, share: tuple[int, int]) -> DataFrame:
    """(rid, slot, vec_id, score, beyond) of the first rows of each anchor's windows within each run of trees.

    anchors: (part, asked), asked holding (rid, label, v, positives); a positive is (slot, score, beyond).
    """
    runs = -(-number // RUN)
    asked = anchors.select("part", "asked", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    met = asked.join(trees.withColumn("run", F.floor(F.col("tree") / RUN).cast("int")), "run").select("part", "run", "tree", "asked", "rows")
    # dealt by block and run, so that a block takes the trees of a run one after another
    dealt = met.repartition("part", "run").sortWithinPartitions("part", "run", "tree")

    def begin(held: pa.Scalar) -> Windows:
        fields = held.values
        asking = Rows(_vectors(fields.field("v")), width, scale)
        rids, labels = fields.field("rid").to_numpy(), fields.field("label").to_numpy()
        of: list[int] = []
        exact: list[tuple[int | None, int | None]] = []
        slots: list[int] = []
        for a, positives in enumerate(fields.field("positives").to_pylist()):
            for p in positives or []:
                score = _whole(p["score"], p["beyond"])
                low = None if same else -(-share[0] * score // share[1])
                of.append(a), slots.append(p["slot"]), exact.append((low, None if same else score))
        low = np.array([-np.inf if x is None else float(max(-LONG_END, min(LONG_END, x))) for x, _ in exact])
        high = np.array([np.inf if x is None else float(max(-LONG_END, min(LONG_END, x))) for _, x in exact])
        state = Windows(asking, rids, labels, np.array(of, np.int64), low, high, exact, same, top)
        state.slots = np.array(slots, np.int32)
        return state

    def end(state: Windows) -> pa.RecordBatch:
        found = state.result()
        w = np.array([x[0] for x in found], np.int64)
        scores = pa.array([max(-LONG_END, min(LONG_END - 1, x[2])) for x in found], pa.int64())
        columns = [pa.array(state.rids[state.of[w]] if len(w) else [], pa.int64()), pa.array(state.slots[w] if len(w) else [], pa.int32()), pa.array([x[1] for x in found], pa.int64()), scores, pa.array([sortable(x[2]) for x in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["rid", "slot", "vec_id", "score", "beyond"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for part, turn, held, block in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), batch.column("asked"), batch.column("rows")):
                if (part, turn) != now:
                    if state:
                        yield end(state)
                    now, state = (part, turn), begin(held)
                fields = block.values
                tree = Tree(Rows(_vectors(fields.field("v")), width, scale))
                state.meet(tree, *(fields.field(c).to_numpy() for c in ("vec_id", "rid", "label")))
        if state:
            yield end(state)

    return dealt.mapInArrow(run, "rid long, slot int, vec_id long, score long, beyond string")


def _first(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("rid", "slot").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("place", place.cast("int")).where(F.col("place") <= top)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, share: tuple[int, int] = SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among `vectors` (vec_id, embedding, label).

    Scores are inner products of floor(scale * x); higher ones come first, ties by the smaller vec_id. An
    anchor's positives are its first `positives` other rows of its label, a positive's negatives the first
    `negatives` rows of other labels with share[0] * positive <= share[1] * negative <= share[1] * positive; a
    positive below 0 has none. Rows without an id, a label or a vector, or with components that are null or not
    finite, take no part; an empty vector scores 0, vectors of unequal length are filled up with zeros. Rows that repeat a vec_id are rows of
    their own. Vectors too wide for exact doubles are scored in whole numbers one by one; a score beyond a long
    counts by its true value and is returned as the nearest long. No anchors, or no rows, give no rows.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sound = checkpoint(sound_rows(vectors, is_anchor))
    # bounded: PIVOTS vectors come to the driver and go with the tasks
    sample = bounded_sample(sound, "rid", PIVOTS).collect()
    asking = sound.where("asks")
    if not sample or not (asked := asking.count()):
        return nothing
    width = max(1, sound.agg(F.max(F.size("v"))).first()[0])
    trees, number = _trees(sound, sample, width, scale)
    trees = checkpoint(trees)
    part = F.pmod(F.xxhash64("rid"), F.lit(-(-asked // ANCHOR_ROWS))).cast("int")

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct("rid", "label", "v", "positives")).alias("asked"))

    whole = F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("score"), F.lit(None).cast("string").alias("beyond")))
    near = _search(blocks(asking.withColumn("positives", whole)), trees, number, width, scale, True, positives, share)
    chosen = checkpoint(_first(near, positives).select("rid", F.col("place").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "beyond"))
    windows = chosen.groupBy("rid").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"), "beyond")).alias("positives"))
    hard = _first(_search(blocks(asking.join(windows, "rid")), trees, number, width, scale, False, negatives, share), negatives)
    named = chosen.select("rid", "slot", "positive_id", "positive_score").join(asking.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return hard.select("rid", "slot", "vec_id", "score", "place").join(named, ["rid", "slot"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
