"""Operators on embeddings against brute force: odd vectors, ties, repeated rows, many cells, trees and slots, empty tables."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.llm import ball_kmeans, hard_negatives, metric_join
from isopleth.llm.pivot_topk import LONG_END

KIND = "vec_id long, embedding array<double>, label int, cluster int, score string, rows string"


def floors(v, scale):
    return [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], KIND).repartition(parts)


def some_rows(wide):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=5).tolist(), int(rnd.integers(3))) for i in range(250)]
    near = rnd.normal(size=5)
    rows += [(i, (near + rnd.normal(size=5) * 0.1).tolist(), i % 3) for i in range(250, 340)]
    rows += [(i, rows[7][1], rows[7][2]) for i in range(340, 350)]  # ties
    rows += [(3, rows[3][1], rows[3][2]), (4, rows[3][1], 2), (3, rows[9][1], rows[9][2])]  # ids and rows that repeat
    rows += [(500, None, 1), (501, [], 1), (502, [math.nan] + [1.0] * 4, 1), (503, [0.0] * 5, 1), (None, [1.0] * 5, 1), (504, [1.0] * 5, None), (505, [None] * 5, 1), (506, [1.0, 0.0], 2), (507, [0.98, math.sqrt(1 - 0.98**2)], 2), (508, [math.inf] * 5, 0)]
    return rows + ([(509, [1e300] * 5, 2), (510, [-1e300, 1e9, 0.0, 0.0, 0.0], 2), (511, [1e9, 2.0, 3.0, 4.0, 5.0], 1), (513, [3e8] * 3, 0), (514, [1e-300] * 5, 2)] if wide else [])


def clusters(rows, k=16, rounds=3, width=5):
    known = [(r[0], floors(r[1], 64)) for r in rows if finite(r[1]) and len(r[1]) == width]
    first = sorted(known, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    centroids = [c for _, c in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in known]
        members = [[x for (_, x), c in zip(known, of) if c == i] for i in range(len(centroids))]
        centroids = [[sum(axis) // len(m) for axis in zip(*m)] if m else c for m, c in zip(members, centroids)]
    far, total = [near(x) for _, x in known], collections.Counter()
    for d, i in far:
        total[i] += d
    cut = lambda x: min(x, LONG_END - 1)
    return sorted(((r[0], i, cut(d), cut(total[i]), cut(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for r, (d, i) in zip(known, far)), key=repr)


@pytest.mark.parametrize("wide", [False, True])
def test_ball_kmeans(spark, wide):
    rows = some_rows(wide)
    got = ball_kmeans.ball_kmeans(frame(spark, rows), width=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == clusters(rows)


def test_ball_kmeans_with_few_or_no_vectors(spark):
    rows = [(1, [1.0] * 5, 1), (2, [2.0] * 5, 1), (2, [2.0] * 5, None)]
    assert sorted(map(tuple, ball_kmeans.ball_kmeans(frame(spark, rows), width=5).collect()), key=repr) == clusters(rows)
    assert ball_kmeans.ball_kmeans(frame(spark, rows), width=64).count() == 0
    assert ball_kmeans.ball_kmeans(frame(spark, [])).count() == 0


def test_balls_skip_what_their_radii_rule_out():
    rnd = np.random.default_rng(1)
    centroids = [[1000 * i, 0] for i in range(8)]
    rows = np.floor(np.array([centroids[i % 8] for i in range(800)]) + rnd.normal(size=(800, 2)) * 250)
    balls = ball_kmeans.Balls(centroids, [1100] * 8)
    own = np.arange(800) % 8
    best, far, computed = balls.nearest(rows, own)
    square = ((rows[:, None] - np.array(centroids)[None]) ** 2).sum(2)
    assert (best == square.argmin(1)).all() and (far == square.min(1)).all()
    assert computed < 800 * 8 / 3 and all(len(n) <= 4 for n in balls.near)
    assert (ball_kmeans.Balls(centroids, [400] * 8).near) == [[]] * 8


def links(rows, least=0.98):
    ok = [finite(r[1]) and None not in (r[0], r[2]) and any(r[1]) for r in rows]
    near = collections.defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if math.fsum(x * y) / math.sqrt(math.fsum(x * x)) / math.sqrt(math.fsum(y * y)) >= least:
                    near[i].add(j), near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        least_id = min(rows[j][0] for j in seen) if ok[i] else r[0]
        out.append((r[0], len(near[i]), least_id, least_id is None or least_id == r[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_rows, slot_rows", [(1024, 2048), (16, 2048), (16, 20), (8, 7)])
def test_metric_join(spark, monkeypatch, cell_rows, slot_rows):
    monkeypatch.setattr(metric_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(metric_join, "SLOT_ROWS", slot_rows)
    rows = some_rows(True)
    got = metric_join.near_duplicates(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == links(rows)
    assert metric_join.near_duplicates(frame(spark, [])).count() == 0


def test_cells_leave_out_only_what_has_no_partner():
    rnd = np.random.default_rng(2)
    base = metric_join.units(rnd.normal(size=(40, 4)))
    points = metric_join.units(np.repeat(base, 25, axis=0) + rnd.normal(size=(1000, 4)) * 0.05)
    reach = 0.1
    pivots = metric_join.spread_pivots(list(points[::17]), 2 * reach)
    m = 1 << (len(pivots).bit_length() - 1)
    home, away, _ = metric_join.Cells(pivots, reach).home(points, m)
    ends = {(4, m, c): (away[home == c].min(), away[home == c].max()) for c in range(m) if (home == c).any()}
    home, _, row, cell, _ = metric_join.Cells(pivots, reach, ends).visits(points, m)
    sent = set(zip(row.tolist(), cell.tolist()))
    i, j = np.nonzero(np.triu(((points[:, None] - points[None]) ** 2).sum(2) <= reach**2, 1))
    apart = home[i] != home[j]
    assert apart.sum() > 50 and len(sent) < 1000 * (m - 1) / 4
    assert all(((x, int(home[y])) in sent) != ((y, int(home[x])) in sent) or {(x, int(home[y])), (y, int(home[x]))} & sent for x, y in zip(i[apart].tolist(), j[apart].tolist()))


def hard(rows, every=3):
    known = [r for r in rows if None not in r and finite(r[1])]
    v = [floors(r[1], 256) for r in known]
    cut, out = (lambda x: max(-LONG_END, min(LONG_END - 1, x))), []
    for i, anchor in enumerate(known):
        if anchor[0] % every:
            continue
        scores = [(sum(x * y for x, y in zip(v[i], v[j])), known[j][0], known[j][2] == anchor[2]) for j in range(len(known)) if j != i]
        for p, positive in sorted(((s, n) for s, n, same in scores if same), key=lambda t: (-t[0], t[1]))[:5]:
            below = sorted(((s, n) for s, n, same in scores if not same and 80 * p <= 100 * s <= 100 * p), key=lambda t: (-t[0], t[1]))[:5]
            out += [(anchor[0], positive, rank, n, cut(p), cut(s)) for rank, (s, n) in enumerate(below, 1)]
    return sorted(out)


@pytest.mark.parametrize("tree_rows, leaf_rows, anchor_rows, run", [(4096, 64, 512, 16), (32, 4, 16, 2), (50, 8, 1000, 100)])
def test_hard_negatives(spark, monkeypatch, tree_rows, leaf_rows, anchor_rows, run):
    for name, value in dict(TREE_ROWS=tree_rows, LEAF_ROWS=leaf_rows, ANCHOR_ROWS=anchor_rows, RUN=run).items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_rows(True)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 3 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == hard(rows)


def test_hard_negatives_of_nothing(spark):
    rows = frame(spark, some_rows(False))
    assert hard_negatives.mine(rows, F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(frame(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1)]), F.lit(True)).count() == 0


def test_trees_prune_outside_the_window():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(32, 8)) * 4
    points = [centres[i // 100] + rnd.normal(size=8) * 0.1 for i in range(3200)]
    tree = hard_negatives.Tree(hard_negatives.Rows(points, 8, 256))
    asking = hard_negatives.Rows(points[:20], 8, 256)
    labels = np.zeros(3200, np.int64)
    state = hard_negatives.Windows(asking, np.arange(20), np.zeros(20, np.int64), np.arange(20), np.full(20, -np.inf), np.full(20, np.inf), [(None, None)] * 20, True, 5)
    state.meet(tree, np.arange(3200), np.arange(3200), labels)
    assert state.scored < 20 * 3200 / 4
    scores = asking.plain @ hard_negatives.Rows(points, 8, 256).plain.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    want = [(w, int(i), int(scores[w, i])) for w in range(20) for i in np.lexsort((np.arange(3200), -scores[w]))[:5]]
    assert state.result() == want
