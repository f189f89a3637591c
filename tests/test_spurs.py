"""Spur removal on paths that fold, nest and stand still, in pieces of several sizes."""

import random

import numpy as np

from strideframe.operators import paths, spurs
from strideframe.operators.paths import Paths


def folded(nodes):
    out = []
    for n in nodes:
        if len(out) >= 2 and out[-2] == n:
            out.pop()
        else:
            out.append(n)
    return out


def walks():
    rng = random.Random(3)
    out = [[1], [1, 2, 1], [1, 1, 1], [1, 1], [1, 2, 3, 2, 1], [1, 2, 3, 2, 4, 2, 1, 5], [1, 2, 3, 1, 3, 2, 1, 2, 3, 1]]
    for _ in range(40):
        at, walk = rng.randrange(6), []
        for _ in range(rng.randrange(1, 120)):
            walk.append(at)
            back = len(walk) > 1 and rng.random() < 0.5
            at = walk[-2] if back else rng.randrange(6)
        out.append(walk)
    there = [rng.randrange(50) for _ in range(90)]
    out += [there + there[-2::-1], there + there[-2::-1] + there[1:40]]  # spurs over many pieces
    return out


def test_every_walk_is_folded(spark):
    data = walks()
    df = spark.createDataFrame([(i, k, n) for i, w in enumerate(data) for k, n in enumerate(w)], "course_id long, seq long, node_id long")
    for chunk in (paths.CHUNK, 2, 7, 64):
        got = {}
        for r in paths.strip_spurs(Paths(df), chunk=chunk).orderBy("course_id", "seq").collect():
            got.setdefault(r.course_id, []).append(r.node_id)
            assert r.seq == len(got[r.course_id]) - 1
        assert got == {i: folded(w) for i, w in enumerate(data)}


def test_products_invert_and_scan():
    rng = np.random.default_rng(1)
    h = rng.integers(0, spurs.PRIME, (50, 3))
    there, back, stay = (spurs.step_matrices(np.full(50, t), h) for t in (1, -1, 0))
    one = np.tile([1, 0, 0, 1], (50, 1))
    assert (spurs._times(there, back) == one).all() and (spurs._times(stay, stay) == one).all()
    first = np.zeros(50, bool)
    first[[0, 13, 14, 31]] = True
    got, want = spurs.prefix_products(there, first), []
    for k in range(50):
        want.append(there[k:k + 1] if first[k] else spurs._times(want[-1], there[k:k + 1]))
    assert (got == np.concatenate(want)).all()
