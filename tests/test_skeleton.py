"""Centre lines: thinning keeps what hangs together, and small blobs go."""

import numpy as np

from waygraph.operators import skeleton as S


def pieces(mask, corners):
    """Number of connected pieces, by flooding."""
    left, n = set(zip(*map(list, np.nonzero(mask)), strict=True)), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            r, c = todo.pop()
            for d in [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else []):
                if (p := (r + d[0], c + d[1])) in left:
                    left.remove(p)
                    todo.append(p)
    return n


def test_blobs_are_those_of_flooding():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        mask = rnd.random((17, 23)) < 0.55
        own = S.blobs(mask)
        assert len(np.unique(own[mask])) == pieces(mask, False)
        kept = S.drop_small(mask, 4)
        assert not (kept & ~mask).any()
        assert pieces(kept, False) == (np.unique(own[mask], return_counts=True)[1] >= 4).sum()


def test_a_bar_thins_to_a_line():
    mask = np.zeros((15, 60), bool)
    mask[4:11, 3:57] = True
    line = S.thin(mask)
    assert not (line & ~mask).any() and line[:, 20:40].sum() == 20
    assert pieces(line, True) == 1
    assert not (S.widen(line, mask, 2) & ~mask).any() and S.widen(line, mask, 2).sum() > line.sum()


def test_thinning_keeps_a_ring_whole():
    y, x = np.mgrid[:41, :41] - 20
    mask = (x * x + y * y < 300) & (x * x + y * y > 100)
    line = S.thin(mask)
    assert pieces(line, True) == 1 and pieces(~line, False) == 2  # inside and outside
    assert (S.thin(line) == line).all()


def test_points_of_odd_rows(spark):
    rows = [(1, -5, 7, 200.0), (1, -5, 7, 220.0), (1, None, 3, 250.0), (2, 0, 0, 10.0), (None, 0, 0, 250.0)]
    got = S.centre_points(spark.createDataFrame(rows, "tile long, x long, y long, v double"), 100).collect()
    assert [tuple(r) for r in got] == [(1, -5, 7, 220.0)]
    assert S.centre_points(spark.createDataFrame([], "tile long, x long, y long, v double"), 100).count() == 0
