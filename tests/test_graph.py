"""Paths, scores and invariants, on graphs small enough to know the answer."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from waygraph.operators import evaluate as ev
from waygraph.operators import labels, merge, nms, spatial
from waygraph.operators import routing as R
from waygraph.operators.graph import connected_components, split_edges

LINE = {0: (0.0, 0.0), 1: (10.0, 0.0), 2: (20.0, 0.0), 3: (30.0, 0.0)}
BASE = {"k": 3, "theta": 0.6, "tau": 20.0, "spacing": 10.0, "points": 20, "pairs": 20, "min_path": 1.0, "tolerance": 1.0, "hops": 0}


def graph(xy, edges):
    return R.adjacency((u, v, math.dist(xy[u], xy[v])) for u, v in edges)


def test_a_network_against_itself_is_perfect():
    adj = graph(LINE, [(0, 1), (1, 2), (2, 3)])
    rows = ev.od_rows(adj, LINE, adj, LINE, ev.Metric(**BASE | {"k": 1, "hops": 4}))
    assert rows and all(r["od"] == r["vanilla"] == 1.0 and r["routable"] for r in rows)


def test_shifted_geometry_costs_half():
    gt, pred = {0: (0.0, 0.0), 1: (100.0, 0.0)}, {0: (0.0, 10.0), 1: (100.0, 10.0)}
    got = ev.score_paths([(100.0, [0, 1])], [(100.0, [0, 1])], gt, pred, ev.Metric(**BASE))
    assert got[:3] == (0.75, 1.0, 0.5)


def test_no_route_no_score():
    xy = {0: (0.0, 0.0), 1: (10.0, 0.0), 2: (20.0, 0.0)}
    rows = ev.od_rows(graph(xy, [(0, 1), (1, 2)]), xy, {}, xy, ev.Metric(**BASE | {"k": 1}))
    assert rows and not any(r["routable"] or r["od"] for r in rows)


def test_missing_alternative_halves_the_score():
    xy = {0: (0.0, 0.0), 1: (10.0, 10.0), 2: (10.0, -10.0), 3: (20.0, 0.0)}
    gt, pred = graph(xy, [(0, 1), (1, 3), (0, 2), (2, 3)]), graph(xy, [(0, 1), (1, 3)])
    m = ev.Metric(**BASE | {"k": 2, "theta": 0.5, "min_path": 20.0})
    g, p = R.diverse(gt, 0, 3, 2, 0.5, 30), R.diverse(pred, 0, 3, 2, 0.5, 30)
    assert (len(g), len(p)) == (2, 1)
    assert ev.score_paths(g, p, xy, xy, m)[:3] == (0.5, 0.5, 0.5)


def test_overlap_limit_is_strict():
    a = {(0, 1): 10.0, (1, 2): 10.0}
    b = {(0, 1): 10.0, (1, 3): 6.0, (2, 3): 6.0}
    assert R.overlap(a, b) == 0.5 and not R.overlap(a, b) < 0.5


def test_simple_paths_are_all_in_order():
    rnd = random.Random(4)
    for _ in range(20):
        n = 6
        edges = [(u, v, rnd.randint(1, 9)) for u, v in itertools.combinations(range(n), 2) if rnd.random() < 0.6]
        adj = R.adjacency(edges)
        got = list(R.simple_paths(adj, 0, n - 1)) if 0 in adj and n - 1 in adj else []
        want = []
        for k in range(n - 1):
            for mid in itertools.permutations(range(1, n - 1), k):
                p = [0, *mid, n - 1]
                if all(b in adj.get(a, {}) for a, b in itertools.pairwise(p)):
                    want.append((sum(adj[a][b] for a, b in itertools.pairwise(p)), p))
        assert sorted(got) == sorted(want)
        assert [x for x, _ in got] == sorted(x for x, _ in want)


def test_bridges_match_removal():
    rnd = random.Random(7)
    for _ in range(30):
        edges = sorted({(u, v) for u, v in itertools.combinations(range(8), 2) if rnd.random() < 0.3})
        adj = R.adjacency((u, v, 1) for u, v in edges)
        count = len(R.parts(adj))
        want = [e for e in edges if len(R.parts({**{n: {} for n in adj}, **R.adjacency((u, v, 1) for u, v in edges if (u, v) != e)})) > count]
        assert R.bridges(adj) == want


def test_chains_cover_each_edge_once():
    adj = R.adjacency([(0, 1, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1), (5, 6, 1), (6, 7, 1), (5, 7, 1)])
    lines, loops = R.chains(adj)
    assert len(loops) == 1 and sorted(loops[0]) == [5, 6, 7]
    assert sum(len(p) - 1 for p in lines) == 4


def test_resample_keeps_ends_and_spacing():
    got = R.resample([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0)], 50.0)
    assert got[0] == (0, 0) and got[-1] == (100, 100) and len(got) == 5


def test_bounded_search_gives_the_first_paths():
    rnd = random.Random(9)
    xy = {i: (rnd.random(), rnd.random()) for i in range(40)}
    edges = [(u, v) for u, v in itertools.combinations(range(40), 2) if math.dist(xy[u], xy[v]) < 0.25]
    adj = graph(xy, edges)
    for t in range(1, 40, 4):
        whole = list(itertools.islice(R.simple_paths(adj, 0, t), 12))
        some = list(R.simple_paths(adj, 0, t, 12))
        assert [p for _, p in some] == [p for _, p in whole]
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(some, whole, strict=True))


def test_seats():
    assert R.seats([100.0, 10.0, 1.0], [9, 9, 9], 8) == [4, 2, 2]
    assert R.seats([100.0, 10.0], [3, 9], 8) == [3, 5]
    assert R.seats([5.0, 5.0], [1, 9], 4) == [1, 3]


def test_milestones_and_chains():
    adj = R.adjacency([(i, i + 1, 10.0) for i in range(6)])
    assert R.milestones(list(range(7)), adj, 25.0) == [0, 3, 6]
    assert R.control_points(adj, {i: (10.0 * i, 0.0) for i in range(7)}, 40.0, 20) == [0, 4, 6]
    assert R.chains(adj) == ([list(range(7))], [])


def test_spread_and_limits():
    xy = {i: (float(i), 0.0) for i in range(11)}
    assert R.spread(list(xy), xy, 1) == [5]
    assert set(R.spread(list(xy), xy, 3)) == {5, 0, 10}


def test_distances():
    a, b = [(0.0, 0.0), (10.0, 0.0)], [(0.0, 3.0), (10.0, 4.0)]
    assert R.hausdorff(a, b) == 4.0 == R.frechet(a, b)


def test_metric_is_checked():
    with pytest.raises(ValueError, match="not a metric"):
        ev.Metric(theta=0.0)


def test_rates_multiply(spark):
    n = [(g, s, i, float(10 * i), 0.0) for g in (1, 2) for s in ("gt", "pred") for i in range(6)]
    e = [(g, s, i, i + 1, 10.0) for g in (1, 2) for s in ("gt", "pred") for i in range(5) if not (s == "pred" and g == 2 and i == 2)]
    nodes = spark.createDataFrame(n, "graph_id long, side string, id long, x double, y double")
    edges = spark.createDataFrame(e, "graph_id long, side string, u long, v long, length double")
    s = ev.od_summary(ev.evaluate_pairs(nodes, edges, ev.Metric(**BASE)), ["graph_id"]).collect()
    for r in s:
        for c in ("combined", "length", "geometry"):
            assert abs(r[f"{c}_strict"] - r["route_availability"] * r[f"{c}_routable"]) < 1e-9
            assert abs(r[f"{c}_matched"] - r["connectivity_rate"] * r[f"{c}_routable"]) < 1e-9


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nms_equals_the_greedy_pass(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(0, 20)) for i in range(300)]
    kept = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 > 49 for q in kept):
            kept.append(p)
    got = nms.suppress(spark.createDataFrame(pts, "id long, x long, y long, score long"), 7).collect()
    assert sorted(tuple(r) for r in got) == sorted(kept)


def test_nms_of_a_long_line(spark):
    """Equal scores along a line: one point a round is accepted."""
    line = spark.createDataFrame([(i, i, 0, 1) for i in range(140)], "id long, x long, y long, score long")
    assert sorted(r["id"] for r in nms.suppress(line, 1).collect()) == list(range(0, 140, 2))


def test_snap_of_nothing_changes_nothing(spark):
    nodes = spark.createDataFrame([(1, 0, 0), (2, 5, 5), (3, 9, 0)], "nid long, x long, y long")
    assert all(r["nid"] == r["cid"] for r in merge.snap_clusters(nodes, 1).collect())


def test_radius_join_is_inclusive(spark):
    p = spark.createDataFrame([(1, -3, 0), (2, 0, 4), (3, 2, 4)], "id long, x long, y long")
    assert sorted((r["a"], r["b"]) for r in spatial.radius_join(p, 5, "id").collect()) == [(1, 2), (2, 3)]


def test_clip_equals_all_pairs(spark):
    rnd = random.Random(3)
    seg = [(i, *(float(rnd.randint(-50, 150)) for _ in range(4))) for i in range(60)]
    box = [(k, 30.0 * (k % 4), 30.0 * (k // 4), 30.0 * (k % 4) + 30, 30.0 * (k // 4) + 30) for k in range(16)]
    s = spark.createDataFrame(seg, "sid long, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(box, "bid long, x0 double, y0 double, xe double, ye double")
    length = {(r["sid"], r["bid"]): math.dist((r["cx1"], r["cy1"]), (r["cx2"], r["cy2"])) for r in spatial.clip(s, b, 40).collect()}
    for i, *p in seg:
        for k, *q in box:  # by stepping along the segment
            inside = [t for t in range(2001) if q[0] <= p[0] + t / 2000 * (p[2] - p[0]) <= q[2] and q[1] <= p[1] + t / 2000 * (p[3] - p[1]) <= q[3]]
            want = (len(inside) - 1) / 2000 * math.dist(p[:2], p[2:]) if inside else 0
            assert abs(length.get((i, k), 0) - want) < 0.5


def test_splitting_keeps_length(spark):
    e = spark.createDataFrame([(1, 2, 0.0, 0.0, 100.0, 0.0)], "u long, v long, x1 double, y1 double, x2 double, y2 double")
    got = split_edges(e, 30.0).orderBy("piece").collect()
    assert [r["x"] for r in got] == [0, 25, 50, 75, 100]


def test_empty_merge(spark):
    n = spark.createDataFrame([], "nid long, tile long, x long, y long")
    e = spark.createDataFrame([], "u long, v long, s long, t int")
    center, edges = merge.global_merge(n, e, 10, 250, 600)
    assert center.count() == edges.count() == 0
    assert edges.where(F.col("synthetic") == 1).count() == 0


def test_pair_labels_meet_in_the_middle(spark, monkeypatch):
    rnd = random.Random(11)
    truth = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(34)})
    near = {n: {n} for n in range(32)}
    for u, v in truth:
        near[u].add(v), near[v].add(u)
    pairs = [(u, v) for u in range(32) for v in range(32)] + [(3, 4), (3, 4)]
    went, hops = [], labels.hops
    monkeypatch.setattr(labels, "hops", lambda e, start, depth: went.append(depth) or hops(e, start, depth))
    df, e = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(truth, "u long, v long")
    within = {n: {n} for n in near}
    for depth in (1, 2, 3):
        within = {n: set().union(*(near[x] for x in have)) for n, have in within.items()}
        went.clear()
        got = sorted(tuple(r) for r in labels.label_pairs(df, e, depth).collect())
        assert got == sorted((u, v, int(u != v and v in within[u])) for u, v in pairs)
        assert max(went) == (depth + 1) // 2  # rows grow with the power of the depth that is gone
