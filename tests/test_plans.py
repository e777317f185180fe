"""Tables that grow with the graph are never sent through the driver."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from waygraph.operators import routing as R
from waygraph.operators import spatial
from waygraph.plans import catalog, storage
from waygraph.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
#: Queries that failed by the driver's memory on tables 60 times as large as sf0.1.
LARGE = (
    "a07_incident_votes",
    "a17_graph_summary",
    "a19_score_summary",
    "f03_greedy_nms",
    "f04_training_nms",
    "f12_merge_threshold",
    "g05_junction_collapse",
    "g06_global_merge",
    "g06_global_nodes",
    "g07_bounded_search",
    "g08_hops",
    "g10_chains",
    "g18_noded_pieces",
    "g19_control_points",
    "g25_apls",
    "g31_pair_labels",
    "g32_snapped_labels",
    "j08_match_points",
    "j10_seam_bridges",
    "k03_edge_features",
    "k05_network_outputs",
    "t04_top_components",
    "j07_buffer_join",
    "a05_cluster_centroids",
)


@pytest.mark.parametrize("name", LARGE)
def test_no_graph_sized_table_is_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(storage, "FEW", 0, raising=False)
    jvm = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    last = lambda: max([-1, *(e.executionId() for e in (lambda s: [s.apply(i) for i in range(s.size())])(jvm.executionsList()))])
    bus.waitUntilEmpty(30_000)
    before = last()
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty(30_000)
    found = jvm.executionsList()
    plans = [e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size())) if e.executionId() > before]
    assert plans
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_cuts_are_found_where_segments_meet(spark):
    rows = [(1, 0, 0, 900, 900), (2, 0, 900, 900, 0), (3, 450, 0, 460, 900), (4, 900, 900, 2000, 900), (5, 0, 0, 900, 900)]
    segments = spark.createDataFrame(rows, "id long, x1 long, y1 long, x2 long, y2 long")
    plan = spatial.crossings(segments, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # a pair that meets in many cells counts in one
    assert sorted(map(tuple, spatial.crossings(segments, 100).collect())) == [(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)]
    pieces = spatial.noded(segments, 100)
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    assert {r["id"]: r["count"] for r in pieces.groupBy("id").count().collect()} == {1: 3, 2: 3, 3: 3, 4: 1, 5: 3}


def test_a_join_near_segments_tests_boxes_only(spark):
    points = spark.createDataFrame([(1, 50, 40), (2, 50, 41), (3, -28, -28), (4, -29, -29), (5, 140, 0), (6, 300, 300)], "pid long, px long, py long")
    segments = spark.createDataFrame([(1, 0, 0, 100, 0), (2, 300, 300, 300, 300)], "sid long, x1 long, y1 long, x2 long, y2 long")
    near = spatial.near_segments(points, segments, 40)
    join = next(x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "/" not in join  # the exact test is not part of the join's condition
    assert sorted(map(tuple, near.collect())) == [(1, 1), (3, 1), (5, 1), (6, 2)]


def test_every_control_point_is_matched(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    nodes = duck.execute(fx.with_relations("SELECT nid, x // 1700 * 10 + y // 1700 AS g, x, y FROM fx_node")).fetchall()
    at = {n: (x, y) for n, _, x, y in nodes}
    cell = {n: g for n, g, _, _ in nodes}
    near = defaultdict(set)
    for u, v in duck.execute(fx.with_relations("SELECT u, v FROM fx_edge")).fetchall():
        if cell[u] == cell[v]:
            near[u].add(v)
            near[v].add(u)
    got = [tuple(r) for r in catalog.QUERIES["j08_match_points"](spark, sf).select("graph_id", "point", "matched").collect()]
    to = {p: t for _, p, t in got}
    graphs = [set(g) for g in R.parts(R.adjacency((u, v, 1.0) for u in near for v in near[u]))]
    assert len(got) == len(to) and all(g == cell[p] for g, p, _ in got)  # each once, in its own graph
    assert max(Counter(g for g, _, _ in got).values()) > 10
    assert {n for n in near if len(near[n]) != 2} <= to.keys() <= near.keys()  # ends and junctions, all of them
    assert all(own & to.keys() for own in graphs)  # and no component without one
    used = [t for t in to.values() if t is not None]
    assert len(used) == len(set(used))
    off = lambda p, t: math.dist(at[p], (at[t][0] + 3, at[t][1]))
    for p, t in to.items():
        if t is None:  # all nodes in reach are others'
            assert {n for n in cell if cell[n] == cell[p] and off(p, n) <= 10} <= set(used)
        else:
            assert cell[t] == cell[p] and off(p, t) <= 10
