import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytogrid.operators import (
    agents, community, describe, evaluate, features, filters, graph, images, morphology, mosaic, nearest, spatial, windows,
)
from cytogrid.plans import bindings, workflow
from cytogrid.session import cut_lineage

CELLS = "region_id string, cell_id long, x double, y double"


def make_cells(spark, xy, region="r"):
    return spark.createDataFrame([(region, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], CELLS)


def test_rectangle_includes_all_edges(spark):
    cells = make_cells(spark, [(0, 0), (10, 10), (0, 10), (10.001, 5), (5, -0.001)])
    inside = filters.cells_in_rectangle(cells, 0, 10, 0, 10)
    assert sorted(r.cell_id for r in inside.collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        filters.cells_in_rectangle(cells, 5, 5, 0, 1)
    rois = spark.createDataFrame([("r", 1, 0.0, 10.0, 0.0, 10.0), ("r", 2, 100.0, 120.0, 0.0, 9.0)],
                                 "region_id string, roi_id int, x0 double, x1 double, y0 double, y1 double")
    for tile in (3.0, 256.0):
        got = filters.cells_in_rois(cells, rois, tile).select("roi_id", "cell_id").collect()
        assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (1, 2)]


def test_window_edges_and_limits(spark):
    corner = make_cells(spark, [(64, 64)])
    got = windows.window_members(corner, origin=(-64, -64)).select("x0", "y0").collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in (-64, 0, 64) for b in (-64, 0, 64)]
    sizes = {}
    for n in (4, 5, 50, 51):
        cells = make_cells(spark, [(10 + i / 100, 10) for i in range(n)], f"r{n}")
        members = windows.window_members(cells, origin=(0, 0), keep=["x"]).where("x0 = 0 AND y0 = 0")
        sizes[n] = windows.cap_members(members).count()
        table = windows.describe_windows(members, n_max=50).collect()
        assert [r.n_cells for r in table] == ([min(n, 50)] if n >= 5 else [])
        means = windows.window_averages(members, ["x"], n_max=50).collect()
        assert [r.n_cells for r in means] == ([min(n, 50)] if n >= 5 else [])
        every = windows.window_averages(windows.window_members(cells, keep=["x"]), ["x"]).collect()
        assert {r.n_cells for r in every} == ({n} if n >= 5 else set())
    assert sizes == {4: 0, 5: 5, 50: 50, 51: 50}


def test_capped_draw_is_reproducible(spark):
    cells = make_cells(spark, [(1 + i / 100, 1) for i in range(80)])
    members = windows.window_members(cells, origin=(0, 0)).where("x0 = 0 AND y0 = 0")
    a = windows.cap_members(members.repartition(5), n_max=20).select("cell_id").collect()
    b = windows.cap_members(members.repartition(2), n_max=20).select("cell_id").collect()
    c = windows.cap_members(members, n_max=20, seed=9).select("cell_id").collect()
    assert sorted(a) == sorted(b) and sorted(a) != sorted(c) and len(set(a)) == 20


def test_windows_cover_cells_anywhere(spark):
    cells = make_cells(spark, [(-500 + 13 * i, -300.5) for i in range(20)])
    for members in (windows.window_members(cells), windows.window_members(cells, origin=(-64, -64))):
        assert {r.cell_id for r in members.collect()} == set(range(20))
        inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x0") + 128)
        assert members.join(cells, ["region_id", "cell_id"]).where(~inside).count() == 0


def test_normalisation_limits_are_per_region(spark):
    pixels = spark.createDataFrame([("a", 1, 0, 0, 5.0), ("b", 1, 0, 0, 5.0)], "region_id string, channel int, row int, col int, value double")
    limits = spark.createDataFrame([("a", 1, 0.0, 10.0, True), ("b", 1, 0.0, 20.0, True)], "region_id string, channel int, low double, high double, valid boolean")
    found = {r.region_id: r.value for r in images.normalize(pixels, limits, ["row", "col"]).collect()}
    assert found == {"a": 0.5, "b": 0.25}


def test_random_origins_in_bounds(spark):
    cells = make_cells(spark, [(100.7, 50.2), (300, 400)])
    for r in windows.window_origins(cells, 128, 0.5, 20, 5).collect():
        assert 36 <= r.x_start < 36.7 + 128 and -14 <= r.y_start < -13.8 + 128


def test_window_counts_are_symmetric(spark):
    xy = np.random.default_rng(1).uniform(0, 500, (300, 2))
    one = windows.describe_windows(windows.window_members(make_cells(spark, xy)))
    two = windows.describe_windows(windows.window_members(make_cells(spark, xy[:, ::-1])))
    a = {(r.x0, r.y0): r.n_cells for r in one.collect()}
    assert a == {(r.y0, r.x0): r.n_cells for r in two.collect()}


def test_references_are_limited_by_count(spark):
    cells = make_cells(spark, np.random.default_rng(2).uniform(0, 600, (500, 2)))
    members = windows.cap_members(windows.sliding_windows(cells))
    drawn = windows.reference_patches(members, 10)
    assert drawn.select("x0", "y0").distinct().count() == 10
    assert windows.reference_patches(members, 10**6).count() == members.count()


def test_channel_names_with_dots_and_slashes(spark):
    wide = spark.createDataFrame([("r", 1, 1.0, float("nan"))], "region_id string, cell_id long, `PGP9.5` double, `K8/18` double")
    long = features.to_long(wide, ["region_id", "cell_id"], ["PGP9.5", "K8/18"])
    assert {r.biomarker: r.value for r in long.collect()} == {"PGP9.5": 1.0, "K8/18": None}
    means = features.group_averages(wide, ["region_id"], ["PGP9.5", "K8/18"])
    assert {r.biomarker: r.value for r in means.collect()} == {"PGP9.5": 1.0, "K8/18": None}


def test_composition_counts_untyped_cells(spark):
    cells = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("r", 3, None), ("r", 4, "b")],
                                  "region_id string, cell_id long, cell_type string")
    got = {r.cell_type: r.share for r in features.composition(cells, ["region_id"]).collect()}
    assert got == {"a": 0.5, "b": 0.25}
    vector = features.type_vector(cells, cells, ["region_id"]).first()
    assert vector.types == ["a", "b"] and vector.shares == pytest.approx([2 / 3, 1 / 3])


def test_constant_biomarker_has_no_signature(spark):
    cells = spark.createDataFrame([("r", 1, "a", 1.0, 5.0), ("r", 2, "b", 2.0, 5.0)],
                                  "region_id string, cell_id long, cell_type string, m double, flat double")
    got = features.signature_biomarkers(cells, ["m", "flat"]).collect()
    assert [(r.cell_type, r.biomarker, r.level) for r in got] == [("b", "m", 1.0)]


def test_unknown_cell_type_stops(spark):
    cells = spark.createDataFrame([("r", 1, "x")], "region_id string, cell_id long, cell_type string")
    renames = spark.createDataFrame([("y", "z")], "old_type string, new_type string")
    with pytest.raises(Exception, match="no new name for cell type x"):
        filters.rename_cell_types(cells, renames).collect()


def test_significant_classes_order_and_strict_threshold(spark):
    labels = spark.createDataFrame([("r", v) for v in [1] * 50 + [2] * 48 + [3] * 2], "region_id string, c int")
    got = filters.significant_classes(labels, ["region_id"], "c").orderBy("position").collect()
    assert [r.c for r in got] == [1, 2]


def brute_nearest(at, k):
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(at)), d.shape), d), axis=1)[:, :k]
    return {(i, int(j), r + 1) for i in range(len(at)) for r, j in enumerate(order[i])}


@pytest.mark.parametrize("ball, askers", [(2048, 8192), (6, 8192), (6, 4)])
def test_nearest_neighbors(spark, monkeypatch, ball, askers):
    monkeypatch.setattr(nearest, "BALL", ball)
    monkeypatch.setattr(nearest, "ASKERS", askers)
    rng = np.random.default_rng(4)
    at = np.vstack([rng.uniform(0, 100, (60, 2)), [[50.0, 50.0]] * 12, [[900.0, 900.0]]])
    got = spatial.nearest_neighbors(make_cells(spark, at), ["x", "y"], 3)
    assert {(r.cell_id, r.neighbor, r.rank) for r in got.collect()} == brute_nearest(at, 3)


@pytest.mark.parametrize("dims, ball", [(4, 40), (30, 25)])
def test_nearest_neighbors_in_many_dimensions(spark, monkeypatch, dims, ball):
    monkeypatch.setattr(nearest, "BALL", ball)
    at = np.random.default_rng(dims).normal(size=(400, dims)).round(2)
    rows = [("r", i, *map(float, v)) for i, v in enumerate(at)]
    names = [f"m{i}" for i in range(dims)]
    points = spark.createDataFrame(rows, "region_id string, cell_id long, " + ", ".join(f"{c} double" for c in names))
    got = nearest.nearest_neighbors(points, names, 4)
    assert {(r.cell_id, r.neighbor, r.rank) for r in got.collect()} == brute_nearest(at, 4)


@pytest.mark.parametrize("shape", ["even", "pile", "line", "lattice"])
def test_nearest_neighbors_across_tiles(spark, monkeypatch, shape):
    """Groups of many tiles; the search in a task is by cells, so pairs do not grow with the square of a tile."""
    monkeypatch.setattr(nearest, "TILE", 20)
    monkeypatch.setattr(nearest, "ASKERS", 7)
    at = np.random.default_rng(1).random((400, 2)) * 100
    if shape == "pile":
        at[:150] = 50.0
    elif shape == "line":
        at[:, 0] = 3.0
    elif shape == "lattice":
        at = np.floor(at / 12)
    got = spatial.nearest_neighbors(make_cells(spark, at), ["x", "y"], 3)
    assert {(r.cell_id, r.neighbor, r.rank) for r in got.collect()} == brute_nearest(at, 3)
    ids = np.arange(len(at))
    for a, b in zip(nearest._top_in_plane(at.T, ids, at.T, ids, 3), nearest._top(at, ids, at, ids, 3), strict=True):
        assert (a == b).all()


def test_neighborhoods_move_lists_not_paths(spark):
    """Two hops are put together from lists: the plan has no row per path that is made distinct; ends are right."""
    pairs = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 2), (7, 7)]
    rows = [("r", a, b, "spatial") for x, y in pairs for a, b in {(x, y), (y, x)}] + [("r", 3, 9, "feature")]
    edges = spark.createDataFrame(rows, "region_id string, src long, dst long, kind string")
    seeds = spark.createDataFrame([("r", i) for i in (0, 0, 3, 5, 7)], "region_id string, cell_id long")
    got = spatial.local_neighborhoods(seeds, edges, 2, 1)
    found = sorted((r.seed, r.node) for r in got.collect())
    assert found == [(0, 0), (0, 1), (0, 2), (0, 4), (3, 1), (3, 2), (3, 3), (3, 4), (3, 9), (5, 5), (7, 7)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("collect_list") == 1


def test_panels_are_compared_over_their_own_markers(spark):
    """Two studies share one marker; each has one of its own, and no region has the third."""
    rng = np.random.default_rng(8)
    at = rng.normal(size=(60, 2))
    rows = [("1_a", i, float(u), float(v), None, None) for i, (u, v) in enumerate(at[:30])]
    rows += [("2_a", i, float(u), None, float(v), None) for i, (u, v) in enumerate(at[30:])]
    rows += [("2_a", 30, 0.0, None, None, None)]  # lacks a marker of its panel
    points = spark.createDataFrame(
        [(*r[:2], float(r[1]), 0.0, *r[2:]) for r in rows],
        "region_id string, cell_id long, x double, y double, `CD3/e` double, B double, C double, D double")
    edges = workflow.build_graph(points, ["CD3/e", "B", "C", "D"], feature_knn=2).where("kind = 'feature'")
    found = {(r.region_id, r.src, r.dst) for r in edges.collect()}
    for region, part in (("1_a", at[:30]), ("2_a", at[30:])):
        near = {(a, b) for a, b, _ in brute_nearest(part, 2)}
        assert {e[1:] for e in found if e[0] == region} == near | {(b, a) for a, b in near}


def test_nearest_neighbors_of_small_regions(spark):
    cells = make_cells(spark, [(0, 0)], "one").unionByName(make_cells(spark, [(0, 0), (3, 4)], "two")).unionByName(
        make_cells(spark, [(1, 1)] * 4, "same"))
    got = spatial.nearest_neighbors(cells, ["x", "y"], 3)
    counts = {r.region_id: r["count"] for r in got.groupBy("region_id").count().collect()}
    assert counts == {"two": 2, "same": 12}
    means = spatial.mean_neighbor_distance(cells, 3).collect()
    assert {(r.region_id, r.mean_k_neighbor_distance) for r in means} == {("one", None), ("two", None), ("same", 0.0)}


def test_radius_counts_with_copies(spark):
    cells = make_cells(spark, [(0, 0), (0, 0), (70, 0), (140.1, 0), (-70, 0)])
    got = {r.cell_id: r.local_density for r in spatial.radius_counts(cells).collect()}
    assert got == {0: 3, 1: 3, 2: 2, 3: 0, 4: 2}


def test_k_hops(spark):
    edges = spark.createDataFrame([("r", i, i + 1, "spatial") for i in range(5)] + [("r", 0, 9, "feature")],
                                  "region_id string, src long, dst long, kind string")
    edges = edges.unionByName(edges.selectExpr("region_id", "dst AS src", "src AS dst", "kind"))
    seed = spark.createDataFrame([("r", 2)], "region_id string, cell_id long")
    near = graph_nodes(spatial.local_neighborhoods(seed, edges, 1))
    assert near == {1, 2, 3}
    zero = spark.createDataFrame([("r", 0)], "region_id string, cell_id long")
    assert graph_nodes(spatial.local_neighborhoods(zero, edges, 2, 1)) == {0, 1, 2, 9}


def graph_nodes(df):
    return {r.node for r in df.collect()}


def two_way(spark, pairs):
    rows = [("r", a, b) for a, b in pairs] + [("r", b, a) for a, b in pairs]
    return spark.createDataFrame(rows, "region_id string, src long, dst long")


@pytest.mark.parametrize("size,growth,links", [(16_384, 64, 10**6), (20, 4, 10**6), (40, 2, 30)])
def test_components_of_chain_ring_and_single(spark, monkeypatch, size, growth, links):
    for name, value in (("TILE_NODES", size), ("GROWTH", growth), ("TILE_LINKS", links)):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(8)
    names = rng.permutation(300)
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(149)]
    pairs += [(int(names[i]), int(names[150 + (i - 149) % 100])) for i in range(150, 250)]
    nodes = spark.createDataFrame([("r", i) for i in range(300)], "region_id string, cell_id long")
    got = graph.connected_components(nodes, two_way(spark, pairs)).collect()
    assert len(got) == 300
    label = {r.cell_id: r.component for r in got}
    groups = [names[:150], names[150:250], *[[n] for n in names[250:]]]
    for members in groups:
        assert {label[int(m)] for m in members} == {int(min(members))}


@pytest.mark.parametrize("size", [30, 400])
def test_components_across_tiles(spark, monkeypatch, size):
    """Near pairs of scattered points in three regions, one of them a single place; edges may repeat."""
    monkeypatch.setattr(graph, "TILE_NODES", size)
    rng = np.random.default_rng(size)
    at = rng.uniform(0, 20, (700, 2))
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("b", i, 1.0, 1.0) for i in range(60)]
    nodes = spark.createDataFrame([*rows, ("c", 5, 0.0, None)], CELLS)
    near = ((at[:, None] - at[None]) ** 2).sum(2) < 0.8
    pairs = [(int(a), int(b)) for a, b in np.argwhere(near) if a < b]
    edges = two_way(spark, pairs + pairs[:50]).withColumn("region_id", F.lit("a")).unionByName(
        two_way(spark, [(i, i + 2) for i in range(58)] + [(7, 999)]).withColumn("region_id", F.lit("b")))
    label = list(range(700))
    while True:
        new = label[:]
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    want = {("a", i): c for i, c in enumerate(label)} | {("b", i): i % 2 for i in range(60)} | {("c", 5): 5}
    assert {(r.region_id, r.cell_id): r.component for r in graph.connected_components(nodes, edges).collect()} == want


@pytest.mark.parametrize("size,large", [(100, False), (101, True), (700, True)])
def test_split_components(spark, size, large):
    side = 30
    nodes = [("r", i, 0) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in (i + 1, i + side) if j < size]
    components = spark.createDataFrame(nodes, "region_id string, cell_id long, component long")
    edges = two_way(spark, pairs)
    parts = graph.split_components(components, edges, 100).toPandas()
    assert parts["cell_id"].is_unique
    if not large:
        assert len(parts) == size and set(parts["part"]) == {0}
        return
    assert 1 <= parts["part"].nunique() <= math.ceil(size / 300)
    linked = {}
    for a, b in pairs:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    for _, members in parts.groupby("part")["cell_id"]:
        members = set(members)
        assert len(members) <= 100
        seen, todo = set(), [next(iter(members))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for m in linked[n] if m in members]
        assert seen == members


def test_refused_nodes_go_to_the_next_part(spark):
    """Left to itself no node stays outside while a part beside it has room."""
    side = 20
    pairs = [(i, i + 1) for i in range(399) if (i + 1) % side] + [(i, i + side) for i in range(400 - side)]
    components = spark.createDataFrame([("r", i, 0) for i in range(400)], "region_id string, cell_id long, component long")
    parts = graph.split_components(components, two_way(spark, pairs), max_size=30, hops=25).toPandas()
    part = dict(zip(parts["cell_id"], parts["part"], strict=True))
    sizes = parts.groupby("part").size()
    assert len(sizes) == 5 and sizes.max() <= 30
    for a, b in [*pairs, *[(b, a) for a, b in pairs]]:
        assert a not in part or b in part or sizes[part[a]] == 30


def test_whole_components_are_split_by_tasks_and_rounds_alike(spark, monkeypatch):
    """Every node is in one connected part, whichever way it grows; samples are the first of these parts."""
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 12, (300, 2))
    near = ((at[:, None] - at[None]) ** 2).sum(2) < 1.3
    pairs = [(int(a), int(b)) for a, b in np.argwhere(near) if a < b]
    nodes = spark.createDataFrame([("r", i) for i in range(300)], "region_id string, cell_id long")
    edges = two_way(spark, pairs)
    components = cut_lineage(graph.connected_components(nodes, edges))
    want = {tuple(r) for r in graph.split_components(components, edges, 30, whole=True).collect()}
    monkeypatch.setattr(graph, "TILE_NODES", 100)
    got = graph.split_components(components, edges, 30, whole=True).toPandas()
    assert set(got.itertuples(index=False, name=None)) == want and sorted(got["cell_id"]) == list(range(300))
    linked = [set() for _ in range(300)]
    for a, b in pairs:
        linked[a].add(b)
        linked[b].add(a)
    for _, members in got.groupby(["component", "part"])["cell_id"]:
        members, todo = set(members), [min(members)]
        assert len(members) <= 30
        seen = set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += linked[n] & members
        assert seen == members
    samples = {tuple(r) for r in graph.split_components(components, edges, 30).collect()}
    assert samples < want


def test_cluster_samples_need_twenty_cells(spark):
    pairs = [(i, i + 1) for i in range(18)] + [(i, i + 1) for i in range(100, 119)]
    nodes = [*range(19), *range(100, 120)]
    clusters = spark.createDataFrame([("r", n, 1) for n in nodes], "region_id string, cell_id long, cluster int")
    got = graph.cluster_samples(clusters, two_way(spark, pairs)).collect()
    assert sorted(r.cell_id for r in got) == list(range(100, 120))


def gaining_nodes(labels, pairs, resolution):
    """Nodes that gain by a move to another community or to none, each move tried."""
    found = []
    for node, own in labels.items():
        total = lambda c: sum(1 for n, l in labels.items() if l == c and n != node)  # noqa: B023, E731, E741
        toward = lambda c: sum(1 for a, b in pairs if node in (a, b) and labels[a if b == node else b] == c)  # noqa: B023, E731
        worth = {c: toward(c) - resolution * total(c) for c in {*labels.values()}} | {None: 0.0}
        if max(worth.values()) > worth[own] + 1e-9:
            found.append(node)
    return found


def test_communities_follow_the_graph(spark):
    blocks = [[(a, b) for a in range(s, s + 12) for b in range(a + 1, s + 12)] for s in range(0, 96, 12)]
    pairs = [p for block in blocks for p in block] + [(s, s + 12) for s in range(0, 84, 12)]
    edges = two_way(spark, pairs).withColumn("kind", F.lit("spatial"))
    nodes = spark.createDataFrame([("r", i) for i in range(96)], "region_id string, cell_id long")
    labels = community.detect(nodes, edges.unionByName(edges), [0.05, 0.9]).collect()
    assert len(labels) == 192 and {(r.cluster, r.resolution) for r in labels} >= {(s, 0.9) for s in range(0, 96, 12)}
    assert all(r.cluster == r.cell_id // 12 * 12 for r in labels)  # blocks are the best at both
    chosen = community.resolution_sweep(nodes, edges, [0.05, 0.9])
    assert chosen.count() == 96 and {r.resolution for r in chosen.collect()} == {0.05}
    assert community.detect(nodes.limit(0), edges, [0.05]).count() == 0


def test_tile_communities_leave_no_gaining_node():
    rng = np.random.default_rng(5)
    for resolution in (0.02, 0.1, 0.4):
        n = 60
        pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (170, 2)).tolist() if a != b})
        a, b = np.array(pairs).T
        tile = community.TileGraph(np.ones(n), np.r_[a, b], np.r_[b, a], np.ones(2 * len(pairs)))
        assert not gaining_nodes(dict(enumerate(tile.communities(resolution).tolist())), pairs, resolution)


def test_communities_over_several_tiles_are_settled(spark, monkeypatch):
    monkeypatch.setattr(community, "TILE_NODES", 40)
    monkeypatch.setattr(community, "GRID_NODES", 4)
    rng = np.random.default_rng(7)
    xy = rng.random((150, 2))
    xy[:45] = 0.5  # one place that exceeds a tile
    near = np.argsort(((xy[:, None] - xy) ** 2).sum(-1), axis=1, kind="stable")[:, :6]
    pairs = sorted({(min(a, b), max(a, b)) for a in range(150) for b in near[a].tolist() if a != b})
    nodes = spark.createDataFrame(
        [("r", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("s", 7, 0.0, 0.0)],
        "region_id string, cell_id long, x double, y double",
    )
    assert {r.n > 1 for r in community._tiles(nodes).where("region_id = 'r'").groupBy("region_id").agg(
        F.countDistinct("tile").alias("n")).collect()} == {True}
    got = community.detect(nodes, two_way(spark, pairs), [0.15]).collect()
    labels = {r.cell_id: r.cluster for r in got if r.region_id == "r"}
    assert len(got) == 151 and len(labels) == 150 and not gaining_nodes(labels, pairs, 0.15)
    assert all(min(n for n, l in labels.items() if l == c) == c for c in set(labels.values()))  # noqa: E741
    assert [r.cluster for r in got if r.region_id == "s"] == [7]


def test_histogram_edges(spark):
    values = [247, 248, 249, 255, 300, -3]
    df = spark.createDataFrame([("i", v) for v in values], "image string, value int")
    got = images.histogram(df, ["image"]).first().histogram
    want, _ = np.histogram(np.clip(values, 0, 255), bins=np.arange(0, 256, 8))
    assert got == pytest.approx(list(want / len(values))) and len(got) == 31
    with pytest.raises(TypeError):
        images.histogram(df.withColumn("value", F.lit("x")), ["image"])


def mask_rows(spark, picture, label=1):
    rows = [("r", label, i, j) for i, line in enumerate(picture) for j, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "region_id string, label long, row int, col int")


def test_shapes_of_a_square(spark):
    r = morphology.shape_features(mask_rows(spark, ["####"] * 4)).first()
    assert (r.area, r.area_convex, r.area_filled, r.perimeter) == (16, 16, 16, 12.0)
    assert r.eccentricity == 0 and r.axis_ratio == 1 and r.orientation == pytest.approx(-math.pi / 4)
    assert r.circularity == pytest.approx(4 * math.pi * 16 / 144)


def test_holes_and_hull(spark):
    ring = morphology.shape_features(mask_rows(spark, ["#####", "#...#", "#.#.#", "#...#", "#####"])).first()
    assert ring.area_filled == 25 and ring.area_convex == 25
    leaky = morphology.shape_features(mask_rows(spark, ["####.", "#..#.", "#..#.", "##.##"])).first()
    assert leaky.area_filled == leaky.area
    corner = morphology.shape_features(mask_rows(spark, [".##.", "#..#", "#..#", ".##."])).first()
    assert corner.area_filled == corner.area  # background connects over corners
    line = morphology.shape_features(mask_rows(spark, ["#####"])).first()
    assert line.minor_axis == 0 and line.eccentricity == 1 and line.area_convex == 5
    dot = morphology.shape_features(mask_rows(spark, ["#"])).first()
    assert (dot.area, dot.perimeter, dot.circularity, dot.axis_ratio) == (1, 0, 0, 1)


@pytest.mark.parametrize("rows_per_block", [7, 1024])
def test_pair_quantile_in_blocks(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(mosaic, "BLOCK_ROWS", rows_per_block)
    rng = np.random.default_rng(6)
    data = {"a": rng.normal(size=(40, 3)), "b": rng.normal(size=(2, 3)), "c": np.zeros((3, 3)), "d": np.zeros((1, 3))}
    rows = [(g, i, v.tolist()) for g, m in data.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "region_id string, k long, v array<double>")
    got = {r.region_id: r.scale for r in mosaic.pair_quantile(df, "region_id", ["k"], "v").collect()}
    for g, m in data.items():
        d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        assert got[g] == pytest.approx(np.quantile(np.triu(d), 0.95)), g
    pairs = {r.region_id: r for r in mosaic.pair_summary(df, "region_id", ["k"], "v").collect()}
    assert pairs["a"].n_pairs == 780 and pairs["d"].n_pairs == 0 and pairs["d"].max_distance is None


def test_kmeans_separates_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(g, 50 * c + i, (rng.normal(size=2) + 100 * c).tolist()) for g in "ab" for c in range(2) for i in range(50)]
    df = spark.createDataFrame(rows, "region_id string, k long, v array<double>")
    got = mosaic.grouped_kmeans(df, ["region_id"], ["k"], "v", 2, iterations=20).toPandas()
    for _, part in got.groupby("region_id"):
        assert part[part.k < 50].cluster.nunique() == 1 and part[part.k >= 50].cluster.nunique() == 1
        assert part.cluster.nunique() == 2
    none = mosaic.grouped_kmeans(df.where("false"), ["region_id"], ["k"], "v", 2)
    assert none.count() == 0 and "cluster" in none.columns


def test_kmeans_ends_with_every_point_at_its_nearest_centre(spark):
    rng = np.random.default_rng(12)
    rows = [(g, i, rng.uniform(0, 1, 2).tolist()) for g in "abc" for i in range({"a": 300, "b": 90, "c": 3}[g])]
    df = spark.createDataFrame(rows, "region_id string, k long, v array<double>")
    for _, part in mosaic.grouped_kmeans(df, ["region_id"], ["k"], "v", 5).toPandas().groupby("region_id"):
        at, own = np.array(part["v"].tolist()), part["cluster"].to_numpy()
        middle = {c: at[own == c].mean(axis=0) for c in set(own)}
        far = {c: np.square(at - m).sum(axis=1) for c, m in middle.items()}
        assert len(middle) == min(5, len(at))
        assert all(far[c][i] <= min(f[i] for f in far.values()) + 1e-7 for i, c in enumerate(own))
    with pytest.raises(RuntimeError, match="did not settle"):
        mosaic.grouped_kmeans(df, ["region_id"], ["k"], "v", 5, iterations=2)


def test_kmeans_settles_groups_inside_tasks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(g, i, rng.uniform(0, 1, 2).tolist()) for g in "abc" for i in range({"a": 300, "b": 90, "c": 3}[g])]
    rows += [("d", 0, [0.5, None]), ("d", 1, [0.1, 0.2]), (None, 0, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "region_id string, k long, v array<double>")
    written, cut = [], mosaic.cut_lineage
    monkeypatch.setattr(mosaic, "cut_lineage", lambda df: written.append(df) or cut(df))
    found, tables = [], []
    for size in (0, 100, mosaic.GROUP_ROWS):  # none, some and all whole groups in tasks
        monkeypatch.setattr(mosaic, "GROUP_ROWS", size)
        written.clear()
        got = mosaic.grouped_kmeans(df.where("region_id IS NULL OR region_id != 'd'" if size > 100 else "true"), ["region_id"], ["k"], "v", 5)
        found.append({(x.region_id, x.k): x.cluster for x in got.collect() if x.region_id != "d"})
        tables.append(len(written))
    assert found[0] == found[1] == found[2] and len(found[0]) == 393
    assert tables[2] == 2 < tables[0]  # no table per turn


@pytest.mark.parametrize("method", ["center", "sample"])
def test_representatives(spark, method):
    rows = [("r", 3, i, [float(i)]) for i in range(3)] + [("r", 9, i, [float(i * i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "region_id string, cluster int, k long, features array<double>")
    got = mosaic.pick_representatives(df, ["region_id", "cluster"], ["k"], 2, method).orderBy("position").collect()
    assert {r.cluster for r in got} == {9} and len(got) == 2  # clusters below four are skipped
    assert got[0].distance <= got[1].distance
    if method == "center":
        assert [r.k for r in got] == [4, 3]


def test_accuracy_and_confusion(spark):
    rows = [(1, "Glomeruli", ["Glomeruli"]), (2, "Interstitium", ["Glomeruli", "Interstitium"]),
            (3, "Other", ["Glomeruli"]), (4, "Blood vessel", [])]
    df = spark.createDataFrame(rows, "reply_id int, truth string, predicted array<string>")
    got = {r.k: (r.n, r.correct) for r in evaluate.accuracy_at_k(df).collect()}
    assert got == {1: (4, 1), 2: (4, 2), 3: (4, 2)}
    matrix = {r.truth: r for r in evaluate.confusion_matrix(df).collect()}
    assert len(matrix) == 5 and {t for t, r in matrix.items() if r.n} == {"Glomeruli", "Interstitium"}
    assert matrix["Blood vessel"].n_glomeruli == 0 and matrix["Blood vessel"].share_glomeruli is None
    assert matrix["Interstitium"].n_glomeruli == 1 and matrix["Interstitium"].share_glomeruli == 1.0


def test_key_types_use_percent_scale(spark):
    rows = [("r", 1, "a", 60.0, 1.0, ["m"]), ("r", 1, "b", 30.0, 0.9, []), ("r", 1, "c", 9.9, 1.1, []),
            ("r", 1, "d", 0.06, 2.0, []), ("r", 1, "e", 0.04, 9.0, [])]
    df = spark.createDataFrame(rows, "region_id string, roi_id int, cell_type string, percent double, "
                                     "enrichment double, signature array<string>")
    got = describe.key_cell_types(df, ["region_id", "roi_id"]).orderBy("position").collect()
    assert [r.cell_type for r in got] == ["a", "b", "c", "d"]
    text = describe.cell_type_text(describe.key_cell_types(df, ["region_id", "roi_id"]), ["region_id"]).first().ct_text
    assert text.splitlines()[1].startswith("1. **a**: 60% of the cells, 1.0 times") and "Marked by m." in text


def test_aggregated_texts_keep_everything(spark):
    df = spark.range(25).selectExpr("'g' AS g", "id", "concat('t', id) AS t")
    got = agents.aggregate_texts(df, ["g"], "t", "id", per_prompt=10).collect()
    assert len(got) == 3 and sum(r.n_obs for r in got) == 25
    assert sorted(t for r in got for t in r.results.split("\n===\n")) == sorted(f"t{i}" for i in range(25))


def test_ask_once_per_dialogue(spark):
    df = spark.range(4).selectExpr("id", "array(named_struct('role', 'human', 'content', concat('q', id % 2))) AS dialogue")
    class Echo:
        def reply(self, dialogue):
            return dialogue[-1]["content"] + "!"

    got = agents.ask(df, Echo()).collect()
    with pytest.raises(ValueError):
        agents.ask(df, None)
    assert len(got) == 4 and len({r.reply for r in got}) <= 2
    assert all(r.dialogue[-1].role == "ai" and r.dialogue[-1].content == r.reply for r in got)
    done = df.where("id < 3")
    assert [r.id for r in agents.not_done(df, done, ["id"]).collect()] == [3]


def test_a_tile_of_one_community_is_proven():
    def graph(pairs, n):
        a, b = np.array(pairs).T
        return community.TileGraph(np.ones(n), np.r_[a, b], np.r_[b, a], np.ones(2 * len(pairs)))

    clique = [(a, b) for a in range(12) for b in range(a)]
    assert graph(clique, 12).best_whole(0.9) and not graph(clique, 12).best_whole(1.1)
    twice = [*clique, *[(a + 12, b + 12) for a, b in clique], (0, 12)]  # cut by one link, 144 pairs
    assert graph(twice, 24).best_whole(0.5 / 144) and not graph(twice, 24).best_whole(1.1 / 144)
    assert not graph(twice[:-1], 24).best_whole(1e-5)  # not connected


def test_tables_are_not_broadcast_by_their_packed_size(spark, tmp_path, capsys):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    own.range(9).write.parquet(str(tmp_path / "nation.parquet"))
    bindings.table(own, str(tmp_path), "nation")
    cells = own.range(500_000).select(F.lit(0).alias("region_id"), F.col("id").alias("cell_id"))
    packed = cut_lineage(cells.withColumn("label", F.lit(7)))
    cells.join(packed, ["region_id", "cell_id"]).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    packed.join(cut_lineage(own.range(9).withColumnRenamed("id", "label")), "label").explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10MB"
    bindings.table(own, str(tmp_path), "nation")  # a second time changes nothing
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10MB"
