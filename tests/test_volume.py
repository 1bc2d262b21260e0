"""Small volumes with answers that are written out, and random ones against a flood fill."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina import queries
from lamina.functions import colors
from lamina.operators import brush, components, geometry, nearest, numbering, paths, skeleton, surface, tracking
from lamina.session import Workspace
from lamina.sources import tables, volume
from lamina.streaming import replay

DATA = "/root/testdata/sf0.001"
VOXEL = "label_id int, z int, y int, x int"


def flood(voxels: set, steps: list) -> dict:
    """Component number from 1 of every voxel, in order of the first one."""
    out, n = {}, 0
    for v in sorted(voxels):
        if v in out:
            continue
        n += 1
        todo = [v]
        out[v] = n
        while todo:
            at = todo.pop()
            for s in steps:
                w = tuple(a + b for a, b in zip(at, s))
                if w in voxels and w not in out:
                    out[w] = n
                    todo.append(w)
    return out


def test_diagonal_touch_is_two_contours(spark):
    mask = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1)], VOXEL)
    assert sorted(r.cc_id for r in components.contour_runs(mask, Workspace(spark, "t")).collect()) == [1, 2]


@pytest.mark.parametrize("share", [0.3, 0.55, 0.7])
def test_contours_are_the_same_at_any_band_height(spark, share):
    """Labels and slices apart, spirals through many bands, and bands without a voxel."""
    rng = random.Random(int(share * 100))
    voxels = {(label, z, y, x) for label in (1, 2) for z in (0, 3) for y in range(23) for x in range(17) if rng.random() < share and not (z == 3 and 8 <= y < 12)}
    spiral = "#########;........#;#######.#;#.....#.#;#.###.#.#;#.#...#.#;#.#####.#;#.......#;#########"
    voxels |= {(3, 1, y, x) for y, line in enumerate(spiral.split(";")) for x, c in enumerate(line) if c == "#"}
    mask, wanted = spark.createDataFrame(sorted(voxels), VOXEL), {}
    for label, z in {v[:2] for v in voxels}:
        flat = flood({(y, x) for a, b, y, x in voxels if (a, b) == (label, z)}, [(0, 1), (0, -1), (1, 0), (-1, 0)])
        wanted |= {(label, z, *v): c for v, c in flat.items()}
    for lines, height in ((None, 1), (None, 2), (None, 5), (None, 1000), (23, 23), (23, 7)):
        runs = components.contour_runs(mask, Workspace(spark, "t"), lines, height)
        assert {(r.label_id, r.z, r.y, r.x): r.cc_id for r in components.contour_voxels(runs).collect()} == wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_flood_fill(spark, seed):
    rng = random.Random(seed)
    voxels = {(z, y, x) for z in range(5) for y in range(7) for x in range(7) if rng.random() < 0.45}
    mask = spark.createDataFrame([(1, *v) for v in sorted(voxels)], VOXEL)
    runs = components.contour_runs(mask, Workspace(spark, "t"))
    found = {(r.z, r.y, r.x): r.cc_id for r in components.contour_voxels(runs).collect()}
    for z in range(5):
        flat = flood({v for v in voxels if v[0] == z}, [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0)])
        assert {v: c for v, c in found.items() if v[0] == z} == flat
    bodies = {(r.z, r.cc_id): r.comp_id for r in components.bodies(runs, Workspace(spark, "t")).collect()}
    solid = flood(voxels, [(1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0)])
    assert {v: bodies[v[0], c] for v, c in found.items()} == solid


def test_components_that_do_not_end_are_an_error(spark, monkeypatch):
    from lamina.functions import graph

    edges = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in graph.connected_components(edges, Workspace(spark, "t")).collect()} == {0}
    assert graph.connected_components(edges.limit(0), Workspace(spark, "t")).collect() == []
    monkeypatch.setattr(graph, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="aren't done"):
        graph.connected_components(edges, Workspace(spark, "t"))


def test_skeleton_parts_against_flood_fill(spark):
    rng = random.Random(3)
    voxels = {(rng.randrange(8), rng.randrange(8), rng.randrange(8)) for _ in range(70)}
    work = Workspace(spark, "t")
    points = components.skeleton_points(spark.createDataFrame(sorted(voxels), "z int, y int, x int"), spark.createDataFrame([(2, *v) for v in sorted(voxels)[:30]] + [(1, *v) for v in sorted(voxels)[20:30]], VOXEL), work)
    rows = {r.point_id: r for r in points.collect()}
    assert [(rows[i].z, rows[i].y, rows[i].x) for i in range(len(voxels))] == sorted(voxels)
    assert rows[25].label_id == 1 and rows[5].label_id == 2 and rows[40].label_id == 0  # the first label wins
    parts = {r.point_id: r.root for r in components.spatial_components(points, components.adjacency(points), work).collect()}
    wanted = flood(voxels, components.NEIGHBOURS)
    groups = {}
    for i, r in rows.items():
        groups.setdefault(wanted[r.z, r.y, r.x], []).append(i)
    assert parts == {i: min(g) for g in groups.values() for i in g}
    marked = {r.point_id: r.instance_id for r in components.instances(points, components.adjacency(points), work).collect()}
    assert {i for i, m in marked.items() if m == -1} == {i for i, r in rows.items() if r.label_id == 0}


def test_overlap_ties_and_mirror(spark):
    # the contour below touches two above with equal area: the same label comes first
    mask = spark.createDataFrame([(2, 0, 0, 0), (2, 0, 0, 1), (2, 0, 0, 2), (1, 1, 0, 0), (2, 1, 0, 2)], VOXEL)
    overlap = components.overlaps(components.contour_runs(mask, Workspace(spark, "t")))
    rows = [tuple(r) for r in overlap.select("dir", "label_id", "z", "o_label_id", "area").collect()]
    assert sorted(rows) == [(-1, 1, 1, 2, 1), (-1, 2, 1, 2, 1), (1, 2, 0, 1, 1), (1, 2, 0, 2, 1)]
    assert [(r.o_label_id, r.area) for r in paths.best_overlap(overlap).where("dir = 1").collect()] == [(2, 1)]


def test_level0_contours_where_masks_overlap(spark):
    mask = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (1, 0, 0, 5)], VOXEL)
    combined = mask.groupBy("z", "y", "x").agg({"label_id": "max"}).withColumnRenamed("max(label_id)", "label_id")
    points = components.skeleton_points(spark.createDataFrame([(0, 0, 0), (0, 0, 5), (0, 3, 3)], "z int, y int, x int"), mask, Workspace(spark, "t"))
    rows = {r.point_id: (r.label_id, r.z_l0, r.cc_id0) for r in skeleton.level0_contours(points, combined, 4, Workspace(spark, "t")).collect()}
    assert rows == {0: (1, 2, -1), 1: (1, 0, 0), 2: (0, 0, -1)}


def test_nearest_widens_its_cells(spark):
    queries_df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 500.0, 0.0, 0.0)], "query_id int, wz double, wy double, wx double")
    points = spark.createDataFrame([(0, 1, 0, 0), (1, 0, 1, 0), (2, 9, 9, 9)], "point_id long, z int, y int, x int")
    rows = {r.query_id: (r.point_id, r.d2) for r in nearest.nearest(queries_df, points, (1.0, 1.0, 1.0), Workspace(spark, "t")).collect()}
    assert rows == {1: (0, 1.0), 2: (2, 491.0**2 + 162)}
    assert nearest.nearest(queries_df, points.limit(0), (1.0, 1.0, 1.0), Workspace(spark, "t")).count() == 0


def test_nearest_ends_whatever_the_queries(spark):
    rng = random.Random(5)
    points = [(i, rng.randrange(40), rng.randrange(300), rng.randrange(300)) for i in range(200)]
    asked = [(i, *(rng.uniform(-50, 400) for _ in range(3))) for i in range(60)] + [(100, None, 0.0, 0.0), (101, float("nan"), 0.0, 0.0), (102, 0.0, float("inf"), 0.0), (103, 1e9, -1e9, 5.0), (104, 1e200, 0.0, 0.0)]
    found = {r.query_id: (r.point_id, r.d2) for r in nearest.nearest(spark.createDataFrame(asked, "query_id int, wz double, wy double, wx double"), spark.createDataFrame(points, "point_id long, z int, y int, x int"), (2.0, 1.0, 0.5), Workspace(spark, "t"), cell=4.0).collect()}
    assert len(found) == len(asked) and all(found[i] == (None, None) for i in (100, 101, 102))
    for i, z, y, x in asked[:60] + [asked[63]]:
        d2, best = min(((p[1] * 2.0 - z) ** 2 + (p[2] * 1.0 - y) ** 2 + (p[3] * 0.5 - x) ** 2, p[0]) for p in points)
        assert found[i][1] == pytest.approx(d2, rel=1e-12) and (found[i][0] == best or i == 103)
    assert found[104][0] is not None


def test_rays_against_all_points(spark):
    """Rays through, past and away from the points; ties, hidden directions, broken numbers and no points."""
    from lamina.operators import rays

    rng = random.Random(7)
    points = [(i, rng.randrange(30), rng.randrange(200), rng.randrange(400)) for i in range(500)] + [(500, 0, 0, 0), (501, 0, 0, 0), (502, 25, 190, 390)]
    asked = [(i, *(rng.uniform(-100, 300) for _ in range(6))) for i in range(80)]
    asked += [(100, -5.0, -5.0, -5.0, 0.0, 0.0, 0.0), (101, 1e6, 0.0, 0.0, 1e6, 5.0, 0.0), (102, -9.0, 5.0, 5.0, -10.0, 5.0, 5.0), (103, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (104, None, 0.0, 0.0, 1.0, 1.0, 1.0), (105, 0.0, 0.0, float("nan"), 1.0, 1.0, 1.0), (106, 0.0, float("inf"), 0.0, 1.0, 1.0, 1.0)]
    size = (2.0, 1.0, 0.5)
    rows = spark.createDataFrame(asked, "ray_id int, oz double, oy double, ox double, tz double, ty double, tx double")
    placed = spark.createDataFrame(points, "point_id long, z int, y int, x int")
    for leaf in (3.0, 8.0, 1000.0):
        found = {r.ray_id: (r.point_id, r.dist) for r in rays.nearest_to_rays(rows, placed, size, Workspace(spark, "t"), leaf).collect()}
        assert len(found) == len(asked) and all(found[i] == (None, None) for i in (103, 104, 105, 106))
        assert found[100] == (500, pytest.approx(0.0, abs=1e-8)) and found[102] == (0, None)
        for i, *o in asked[:82]:
            origin, target = o[:3], o[3:]
            length = sum((b - a) ** 2 for a, b in zip(origin, target)) ** 0.5
            unit, best = [(b - a) / length for a, b in zip(origin, target)], []
            for p, *v in points:
                off = [c * s - a for c, s, a in zip(v, size, origin)]
                along = sum(a * b for a, b in zip(off, unit))
                if along >= 0:
                    best.append((max(0.0, sum(c * c for c in off) - along * along) ** 0.5, p))
            if best:
                assert found[i][1] == pytest.approx(min(best)[0], abs=1e-4) and (i == 101 or found[i][0] in {p for d, p in best if d < min(best)[0] + 1e-6}), i
    assert {r.point_id for r in rays.nearest_to_rays(rows, placed.limit(0), size, Workspace(spark, "t")).collect()} == {None}


def test_node_ids_that_do_not_fit_are_an_error(spark):
    high = spark.createDataFrame([(1, 1 << 23, 0, 0), (1, (1 << 23) + 1, 0, 0)], VOXEL)
    with pytest.raises(Exception, match="too large for a node id"):
        components.bodies(components.contour_runs(high, Workspace(spark, "t")), Workspace(spark, "t")).collect()


def test_overlaps_of_long_runs(spark):
    """Runs over several stretches count once."""
    rows = [(1, z, 0, x) for z, xs in ((0, range(0, 300)), (1, [*range(10, 130), *range(190, 260)])) for x in xs]
    overlap = components.overlaps(components.contour_runs(spark.createDataFrame(rows, VOXEL), Workspace(spark, "t")))
    assert sorted((r.dir, r.area) for r in overlap.collect()) == [(-1, 70), (-1, 120), (1, 70), (1, 120)]


def test_sidecars_that_are_out_of_order_are_an_error(spark, tmp_path):
    line = lambda contours: '{"label_id":1,"z":0,"contours":"' + contours.replace('"', '\\"') + '"}\n'
    marker = '"skeleton_marker":{"position":[1.0,2.0,3.0],"has_skeleton":false}'
    for text, error in (('[{"cc_id":2,"area":5,' + marker + "}]", "place in its list"), ('[{"cc_id":1,"area":5}]', "no skeleton marker"), ('[{"area":5,' + marker + "}]", "place in its list")):
        (tmp_path / "c.json").write_text(line(text))
        with pytest.raises(Exception, match=error):
            tables.read_contours(spark, str(tmp_path)).collect()
    (tmp_path / "c.json").write_text(line('[{"cc_id":1,"area":5,' + marker + "}]"))
    assert [(r.cc_id, r.area, r.skeleton_marker.position) for r in tables.read_contours(spark, str(tmp_path)).collect()] == [(1, 5, [1.0, 2.0, 3.0])]


def test_a_closed_workspace_is_gone(spark):
    work = Workspace(spark, "t")
    work.keep(spark.range(3), "a")
    assert os.path.isdir(work.root.removeprefix("file:"))
    work.close()
    assert not os.path.exists(work.root.removeprefix("file:"))


def test_surfaces_are_closed(spark):
    rng = random.Random(6)
    voxels = [(k, rng.randrange(5), rng.randrange(5), rng.randrange(5)) for k in (1, 2) for _ in range(60)] + [(3, 0, 0, 0), (4, 0, 0, 0), (4, 1, 1, 0)]
    meshes = {r.label_id: r for r in surface.mesh_table(spark.createDataFrame(sorted(set(voxels)), VOXEL), ["label_id"], (2.0, 1.0, 0.5)).collect()}
    assert all(m.open_edges == 0 for m in meshes.values())
    assert (meshes[3].n_points, meshes[3].n_cells) == (8, 12)
    corner = surface.vertices(surface.quads(spark.createDataFrame([(1, 0, 0, 0)], VOXEL), ["label_id"]), ["label_id"], (2.0, 1.0, 0.5)).collect()
    assert {round(abs(r.vx) / 0.5, 6) for r in corner} == {round(1 / 6, 6)} and {r.n_faces for r in corner} == {3}


def test_outline_of_a_ring_is_its_outer_one(spark):
    ring = [(1, 0, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    rows = surface.outlines(spark.createDataFrame(ring, VOXEL).withColumn("cc_id", F.lit(1))).orderBy("place").collect()
    assert [(r.cy, r.cx) for r in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (3, 3), (3, 2), (3, 1), (3, 0), (2, 0), (1, 0)]


def test_gaps_are_filled_forwards_then_backwards(spark):
    best = spark.createDataFrame([(1, 0, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1), (1, 5, 1, -1, 1, 7)], "label_id int, z int, cc_id int, dir int, o_label_id int, o_cc_id int")
    chosen = spark.createDataFrame([(9, 0, 1, 1), (9, 5, 1, 1)], "selection_id int, z int, label_id int, cc_id int")
    assert sorted(r.z for r in tracking.missing_slices(chosen).collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, tracking.fill_gaps(chosen, best, Workspace(spark, "t")).collect())) == [(9, 1, 1, 1), (9, 2, 1, 1), (9, 4, 1, 7)]


def test_path_layers_reach_every_layer_once(spark):
    best = spark.createDataFrame([(1, z, 1, 1, 1, 1) for z in range(9)] + [(1, z, 1, -1, 1, 1) for z in range(1, 10)], "label_id int, z int, cc_id int, dir int, o_label_id int, o_cc_id int")
    rows = paths.path_layers(spark.createDataFrame([(1, 3, 1), (1, 9, 1)], "label_id int, z int, cc_id int"), best, Workspace(spark, "t")).collect()
    assert sorted((r.s_z, r.z) for r in rows) == [(s, z) for s in (3, 9) for z in range(10)]


def test_brush_searches():
    line = {i: [j for j in (i - 1, i + 1) if 0 <= j < 50] for i in range(50)}
    assert brush.find_path(line, 3, 6) == [4, 5, 6] and brush.find_path(line, 3, 3) == []
    assert brush.find_path(line, 0, 30) is not None and brush.find_path(line, 0, 31) is None  # 30 expansions
    assert brush.within_hops(line, 0) == set(range(16))


def test_paths_from_bounded_neighbourhoods(spark):
    """The same paths as a search over all edges finds, on lines, trees and thick lumps; no row knows more than 30 points."""
    rng = random.Random(9)
    near = {}
    link = lambda a, b: (near.setdefault(a, []).append(b), near.setdefault(b, []).append(a))
    for i in range(200):
        link(i, i + 1)
    for i in range(301, 420):
        link(i, rng.randrange(300, i))
    lump = [(z, y, x) for z in range(5) for y in range(5) for x in range(5)]
    for i, v in enumerate(lump):
        for j, w in enumerate(lump[:i]):
            if max(abs(a - b) for a, b in zip(v, w)) == 1:
                link(500 + i, 500 + j)
    for n in near.values():
        rng.shuffle(n)
    edges = spark.createDataFrame([(a, b, i) for a, n in near.items() for i, b in enumerate(n)], "a long, b long, ord int")
    pairs = [(i, rng.choice(sorted(near)), None) for i in range(400)]
    pairs = [(i, a, a if i % 40 == 0 else rng.choice([b for b in near if abs(b - a) < 40])) for i, a, _ in pairs]
    work = Workspace(spark, "t")
    known = brush.bounded_neighbourhoods(edges, work).collect()
    assert len(known) == len(near) and max(len(r.nodes) for r in known) == 30 and all(near[p] == list(n) for r in known for p, n in zip(r.nodes, r.lists))
    found = {}
    for r in brush.fill_paths(spark.createDataFrame(pairs, "pair_id long, from_id long, to_id long"), edges, work).orderBy("pair_id", "place").collect():
        found.setdefault(r.pair_id, []).append(r.point_id)
    wanted = {i: p for i, a, b in pairs if (p := brush.find_path(near, a, b))}
    assert found == wanted and 50 < len(wanted) < 400


def test_brush_strokes(spark):
    """A far pick is drawn in by hops; the brush is placed, then draws, and refuses a jump."""
    points = [(i, 0, 0, 2 * i) for i in range(60)]
    placed = spark.createDataFrame(points, "point_id long, z int, y int, x int")
    part = spark.createDataFrame([(i, 1, 0) for i in range(60)], "point_id long, label_id int, root long")
    edges = spark.createDataFrame([(a, b, 0) for a in range(60) for b in (a - 1, a + 1) if 0 <= b < 60], "a long, b long, ord int")
    strokes = spark.createDataFrame([(e, 7, e, p) for e, p in enumerate([0, 2, 5, 50, 4])], "event_id long, user_id long, ts int, point_id long").withColumn("ts", F.timestamp_seconds("ts"))
    rows = brush.replay_strokes(strokes, placed, part, edges, (1.0, 1.0, 1.0), 20.0, Workspace(spark, "t")).orderBy("event_id").collect()
    assert [(r.phase, r.point_id, r.n_added) for r in rows] == [("positioning", 0, 0), ("drawing", 2, 2), ("drawing", 5, 3), ("rejected", 5, 0), ("drawing", 4, 0)]
    hidden = spark.createDataFrame([(2,), (50,)], "point_id long")
    rows = brush.replay_strokes(strokes, placed, part, edges, (1.0, 1.0, 1.0), 20.0, Workspace(spark, "t"), hidden).orderBy("event_id").collect()
    assert [(r.phase, r.point_id, r.n_added) for r in rows] == [("positioning", 0, 0), ("hidden", 2, 0), ("drawing", 5, 5), ("hidden", 50, 0), ("drawing", 4, 0)]


def test_colours(spark):
    labels = spark.createDataFrame([(1, "a", "#FF0000"), (2, "b", None), (3, "c", None)], "label_id int, name string, color string")
    rows = [r.color for r in colors.assign_colors(labels).orderBy("label_id").collect()]
    import colorsys

    hexed = ["#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hsv_to_rgb(h, 0.75, 0.85)) for h in colors.rainbow_hues(12)]
    rgb = lambda c: [int(c[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    used = ["#ff0000"]
    for _ in range(2):
        free = [c for c in hexed if c not in used]
        used.append(max(free, key=lambda c: min(sum((a - b) ** 2 for a, b in zip(rgb(c), rgb(u))) ** 0.5 for u in used)))
    assert rows == ["#FF0000", *used[1:]]
    got = spark.range(1).select(colors.hex_to_rgba(F.lit("zz")).alias("a"), colors.hex_to_rgba(F.lit("#0080ff")).alias("b")).first()
    assert got.a is None and (got.b.r, got.b.g, got.b.b, got.b.a) == (0.0, 128 / 255, 1.0, 1.0)


@pytest.mark.parametrize("name", ["J15", "O4", "J20", "P12"])
def test_plans_neither_window_nor_broadcast_for_nulls(spark, name):
    """Least rows come from sums by key, and hidden parts from a plain anti join."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from lamina.session import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=dict), conf={}))


def test_tracking_steps():
    path = [{"z": z, "label_id": 1 if z < 4 else 2} for z in (1, 2, 3, 4, 6, 7)]
    event = lambda z_l0=None, z=None, path=None: {"z_l0": z_l0, "z": z, "path": path}
    state, steps = None, []
    for e in (event(8), event(z=2, path=path), event(9), event(12), event(16), event(24), event(40), event(28), event(4)):
        step, state = replay.track(state, e, 4)
        steps.append(step)
    assert steps == ["untracked", "tracked", "same layer", "moved", "label changed", "instance changed", "out of path", "instance changed", "label changed"]


def _stream(spark, tmp_path, rows, schema, build, name):
    """What a stream yields over micro-batches of one file each, and how many users' states are left."""
    from lamina.streaming import processors

    processors.rocksdb(spark)
    at = tmp_path / name
    query = None
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_millis(F.round(F.col("ts") * 1000 + 10**12).cast("long"))).coalesce(1).write.mode("append").parquet(str(at / "in"))
        stream = spark.readStream.schema(schema).parquet(str(at / "in")).withWatermark("ts", "1 second")
        query = build(stream).writeStream.format("parquet").option("path", str(at / "out")).outputMode("append").option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "state").load(str(at / "state")).count()
    return spark.read.parquet(str(at / "out")).collect(), left


def test_tracking_state_is_carried_over_micro_batches(spark, tmp_path):
    from lamina.streaming import processors

    path = [(z, 1) for z in range(10)]
    schema = "event_id long, user_id long, ts timestamp, z_l0 int, z int, path array<struct<z:int,label_id:int>>"
    rows = [[(1, 7, 0.0, None, 2, path)], [(2, 7, 1.0, 12, None, None)], [(3, 7, 2.0, 13, None, None)], [(4, 8, 3.0, 4, None, None)]]
    found, left = _stream(spark, tmp_path, rows, schema, lambda s: processors.tracking_stream(s, 60_000), "tracked")
    assert {r.event_id: r.step for r in found} == {1: "tracked", 2: "moved", 3: "same layer", 4: "untracked"} and left == 1
    more = rows + [[(5, 8, 200.0, 4, None, None)], [(6, 8, 201.0, 4, None, None)], [(7, 7, 202.0, 13, None, None)]]
    found, left = _stream(spark, tmp_path, more, schema, lambda s: processors.tracking_stream(s, 60_000), "idle")
    assert {r.event_id: r.step for r in found}[7] == "untracked" and left == 0


def test_delays_over_micro_batches_equal_the_table_form(spark, tmp_path):
    from lamina.streaming import processors

    rng = random.Random(3)
    rows, now, event = [], {u: 100.0 * u for u in range(5)}, 0
    for _ in range(6):
        part = []
        for _ in range(40):
            u = rng.randrange(5)
            now[u] = max(now[u], max(now.values()) - 0.5) if rng.random() < 0.1 else now[u] + rng.choice([0.01, 0.02, 0.049, 0.05, 0.06, 0.099, 0.1, 0.3])
            part.append((event := event + 1, u, round(now[u], 3)))
        shift = max(now.values())
        now = {u: max(t, shift) for u, t in now.items()}
        rows.append(part)
    schema = "event_id long, user_id long, ts timestamp"
    found, left = _stream(spark, tmp_path, rows, schema, lambda s: processors.delays_stream(s, 10**12), "delays")
    table = spark.createDataFrame([r for part in rows for r in part], "event_id long, user_id long, ts double").withColumn("ts", F.timestamp_millis(F.round(F.col("ts") * 1000 + 10**12).cast("long")))
    wanted = spark.sql(queries._T1.replace("{events}", "{e}") % "unix_millis(ts) - unix_millis(before)", e=table).collect()
    assert {(r.event_id, r.scroll_count, r.delay_ms) for r in found} == {(r.event_id, r.scroll_count, r.delay_ms) for r in wanted} and left == 5


def test_the_state_of_idle_users_goes(spark, tmp_path):
    from lamina.streaming import processors

    rows = [[(1, 7, 0.0), (2, 7, 0.01), (3, 7, 0.02), (4, 8, 0.0)], [(5, 8, 100.0)], [(6, 8, 100.01)], [(7, 7, 100.5), (8, 7, 100.51)]]
    found, left = _stream(spark, tmp_path, rows, "event_id long, user_id long, ts timestamp", lambda s: processors.delays_stream(s, 30_000), "idle")
    assert {r.event_id: r.scroll_count for r in found} == {1: 0, 2: 2, 3: 4, 4: 0, 5: 0, 6: 2, 7: 0, 8: 2} and left == 2
    found, left = _stream(spark, tmp_path, rows[:3], "event_id long, user_id long, ts timestamp", lambda s: processors.delays_stream(s, 30_000), "gone")
    assert left == 1


def test_dilation_and_faces(spark):
    voxel = spark.createDataFrame([(1, 5, 5, 5)], VOXEL)
    assert geometry.dilate(voxel, 3, ["label_id"], (20, 20, 20)).count() == 123
    assert geometry.boundary_faces(voxel, ["label_id"]).count() == 6


@pytest.mark.parametrize("share", [0.02, 0.5, 0.9])
def test_dilation_and_faces_against_every_voxel(spark, share):
    rng = random.Random(int(share * 100))
    voxels = {(k, z, y, x) for k in (1, 2) for z in range(7) for y in range(8) for x in range(9) if rng.random() < share}
    df = spark.createDataFrame([*sorted(voxels), *list(voxels)[:3]], VOXEL)
    shape = (8, 9, 10)
    grown = [tuple(r) for r in geometry.dilate(df, 3, ["label_id"], shape).select("label_id", "z", "y", "x").collect()]
    ball = [(a, b, c) for a in range(-3, 4) for b in range(-3, 4) for c in range(-3, 4) if a * a + b * b + c * c <= 9]
    assert len(grown) == len(set(grown)) and set(grown) == {(k, z + a, y + b, x + c) for k, z, y, x in voxels for a, b, c in ball if 0 <= z + a < 8 and 0 <= y + b < 9 and 0 <= x + c < 10}
    for directions in (geometry.FACES, geometry.FACES[2:], geometry.FACES[:1], geometry.FACES[5:]):
        faces = [tuple(r) for r in geometry.boundary_faces(df, ["label_id"], directions).select("label_id", "z", "y", "x", "face").collect()]
        wanted = {(k, z, y, x, i) for k, z, y, x in voxels for i, (a, b, c) in enumerate(directions) if (k, z + a, y + b, x + c) not in voxels}
        assert len(faces) == len(set(faces)) and set(faces) == wanted


def test_ordered_ids_are_gapless(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    rows = numbering.ordered_ids(df, ["k"], "n", Workspace(spark, "t")).collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 1000


def test_empty_volume(spark):
    empty = spark.createDataFrame([], VOXEL)
    work = Workspace(spark, "t")
    runs = components.contour_runs(empty, work)
    assert runs.count() == components.overlaps(runs).count() == components.bodies(runs, work).count() == 0
    points = components.skeleton_points(empty.select("z", "y", "x"), empty, work)
    assert components.instances(points, components.adjacency(points), work).count() == 0


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")
    late = events.selectExpr("max(event_id) + 1 as event_id", "-1L as user_id", "max(ts) + interval 10 days as ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    query = replay.debounced(stream, "30 minutes").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all bursts
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    streamed = sorted(tuple(r) for r in spark.table("bursts").where("user_id >= 0").collect())
    assert streamed == sorted(tuple(r) for r in replay.debounced(events, "30 minutes").collect())


@pytest.mark.parametrize("name", ["C1", "A1", "J1", "J4", "G1", "A5", "U5", "T1", "J7", "G13", "G14", "M6_outline", "S2", "R1", "R4", "K1", "P17", "Q5", "T6"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(c) for c in columns]
    wanted = sorted(str([float(row[i]) if isinstance(row[i], (int, float)) and not isinstance(row[i], bool) else row[i] for i in order]) for row in cur.fetchall())
    rows = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows) == wanted


def test_hop_neighbourhood_of_15_hops(spark):
    test_query_equals_its_oracle(spark, "G6")
    hops = {r.hops for r in queries.QUERIES["G6"](spark, DATA).collect()}
    assert 5 < max(hops) <= 15


def test_deep_pyramid_has_every_image_voxel(spark):
    test_query_equals_its_oracle(spark, "R1_deep")
    made = queries.QUERIES["R1_deep"](spark, DATA)
    assert made.where("level = 0").count() == volume.image(spark, DATA).count()
    assert made.where("value = 0").count() > 0


def test_entry_imports_without_the_text_package():
    import __spark_entry__ as entry

    assert {"C1", "G2"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(DATA)
