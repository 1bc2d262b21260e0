"""The selection brush on the skeleton: bounded searches and the replay of strokes.

A path search expands at most MAX_EXPANSIONS points, so each point's searches need a neighbourhood that is
bounded whatever its part's size; these are pulled together by joins for all points at once. A
stroke's choices depend on what it did before and are followed step by step: a task gets the strokes and
edges of one part, which a stroke never leaves.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import Workspace

#: Points that a search for a path may expand, and hops that a snap may go.
MAX_EXPANSIONS, MAX_HOPS = 30, 15


def neighbour_lists(edges: pa.Table) -> dict[int, list[int]]:
    """Neighbours of each point in the order of their offsets."""
    out: dict[int, list[int]] = {}
    edges = edges.sort_by([("a", "ascending"), ("ord", "ascending")])
    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
        out.setdefault(a, []).append(b)
    return out


def find_path(near: dict[int, list[int]], start: int, goal: int, most: int = MAX_EXPANSIONS) -> list[int] | None:
    """The points after start on the way to goal that breadth-first search finds within so many expansions."""
    if start == goal:
        return []
    came, queue = {start: start}, deque([start])
    for _ in range(most):
        if not queue:
            return None
        now = queue.popleft()
        for point in near.get(now, ()):
            if point not in came:
                came[point] = now
                if point == goal:
                    path = [goal]
                    while came[path[-1]] != start:
                        path.append(came[path[-1]])
                    return path[::-1]
                queue.append(point)
    return None


def within_hops(near: dict[int, list[int]], start: int, hops: int = MAX_HOPS) -> set[int]:
    seen = frontier = {start}
    for _ in range(hops):
        frontier = {b for a in frontier for b in near.get(a, ())} - seen
        seen = seen | frontier
    return seen


def expansions(start: int, near: dict[int, list[int]], most: int) -> tuple[list[int], list[int]]:
    """The first ``most`` points that breadth-first search expands, and those of them whose neighbours aren't known yet."""
    order, seen, missing, at = [start], {start}, [], 0
    while at < len(order) and at < most:
        now = order[at]
        at += 1
        if now not in near:
            missing.append(now)
            continue
        new = [p for p in near[now] if p not in seen]
        seen.update(new)
        order += new
    return order[:most], missing


NEAR = "point_id long, nodes array<long>, lists array<array<long>>, missing array<long>"


def bounded_neighbourhoods(edges: DataFrame, work: Workspace, most: int = MAX_EXPANSIONS) -> DataFrame:
    """(point_id, nodes, lists): for each point with neighbours the points that a search from it expands, at most ``most``, with their neighbours in order.

    A point first knows its own neighbours. In each round it asks the points that it would expand but doesn't know for
    all that they know, so what is known about doubles in reach, and rounds grow with the logarithm of ``most``. No row
    holds more than ``most`` lists of 26, and what a point asks for is at most ``most`` such rows, whatever the part's size.
    """
    own = edges.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("n"))  # at most 26
    first = own.select(F.col("a").alias("point_id"), F.array("a").alias("nodes"), F.array(F.transform("n", lambda s: s["b"])).alias("lists"), F.slice(F.transform("n", lambda s: s["b"]), 1, most - 1).alias("missing"))
    now, turn = work.keep(first, "near0"), 0
    while not now.where("size(missing) > 0").isEmpty():
        told = now.select(F.col("point_id").alias("asked"), F.arrays_zip("nodes", "lists").alias("known"))
        answers = now.select("point_id", F.explode("missing").alias("asked")).join(told, "asked").groupBy("point_id").agg(F.flatten(F.collect_list("known")).alias("more"))

        def learn(batches):
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    near = dict(zip(r["nodes"], r["lists"])) | {k["nodes"]: k["lists"] for k in r.pop("more") or []}
                    order, missing = expansions(r["point_id"], near, most)
                    known = [p for p in order if p in near]
                    r |= {"nodes": known, "lists": [near[p] for p in known], "missing": missing}
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("point_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("lists", pa.list_(pa.list_(pa.int64()))), ("missing", pa.list_(pa.int64()))]))

        turn += 1
        now = work.keep(now.drop("missing").join(answers, "point_id", "left").select("point_id", "nodes", "lists", "more").mapInArrow(learn, NEAR), f"near{turn}")
        work.drop(f"near{turn - 1}")
    return now.drop("missing")


def fill_paths(pairs: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """(pair_id, from_id, to_id, place, point_id) of the paths of pairs (pair_id, from_id, to_id); pairs without one within MAX_EXPANSIONS have no row."""
    near = bounded_neighbourhoods(edges, work)

    def fill(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path = find_path(dict(zip(r["nodes"], r["lists"])), r["from_id"], r["to_id"]) or []
                out += [{"pair_id": r["pair_id"], "from_id": r["from_id"], "to_id": r["to_id"], "place": i, "point_id": p} for i, p in enumerate(path)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("pair_id", pa.int64()), ("from_id", pa.int64()), ("to_id", pa.int64()), ("place", pa.int32()), ("point_id", pa.int64())]))

    asked = pairs.select("pair_id", "from_id", "to_id").join(near.withColumnRenamed("point_id", "from_id"), "from_id")
    return asked.select("pair_id", "from_id", "to_id", "nodes", "lists").mapInArrow(fill, "pair_id long, from_id long, to_id long, place int, point_id long")


def _with_root(edges: DataFrame, part: DataFrame) -> DataFrame:
    return edges.select("a", "b", "ord").join(part.select(F.col("point_id").alias("a"), "root"), "a")


def _replay(size: tuple[float, float, float], jump: float):
    def replay(strokes: pa.Table, points: pa.Table, edges: pa.Table) -> list[tuple]:
        near = neighbour_lists(edges)
        at = {p: np.array(c) * size for p, *c in zip(*(points.column(c).to_pylist() for c in ("point_id", "z", "y", "x")))}
        distance = lambda a, b: float(np.linalg.norm(at[a] - at[b]))
        out = []
        strokes = strokes.sort_by([("user_id", "ascending"), ("ts", "ascending"), ("event_id", "ascending")])
        user = last = None
        for event, now, picked, *place in zip(*(strokes.column(c).to_pylist() for c in ("event_id", "user_id", "point_id", "z", "y", "x"))):
            if now != user:
                user, last, drawing, drawn = now, None, False, set()
            point = picked
            if last is not None:
                local = within_hops(near, last)
                if picked not in local:
                    point = min(sorted(local), key=lambda p: float(np.linalg.norm(at[p] - np.array(place) * size)))  # noqa: B023
            if not drawing:
                if last is None or last == point or distance(last, point) > jump:
                    last = point
                    out.append((event, now, "positioning", point, 0))
                    continue
                drawing = True
            if last != point and distance(last, point) > jump:
                out.append((event, now, "rejected", last, 0))
                continue
            path = find_path(near, last, point)
            if path is None:
                out.append((event, now, "no path", last, 0))
                continue
            new = {*path, point} - drawn
            drawn |= new
            last = point
            out.append((event, now, "drawing", point, len(new)))
        return out

    return replay


def replay_strokes(strokes: DataFrame, points: DataFrame, part: DataFrame, edges: DataFrame, size: tuple[float, float, float], jump: float, work: Workspace, hidden: DataFrame | None = None) -> DataFrame:
    """(event_id, user_id, phase, point_id, n_added) of each brush event (event_id, user_id, ts, point_id), in order of ts.

    A picked point further than MAX_HOPS from the last one is replaced by the nearest of those
    within. Until a move shorter than ``jump`` the brush is only placed; then a move adds the
    path to its point, and a longer one, or one without a path, is refused. hidden: (point_id) that can't be
    picked; such an event changes nothing, and its phase is 'hidden'.
    """
    refused = None
    if hidden is not None:
        strokes = work.keep(strokes.join(work.met(hidden.select("point_id").distinct().withColumn("_hidden", F.lit(True))), "point_id", "left"), "seen")
        refused = strokes.where("_hidden").select("event_id", "user_id", F.lit("hidden").alias("phase"), "point_id", F.lit(0).cast("long").alias("n_added"))
        strokes = strokes.where("_hidden is null").drop("_hidden")
    replay = _replay(size, jump)

    def run(both: pa.Table, edge: pa.Table) -> pa.Table:
        is_stroke = pc.is_valid(both.column("event_id"))
        rows = replay(both.filter(is_stroke), both.filter(pc.invert(is_stroke)), edge) if both.num_rows else []
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("event_id", "user_id", "phase", "point_id", "n_added"), columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))})

    first = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rooted = work.keep(strokes.join(part.select("point_id", "root"), "point_id").join(points.select("point_id", "z", "y", "x"), "point_id").withColumn("root", F.first("root").over(first)), "strokes")
    none = {"event_id": "long", "user_id": "long", "ts": "timestamp"}
    places = points.join(part.select("point_id", "root"), "point_id").join(rooted.select("root").distinct(), "root", "left_semi").select("root", "point_id", "z", "y", "x")
    both = rooted.select("root", "point_id", "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "z", "y", "x").unionByName(places.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items())))
    used = _with_root(edges, part).join(rooted.select("root").distinct(), "root", "left_semi")
    out = both.groupBy("root").cogroup(used.groupBy("root")).applyInArrow(run, "event_id long, user_id long, phase string, point_id long, n_added long")
    return out if refused is None else out.unionByName(refused)
