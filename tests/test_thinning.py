"""Thinning against the same rules one voxel at a time, and against what must stay."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest

from lamina.operators import thinning
from lamina.session import Workspace


def parts(voxels: set, steps) -> list[set]:
    left, out = set(voxels), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            v = todo.pop()
            own.add(v)
            for s in steps:
                w = tuple(a + b for a, b in zip(v, s))
                if w in left:
                    left.remove(w)
                    todo.append(w)
        out.append(own)
    return out


def simple(v, voxels) -> bool:
    """By definition: one 26-part of neighbours, and one 6-part of the background within the 18-neighbours that faces the voxel."""
    near = {o for o in thinning.AROUND if tuple(a + b for a, b in zip(v, o)) in voxels}
    empty = {o for o in thinning.AROUND if o not in near and sum(map(abs, o)) <= 2}
    faces = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
    return len(parts(near, thinning.AROUND)) == 1 and len([p for p in parts(empty, faces) if p & set(faces)]) == 1


def brute_thin(voxels: set) -> set:
    """Round after round, subfield after subfield, voxel after voxel."""
    now = set(voxels)
    while True:
        before = set(now)
        faces = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
        border = {v for v in now if any(tuple(a + b for a, b in zip(v, o)) not in now for o in faces)}
        for field in product((0, 1), repeat=3):
            for v in sorted(v for v in border & now if tuple(c % 2 for c in v) == field):
                n = sum(tuple(a + b for a, b in zip(v, o)) in now for o in thinning.AROUND)
                if n >= 2 and simple(v, now):
                    now.remove(v)
        if now == before:
            return now


def test_deletable_by_definition():
    rng = random.Random(2)
    for _ in range(3000):
        share = rng.random()
        near = {o for o in thinning.AROUND if rng.random() < share}
        code = sum(1 << i for i, o in enumerate(thinning.AROUND) if o in near)
        assert thinning.deletable(code) == (len(near) >= 2 and simple((0, 0, 0), near))


SHAPES = {
    "noise": lambda z, y, x, rng: rng.random() < 0.55,
    "box": lambda z, y, x, rng: True,
    "ring": lambda z, y, x, rng: 9 <= (y - 6) ** 2 + (x - 7) ** 2 <= 30,
    "shell": lambda z, y, x, rng: 9 <= (z - 6) ** 2 + (y - 6) ** 2 + (x - 6) ** 2 <= 26,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_thinning_equals_brute_force_in_any_blocks(spark, monkeypatch, shape):
    rng = random.Random(4)
    voxels = {(z, y, x) for z in range(13) for y in range(13) for x in range(15) if SHAPES[shape](z, y, x, rng)}
    wanted = brute_thin(voxels)
    rows = thinning.thin(spark.createDataFrame(sorted(voxels), "z int, y int, x int"), Workspace(spark, "t")).collect()
    assert {(r.z, r.y, r.x) for r in rows} == wanted and len(rows) == len(wanted)
    far = {(z + 57, y + 58, x + 121) for z, y, x in voxels} | {(200, 3, 3)}  # over block borders; one voxel alone
    rows = thinning.thin(spark.createDataFrame(sorted(far), "z int, y int, x int"), Workspace(spark, "t")).collect()
    assert {(r.z, r.y, r.x) for r in rows} == brute_thin(far)
    whole, thin = ([p for p in parts(v, thinning.AROUND)] for v in (voxels, wanted))
    assert len(whole) == len(thin) and len(wanted) <= len(voxels)
    if shape == "ring":
        assert 5 < len(wanted) < 40  # a loop
    if shape == "shell":
        assert len(wanted) > 20  # the hollow stays closed


def test_curves_are_left_alone(spark):
    line = [(z, z // 2, 70 - z) for z in range(70)]
    rows = thinning.thin(spark.createDataFrame([*line, *line], "z int, y int, x int"), Workspace(spark, "t")).collect()
    ends = {line[0], line[-1]}
    assert ends <= {(r.z, r.y, r.x) for r in rows} <= set(line) and len(parts({(r.z, r.y, r.x) for r in rows}, thinning.AROUND)) == 1
    assert thinning.thin(spark.createDataFrame([], "z int, y int, x int"), Workspace(spark, "t")).collect() == []


def test_thick_rods_become_curves(spark):
    rod = np.zeros((40, 12, 12), bool)
    rod[2:38, 3:8, 4:9] = True
    rows = thinning.thin(spark.createDataFrame([tuple(map(int, v)) for v in np.argwhere(rod)], "z int, y int, x int"), Workspace(spark, "t")).collect()
    assert 25 <= len(rows) <= 60 and {r.z for r in rows} >= set(range(6, 34))
