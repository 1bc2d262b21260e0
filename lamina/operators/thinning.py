"""Thinning of voxel sets to curves by deleting simple points.

In each round the border voxels, those with a face to the outside, are taken in eight subfields by the
parity of z, y and x, one after the other. Two voxels of a subfield never touch, so all of its voxels that may go
go at once: those that are simple (the voxel's 26-neighbours stay one part without it, and the background by its faces
stays one part within its 18-neighbours) and aren't the end of a curve (one neighbour). So parts, holes and ends stay.
Rounds go on until none deletes a voxel.

The voxels are dealt over blocks of BLOCK^3 with a halo of HALO voxels around. A deletion is decided by
voxels one place away, so a round of eight subfields, after the borders are marked, is right within the block whatever
lies beyond the halo: the result doesn't depend on the blocks. A task holds one block as a dense array; a round is one job.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lamina.session import Workspace

BLOCK, HALO = 64, 10
MAX_ROUNDS = 10_000
SUBFIELDS = tuple(product((0, 1), repeat=3))
#: The 26 neighbours, in raster order.
AROUND = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
_touch = lambda a, b: max(abs(i - j) for i, j in zip(a, b)) == 1
_face = lambda a, b: sum(abs(i - j) for i, j in zip(a, b)) == 1
TOUCHING = [sum(1 << j for j, b in enumerate(AROUND) if _touch(a, b)) for a in AROUND]
NEAR = sum(1 << i for i, a in enumerate(AROUND) if sum(map(abs, a)) <= 2)
BY_FACE = [sum(1 << j for j, b in enumerate(AROUND) if _face(a, b)) for a in AROUND]
FACES = sum(1 << i for i, a in enumerate(AROUND) if sum(map(abs, a)) == 1)


def _spread(start: int, within: int, links: list[int]) -> int:
    """The members of a bit set that links reach from start."""
    done, todo = 0, start
    while todo:
        low = todo & -todo
        done |= low
        todo = (todo | links[low.bit_length() - 1] & within) & ~done
    return done


@lru_cache(maxsize=1 << 20)
def deletable(around: int) -> bool:
    """Whether a voxel may go, by the bits of its 26 neighbours."""
    if around.bit_count() < 2:
        return False
    if _spread(around & -around, around, TOUCHING) != around:
        return False
    outside = ~around & NEAR
    faces = outside & FACES
    return bool(faces) and _spread(faces & -faces, outside, BY_FACE) & FACES == faces


def _neighbours(solid: np.ndarray, at: tuple[np.ndarray, ...]) -> np.ndarray:
    """The bits of the neighbours of some voxels, none on the array's edge."""
    out = np.zeros(len(at[0]), np.int64)
    for i, offset in enumerate(AROUND):
        out |= solid[tuple(a + o for a, o in zip(at, offset))].astype(np.int64) << i
    return out


def thin_round(solid: np.ndarray) -> np.ndarray:
    """One round over a dense array, whose edge layer is never touched; the array after it."""
    solid = solid.copy()
    inner = (slice(1, -1),) * 3
    border = np.zeros_like(solid)
    faces = [np.roll(solid, s, axis)[inner] for axis in range(3) for s in (1, -1)]
    border[inner] = solid[inner] & ~np.logical_and.reduce(faces)
    for field in SUBFIELDS:
        own = np.zeros_like(solid)
        own[tuple(slice(p, None, 2) for p in field)] = True
        at = np.nonzero(border & solid & own)
        if len(at[0]):
            codes, of = np.unique(_neighbours(solid, at), return_inverse=True)
            gone = np.array([deletable(int(c)) for c in codes])[of]
            solid[tuple(a[gone] for a in at)] = False
    return solid


def _block(rows: pa.Table) -> pa.Table:
    """The voxels of a block that are left after a round."""
    start = np.array([rows.column(c)[0].as_py() * BLOCK for c in ("bz", "by", "bx")])
    at = np.stack([rows.column(c).to_numpy() for c in "zyx"])
    low = start - HALO - 2  # an even number, so that parities hold, and an empty layer around
    solid = np.zeros((BLOCK + 2 * HALO + 4,) * 3, bool)
    solid[tuple(at - low[:, None])] = True
    left = thin_round(solid)[(slice(HALO + 2, HALO + 2 + BLOCK),) * 3]
    z, y, x = (p + s for p, s in zip(np.nonzero(left), start))
    return pa.table({c: pa.array(p.astype(np.int32)) for c, p in zip("zyx", (z, y, x))})


def thin(voxels: DataFrame, work: Workspace) -> DataFrame:
    """(z, y, x): the curves that are left of the voxels (z, y, x), whose coordinates aren't negative."""
    now = work.keep(voxels.select("z", "y", "x").distinct(), "thin0")
    before = now.count()
    for i in range(1, MAX_ROUNDS):
        # each voxel goes to its block and to those whose halo holds it, at most two along each axis
        spread = now
        for c in "zyx":
            spread = spread.withColumn(f"b{c}", F.explode(F.expr(f"sequence(greatest(0, {c} - {HALO}) div {BLOCK}, ({c} + {HALO}) div {BLOCK})")))
        own = F.expr(" and ".join(f"{c} div {BLOCK} = b{c}" for c in "zyx")).cast("int")
        block = ["bz", "by", "bx"]
        spread = spread.withColumn("own", own)
        kept = spread.groupBy(*block).agg(F.max("own").alias("any_own")).where("any_own = 1").drop("any_own")  # blocks with nothing but a halo
        seen = Observation()
        made = spread.join(kept, block).select(*block, "z", "y", "x").groupBy(*block).applyInArrow(_block, "z int, y int, x int")
        now = work.keep(made.observe(seen, F.count(F.lit(1)).alias("n")), f"thin{i}")
        work.drop(f"thin{i - 1}")
        if seen.get["n"] == before:
            return now
        before = seen.get["n"]
    raise RuntimeError(f"thinning isn't done after {MAX_ROUNDS} rounds")
