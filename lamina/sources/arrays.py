"""Chunk arrays: rows that hold a dense box of a volume with a channel axis, and numpy operators over them.

A row names its array, its cell of the grid of CHUNK voxels, the box it fills (z0, y0, x0, nz, ny, nx), its
channels and type, and holds the values in order z, y, x, channel. Boxes of zeros alone have no row. No
operator here makes a row of a voxel but ``to_voxels``; a task holds a chunk, or the parts of one, at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = (16, 256, 256)
SCHEMA = "array string, cz int, cy int, cx int, z0 int, y0 int, x0 int, nz int, ny int, nx int, nc int, dtype string, data binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
KEY = ["array", "cz", "cy", "cx"]


class Shape(NamedTuple):
    """Size along z, y and x, channels (None: no channel axis) and type of an array."""

    size: tuple[int, int, int]
    channels: int | None
    dtype: str

    def coarser(self, f: int, up: bool = True) -> tuple[int, int, int]:
        return tuple(-(-n // f) if up else n // f for n in self.size)


def row(array: str, origin: tuple[int, int, int], values: np.ndarray, chunk: tuple[int, int, int] = CHUNK) -> dict:
    """A row of a box (z, y, x, channel) that starts at origin."""
    cell = [int(o) // n for o, n in zip(origin, chunk)]
    values = np.ascontiguousarray(values)
    numbers = dict(zip(("cz", "cy", "cx", "z0", "y0", "x0", "nz", "ny", "nx", "nc"), (*cell, *map(int, origin), *values.shape)))
    return {"array": array, **numbers, "dtype": values.dtype.str, "data": values.tobytes()}


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple[int, int, int], np.ndarray]]:
    """(array, origin, values) of each row, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in COLUMNS[:-1]}
            values = np.frombuffer(b.column("data")[i].as_buffer(), r["dtype"]).reshape(r["nz"], r["ny"], r["nx"], r["nc"])
            yield r["array"], (r["z0"], r["y0"], r["x0"]), values


def cells(origin: tuple[int, int, int], size: tuple[int, ...], chunk: tuple[int, int, int] = CHUNK) -> Iterator[tuple[tuple[int, int, int], tuple[slice, ...]]]:
    """(origin, slices of the box) of the parts of a box in each cell of the grid."""
    spans = [[(max(o, c * n), min(o + s, (c + 1) * n)) for c in range(o // n, -(-(o + s) // n))] for o, s, n in zip(origin, size, chunk)]
    for part in itertools.product(*spans):
        yield tuple(a for a, _ in part), tuple(slice(a - o, b - o) for (a, b), o in zip(part, origin))


def split(array: str, origin: tuple[int, int, int], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the parts of a box that hold any value but zero."""
    for at, part in cells(origin, values.shape[:3]):
        if values[part].any():
            yield batch([row(array, at, values[part])])


def mapped(chunks: DataFrame, change: Callable[[str, tuple, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Each chunk changed on its own, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in opened(batches):
            yield from change(*one)

    return chunks.select(*COLUMNS).mapInArrow(run, SCHEMA)


def assembled(pieces: DataFrame, size: tuple[int, int, int], dtype: str, add: bool = False, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """Pieces put together, or added up, to one row a cell; ``size`` cuts cells off at the array's end."""

    def cell(rows: pa.Table) -> pa.Table:
        parts = list(opened(iter(rows.to_batches())))
        start = [int(o) // n * n for o, n in zip(parts[0][1], CHUNK)]
        shape = [min(n, s - o) for n, s, o in zip(CHUNK, size, start)]
        whole = np.zeros((*shape, parts[0][2].shape[3]), parts[0][2].dtype if add else dtype)
        for _, origin, values in parts:
            place = tuple(slice(o - s, o - s + n) for o, s, n in zip(origin, start, values.shape))
            if add:
                whole[place] += values
            else:
                whole[place] = values
        done = finish(whole).astype(dtype, copy=False)
        return pa.Table.from_batches([batch([row(parts[0][0], tuple(start), done)])] if done.any() else [], ARROW)

    return pieces.groupBy(*KEY).applyInArrow(cell, SCHEMA)


def mean_type(dtype: str) -> str:
    """Means of unsigned 8 and 16 bits stay what they are, cut to whole numbers; 32-bit floats stay; others become 64-bit floats."""
    return dtype if np.dtype(dtype).str[1:] in ("u1", "u2", "f4") else "<f8"


def block_mean(chunks: DataFrame, f: int, shape: Shape, held: bool = False) -> tuple[DataFrame, Shape]:
    """The mean of each block of f^3 voxels by channel, edge blocks padded with zeros.

    held: the last channel marks the voxels that the array holds; a block that has any is marked.
    """
    kind, out = np.dtype(shape.dtype), Shape(shape.coarser(f), shape.channels, mean_type(shape.dtype))
    total = np.dtype("<f8") if kind.kind == "f" else np.dtype("<u4") if kind.kind in "ub" and (1 << 8 * kind.itemsize) * f**3 <= 1 << 32 else np.dtype("<i8")

    def sums(array: str, origin: tuple, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        pads = [(o % f, -(o + n) % f) for o, n in zip(origin, values.shape)]
        padded = np.pad(values, [*pads, (0, 0)]) if any(map(any, pads)) else values
        z, y, x, c = padded.shape
        yield from split(array, tuple(o // f for o in origin), padded.reshape(z // f, f, y // f, f, x // f, f, c).sum(axis=(1, 3, 5), dtype=total))

    def means(s: np.ndarray) -> np.ndarray:
        done = s // f**3 if np.dtype(out.dtype).kind in "ui" else s / f**3
        if held:
            done[..., -1] = s[..., -1] > 0
        return done

    return assembled(mapped(chunks, sums), out.size, out.dtype, add=True, finish=means), out


def truncated(chunks: DataFrame, depth: int) -> DataFrame:
    """Without the slices from depth on."""
    cut = lambda array, origin, values: split(array, origin, values[: max(0, depth - origin[0])])
    return mapped(chunks, cut)


def stride(chunks: DataFrame, f: int, shape: Shape) -> tuple[DataFrame, Shape]:
    """Every f-th voxel along z, y and x."""
    out = Shape(shape.coarser(f), shape.channels, shape.dtype)

    def take(array: str, origin: tuple, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = [-o % f for o in origin]
        taken = values[first[0] :: f, first[1] :: f, first[2] :: f]
        if taken.size:
            yield from split(array, tuple((o + a) // f for o, a in zip(origin, first)), taken)

    return assembled(mapped(chunks, take), out.size, out.dtype), out


def upsample(chunks: DataFrame, f: int, size: tuple[int, int, int]) -> DataFrame:
    """Every voxel as a block of f^3, cut off at ``size``. Chunks must fill whole cells, so that each cell comes from one."""

    def grow(array: str, origin: tuple, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = tuple(o * f for o in origin)
        if any(o % n for o, n in zip(origin, CHUNK)):
            raise ValueError("upsample takes chunks on the grid of cells")
        box = [min(n * f, s - o) for n, s, o in zip(values.shape, size, start)]
        for at, part in cells(start, box) if min(box) > 0 else ():
            index = [(np.arange(p.start, p.stop)) // f for p in part]
            grown = values[np.ix_(*index)]
            if grown.any():
                yield batch([row(array, at, grown)])

    return mapped(chunks, grow)


def pyramid(chunks: DataFrame, levels: int, shape: Shape, keep: Callable[[DataFrame, str], DataFrame], least_side: int = 16, coarsen: Callable = block_mean, progressive: bool = True) -> list[tuple[DataFrame, Shape]]:
    """Levels from the given one down, while the least side halved so often is ``least_side`` or more.

    progressive: each level from the one before by a factor of 2; else all from the first by 2, 4, 8...
    ``keep`` writes a level under a name and gives it back, so that no level is made twice.
    """
    out = [(chunks, shape)]
    for level in range(1, levels):
        if min(shape.size) // 2**level < least_side:
            break
        source, f = (out[-1], 2) if progressive else (out[0], 2**level)
        made, size = coarsen(source[0], f, source[1])
        out.append((keep(made, f"level{level}"), size))
    return out


def named(chunks: DataFrame, array: str) -> DataFrame:
    return chunks.withColumn("array", F.lit(array)).select(*COLUMNS)


def values_of(chunks: DataFrame) -> DataFrame:
    """(value): distinct values but zero; each chunk sends its own once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, values in opened(batches):
            found = np.unique(values)
            yield pa.RecordBatch.from_arrays([pa.array(found[found != 0].astype(np.float64))], ["value"])

    return chunks.select(*COLUMNS).mapInArrow(run, "value double").distinct()


def label_masks(chunks: DataFrame) -> DataFrame:
    """A mask chunk of 0 and 1 for each value above 0 of a label volume's chunk; its array is the value's name."""

    def cut(_: str, origin: tuple, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for value in np.unique(values):
            if value > 0:
                yield batch([row(str(int(value)), origin, (values == value).astype("u1"))])

    return mapped(chunks, cut)


def to_voxels(chunks: DataFrame, held: bool = False) -> DataFrame:
    """(array, z, y, x, channel, value): a row for each value but zero; held: for each value, zero too, of the voxels that the last channel marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for array, origin, values in opened(batches):
            z, y, x, channel = np.nonzero(np.broadcast_to(values[..., -1:], (*values.shape[:3], values.shape[3] - 1)) if held else values)
            places = [(p + o).astype(np.int32) for p, o in zip((z, y, x), origin)]
            yield pa.RecordBatch.from_arrays([pa.array([array] * len(z), pa.string()), *map(pa.array, places), pa.array(channel.astype(np.int32)), pa.array(values[z, y, x, channel].astype(np.float64))], ["array", "z", "y", "x", "channel", "value"])

    return chunks.select(*COLUMNS).mapInArrow(run, "array string, z int, y int, x int, channel int, value double")


def from_voxels(voxels: DataFrame, shape: Shape, array: str = "", held: bool = False) -> DataFrame:
    """Chunks of voxels (z, y, x[, channel], value); of several rows of a voxel any stays. held: the last channel becomes 1 where a voxel has a row."""
    channel = F.col("channel") if "channel" in voxels.columns else F.lit(0)
    placed = voxels.select(*(F.expr(f"cast({c} div {n} as int)").alias(f"c{c}") for c, n in zip("zyx", CHUNK)), "z", "y", "x", channel.alias("channel"), F.col("value").cast("double").alias("value"))

    def cell(rows: pa.Table) -> pa.Table:
        start = [rows.column(c)[0].as_py() * n for c, n in zip(("cz", "cy", "cx"), CHUNK)]
        values = np.zeros((*(min(n, s - o) for n, s, o in zip(CHUNK, shape.size, start)), shape.channels or 1), shape.dtype)
        z, y, x, c = (rows.column(n).to_numpy() for n in ("z", "y", "x", "channel"))
        values[z - start[0], y - start[1], x - start[2], c] = rows.column("value").to_numpy()
        if held:
            values[z - start[0], y - start[1], x - start[2], -1] = 1
        return pa.Table.from_batches([batch([row(array, tuple(start), values)])] if values.any() else [], ARROW)

    return placed.groupBy("cz", "cy", "cx").applyInArrow(cell, SCHEMA)
