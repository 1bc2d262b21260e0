"""Meshes as binary VTK files, with an index table beside them.

A mesh set is a folder: ``files`` holds a legacy VTK file (PolyData, binary) for each mesh, named after its key,
and ``index`` is a Parquet table of keys, files and sizes. A mesh of more than BAND slices has a file for each band of
them, ``<key>_z<band>.vtk``, so that one task never holds more than a band. Points on a band's border are in both; they
come first in the upper band's file, and the index has their number, so that a reader counts each once.
A file is written whole or not at all, and the index last, so that a set without one isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import surface
from lamina.session import by_shuffle
from lamina.sources import files

BAND = 256
INDEX = "mesh_key string, band int, file string, n_points long, n_cells long, n_shared long"


def to_vtk(points: np.ndarray, triangles: np.ndarray, title: str = "mesh", kind: str = "float") -> bytes:
    """A legacy VTK file of points (n, 3) in x, y, z and triangles (m, 3); numbers are big-endian, places of the kind float or double."""
    cells = np.column_stack([np.full(len(triangles), 3), triangles]).astype(">i4")
    head = f"# vtk DataFile Version 3.0\n{title[:200]}\nBINARY\nDATASET POLYDATA\nPOINTS {len(points)} {kind}\n"
    return head.encode() + points.astype({"float": ">f4", "double": ">f8"}[kind]).tobytes() + f"\nPOLYGONS {len(triangles)} {cells.size}\n".encode() + cells.tobytes() + b"\n"


def from_vtk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(points, triangles) of a binary PolyData file; ValueError for another."""
    at = 0

    def line() -> list[bytes]:
        nonlocal at
        while True:
            end = data.find(b"\n", at)
            if end < 0:
                raise ValueError("a VTK file ends early")
            text, at = data[at:end].split(), end + 1
            if text:
                return text

    def numbers(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * n
        if at + size > len(data):
            raise ValueError("a VTK file ends early")
        out, at = np.frombuffer(data, kind, n, at), at + size
        return out

    if not data.startswith(b"# vtk DataFile") or line() is None or line() is None or line() != [b"BINARY"] or line() != [b"DATASET", b"POLYDATA"]:
        raise ValueError("not a binary PolyData file")
    word, n, kind = line()
    points = numbers({b"float": ">f4", b"double": ">f8"}[kind], 3 * int(n)).reshape(-1, 3)
    word, n, size = line()
    if word != b"POLYGONS" or int(size) != 4 * int(n):
        raise ValueError("a mesh of triangles was expected")
    cells = numbers(">i4", int(size)).reshape(-1, 4)
    if len(cells) and ((cells[:, 0] != 3).any() or cells[:, 1:].min() < 0 or cells[:, 1:].max() >= len(points)):
        raise ValueError("a mesh of triangles was expected")
    return points, cells[:, 1:]


def _assemble(rows: pa.Table, path: str, depth: int, height: int) -> pa.Table:
    """Writes the mesh of one key and band; rows are its quadrilaterals' corners with their vertices.

    Places are doubles, as a float's seven digits don't tell micrometres far down a deep volume. The cells of the slice
    before a band are in the file of the band before too: if only faces above the slice touched such a cell,
    its voxels there and below would be the same, so there would be faces in the slice as well.
    """
    t = rows.sort_by([(c, "ascending") for c in ("z", "y", "x", "axis", "up", "corner")])
    cells = np.column_stack([t.column(c).to_numpy() for c in ("cz", "cy", "cx")])
    own, first, of = np.unique(cells, axis=0, return_index=True, return_inverse=True)
    points = np.column_stack([t.column(c).to_numpy()[first] for c in ("vx", "vy", "vz")])
    quads = of.reshape(-1, 4)
    outward = t.column("up").to_numpy(zero_copy_only=False)[::4] ^ (t.column("axis").to_numpy()[::4] == 1)  # which way round the corners run, seen from outside
    quads = np.where(outward[:, None], quads, quads[:, ::-1])
    triangles = np.concatenate([quads[:, [0, 1, 2]], quads[:, [0, 2, 3]]])
    key, band = t.column("mesh_key")[0].as_py(), t.column("band")[0].as_py()
    name = f"{key}.vtk" if depth <= height else f"{key}_z{band:05d}.vtk"
    files.write_file(f"{path}/files/{name}", to_vtk(points, triangles, key, "double"))
    shared = int((own[:, 0] < band * height).sum()) if band else 0
    return pa.table({"mesh_key": [key], "band": pa.array([band], pa.int32()), "file": [name], "n_points": [len(points)], "n_cells": [len(triangles)], "n_shared": [shared]})


def write_meshes(voxels: DataFrame, keys: list[str], voxel: tuple[float, float, float], mesh_key: F.Column, path: str, depth: int, band: int = BAND) -> str:
    """Writes the closed mesh of each voxel set (keys, z, y, x) below path. mesh_key: its name, from keys; depth: slices of the volume."""
    files.delete(path)
    corners = surface.quads(voxels, keys)
    placed = corners.join(by_shuffle(surface.vertices(corners, keys, voxel)), [*keys, "cz", "cy", "cx"])
    named = placed.withColumn("mesh_key", mesh_key).withColumn("band", F.expr(f"cast(greatest(z, 0) div {band} as int)"))
    made = named.groupBy("mesh_key", "band").applyInArrow(lambda t: _assemble(t, path, depth, band), INDEX)
    made.write.mode("overwrite").parquet(f"{path}/index")
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_key, band, file, n_points, n_cells, n_shared) of a mesh set; n_shared of a file's points are in the band before too."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def exists(path: str) -> bool:
    return files.read_file(f"{path}/index/_SUCCESS") is not None


def _each(index: DataFrame, path: str, out: str, change) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, shared in zip(*(c.to_pylist() for c in batch.columns)):
                data = files.read_file(f"{path}/files/{name}")
                if data is None:
                    raise FileNotFoundError(f"{path}/files/{name}")
                points, cells = from_vtk(data)
                yield change(key, points[shared:], cells)

    return index.select("mesh_key", "file", F.coalesce("n_shared", F.lit(0))).mapInArrow(run, out)


def read_sizes(index: DataFrame, path: str) -> DataFrame:
    """(mesh_key, n_points, n_cells) of whole meshes as the files have them; filter the index first, and only its files are read."""
    counted = lambda key, points, cells: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(points)], pa.int64()), pa.array([len(cells)], pa.int64())], ["mesh_key", "n_points", "n_cells"])
    return _each(index, path, "mesh_key string, n_points long, n_cells long", counted).groupBy("mesh_key").agg(F.sum("n_points").alias("n_points"), F.sum("n_cells").alias("n_cells"))


def read_points(index: DataFrame, path: str) -> DataFrame:
    """(mesh_key, vx, vy, vz): the points of the files, each once."""
    listed = lambda key, points, cells: pa.RecordBatch.from_arrays([pa.array([key] * len(points), pa.string()), *(pa.array(c.astype("f8")) for c in points.T)], ["mesh_key", "vx", "vy", "vz"])
    return _each(index, path, "mesh_key string, vx double, vy double, vz double", listed)


def skeleton_mesh_set(volume, path: str, per_part: bool = True, radius: int = 3) -> str:
    """The skeleton's meshes, made thicker by radius: one for each part and label, or for each label."""
    from lamina.operators.geometry import dilate

    keys = ["root", "label_id"] if per_part else ["label_id"]
    rooted = volume.point.join(volume.part.select("point_id", "root"), "point_id").select(*keys, "z", "y", "x")
    name = F.format_string("skeleton_cc%d_%d", "root", "label_id") if per_part else F.format_string("skeleton_%d", "label_id")
    return write_meshes(dilate(rooted, radius, keys, volume.shape), keys, volume.voxel, name, path, volume.shape[0])


def open_skeleton_meshes(volume, path: str) -> tuple[str, DataFrame, str]:
    """(mode, index, path) of the skeleton's meshes below path: by part where they are stored, else by label, else made by label now."""
    for mode in ("per_spatial_cc", "per_label"):
        if exists(f"{path}/{mode}"):
            return mode, read_index(volume.spark, f"{path}/{mode}"), f"{path}/{mode}"
    made = skeleton_mesh_set(volume, f"{path}/per_label", per_part=False)
    return "per_label", read_index(volume.spark, made), made
