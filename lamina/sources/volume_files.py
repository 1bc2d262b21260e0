"""Volume files as a data source: .npy and .tif/.tiff files become chunk arrays.

    spark.dataSource.register(VolumeFiles)
    spark.read.format("volume_files").load("/data/image.npy")

The driver reads headers alone and plans bands of the grid of cells: some slices and lines each, of
about PART_BYTES. A task reads the byte ranges of its band (of a TIFF the strips or tiles that hold its lines),
so a file may be larger than any task and 2 GiB is no limit. A folder holds slabs of one volume that
follow each other in z in natural order of their names, slab2 before slab10; they must agree in lines, columns,
channels and type. A band may span files.

Axes: a .npy array has (y, x), (z, y, x) or (z, y, x, channel) and is taken as it is. A TIFF's pages are the
slices; of samples, 3 or 4 in number and side by side or in planes, the first three are the channels.
Any other number of samples stays. Fortran-ordered arrays are read plane by plane, which reads more than a band
holds: reorder large ones. Boxes of zeros have no rows; ``describe`` has the shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.sources import arrays, files, tiff
from lamina.sources.tiff import tiff_bytes

SUFFIXES = ("npy", "tif", "tiff")
PART_BYTES = 64 << 20
KEPT_CHANNELS = 3


class Slab(NamedTuple):
    """A file's header: its size, and where its values stand."""

    path: str
    depth: int
    lines: int
    columns: int
    channels: int | None
    dtype: str
    at: int = 0
    stored: int = 1
    fortran: bool = False
    pages: tuple[tiff.Page, ...] = ()


def npy_bytes(array: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def header(path: str) -> Slab:
    """What a file holds, without its values."""
    fs, at = files.resolve(path)
    with fs.open_input_file(at) as file:
        if path.lower().endswith(".npy"):
            version = np.lib.format.read_magic(file)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            if not 2 <= len(shape) <= 4 or dtype.hasobject or dtype.kind not in "biuf":
                raise ValueError(f"a volume has 2 to 4 axes of numbers, not {shape} of {dtype}: {path}")
            z, y, x, *c = (1, *shape) if len(shape) == 2 else shape
            return Slab(path, z, y, x, c[0] if c else None, dtype.str, file.tell(), c[0] if c else 1, fortran)
        pages = tiff.read_directory(file)
        if not pages or any((p.height, p.width, p.samples, p.dtype) != (pages[0].height, pages[0].width, pages[0].samples, pages[0].dtype) for p in pages):
            raise ValueError(f"the pages of a volume have one size and type: {path}")
        first = pages[0]
        kept = first.samples if first.samples not in (3, 4) else KEPT_CHANNELS
        return Slab(path, len(pages), first.height, first.width, kept if first.samples > 1 else None, first.dtype, stored=first.samples, pages=tuple(pages))


def headers(path: str) -> list[Slab]:
    """The slabs of a file or folder in order of z."""
    found = [header(p) for p in files.listed(path, SUFFIXES)]
    for s in found[1:]:
        if (s.lines, s.columns, s.channels, np.dtype(s.dtype).newbyteorder("<")) != (found[0].lines, found[0].columns, found[0].channels, np.dtype(found[0].dtype).newbyteorder("<")):
            raise ValueError(f"slabs of one volume differ in lines, columns, channels or type: {found[0].path} and {s.path}")
    return found


def describe(path: str) -> arrays.Shape:
    """Shape, channels and type of a volume, from its headers; of an empty folder 0 x 0 x 0."""
    slabs = headers(path)
    if not slabs:
        return arrays.Shape((0, 0, 0), None, "|u1")
    first = slabs[0]
    return arrays.Shape((sum(s.depth for s in slabs), first.lines, first.columns), first.channels, np.dtype(first.dtype).newbyteorder("<").str)


def read_box(slab: Slab, z0: int, z1: int, y0: int, y1: int) -> np.ndarray:
    """(z, y, x, channel) of some slices and lines of a file, from their byte ranges."""
    fs, at = files.resolve(slab.path)
    kind, x, c = np.dtype(slab.dtype), slab.columns, slab.stored
    with fs.open_input_file(at) as file:
        if slab.pages:
            out = np.stack([tiff.read_lines(file, p, y0, y1) for p in slab.pages[z0:z1]])
            return out[..., : slab.channels or 1]

        def values(first: int, n: int) -> np.ndarray:
            file.seek(slab.at + first * kind.itemsize)
            data = file.read(n * kind.itemsize)
            if len(data) < n * kind.itemsize:
                raise ValueError(f"a file ends before its values do: {slab.path}")
            return np.frombuffer(data, kind)

        out = np.empty((z1 - z0, y1 - y0, x, c), kind)
        if slab.fortran:
            for k in range(c):
                for i in range(x):
                    plane = values(((k * x + i) * slab.lines + y0) * slab.depth, (y1 - y0) * slab.depth)
                    out[:, :, i, k] = plane.reshape(y1 - y0, slab.depth)[:, z0:z1].T
        else:
            for z in range(z0, z1):
                out[z - z0] = values((z * slab.lines + y0) * x * c, (y1 - y0) * x * c).reshape(y1 - y0, x, c)
        return out


class Band(InputPartition):
    """Lines y0 to y1 - 1 of the slices from z0 on, in parts (slab, first slice, end)."""

    def __init__(self, z0: int, y0: int, y1: int, parts: list[tuple[Slab, int, int]]):
        super().__init__(None)
        self.z0, self.y0, self.y1, self.parts = z0, y0, y1, parts


class VolumeReader(DataSourceReader):
    def __init__(self, path: str, array: str, part_bytes: int):
        self.path, self.array, self.part_bytes = path, array, part_bytes

    def partitions(self) -> Sequence[InputPartition]:
        slabs = headers(self.path)
        depth, bands = sum(s.depth for s in slabs), []
        for z0 in range(0, depth, arrays.CHUNK[0]):
            z1, parts, start = min(depth, z0 + arrays.CHUNK[0]), [], 0
            for s in slabs:
                a, b = max(z0, start), min(z1, start + s.depth)
                if a < b:
                    cut = s._replace(pages=s.pages[a - start : b - start]) if s.pages else s
                    parts.append((cut, 0 if s.pages else a - start, b - a if s.pages else b - start))
                start += s.depth
            first = slabs[0]
            line = (z1 - z0) * first.columns * first.stored * np.dtype(first.dtype).itemsize
            lines = max(1, self.part_bytes // max(1, line * arrays.CHUNK[1])) * arrays.CHUNK[1]
            bands += [Band(z0, y0, min(first.lines, y0 + lines), parts) for y0 in range(0, first.lines, lines)]
        return bands

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        if band is None or not band.parts:
            return
        box = np.concatenate([read_box(s, a, b, band.y0, band.y1) for s, a, b in band.parts])
        yield from arrays.split(self.array, (band.z0, band.y0, 0), box.astype(box.dtype.newbyteorder("<"), copy=False))


class VolumeFiles(DataSource):
    """Options: path (or the argument of load), array (a name for the rows) and partbytes."""

    @classmethod
    def name(cls) -> str:
        return "volume_files"

    def schema(self) -> str:
        return arrays.SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options["path"], self.options.get("array", ""), int(self.options.get("partbytes", PART_BYTES)))


def read_volume(spark: SparkSession, path: str, array: str = "", part_bytes: int = PART_BYTES) -> tuple[DataFrame, arrays.Shape]:
    """The chunk arrays of a file or folder of slabs, and its shape."""
    shape = describe(path)
    spark.dataSource.register(VolumeFiles)
    return spark.read.format("volume_files").option("array", array).option("partbytes", str(part_bytes)).load(path), shape


def _slab(kind: str, shape: tuple[int, ...], dtype: str, planes: Callable[[int], bool], depth: int):
    def write(rows: pa.Table) -> pa.Table:
        number = rows.column("slab")[0].as_py()
        first = number * shape[0]
        z, y, x, channel = (rows.column(c).to_numpy() for c in ("z", "y", "x", "channel"))
        array = np.zeros((min(shape[0], depth - first), *shape[1:]), dtype)
        array[(z - first, y, x) if array.ndim == 3 else (z - first, y, x, channel)] = rows.column("value").to_numpy()
        content = npy_bytes(array) if kind == "npy" else tiff_bytes(array, planes=planes(number))
        return pa.table({"name": [f"slab{number}.{kind}"], "content": pa.array([content], pa.binary())})

    return write


def write_slabs(voxels: DataFrame, path: str, slab: int, shape: arrays.Shape, kind: str = "npy", planes: Callable[[int], bool] = lambda slab: False) -> str:
    """Writes voxels (z, y, x[, channel], value) as files of ``slab`` slices each; a slab is dense in one task.

    planes: which slabs of a TIFF have their samples in planes.
    """
    channel = F.col("channel") if "channel" in voxels.columns else F.lit(0)
    size = (slab, *shape.size[1:], *([shape.channels] if shape.channels else []))
    empty = voxels.sparkSession.range(0, shape.size[0], slab).selectExpr(f"cast(id div {slab} as int) as slab", "cast(id as int) as z", "0 as y", "0 as x", "0 as channel", "0d as value")
    placed = voxels.select(F.expr(f"cast(z div {slab} as int)").alias("slab"), "z", "y", "x", channel.alias("channel"), F.col("value").cast("double").alias("value"))
    rows = empty.unionByName(placed).groupBy("slab", "z", "y", "x", "channel").agg(F.max("value").alias("value"))  # each slab has a row, so that each has a file
    made = rows.groupBy("slab").applyInArrow(_slab(kind, size, shape.dtype, planes, shape.size[0]), "name string, content binary")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(b.column(i).to_pylist() for i in range(2))):
                files.write_file(f"{path}/{name}", content)
            yield b.select(["name"])

    made.mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()
    return path
