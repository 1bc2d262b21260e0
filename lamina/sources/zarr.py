"""Zarr stores (version 2) as a data source: chunk arrays in and out, with OME multiscales metadata.

Writing: each task compresses its rows, cells of the grid, and writes one file for each. Array and group
metadata are written when all tasks are done, the root's last; a task that fails fails the job, and its
chunks go. A store without a root group can't be opened, so half a store is never read.
Chunks are min(16, nz) x min(256, ny) x min(256, nx) [x channels], zlib level 5; cells of zeros have no file.

Reading: the driver reads metadata and plans groups of chunks; a missing chunk is the fill value. Readable
are little-endian or single-byte types in C order without filters, plain or by zlib, gzip, bz2 or zstd.
Blosc, which some stores use, has no decoder here and is an error that names it.
"""

from __future__ import annotations

import bz2
import gzip
import itertools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lamina.sources import arrays, files

LEVEL = 5
#: Chunks of a reading task.
TASK_CHUNKS = 32


def chunk_of(shape: arrays.Shape) -> tuple[int, ...]:
    size = tuple(max(1, min(n, s)) for n, s in zip(arrays.CHUNK, shape.size))
    return size if shape.channels is None else (*size, shape.channels)


def array_metadata(shape: arrays.Shape) -> dict:
    full = shape.size if shape.channels is None else (*shape.size, shape.channels)
    return {
        "zarr_format": 2, "shape": list(full), "chunks": list(chunk_of(shape)), "dtype": np.dtype(shape.dtype).str, "compressor": {"id": "zlib", "level": LEVEL},
        "fill_value": 0, "order": "C", "filters": None, "dimension_separator": ".",
    }


def multiscales(paths: list[str], shape: arrays.Shape, voxel: tuple[float, float, float]) -> dict:
    """OME metadata, version 0.4, of levels that halve along z, y and x."""
    channel = [{"name": "c", "type": "channel"}] if shape.channels else []
    axes = [{"name": c, "type": "space", "unit": "micrometer"} for c in "zyx"] + channel
    scale = lambda i: [v * 2**i for v in voxel] + [1.0] * len(channel)
    datasets = [{"path": p, "coordinateTransformations": [{"type": "scale", "scale": scale(i)}]} for i, p in enumerate(paths)]
    return {"multiscales": [{"version": "0.4", "axes": axes, "datasets": datasets}]}


class Done(WriterCommitMessage):
    def __init__(self, chunks: int):
        self.chunks = chunks


class ZarrWriter(DataSourceArrowWriter):
    def __init__(self, path: str, plan: dict):
        self.path, self.plan = path, plan

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        n = 0
        for array, origin, values in arrays.opened(iterator):
            meta = self.plan["arrays"].get(array)
            if meta is None:
                raise ValueError(f"the store has no array named {array}")
            size, chunk = meta["shape"], meta["chunks"]
            full = values if len(size) == 4 else values[..., 0]
            wanted = tuple(min(c, s - o) for c, s, o in zip(chunk, size, (*origin, 0)))
            if any(o % c for o, c in zip(origin, chunk)) or full.shape != wanted or full.dtype != np.dtype(meta["dtype"]):
                raise ValueError(f"a box {full.shape} of {full.dtype} at {origin} isn't a chunk of array {array}, {meta}")
            padded = np.zeros(chunk, meta["dtype"])
            padded[tuple(slice(s) for s in full.shape)] = full
            key = ".".join(str(o // c) for o, c in zip((*origin, 0), chunk))
            files.write_file(f"{self.path}/{array}/{key}", zlib.compress(padded.tobytes(), LEVEL))
            n += 1
        return Done(n)

    def commit(self, messages: list) -> None:
        put = lambda name, value: files.write_file(f"{self.path}/{name}", json.dumps(value, indent=2).encode())
        groups = {"/".join(p[:i]) for p in (name.split("/") for name in self.plan["arrays"]) for i in range(1, len(p))}
        for name, meta in self.plan["arrays"].items():
            put(f"{name}/.zarray", meta)
        for name in sorted(groups | {""}, reverse=True):  # the root comes last
            at = f"{name}/" if name else ""
            if name in self.plan["attributes"]:
                put(f"{at}.zattrs", self.plan["attributes"][name])
            put(f"{at}.zgroup", {"zarr_format": 2})

    def abort(self, messages: list) -> None:
        files.delete(self.path)


def _decoded(meta: dict, data: bytes) -> np.ndarray:
    codec = (meta.get("compressor") or {"id": None})["id"]
    if codec == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data)
    else:
        data = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress}[codec](data)
    return np.frombuffer(data, meta["dtype"]).reshape(meta["chunks"])


def _metadata(path: str, name: str) -> dict:
    data = files.read_file(f"{path}/{name}/.zarray")
    if data is None:
        raise FileNotFoundError(f"no array {name} in {path}")
    meta = json.loads(data)
    codec = (meta.get("compressor") or {"id": None})["id"]
    if meta["order"] != "C" or meta.get("filters") or codec not in (None, "zlib", "gzip", "bz2", "zstd") or not 3 <= len(meta["shape"]) <= 4:
        raise ValueError(f"array {name}: order {meta['order']}, filters {meta.get('filters')}, codec {codec}, shape {meta['shape']} can't be read")
    return meta


class Chunks(InputPartition):
    def __init__(self, array: str, meta: dict, cells: list[tuple[int, ...]]):
        super().__init__(None)
        self.array, self.meta, self.cells = array, meta, cells


class ZarrReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], z: tuple[int, int] | None):
        self.path, self.names, self.z = path, names, z

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for name in self.names:
            meta = _metadata(self.path, name)
            grid = [range(-(-s // c)) for s, c in zip(meta["shape"], meta["chunks"])]
            if self.z is not None:
                grid[0] = range(max(0, self.z[0]) // meta["chunks"][0], min(len(grid[0]), -(-self.z[1] // meta["chunks"][0])))
            cells = itertools.product(*grid)
            while part := list(itertools.islice(cells, TASK_CHUNKS)):
                out.append(Chunks(name, meta, part))
        return out

    def read(self, part: Chunks) -> Iterator[pa.RecordBatch]:
        if part is None or not part.cells:
            return
        meta, separator = part.meta, part.meta.get("dimension_separator", ".")
        for cell in part.cells:
            data = files.read_file(f"{self.path}/{part.array}/{separator.join(map(str, cell))}")
            fill = meta["fill_value"] or 0
            if data is None and not fill:
                continue
            values = np.full(meta["chunks"], fill, meta["dtype"]) if data is None else _decoded(meta, data)
            start = [c * n for c, n in zip(cell, meta["chunks"])]
            values = values[tuple(slice(0, min(n, s - o)) for n, s, o in zip(meta["chunks"], meta["shape"], start))]
            if values.ndim == 3:
                values = values[..., None]
            elif start[3]:
                raise ValueError("the channels of a chunk must be whole")
            if self.z is not None:
                a, b = max(self.z[0] - start[0], 0), self.z[1] - start[0]
                values, start[0] = values[a:b], start[0] + a
            if values.size and values.any():
                yield arrays.batch([arrays.row(part.array, tuple(start[:3]), values)])


class ZarrStore(DataSource):
    """Options: path, arrays (names with commas, for reading), zfrom and zend (slices), plan (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "zarr_store"

    def schema(self) -> str:
        return arrays.SCHEMA

    def reader(self, schema) -> ZarrReader:
        z = (int(self.options["zfrom"]), int(self.options["zend"])) if "zfrom" in self.options else None
        return ZarrReader(self.options["path"], [n for n in self.options.get("arrays", "").split(",") if n], z)

    def writer(self, schema, overwrite: bool) -> ZarrWriter:
        files.delete(self.options["path"])  # a store is replaced as a whole
        return ZarrWriter(self.options["path"], json.loads(self.options["plan"]))


def write_store(parts: dict[str, tuple[DataFrame, arrays.Shape]], path: str, attributes: dict[str, dict]) -> str:
    """Writes named arrays as one store, in one job. attributes: by group, '' the root."""
    spark, rows = None, None
    for name, (chunks, _) in parts.items():
        spark, one = chunks.sparkSession, arrays.named(chunks, name)
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("a store needs an array")
    plan = {"arrays": {name: array_metadata(shape) for name, (_, shape) in parts.items()}, "attributes": attributes}
    spark.dataSource.register(ZarrStore)
    rows.write.format("zarr_store").option("plan", json.dumps(plan)).mode("overwrite").save(path)
    return path


def read_arrays(spark: SparkSession, path: str, names: list[str], z: tuple[int, int] | None = None) -> DataFrame:
    """Chunk arrays of some of a store's arrays, and of slices z[0] to z[1] - 1 alone; only their chunks are read."""
    open_group(path)
    spark.dataSource.register(ZarrStore)
    read = spark.read.format("zarr_store").option("arrays", ",".join(names))
    if z is not None:
        read = read.option("zfrom", str(z[0])).option("zend", str(z[1]))
    return read.load(path)


def shape_of(path: str, name: str) -> arrays.Shape:
    meta = _metadata(path, name)
    return arrays.Shape(tuple(meta["shape"][:3]), meta["shape"][3] if len(meta["shape"]) == 4 else None, np.dtype(meta["dtype"]).str)


def open_group(path: str, group: str = "") -> dict:
    """A group's attributes; an error where the store, or the group, isn't whole."""
    at = f"{path}/{group}/" if group else f"{path}/"
    if files.read_file(f"{path}/.zgroup") is None or files.read_file(f"{at}.zgroup") is None:
        raise FileNotFoundError(f"no Zarr group at {at}")
    return json.loads(files.read_file(f"{at}.zattrs") or b"{}")


def members(path: str, group: str = "") -> list[str]:
    """The arrays of a group by name; numbers, the levels, in order first."""
    fs, at = files.resolve(f"{path}/{group}" if group else path)
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.Directory and fs.get_file_info(f"{i.path}/.zarray").is_file]
    return sorted(found, key=lambda n: (not n.isdigit(), int(n) if n.isdigit() else 0, n))


def levels(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """(level, n_chunks, nz, ny, nx, channels, dtype) of a group's levels in order, as their metadata has them."""
    open_group(path, group)
    rows = []
    for name in (n for n in members(path, group) if n.isdigit()):
        full = f"{group}/{name}" if group else name
        shape, chunk = shape_of(path, full), chunk_of(shape_of(path, full))
        rows.append((int(name), int(np.prod([-(-s // c) for s, c in zip(shape.size, chunk)])), *shape.size, shape.channels, shape.dtype))
    return spark.createDataFrame(rows, "level int, n_chunks int, nz int, ny int, nx int, channels int, dtype string")
