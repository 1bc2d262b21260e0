"""Volume files, chunk arrays, Zarr stores and the preprocessing job, against numpy."""

from __future__ import annotations

import collections
import functools
import io
import json
import os
import struct
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.jobs import preprocess as job
from lamina.operators import surface
from lamina.sources import arrays, files, mesh_files, tables, tiff, volume_files, zarr


def dense(chunks, shape, channels=1) -> np.ndarray:
    out = np.zeros((*shape, channels))
    for r in chunks.collect():
        box = np.frombuffer(r.data, r.dtype).reshape(r.nz, r.ny, r.nx, r.nc)
        assert [r.cz, r.cy, r.cx] == [o // n for o, n in zip((r.z0, r.y0, r.x0), arrays.CHUNK)] and box.any()
        out[r.z0 : r.z0 + r.nz, r.y0 : r.y0 + r.ny, r.x0 : r.x0 + r.nx] = box
    return out


def sparse(rng, *shape) -> np.ndarray:
    """Values in one corner alone, so that shapes can't be told from them."""
    out = np.zeros(shape)
    out[: shape[0] // 2, : shape[1] // 2, : shape[2] // 2] = rng.integers(0, 200, [n // 2 for n in shape[:3]] + list(shape[3:]))
    return out


def lzw_encoded(data: bytes) -> bytes:
    table, out, n_bits = {bytes([i]): i for i in range(256)}, [(256, 9)], 9
    now, free = b"", 258
    for byte in data:
        longer = now + bytes([byte])
        if longer in table:
            now = longer
            continue
        out.append((table[now], n_bits))
        table[longer], free = free, free + 1
        n_bits = max(9, free.bit_length())
        now = bytes([byte])
        if free == 4094:
            out.append((256, n_bits))
            table, free, n_bits = {bytes([i]): i for i in range(256)}, 258, 9
    if now:
        out.append((table[now], n_bits))
        free += 1
    out.append((257, max(9, free.bit_length())))
    bits = "".join(format(code, f"0{n}b") for code, n in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits_encoded(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and data[at + run] == data[at] and run < 128:
            run += 1
        out += struct.pack("B", 257 - run) + data[at : at + 1] if run > 1 else b"\0" + data[at : at + 1]
        at += run
    return out


def other_tiff(volume: np.ndarray, order="<", big=False, tile=None, rows=None, packed=1, predictor=1, planes=False) -> bytes:
    """TIFF as other programs write it: either byte order, BigTIFF, tiles, several strips, LZW, PackBits, differences."""
    pack = {1: bytes, 5: lzw_encoded, 8: zlib.compress, 32773: packbits_encoded}[packed]
    word, head = ("Q", 16) if big else ("I", 8)
    out = bytearray(struct.pack(order + ("2sHHHQ" if big else "2sHI"), *([b"II" if order == "<" else b"MM", 43, 8, 0, 0] if big else [b"II" if order == "<" else b"MM", 42, 0])))
    assert len(out) == head
    link = head - struct.calcsize(word)
    for page in volume if volume.ndim == 4 else volume[..., None]:
        h, w, s = page.shape
        bh, bw = tile or (rows or h, w)
        blocks = []
        for plane in range(s) if planes else [slice(None)]:
            part = page[..., plane : plane + 1] if planes else page
            for y in range(0, h, bh):
                for x in range(0, w, bw):
                    block = part[y : y + bh, x : x + bw]
                    if tile:
                        block = np.pad(block, [(0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)])
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                    blocks.append(pack(np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order)).tobytes()))
        places = []
        for b in blocks:
            places.append(len(out))
            out += b + b"\0" * (len(b) % 2)
        fields = {256: [w], 257: [h], 258: [page.dtype.itemsize * 8] * s, 259: [packed], 277: [s], 284: [2 if planes else 1], 317: [predictor], 339: [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]]}
        fields |= {322: [bw], 323: [bh], 324: places, 325: [len(b) for b in blocks]} if tile else {278: [bh], 273: places, 279: [len(b) for b in blocks]}
        entries = b""
        for tag, values in sorted(fields.items()):
            data = struct.pack(f"{order}{len(values)}{word}", *values)
            if len(data) > struct.calcsize(word):
                at = len(out)
                out += data
                data = struct.pack(order + word, at)
            entries += struct.pack(order + "HH" + word, tag, 16 if big else 4, len(values)) + data
        at = len(out)
        out += struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + struct.pack(order + word, 0)
        struct.pack_into(order + word, out, link, at)
        link = len(out) - struct.calcsize(word)
    return bytes(out)


VARIANTS = [
    {}, {"order": ">"}, {"big": True}, {"order": ">", "big": True, "rows": 3}, {"rows": 7}, {"tile": (16, 16)}, {"tile": (16, 32), "packed": 8, "big": True},
    {"packed": 5}, {"packed": 5, "predictor": 2, "rows": 5}, {"packed": 5, "tile": (16, 16), "predictor": 2, "order": ">"}, {"packed": 32773, "rows": 4}, {"packed": 8, "predictor": 2},
]


@pytest.mark.parametrize("options", VARIANTS)
def test_tiff_variants(options):
    rng = np.random.default_rng(3)
    smooth = np.cumsum(rng.integers(0, 3, (2, 37, 41, 3)), axis=2)
    for kind in ("u1", "<u2", "<i4") + (() if options.get("predictor") else ("<f4",)):
        for channels, planes in ((1, False), (3, False), (3, True)):
            volume = smooth[..., :channels].astype(kind)
            data = io.BytesIO(other_tiff(volume if channels > 1 else volume[..., 0], planes=planes, **options))
            pages = tiff.read_directory(data)
            assert len(pages) == 2
            for y0, y1 in ((0, 37), (5, 6), (16, 33), (36, 37)):
                assert (tiff.read_lines(data, pages[1], y0, y1) == volume[1, y0:y1]).all(), (options, kind, channels, planes)


def test_lzw_over_full_tables():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaaaaa" * 50, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 60_000, dtype=np.uint8).tobytes()):
        assert tiff.lzw(lzw_encoded(data)) == data and tiff.packbits(packbits_encoded(data)) == data


def test_bad_tiffs_are_errors():
    one = np.ones((1, 4, 4), "u1")
    for bad in (b"II*", b"MM\0\x2c" + b"\0" * 8, b"nothing at all", other_tiff(one)[:-20], other_tiff(one).replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7))):
        with pytest.raises((ValueError, struct.error)):
            list(tiff.tiff_pages(bad))
    circle = bytearray(other_tiff(one))
    circle[-4:] = circle[4:8]
    with pytest.raises(ValueError, match="circle"):
        list(tiff.tiff_pages(bytes(circle)))


@pytest.mark.parametrize("kind", ["npy", "tif", "TIFF"])
def test_volumes_of_slabs_in_natural_order(spark, tmp_path, kind):
    """More than ten slabs of other depths than a chunk; shape from headers although most values are 0."""
    rng = np.random.default_rng(1)
    volume = sparse(rng, 37, 300, 270).astype("<u2")
    volume[36, 299, 269] = 7
    write = volume_files.npy_bytes if kind == "npy" else volume_files.tiff_bytes
    cuts = [0, 3, 4, 9, 10, 12, 15, 18, 22, 25, 29, 33, 37]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"slab{i}.{kind}").write_bytes(write(volume[a:b]))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for part_bytes in (1, 64 << 20):
        chunks, shape = volume_files.read_volume(spark, str(tmp_path), "name", part_bytes)
        assert shape == arrays.Shape((37, 300, 270), None, "<u2")
        assert (dense(chunks, shape.size)[..., 0] == volume).all()
    assert {(r.array, r.nc) for r in chunks.collect()} == {("name", 1)}
    bands = volume_files.VolumeReader(str(tmp_path), "", 1).partitions()
    assert len(bands) == 3 * 2 and all(0 < b.y1 - b.y0 <= 256 for b in bands) and max(sum(e - s for _, s, e in b.parts) for b in bands) <= 16


def test_npy_is_taken_as_it_is(spark, tmp_path):
    rng = np.random.default_rng(2)
    cases = {
        "flat": rng.integers(1, 9, (5, 6)).astype("u1"), "four": rng.integers(1, 9, (3, 5, 6, 4)).astype(">i2"), "second": rng.integers(1, 9, (3, 3, 5, 6)).astype("u1"),
        "floats": rng.random((3, 5, 6)).astype("f4"), "fortran": np.asfortranarray(rng.integers(1, 9, (20, 7, 6))), "fortran4": np.asfortranarray(rng.random((20, 7, 6, 2))), "mask": rng.random((3, 4, 5)) < 0.5,
    }
    for name, values in cases.items():
        np.save(tmp_path / f"{name}.npy", values)
        chunks, shape = volume_files.read_volume(spark, str(tmp_path / f"{name}.npy"))
        whole = values[None] if values.ndim == 2 else values
        assert shape.size == whole.shape[:3] and shape.channels == (whole.shape[3] if whole.ndim == 4 else None) and np.dtype(shape.dtype).kind == values.dtype.kind
        assert (dense(chunks, shape.size, shape.channels or 1) == (whole if whole.ndim == 4 else whole[..., None])).all()


def test_tiff_channels(spark, tmp_path):
    rng = np.random.default_rng(2)
    for samples, kept in ((2, 2), (3, 3), (4, 3), (5, 5)):
        values = rng.integers(1, 99, (3, 5, 6, samples)).astype("u1")
        for planes in (False, True):
            path = tmp_path / f"c{samples}{planes}.tif"
            path.write_bytes(volume_files.tiff_bytes(values, planes=planes))
            chunks, shape = volume_files.read_volume(spark, str(path))
            assert shape.channels == kept and (dense(chunks, (3, 5, 6), kept) == values[..., :kept]).all()


def test_files_that_cannot_be_volumes(spark, tmp_path):
    (tmp_path / "a.npy").write_bytes(volume_files.npy_bytes(np.ones((2, 3, 4), "u1")))
    (tmp_path / "b.npy").write_bytes(volume_files.npy_bytes(np.ones((2, 3, 5), "u1")))
    with pytest.raises(ValueError, match="differ in lines"):
        volume_files.describe(str(tmp_path))
    (tmp_path / "b.npy").write_bytes(volume_files.npy_bytes(np.ones((2, 3, 4), "u1"))[:-5])
    assert volume_files.describe(str(tmp_path)).size == (4, 3, 4)
    with pytest.raises(Exception, match="ends before its values do"):
        volume_files.read_volume(spark, str(tmp_path))[0].collect()
    (tmp_path / "v.png").write_bytes(b"x")
    with pytest.raises(ValueError, match="no reader for .png"):
        volume_files.describe(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        volume_files.describe(str(tmp_path / "none"))
    os.mkdir(tmp_path / "empty")
    chunks, shape = volume_files.read_volume(spark, str(tmp_path / "empty"))
    assert shape.size == (0, 0, 0) and chunks.collect() == []


def test_addresses_resolve():
    for path in ("/a/b", "file:/a/b", "file:///a/b"):
        assert files.resolve(path)[1] == "/a/b"
    assert sorted(["s10", "s2", "s1"], key=files.natural) == ["s1", "s2", "s10"]


def chunked(spark, values: np.ndarray):
    """Chunk arrays of (z, y, x, channel) by a file."""
    import tempfile

    path = tempfile.mkdtemp(prefix="arrays-") + "/v.npy"
    np.save(path, values)
    return volume_files.read_volume(spark, path)


def blocks(values: np.ndarray, f: int) -> np.ndarray:
    padded = np.pad(values, [*((0, -n % f) for n in values.shape[:3]), (0, 0)])
    z, y, x, c = padded.shape
    return padded.reshape(z // f, f, y // f, f, x // f, f, c).astype("f8").mean(axis=(1, 3, 5))


@pytest.mark.parametrize(("dtype", "kept"), [("u1", "|u1"), ("<u2", "<u2"), ("<f4", "<f4"), ("<i4", "<f8"), ("<f8", "<f8")])
def test_block_means_by_channel(spark, dtype, kept):
    rng = np.random.default_rng(5)
    values = (sparse(rng, 35, 290, 33, 3) * (1 if dtype[-2] == "u" else 1.25)).astype(dtype)
    chunks, shape = chunked(spark, values)
    for f in (2, 3, 5):
        made, size = arrays.block_mean(chunks, f, shape)
        wanted = blocks(values, f).astype(kept)
        assert size == arrays.Shape(wanted.shape[:3], 3, kept)
        assert np.allclose(dense(made, size.size, 3), wanted, rtol=1e-6) and (np.dtype(kept).kind == "f" or (dense(made, size.size, 3) == wanted).all())


def test_pyramids_stop_and_strides(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 255, (40, 70, 50, 1)).astype("u1")
    chunks, shape = chunked(spark, values[..., 0])
    keep = lambda df, name: df
    levels = arrays.pyramid(chunks, 5, shape, keep)
    assert [s.size for _, s in levels] == [(40, 70, 50), (20, 35, 25)]
    direct = arrays.pyramid(chunks, 3, shape, keep, least_side=4, progressive=False)
    assert (dense(direct[2][0], direct[2][1].size) == blocks(values, 4).astype("u1")).all()
    for f in (2, 3, 4):
        made, size = arrays.stride(chunks, f, shape)
        assert (dense(made, size.size) == values[::f, ::f, ::f]).all()
    cut = dense(arrays.truncated(chunks, 33), (40, 70, 50))
    assert (cut[:33] == values[:33]).all() and not cut[33:].any()


def test_pyramid_keeps_held_voxels_of_value_zero(spark):
    rows = [(0, 0, 0, 0), (0, 0, 1, 9), (5, 7, 6, 3), (17, 40, 30, 0), (39, 69, 49, 255)]
    shape = arrays.Shape((40, 70, 50), 2, "|u1")
    chunks = arrays.from_voxels(spark.createDataFrame(rows, "z int, y int, x int, value int"), shape, held=True)
    levels = arrays.pyramid(chunks, 3, shape, lambda df, name: df, 4, functools.partial(arrays.block_mean, held=True))
    wanted = {r[:3]: r[3] for r in rows}
    for made, _ in levels:
        assert {(r.z, r.y, r.x): r.value for r in arrays.to_voxels(made, held=True).collect()} == wanted
        sums = collections.Counter()
        for (z, y, x), value in wanted.items():
            sums[z // 2, y // 2, x // 2] += value
        wanted = {place: total // 8 for place, total in sums.items()}


def test_upsample_then_stride_is_the_mask(spark):
    rng = np.random.default_rng(7)
    values = sparse(rng, 11, 90, 70).astype("<u2")
    chunks, shape = chunked(spark, values)
    size = (43, 360, 271)
    grown = dense(arrays.upsample(chunks, 4, size), size)[..., 0]
    assert (grown == np.repeat(np.repeat(np.repeat(values, 4, 0), 4, 1), 4, 2)[:43, :360, :271]).all()
    back, _ = arrays.stride(arrays.upsample(chunks, 4, (44, 360, 280)), 4, arrays.Shape((44, 360, 280), None, "<u2"))
    assert (dense(back, shape.size)[..., 0] == values).all()


def test_voxels_and_label_masks(spark):
    rng = np.random.default_rng(8)
    values = sparse(rng, 20, 30, 40).astype("<u2") % 4
    chunks, shape = chunked(spark, values)
    voxels = arrays.to_voxels(chunks)
    assert voxels.count() == (values > 0).sum()
    assert (dense(arrays.from_voxels(voxels, shape), shape.size)[..., 0] == values).all()
    assert sorted(r.value for r in arrays.values_of(chunks).collect()) == [1, 2, 3]
    masks = arrays.label_masks(chunks)
    for label in (1, 2, 3):
        assert (dense(masks.where(F.col("array") == str(label)), shape.size)[..., 0] == (values == label)).all()


def test_zarr_round_trip_and_metadata(spark, tmp_path):
    rng = np.random.default_rng(9)
    image, labels = sparse(rng, 37, 300, 270, 3).astype("u1"), sparse(rng, 37, 300, 270).astype("<u2")
    (a, image_shape), (b, label_shape) = chunked(spark, image), chunked(spark, labels)
    path = str(tmp_path / "store.zarr")
    for _ in range(2):  # a store is replaced
        zarr.write_store({"0": (a, image_shape), "10": (a, image_shape), "2": (a, image_shape), "segmentation/0": (b, label_shape)}, path, {"": zarr.multiscales(["0", "2", "10"], image_shape, (2.0, 1.0, 0.5))})
    meta = json.loads((tmp_path / "store.zarr/0/.zarray").read_text())
    assert meta["shape"] == [37, 300, 270, 3] and meta["chunks"] == [16, 256, 256, 3] and meta["compressor"] == {"id": "zlib", "level": 5} and meta["zarr_format"] == 2
    raw = np.frombuffer(zlib.decompress((tmp_path / "store.zarr/0/0.0.0.0").read_bytes()), "u1").reshape(16, 256, 256, 3)
    assert (raw == image[:16, :256, :256]).all() and not (tmp_path / "store.zarr/0/2.1.1.0").exists()
    assert zarr.members(path) == ["0", "2", "10"] and zarr.members(path, "segmentation") == ["0"]
    scales = zarr.open_group(path)["multiscales"][0]
    assert [d["path"] for d in scales["datasets"]] == ["0", "2", "10"] and scales["datasets"][1]["coordinateTransformations"][0]["scale"] == [4.0, 2.0, 1.0, 1.0] and len(scales["axes"]) == 4
    assert (dense(zarr.read_arrays(spark, path, ["0"]), image.shape[:3], 3) == image).all()
    assert (dense(zarr.read_arrays(spark, path, ["segmentation/0"]), labels.shape)[..., 0] == labels).all()
    some = dense(zarr.read_arrays(spark, path, ["segmentation/0"], z=(10, 18)), labels.shape)[..., 0]
    assert (some[10:18] == labels[10:18]).all() and not some[:10].any() and not some[18:].any()
    assert len(zarr.ZarrReader(path, ["segmentation/0"], (10, 16)).partitions()[0].cells) == 4
    assert [(r.level, r.nz, r.channels, r.dtype) for r in zarr.levels(spark, path).collect()] == [(0, 37, 3, "|u1"), (2, 37, 3, "|u1"), (10, 37, 3, "|u1")]


def test_zarr_stores_of_others(spark, tmp_path):
    """Other chunk sizes, codecs, separators, a fill value; what can't be decoded is an error that names it."""
    import gzip

    import zstandard

    values = np.arange(5 * 6 * 7).reshape(5, 6, 7).astype("<i2")
    codecs = {"zstd": zstandard.ZstdCompressor().compress, "gzip": gzip.compress, None: bytes}
    for codec, pack in codecs.items():
        at = tmp_path / str(codec)
        os.makedirs(at / "0" / "0" / "1")
        (at / ".zgroup").write_text('{"zarr_format": 2}')
        (at / "0/.zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 6, 7], "chunks": [3, 6, 4], "dtype": "<i2", "compressor": {"id": codec} if codec else None, "fill_value": 9, "order": "C", "filters": None, "dimension_separator": "/"}))
        os.makedirs(at / "0/0/0")
        (at / "0/0/0/0").write_bytes(pack(np.ascontiguousarray(values[:3, :, :4]).tobytes()))
        found = {}
        for r in arrays.to_voxels(zarr.read_arrays(spark, str(at), ["0"])).collect():
            found[r.z, r.y, r.x] = r.value
        assert all(found.get((z, y, x), 0) == (values[z, y, x] if z < 3 and x < 4 else 9) for z in range(5) for y in range(6) for x in range(7))
    meta = json.loads((at / "0/.zarray").read_text()) | {"compressor": {"id": "blosc"}}
    (at / "0/.zarray").write_text(json.dumps(meta))
    with pytest.raises(Exception, match="blosc"):
        zarr.read_arrays(spark, str(at), ["0"]).collect()


def test_a_failed_level_fails_the_job_and_leaves_no_store(spark, tmp_path):
    good, shape = chunked(spark, np.ones((20, 4, 4), "u1"))
    bad = arrays.mapped(good, lambda array, origin, values: (_ for _ in ()).throw(RuntimeError("lost")) if origin[0] else iter([arrays.batch([arrays.row(array, origin, values)])]))
    path = str(tmp_path / "store.zarr")
    zarr.write_store({"0": (good, shape)}, path, {})
    with pytest.raises(Exception, match="lost"):
        zarr.write_store({"0": (good, shape), "1": (bad, shape)}, path, {})
    with pytest.raises(FileNotFoundError):
        zarr.read_arrays(spark, path, ["0"])
    with pytest.raises(Exception, match="isn't a chunk"):
        zarr.write_store({"0": (good, arrays.Shape((21, 4, 4), None, "|u1"))}, path, {})


def masks_of(tmp_path, rng, size=(6, 20, 20)) -> dict[int, np.ndarray]:
    """Sparse masks, in a corner of their files."""
    masks = {1: np.zeros(size, bool), 2: np.zeros(size, bool)}
    masks[1][1:4, 2:9, 3:11] = rng.random((3, 7, 8)) < 0.6
    masks[2][1:3, 1:4, 1:5] = True
    for i, m in masks.items():
        (tmp_path / f"outer{i}.tif").write_bytes(volume_files.tiff_bytes(m.astype("u1") * 255))
    return masks


def test_preprocess_job_on_an_rgb_file(spark, tmp_path):
    rng = np.random.default_rng(4)
    masks = masks_of(tmp_path, rng)
    dots = masks[1] & (rng.random((6, 20, 20)) < 0.3)
    (tmp_path / "skel.npy").write_bytes(volume_files.npy_bytes(dots.astype("u1")))
    image = rng.integers(0, 255, (70, 80, 80, 3)).astype("u1")[:24]
    (tmp_path / "image.tif").write_bytes(volume_files.tiff_bytes(image))
    out = str(tmp_path / "out")
    volume = job.preprocess(spark, out, {i: str(tmp_path / f"outer{i}.tif") for i in masks}, skeleton=str(tmp_path / "skel.npy"), image=str(tmp_path / "image.tif"), labels=((1, "Benign", "#10B981"),), voxel=(2.0, 1.0, 1.0))
    assert volume.shape == (6, 20, 20)
    bodies = spark.read.parquet(f"{out}/body").join(spark.read.parquet(f"{out}/contour"), ["label_id", "z", "cc_id"])
    sizes = {r.label_id: r.n for r in bodies.groupBy("label_id").agg(F.sum("area").alias("n")).collect()}
    assert sizes == {i: int(m.sum()) for i, m in masks.items()}
    rows = tables.read_metadata(spark, f"{out}/metadata.json").collect()
    assert {(r.label_id, r.name, r.nz, r.ny, r.nx) for r in rows} == {(1, "Benign", 6, 20, 20), (2, "Label_2", 6, 20, 20)}
    assert tables.read_points(spark, f"{out}/skeleton_points.json").count() == spark.read.parquet(f"{out}/point").count() == dots.sum()
    store = f"{out}/store.zarr"
    assert (dense(zarr.read_arrays(spark, store, ["0"]), (24, 80, 80), 3) == image).all()
    combined = np.where(masks[2], 2, masks[1])
    grown = combined.repeat(4, 0).repeat(4, 1).repeat(4, 2)
    assert (dense(zarr.read_arrays(spark, store, ["segmentation/0"]), (24, 80, 80))[..., 0] == grown).all()
    assert zarr.members(store, "outer_masks_L2") == ["Benign", "Label_2"]
    for kind in ("morphology_meshes", "image_host_meshes", "skeleton_meshes/per_spatial_cc"):
        index = mesh_files.read_index(spark, f"{out}/{kind}")
        assert {(r.mesh_key, r.n_points, r.n_cells) for r in mesh_files.read_sizes(index, f"{out}/{kind}").collect()} == {(r.mesh_key, r.n_points, r.n_cells) for r in index.collect()} != set()
    assert (dense(zarr.read_arrays(spark, store, ["outer_masks_L2/Benign"]), (6, 20, 20))[..., 0] == masks[1]).all()
    with pytest.raises(ValueError):
        job.preprocess(spark, out)
    thin = job.preprocess(spark, out, {2: str(tmp_path / "outer2.tif")}, skeleton=str(tmp_path / "outer2.tif"), target_points=5)
    assert 0 < thin.skel.count() < masks[2].sum()


def test_preprocess_job_on_a_label_volume_and_a_float_image(spark, tmp_path):
    rng = np.random.default_rng(5)
    labels = np.zeros((10, 20, 20), "<u2")
    labels[2:5, 3:9, 4:9], labels[2:4, 12:15, 12:15], labels[7, 1, 1] = 3, 7, 300
    (tmp_path / "labels.tif").write_bytes(volume_files.tiff_bytes(labels))
    image = rng.random((40, 80, 80)).astype("f4")
    np.save(tmp_path / "image.npy", image)
    out = str(tmp_path / "out")
    job.main(["--labels", str(tmp_path / "labels.tif"), "--image", str(tmp_path / "image.npy"), "--out", out, "--name", "7=Seven"])
    store = f"{out}/store.zarr"
    assert zarr.members(store, "outer_masks_L2") == ["Label_3", "Label_300", "Seven"]
    levels = zarr.levels(spark, store).collect()
    assert [(r.level, r.nz, r.dtype) for r in levels] == [(0, 40, "<f4"), (1, 20, "<f4")]
    assert np.allclose(dense(zarr.read_arrays(spark, store, ["1"]), (20, 40, 40)), blocks(image[..., None], 2), rtol=1e-6)
    areas = {r.label_id: r.n for r in spark.read.parquet(f"{out}/contour").groupBy("label_id").agg(F.sum("area").alias("n")).collect()}
    assert areas == {int(v): int((labels == v).sum()) for v in (3, 7, 300)}


def test_masks_must_agree_and_images_are_checked(spark, tmp_path):
    rng = np.random.default_rng(6)
    masks_of(tmp_path, rng)
    (tmp_path / "outer2.tif").write_bytes(volume_files.tiff_bytes(np.ones((6, 20, 21), "u1")))
    with pytest.raises(ValueError, match="one size"):
        job.preprocess(spark, str(tmp_path / "out"), {i: str(tmp_path / f"outer{i}.tif") for i in (1, 2)})
    (tmp_path / "image.tif").write_bytes(volume_files.tiff_bytes(np.ones((20, 80, 80), "u1")))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        job.preprocess(spark, str(tmp_path / "out"), {1: str(tmp_path / "outer1.tif")}, image=str(tmp_path / "image.tif"))
    assert any("by 4 isn't the masks'" in str(w.message) for w in seen)


def test_vtk_files_round_trip_and_bad_ones():
    points, cells = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 2.5]]), np.array([[0, 1, 2], [0, 3, 1]])
    data = mesh_files.to_vtk(points, cells, "a mesh")
    again = mesh_files.from_vtk(data)
    assert (again[0] == points).all() and (again[1] == cells).all() and data.startswith(b"# vtk DataFile Version 3.0\na mesh\nBINARY\nDATASET POLYDATA\nPOINTS 4 float\n")
    assert len(mesh_files.from_vtk(mesh_files.to_vtk(points[:0], cells[:0]))[0]) == 0
    for bad in (b"", data[:60], data[:-10], data.replace(b"BINARY", b"ASCII"), data.replace(b"POLYGONS 2 8", b"POLYGONS 2 9")):
        with pytest.raises(ValueError):
            mesh_files.from_vtk(bad)


@pytest.mark.parametrize("band", [256, 3])
def test_meshes_face_outwards_and_enclose_their_voxels(spark, tmp_path, band):
    """The volume inside a mesh, by its signed triangles, is about that of its voxels, in any number of bands."""
    ball = [(z, y, x) for z in range(9) for y in range(9) for x in range(9) if (z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2 <= 16]
    voxels = [(1, *v) for v in ball] + [(2, 0, 0, 0)]
    df = spark.createDataFrame(voxels, "label_id int, z int, y int, x int")
    path = str(tmp_path / "meshes")
    mesh_files.write_meshes(df, ["label_id"], (2.0, 1.0, 0.5), F.format_string("outer_%d", "label_id"), path, 9, band)
    index = mesh_files.read_index(spark, path)
    rows = {r.file: r for r in index.collect()}
    assert ("outer_1.vtk" in rows) == (band == 256) and (band == 256 or {"outer_1_z00000.vtk", "outer_1_z00002.vtk", "outer_2_z00000.vtk"} <= set(rows))
    inside = {1: 0.0, 2: 0.0}
    for name, r in rows.items():
        points, cells = mesh_files.from_vtk((tmp_path / "meshes/files" / name).read_bytes())
        assert (len(points), len(cells)) == (r.n_points, r.n_cells)
        a, b, c = (points[cells[:, i]].astype("f8") for i in range(3))
        inside[int(name[6])] += float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)
    assert 0.75 * len(ball) <= inside[1] <= 1.0 * len(ball) and 0 < inside[2] < 1
    chosen = mesh_files.read_sizes(index.where("mesh_key = 'outer_2'"), path).collect()
    assert [(r.mesh_key, r.n_points, r.n_cells) for r in chosen] == [("outer_2", 8, 12)]
    assert mesh_files.exists(path) and not mesh_files.exists(str(tmp_path))
    os.remove(tmp_path / "meshes/files" / next(n for n in rows if n.startswith("outer_2")))
    with pytest.raises(Exception, match="FileNotFoundError"):
        mesh_files.read_sizes(index, path).collect()


def test_a_mesh_in_bands_counts_as_one_and_far_down_too(spark, tmp_path):
    """Sizes and points are those of the mesh in one file, whatever its bands cut through, and exact far from the origin."""
    rng = np.random.default_rng(4)
    solid = {(1, *map(int, v)) for v in np.argwhere(rng.random((11, 5, 5)) < 0.6)} | {(2, z, 1, 1) for z in (2, 3, 7)}
    for far in (0, 23_000):
        df = spark.createDataFrame([(k, z + far, y, x) for k, z, y, x in sorted(solid)], "label_id int, z int, y int, x int")
        found = {}
        for band in (256, 1, 3, 4) if not far else (256, 100_000):
            path = str(tmp_path / f"meshes{far}_{band}")
            mesh_files.write_meshes(df, ["label_id"], (2.0, 1.0, 0.5), F.format_string("outer_%d", "label_id"), path, 11 + far, band)
            index = mesh_files.read_index(spark, path)
            sizes = sorted(map(tuple, mesh_files.read_sizes(index, path).collect()))
            found[band] = (sizes, sorted(map(tuple, mesh_files.read_points(index, path).collect())))
            assert [s[0] for s in sizes] == ["outer_1", "outer_2"]
        corners = surface.quads(df, ["label_id"])
        wanted = sorted((f"outer_{r.label_id}", r.vx, r.vy, r.vz) for r in surface.vertices(corners, ["label_id"], (2.0, 1.0, 0.5)).collect())
        assert all(f[0] == found[256][0] and f[1] == wanted for f in found.values())
