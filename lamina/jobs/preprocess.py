"""The preprocessing job: volume files in, a Zarr store and derived tables out.

Run it with the script beside the package (see README):

    spark-submit --conf spark.checkpoint.dir=/shared/checkpoints --py-files lamina.zip preprocess_volume.py \\
        --outer 1=/data/benign.tif --outer 2=/data/hgpin.tif --inner 1=/data/benign_in.tif \\
        --skeleton /data/skeleton.tif --image /data/image.npy --out /shared/case1

A path names a file, or a folder of slabs that follow each other in z in natural order of their names.
Masks are given one for each label, or all as one label volume (--labels): 0 is background, every other value a label.
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import colors
from lamina.operators import thinning
from lamina.operators.volume_tables import Volume
from lamina.session import Workspace, build_session
from lamina.sources import arrays, mesh_files, tables, volume_files, zarr

#: Factor between the levels of the masks and of the image, and the most levels of a pyramid.
FACTOR, LEVELS = 4, 4
#: Skeleton voxels beyond which a skeleton is thinned.
TARGET_POINTS = 50_000
#: Voxels that a body's mesh is made from.
LEAST_BODY = 10

Part = tuple[DataFrame, arrays.Shape]


def _masks(spark: SparkSession, paths: dict[int, str]) -> dict[int, Part]:
    """A mask of 0 and 1 for each label; any value but 0 counts."""
    out = {}
    for label_id, path in paths.items():
        chunks, shape = volume_files.read_volume(spark, path)
        ones = lambda array, origin, values: iter([arrays.batch([arrays.row(array, origin, values.any(axis=3, keepdims=True).astype("u1"))])])
        out[label_id] = arrays.mapped(chunks, ones), arrays.Shape(shape.size, None, "|u1")
    return out


def _split_labels(spark: SparkSession, path: str, work: Workspace) -> dict[int, Part]:
    """The masks of a label volume."""
    chunks, shape = volume_files.read_volume(spark, path)
    masks = work.keep(arrays.label_masks(chunks), "label_masks")
    values = sorted(int(r.array) for r in masks.select("array").distinct().collect())  # the labels
    return {v: (masks.where(F.col("array") == str(v)), arrays.Shape(shape.size, None, "|u1")) for v in values}


def _voxels(parts: dict[int, Part]) -> DataFrame | None:
    out = None
    for label_id, (chunks, _) in parts.items():
        one = arrays.to_voxels(chunks).select(F.lit(label_id).alias("label_id"), "z", "y", "x")
        out = one if out is None else out.unionByName(one)
    return out


def _sizes(parts: list[tuple[str, arrays.Shape]]) -> tuple[int, int, int]:
    """The one size that all masks have."""
    name, first = parts[0]
    for other, shape in parts[1:]:
        if shape.size != first.size:
            raise ValueError(f"{name} has {first.size} voxels and {other} {shape.size}: masks of one volume have one size")
    return first.size


def preprocess(
    spark: SparkSession, out: str, outer: dict[int, str] | None = None, inner: dict[int, str] | None = None, skeleton: str | None = None, image: str | None = None,
    labels: tuple = (), voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), levels: int = LEVELS, label_volume: str | None = None, target_points: int = TARGET_POINTS,
) -> Volume:
    """Reads the files, writes everything below ``out`` and returns the volume over what it read.

    labels: (label_id, name, colour or None); labels without a row are named Label_<id>, those
    without a colour get one. An inner mask may be missing for any label. The volume's shape is that of
    the mask files; masks that differ in it are an error, an image that isn't FACTOR times as large a warning.
    A skeleton of more than ``target_points`` voxels is thinned to curves first.
    """
    if bool(outer) == bool(label_volume):
        raise ValueError("a volume needs outer masks, or one label volume")
    work = Workspace(spark, "preprocess")
    outers = _masks(spark, outer) if outer else _split_labels(spark, label_volume, work)
    inners = _masks(spark, inner or {})
    if not outers:
        raise ValueError(f"no label in {label_volume}")
    size = _sizes([(f"outer mask {i}", s) for i, (_, s) in outers.items()] + [(f"inner mask {i}", s) for i, (_, s) in inners.items()])
    named = {i: (i, n, c) for i, n, c in labels}
    dim = spark.createDataFrame([named.get(i, (i, f"Label_{i}", None)) for i in sorted(outers)], "label_id int, name string, color string")
    dim = tuple(tuple(r) for r in colors.assign_colors(dim).orderBy("label_id").collect())  # the label table
    names = {i: n for i, n, _ in dim}
    dots = None
    if skeleton is not None:
        chunks, shape = volume_files.read_volume(spark, skeleton)
        if shape.size != size:
            warnings.warn(f"the skeleton has {shape.size} voxels, the masks {size}", stacklevel=2)
        dots = arrays.to_voxels(chunks).select("z", "y", "x")
        dots = work.keep(dots, "dots")
        if dots.count() > target_points:
            dots = thinning.thin(dots, work)
    volume = Volume(spark, _voxels(outers), dots, _voxels(inners) if inners else None, None, dim, voxel, size)
    for name in ("outerv", "innerv", "skel"):
        setattr(volume, name, volume.work.keep(getattr(volume, name), name))

    parts: dict[str, Part] = {}
    attributes = {}
    full = tuple(n * FACTOR for n in size)
    if image is not None:
        chunks, shape = volume_files.read_volume(spark, image)
        if tuple(n // FACTOR for n in shape.size) != size:
            warnings.warn(f"the image has {shape.size} voxels, which by {FACTOR} isn't the masks' {size}", stacklevel=2)
        full = shape.size
        pyramid = arrays.pyramid(work.keep(chunks, "image"), levels, shape, lambda df, name: work.keep(df, f"image_{name}"))
        parts |= {str(i): x for i, x in enumerate(pyramid)}
        attributes[""] = zarr.multiscales([str(i) for i in range(len(pyramid))], shape, tuple(v / FACTOR for v in voxel))
    combined = arrays.from_voxels(volume.combined.withColumnRenamed("label_id", "value"), arrays.Shape(size, None, "<u2" if max(outers) < 1 << 16 else "<u4"))
    whole = arrays.Shape(full, None, "<u2" if max(outers) < 1 << 16 else "<u4")
    grown = arrays.upsample(work.keep(combined, "combined"), FACTOR, full)
    segmentation = arrays.pyramid(grown, levels, whole, lambda df, name: work.keep(df, f"segmentation_{name}"), coarsen=arrays.stride, progressive=False)
    parts |= {f"segmentation/{i}": x for i, x in enumerate(segmentation)}
    attributes["segmentation"] = zarr.multiscales([str(i) for i in range(len(segmentation))], whole, tuple(v / FACTOR for v in voxel))
    for kind, masks in (("outer", outers), ("inner", inners)):
        parts |= {f"{kind}_masks_L2/{names.get(i, f'Label_{i}')}": part for i, part in masks.items()}
    zarr.write_store(parts, f"{out}/store.zarr", attributes)

    save = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}")
    for name in ("contour", "overlap", "body", "part", "inst", "edge"):
        save(getattr(volume, name), name)
    save(volume.point.join(volume.mapped.drop("label_id"), "point_id"), "point")
    mesh_files.write_meshes(volume.outerv, ["label_id"], voxel, F.format_string("outer_%d", "label_id"), f"{out}/morphology_meshes", size[0])
    bodies = volume.body.join(volume.cvox, ["label_id", "z", "cc_id"]).select("label_id", "comp_id", "z", "y", "x")
    large = bodies.groupBy("label_id", "comp_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_BODY).drop("n")
    mesh_files.write_meshes(bodies.join(large, ["label_id", "comp_id"]), ["label_id", "comp_id"], voxel, F.format_string("cc_%04d_%d_outer", "comp_id", "label_id"), f"{out}/image_host_meshes", size[0])
    if skeleton is not None:
        mesh_files.skeleton_mesh_set(volume, f"{out}/skeleton_meshes/per_spatial_cc")
    tables.write_metadata(volume, f"{out}/metadata.json")
    tables.write_contours(tables.contour_rows(volume), f"{out}/cc_metadata.json")
    tables.write_points(tables.point_rows(volume), f"{out}/skeleton_points.json")
    tables.write_graph(volume.edge, voxel, f"{out}/skeleton_graph.json")
    return volume


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    pair = lambda text: (int(text.partition("=")[0]), text.partition("=")[2])
    parser.add_argument("--outer", type=pair, action="append", default=[], metavar="LABEL=PATH")
    parser.add_argument("--inner", type=pair, action="append", default=[], metavar="LABEL=PATH")
    parser.add_argument("--labels", metavar="PATH", help="a label volume in place of outer masks")
    parser.add_argument("--name", type=pair, action="append", default=[], metavar="LABEL=NAME")
    parser.add_argument("--skeleton")
    parser.add_argument("--image")
    parser.add_argument("--out", required=True)
    parser.add_argument("--voxel", type=float, nargs=3, default=(1.0, 1.0, 1.0), metavar=("Z", "Y", "X"))
    given = parser.parse_args(arguments)
    named = tuple((i, name, None) for i, name in given.name)
    preprocess(build_session("preprocess"), given.out, dict(given.outer), dict(given.inner), given.skeleton, given.image, named, tuple(given.voxel), label_volume=given.labels)


if __name__ == "__main__":
    main()
