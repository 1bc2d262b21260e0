"""Queries of files and stores: what is written is read back, and held against SQL over the tables it came from."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import colors
from lamina.operators import paths, thinning
from lamina.operators.numbering import ordered_ids
from lamina.operators.volume_tables import DerivedVolume
from lamina.registry import both, register
from lamina.sources import arrays, mesh_files, tables, volume_files, zarr


def _image(v: DerivedVolume) -> tuple[DataFrame, arrays.Shape]:
    shape = arrays.Shape(v.shape, None, "|u1")
    return arrays.from_voxels(v.img, shape), shape


def _rgb(v: DerivedVolume) -> DataFrame:
    """The image as three channels and a fourth that a TIFF's reader leaves out."""
    values = F.array(F.col("value"), 255 - F.col("value"), F.col("value") % 7, F.lit(9))
    return v.img.select("z", "y", "x", F.posexplode(values).alias("channel", "value"))


def _rgb_files(v: DerivedVolume) -> str:
    """Slabs with samples side by side and, every second one, in planes."""
    return volume_files.write_slabs(_rgb(v), v.work.path("rgb"), 10, arrays.Shape(v.shape, 4, "|u1"), "tif", planes=lambda slab: slab % 2 == 1)


def _plain(chunks: DataFrame, *columns: str, held: bool = False) -> DataFrame:
    """Voxel rows with whole values, as SQL has them."""
    return arrays.to_voxels(chunks, held).select(*columns, "z", "y", "x", F.col("value").cast("int").alias("value"))


_VALUES = "select z, y, x, value from {img} where value > 0"
_RGB = "select z, y, x, 0 as channel, value from {img} union all select z, y, x, 1, 255 - value from {img} union all select z, y, x, 2, value % 7 from {img}"
for _kind, _name in (("npy", "S1"), ("tif", "S1_tif")):
    register(_name, lambda v, kind=_kind: _plain(volume_files.read_volume(v.spark, volume_files.write_slabs(v.img, v.work.path(kind), 10, arrays.Shape(v.shape, None, "|u1"), kind))[0]), _VALUES)


def _described(v: DerivedVolume) -> DataFrame:
    """Shape and type by the headers alone."""
    shape = volume_files.describe(_rgb_files(v))
    return v.spark.createDataFrame([(*shape.size, shape.channels, shape.dtype)], "nz int, ny int, nx int, channels int, dtype string")


register("S1_shape", _described, "select cast(nz as int) as nz, 48 as ny, 48 as nx, 3 as channels, '|u1' as dtype from {depth}")
register("S2", lambda v: _plain(volume_files.read_volume(v.spark, _rgb_files(v))[0], "channel"), f"select z, y, x, channel, value from ({_RGB}) c where value > 0")


def _label_volume(v: DerivedVolume) -> DataFrame:
    """Labels of a label-volume file: numbered in order of value, named by the user or by value, with their voxels."""
    labels = v.combined.withColumnRenamed("label_id", "value")
    chunks, _ = volume_files.read_volume(v.spark, volume_files.write_slabs(labels, v.work.path("labels"), 10, arrays.Shape(v.shape, None, "<u2"), "tif"))
    sizes = arrays.to_voxels(arrays.label_masks(chunks)).groupBy(F.col("array").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    named = ordered_ids(sizes, ["value"], "nth", v.work).join(v.label_dim.where("label_id <= 2").withColumnRenamed("label_id", "value"), "value", "left")
    return named.select((F.col("nth") + 1).alias("label_id"), "value", F.coalesce("name", F.concat(F.lit("Label_"), "value")).alias("name"), "n")


register("S3", _label_volume, "select row_number() over (order by value) as label_id, value, coalesce(d.name, concat('Label_', value)) as name, n from (select label_id as value, count(*) as n from {combined} group by label_id) v left join (select * from {label_dim} where label_id <= 2) d on d.label_id = v.value")

_HALF = "select z // 2 z, y // 2 y, x // 2 x, channel, cast(sum(value) // 8 as int) as value from ({}) a group by 1, 2, 3, 4"
_LEVELS, _RGB_LEVELS = (["select z, y, x, 0 as channel, value from {img}"], [_RGB])
for _ in range(3):
    _LEVELS.append(_HALF.format(_LEVELS[-1]))
    _RGB_LEVELS.append(_HALF.format(_RGB_LEVELS[-1]))


def _pyramid_sql(levels: list[str], least_side: int, wanted: str = "value > 0 and ") -> str:
    """Levels are made while the least side, halved so often, is least_side or more."""
    return " union all ".join(f"select {i} as level, z, y, x, channel, value from ({text}) l{i} where {wanted}({i} = 0 or (select least(nz, 48) // {2**i} from {{depth}}) >= {least_side})" for i, text in enumerate(levels))


def _read_rgb(v: DerivedVolume) -> tuple[DataFrame, arrays.Shape]:
    return volume_files.read_volume(v.spark, _rgb_files(v))


def _united(levels: list[tuple[DataFrame, arrays.Shape]], held: bool = False) -> DataFrame:
    out = None
    for level, (chunks, _) in enumerate(levels):
        one = _plain(chunks, "channel", held=held).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def _rgb_pyramid(v: DerivedVolume) -> DataFrame:
    chunks, shape = _read_rgb(v)
    return _united(arrays.pyramid(chunks, 3, shape, v.work.keep))


def _held_pyramid(v: DerivedVolume) -> DataFrame:
    """All voxels of the image, and all blocks that hold any, those of value 0 too."""
    shape = arrays.Shape(v.shape, 2, "|u1")
    return _united(arrays.pyramid(arrays.from_voxels(v.img, shape, held=True), 4, shape, v.work.keep, 4, partial(arrays.block_mean, held=True)), held=True)


register("R1", _rgb_pyramid, f"select level, z, y, x, channel, value from ({_pyramid_sql(_RGB_LEVELS, 16)}) p")
register("R1_deep", _held_pyramid, f"select level, z, y, x, channel, value from ({_pyramid_sql(_LEVELS, 4, '')}) p")
register("R2", lambda v: _plain(arrays.pyramid(_image(v)[0], 3, _image(v)[1], v.work.keep, 4, progressive=False)[2][0]), "select * from (select z // 4 as z, y // 4 as y, x // 4 as x, cast(sum(value) // 64 as int) as value from {img} group by 1, 2, 3) m where value > 0")
register("R3", lambda v: _plain(arrays.block_mean(_image(v)[0], 3, _image(v)[1])[0]), "select * from (select z // 3 as z, y // 3 as y, x // 3 as x, cast(sum(value) // 27 as int) as value from {img} group by 1, 2, 3) m where value > 0")
register("R3_truncated", lambda v: _plain(arrays.block_mean(arrays.truncated(_image(v)[0], v.shape[0] // 3 * 3), 3, _image(v)[1])[0]), "select * from (select z // 3 as z, y // 3 as y, x // 3 as x, cast(sum(value) // 27 as int) as value from {img} where z < (select nz // 3 * 3 from {depth}) group by 1, 2, 3) m where value > 0")


def _segmentation(v: DerivedVolume) -> tuple[DataFrame, arrays.Shape]:
    shape = arrays.Shape(v.shape, None, "<u2")
    return arrays.from_voxels(v.combined.withColumnRenamed("label_id", "value"), shape), shape


register("R4", lambda v: _plain(arrays.upsample(_segmentation(v)[0], 2, (v.shape[0] * 2 - 1, 95, 95))).withColumnRenamed("value", "label_id"), "select z * 2 + a.v as z, y * 2 + b.v as y, x * 2 + c.v as x, label_id from {combined}, (values (0), (1)) a(v), (values (0), (1)) b(v), (values (0), (1)) c(v) where z * 2 + a.v < (select nz * 2 - 1 from {depth}) and y * 2 + b.v < 95 and x * 2 + c.v < 95")
register("R6", lambda v: _plain(arrays.stride(_segmentation(v)[0], 2, _segmentation(v)[1])[0]).withColumnRenamed("value", "label_id"), "select z // 2 as z, y // 2 as y, x // 2 as x, label_id from {combined} where z % 2 = 0 and y % 2 = 0 and x % 2 = 0")


def _store(v: DerivedVolume, least_side: int = 4) -> str:
    """Image pyramid, label pyramid and masks as a Zarr store."""
    levels = arrays.pyramid(_image(v)[0], 4, _image(v)[1], v.work.keep, least_side)
    chunks, shape = _segmentation(v)
    strided = [(chunks, shape), *(arrays.stride(chunks, 2**i, shape) for i in range(1, len(levels)))]
    masks = {}
    for kind, voxels in (("outer", v.outerv), ("inner", v.innerv)):
        for label_id, name, _ in v.labels:
            own = arrays.Shape(v.shape, None, "|u1")
            masks[f"{kind}_masks_L2/{name}"] = (arrays.from_voxels(voxels.where(F.col("label_id") == label_id).withColumn("value", F.lit(1)), own), own)
    parts = {str(i): x for i, x in enumerate(levels)} | {f"segmentation/{i}": x for i, x in enumerate(strided)} | masks
    names = [str(i) for i in range(len(levels))]
    return zarr.write_store(parts, v.work.path("store"), {group: zarr.multiscales(names, own, v.voxel) for group, own in (("", levels[0][1]), ("segmentation", shape))})


def _stored(v: DerivedVolume) -> DataFrame:
    """Everything that the store holds, by the names that it lists."""
    path = _store(v)
    names = [n if not g else f"{g}/{n}" for g in ("", "segmentation", "outer_masks_L2", "inner_masks_L2") for n in zarr.members(path, g)]
    return _plain(zarr.read_arrays(v.spark, path, names), "array")


_STRIDES = " union all ".join(f"select 'segmentation/{i}' as array, z // {2**i} as z, y // {2**i} as y, x // {2**i} as x, label_id as value from {{combined}} where z % {2**i} = 0 and y % {2**i} = 0 and x % {2**i} = 0 and ({i} = 0 or (select least(nz, 48) // {2**i} from {{depth}}) >= 4)" for i in range(4))
_MASKS = " union all ".join(f"select concat('{kind}_masks_L2/', name) as array, z, y, x, 1 as value from {{{kind}v}} join {{label_dim}} using (label_id)" for kind in ("outer", "inner"))
register("K1", _stored, f"select cast(level as varchar) as array, z, y, x, value from ({_pyramid_sql(_LEVELS, 4)}) i union all {_STRIDES} union all {_MASKS}")
_SIZES = " union all ".join(f"select {i} as level, " + ", ".join(f"cast(({n} + {2**i - 1}) // {2**i} as int) as {c}" for c, n in (("nz", "nz"), ("ny", "48"), ("nx", "48"))) + f" from {{depth}} where {i} = 0 or least(nz, 48) // {2**i} >= 4" for i in range(4))
register("S6", lambda v: zarr.levels(v.spark, _store(v)).drop("channels", "dtype"), f"select level, cast((nz + 15) // 16 as int) as n_chunks, nz, ny, nx from ({_SIZES}) s order by level")
register("S11", lambda v: _plain(zarr.read_arrays(v.spark, _store(v), ["1"])).select("*", *((F.col(c) * s * 2).alias(f"w{c}") for c, s in zip("zyx", v.voxel))), f"select z, y, x, value, z * 2e0 * 2 as wz, y * 1e0 * 2 as wy, x * 0.5e0 * 2 as wx from ({_LEVELS[1]}) l where value > 0")
register("S12_store", lambda v: _plain(zarr.read_arrays(v.spark, _store(v), ["0"], z=(5, 9))), "select z, y, x, value from {img} where value > 0 and z between 5 and 8")


def _shape_check(v: DerivedVolume) -> DataFrame:
    """Each level's shape in the store's metadata against the first one's divided by its factor, rounded down."""
    path = _store(v)
    first = zarr.shape_of(path, "0").size
    rows = [(2 ** int(n), *(s // 2 ** int(n) for s in first), *zarr.shape_of(path, n).size) for n in zarr.members(path) if n.isdigit()]
    got = v.spark.createDataFrame(rows, "factor int, want_z int, want_y int, want_x int, got_z int, got_y int, got_x int")
    return got.withColumn("mismatch", F.expr("want_z <> got_z or want_y <> got_y or want_x <> got_x"))


register("P17", _shape_check, f"""
    select f as factor, cast(d.nz // f as int) as want_z, cast(48 // f as int) as want_y, cast(48 // f as int) as want_x, s.nz as got_z, s.ny as got_y, s.nx as got_x, s.nz <> d.nz // f or s.ny <> 48 // f or s.nx <> 48 // f as mismatch
    from {{depth}} d, (select *, cast(1 << level as int) as f from ({_SIZES}) z) s""")

register("K2", lambda v: tables.read_metadata(v.spark, tables.write_metadata(v, v.work.path("metadata"))), "select label_id, name, color, 2.0e0 as vz, 1.0e0 as vy, 0.5e0 as vx, cast(nz as int) as nz, 48 as ny, 48 as nx from {label_dim}, {depth}")
register("K3", lambda v: tables.read_graph(v.spark, tables.write_graph(v.edge, v.voxel, v.work.path("graph"))), "select a as node_a, b as node_b, round(sqrt(dz * dz * 4.0e0 + dy * dy * 1.0e0 + dx * dx * 0.25e0), 6) as distance_um from {edge} where a < b")
def _points_read(v: DerivedVolume) -> DataFrame:
    read = tables.read_points(v.spark, tables.write_points(tables.point_rows(v), v.work.path("points")))
    return read.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ","))


def _contours_read(v: DerivedVolume) -> DataFrame:
    """The fields of the contours, lists as text: label:contour:area of what they share voxels with."""
    read = tables.read_contours(v.spark, tables.write_contours(tables.contour_rows(v), v.work.path("contours")))
    text = lambda c: F.array_join(F.transform(c, lambda o: F.concat_ws(":", o["label_id"].cast("string"), o["cc_id"].cast("string"), o["area"].cast("string"))), ",").alias(c)
    box = (F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(("y_min", "y_max", "x_min", "x_max")))
    place = (F.round(F.element_at("skeleton_marker.position", i + 1), 6).alias(f"world_{c}") for i, c in enumerate("xyz"))
    middle = (F.round(F.element_at("centroid", i + 1), 6).alias(f"centroid_{c}") for i, c in enumerate("yx"))
    return read.select("label_id", "z", "cc_id", *box, "area", *middle, *place, "skeleton_marker.has_skeleton", text("overlaps_prev"), text("overlaps_next"))


register("S7", _points_read, """
    select p.point_id, p.z, p.y, p.x, p.z * 2.0e0 as wz, p.y * 1.0e0 as wy, p.x * 0.5e0 as wx, p.label_id, cast(i.instance_id as int) as instance_id, r.root as spatial_cc_id,
        cast(p.z * 4 + case when p.label_id > 0 and c.label_id is distinct from p.label_id then 2 else 0 end as int) as z_l0, coalesce(v.cc_id, 0) - 1 as cc_id0,
        coalesce((select string_agg(cast(e.b as varchar), ',' order by e.ord) from {edge} e where e.a = p.point_id), '') as neighbours
    from {point} p join (select point_id, instance_id from {inst}) i using (point_id) join (select point_id, root from {part}) r using (point_id)
    left join {combined} c on c.z = p.z and c.y = p.y and c.x = p.x left join {ccvox} v on v.label_id = p.label_id and v.z = p.z and v.y = p.y and v.x = p.x""")
register("S8", _contours_read, """
    select c.label_id, c.z, c.cc_id, y_min, y_max, x_min, x_max, c.area, round(centroid_y, 6) as centroid_y, round(centroid_x, 6) as centroid_x, round(marker_x * 0.5e0, 6) as world_x, round(marker_y * 1.0e0, 6) as world_y, round(c.z * 2.0e0, 6) as world_z, has_skeleton,
        coalesce(string_agg(case when dir = -1 then concat(o_label_id, ':', o_cc_id, ':', o.area) end, ',' order by o_label_id, o_cc_id), '') as overlaps_prev, coalesce(string_agg(case when dir = 1 then concat(o_label_id, ':', o_cc_id, ':', o.area) end, ',' order by o_label_id, o_cc_id), '') as overlaps_next
    from {contour} c left join {overlap} o using (label_id, z, cc_id) group by all""")


def _skeleton_tiff(v: DerivedVolume) -> DataFrame:
    """Vertices in micrometres, cut to voxels, inside the shape, as a mask of 255 in slabs of TIFF, and read again."""
    vz, vy, vx = v.voxel
    _, ny, nx = v.shape
    vertices = v.skel.selectExpr(f"z * {vz} + 0.5 as wz", f"y * {vy} + 0.25 as wy", f"x * {vx} + 0.125 as wx")
    cut = vertices.select(*((F.col(f"w{c}") / s).cast("int").alias(c) for c, s in zip("zyx", v.voxel))).where((F.col("y") < ny) & (F.col("x") < nx)).distinct().withColumn("value", F.lit(255))
    return _plain(volume_files.read_volume(v.spark, volume_files.write_slabs(cut, v.work.path("vertices"), 10, arrays.Shape(v.shape, None, "|u1"), "tif"))[0])


register("K5_tiff", _skeleton_tiff, "select z, y, x, 255 as value from {skel}")


def _label_meshes(v: DerivedVolume) -> str:
    return mesh_files.write_meshes(v.outerv, ["label_id"], v.voxel, F.format_string("outer_%d", "label_id"), v.work.path("label_meshes"), v.shape[0])


def _body_meshes(v: DerivedVolume, wanted: str = "true") -> DataFrame:
    """Sizes of the stored outer meshes of the wanted bodies of 10 voxels or more; no other is made."""
    bodies = v.body.where(wanted).join(v.cvox, ["label_id", "z", "cc_id"]).select("label_id", "comp_id", "z", "y", "x")
    sizes = bodies.groupBy("label_id", "comp_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").drop("n")
    own = bodies.join(sizes, ["label_id", "comp_id"])
    path = mesh_files.write_meshes(own, ["label_id", "comp_id"], v.voxel, F.format_string("cc_%04d_%d_outer", "comp_id", "label_id"), v.work.path("body_meshes"), v.shape[0])
    read = mesh_files.read_sizes(mesh_files.read_index(v.spark, path), path)
    ids = F.split("mesh_key", "_")
    return read.select("mesh_key", ids[2].cast("int").alias("label_id"), ids[1].cast("int").alias("comp_id"), "n_points", "n_cells")


def _label_sizes(v: DerivedVolume) -> DataFrame:
    path = _label_meshes(v)
    return mesh_files.read_sizes(mesh_files.read_index(v.spark, path), path)


def _label_points(v: DerivedVolume) -> DataFrame:
    """The points of the stored label meshes, as the files have them."""
    path = _label_meshes(v)
    return mesh_files.read_points(mesh_files.read_index(v.spark, path), path).select("mesh_key", *(F.round(c, 3).alias(c) for c in ("vx", "vy", "vz")))


def _skeleton_sizes(v: DerivedVolume, per_part: bool = True) -> DataFrame:
    """The stored skeleton meshes by part, or those by label that are made where none are stored."""
    at = v.work.path("skeleton_meshes")
    if per_part:
        mesh_files.skeleton_mesh_set(v, f"{at}/per_spatial_cc")
    mode, index, path = mesh_files.open_skeleton_meshes(v, at)
    return mesh_files.read_sizes(index, path).select(F.lit(mode).alias("mode"), "mesh_key", "n_points", "n_cells")


_SURFACE = """(with own as ({voxels}), faces as (select o.label_id, o.comp_id, f.axis, o.z + least(0, f.dz) z, o.y + least(0, f.dy) y, o.x + least(0, f.dx) x from own o, (values (0, -1, 0, 0), (0, 1, 0, 0), (1, 0, -1, 0), (1, 0, 1, 0), (2, 0, 0, -1), (2, 0, 0, 1)) f(axis, dz, dy, dx)
        where not exists (select 1 from own n where n.label_id = o.label_id and n.comp_id = o.comp_id and n.z = o.z + f.dz and n.y = o.y + f.dy and n.x = o.x + f.dx)),
    cells as (select distinct label_id, comp_id, case when axis = 0 then z else z + a.v end cz, case when axis = 1 then y when axis = 0 then y + a.v else y + b.v end cy, case when axis = 2 then x else x + b.v end cx from faces, (values (-1), (0)) a(v), (values (-1), (0)) b(v))
    select p.label_id, p.comp_id, p.n_points, q.n_cells from (select label_id, comp_id, count(*) n_points from cells group by 1, 2) p join (select label_id, comp_id, 2 * count(*) n_cells from faces group by 1, 2) q using (label_id, comp_id))"""
_VERTICES = """with faces as (select o.label_id, f.axis, o.z + least(0, f.dz) z, o.y + least(0, f.dy) y, o.x + least(0, f.dx) x from {outerv} o, (values (0, -1, 0, 0), (0, 1, 0, 0), (1, 0, -1, 0), (1, 0, 1, 0), (2, 0, 0, -1), (2, 0, 0, 1)) f(axis, dz, dy, dx)
        where not exists (select 1 from {outerv} n where n.label_id = o.label_id and n.z = o.z + f.dz and n.y = o.y + f.dy and n.x = o.x + f.dx))
    select label_id, avg((x + case when axis = 2 then 0.5e0 else 0 end) * 0.5e0) as vx, avg((y + case when axis = 1 then 0.5e0 else 0 end) * 1e0) as vy, avg((z + case when axis = 0 then 0.5e0 else 0 end) * 2e0) as vz
    from (select *, case when axis = 0 then z else z + a.v end cz, case when axis = 1 then y when axis = 0 then y + a.v else y + b.v end cy, case when axis = 2 then x else x + b.v end cx from faces, (values (-1), (0)) a(v), (values (-1), (0)) b(v)) c group by label_id, cz, cy, cx"""
_BODIES = "select b.label_id, b.comp_id, v.z, v.y, v.x from {body} b join {cvox} v using (label_id, z, cc_id) semi join (select label_id, comp_id from {body} join {contour} using (label_id, z, cc_id) group by 1, 2 having sum(area) >= 10) k on k.label_id = b.label_id and k.comp_id = b.comp_id"
_LABEL_VOXELS = "select label_id, 0 as comp_id, z, y, x from {outerv}"
register("S10", _label_points, f"select concat('outer_', label_id) as mesh_key, round(vx, 3) as vx, round(vy, 3) as vy, round(vz, 3) as vz from ({_VERTICES}) m")
register("S10_sizes", _label_sizes, "select concat('outer_', label_id) as mesh_key, n_points, n_cells from " + _SURFACE.replace("{voxels}", _LABEL_VOXELS))
register("K4_files", _body_meshes, "select printf('cc_%04d_%d_outer', comp_id, label_id) as mesh_key, label_id, comp_id, n_points, n_cells from " + _SURFACE.replace("{voxels}", _BODIES))
register("S13", lambda v: _body_meshes(v, "comp_id % 3 = 1"), "select printf('cc_%04d_%d_outer', comp_id, label_id) as mesh_key, label_id, comp_id, n_points, n_cells from " + _SURFACE.replace("{voxels}", _BODIES) + " m where comp_id % 3 = 1")
_THICK = "select distinct {root}, label_id, z + a.v as z, y + b.v as y, x + c.v as x from {point} join (select point_id, root from {part}) r using (point_id), {dsteps} a, {dsteps} b, {dsteps} c where a.v * a.v + b.v * b.v + c.v * c.v <= 9 and z + a.v >= 0 and z + a.v < (select nz from {depth}) and y + b.v between 0 and 47 and x + c.v between 0 and 47"
register("S9", _skeleton_sizes, "select 'per_spatial_cc' as mode, concat('skeleton_cc', comp_id, '_', label_id) as mesh_key, n_points, n_cells from " + _SURFACE.replace("{voxels}", _THICK.replace("{root}", "root as comp_id")))
register("S9_label", lambda v: _skeleton_sizes(v, per_part=False), "select 'per_label' as mode, concat('skeleton_', label_id) as mesh_key, n_points, n_cells from " + _SURFACE.replace("{voxels}", _THICK.replace("{root}", "0 as comp_id")))

register("G19", lambda v: thinning.thin(v.combined, v.work))

# Colours and scalar functions
_HEX = "concat('#', lpad(lower(to_hex(event_id % 256)), 2, '0'), lpad(lower(to_hex((event_id * 7) % 256)), 2, '0'), lpad(lower(to_hex(user_id % 256)), 2, '0'))"
register("Q2", lambda v: v.events.select("event_id", colors.hex_to_rgba(colors.rgb_to_hex(*((F.expr(e) % 256) / 255.0 + 0.001 for e in ("event_id", "event_id * 7", "user_id")))).alias("c")).select("event_id", *(F.round(f"c.{p}", 6).alias(p) for p in "rgba")), """
    select event_id, round((event_id % 256) / 255e0, 6) as r, round(((event_id * 7) % 256) / 255e0, 6) as g, round((user_id % 256) / 255e0, 6) as b, 1e0 as a from (select event_id, user_id from {events}) e""".replace("{events}", "events"))
register("Q3_cut", lambda v: v.events.where("value between 0 and 1e6").select("event_id", colors.rgb_to_hex(*(F.expr(f"pmod(value * {k}, 1e0)") for k in (1, 3, 7))).alias("color")), """
    select event_id, concat('#', """ + ", ".join(f"lpad(lower(to_hex(cast(trunc(fmod(value * {k}, 1e0) * 255) as int))), 2, '0')" for k in (1, 3, 7)) + """) as color from events where value between 0 and 1e6""")
register("Q5", lambda v: v.combined.select("label_id").distinct().select("label_id", F.posexplode(F.lit(colors.rainbow_hues(12))).alias("nth", "hue")).select("label_id", "nth", colors.rainbow_hex(F.col("hue")).alias("color")), """
    with recursive h(nth, hue) as (select 0, 0e0 union all select nth + 1, fmod(hue + 0.618033988749895e0, 1e0) from h where nth < 11),
    p as (select nth, cast(floor(hue * 6e0) as int) % 6 i, 0.85e0 v, 0.85e0 * (1e0 - 0.75e0) p, 0.85e0 * (1e0 - 0.75e0 * (hue * 6e0 - floor(hue * 6e0))) q, 0.85e0 * (1e0 - 0.75e0 * (1e0 - (hue * 6e0 - floor(hue * 6e0)))) t from h),
    c as (select nth, case i when 0 then v when 1 then q when 2 then p when 3 then p when 4 then t else v end r, case i when 0 then t when 1 then v when 2 then v when 3 then q else p end g, case i when 0 then p when 1 then p when 2 then t when 3 then v when 4 then v else q end b from p)
    select l.label_id, c.nth, concat('#', lpad(lower(to_hex(cast(trunc(r * 255) as int))), 2, '0'), lpad(lower(to_hex(cast(trunc(g * 255) as int))), 2, '0'), lpad(lower(to_hex(cast(trunc(b * 255) as int))), 2, '0')) as color from c, (select distinct label_id from {combined}) l""")
register("Q6", lambda v: colors.assign_colors(v.combined.groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).join(v.label_dim.withColumn("color", F.when(F.col("label_id") <= 2, F.col("color"))), "label_id")))
both("Q8", """select z, y, x, value % 7 as m, cast(ceil(value / 8.0e0) as bigint) as c, round(sqrt(value * 1.0e0), 6) as s, greatest(10, least(200, value)) as clipped,
    round(sqrt(z * z * {vz} * {vz} + y * y * {vy} * {vy} + x * x * {vx} * {vx}), 6) as norm, round(x * {vx} * 0.6e0 + z * {vz} * 0.8e0, 6) as dot, round(y * 0.8e0 * {vy}, 6) as cross_x, round(z * {vz} * 0.6e0 - x * {vx} * 0.8e0, 6) as cross_y, round(-y * {vy} * 0.6e0, 6) as cross_z from {img}""")


def _camera(v: DerivedVolume) -> DataFrame:
    """The camera's focus and distance for the path of every contour: the middle and twice the longer side of its box, in micrometres."""
    _, vy, vx = v.voxel
    box = paths.path_boxes(v.contour, v.overlap, v.work, 0, *v.shape[1:])
    side = F.greatest((F.col("x1") - F.col("x0")) * vx, (F.col("y1") - F.col("y0")) * vy)
    return box.select("label_id", "z", "cc_id", ((F.col("x0") + F.col("x1")) * vx / 2).alias("focal_x"), ((F.col("y0") + F.col("y1")) * vy / 2).alias("focal_y"), (2 * side).alias("distance"))


register("M11_path", _camera, """
    select s.label_id, s.z, s.cc_id, (min(x_min) + max(x_max)) * 0.5e0 / 2 as focal_x, (min(y_min) + max(y_max)) * 1.0e0 / 2 as focal_y, 2 * greatest((max(x_max) - min(x_min)) * 0.5e0, (max(y_max) - min(y_min)) * 1.0e0) as distance from (
        with recursive best as (select * from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, o_cc_id) nth from {overlap} where label_id = o_label_id) o where nth = 1),
        walk(label_id, z, cc_id, dir, zz, c) as (
            select label_id, z, cc_id, d.v, z, cc_id from {contour}, (values (-1), (1)) d(v)
            union all select w.label_id, w.z, w.cc_id, w.dir, w.zz + w.dir, b.o_cc_id from walk w join best b on b.label_id = w.label_id and b.z = w.zz and b.cc_id = w.c and b.dir = w.dir)
        select * from walk) s join {contour} c on c.label_id = s.label_id and c.z = s.zz and c.cc_id = s.c group by s.label_id, s.z, s.cc_id""")
