"""JSON sidecars of points, contours, the graph and metadata: written and read as JSON lines, one for each chunk or slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parallel lists of a chunk of points; world places are in micrometres, neighbours in order of their offsets.
POINT = {
    "point_id": "long", "z": "int", "y": "int", "x": "int", "wz": "double", "wy": "double", "wx": "double", "label_id": "int",
    "z_l0": "int", "cc_id0": "int", "instance_id": "int", "spatial_cc_id": "long", "neighbours": "array<long>",
}
POINTS = "struct<" + ",".join(f"{c}:array<{t}>" for c, t in POINT.items()) + ">"
OVERLAP = "array<struct<label_id:int,cc_id:int,area:bigint>>"
CONTOUR = f"struct<cc_id:int,bbox:array<int>,area:bigint,centroid:array<double>,skeleton_marker:struct<position:array<double>,has_skeleton:boolean>,overlaps_prev:{OVERLAP},overlaps_next:{OVERLAP}>"
CONTOURS = f"array<{CONTOUR}>"


def point_rows(volume) -> DataFrame:
    """All fields of a volume's skeleton points."""
    near = volume.edge.groupBy(F.col("a").alias("point_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "b"))), lambda s: s["b"]).alias("neighbours"))
    rows = volume.point.join(volume.mapped.drop("label_id"), "point_id").join(volume.inst.select("point_id", F.col("instance_id").cast("int").alias("instance_id")), "point_id")
    rows = rows.join(volume.part.select("point_id", F.col("root").alias("spatial_cc_id")), "point_id").join(near, "point_id", "left")
    world = {f"w{c}": F.col(c) * F.lit(float(v)) for c, v in zip("zyx", volume.voxel)}
    return rows.withColumns(world | {"neighbours": F.coalesce("neighbours", F.expr("cast(array() as array<bigint>)"))}).select(*(F.col(c).cast(t).alias(c) for c, t in POINT.items()))


def contour_rows(volume) -> DataFrame:
    """(label_id, z, contour): all fields of a volume's contours, with their overlaps in the slice before and after."""
    key = ["label_id", "z", "cc_id"]
    lists = volume.overlap.groupBy(*key).agg(*(F.array_sort(F.collect_list(F.when(F.col("dir") == d, F.struct(F.col("o_label_id").alias("label_id"), F.col("o_cc_id").alias("cc_id"), F.col("area").cast("long").alias("area"))))).alias(n) for d, n in ((-1, "overlaps_prev"), (1, "overlaps_next"))))
    none = F.expr(f"cast(array() as {OVERLAP})")
    vz, vy, vx = map(float, volume.voxel)
    marker = F.struct(F.array(F.col("marker_x") * vx, F.col("marker_y") * vy, F.col("z") * vz).alias("position"), "has_skeleton")
    fields = [F.col("cc_id"), F.array("y_min", "y_max", "x_min", "x_max").alias("bbox"), F.col("area").cast("long").alias("area"), F.array("centroid_y", "centroid_x").alias("centroid"), marker.alias("skeleton_marker")]
    fields += [F.coalesce(n, none).alias(n) for n in ("overlaps_prev", "overlaps_next")]
    return volume.contour.join(lists, key, "left").select("label_id", "z", F.struct(*fields).alias("contour"))


def points_to_json(points: DataFrame, chunk: int = 1000) -> DataFrame:
    """(chunk, json): parallel lists, chunk points at a time."""
    rows = points.groupBy(F.expr(f"point_id div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*POINT))).alias("rows"))
    return rows.select("chunk", F.to_json(F.struct(*(F.col(f"rows.{c}").alias(c) for c in POINT))).alias("json"))


def points_from_json(texts: DataFrame) -> DataFrame:
    p = texts.select(F.from_json("json", POINTS).alias("p"))
    return p.select(F.explode(F.arrays_zip(*(f"p.{c}" for c in POINT))).alias("r")).select("r.*")


def contours_to_json(contours: DataFrame) -> DataFrame:
    """(label_id, z, json): the contours of a slice as a list in order of cc_id."""
    return contours.groupBy("label_id", "z").agg(F.to_json(F.array_sort(F.collect_list("contour"))).alias("json"))


def contours_from_json(texts: DataFrame) -> DataFrame:
    """Contours of the lists, a column for each field; one whose cc_id isn't its place in the list, or that lacks its marker, is an error."""
    rows = texts.select("label_id", "z", F.posexplode(F.from_json("json", CONTOURS)).alias("place", "c"))
    bad = F.when(~F.col("c.cc_id").eqNullSafe(F.col("place") + 1), "cc_id isn't the contour's place in its list").when(F.col("c.skeleton_marker.position").isNull() | F.col("c.skeleton_marker.has_skeleton").isNull(), "a contour has no skeleton marker")
    checked = F.when(bad.isNull(), F.col("c.cc_id")).otherwise(F.raise_error(bad).cast("int"))
    return rows.select("label_id", "z", checked.alias("cc_id"), *(f"c.{f}" for f in ("bbox", "area", "centroid", "skeleton_marker", "overlaps_prev", "overlaps_next")))


def _written(texts: DataFrame, path: str) -> str:
    texts.select("json").write.mode("overwrite").text(path)
    return path


def write_points(points: DataFrame, path: str) -> str:
    """Rows of ``point_rows`` as JSON lines, a chunk of parallel lists a line."""
    return _written(points_to_json(points), path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return points_from_json(spark.read.text(path).withColumnRenamed("value", "json"))


def write_contours(contours: DataFrame, path: str) -> str:
    """Rows of ``contour_rows`` as JSON lines, each the label, the slice and its list."""
    lists = contours_to_json(contours).select(F.to_json(F.struct("label_id", "z", F.col("json").alias("contours"))).alias("json"))
    return _written(lists, path)


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """Contours of the lines; one whose list isn't in order of cc_id is an error."""
    return contours_from_json(spark.read.schema("label_id int, z int, contours string").json(path).withColumnRenamed("contours", "json"))


GRAPH = "node_a long, node_b long, distance_um double"


def write_graph(edges: DataFrame, voxel: tuple[float, float, float], path: str) -> str:
    """The skeleton's edges, each once, with their length, as JSON lines."""
    length = F.sqrt(F.pow(F.col("dz") * voxel[0], 2.0) + F.pow(F.col("dy") * voxel[1], 2.0) + F.pow(F.col("dx") * voxel[2], 2.0))
    return _written(edges.where("a < b").select(F.to_json(F.struct(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.round(length, 6).alias("distance_um"))).alias("json")), path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRAPH).json(path)


METADATA = "labels array<struct<label_id:int,name:string,color:string>>, voxel_size array<double>, shape array<int>"


def write_metadata(volume, path: str) -> str:
    """One JSON text of a volume's labels, voxel size and shape; the label table is small."""
    labels = volume.label_dim.agg(F.array_sort(F.collect_list(F.struct("label_id", "name", "color"))).alias("labels"))
    return _written(labels.select(F.to_json(F.struct("labels", F.array(*map(F.lit, volume.voxel)).alias("voxel_size"), F.array(*map(F.lit, volume.shape)).alias("shape"))).alias("json")).coalesce(1), path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, name, color, vz, vy, vx, nz, ny, nx)."""
    whole = spark.read.schema(METADATA).json(path).select(F.explode("labels").alias("l"), *(F.element_at("voxel_size", i + 1).alias(f"v{c}") for i, c in enumerate("zyx")), *(F.element_at("shape", i + 1).alias(f"n{c}") for i, c in enumerate("zyx")))
    return whole.select("l.*", "vz", "vy", "vx", "nz", "ny", "nx")
