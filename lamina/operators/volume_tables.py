"""The derived tables of one volume, each built when it is first asked for."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import components, skeleton
from lamina.session import Workspace, by_shuffle
from lamina.sources import volume

#: Voxel size in micrometres at level 2 of the derived volume, along z, y and x; unequal, so that an axis mix-up shows.
VZ, VY, VX = 2.0, 1.0, 0.5

#: The label dimension of the derived volume.
LABELS = ((1, "Benign", "#10B981"), (2, "HGPIN", "#F59E0B"), (3, "AIP", "#FB7185"), (4, "IDCP", "#DC2626"))


def with_sizes(text: str, voxel: tuple[float, float, float], shape: Callable[[], tuple[int, int, int]]) -> str:
    """The text with the voxel's size and the shape, which is asked for only where it is named."""
    for name, size in zip(("vz", "vy", "vx"), voxel):
        text = text.replace(f"{{{name}}}", f"cast({float(size)!r} as double)")
    if re.search(r"\{n[zyx]\}", text):
        for name, n in zip(("nz", "ny", "nx"), shape()):
            text = text.replace(f"{{{name}}}", str(n))
    return text


class Volume:
    """A volume of one's own: outer and inner masks (label_id, z, y, x), skeleton (z, y, x), image
    (z, y, x, value), labels (id, name, colour), voxel size and shape along z, y and x."""

    def __init__(
        self, spark: SparkSession, outer: DataFrame, skeleton: DataFrame | None = None, inner: DataFrame | None = None, image: DataFrame | None = None,
        labels: tuple = LABELS, voxel: tuple[float, float, float] = (VZ, VY, VX), shape: tuple[int, int, int] | None = None,
    ):
        self.spark, self.labels, self.voxel = spark, labels, voxel
        self.outerv = by_shuffle(outer.select("label_id", "z", "y", "x"))
        self.innerv = by_shuffle((inner if inner is not None else outer.limit(0)).select("label_id", "z", "y", "x"))
        self.skel = by_shuffle((skeleton if skeleton is not None else outer.limit(0)).select("z", "y", "x"))
        self.img = by_shuffle((image if image is not None else outer.limit(0).withColumn("value", F.lit(0))).select("z", "y", "x", "value"))
        self._shape = shape

    @cached_property
    def shape(self) -> tuple[int, int, int]:
        """As given, or of the smallest box from the origin that holds the masks."""
        if self._shape is None:
            self._shape = tuple((n or 0) for n in self.outerv.agg(*(F.max(c) + 1 for c in "zyx")).first())
        return self._shape

    @cached_property
    def work(self) -> Workspace:
        return Workspace(self.spark, "volume", by_shuffle=True)

    @cached_property
    def label_dim(self) -> DataFrame:
        return self.spark.createDataFrame(self.labels, "label_id int, name string, color string")

    @cached_property
    def combined(self) -> DataFrame:
        """One label for each voxel: the last one wins."""
        return self.outerv.groupBy("z", "y", "x").agg(F.max("label_id").alias("label_id"))

    @cached_property
    def crun(self) -> DataFrame:
        return self.work.keep(components.contour_runs(self.outerv, self.work, self.shape[1]), "crun")

    @cached_property
    def cvox(self) -> DataFrame:
        return components.contour_voxels(self.crun)

    @cached_property
    def contour(self) -> DataFrame:
        """Box, area, centroid and skeleton marker of every contour."""
        size = F.col("x_hi") - F.col("x_lo") + 1
        shape = self.crun.groupBy("label_id", "z", "cc_id").agg(
            F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x_lo").alias("x_min"), F.max("x_hi").alias("x_max"),
            F.sum(size.cast("long")).alias("area"), F.sum((F.col("y") * size).cast("long")).alias("sum_y"), F.sum(((F.col("x_lo") + F.col("x_hi")) * size / 2).cast("long")).alias("sum_x"),
        )
        runs = self.crun.withColumn("xb", F.explode(F.expr(f"sequence(x_lo div {components.X_BUCKET}, x_hi div {components.X_BUCKET})")))
        dots = self.skel.withColumn("xb", F.expr(f"x div {components.X_BUCKET}"))
        on_line = runs.join(dots, ["z", "y", "xb"]).where("x between x_lo and x_hi").groupBy("label_id", "z", "cc_id").agg(F.count(F.lit(1)).alias("n_skel"), F.sum(F.col("y").cast("long")).alias("skel_y"), F.sum(F.col("x").cast("long")).alias("skel_x"))
        return (
            shape.join(on_line, ["label_id", "z", "cc_id"], "left")
            .withColumns({"centroid_y": F.col("sum_y") / F.col("area"), "centroid_x": F.col("sum_x") / F.col("area"), "has_skeleton": F.col("n_skel").isNotNull()})
            .withColumns({"marker_y": F.coalesce(F.col("skel_y") / F.col("n_skel"), "centroid_y"), "marker_x": F.coalesce(F.col("skel_x") / F.col("n_skel"), "centroid_x")})
            .select("label_id", "z", "cc_id", "y_min", "y_max", "x_min", "x_max", "area", "centroid_y", "centroid_x", "marker_y", "marker_x", "has_skeleton")
        )

    @cached_property
    def overlap(self) -> DataFrame:
        return components.overlaps(self.crun)

    @cached_property
    def body(self) -> DataFrame:
        return self.work.keep(components.bodies(self.crun, self.work), "body")

    @cached_property
    def point(self) -> DataFrame:
        return components.skeleton_points(self.skel, self.outerv, self.work)

    @cached_property
    def mapped(self) -> DataFrame:
        """(point_id, label_id, z_l0, cc_id0): the points' contours at level 0."""
        return skeleton.level0_contours(self.point, self.combined, 4, self.work, self.shape[1])

    @cached_property
    def ccvox(self) -> DataFrame:
        """Voxels of the contours of the combined labels, which are those of level 0."""
        return components.contour_voxels(self.work.keep(components.contour_runs(self.combined.select("label_id", "z", "y", "x"), self.work, self.shape[1]), "ccrun"))

    @cached_property
    def edge(self) -> DataFrame:
        return components.adjacency(self.point)

    @cached_property
    def part(self) -> DataFrame:
        """(point_id, label_id, root): 26-connected parts of the skeleton."""
        return self.work.keep(components.spatial_components(self.point, self.edge, self.work), "part")

    @cached_property
    def inst(self) -> DataFrame:
        return self.work.keep(components.instances(self.point, self.edge, self.work), "inst")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables named in braces; {vz}, {vy}, {vx} are the voxel's size and {nz}, {ny}, {nx} the shape."""
        text = with_sizes(text, self.voxel, lambda: self.shape)
        return self.spark.sql(text, **{name: getattr(self, name) for name in set(re.findall(r"\{(\w+)\}", text))})


class DerivedVolume(Volume):
    """The volume that is derived from the business tables of a folder, and these tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.labels, self.voxel = spark, sf_dir, LABELS, (VZ, VY, VX)

    @cached_property
    def outerv(self) -> DataFrame:
        return by_shuffle(volume.mask(self.spark, self.sf_dir).select("label_id", "z", "y", "x"))

    @cached_property
    def innerv(self) -> DataFrame:
        return by_shuffle(volume.mask(self.spark, self.sf_dir, shrink=2).select("label_id", "z", "y", "x"))

    @cached_property
    def skel(self) -> DataFrame:
        return by_shuffle(volume.skeleton(self.spark, self.sf_dir).select("z", "y", "x"))

    @cached_property
    def img(self) -> DataFrame:
        return volume.image(self.spark, self.sf_dir).select("z", "y", "x", "value")

    @cached_property
    def supplier(self) -> DataFrame:
        return volume.read(self.spark, self.sf_dir, "supplier")

    @cached_property
    def events(self) -> DataFrame:
        return volume.read(self.spark, self.sf_dir, "events")

    @cached_property
    def shape(self) -> tuple[int, int, int]:
        tiles = self.supplier.agg(F.expr(f"max(s_suppkey) div {volume.TILE_KEYS} + 1")).first()[0] or 0
        return tiles * volume.TILE_Z, volume.NY, volume.NX


_SHIFTS = "select a.v dz, b.v dy, c.v dx, row_number() over (order by a.v, b.v, c.v) - 1 as nth from (select unnest([-1, 0, 1]) v) a, (select unnest([-1, 0, 1]) v) b, (select unnest([-1, 0, 1]) v) c where a.v <> 0 or b.v <> 0 or c.v <> 0"


def _reach(name: str, ids: str, edges: str) -> str:
    """Least reachable id of every node, by DuckDB's keyed recursion."""
    return f"""(id, root) USING KEY (id) AS (select id, id from {ids} union select e.a, min(n.root) from {name} n join {edges} e on e.b = n.id
        join recurring.{name} cur on cur.id = e.a where n.root < cur.root group by e.a)"""


#: DuckDB text of the same tables; names in text are what each needs.
SQL = volume.SQL | {
    "label_dim": "select * from (values " + ", ".join(f"({i}, '{n}', '{c}')" for i, n, c in LABELS) + ") t(label_id, name, color)",
    "combined": "select z, y, x, max(label_id) label_id from outerv group by 1, 2, 3",
    "runs2": "select label_id, z, y, min(x) x_lo, max(x) x_hi, cast(label_id as bigint) * 1000000000000 + cast(z as bigint) * 10000 + y * 100 + min(x) id from (select *, x - row_number() over (partition by label_id, z, y order by x) g from outerv) group by label_id, z, y, g",
    "edges2": "with up as (select a.id a, b.id b from runs2 a join runs2 b on a.label_id = b.label_id and a.z = b.z and b.y = a.y + 1 where a.x_lo <= b.x_hi and b.x_lo <= a.x_hi) select a, b from up union all select b, a from up",
    "reach2": _reach("reach2", "runs2", "edges2"),
    "crun": "select r.label_id, r.z, r.y, r.x_lo, r.x_hi, cast(dense_rank() over (partition by label_id, z order by c.root) as int) cc_id from runs2 r join reach2 c using (id)",
    "cvox": "select label_id, z, cc_id, y, cast(unnest(generate_series(x_lo, x_hi)) as int) x from crun",
    "contour": """select label_id, z, cc_id, min(y) y_min, max(y) y_max, min(x) x_min, max(x) x_max, count(*) area, avg(y) centroid_y, avg(x) centroid_x,
        coalesce(avg(case when s then y end), avg(y)) marker_y, coalesce(avg(case when s then x end), avg(x)) marker_x, coalesce(bool_or(s), false) has_skeleton
        from cvox left join (select *, true s from skel) using (z, y, x) group by 1, 2, 3""",
    "dsteps": "select cast(unnest(generate_series(-3, 3)) as int) v",
    "runsc": "select label_id, z, y, min(x) x_lo, max(x) x_hi, cast(label_id as bigint) * 1000000000000 + cast(z as bigint) * 10000 + y * 100 + min(x) id from (select *, x - row_number() over (partition by label_id, z, y order by x) g from combined) group by label_id, z, y, g",
    "edgesc": "with up as (select a.id a, b.id b from runsc a join runsc b on a.label_id = b.label_id and a.z = b.z and b.y = a.y + 1 where a.x_lo <= b.x_hi and b.x_lo <= a.x_hi) select a, b from up union all select b, a from up",
    "reachc": _reach("reachc", "runsc", "edgesc"),
    "ccvox": "select label_id, z, cc_id, y, cast(unnest(generate_series(x_lo, x_hi)) as int) x from (select r.*, cast(dense_rank() over (partition by label_id, z order by c.root) as int) cc_id from runsc r join reachc c using (id))",
    "overlap": """select a.label_id, a.z, a.cc_id, b.label_id o_label_id, b.cc_id o_cc_id, count(*) area, d.v dir from cvox a, (values (-1), (1)) d(v), cvox b
        where b.z = a.z + d.v and a.y = b.y and a.x = b.x group by 1, 2, 3, 4, 5, 7""",
    "depth": f"select (max(s_suppkey) // {volume.TILE_KEYS} + 1) * {volume.TILE_Z} as nz from supplier",
    "best": "select label_id, z, cc_id, dir, o_label_id, o_cc_id from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, case when label_id = o_label_id then 0 else 1 end, o_label_id, o_cc_id) nth from overlap) o where nth = 1",
    "best_same": "select label_id, z, cc_id, dir, o_cc_id from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, o_cc_id) nth from overlap where label_id = o_label_id) o where nth = 1",
    "clicks": "select event_id, user_id, ts, cast(event_id % 20 as int) z, cast((event_id * 7) % 48 as int) y, cast((user_id * 13) % 48 as int) x, cast(1 + event_id % 4 as int) label_id from events",
    "nodes3": "select distinct label_id, z, cc_id, cast(label_id as bigint) * 1099511627776 + cast(z as bigint) * 1048576 + cc_id id from crun",
    "edges3": "select cast(label_id as bigint) * 1099511627776 + cast(z as bigint) * 1048576 + cc_id a, cast(o_label_id as bigint) * 1099511627776 + cast(z + dir as bigint) * 1048576 + o_cc_id b from overlap where label_id = o_label_id",
    "reach3": _reach("reach3", "nodes3", "edges3"),
    "body": "select label_id, z, cc_id, cast(dense_rank() over (partition by label_id order by root) as int) comp_id from nodes3 join reach3 using (id)",
    "point": "select row_number() over (order by z, y, x) - 1 point_id, z, y, x, label_id from (select z, y, x, coalesce(min(label_id), 0) label_id from skel left join outerv using (z, y, x) group by 1, 2, 3)",
    "shifts": _SHIFTS,
    "shifted": "select p.point_id a, p.z + dz z, p.y + dy y, p.x + dx x, nth, dz, dy, dx from point p, shifts",
    "edge": "select a, q.point_id b, cast(nth as int) ord, dz, dy, dx from shifted s join point q using (z, y, x)",
    "idsp": "select point_id id from point",
    "reachp": _reach("reachp", "idsp", "edge"),
    "part": "select point_id, label_id, root from point join reachp on id = point_id",
    "edgel": "select e.a, e.b from edge e join point p on p.point_id = e.a join point q on q.point_id = e.b where p.label_id = q.label_id and p.label_id > 0",
    "reachl": _reach("reachl", "idsp", "edgel"),
    "inst": "select point_id, label_id, case when label_id = 0 then -1 else dense_rank() over (order by case when label_id = 0 then 1 else 0 end, label_id, root) - 1 end instance_id from point join reachl on id = point_id",
}


def oracle(text: str) -> str:
    """The text with the tables it names in braces, and all that they need, in front."""
    text = with_sizes(text, (VZ, VY, VX), lambda: ("(select nz from {depth})", volume.NY, volume.NX))
    order: list[str] = []

    def need(name: str) -> None:
        if name in order or name not in SQL:
            return
        for other in re.findall(r"\w+", SQL[name]):
            if other != name:
                need(other)
        order.append(name)

    for name in re.findall(r"\{(\w+)\}", text):
        need(name)
    body = re.sub(r"\{(\w+)\}", r"\1", text)
    if not order:
        return body
    if body.lstrip().lower().startswith("with"):
        body = f"select * from ({body}) q"
    parts = [f"{n}{SQL[n]}" if SQL[n].startswith("(id") else f"{n} AS MATERIALIZED ({SQL[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
