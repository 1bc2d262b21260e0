"""Queries of what follows contours through the slices, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import brush, nearest, paths, skeleton, surface, tracking
from lamina.operators import rays as rays_operator
from lamina.operators.volume_tables import DerivedVolume
from lamina.registry import both, register
from lamina.streaming import processors

#: Milliseconds after which an idle user's state goes: longer than the events last, as the SQL forgets nobody.
IDLE = 10_000 * 86_400_000


def clicks(v: DerivedVolume) -> DataFrame:
    """Clicks of the event table at a voxel of one label."""
    return v.events.selectExpr("event_id", "user_id", "ts", "cast(event_id % 20 as int) as z", "cast((event_id * 7) % 48 as int) as y", "cast((user_id * 13) % 48 as int) as x", "cast(1 + event_id % 4 as int) as label_id")


def _hits(v: DerivedVolume) -> DataFrame:
    return clicks(v).join(v.cvox, ["label_id", "z", "y", "x"])


def _best(v: DerivedVolume, same_label: bool = False) -> DataFrame:
    return v.work.keep(paths.best_overlap(v.overlap, same_label), "best_same" if same_label else "best")


#: DuckDB: the contours on the any-label path of every contour, a slice a step.
_LAYERS = """layers as (with recursive walk(s_label, s_z, s_cc, dir, label_id, z, cc_id) as (
        select label_id, z, cc_id, d.v, label_id, z, cc_id from {contour}, (values (-1), (1)) d(v)
        union all select w.s_label, w.s_z, w.s_cc, w.dir, b.o_label_id, w.z + w.dir, b.o_cc_id from walk w join {best} b on b.label_id = w.label_id and b.z = w.z and b.cc_id = w.cc_id and b.dir = w.dir)
    select distinct s_label, s_z, s_cc, label_id, z, cc_id from walk)"""


def with_layers(text: str) -> str:
    return f"with {_LAYERS} {text}"


def _plain(text: str, columns: str) -> str:
    return f"select {columns} from ({with_layers(text)}) p"


def _moves(v: DerivedVolume) -> DataFrame:
    return clicks(v).join(v.cvox, ["label_id", "z", "y", "x"], "left").selectExpr("event_id as move_id", "label_id", "z", "cc_id", "cast((event_id * 3) % 20 as int) as to_z")


register(
    "G5",
    lambda v: tracking.crossed_boundary(_moves(v), _best(v), v.work),
    _plain(
        """select m.event_id as move_id, case when m.cc_id is null then false else exists (
            select 1 from (select unnest(generate_series(0, 19)) zz) s where s.zz between least(m.z, m.to_z) and greatest(m.z, m.to_z) and s.zz <> m.z
            and not exists (select 1 from layers l where l.s_label = m.label_id and l.s_z = m.z and l.s_cc = m.cc_id and l.z = s.zz and l.label_id = m.label_id)) end as crossed
        from (select k.*, c.cc_id, cast((k.event_id * 3) % 20 as int) to_z from {clicks} k left join {cvox} c using (label_id, z, y, x)) m""",
        "move_id, crossed",
    ),
)


def _events(v: DerivedVolume) -> DataFrame:
    """Every fifth event is a click, which counts if it hits; the others change the slice."""
    own = clicks(v).withColumn("z_l0", F.expr("case when event_id % 5 = 0 then null else cast((event_id * 7) % 80 as int) end"))
    hit = own.where("event_id % 5 = 0").select("event_id", "label_id", "z", "y", "x").join(v.cvox, ["label_id", "z", "y", "x"]).select("event_id", "cc_id")
    return own.join(hit, "event_id", "left").where("z_l0 is not null or cc_id is not null").select("event_id", "user_id", "ts", "z_l0", "label_id", "z", "cc_id")


_STEPS = _plain(
    """, e as (select k.event_id, k.user_id, k.ts, case when k.event_id % 5 = 0 then k.z else ((k.event_id * 7) % 80) // 4 end zz, k.event_id % 5 = 0 as click, k.label_id, k.z, c.cc_id
            from {clicks} k left join {cvox} c on c.label_id = k.label_id and c.z = k.z and c.y = k.y and c.x = k.x where k.event_id % 5 <> 0 or c.cc_id is not null),
        s as (select *, count(*) filter (click) over o as n, last_value(case when click then label_id end ignore nulls) over o sl, last_value(case when click then z end ignore nulls) over o sz, last_value(case when click then cc_id end ignore nulls) over o sc
            from e window o as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
        p as (select s.*, l.label_id as on_path from s left join layers l on l.s_label = s.sl and l.s_z = s.sz and l.s_cc = s.sc and l.z = s.zz),
        b as (select *, lag(zz) over w as zz0, last_value(on_path ignore nulls) over (partition by user_id, n order by ts, event_id rows between unbounded preceding and 1 preceding) as label0
            from p window w as (partition by user_id, n order by ts, event_id))
        select event_id, case when click then 'tracked' when n = 0 then 'untracked' when zz = zz0 then 'same layer' when on_path is null then 'out of path' when on_path <> label0 then 'label changed'
            when exists (select 1 from (select unnest(generate_series(0, 19)) t) r where r.t between least(zz, zz0) and greatest(zz, zz0) and r.t <> zz0
                and not exists (select 1 from layers l where l.s_label = sl and l.s_z = sz and l.s_cc = sc and l.z = r.t and l.label_id = on_path)) then 'instance changed' else 'moved' end as step from b""",
    "event_id, step",
)
register("G15", lambda v: tracking.tracking_steps(_events(v), _best(v), v.work), _STEPS)


def _tracked_stream(v: DerivedVolume) -> DataFrame:
    """The same events as a stream of files, followed to its end."""
    events = v.work.keep(_events(v), "tracked_events")
    layers = paths.path_layers(events.where("cc_id is not null"), _best(v), v.work).groupBy(F.col("s_label").alias("label_id"), F.col("s_z").alias("z"), F.col("s_cc").alias("cc_id")).agg(F.collect_list(F.struct("z", "label_id")).alias("path"))  # one for each slice
    rows = v.work.keep(events.join(layers, ["label_id", "z", "cc_id"], "left").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "z_l0", "z", "path"), "stream")
    stream = v.spark.readStream.schema(rows.schema).parquet(v.work.path("stream")).withWatermark("ts", "1 day")
    return _streamed(v, processors.tracking_stream(stream, IDLE), "steps")


def _streamed(v: DerivedVolume, rows: DataFrame, name: str) -> DataFrame:
    """What a stream has written when it has come to its end."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key)
    processors.rocksdb(v.spark)
    try:
        _written(v, rows, name)
    finally:
        v.spark.conf.set(key, before)
    return v.spark.read.schema(rows.schema).parquet(v.work.path(name))


def _written(v: DerivedVolume, rows: DataFrame, name: str) -> None:
    rows.writeStream.format("parquet").option("path", v.work.path(name)).option("checkpointLocation", v.work.path(f"{name}_state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def delays_stream(v: DerivedVolume) -> DataFrame:
    events = v.work.keep(v.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "scrolls")
    stream = v.spark.readStream.schema(events.schema).parquet(v.work.path("scrolls")).withWatermark("ts", "1 day")
    return _streamed(v, processors.delays_stream(stream, IDLE), "delays")


register("T4", _tracked_stream, _STEPS)


def _selection(v: DerivedVolume) -> DataFrame:
    """Contours at every third point of each skeleton part: a selection with gaps."""
    return v.point.where("point_id % 3 = 0").join(v.part.select("point_id", F.col("root").alias("selection_id")), "point_id").join(v.cvox, ["label_id", "z", "y", "x"]).select("selection_id", "z", "label_id", "cc_id").distinct()


_SELECTION = "sel as (select distinct r.root as selection_id, p.z, p.label_id, c.cc_id from {point} p join (select point_id, root from {part}) r using (point_id) join {cvox} c using (label_id, z, y, x) where p.point_id % 3 = 0)"
_GAPS = "gaps as (select selection_id, unnest(generate_series(min(z), max(z))) as z from sel group by selection_id except select selection_id, z from sel)"
register("U3", lambda v: tracking.missing_slices(_selection(v)), f"select selection_id, cast(z as int) as z from (with {_SELECTION}, {_GAPS} select * from gaps) g")
register("O6", lambda v: tracking.missing_slices(_selection(v)).orderBy("selection_id", "z"), f"select selection_id, cast(z as int) as z from (with {_SELECTION}, {_GAPS} select * from gaps) g order by selection_id, z")
register(
    "G4",
    lambda v: tracking.fill_gaps(_selection(v), _best(v, same_label=True), v.work),
    f"""select * from (with recursive {_SELECTION}, {_GAPS},
        ahead(selection_id, z, label_id, cc_id) as (
            select s.selection_id, cast(s.z + 1 as int), s.label_id, b.o_cc_id from sel s join {{best_same}} b on b.label_id = s.label_id and b.z = s.z and b.cc_id = s.cc_id and b.dir = 1 join gaps g on g.selection_id = s.selection_id and g.z = s.z + 1
            union select a.selection_id, cast(a.z + 1 as int), a.label_id, b.o_cc_id from ahead a join {{best_same}} b on b.label_id = a.label_id and b.z = a.z and b.cc_id = a.cc_id and b.dir = 1 join gaps g on g.selection_id = a.selection_id and g.z = a.z + 1)
        select selection_id, z, label_id, cc_id from ahead
        union select s.selection_id, cast(s.z - 1 as int), s.label_id, b.o_cc_id from sel s join {{best_same}} b on b.label_id = s.label_id and b.z = s.z and b.cc_id = s.cc_id and b.dir = -1 join gaps g on g.selection_id = s.selection_id and g.z = s.z - 1
            where not exists (select 1 from ahead a where a.selection_id = s.selection_id and a.z = s.z - 1)) f""",
)


def _path_masks(v: DerivedVolume, margin: int = 20) -> DataFrame:
    """Outer and inner voxels of the path of each label's largest contour, moved into the box around it."""
    largest = v.contour.groupBy("label_id").agg(F.min(F.struct(-F.col("area"), "z", "cc_id")).alias("m")).select("label_id", "m.z", "m.cc_id")
    layers = v.work.keep(paths.path_layers(largest, _best(v), v.work), "mask_layers")
    _, ny, nx = v.shape
    box = layers.join(v.contour, ["label_id", "z", "cc_id"]).groupBy("s_label").agg(F.greatest(F.lit(0), F.min("y_min") - margin).alias("y0"), F.least(F.lit(ny), F.max("y_max") + margin).alias("y1"), F.greatest(F.lit(0), F.min("x_min") - margin).alias("x0"), F.least(F.lit(nx), F.max("x_max") + margin).alias("x1"))
    voxels = layers.join(v.cvox, ["label_id", "z", "cc_id"]).join(F.broadcast(box), "s_label").where("y >= y0 and y < y1 and x >= x0 and x < x1")  # a box for each label
    inner = v.innerv.select("label_id", "z", "y", "x", F.lit(True).alias("inside"))
    return voxels.join(inner, ["label_id", "z", "y", "x"], "left").select("s_label", "label_id", "z", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.coalesce("inside", F.lit(False)).alias("is_inner"))


register(
    "G10",
    _path_masks,
    _plain(
        """, top as (select label_id, z, cc_id from (select *, row_number() over (partition by label_id order by area desc, z, cc_id) nth from {contour}) c where nth = 1),
        mine as (select l.* from layers l join top t on t.label_id = l.s_label and t.z = l.s_z and t.cc_id = l.s_cc),
        box as (select m.s_label, greatest(0, min(y_min) - 20) y0, least(48, max(y_max) + 20) y1, greatest(0, min(x_min) - 20) x0, least(48, max(x_max) + 20) x1 from mine m join {contour} c using (label_id, z, cc_id) group by m.s_label)
        select m.s_label, m.label_id, m.z, x.y - y0 as y, x.x - x0 as x, i.z is not null as is_inner from mine m join {cvox} x using (label_id, z, cc_id) join box b on b.s_label = m.s_label
        left join {innerv} i on i.label_id = m.label_id and i.z = m.z and i.y = x.y and i.x = x.x where x.y >= y0 and x.y < y1 and x.x >= x0 and x.x < x1""",
        "s_label, label_id, z, y, x, is_inner",
    ),
)
register(
    "G13",
    # where level 0 has no contour near, the contour of the masks' own level is shown, made larger
    lambda v: tracking.level0_at_cursor(v.contour, v.ccvox, 4, v.shape[1:]).withColumn("l2_cc", F.when(F.col("l0_cc0") < 0, F.col("cc_id")).otherwise(0)),
    """select label_id, z, cc_id, coalesce(l0, 0) - 1 as l0_cc0, case when l0 is null then cc_id else 0 end as l2_cc from {contour} left join (select *, row_number() over (partition by label_id, z, cc_id order by d2, ny, nx) nth from (
        select c.label_id, c.z, c.cc_id, v.cc_id as l0, ny.v as ny, nx.v as nx, (ny.v - py) * (ny.v - py) + (nx.v - px) * (nx.v - px) as d2
        from (select label_id, z, cc_id, greatest(0, least(191, cast(round_even(centroid_y * 4, 0) as int))) py, greatest(0, least(191, cast(round_even(centroid_x * 4, 0) as int))) px from {contour}) c
        join {ccvox} v on v.label_id = c.label_id and v.z = c.z, lateral (select unnest(generate_series(v.y * 4, v.y * 4 + 3)) v) ny, lateral (select unnest(generate_series(v.x * 4, v.x * 4 + 3)) v) nx
        where ny.v between py - 20 and py + 20 and nx.v between px - 20 and px + 20) d) r using (label_id, z, cc_id) where coalesce(nth, 1) = 1""",
)
register(
    "G14",
    lambda v: tracking.ring_search(clicks(v).withColumnRenamed("event_id", "click_id"), v.cvox),
    """select click_id, ring, y, x, cc_id from (select k.event_id as click_id, greatest(abs(c.y - k.y), abs(c.x - k.x)) as ring, c.y, c.x, c.cc_id,
        row_number() over (partition by k.event_id order by greatest(abs(c.y - k.y), abs(c.x - k.x)), c.y, c.x) nth from {clicks} k join {cvox} c on c.label_id = k.label_id and c.z = k.z
        where greatest(abs(c.y - k.y), abs(c.x - k.x)) between 1 and 20) r where nth = 1""",
)


def _markers(v: DerivedVolume) -> DataFrame:
    """Markers of the contours that clicks hit, in micrometres."""
    vz, vy, vx = v.voxel
    hit = _hits(v).select("label_id", "z", "cc_id").distinct()
    marked = hit.join(v.contour, ["label_id", "z", "cc_id"]).select("label_id", "z", "cc_id", (F.col("z") * vz).alias("wz"), (F.col("marker_y") * vy).alias("wy"), (F.col("marker_x") * vx).alias("wx"))
    return marked.withColumn("query_id", F.struct("label_id", "z", "cc_id"))


def _snapped(v: DerivedVolume) -> DataFrame:
    """Every event's point: the one nearest its tracked contour's marker, or point 0 where it tracks none."""
    found = nearest.nearest(_markers(v), v.point, v.voxel, v.work).select("query_id.*", F.col("point_id"))
    events = clicks(v).join(v.cvox, ["label_id", "z", "y", "x"], "left").select("event_id", "label_id", "z", "cc_id")
    return events.join(found, ["label_id", "z", "cc_id"], "left").select("event_id", F.coalesce("point_id", F.lit(0)).cast("long").alias("point_id"))


register(
    "G22",
    _snapped,
    """select k.event_id, coalesce(n.point_id, 0) as point_id from {clicks} k left join {cvox} c using (label_id, z, y, x) left join (
        select label_id, z, cc_id, point_id from (select h.label_id, h.z, h.cc_id, p.point_id, row_number() over (partition by h.label_id, h.z, h.cc_id order by power(h.z * 2e0 - p.z * 2e0, 2) + power(h.marker_y * 1e0 - p.y * 1e0, 2) + power(h.marker_x * 0.5e0 - p.x * 0.5e0, 2), p.point_id) nth
        from (select * from {contour} semi join (select distinct label_id, z, cc_id from {clicks} join {cvox} using (label_id, z, y, x)) t using (label_id, z, cc_id)) h, {point} p) r where nth = 1) n
        on n.label_id = c.label_id and n.z = c.z and n.cc_id = c.cc_id""",
)


def _centre_points(v: DerivedVolume) -> DataFrame:
    """The point nearest each label's centre; if it isn't of the label, the label's least point."""
    vz, vy, vx = v.voxel
    own = v.point.where("label_id > 0").groupBy(F.col("label_id").alias("query_id")).agg(F.avg(F.col("z") * vz).alias("wz"), F.avg(F.col("y") * vy).alias("wy"), F.avg(F.col("x") * vx).alias("wx"), F.min("point_id").alias("least"))
    own = v.work.keep(own, "centres")
    found = nearest.nearest(own, v.point, v.voxel, v.work).join(v.point.select("point_id", "label_id"), "point_id")
    return own.join(found, "query_id").select(F.col("query_id").alias("label_id"), F.round("wz", 6).alias("wz"), F.round("wy", 6).alias("wy"), F.round("wx", 6).alias("wx"), F.when(F.col("label_id") == F.col("query_id"), F.col("point_id")).otherwise(F.col("least")).alias("point_id"))


register(
    "A15",
    _centre_points,
    """select label_id, round(wz, 6) as wz, round(wy, 6) as wy, round(wx, 6) as wx, case when found_label = label_id then found else least_id end as point_id from (
        select m.label_id, m.wz, m.wy, m.wx, m.least_id, p.point_id as found, p.label_id as found_label, row_number() over (partition by m.label_id order by power(p.z * 2e0 - wz, 2) + power(p.y * 1e0 - wy, 2) + power(p.x * 0.5e0 - wx, 2), p.point_id) nth
        from (select label_id, avg(z * 2e0) wz, avg(y * 1e0) wy, avg(x * 0.5e0) wx, min(point_id) least_id from {point} where label_id > 0 group by label_id) m, {point} p) r where nth = 1""",
)
register("P15_edges", lambda v: skeleton.sample_edges(v.point, v.edge, 3, v.work), """
    with kept as (select row_number() over (order by point_id) - 1 as new_id, point_id from (select point_id, count(b) as degree from {point} left join {edge} on a = point_id group by point_id) g where degree = 1 or degree >= 3 or point_id % 3 = 0)
    select k.new_id as node_a, m.new_id as node_b, round(sqrt(dz * dz * 4.0e0 + dy * dy * 1.0e0 + dx * dx * 0.25e0), 6) as distance_um, count(*) over (partition by k.new_id) as degree
    from {edge} e join kept k on k.point_id = e.a join kept m on m.point_id = e.b""")


def _brush_pairs(v: DerivedVolume) -> DataFrame:
    """From every point to the last one of its part."""
    roots = v.part.select("point_id", "root")
    ends = roots.groupBy("root").agg(F.max("point_id").alias("to_id"))
    return roots.join(ends, "root").where("point_id < to_id").select(F.col("point_id").alias("pair_id"), F.col("point_id").alias("from_id"), "to_id")


register("G7", lambda v: brush.fill_paths(_brush_pairs(v), v.edge, v.work).select("from_id", "to_id", "place", "point_id"))


def _strokes(v: DerivedVolume) -> DataFrame:
    """Brush events at the points nearest to the clicks' places."""
    vz, vy, vx = v.voxel
    places = clicks(v).select(F.col("event_id").alias("query_id"), (F.col("z") * vz).alias("wz"), (F.col("y") * vy).alias("wy"), (F.col("x") * vx).alias("wx"))
    picked = v.work.keep(nearest.nearest(places, v.point, v.voxel, v.work).where("point_id is not null"), "picked")
    return v.events.select("event_id", "user_id", "ts").join(picked.select(F.col("query_id").alias("event_id"), "point_id"), "event_id")


def _hidden(v: DerivedVolume) -> DataFrame:
    """Points of parts of fewer than 5 points, which the size filter hides."""
    return v.part.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n < 5").join(v.part, "root").select("point_id")


_CAMERA = {"z": "event_id % 90 - 45", "y": "event_id % 130 - 40", "x": "user_id % 60 - 20"}


def _view_rays(v: DerivedVolume) -> DataFrame:
    """For each event the nearest visible skeleton point to the ray from its camera through its click."""
    vz, vy, vx = v.voxel
    rays = clicks(v).selectExpr("event_id as ray_id", *(f"cast({e} as double) as o{c}" for c, e in _CAMERA.items()), f"z * {vz} as tz", f"y * {vy} as ty", f"x * {vx} as tx")
    seen = v.point.join(_hidden(v), "point_id", "left_anti")
    found = rays_operator.nearest_to_rays(rays, seen, v.voxel, v.work)
    return found.select("ray_id", "point_id", F.round("dist", 6).alias("dist"))


register("J15_rays", _view_rays, """
    with seen as (select * from {point} where point_id not in (select point_id from {part} where root in (select root from {part} group by root having count(*) < 5))),
    rays as (select event_id as ray_id, """ + ", ".join(f"cast({e} as double) as o{c}" for c, e in _CAMERA.items()) + """, z * 2e0 as tz, y * 1e0 as ty, x * 0.5e0 as tx from {clicks}),
    told as (select *, sqrt(power(tz - oz, 2) + power(ty - oy, 2) + power(tx - ox, 2)) as len from rays),
    unit as (select ray_id, oz, oy, ox, case when len > 0 then (tz - oz) / len end as dz, case when len > 0 then (ty - oy) / len end as dy, case when len > 0 then (tx - ox) / len end as dx from told),
    off as (select ray_id, point_id, dz, dy, dx, z * 2e0 - oz as vz, y * 1e0 - oy as vy, x * 0.5e0 - ox as vx, (z * 2e0 - oz) * dz + (y * 1e0 - oy) * dy + (x * 0.5e0 - ox) * dx as along from unit, seen where dz is not null),
    far as (select ray_id, point_id, round(sqrt(power(vz - along * dz, 2) + power(vy - along * dy, 2) + power(vx - along * dx, 2)), 9) as dist from off where along >= 0),
    near as (select ray_id, arg_min(point_id, (dist, point_id)) as point_id, min(dist) as dist from far group by ray_id)
    select u.ray_id, coalesce(n.point_id, case when u.dz is not null then (select min(point_id) from seen) end) as point_id, round(n.dist, 6) as dist from unit u left join near n using (ray_id)""")


def _replayed(v: DerivedVolume) -> DataFrame:
    return brush.replay_strokes(_strokes(v), v.point, v.part, v.edge, v.voxel, 20 * v.voxel[0], v.work, _hidden(v))


register("T3", _replayed)
register("G8", lambda v: _replayed(v).where("phase = 'drawing'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_drawn"), F.sum("n_added").alias("n_added")))

register(
    "M5",
    lambda v: surface.mesh_table(v.outerv, ["label_id"], v.voxel),
    """select label_id, n_points, n_cells, cast(0 as bigint) as open_edges from (
        with faces as (select o.label_id, f.axis, o.z + least(0, f.dz) z, o.y + least(0, f.dy) y, o.x + least(0, f.dx) x from {outerv} o, (values (0, -1, 0, 0), (0, 1, 0, 0), (1, 0, -1, 0), (1, 0, 1, 0), (2, 0, 0, -1), (2, 0, 0, 1)) f(axis, dz, dy, dx)
            where not exists (select 1 from {outerv} n where n.label_id = o.label_id and n.z = o.z + f.dz and n.y = o.y + f.dy and n.x = o.x + f.dx)),
        cells as (select distinct label_id, case when axis = 0 then z else z + a.v end cz, case when axis = 1 then y when axis = 0 then y + a.v else y + b.v end cy, case when axis = 2 then x else x + b.v end cx
            from faces, (values (-1), (0)) a(v), (values (-1), (0)) b(v))
        select p.label_id, p.n_points, q.n_cells from (select label_id, count(*) n_points from cells group by label_id) p join (select label_id, 2 * count(*) n_cells from faces group by label_id) q using (label_id)) m""",
)
register(
    "M1_mesh",
    lambda v: surface.vertices(surface.quads(v.outerv, ["label_id"]), ["label_id"], v.voxel).select("label_id", "cz", "cy", "cx", *(F.round(c, 6).alias(c) for c in ("vx", "vy", "vz")), "n_faces"),
    """with faces as (select o.label_id, f.axis, o.z + least(0, f.dz) z, o.y + least(0, f.dy) y, o.x + least(0, f.dx) x from {outerv} o, (values (0, -1, 0, 0), (0, 1, 0, 0), (1, 0, -1, 0), (1, 0, 1, 0), (2, 0, 0, -1), (2, 0, 0, 1)) f(axis, dz, dy, dx)
        where not exists (select 1 from {outerv} n where n.label_id = o.label_id and n.z = o.z + f.dz and n.y = o.y + f.dy and n.x = o.x + f.dx))
    select label_id, cz, cy, cx, round(avg((x + case when axis = 2 then 0.5e0 else 0 end) * 0.5e0), 6) as vx, round(avg((y + case when axis = 1 then 0.5e0 else 0 end) * 1e0), 6) as vy, round(avg((z + case when axis = 0 then 0.5e0 else 0 end) * 2e0), 6) as vz, count(*) as n_faces
    from (select *, case when axis = 0 then z else z + a.v end cz, case when axis = 1 then y when axis = 0 then y + a.v else y + b.v end cy, case when axis = 2 then x else x + b.v end cx from faces, (values (-1), (0)) a(v), (values (-1), (0)) b(v)) c group by label_id, cz, cy, cx""",
)
register(
    "M6_outline",
    lambda v: surface.outlines(v.cvox),
    """select label_id, z, cc_id, place, cy, cx from (with recursive steps as (
            select o.label_id, o.z, o.cc_id, o.y + f.sy as cy, o.x + f.sx as cx, f.dy, f.dx from {cvox} o, (values (-1, 0, 0, 0, 0, 1), (1, 0, 1, 1, 0, -1), (0, -1, 1, 0, -1, 0), (0, 1, 0, 1, 1, 0)) f(ny, nx, sy, sx, dy, dx)
            where not exists (select 1 from {cvox} n where n.label_id = o.label_id and n.cc_id = o.cc_id and n.z = o.z and n.y = o.y + f.ny and n.x = o.x + f.nx)),
        start as (select label_id, z, cc_id, min(cy * 100000 + cx) // 100000 as cy0, min(cy * 100000 + cx) % 100000 as cx0 from steps group by label_id, z, cc_id),
        walk(label_id, z, cc_id, cy0, cx0, place, cy, cx, dy, dx) as (
            select label_id, z, cc_id, cy0, cx0, 0, cy0, cx0, 0, 1 from start
            union all select * from (select w.label_id, w.z, w.cc_id, w.cy0, w.cx0, w.place + 1 as place, w.cy + w.dy as ny, w.cx + w.dx as nx, s.dy as sdy, s.dx as sdx from walk w join steps s on s.label_id = w.label_id and s.z = w.z and s.cc_id = w.cc_id and s.cy = w.cy + w.dy and s.cx = w.cx + w.dx
                where (w.cy + w.dy <> w.cy0 or w.cx + w.dx <> w.cx0)
                qualify row_number() over (partition by w.label_id, w.z, w.cc_id order by case when s.dy = w.dx and s.dx = -w.dy then 0 when s.dy = w.dy and s.dx = w.dx then 1 else 2 end) = 1) n)
        select label_id, z, cc_id, place, cast(cy as int) as cy, cast(cx as int) as cx from walk) o""",
)
both("M2", """select i.instance_id, i.label_id, count(*) as n_voxels, count(n.z) as n_inner, greatest(0, min(i.z_lo) - 1) as z_min, max(i.z_hi) + 2 as z_end from (
        select i.instance_id, p.label_id, c.z, c.cc_id, min(p.z) over (partition by i.instance_id) as z_lo, max(p.z) over (partition by i.instance_id) as z_hi, row_number() over (partition by i.instance_id, c.z, c.cc_id order by p.point_id) as nth
        from {inst} i join {point} p on p.point_id = i.point_id join {cvox} c on c.label_id = p.label_id and c.z = p.z and c.y = p.y and c.x = p.x where i.instance_id >= 0) i
    join {cvox} v on v.label_id = i.label_id and v.z = i.z and v.cc_id = i.cc_id left join {innerv} n on n.label_id = v.label_id and n.z = v.z and n.y = v.y and n.x = v.x where i.nth = 1 group by i.instance_id, i.label_id""")
