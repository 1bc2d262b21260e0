"""The registered queries over volumes, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import geometry, nearest, numbering, paths, skeleton
from lamina.operators.volume_tables import Volume
from lamina.registry import ORACLES, QUERIES, both, register
from lamina.streaming import replay

FLAGSHIP = "G2"

both("C1", "select label_id, z, cc_id, y, x_lo, x_hi from {crun}")
both("A1", "select label_id, z, cc_id, y_min, y_max, x_min, x_max, area, round(centroid_y, 6) as centroid_y, round(centroid_x, 6) as centroid_x from {contour}")
both("C2", "select label_id, z, cc_id, comp_id from {body}")
both("J4", "select label_id, z, cc_id, o_label_id, o_cc_id, dir, area from {overlap}")
both("C3", "select point_id, root from {part}")
both("C4", "select point_id, label_id, instance_id from {inst}")
both("J6", "select a, b, ord from {edge}")
both("A2", "select label_id, z, cc_id, round(marker_x * {vx}, 6) as world_x, round(marker_y * {vy}, 6) as world_y, round(z * {vz}, 6) as world_z, has_skeleton from {contour}")
both("A3", "select label_id, o_label_id, cast(sum(area) as bigint) as area, count(*) as n from {overlap} where dir = 1 group by label_id, o_label_id")
both("A6", "select label_id, comp_id, cast(sum(area) as bigint) as voxel_count, min(z) as z_min, max(z) as z_max from {body} join {contour} using (label_id, z, cc_id) group by label_id, comp_id")
both("A7", "select root, count(*) as n, max(label_id) as most_label from {part} group by root")
both("A9", "select count(*) as n_nodes, sum(degree) / 2 as n_edges, cast(sum(case when degree = 1 then 1 else 0 end) as bigint) as n_ends, cast(sum(case when degree >= 3 then 1 else 0 end) as bigint) as n_forks, round(sum(length) / 2, 6) as total_length from (select point_id, count(b) as degree, coalesce(sum(sqrt(dz * dz * {vz} * {vz} + dy * dy * {vy} * {vy} + dx * dx * {vx} * {vx})), 0) as length from {point} left join {edge} on a = point_id group by point_id) g")
both("A13", "select label_id, z, cc_id, area from (select *, row_number() over (partition by label_id, z order by area desc, cc_id) as nth from {contour}) c where nth = 1")
both("A14", "select z, y, x, label_id, n from (select *, row_number() over (partition by z, y, x order by n desc, label_id) as nth from (select z div 4 as z, y div 4 as y, x div 4 as x, label_id, count(*) as n from {combined} group by 1, 2, 3, 4) b) c where nth = 1")
both("A17", "select d.label_id, count(z) as n_outer, count(z) > 0 as has_mask from {label_dim} d left join {outerv} o on o.label_id = d.label_id group by d.label_id")
both("A18", "select label_id, count(distinct z) as n_slices, count(*) as n_contours, cast(sum(area) as bigint) as area from {contour} group by label_id")
both("A19", "select label_id, min(x) * {vx} as x0, max(x) * {vx} as x1, min(y) * {vy} as y0, max(y) * {vy} as y1, min(z) * {vz} as z0, max(z) * {vz} as z1, round(sqrt(power((max(x) - min(x)) * {vx}, 2) + power((max(y) - min(y)) * {vy}, 2) + power((max(z) - min(z)) * {vz}, 2)), 6) as diagonal from {outerv} group by label_id")
both("J1", "select z, y, x, label_id from {point}")
both("J2", "select z, y, x, label_id from {combined}")
both("J3", "select c.label_id, c.z, c.cc_id, count(s.x) as n_skel from {cvox} c left join (select z, y, x from {skel}) s on s.z = c.z and s.y = c.y and s.x = c.x group by c.label_id, c.z, c.cc_id")
both("J5", "select b.label_id, b.comp_id, count(*) as n_inner from {innerv} i join {cvox} c on c.label_id = i.label_id and c.z = i.z and c.y = i.y and c.x = i.x join {body} b on b.label_id = c.label_id and b.z = c.z and b.cc_id = c.cc_id group by b.label_id, b.comp_id")
_CLICKS = "(select event_id, cast(event_id % 20 as int) as z, cast((event_id * 7) % 48 as int) as y, cast((user_id * 13) % 48 as int) as x, cast(1 + event_id % 4 as int) as label_id from {events})"
both("J7", f"select k.event_id, c.cc_id - 1 as cc_id0 from {_CLICKS} k left join {{cvox}} c on c.label_id = k.label_id and c.z = k.z and c.y = k.y and c.x = k.x")
both("J8", f"select k.event_id, round(m.marker_y, 6) as marker_y, round(m.marker_x, 6) as marker_x, m.has_skeleton from {_CLICKS} k join {{cvox}} c on c.label_id = k.label_id and c.z = k.z and c.y = k.y and c.x = k.x join {{contour}} m on m.label_id = c.label_id and m.z = c.z and m.cc_id = c.cc_id")
both("J9", "select label_id, z, cc_id - 1 as cc_id0, comp_id - 1 as comp_id0 from {body}")
both("J10", "select b.label_id, b.z, b.cc_id - 1 as cc_id0, concat('cc_', lpad(cast(b.comp_id as string), 4, '0'), '_outer.vtk') as mesh from {body} b join (select label_id, comp_id from {body} join {contour} using (label_id, z, cc_id) group by label_id, comp_id having cast(sum(area) as bigint) >= 10) m on m.label_id = b.label_id and m.comp_id = b.comp_id")
both("J11", "select d.name, m.comp_id from {label_dim} d join (select label_id, comp_id from {body} join {contour} using (label_id, z, cc_id) group by label_id, comp_id having cast(sum(area) as bigint) >= 10) m on m.label_id = d.label_id")
both("J12", "select p.point_id, i.instance_id, g.n as instance_points from {point} p join {inst} i on i.point_id = p.point_id left join (select instance_id, count(*) as n from {inst} where instance_id >= 0 group by instance_id) g on g.instance_id = i.instance_id")
both("J16", "select label_id, min(sqrt(greatest(0.0e0, x * x * {vx} * {vx} + y * y * {vy} * {vy} + z * z * {vz} * {vz} - power(x * {vx} * 0.6e0 + z * {vz} * 0.8e0, 2)))) <= 0.1e0 * least((max(x) - min(x)) * {vx}, (max(y) - min(y)) * {vy}, (max(z) - min(z)) * {vz}) as accepted from {outerv} group by label_id")
both("J17", "select s_suppkey, label_id, cc_id from (select s.s_suppkey, c.label_id, c.cc_id, row_number() over (partition by s.s_suppkey order by round(power(c.marker_y - s.cy, 2) + power(c.marker_x - s.cx, 2), 9), c.label_id, c.cc_id) as nth from (select s_suppkey, cast((s_suppkey * 29) % 20 + (s_suppkey div 100) * 20 as int) as z, (s_suppkey * 53) % 48 as cy, (s_suppkey * 37) % 48 as cx from {supplier}) s join {contour} c on c.z = s.z) r where nth = 1")
both("J19", "select d.name, d.color, count(*) as n from {combined} c join {label_dim} d on d.label_id = c.label_id group by d.name, d.color")
both("P1", "select z, count(*) as n from {img} where value > 0 group by z")
both("P2", "select z, y, x from {combined} where label_id = 2")
both("P3", "select point_id, z, y, x from {point}")
both("P4", "select point_id, x * {vx} as wx, y * {vy} as wy, z * {vz} as wz from {point}")
both("P5", "select s_suppkey, cast(abs(s_acctbal) / {vz} as int) as z, cast(abs(s_acctbal) / {vx} as int) as x from {supplier}", "select s_suppkey, cast(trunc(abs(s_acctbal) / {vz}) as int) as z, cast(trunc(abs(s_acctbal) / {vx}) as int) as x from {supplier}")
both("P6", "select z div 4 as z, y div 4 as y, x div 4 as x, count(*) as n from {combined} group by 1, 2, 3")
both("P7", "select label_id, z * 4 as z, cc_id, cast(centroid_y * 4 as int) as y, cast(centroid_x * 4 as int) as x from {contour}", "select label_id, z * 4 as z, cc_id, cast(trunc(centroid_y * 4) as int) as y, cast(trunc(centroid_x * 4) as int) as x from {contour}")
both("P8", "select event_id, greatest(0, least({ny} - 1, cast((event_id * 11) % 90 as int) - 20)) as y, (event_id * 11) % 90 - 20 between 0 and {ny} - 1 as inside from {events}")
both("P9", "select label_id, count(distinct z div 4) as n_slices, count(distinct z div 4) * {vz} * 4 as depth from {outerv} group by label_id")
both("P10", "select root, n, n >= 5 as shown from (select root, count(*) as n from {part} group by root) s")
both("P13", "select label_id, z, y, x from {outerv} where power(x * {vx} - 12, 2) + power(y * {vy} - 24, 2) + power(z * {vz} - 20, 2) <= 100")
both("P16", "select case when count(*) > 50 then cast(ceil(count(*) / 50.0e0) as int) else 1 end as rate from {point}")
both("S4", "select distinct value from {img}")
both("S5", "select kind, label_id, count(*) as n from (select 'outer' as kind, label_id from {outerv} union all select 'inner' as kind, label_id from {innerv}) m group by kind, label_id")
both("S12", "select z, y, x, label_id from {combined} where z between 5 and 8")
both("O2", "select label_id, row_number() over (order by label_id) as nth from (select distinct label_id from {combined}) l")
both("O3", "select n from (select root, count(*) as n from {part} group by root order by n desc, root limit 5) s")
both("O5", "select label_id, z, min(cc_id) as cc_id from {contour} group by label_id, z")
both("U1", "select z, y, x from {outerv} where label_id = 1 union select z, y, x from {outerv} where label_id = 2")
# EXCEPT and INTERSECT lose the hints of their tables, so these are joins
register("U2", lambda v: v.outerv.select("z", "y", "x").join(v.skel, ["z", "y", "x"], "left_semi").distinct(), "select z, y, x from {outerv} intersect select z, y, x from {skel}")
both("U4", "select distinct z, label_id, cc_id from {cvox}")
register("U5", lambda v: v.skel.join(v.outerv, ["z", "y", "x"], "left_anti").distinct(), "select z, y, x from {skel} except select z, y, x from {outerv}")
both("U6", "select point_id from {point} where label_id not in (1, 3)")
both("K4", "select label_id, comp_id, concat('cc_', lpad(cast(comp_id as string), 4, '0'), '_outer.vtk') as outer_file, concat('cc_', lpad(cast(comp_id as string), 4, '0'), '_inner.vtk') as inner_file from (select distinct label_id, comp_id from {body}) b")
both("K5", "select distinct cast(wz / {vz} as int) as z, cast(wy / {vy} as int) as y, cast(wx / {vx} as int) as x, 255 as value from (select z * {vz} + 0.5e0 as wz, y * {vy} + 0.25e0 as wy, x * {vx} + 0.125e0 as wx from {skel}) v", "select distinct cast(trunc(wz / {vz}) as int) as z, cast(trunc(wy / {vy}) as int) as y, cast(trunc(wx / {vx}) as int) as x, 255 as value from (select z * {vz} + 0.5e0 as wz, y * {vy} + 0.25e0 as wy, x * {vx} + 0.125e0 as wx from {skel}) v")
both("M7", "select label_id, z, cc_id, (x_min + x_max) * {vx} / 2 as center_x, (y_min + y_max) * {vy} / 2 as center_y, (x_max - x_min) * {vx} + 100 as width, (y_max - y_min) * {vy} + 100 as height from {contour}")
both("M8", "select extent, case when extent < 2000 then 300 when extent < 5000 then 500 when extent < 10000 then 1000 else 2000 end as bar from (select greatest(max(x) * {vx}, max(y) * {vy}, max(z) * {vz}) as extent from {outerv}) e")
both("M9", "select label_id, z, cc_id, round(greatest(0.2e0, least(50.0e0, 1.2e0 * 800.0e0 / (greatest(y_max - y_min + 1, x_max - x_min + 1) * 4 + 200))), 6) as zoom from {contour}")
both("M10", "select point_id, z * {vz} as plane_z, y * {vy} as plane_y, x * {vx} as plane_x, round(0.08e0 * least(mz, my, mx), 6) as arm from {point} cross join (select max(z) * {vz} as mz, max(y) * {vy} as my, max(x) * {vx} as mx from {outerv}) e")
both("M11", "select label_id, (min(x_min) + max(x_max)) * {vx} / 2 as focal_x, (min(y_min) + max(y_max)) * {vy} / 2 as focal_y, 2 * greatest((max(x_max) - min(x_min)) * {vx}, (max(y_max) - min(y_min)) * {vy}) as distance from {contour} group by label_id")
both("Q1", "select c.z, c.y, c.x, round(conv(substr(color, 2, 2), 16, 10) / 255.0e0, 6) as r, round(conv(substr(color, 4, 2), 16, 10) / 255.0e0, 6) as g, round(conv(substr(color, 6, 2), 16, 10) / 255.0e0, 6) as b from {combined} c join {label_dim} d on d.label_id = c.label_id", "select c.z, c.y, c.x, round(cast(concat('0x', substr(color, 2, 2)) as int) / 255.0e0, 6) as r, round(cast(concat('0x', substr(color, 4, 2)) as int) / 255.0e0, 6) as g, round(cast(concat('0x', substr(color, 6, 2)) as int) / 255.0e0, 6) as b from {combined} c join {label_dim} d on d.label_id = c.label_id")
both("Q3", "select z, y, x, concat('#', lower(lpad(hex(value), 2, '0')), lower(lpad(hex(255 - value), 2, '0')), '00') as color from {img}", "select z, y, x, concat('#', lower(lpad(printf('%x', value), 2, '0')), lower(lpad(printf('%x', 255 - value), 2, '0')), '00') as color from {img}")
both("Q4", "select z, y, x, round(sqrt(power(value / 255.0e0 - 0.5e0, 2) + power((255 - value) / 255.0e0 - 0.25e0, 2)), 6) as distance from {img}")
both("Q7", "select distinct concat('Label_', label_id) as name from {combined}")
both("Q9", "select point_id, concat('skeleton_cc', root, '_', name) as mesh_key, substring_index(concat('outer_', name), '_', 1) as kind from {part} p join {label_dim} d on d.label_id = p.label_id", "select point_id, concat('skeleton_cc', root, '_', name) as mesh_key, split_part(concat('outer_', name), '_', 1) as kind from {part} p join {label_dim} d on d.label_id = p.label_id")
both("Q11", "select event_id, case when value < 60 then concat(cast(cast(floor(value) as int) as string), 's') when value < 3600 then concat(cast(cast(floor(value / 60) as int) as string), 'min') else concat(cast(cast(floor(value / 3600) as int) as string), 'h') end as elapsed from {events} where value >= 0")
both("Q12", "select z, y, x, case when value > 0 then cast(floor(0.2e0 * 255) as int) else 0 end as alpha from {img}")
both("Q13", "select d.label_id, case when n > 0 then 0.2e0 else 0.8e0 end as outer_opacity, case when n > 0 then 1.0e0 else 0.0e0 end as inner_opacity from (select d.label_id, count(i.z) as n from {label_dim} d left join {innerv} i on i.label_id = d.label_id group by d.label_id) d")
# Paths, resampling, nearest points and geometry: operators in DataFrame functions, their oracles in SQL.

both("G1", """select label_id, z, cc_id, dir, o_label_id, o_cc_id, area from (select *, row_number() over (partition by label_id, z, cc_id, dir
    order by area desc, case when label_id = o_label_id then 0 else 1 end, o_label_id, o_cc_id) as nth from {overlap}) o where nth = 1""")
register(
    "G3",
    lambda v: paths.best_overlap(v.overlap, same_label=True).select("label_id", "z", "cc_id", "dir", "o_cc_id", "area"),
    "select label_id, z, cc_id, dir, o_cc_id, area from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, o_cc_id) as nth from {overlap} where label_id = o_label_id) o where nth = 1",
)


def _walk(same_label: bool) -> str:
    """DuckDB: every contour's path, one slice a step."""
    pool = "where label_id = o_label_id" if same_label else ""
    return f"""select label_id, z, cc_id, cast(min(zz) as int) as z_lo, cast(max(zz) as int) as z_hi from (
        with recursive best as (select * from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, case when label_id = o_label_id then 0 else 1 end, o_label_id, o_cc_id) nth from {{overlap}} {pool}) o where nth = 1),
        walk(label_id, z, cc_id, dir, l, zz, c) as (
            select label_id, z, cc_id, d.v, label_id, z, cc_id from {{contour}}, (values (-1), (1)) d(v)
            union all select w.label_id, w.z, w.cc_id, w.dir, b.o_label_id, w.zz + w.dir, b.o_cc_id from walk w join best b on b.label_id = w.l and b.z = w.zz and b.cc_id = w.c and b.dir = w.dir)
        select * from walk) p group by label_id, z, cc_id"""


register("G2", lambda v: paths.all_paths(v.contour, v.overlap, v.work), _walk(True))
register("G2_any_label", lambda v: paths.all_paths(v.contour, v.overlap, v.work, same_label=False), _walk(False))
register(
    "A12",
    lambda v: paths.path_boxes(v.contour, v.overlap, v.work, 20, *v.shape[1:]),
    """select s.label_id, s.z, s.cc_id, greatest(0, min(y_min) - 20) as y0, least(48, max(y_max) + 20) as y1, greatest(0, min(x_min) - 20) as x0, least(48, max(x_max) + 20) as x1 from (
        with recursive best as (select * from (select *, row_number() over (partition by label_id, z, cc_id, dir order by area desc, o_cc_id) nth from {overlap} where label_id = o_label_id) o where nth = 1),
        walk(label_id, z, cc_id, dir, zz, c) as (
            select label_id, z, cc_id, d.v, z, cc_id from {contour}, (values (-1), (1)) d(v)
            union all select w.label_id, w.z, w.cc_id, w.dir, w.zz + w.dir, b.o_cc_id from walk w join best b on b.label_id = w.label_id and b.z = w.zz and b.cc_id = w.c and b.dir = w.dir)
        select * from walk) s join {contour} c on c.label_id = s.label_id and c.z = s.zz and c.cc_id = s.c group by s.label_id, s.z, s.cc_id""",
)
both("A5", "select z div 2 as z, y div 2 as y, x div 2 as x, cast(cast(sum(value) as bigint) div 8 as int) as value from {img} group by 1, 2, 3")
register("X1", lambda v: v.mapped.select("point_id", "z_l0", "cc_id0"), """
    select p.point_id, p.z * 4 + case when p.label_id > 0 and c.label_id is distinct from p.label_id then 2 else 0 end as z_l0, coalesce(v.cc_id, 0) - 1 as cc_id0
    from {point} p left join {combined} c on c.z = p.z and c.y = p.y and c.x = p.x
    left join {ccvox} v on v.label_id = p.label_id and v.z = p.z and v.y = p.y and v.x = p.x""")
register("A11", lambda v: v.mapped.groupBy("label_id").agg(F.sum(F.when(F.col("cc_id0") >= 0, 1).otherwise(0)).alias("n_valid"), F.count(F.lit(1)).alias("n")), """
    select p.label_id, cast(sum(case when v.cc_id is null then 0 else 1 end) as bigint) as n_valid, count(*) as n
    from {point} p left join {ccvox} v on v.label_id = p.label_id and v.z = p.z and v.y = p.y and v.x = p.x group by p.label_id""")


def _centres(v: Volume) -> DataFrame:
    return v.supplier.selectExpr("s_suppkey as query_id", "((s_suppkey * 29) % 20 + (s_suppkey div 100) * 20) * 2e0 as wz", "((s_suppkey * 53) % 48) * 1e0 as wy", "((s_suppkey * 37) % 48) * 0.5e0 as wx")


def _nearest_sql(where: str) -> str:
    return f"""select query_id, point_id, round(d2, 6) as d2 from (select query_id, point_id, d2, row_number() over (partition by query_id order by d2, point_id) nth from (
        select s_suppkey query_id, point_id, power(((s_suppkey * 29) % 20 + (s_suppkey // 100) * 20) * 2e0 - z * 2e0, 2) + power((s_suppkey * 53) % 48 - y * 1e0, 2) + power(((s_suppkey * 37) % 48) * 0.5e0 - x * 0.5e0, 2) d2
        from supplier, {{point}} {where}) d) r where nth = 1"""


def _nearest(v: Volume, where: str) -> DataFrame:
    return nearest.nearest(_centres(v), v.point.where(where), (2.0, 1.0, 0.5), v.work).select("query_id", "point_id", F.round("d2", 6).alias("d2"))


register("J13", lambda v: _nearest(v, "true"), _nearest_sql(""))
register("J14", lambda v: _nearest(v, "label_id in (1, 2)"), _nearest_sql("where label_id in (1, 2)"))
register(
    "G21",
    lambda v: _nearest(v, "true").join(v.part.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n < 5").join(v.part, "root").select("point_id"), "point_id", "left_anti").select("query_id", "point_id"),
    f"select query_id, point_id from ({_nearest_sql('')}) n where point_id not in (select point_id from {{part}} where root in (select root from {{part}} group by root having count(*) < 5))",
)
register(
    "G16",
    lambda v: _nearest(v, "true").join(v.point, "point_id").where("label_id > 0").join(v.cvox, ["label_id", "z", "y", "x"], "left").selectExpr("query_id", "point_id", "label_id", "z", "coalesce(cc_id, 0) - 1 as cc_id0"),
    f"select query_id, point_id, label_id, z, coalesce(cc_id, 0) - 1 as cc_id0 from ({_nearest_sql('')}) n join {{point}} using (point_id) left join {{cvox}} using (label_id, z, y, x) where label_id > 0",
)
register("G6", lambda v: skeleton.hop_neighbourhood(v.point.where("point_id % 20 = 0"), v.edge, 15, v.work), """
    select start, point_id, cast(min(hops) as int) as hops from (with recursive reach(start, point_id, hops) as (select point_id, point_id, 0 from {point} where point_id % 20 = 0
        union select r.start, e.b, r.hops + 1 from reach r join {edge} e on e.a = r.point_id where r.hops < 15) select * from reach) h group by start, point_id""")
register("P15", lambda v: skeleton.sample_keypoints(v.point, v.edge, 3, v.work), """
    select row_number() over (order by point_id) - 1 as new_id, point_id, degree from (select point_id, count(b) as degree from {point} left join {edge} on a = point_id group by point_id) g where degree = 1 or degree >= 3 or point_id % 3 = 0""")
both("G11", "select a as node_a, b as node_b, round(sqrt(dz * dz * {vz} * {vz} + dy * dy * {vy} * {vy} + dx * dx * {vx} * {vx}), 6) as distance_um from {edge} where a < b")
both("G12", "select p.point_id, p.label_id, i.instance_id, r.root, x * {vx} as wx, y * {vy} as wy, z * {vz} as wz, coalesce(n, 0) as n_neighbours from {point} p join {inst} i on i.point_id = p.point_id join {part} r on r.point_id = p.point_id left join (select a, count(*) as n from {edge} group by a) e on e.a = p.point_id")
both("G9", "select distinct c.label_id, c.z, c.cc_id - 1 as cc_id0 from {point} p join {cvox} c on c.label_id = p.label_id and c.z = p.z and c.y = p.y and c.x = p.x")
both("A16", "select label_id, z, cc_id, greatest(100.0e0, least(500.0e0, greatest((y_max - y_min) * {vy}, (x_max - x_min) * {vx}) / 2 + 50)) as radius from {contour}")
register("D1", lambda v: geometry.dilate(v.skel, 3, [], v.shape), """
    select distinct z + a.v as z, y + b.v as y, x + c.v as x from {skel}, {dsteps} a, {dsteps} b, {dsteps} c
    where a.v * a.v + b.v * b.v + c.v * c.v <= 9 and z + a.v >= 0 and z + a.v < (select nz from {depth}) and y + b.v between 0 and 47 and x + c.v between 0 and 47""")
register("M1", lambda v: geometry.boundary_faces(v.outerv, ["label_id"]), """
    select o.label_id, o.z, o.y, o.x, f.face from {outerv} o, (values (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) f(face, dz, dy, dx)
    where not exists (select 1 from {outerv} n where n.label_id = o.label_id and n.z = o.z + dz and n.y = o.y + dy and n.x = o.x + dx)""")
register("M6", lambda v: geometry.boundary_faces(v.cvox, ["label_id", "cc_id"], geometry.FACES[2:]), """
    select o.label_id, o.cc_id, o.z, o.y, o.x, f.face from {cvox} o, (values (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) f(face, dy, dx)
    where not exists (select 1 from {cvox} n where n.label_id = o.label_id and n.cc_id = o.cc_id and n.z = o.z and n.y = o.y + dy and n.x = o.x + dx)""")
both("M4", "select b.label_id, b.comp_id, cast(sum(area) as bigint) as n_voxels, min(z) as z_min, max(z) as z_max, cast(sum(area) as bigint) >= 10 as has_mesh from {body} b join {contour} c using (label_id, z, cc_id) group by b.label_id, b.comp_id")
both("A20", "select label_id, count(*) as n_meshes, cast(sum(n) as bigint) as n_points from (select label_id, comp_id, cast(sum(area) as bigint) as n from {body} join {contour} using (label_id, z, cc_id) group by label_id, comp_id) m group by label_id")
_T1 = """select event_id, cast(c as int) as scroll_count, cast(case when gap < 50 then least(200, 100 + 10 * c) when gap < 100 then least(150, 50 + 5 * c) else greatest(16, 30 - 2 * c) end as int) as delay_ms from (
    select event_id, gap, s - least(0, min(s) over (partition by user_id order by ts, event_id)) as c from (
        select *, sum(case when gap < 50 then 2 when gap < 100 then 1 else -3 end) over (partition by user_id order by ts, event_id) as s from (
            select event_id, user_id, ts, coalesce(%s, 1000) as gap from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from {events}) e) g) h) r"""
ORACLE_T1 = _T1 % "epoch_ms(ts) - epoch_ms(before)"
both("T1", _T1 % "unix_millis(cast(ts as timestamp)) - unix_millis(cast(before as timestamp))", ORACLE_T1)
register("T2", lambda v: replay.debounced(v.events, "30 minutes"), """
    select user_id, arg_max(event_id, row(ts, event_id)) as event_id, count(*) as n from (select *, sum(case when before is null or ts - before >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from (
        select *, lag(ts) over (partition by user_id order by ts, event_id) as before from {events}) e) s group by user_id, session""")


def _ordered(df: DataFrame, order: list[str], name: str, v: Volume) -> DataFrame:
    return numbering.ordered_ids(df, order, name, v.work)


both("A4", """select d.label_id, d.name, coalesce(n, 0) as n, round(100.0e0 * coalesce(n, 0) / total, 6) as percent from (select label_id, name from {label_dim} union all select 0, 'unclassified') d
    left join (select label_id, count(*) as n from {point} group by label_id) c on c.label_id = d.label_id cross join (select count(*) as total from {point}) t""")
register(
    "A8",
    lambda v: v.inst.where("instance_id >= 0").join(v.point.select("point_id", "z"), "point_id").join(v.mapped.select("point_id", "z_l0", "cc_id0"), "point_id")
    .groupBy("instance_id", "label_id").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("cc_id0") >= 0, F.format_string("%06d:%d", "z_l0", "cc_id0")))), ",").alias("pairs")),
    """select i.instance_id, i.label_id, count(*) as n, min(p.z) as z_min, max(p.z) as z_max, coalesce(string_agg(distinct case when c.z is not null and v.cc_id is not null then printf('%06d:%d', cast(p.z * 4 as int), v.cc_id - 1) end, ',' order by case when c.z is not null and v.cc_id is not null then printf('%06d:%d', cast(p.z * 4 as int), v.cc_id - 1) end), '') as pairs
    from {inst} i join {point} p on p.point_id = i.point_id left join {combined} c on c.z = p.z and c.y = p.y and c.x = p.x and c.label_id = p.label_id
    left join {ccvox} v on v.label_id = p.label_id and v.z = p.z and v.y = p.y and v.x = p.x where i.instance_id >= 0 group by i.instance_id, i.label_id""",
)
both("A10", """select g.degree, count(*) as n, round(max(mean_degree), 6) as mean_degree, max(n_isolated) as n_isolated from (select point_id, count(b) as degree from {point} left join {edge} on a = point_id group by point_id) g
    cross join (select (select count(*) from {edge}) * 1.0e0 / (select count(*) from {point}) as mean_degree, (select count(*) from {point} p left anti join {edge} e on e.a = p.point_id) as n_isolated) m group by g.degree""", """
    select g.degree, count(*) as n, round(max(mean_degree), 6) as mean_degree, max(n_isolated) as n_isolated from (select point_id, count(b) as degree from {point} left join {edge} on a = point_id group by point_id) g
    cross join (select (select count(*) from {edge}) * 1.0e0 / (select count(*) from {point}) as mean_degree, (select count(*) from {point} p anti join {edge} e on e.a = p.point_id) as n_isolated) m group by g.degree""")
both("P14", """select b.label_id, b.comp_id, b.n, coalesce(i.n, 0) as n_inner, coalesce(i.n, 0) > 10 as has_inner from (select label_id, comp_id, cast(sum(area) as bigint) as n from {body} join {contour} using (label_id, z, cc_id) group by label_id, comp_id having cast(sum(area) as bigint) >= 10) b
    left join (select b.label_id, b.comp_id, count(*) as n from {innerv} i join {cvox} c on c.label_id = i.label_id and c.z = i.z and c.y = i.y and c.x = i.x join {body} b on b.label_id = c.label_id and b.z = c.z and b.cc_id = c.cc_id group by b.label_id, b.comp_id) i on i.label_id = b.label_id and i.comp_id = b.comp_id""")
register("O1", lambda v: _ordered(v.img.select("z").distinct(), ["z"], "slot", v), "select z, dense_rank() over (order by z) - 1 as slot from (select distinct z from {img}) l")
register("P11", lambda v: _ordered(v.part.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("n").distinct(), ["n"], "slider", v), "select n, row_number() over (order by n) - 1 as slider from (select distinct count(*) over (partition by root) as n from {part}) s")
both("P12", "select p.point_id from {part} p left anti join (select root from {part} group by root having count(*) < 5) h on h.root = p.root", "select p.point_id from {part} p where p.root not in (select root from {part} group by root having count(*) < 5)")


def _ray(v: Volume, direction: tuple[float, float] = (0.6, 0.8)) -> tuple[F.Column, F.Column]:
    """Depth along, and distance from, a view ray out of the origin; direction along x and z."""
    vz, vy, vx = v.voxel
    x, y, z = F.col("x") * vx, F.col("y") * vy, F.col("z") * vz
    along = x * direction[0] + z * direction[1]
    return along, F.sqrt(F.greatest(F.lit(0.0), F.col("x") * F.col("x") * vx**2 + F.col("y") * F.col("y") * vy**2 + F.col("z") * F.col("z") * vz**2 - F.pow(along, 2.0)))


def _nearest_to_ray(v: Volume) -> DataFrame:
    """Each label's point nearest to the ray, in front of the camera, outside hidden parts."""
    along, off = _ray(v)
    return v.point.where(along > 0).groupBy("label_id").agg(F.min(F.struct(off.alias("dist"), "point_id")).alias("m")).select("label_id", "m.point_id", F.round("m.dist", 6).alias("dist"))


register("J15", _nearest_to_ray, "select label_id, point_id, round(dist, 6) as dist from (select *, row_number() over (partition by label_id order by dist, point_id) as nth from (select label_id, point_id, sqrt(greatest(0.0e0, x * x * 0.25e0 + y * y * 1.0e0 + z * z * 4.0e0 - power(x * 0.5e0 * 0.6e0 + z * 2.0e0 * 0.8e0, 2))) as dist from {point} where x * 0.5e0 * 0.6e0 + z * 2.0e0 * 0.8e0 > 0) d) r where nth = 1")
register("O4", lambda v: v.contour.groupBy("label_id").agg(F.min(F.struct(-F.col("area"), "z", "cc_id")).alias("m")).select("label_id", "m.z", "m.cc_id"), "select label_id, z, cc_id from (select *, row_number() over (partition by label_id order by area desc, z, cc_id) as nth from {contour}) c where nth = 1")


def _picked(v: Volume) -> DataFrame:
    """Each label's mesh vertex nearest to the ray, if within a tenth of the least extent: in micrometres, held inside the volume, and as a voxel."""
    _, off = _ray(v)
    extent = F.least(*((F.max(c) - F.min(c)) * s for c, s in zip("zyx", v.voxel)))
    best = v.outerv.groupBy("label_id").agg(F.min(F.struct(F.round(off, 9).alias("dist"), "z", "y", "x")).alias("m"), (extent * 0.1).alias("reach")).where("m.dist <= reach")
    world = {c: F.greatest(F.lit(0.0), F.least(F.lit((n - 1) * s), (F.col(f"m.{c}") + 0.5) * s)) for c, s, n in zip("zyx", v.voxel, v.shape)}
    return best.select("label_id", *(w.alias(f"w{c}") for c, w in world.items()), *((w / s).cast("int").alias(c) for (c, w), s in zip(world.items(), v.voxel)))


register("J20", _picked, """
    select label_id, wz, wy, wx, cast(trunc(wz / 2.0e0) as int) as z, cast(trunc(wy / 1.0e0) as int) as y, cast(trunc(wx / 0.5e0) as int) as x from (
        select label_id, greatest(0e0, least((select nz - 1 from {depth}) * 2e0, (z + 0.5e0) * 2e0)) as wz, greatest(0e0, least(47e0, (y + 0.5e0) * 1e0)) as wy, greatest(0e0, least(47 * 0.5e0, (x + 0.5e0) * 0.5e0)) as wx from (
            select *, row_number() over (partition by label_id order by dist, z, y, x) as nth, 0.1e0 * least((max(x) over l - min(x) over l) * 0.5e0, (max(y) over l - min(y) over l) * 1.0e0, (max(z) over l - min(z) over l) * 2.0e0) as reach from (
                select *, round(sqrt(greatest(0.0e0, x * x * 0.25e0 + y * y * 1.0e0 + z * z * 4.0e0 - power(x * 0.5e0 * 0.6e0 + z * 2.0e0 * 0.8e0, 2))), 9) as dist from {outerv}) d window l as (partition by label_id)) r
        where nth = 1 and dist <= reach) w""")
_HIDDEN = "select point_id from {part} where root in (select root from {part} group by root having count(*) < 5)"
register(
    "G17",
    lambda v: _nearest(v, "true").join(v.part.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root"))).select("point_id", "n"), "point_id").selectExpr("query_id", "d2 <= 81 * 4e0 and n >= 5 as on_skeleton"),
    f"select query_id, d2 <= 81 * 4e0 and point_id not in ({_HIDDEN}) as on_skeleton from ({_nearest_sql('')}) n",
)
register("M3", lambda v: geometry.dilate(v.point.join(v.part.select("point_id", "root"), "point_id").select("root", "label_id", "z", "y", "x"), 3, ["root", "label_id"], v.shape).groupBy("root", "label_id").agg(F.count(F.lit(1)).alias("n_voxels")).join(v.part.groupBy("root").agg(F.count(F.lit(1)).alias("part_points")), "root"), """
    select root, label_id, count(*) as n_voxels, max(part_points) as part_points from (select distinct root, label_id, z + a.v as z, y + b.v as y, x + c.v as x from {point} join (select point_id, root from {part}) r using (point_id), {dsteps} a, {dsteps} b, {dsteps} c
    where a.v * a.v + b.v * b.v + c.v * c.v <= 9 and z + a.v >= 0 and z + a.v < (select nz from {depth}) and y + b.v between 0 and 47 and x + c.v between 0 and 47) d join (select root, count(*) as part_points from {part} group by root) t using (root) group by root, label_id""")
both("M11_sphere", "select label_id, z, cc_id, 4 * greatest(100.0e0, least(500.0e0, greatest((y_max - y_min) * {vy}, (x_max - x_min) * {vx}) / 2 + 50)) as distance from {contour}")
_TYPED = "case event_id % 5 when 0 then concat(' ', cast(event_id % 40 as %s), ' ') when 1 then concat('-', cast(event_id % 7 as %s)) when 2 then '3.5' when 3 then 'z12' else cast(event_id % 1000 as %s) end"
register(
    "T6",
    lambda v: replay.typed_slices(v.events.selectExpr("event_id", _TYPED.replace("%s", "string") + " as typed"), v.shape[0]),
    "select event_id, case when regexp_full_match(trim(typed), '[+-]?[0-9]+') then cast(greatest(0, least((select nz - 1 from {depth}), cast(trim(typed) as bigint))) as int) end as z from (select event_id, " + _TYPED.replace("%s", "varchar") + " as typed from {events}) t",
)

from lamina import store_queries, tracking_queries  # noqa: E402, F401

register("T1_stream", tracking_queries.delays_stream, ORACLE_T1)
