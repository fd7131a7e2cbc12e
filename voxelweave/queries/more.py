"""More of the inventory: compound splits, ensembles, exports, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..functions import geometry as G, text as X
from ..operators import aggregates as A, clustering as C, compound as M, joins as J, structure as S, windows as W
from ..plans import exports, graph as K, metrics, objects as O, places as P, relations as R
from .base import RESCAN, density, query, same_extents
from .knowledge import _records
from .scene import NEXT, STACK, r

#: The plane of least spread of every instance, solved in closed form.
PLANE = """with c as (select inst, count(*) as n, var_pop(x) as a, covar_pop(x,y) as b, covar_pop(x,z) as c, var_pop(y) as e, covar_pop(y,z) as f, var_pop(z) as g from v_point group by inst), q as (select *, (a+e+g)/3e0 as q from c), p as (select *, sqrt(((a-q)*(a-q)+(e-q)*(e-q)+(g-q)*(g-q)+2e0*(b*b+c*c+f*f))/6e0) as p from q), t as (select *, ((a-q)*((e-q)*(g-q)-f*f)-b*(b*(g-q)-f*c)+c*(b*f-(e-q)*c))/(2e0*p*p*p) as t from p), l as (select *, q+2e0*p*cos(acos(least(1e0, greatest(-1e0, t)))/3e0+2e0*pi()/3e0) as lo from t), v as (select *, [b*f-c*(e-lo), c*b-(a-lo)*f, (a-lo)*(e-lo)-b*b] as v1, [b*(g-lo)-c*f, c*c-(a-lo)*(g-lo), (a-lo)*f-b*c] as v2, [(e-lo)*(g-lo)-f*f, f*c-b*(g-lo), b*f-(e-lo)*c] as v3 from l), s as (select *, sqrt(v1[1]*v1[1]+v1[2]*v1[2]+v1[3]*v1[3]) as s1, sqrt(v2[1]*v2[1]+v2[2]*v2[2]+v2[3]*v2[3]) as s2, sqrt(v3[1]*v3[1]+v3[2]*v3[2]+v3[3]*v3[3]) as s3 from v), plane as (select inst, n, sqrt(greatest(lo, 0e0)) as thickness, case when s1 >= s2 and s1 >= s3 then abs(v1[3])/s1 when s2 >= s3 then abs(v2[3])/s2 else abs(v3[3])/s3 end as normal_z from s)"""
BOXES = "select id, x-l/2 as x0, x+l/2 as x1, y-w/2 as y0, y+w/2 as y1, z-h/2 as z0, z+h/2 as z1 from v_object"


def points(v, *extra):
    return v("v_point").select(F.xxhash64("okey", "inst", "x", "y", "z").alias("point_id"), "x", "y", "z", "inst", *extra)


@query("prj04_affine", "select id, round(0.8e0*(x+0.5e0*l*cos(th)-0.5e0*w*sin(th)-1e0) - 0.6e0*(y+0.5e0*l*sin(th)+0.5e0*w*cos(th)-2e0) + 3e0, 6) as u from v_object")
def _(v):
    ring = G.affine2(G.corners(*(F.col(c) for c in ("x", "y", "l", "w", "th"))), [[0.8, -0.6], [0.6, 0.8]], (1.0, 2.0), (3.0, 4.0))
    return v("v_object").select("id", r(ring[0]["x"]).alias("u"))


@query("prj14_message", "select cast(count(*) as int) as n from v_object")
def _(v):
    return O.message(O.record(v("v_object"), "lab"), "2024-01-01T00:00:00Z").select(F.size("semanticObjects").alias("n"))


@query("prj19_depth_grid", "with c as (select inst, avg(x) as ax, avg(y) as ay, avg(z) as az from v_point group by inst), t as (select p.inst, x-ax as x, y-ay as y, z-az as z from v_point p join c on c.inst = p.inst), f as (select inst, greatest(sqrt(max(x*x+y*y+z*z)), 1e-12) as far from t group by inst), u as (select t.inst, x/far as x, y/far as y, z/far as z from t join f on f.inst = t.inst), v(view, a, e) as (values (0, 0e0, 0e0), (1, radians(90e0), 0e0), (2, radians(45e0), radians(30e0))), i as (select inst, view, least(15, greatest(0, floor(((z*cos(e)-(x*cos(a)+y*sin(a))*sin(e))+1)/2*16))) as r, least(15, greatest(0, floor(((y*cos(a)-x*sin(a))+1)/2*16))) as c from u, v) select inst, view, count(distinct r*100+c) as cells from i group by inst, view")
def _(v):
    t = A.unit_sphere(v("v_point").select("inst", "x", "y", "z"), "inst")
    return A.depth_grid(t, [(0, 0), (90, 0), (45, 30)], 16).groupBy("inst", "view").agg(F.count(F.lit(1)).alias("cells"))


@query("flt04_grid_lookup", "select o.id, c.place as value from v_object o left join v_cell c on c.i = least(59, greatest(0, cast(trunc(o.x/0.5e0) as int))) and c.j = least(39, greatest(0, cast(trunc(o.y/0.5e0) as int)))")
def _(v):
    grid = v("v_cell").select(F.col("j").alias("row"), F.col("i").alias("col"), F.col("place").alias("value"))
    return S.grid_lookup(v("v_object"), grid, 0.5, (0.0, 0.0), (40, 60)).select("id", "value")


@query("flt07_ceiling_remnants")
def _(v):
    # every fifth object a strip under a ceiling's edge, the others shelves; a ceiling and a floor
    o, k = v("v_object").select("id"), F.col("id")
    across, along = (k * 37 % 101) / 50.0, (k * 13 % 61) / 61.0
    place = F.floor(k % 10).cast("int")
    strip = place % 5 == 0
    p = o.select(
        k.alias("point_id"), place.alias("inst"), (place * 10 + across).alias("x"), F.when(strip, 1 + along / 1000).otherwise(along).alias("y"),
        F.when(strip, 2.2 + along * 0.3).otherwise(1.7 + across / 40).alias("z"),
    )
    span = o.select(k.alias("point_id"), F.lit(-1).alias("inst"), (place * 10 + across * 1.2 - 0.2).alias("x"), (0.6 + along * 0.8).alias("y"))
    ceiling, floor = span.where("point_id % 2 = 0").withColumn("z", F.lit(2.6)), span.withColumn("z", (F.col("point_id") * 13 % 61) / 6100.0)
    t = S.ceiling_remnants(p, p.unionByName(ceiling).unionByName(floor).unionByName(floor), min_points=10)
    return t.select("inst", "n_points", "ceiling_layer_frac", "above_floor", "ceiling_pts_above")


@query("flt08_wall_filter")
def _(v):
    p = points(v)
    walls = p.select("point_id", F.abs(F.col("x") % 3).alias("wall_dist"), F.col("y").alias("room_dist")).dropDuplicates(["point_id"])
    return S.wall_filter(p.dropDuplicates(["point_id"]), walls, 0.0).select("inst", "why")


@query("flt11_evidence", "select id from v_object where 300 + id % 100 >= 250 and 0.2e0 >= 0.1e0 and l*w <= 0.5e0 and h >= 0.4e0")
def _(v):
    o = v("v_object").withColumn("n_points", 300 + F.col("id") % 100).withColumn("fill", F.lit(0.2))
    return M.evidence(o, most_area=0.5, desk_area=0.5, least_height=0.4).select("id")


@query("flt17_merged_candidates", "select id from v_object where greatest(l, w) >= 1e0 and greatest(l, w)/greatest(least(l, w), 1e-6) <= 3e0")
def _(v):
    return M.merged_candidates(v("v_object"), 1.0, 3.0).select("id")


@query("flt19_outside_boxes", f"with b as ({BOXES}) select o.id from v_object o where not exists (select 1 from b where b.id <> o.id and b.id % 3 = 0 and o.id % 3 <> 0 and o.x between x0-0.2e0 and x1+0.2e0 and o.y between y0-0.2e0 and y1+0.2e0 and o.z between z0-0.2e0 and z1+0.2e0) and o.id % 3 <> 0")
def _(v):
    b = v("v_object").where("id % 3 = 0").selectExpr("id", "x-l/2 as x0", "x+l/2 as x1", "y-w/2 as y0", "y+w/2 as y1", "z-h/2 as z0", "z+h/2 as z1")
    return J.outside_boxes(v("v_object").where("id % 3 <> 0").select("id", "x", "y", "z"), b, 0.2).select("id")


@query("jn11_spatial_hash", "select xor(xor(cast(floor(x/1e-4+0.5e0) as bigint)*73856093, cast(floor(y/1e-4+0.5e0) as bigint)*19349663), cast(floor(z/1e-4+0.5e0) as bigint)*83492791) as hash, count(*) as n from v_object group by 1")
def _(v):
    return v("v_object").groupBy(X.spatial_hash(F.col("x"), F.col("y"), F.col("z")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


CONDITIONS = "with c as (select *, id*2 + (case when condition = 'B' then 1 else 0 end) as ord, condition || id as name from (select id, x, y, z, l, w, h, 'A' as condition from v_rescan union all select id, x+0.02e0, y, z, l, w, h, 'B' from v_rescan where id % 2 = 0))"


def _conditions(v):
    m = F.lit("m").alias("map_id")
    a = v("v_rescan").select(m, "id", "x", "y", "z", "l", "w", "h", F.lit("A").alias("condition"))
    b = v("v_rescan").where("id % 2 = 0").select(m, "id", (F.col("x") + 0.02).alias("x"), "y", "z", "l", "w", "h", F.lit("B").alias("condition"))
    return a.unionByName(b).withColumns({"name": F.concat("condition", F.col("id").cast("string")), "ord": F.col("id") * 2 + (F.col("condition") == "B").cast("long"), "n_points": F.col("id") % 50})


@query("jn19_support", CONDITIONS + f", f as (select o.id, string_agg(distinct c.condition, '+' order by c.condition) as found_in from v_object o left join c on (o.x-c.x)*(o.x-c.x)+(o.y-c.y)*(o.y-c.y)+(o.z-c.z)*(o.z-c.z) <= 0.25e0 and {same_extents('o', 'c')} group by o.id) select coalesce(found_in, '') as found_in, count(*) as n from f group by 1")
def _(v):
    return M.support(_conditions(v), v("v_object").select("id", "x", "y", "z", "l", "w", "h")).groupBy(F.array_join("found_in", "+").alias("found_in")).agg(F.count(F.lit(1)).alias("n"))


@query("jn20_discoveries", "with recursive" + CONDITIONS[4:] + f""", u as (select * from c where not exists (select 1 from v_object o where o.id % 2 = 1 and (o.x-c.x)*(o.x-c.x)+(o.y-c.y)*(o.y-c.y)+(o.z-c.z)*(o.z-c.z) <= 0.25e0 and {same_extents('c', 'o')})),
 p as (select a.ord as l, b.ord as r from u a join u b on a.ord > b.ord and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 0.25e0 and {same_extents('a', 'b')}), o as (select l, row_number() over (order by l) as k from (select distinct l from p)),
 w(k, dups, l, head) as (select cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as bigint) union all select o.k, case when b.r is null then w.dups else list_append(w.dups, o.l) end, o.l, b.r from w join o on o.k = w.k + 1 left join lateral (select min(p.r) as r from p where p.l = o.l and not list_contains(w.dups, p.r)) b on true),
 g as (select coalesce(w.head, u.ord) as ord, string_agg(distinct u.condition, '+' order by u.condition) as conditions, arg_min(u.name, u.ord) as name, arg_min(u.x, u.ord) as x, arg_min(u.y, u.ord) as y from u left join w on w.l = u.ord group by 1)
 select g.ord, g.name, g.conditions, min(o.id) as variant_of from g left join v_object o on o.id % 2 = 1 and (o.x-g.x)*(o.x-g.x)+(o.y-g.y)*(o.y-g.y) < 0.49e0 group by g.ord, g.name, g.conditions""")
def _(v):
    return M.discoveries(_conditions(v), v("v_object").where("id % 2 = 1").select("id", "x", "y", "z", "l", "w", "h")).select("ord", "name", F.array_join("conditions", "+").alias("conditions"), "variant_of")


@query("jn24_subtract_points", "select id from v_rescan r where not exists (select 1 from v_object o where floor(o.x/1e-4+0.5e0) = floor(r.x/1e-4+0.5e0) and floor(o.y/1e-4+0.5e0) = floor(r.y/1e-4+0.5e0) and floor(o.z/1e-4+0.5e0) = floor(r.z/1e-4+0.5e0))")
def _(v):
    return J.exact_points(v("v_rescan"), v("v_object"), 1e-4, how="left_anti").select("id")


@query("jn26_robot_place", "select 1 as id, arg_min(place, (12-i)*(12-i)*1e6 + (45-j)*(45-j)*1e6 + i*1e3 + j) as place from v_cell")
def _(v):
    robot = v("v_cell").sparkSession.createDataFrame([(1, 12, 45)], "id int, i int, j int")
    return J.nearest_cell(robot, v("v_cell"), "id", "place")


@query("jn27_relation_targets", f"with s as ({STACK}) select concat('obj_', subject) as subject, predicate, string_agg('/World/Objects/obj_' || object, ',' order by '/World/Objects/obj_' || object) as paths from s where object % 2 = 0 group by 1, 2")
def _(v):
    n = lambda c: F.concat(F.lit("obj_"), F.col(c).cast("string")).alias(c)
    e = R.stacked(v("v_object")).select(n("subject"), "predicate", n("object"))
    t = exports.relation_targets(e, v("v_object").where("id % 2 = 0").select("name"), v("v_object").limit(0).select("name"))
    return t.select("subject", "predicate", F.array_join("paths", ",").alias("paths"))


@query("jn28_label_change", "select o.id, coalesce(r.type, '?') as before, o.type <> coalesce(r.type, '?') as changed from v_object o left join v_rescan r on o.id = r.id")
def _(v):
    b = v("v_rescan").select("id", F.col("type").alias("before"))
    return v("v_object").join(b, "id", "left").select("id", F.coalesce("before", F.lit("?")).alias("before"), (F.col("type") != F.coalesce("before", F.lit("?"))).alias("changed"))


@query("agg06_plane_stats", PLANE + " select inst, round(normal_z, 4) as normal_z, round(thickness, 4) as thickness from plane")
def _(v):
    return A.plane_stats(v("v_point"), "inst").select("inst", r("normal_z", 4).alias("normal_z"), r("thickness", 4).alias("thickness"))


@query("agg23_class_stats", "select type, count(*) as n, round(avg(confidence), 6) as mean_confidence, count(distinct status) as statuses from v_object group by type")
def _(v):
    return v("v_object").groupBy("type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("confidence")).alias("mean_confidence"), F.count_distinct("status").alias("statuses"))


@query("agg28_room_box", "select place, round(count(*)*0.0625e0, 6) as area, min(i)*0.25e0 as x0, (max(j)+1)*0.25e0 as y1 from v_cell group by place")
def _(v):
    return v("v_cell").groupBy("place").agg(r(F.count(F.lit(1)) * 0.0625).alias("area"), (F.min("i") * 0.25).alias("x0"), ((F.max("j") + 1) * 0.25).alias("y1"))


@query("agg34_free_cells", "select distinct cast(round_even(x/0.25e0, 0) as int) as i, cast(round_even(y/0.25e0, 0) as int) as j from v_point where z < 0.5e0")
def _(v):
    return v("v_point").where("z < 0.5").select(G.cell("x", 0.25, "round").alias("i"), G.cell("y", 0.25, "round").alias("j")).distinct()


@query("agg36_revision_states", RESCAN + " select (select count(*) from met where m) as moved, (select count(*) from lost) as absent, (select count(*) from fresh where times = 1) as inserted, (select count(distinct id) from (select id from met where not m and (d_type or d_pose or d_dims) union all select id from back union all select id from fresh where times > 1) where id not in (select id from met where m)) as updated")
def _(v):
    g = K.upsert(K.new_graph(v("v_object").sparkSession), _records(v("v_object")), "t1")
    g = K.upsert(g, _records(v("v_rescan")), "t2")
    return K.diff_summary(g.history, 2)


@query("win01_first_wins", "select type, arg_min(id, ord) as id from v_object o where h = (select max(h) from v_object p where p.type = o.type) group by type")
def _(v):
    return W.top_per_group(v("v_object"), ["type"], [F.col("h").desc(), F.col("ord")]).select("type", "id")


@query("win08_top_listing", "select name from v_object order by l desc, w desc, id limit 12")
def _(v):
    return v("v_object").orderBy(F.col("l").desc(), F.col("w").desc(), "id").limit(12).select("name")


@query("win11_novelty", "with recursive m as (select obj%5 as g, obj as m, max(confidence) as s, list(distinct ord%40) as p from v_vote group by 1, 2), o as (select *, row_number() over (partition by g order by s desc, m) as k from m), w(g, k, seen, m, n_new, ok) as (select distinct g, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(0 as bigint), false from m union all select o.g, o.k, case when len(list_filter(o.p, lambda x: not list_contains(w.seen, x)))*1e0/len(o.p) >= 0.5e0 then list_concat(w.seen, list_filter(o.p, lambda x: not list_contains(w.seen, x))) else w.seen end, o.m, len(list_filter(o.p, lambda x: not list_contains(w.seen, x))), len(list_filter(o.p, lambda x: not list_contains(w.seen, x)))*1e0/len(o.p) >= 0.5e0 from w join o on o.g = w.g and o.k = w.k + 1) select g, m, n_new from w where ok")
def _(v):
    t = v("v_vote").select((F.col("obj") % 5).alias("g"), F.col("obj").alias("m"), F.col("confidence").alias("s"), (F.col("ord") % 40).alias("p"))
    return W.greedy_novelty(t, "g", "m", "s", "p", 0.5).select("g", "m", "n_new")


@query("win12_paint", "select okey as p, arg_max(inst, k) as inst from (select okey, inst, max(z)*1000e0+inst as k from v_point group by okey, inst) group by okey")
def _(v):
    t = v("v_point").groupBy("okey", "inst").agg((F.max("z") * 1000 + F.col("inst")).alias("k"))
    return W.paint(t, "okey", "inst", "k").withColumnRenamed("okey", "p")


@query("win13_farthest", "with recursive p as (select id%4 as g, id, x, y, z from v_object), f(g, ord, id, picked) as (select g, 0, min(id), [arg_min({'x': x, 'y': y, 'z': z}, id)] from p group by g union all select f.g, f.ord + 1, b.id, list_append(f.picked, b.q) from f join lateral (select p.id, {'x': p.x, 'y': p.y, 'z': p.z} as q from p where p.g = f.g order by list_min(list_transform(f.picked, lambda s: (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)+(s.z-p.z)*(s.z-p.z))) desc, p.id limit 1) b on true where f.ord < 7) select g, id as point_id, ord from f")
def _(v):
    p = v("v_object").select((F.col("id") % 4).alias("g"), F.col("id").alias("point_id"), "x", "y", "z")
    return W.farthest_points(p, "g", 8).select("g", "point_id", "ord")


@query("win14_hashed_sample", "select status, id from (select status, id, row_number() over (partition by status order by md5('0:' || id), id) as k from v_object) where k <= 10")
def _(v):
    return W.hashed_sample(v("v_object"), ["status"], "id", 10).select("status", "id")


@query("set01_union", "select id, type, status from v_object union all select id, type, null from v_rescan")
def _(v):
    return v("v_object").select("id", "type", "status").unionByName(v("v_rescan").select("id", "type"), allowMissingColumns=True)


@query("set04_difference", "select id from v_object where id not in (select id from v_rescan)")
def _(v):
    return v("v_object").join(v("v_rescan"), "id", "left_anti").select("id")


@query("cl02_split", f"""with recursive p as (select id, x, y, z from v_object), {density('base', 'p', 1.5, 3)},
 foot as (select b.inst from base b join p on p.id = b.id where b.inst >= 0 group by b.inst having greatest(max(x)-min(x), max(y)-min(y)) > 2e0), wide as (select p.*, b.inst as base from p join base b on b.id = p.id where b.inst in (select inst from foot)),
 {density('sub', 'wide', 1.5, 4, 'xyz', 'base')}, good as (select w.base, s.inst as part from sub s join wide w on w.id = s.id where s.inst >= 0 group by 1, 2 having count(*) >= 4), split as (select base from good group by base having count(*) >= 2),
 final as (select b.id, b.inst, case when b.inst < 0 then null when b.inst in (select base from split) then (select g.part from good g join sub s on s.inst = g.part where s.id = b.id and g.base = b.inst) else 0 end as part from base b),
 num as (select inst, part, dense_rank() over (order by inst, part) - 1 as n from (select distinct inst, part from final where part is not null))
 select cast(coalesce(n.n, -1) as int) as inst, count(*) as n from final f left join num n on n.inst = f.inst and n.part = f.part group by 1""")
def _(v):
    p = v("v_object").select(F.col("id").alias("point_id"), "x", "y", "z")
    out, n = C.dbscan_split(p, 1.5, 3, 2.0, 1.5, 4)
    return out.groupBy("inst").agg(F.count(F.lit(1)).alias("n"))


@query("cl03_by_class", f"with recursive p as (select id, id%3 as label, x, y, z from v_object), {density('d', 'p', 2.0, 3, 'xyz', 'label')} select p.label, d.inst, count(*) as n from d join p on p.id = d.id group by 1, 2")
def _(v):
    p = v("v_object").select(F.col("id").alias("point_id"), (F.col("id") % 3).alias("label"), "x", "y", "z")
    return C.cluster_instances(p, "label", 2.0, 3).groupBy("label", "inst").agg(F.count(F.lit(1)).alias("n"))


@query("cl08_baseline")
def _(v):
    p = v("v_object").select(F.col("id").alias("point_id"), "x", "y", "z")
    return models.build_segmenter("geometric", radius=1.0).segment(p).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cl09_compound")
def _(v):
    p = v("v_object").select(F.col("id").alias("point_id"), F.lit(1).alias("parent"), (F.col("x") / 20).alias("x"), (F.col("y") / 20).alias("y"), (F.col("z") / 2).alias("z"))
    return M.split_compound(p, "parent", 0.0, least=20).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("cl13_superpoints")
def _(v):
    p = v("v_object").select(F.lit("s").alias("scan_id"), F.col("id").alias("point_id"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), "z")
    return M.superpoints(p, S.estimate_normals(p, 1.0), k=6, size=0.5).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("gr03_rooms")
def _(v):
    c = v("v_cell").select(F.lit("m").alias("map_id"), F.col("j").alias("row"), F.col("i").alias("col"), F.lit(254).alias("value"))
    return P.rooms(c, 0.25, door_radius=0.6).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("gr07_slic")
def _(v):
    return P.slic_places(v("v_cell").select(F.lit("m").alias("map_id"), "i", "j"), 6, 0.25).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("kg07_feedback", "select 'owner' as event, field, count(*) as n from (select 'presence' as field from v_object where name = 'obj_3' union all select 'type' from v_object where (name = 'obj_4' and type <> 'sofa') or (name = 'obj_5' and type <> 'desk') union all select 'status' from v_object where name in ('obj_4', 'obj_5')) group by field")
def _(v):
    spark = v("v_object").sparkSession
    g = K.upsert(K.new_graph(spark), _records(v("v_object")), "t1")
    g = K.feedback(g, spark.createDataFrame([("obj_3",)], "name string"), spark.createDataFrame([("obj_4", "sofa")], "name string, type string"), spark.createDataFrame([("obj_5", "desk")], "name string, type string"), "t2")
    return g.history.where("revision = 2").groupBy("event", "field").agg(F.count(F.lit(1)).alias("n"))


@query("kg12_edit_scene", "select inst, count(*) as n from (select case when inst = 3 then 900 else inst end as inst from v_point where inst not in (1) union all select 3 from v_point where inst = 3) group by inst")
def _(v):
    spark = v("v_object").sparkSession
    e = spark.createDataFrame([(1, "remove", None, None, None, None), (2, "move", 1.0, 0.0, 0.0, None), (3, "insert", 2.0, 0.0, 0.0, 900)], "inst int, op string, dx double, dy double, dz double, copy_as int")
    return O.edit_scene(v("v_point").select("inst", "x", "y", "z"), e).groupBy("inst").agg(F.count(F.lit(1)).alias("n"))


@query("kg13_place_names", "select distinct place, coalesce(case place when 1 then 'hall' when 4 then 'lab' end, 'place_' || lpad(cast(place as varchar), 2, '0')) as name from v_cell")
def _(v):
    names = v("v_cell").sparkSession.createDataFrame([(1, "hall"), (4, "lab")], "place int, name string")
    return P.merge_names(v("v_cell").select("place").distinct(), names)


@query("qry10_on_top", f"with s as ({STACK}) select subject, string_agg(cast(object as varchar), ',' order by object) as objects from s group by subject, predicate")
def _(v):
    return R.stacked_targets(v("v_object"), each=lambda o: F.array_join(o.cast("array<string>"), ",")).select("subject", "objects")


@query("agg22_flag_rates", "with c as (select count(*) filter (where status = 'unverified' and quality = 'unknown') as tp, count(*) filter (where status = 'unverified' and quality <> 'unknown') as fp, count(*) filter (where status <> 'unverified' and quality = 'unknown') as fn from v_object) select tp, fp, fn, tp*1e0/greatest(tp+fp, 1) as precision, tp*1e0/greatest(tp+fn, 1) as recall from c")
def _(v):
    return metrics.flags(v("v_object"), F.col("status") == "unverified", F.col("quality") == "unknown")
