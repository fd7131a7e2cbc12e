"""Registry of queries, and the derived views that they read.

The test tables hold no scans, so views over them play points, votes, objects,
cells and a second epoch. A view's text is the same for Spark and DuckDB:
``{part}`` and the like stand for its tables. Doubles are written as e0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "v_object": """select p_partkey as id, p_partkey as ord, concat('obj_', cast(p_partkey as varchar(20))) as name, lower(p_type) as type,
 ((p_partkey*37)%1000)/20.0e0+0.013e0 as x, ((p_partkey*91)%1000)/20.0e0+0.027e0 as y, ((p_partkey*13)%60)/20.0e0+0.0031e0 as z,
 ((p_partkey%7)-3)*0.4e0 as th, 0.2e0+(p_size%10)*0.15e0 as l, 0.2e0+(p_size%7)*0.1e0 as w, 0.3e0+(p_size%5)*0.3e0 as h,
 case when p_partkey%5=0 then 'unverified' when p_partkey%5=1 then 'verified_escalated' else 'verified' end as status,
 case when p_partkey%11=0 then 'absent' else 'present' end as presence,
 case when p_partkey%4=0 then 'unknown' when p_partkey%4=1 then 'plausible' else 'confirmed' end as quality, (p_partkey%9=0) as is_key,
 case when p_partkey%6=5 then null else (p_partkey%3=0) end as is_movable, 0.3e0+(p_partkey%70)/100.0e0 as confidence from {part}""",
    "v_point": """select l_orderkey as okey, cast(l_partkey%100 as int) as inst, (l_partkey%10)*3.0e0+l_quantity/50.0e0 as x,
 floor((l_partkey%100)/10.0e0)*3.0e0+(l_suppkey%37)/37.0e0 as y, l_discount*10.0e0+l_linenumber/7.0e0 as z, l_tax*10.0e0 as r, l_discount*10.0e0 as g,
 (l_quantity%10)/10.0e0 as b from {lineitem}""",
    "v_vote": """select l_orderkey*1000000+l_suppkey*100+l_linenumber as ord, l_partkey as obj, cast(((l_linenumber-1)%4)*90 as int) as azimuth, (l_linenumber>4) as zoom,
 lower(l_returnflag) as type, 0.31e0+l_discount*5.0e0 as confidence from {lineitem}""",
    "v_cell": """select distinct cast(o_orderkey%60 as int) as i, cast(floor(o_orderkey/60.0e0) as int)%40 as j,
 cast(floor((o_orderkey%60)/20.0e0) as int)+3*cast(floor((cast(floor(o_orderkey/60.0e0) as int)%40)/20.0e0) as int)+1 as place
 from {orders} where o_orderkey%20<>19 or (cast(floor(o_orderkey/60.0e0) as int)%40)%20 between 8 and 11""",
    "v_rescan": """select p_partkey as id, p_partkey as ord, concat('obj_', cast(p_partkey as varchar(20))) as name, lower(p_type) as type,
 ((p_partkey*37)%1000)/20.0e0+0.013e0+(case when p_partkey%13=0 then 2.0e0 when p_partkey%5=0 then 0.1e0 else 0.0e0 end) as x,
 ((p_partkey*91)%1000)/20.0e0+0.027e0 as y, ((p_partkey*13)%60)/20.0e0+0.0031e0 as z, ((p_partkey%7)-3)*0.4e0 as th,
 0.2e0+(p_size%10)*0.15e0 as l, 0.2e0+(p_size%7)*0.1e0 as w, 0.3e0+(p_size%5)*0.3e0 as h from {part} where p_partkey%17<>0""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def folder(spark: SparkSession) -> str:
    """A new folder of the shared one; it goes when the driver's JVM ends."""
    where = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text})


def twin(sql: str) -> str:
    """SQL over the views it names, for DuckDB."""
    parts = [f"{n} as ({t.format(**{x: x for x in TABLES})})" for n, t in VIEWS.items() if n in sql]
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"


def query(name: str, sql: str | None = None):
    """Registers a query f(view), view(name) giving the derived views."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            SQL[name] = twin(sql)
        return f

    return wrap


#: Two footprints meet (x, y, l, w, th of a and b): no side normal parts them.
SAT = """(not (abs((b.x-a.x)*cos(a.th)+(b.y-a.y)*sin(a.th)) > 0.5e0*(a.l+b.l*abs(cos(b.th-a.th))+b.w*abs(sin(b.th-a.th)))+1e-9)
 and not (abs((b.y-a.y)*cos(a.th)-(b.x-a.x)*sin(a.th)) > 0.5e0*(a.w+b.l*abs(sin(b.th-a.th))+b.w*abs(cos(b.th-a.th)))+1e-9)
 and not (abs((b.x-a.x)*cos(b.th)+(b.y-a.y)*sin(b.th)) > 0.5e0*(b.l+a.l*abs(cos(b.th-a.th))+a.w*abs(sin(b.th-a.th)))+1e-9)
 and not (abs((b.y-a.y)*cos(b.th)-(b.x-a.x)*sin(b.th)) > 0.5e0*(b.w+a.l*abs(sin(b.th-a.th))+a.w*abs(cos(b.th-a.th)))+1e-9))"""
RADIUS = "0.5e0*sqrt({0}.l*{0}.l+{0}.w*{0}.w)"


def greedy(name: str, pairs: str, kind: str = "bigint") -> str:
    """Recursive CTEs ``name`` (k, taken, l, r, cost) over the CTE ``pairs`` (l,
    r, ord, cost): left rows claim in their order the cheapest right row that is
    free, ties going to the smaller one."""
    return f"""{name}_o as (select l, row_number() over (order by min(ord), l) as k from {pairs} group by l), {name}(k, taken, l, r, cost) as (
 select cast(0 as bigint), cast([] as {kind}[]), cast(null as bigint), cast(null as {kind}), cast(null as double)
 union all select o.k, case when b.r is null then t.taken else list_append(t.taken, b.r) end, o.l, b.r, b.cost from {name} t join {name}_o o on o.k = t.k + 1
 left join lateral (select p.r, p.cost from {pairs} p where p.l = o.l and not list_contains(t.taken, p.r) order by p.cost, p.r limit 1) b on true)"""


def density(name: str, rows: str, eps: float, least: int, axes: str = "xyz", by: str = "") -> str:
    """Recursive CTEs for density clustering of the CTE ``rows`` (id, x, y, z):
    ``name`` (id, inst), -1 for noise, clusters numbered by their smallest core, a
    border point with its smallest core."""
    d2 = "+".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in axes)
    same = f"a.{by} = b.{by} and " if by else ""
    n = name
    return f"""{n}_g as (select a.id a, b.id b from {rows} a join {rows} b on {same}{d2} <= {eps}e0*{eps}e0), {n}_k as (select a from {n}_g group by a having count(*) >= {least}),
 {n}_l as (select a, b from {n}_g where a in (select a from {n}_k) and b in (select a from {n}_k)), {n}_w(n, t) as (select a, a from {n}_k union select w.n, l.b from {n}_w w join {n}_l l on l.a = w.t),
 {n}_c as (select n, min(t) as c from {n}_w group by n), {n}_r as (select c, dense_rank() over (order by c) - 1 as inst from (select distinct c from {n}_c)),
 {n}_b as (select g.a, arg_min(c.c, c.n) as c from {n}_g g join {n}_c c on c.n = g.b where g.a not in (select a from {n}_k) group by g.a),
 {n} as (select p.id, cast(coalesce(r.inst, -1) as int) as inst from {rows} p left join (select n, c from {n}_c union all select a, c from {n}_b) x on x.n = p.id left join {n}_r r on r.c = x.c)"""


def same_extents(a: str, b: str) -> str:
    return " and ".join(f"abs({a}.{c}-{b}.{c}) <= greatest(0.3e0*greatest({a}.{c}, {b}.{c}), 0.15e0)" for c in "lwh")


def anchor(row: str = "") -> str:
    parts = " || ', ' || ".join(f"cast(cast(floor({row}{c}/0.25e0) as bigint) as varchar)" for c in ("x", "y", "z", "l", "w", "h"))
    return f"'obj-lab-' || substr(sha1('(''lab'', ' || {parts} || ')'), 1, 10)"


#: v_object as a graph's first revision and v_rescan as its second: claims that
#: stayed, claims that moved, and what is left. Anchors are distinct in both as
#: long as there are fewer than 3,000 parts.
RESCAN = f"""with recursive n as (select {anchor()} as id, lower(trim(type)) as kind, * exclude (id) from v_object), r as (select {anchor()} as id, lower(trim(type)) as kind, * exclude (id) from v_rescan),
 near as (select r.ord as l, n.id as r, r.ord, (r.x-n.x)*(r.x-n.x)+(r.y-n.y)*(r.y-n.y) as cost from r join n on (r.x-n.x)*(r.x-n.x)+(r.y-n.y)*(r.y-n.y)+(r.z-n.z)*(r.z-n.z) <= 0.25e0 and {same_extents('r', 'n')}),
 {greedy('stay', 'near', 'varchar')}, stayed as (select l as rec, r as node from stay where r is not null),
 far as (select r.ord as l, n.id as r, r.ord, (r.x-n.x)*(r.x-n.x)+(r.y-n.y)*(r.y-n.y) as cost from r join n on r.kind = n.kind and (r.x-n.x)*(r.x-n.x)+(r.y-n.y)*(r.y-n.y) <= 36e0 and {same_extents('r', 'n')}
  where r.ord not in (select rec from stayed) and n.id not in (select node from stayed) and r.kind not in ('clutter', 'unknown', 'misc', 'object')),
 {greedy('move', 'far', 'varchar')}, moved as (select l as rec, r as node from move where r is not null),
 met as (select n.id, r.ord as rec, m, r.type <> n.type as d_type, (r.x <> n.x or r.y <> n.y or r.z <> n.z or r.th <> n.th) as d_pose, (r.l <> n.l or r.w <> n.w or r.h <> n.h) as d_dims
  from (select *, false as m from stayed union all select *, true from moved) p join n on n.id = p.node join r on r.ord = p.rec),
 rest as (select id, count(*) as times from r where ord not in (select rec from met) group by id), back as (select id from rest where id in (select id from n)), fresh as (select id, times from rest where id not in (select id from n)),
 lost as (select id from n where id not in (select id from met) and id not in (select id from rest))"""
