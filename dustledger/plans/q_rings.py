"""Queries on true outlines: gaps, clusters, sites, identity, overlap, clipping and dissolved features of concave rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger.functions import overlay
from dustledger.functions.numeric import half_even, micro
from dustledger.operators import rings as R, spatial as SP
from dustledger.plans.registry import query
from dustledger.plans.q_spatial import with_ring
from dustledger.plans.views import ctes, m6, r
from dustledger.session import shuffled

BOX = SP.BOX

# Outlines inside the boxes of the arrays: an L, a C that opens to the right, an arrow. Corners as (x, y) in parts of the box.
_OUTLINES = (
    ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)),
    ((0, 0), (1, 0), (1, 0.25), (0.25, 0.25), (0.25, 0.75), (1, 0.75), (1, 1), (0, 1)),
    ((0, 0), (0.5, 0.25), (1, 0), (0.5, 1)),
)


def with_outline(df, key: str):
    """``df`` with a ring by the remainder of its key."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    rings = [F.array(*[F.struct((F.col("minx") + w * x).alias("x"), (F.col("miny") + h * y).alias("y")) for x, y in one]) for one in _OUTLINES]
    return df.withColumn("ring", F.when(F.col(key) % 3 == 0, rings[0]).when(F.col(key) % 3 == 1, rings[1]).otherwise(rings[2]))


def box_ring(df):
    """``df`` with its box as a ring."""
    a, b, c, d = (F.col(n) for n in BOX)
    return df.withColumn("ring", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (c, b), (c, d), (a, d))]))


def _edges_sql(name: str, source: str, key: str, xs: str, ys: str) -> str:
    """CTE of ring edges (id, k, x0, y0, x1, y1) from lists of corner coordinates."""
    return (f"{name} as (select id, k, xs[k] as x0, ys[k] as y0, xs[k % len(xs) + 1] as x1, ys[k % len(ys) + 1] as y1 "
            f"from (select id, xs, ys, unnest(range(1, len(xs) + 1)) as k from (select {key} as id, {xs} as xs, {ys} as ys from {source}) o) q)")


def _outline_sql(axis: int) -> str:
    low, size = (("minx", "(maxx - minx)"), ("miny", "(maxy - miny)"))[axis]
    lists = ["[" + ", ".join(f"{low} + {size} * {p[axis]}e0" for p in one) + "]" for one in _OUTLINES]
    return f"case kind when 0 then {lists[0]} when 1 then {lists[1]} else {lists[2]} end"


_ROOFS = "roofs as (select *, array_id % 3 as kind from arrays), " + _edges_sql("re", "roofs", "array_id", _outline_sql(0), _outline_sql(1))


def _point_sql(x: str, y: str, e: str) -> str:
    """Squared distance from a point to an edge."""
    dx, dy = f"({e}.x1 - {e}.x0)", f"({e}.y1 - {e}.y0)"
    t = f"greatest(0e0, least(1e0, (({x} - {e}.x0) * {dx} + ({y} - {e}.y0) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"(power({x} - ({e}.x0 + {t} * {dx}), 2) + power({y} - ({e}.y0 + {t} * {dy}), 2))"


def _side_sql(e: str, x: str, y: str) -> str:
    return f"(({e}.x1 - {e}.x0) * ({y} - {e}.y0) - ({e}.y1 - {e}.y0) * ({x} - {e}.x0))"


def _cross_sql(e: str, f: str) -> str:
    return (f"({_side_sql(e, f'{f}.x0', f'{f}.y0')} * {_side_sql(e, f'{f}.x1', f'{f}.y1')} < 0 and "
            f"{_side_sql(f, f'{e}.x0', f'{e}.y0')} * {_side_sql(f, f'{e}.x1', f'{e}.y1')} < 0)")


def _gap_sql(pairs: str, margin: float) -> str:
    """CTEs from pairs (u, v) to gp (u, v, gap) by the edges re."""
    gaps = ", ".join(_point_sql(f"{a}.x{k}", f"{a}.y{k}", b) for a, b in (("e", "f"), ("f", "e")) for k in (0, 1))
    return f"""near as (select a.array_id as u, b.array_id as v from {pairs} a join {pairs} b on a.array_id < b.array_id and b.minx <= a.maxx + {margin}
   and a.minx <= b.maxx + {margin} and b.miny <= a.maxy + {margin} and a.miny <= b.maxy + {margin}),
 eg as (select u, v, min(case when {_cross_sql('e', 'f')} then 0e0 else sqrt(least({gaps})) end) as gap from near join re e on e.id = u join re f on f.id = v group by 1, 2),
 cn as (select u, v, s.id as holder, count(*) % 2 = 1 as held from near join re p on p.k = 1 and (p.id = u or p.id = v) join re s on s.id <> p.id and (s.id = u or s.id = v)
   and (s.y0 > p.y0) <> (s.y1 > p.y0) and p.x0 < (s.x1 - s.x0) * (p.y0 - s.y0) / (s.y1 - s.y0) + s.x0 group by 1, 2, 3),
 gp as (select eg.u, eg.v, case when exists (select 1 from cn where cn.u = eg.u and cn.v = eg.v and held) then 0e0 else gap end as gap from eg)"""


def _share_sql(pairs: str, one: str, two: str) -> str:
    """CTEs from pairs (l, r) to sh (l, r, area): the area shared by ring l of edges ``one`` and ring r of edges ``two``, by vertical slabs."""
    p, q = _side_sql("f", "e.x0", "e.y0"), _side_sql("f", "e.x1", "e.y1")
    return f"""bs as (select l, r, 0 as side, x0, y0, x1, y1 from {pairs} join {one} on id = l union all select l, r, 1, x0, y0, x1, y1 from {pairs} join {two} on id = r),
 vx as (select distinct l, r, x0 as x from bs union select e.l, e.r, e.x0 + (e.x1 - e.x0) * {p} / ({p} - {q}) from bs e join bs f on e.l = f.l and e.r = f.r and e.side = 0 and f.side = 1 where {_cross_sql('e', 'f')}),
 sl as (select l, r, x as xa, lead(x) over (partition by l, r order by x) as xb from vx),
 yy as (select s.l, s.r, xa, xb, side, y0 + ((xa + xb) / 2e0 - x0) * (y1 - y0) / (x1 - x0) as y from sl s join bs b on b.l = s.l and b.r = s.r
   where xb is not null and (x0 <= (xa + xb) / 2e0) <> (x1 <= (xa + xb) / 2e0)),
 yk as (select *, row_number() over (partition by l, r, xa, side order by y) as k from yy),
 rn as (select l, r, xa, xb, side, (k - 1) // 2 as run, min(y) as lo, max(y) as hi from yk group by all),
 sh as (select a.l, a.r, sum(greatest(0e0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) * (a.xb - a.xa)) as area from rn a join rn b on a.l = b.l and a.r = b.r and a.xa = b.xa and a.side = 0 and b.side = 1 group by 1, 2)"""


def _area_sql(edges: str, name: str) -> str:
    return f"{name} as (select id, abs(sum(x0 * y1 - x1 * y0)) / 2e0 as area from {edges} group by 1)"


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


def roofs(t):
    return with_outline(t.sql("arrays"), "array_id")


@query("c7_outline_neighbours", ctes("arrays", extra=f"""{_ROOFS}, {_gap_sql('roofs', 100)}, {_area_sql('re', 'ar')},
 g2 as (select u, v, gap from gp union all select v, u, gap from gp),
 g as (select u, count(case when gap <= 50 then 1 end) as n_near, count(case when gap <= 100 then 1 end) as n_far, min(gap) as nearest_m, avg(case when gap <= 100 then ar.area end) as mean_area_far from g2 join ar on ar.id = v group by 1)""")
       + f"select array_id, coalesce(n_near, 0) as n_near, coalesce(n_far, 0) as n_far, {m6('nearest_m')} as nearest_m, {m6('mean_area_far')} as mean_area_far from arrays left join g on array_id = u")
def _(t):
    """Neighbours within 50 and 100 m of concave outlines, edge to edge."""
    from dustledger.functions import geo

    near = R.ring_neighbours(roofs(t).withColumn("area", geo.ring_area(F.col("ring"))), "array_id", "area")
    return near.withColumns({c: micro(F.col(c)) for c in ("nearest_m", "mean_area_far")})


_LINKS = """ed as (select u, v from gp where gap <= 2.5 union all select v, u from gp where gap <= 2.5),
 cc(node, reach) as (select array_id, array_id from {src} union select c.node, e.v from cc c join ed e on e.u = c.reach),
 comp as (select node, min(reach) as component from cc group by 1)"""


@query("c8_outline_clusters", _recursive(ctes("arrays", extra=f"{_ROOFS}, {_gap_sql('roofs', 2.5)}, {_LINKS.format(src='roofs')}")) + "select node as array_id, component from comp")
def _(t):
    return R.ring_clusters(roofs(t), "array_id")


_SPOT = """sp as (select array_id, (miny + maxy) / 2e0 as y from roofs),
 hx as (select array_id, y, x0 + (y - y0) * (x1 - x0) / (y1 - y0) as x from sp join re on id = array_id where (y0 > y) <> (y1 > y)),
 hk as (select *, row_number() over (partition by array_id order by x) as k from hx),
 hr as (select array_id, y, (k - 1) // 2 as run, max(x) - min(x) as w, (max(x) + min(x)) / 2e0 as m from hk group by 1, 2, 3),
 ip as (select array_id, y, m as x from hr qualify row_number() over (partition by array_id order by w desc, m desc) = 1),
 hit as materialized (select i.array_id, min(p.parcel_no) as parcel_no from ip i join parcels p on i.x >= p.minx and i.x < p.maxx and i.y >= p.miny and i.y < p.maxy group by 1),
 off as materialized (select * from roofs where array_id not in (select array_id from hit))"""


@query("c9_outline_sites", _recursive(ctes("arrays", "parcels", extra=f"{_ROOFS}, {_SPOT}, {_gap_sql('off', 2.5)}, {_LINKS.format(src='off')}"))
       + "select array_id, 'apn:' || parcel_no::varchar as site_id, 'parcel' as site_source from hit union all select node, 'prox:' || component::varchar, 'proximity' from comp")
def _(t):
    """The parcel of the point inside each outline, else the cluster of outlines within 2.5 m."""
    return R.assign_ring_sites(roofs(t), box_ring(t.sql("parcels")), "array_id", "parcel_no")


@query("b16_outline_iou", ctes("arrays", extra=f"""{_ROOFS}, pr as (select a.array_id as l, b.array_id as r from arrays a join arrays b on a.array_id < b.array_id
   and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy), {_share_sql('pr', 're', 're')}, {_area_sql('re', 'ar')}""")
       + f"select pr.l as a_id, pr.r as b_id, {m6('coalesce(sh.area, 0e0) / (p.area + q.area - coalesce(sh.area, 0e0))')} as iou from pr left join sh on sh.l = pr.l and sh.r = pr.r join ar p on p.id = pr.l join ar q on q.id = pr.r")
def _(t):
    a = roofs(t)
    pairs = SP.box_pairs(a, a, "array_id", "array_id", 50.0).filter("l < r").select("l", "r")
    rings = a.select("array_id", "ring")
    j = (pairs.join(rings.withColumnsRenamed({"array_id": "l", "ring": "ring_a"}), "l")
         .join(rings.withColumnsRenamed({"array_id": "r", "ring": "ring_b"}), "r"))
    return j.select(F.col("l").alias("a_id"), F.col("r").alias("b_id"), micro(overlay.polygon_iou(F.col("ring_a"), F.col("ring_b"))).alias("iou"))


_CHIPS = _edges_sql("ce", "parcels", "parcel_no", "[minx, maxx, maxx, minx]", "[miny, miny, maxy, maxy]")


@query("g10_outlines_to_chips_clipped", ctes("arrays", "parcels", extra=f"""{_ROOFS}, {_CHIPS}, pr as (select a.array_id as l, p.parcel_no as r from arrays a join parcels p
   on a.minx <= p.maxx and p.minx <= a.maxx and a.miny <= p.maxy and p.miny <= a.maxy), {_share_sql('pr', 're', 'ce')}, {_area_sql('re', 'ar')}""")
       + f"select l as array_id, r as chip_id, {m6('sh.area / ar.area')} as kept_frac, {m6('sh.area')} as clip_area from sh join ar on ar.id = l where sh.area / ar.area >= 0.25 and sh.area >= 1")
def _(t):
    """Concave outlines cut to chips: those with a quarter of the outline and a square metre stay."""
    from dustledger.operators.tiles import clip_to_chips

    c = clip_to_chips(roofs(t), t.sql("parcels"), "array_id", "parcel_no", 0.25, 1.0)
    return c.select("array_id", F.col("parcel_no").alias("chip_id"), micro(F.col("kept_frac")).alias("kept_frac"), micro(F.col("clip_area")).alias("clip_area"))


def _pentagon_sql() -> str:
    return _edges_sql("re", "arrays", "array_id", "[minx, maxx, maxx, (minx + maxx) / 2e0, minx]", "[miny, miny, maxy, maxy, (miny + maxy) / 2e0]")


@query("g10_polygons_to_chips_clipped", ctes("arrays", "parcels", extra=f"""{_pentagon_sql()}, {_CHIPS}, pr as (select a.array_id as l, p.parcel_no as r from arrays a join parcels p
   on a.minx <= p.maxx and p.minx <= a.maxx and a.miny <= p.maxy and p.miny <= a.maxy), {_share_sql('pr', 're', 'ce')}, {_area_sql('re', 'ar')}""")
       + f"select l as array_id, r as chip_id, {m6('sh.area / ar.area')} as kept_frac, {m6('sh.area')} as clip_area from sh join ar on ar.id = l where sh.area / ar.area >= 0.25 and sh.area >= 1")
def _(t):
    from dustledger.operators.tiles import clip_to_chips

    c = clip_to_chips(with_ring(t.sql("arrays")), t.sql("parcels"), "array_id", "parcel_no", 0.25, 1.0)
    return c.select("array_id", F.col("parcel_no").alias("chip_id"), micro(F.col("kept_frac")).alias("kept_frac"), micro(F.col("clip_area")).alias("clip_area"))


@query("d22_dissolved_outlines", _recursive(ctes("arrays", extra=f"""{_ROOFS}, {_gap_sql('roofs', 2.5)}, {_LINKS.format(src='roofs')},
 me as (select component as g, re.* from re join comp on node = id),
 gx as (select distinct g, x0 as x from me union select e.g, e.x0 + (e.x1 - e.x0) * {_side_sql('f', 'e.x0', 'e.y0')} / ({_side_sql('f', 'e.x0', 'e.y0')} - {_side_sql('f', 'e.x1', 'e.y1')})
   from me e join me f on e.g = f.g and e.id <> f.id where {_cross_sql('e', 'f')}),
 sl as (select g, x as xa, lead(x) over (partition by g order by x) as xb from gx),
 yy as (select s.g, xa, xb, id, y0 + ((xa + xb) / 2e0 - x0) * (y1 - y0) / (x1 - x0) as y from sl s join me on me.g = s.g where xb is not null and (x0 <= (xa + xb) / 2e0) <> (x1 <= (xa + xb) / 2e0)),
 yk as (select *, row_number() over (partition by g, xa, id order by y) as k from yy),
 rn as (select g, xa, xb, min(y) as lo, max(y) as hi from yk group by g, xa, xb, id, (k - 1) // 2),
 mg as (select *, max(hi) over (partition by g, xa order by lo, hi rows between unbounded preceding and 1 preceding) as reach from rn)""")
       ) + f"select g as component, {r('sum(greatest(0e0, hi - greatest(lo, coalesce(reach, lo))) * (xb - xa)) + 3e-5', 4)} as union_area from mg group by 1")
def _(t):
    """Union area of every cluster of outlines, as the sum over its dissolved features (rounded beside the ties of sixteenths)."""
    a = roofs(t)
    members = R.ring_clusters(a, "array_id").join(shuffled(a.select("array_id", "ring")), "array_id")
    features = R.dissolve(members, "component")
    return features.groupBy("component").agg(F.sum("area").alias("union_area")).select("component", half_even(F.col("union_area") + 3e-5, 4).alias("union_area"))


@query("c10_outline_identity", _recursive(ctes("arrays", extra=f"""{_ROOFS}, cur as (select array_id + 1000000000 as id, array_id, kind, minx + array_id % 7 * 0.6e0 as minx, miny, maxx + array_id % 7 * 0.6e0 as maxx, maxy from roofs where array_id % 10 <> 0),
 {_edges_sql('ue', 'cur', 'id', _outline_sql(0), _outline_sql(1))}, {_area_sql('re', 'ra')}, {_area_sql('ue', 'ua')},
 pr as (select c.id as l, a.array_id as r from cur c join arrays a on c.minx <= a.maxx and a.minx <= c.maxx and c.miny <= a.maxy and a.miny <= c.maxy), {_share_sql('pr', 'ue', 're')},
 cand as (select l, r, sh.area / (ua.area + ra.area - sh.area) as iou, r // 1000 as blk from sh join ua on ua.id = l join ra on ra.id = r where sh.area / (ua.area + ra.area - sh.area) >= 0.3),
 rk as (select *, row_number() over (partition by blk order by iou desc, l, r) as k from cand),
 st(blk, k, ul, ur, l, r, taken) as (select distinct blk, 0::bigint, []::bigint[], []::bigint[], null::bigint, null::bigint, false from cand
   union all select s.blk, s.k + 1, case when f then list_append(s.ul, r.l) else s.ul end, case when f then list_append(s.ur, r.r) else s.ur end, r.l, r.r, f
   from (select s.*, not list_contains(s.ul, r.l) and not list_contains(s.ur, r.r) as f from st s join rk r on r.blk = s.blk and r.k = s.k + 1) s join rk r on r.blk = s.blk and r.k = s.k + 1),
 settled as (select l, r from st where taken),
 rc as (select id, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3e0 * sum(x0 * y1 - x1 * y0)) as x, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3e0 * sum(x0 * y1 - x1 * y0)) as y from re group by 1),
 lp as (select id as l, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3e0 * sum(x0 * y1 - x1 * y0)) as x, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3e0 * sum(x0 * y1 - x1 * y0)) as y from ue where id not in (select l from settled) group by 1),
 nr as (select lp.l, rc.id as r, round(sqrt(power(lp.x - rc.x, 2) + power(lp.y - rc.y, 2)), 9) as d from lp join rc on abs(lp.x - rc.x) <= 5 and abs(lp.y - rc.y) <= 5),
 one as (select *, row_number() over (partition by l order by d, r) as rn from nr where d <= 5),
 two as (select *, row_number() over (partition by r order by d, l) as rm from one where rn = 1 and r not in (select r from settled)),
 pair as (select * from settled union all select l, r from two where rm = 1)""")) + """select cur.id as curr_id, pair.r as prev_id, case when pair.r is not null then 'matched' else 'new' end as status from cur left join pair on pair.l = cur.id
 union all select null, array_id, 'dropped' from arrays where array_id not in (select r from pair)""")
def _(t):
    """Two detection runs of outlines: the second is shifted by up to 3.6 m and misses every tenth."""
    prev = t.sql("arrays").select("array_id", *BOX)
    dx = F.col("array_id") % 7 * 0.6
    moved = prev.filter("array_id % 10 <> 0").select((F.col("array_id") + 1000000000).alias("new_id"), "array_id", (F.col("minx") + dx).alias("minx"), "miny",
                                                     (F.col("maxx") + dx).alias("maxx"), "maxy")
    return R.carry_ring_identity(with_outline(prev, "array_id"), with_outline(moved, "array_id"), "array_id", "new_id")
