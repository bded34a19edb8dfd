"""The driver's tables read as domain tables, as Spark expressions and as SQL text.

Every view is a projection or aggregation of whole tables, so its rows grow with them. The SQL text
of a view is used as a CTE body in the oracle of each query that reads it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """Lazy readers for one scale-factor folder, plus the domain views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, view: str) -> DataFrame:
        """A domain view from its SQL text, over the columns it names."""
        text = VIEWS[view]
        for name in SOURCES[view]:
            text = text.replace("{" + name + "}", f"parquet.`{self.sf_dir}/{name}.parquet`")
        return self.spark.sql(text)

    @cached_property
    def weather(self) -> DataFrame:
        pct = F.rint(F.col("l_discount") * 100)
        agg = (self.read("lineitem")
               .groupBy(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("day"))
               .agg(F.greatest(F.lit(0.0), F.max("l_quantity") - 38.0).alias("p"),
                    (F.sum(pct) * 10.0 / F.count(F.lit(1))).alias("pm"),
                    F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"),
                    F.min("l_quantity").alias("q"), F.max(F.rint(F.col("l_tax") * 100)).alias("tax")))
        return agg.select(
            "cell_id", "day", F.when(F.col("lo") != 5, F.col("p")).alias("precipitation_sum"),
            F.when(F.col("lo") != 6, F.col("pm")).alias("pm10"),
            F.when(F.col("lo") != 7, F.col("pm") * 0.5).alias("pm2_5"),
            (F.col("tax") + 1.0).alias("wind_speed_10m_max"),
            (F.lit(65.0) + 5.0 * F.col("hi")).alias("relative_humidity_2m_mean"),
            (F.lit(8.0) + F.col("q") * 0.5).alias("temperature_2m_max"))


# Views stated as SQL that both engines read the same way. {name} marks a driver table.
SOURCES: dict[str, tuple[str, ...]] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sources: tuple[str, ...], text: str) -> None:
    SOURCES[name] = sources
    VIEWS[name] = text


WEATHER = """
select l_suppkey as cell_id, cast(l_shipdate as date) as day,
  case when min(l_linenumber) <> 5 then greatest(0e0, max(l_quantity) - 38e0) end as precipitation_sum,
  case when min(l_linenumber) <> 6 then sum(round_even(l_discount * 100, 0)) * 10e0 / count(*) end as pm10,
  case when min(l_linenumber) <> 7 then sum(round_even(l_discount * 100, 0)) * 10e0 / count(*) * 0.5e0 end as pm2_5,
  max(round_even(l_tax * 100, 0)) + 1e0 as wind_speed_10m_max,
  65e0 + 5e0 * max(l_linenumber) as relative_humidity_2m_mean,
  8e0 + min(l_quantity) * 0.5e0 as temperature_2m_max
from lineitem group by 1, 2"""


def ctes(*names: str, extra: str = "") -> str:
    """``with a as (...), b as (...)`` for the named views; ``extra`` adds further CTEs."""
    parts = []
    for name in names:
        text = WEATHER if name == "weather" else VIEWS[name]
        if name != "weather":
            for src in SOURCES[name]:
                text = text.replace("{" + src + "}", src)
        parts.append(f"{name} as ({text})")
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n"


def m6(expr: str) -> str:
    """SQL twin of ``numeric.micro``."""
    return f"round_even(cast({expr} as double) * 1e6, 0) / 1e6"


def r(expr: str, digits: int) -> str:
    """SQL twin of ``numeric.half_even``."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


view("arrays", ("part",), """
select p_partkey as array_id,
  cast(floor(p_partkey / 1000e0) as bigint) * 800 + ((p_partkey - p_partkey % 3) * 7919) % 701 + p_partkey % 3 * 6 + 0e0 as minx,
  ((p_partkey - p_partkey % 3) * 104729) % 709 + p_partkey % 2 + 0e0 as miny,
  cast(floor(p_partkey / 1000e0) as bigint) * 800 + ((p_partkey - p_partkey % 3) * 7919) % 701 + p_partkey % 3 * 6 + 3 + p_size % 6 + 0e0 as maxx,
  ((p_partkey - p_partkey % 3) * 104729) % 709 + p_partkey % 2 + 3 + p_partkey % 5 + 0e0 as maxy,
  (3 + p_size % 6) * (3 + p_partkey % 5) + 0e0 as area_m2,
  ((p_partkey * 37) % 1000) / 1000e0 as risk_score,
  case when p_partkey % 7 <> 0 then (10 + (p_size % 9) * 8) / 10e0 end as loss_pct_p50,
  case when p_partkey % 7 <> 0 then (10 + (p_size % 9) * 8) / 25e0 end as loss_pct_p10,
  case when p_partkey % 7 <> 0 then (10 + (p_size % 9) * 8) / 5e0 end as loss_pct_p90,
  case when p_partkey % 4 = 0 then (20 + (p_partkey % 23) * 7) / 10e0 end as permit_kw,
  case when p_partkey % 6 <> 0 then (p_partkey * 13) % 41 + 0e0 end as tilt_deg,
  (p_partkey * 29) % 360 + 0e0 as azimuth_deg,
  case when p_partkey % 5 <> 0 then 0.8e0 + (p_partkey % 40) / 100e0 end as poa_rel,
  case when p_partkey % 9 <> 0 then (p_partkey % 50) / 50e0 end as canopy_frac,
  case when p_partkey % 8 <> 0 then (p_partkey * 17) % 20 + 0e0 end as nearest_canopy_m,
  (p_partkey * 41) % 900 + 0e0 as distance_to_agriculture_m,
  (p_partkey * 43) % 600 + 0e0 as distance_to_highway_m
from {part}""")

view("sites", ("orders",), """
select o_orderkey as site_id, o_custkey as owner_id,
  0.5e0 + floor(o_totalprice / 1000e0) / 10e0 as system_kw,
  0.5e0 + (o_orderkey % 97) / 10e0 as loss_pct,
  4e0 + (o_custkey % 25) / 10e0 as sun_hours,
  case when o_custkey % 3 <> 0 then cast(o_orderdate as date) + 8000 end as install_date
from {orders}""")

view("permits", ("orders",), """
select o_orderkey as app_no, o_custkey as parcel_no,
  substr(lpad(cast(o_custkey as string), 8, '0'), 1, 3) || '-' || substr(lpad(cast(o_custkey as string), 8, '0'), 4, 3)
    || '-' || substr(lpad(cast(o_custkey as string), 8, '0'), 7, 2) as apn,
  case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) + 8000 end as issued,
  case when o_orderkey % 11 <> 0 then floor(o_totalprice / 200e0) / 100e0 end as kw,
  case when o_orderpriority = '1-URGENT' then 'ground-mount' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'roof-mount' end as mount,
  case when o_orderkey % 3 = 0 then 'install photovoltaic array' when o_orderkey % 3 = 1 then 'solar pool heater' else 'PV system 12 modules' end as description
from {orders}""")

view("scored", ("orders",), """
select o_orderkey as row_id, o_custkey % 150 as station_id, cast(year(o_orderdate) as int) as yr,
  o_custkey % 25 as county, case when o_custkey % 2 = 0 then 'A' else 'B' end as instrument,
  floor(o_totalprice) % 1000 / 1000e0 as score,
  case when o_orderstatus = 'F' or (o_totalprice > 300000 and o_orderkey % 3 = 0) then 1 else 0 end as label,
  floor(o_totalprice / 100e0) / 500e0 as y,
  floor(o_totalprice / 100e0) / 500e0 * 0.8e0 + ((o_orderkey * 17) % 100) / 50e0 as p50,
  floor(o_totalprice / 100e0) / 500e0 * 0.8e0 + ((o_orderkey * 17) % 100) / 50e0 - 1e0 as p10,
  floor(o_totalprice / 100e0) / 500e0 * 0.8e0 + ((o_orderkey * 17) % 100) / 50e0 + 1.25e0 as p90
from {orders}""")

view("parcels", ("customer",), """
select c_custkey as parcel_no,
  cast(floor(c_custkey / 750e0) as bigint) * 800 + (c_custkey % 750 % 28) * 25 + 0e0 as minx,
  cast(floor((c_custkey % 750) / 28e0) as bigint) * 25 + 0e0 as miny,
  cast(floor(c_custkey / 750e0) as bigint) * 800 + (c_custkey % 750 % 28) * 25 + 25e0 as maxx,
  cast(floor((c_custkey % 750) / 28e0) as bigint) * 25 + 25e0 as maxy
from {customer} where c_mktsegment <> 'BUILDING'""")

_BOXES = """select l_orderkey * 8 + l_linenumber as id, cast(floor(l_orderkey / 8e0) as bigint) as tile_id,
    ((l_orderkey % 8) * 37 + l_linenumber * 13) % 200 + 0e0 as gx, (l_linenumber * 29 + (l_orderkey % 8) * 11) % 200 + 0e0 as gy,
    20 + (l_orderkey % 5) * 4 + 0e0 as w, 20 + (l_linenumber % 4) * 5 + 0e0 as h, max(l_quantity) as q,
    floor(max(l_discount) * 100 + 0.5e0) as d, floor(max(l_tax) * 100 + 0.5e0) as t, max(l_returnflag) as rf, max(l_linestatus) as ls
  from {lineitem} group by l_orderkey, l_linenumber"""

view("preds", ("lineitem",), f"""
select id as det_id, tile_id, gx + d * 0.7e0 as minx, gy + t * 0.5e0 as miny, gx + d * 0.7e0 + w as maxx, gy + t * 0.5e0 + h as maxy,
  q / 50e0 as score from ({_BOXES}) b where d <> 4""")

view("truths", ("lineitem",), f"""
select id as gt_id, tile_id, gx as minx, gy as miny, gx + w as maxx, gy + h as maxy, case when tile_id % 3 = 0 then 'val' else 'test' end as split
from ({_BOXES}) b where t <> 3 and q > 8""")

view("labelled", ("lineitem",), """
select l_orderkey * 8 + l_linenumber as det_id, l_orderkey as tile_id, l_quantity / 50e0 as score,
  case when l_returnflag = 'A' then 'tp' when l_returnflag = 'R' then 'fp' else 'fn' end as class,
  case when l_returnflag = 'A' then 0.5e0 + l_tax * 5 end as iou,
  case when l_returnflag <> 'N' and l_linenumber <> 6 then floor(l_extendedprice / 10e0) end as pred_area_px,
  case when l_returnflag <> 'R' and l_linenumber <> 7 then floor(l_extendedprice / 12e0) end as gt_area_px,
  case when l_linenumber <> 5 then l_quantity * 5 end as distance_to_image_edge_px,
  case when l_linenumber <> 4 then l_linenumber - 1 end as num_other_panels_in_tile
from {lineitem}""")


def sql_piecewise(x: str, xs, ys) -> str:
    """SQL twin of ``numeric.piecewise_linear``."""
    parts = [f"when {x} <= {float(xs[0])!r}e0 then {float(ys[0])!r}e0"]
    for i in range(1, len(xs)):
        x0, x1, y0, y1 = (float(v) for v in (xs[i - 1], xs[i], ys[i - 1], ys[i]))
        parts.append(f"when {x} <= {x1!r}e0 then {y0!r}e0 + ({x} - {x0!r}e0) / {x1 - x0!r}e0 * {y1 - y0!r}e0")
    return f"case when {x} is null then null " + " ".join(parts) + f" else {float(ys[-1])}e0 end"


def sql_draw(hex_expr: str, slot: int) -> str:
    """SQL twin of ``numeric.uniform``."""
    return f"((('0x' || substr({hex_expr}, {6 * slot + 1}, 6))::ubigint)::double + 0.5e0) / 16777216e0"


def sql_draw_fine(hex_expr: str) -> str:
    """SQL twin of ``numeric.uniform_fine``."""
    return f"((('0x' || substr({hex_expr}, 1, 13))::ubigint)::double + 0.5e0) / 4503599627370496e0"
