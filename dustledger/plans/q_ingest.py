"""Queries of the ingestion, contract, text and roll-up operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import pv, text as TX
from dustledger.functions.numeric import half_even, micro
from dustledger.operators import contracts as C, rollup as RU, tiles as TI
from dustledger.plans.q_economics import pro_cost_sql, rinse_cost_sql
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6, r, sql_draw_fine, sql_piecewise, view
from dustledger.sources import permits as PE, polygons as PO, readers as RD, stations as SN


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


# ---- A: sources ----------------------------------------------------------------------------------------------
# one JSON document per customer: a station with up to three annual entries
view("station_docs", ("customer",), """
select c_custkey as doc_id, '{"S' || c_custkey || '": {"IWSR": "' || case when c_custkey % 5 = 0 then '>0.' || (90 + c_custkey % 10) when c_custkey % 11 = 0 then 'n/a' else '0.' || (800 + c_custkey % 200) end
  || '", "Latitude": ' || case when c_custkey % 13 = 0 then 'null' else '3' || (c_custkey % 9) || '.5' end || ', "Longitude": -12' || (c_custkey % 5) || '.25, "State": "CA", "County": "C' || (c_custkey % 40)
  || '", "Months in data set": ' || (c_custkey % 90) || ', "Annual IWSR": [["Year", "IWSR", "IWSR lower", "IWSR upper"], ["' || (2010 + c_custkey % 4) || '", "0.' || (850 + c_custkey % 100) || '", "0.8", "0.99"], ["' || (2014 + c_custkey % 4)
  || '", ">0.' || (91 + c_custkey % 9) || '"], ["2019"]]}}' as value
from {customer}""")

_ST = """raw as (select c_custkey as k, case when c_custkey % 5 = 0 then '>0.' || (90 + c_custkey % 10) when c_custkey % 11 = 0 then 'n/a' else '0.' || (800 + c_custkey % 200) end as txt,
   case when c_custkey % 13 <> 0 then 30e0 + c_custkey % 9 + 0.5e0 end as lat, -120e0 - c_custkey % 5 - 0.25e0 as lon from customer),
 summ as (select 'S' || k as station_id, lat as latitude, lon as longitude, case when txt like '>%' then (try_cast(substr(txt, 2) as double) + 1e0) / 2e0 else try_cast(txt as double) end as iwsr, txt like '>%' as iwsr_censored, k from raw),
 sm as (select * from summ where latitude is not null and iwsr is not null),
 pan as (select 'S' || k as station_id, 2010 + k % 4 as year, lat as latitude, lon as longitude, try_cast('0.' || (850 + k % 100) as double) as iwsr, false as iwsr_censored, 0.8e0 as iwsr_lower, 0.99e0 as iwsr_upper from raw where lat is not null
   union all select 'S' || k, 2014 + k % 4, lat, lon, (try_cast('0.' || (91 + k % 9) as double) + 1e0) / 2e0, true, null, null from raw where lat is not null)"""


@query("a2_station_summary", f"with {_ST} select station_id, latitude, longitude, {m6('iwsr')} as iwsr, iwsr_censored from sm")
def _(t):
    return _round(SN.station_summary(t.sql("station_docs")), "iwsr").select("station_id", "latitude", "longitude", "iwsr", "iwsr_censored")


@query("a3_station_year_panel", f"with {_ST} select station_id, cast(year as int) as year, {m6('iwsr')} as iwsr, iwsr_censored, iwsr_lower, iwsr_upper from pan")
def _(t):
    return _round(SN.station_panel(t.sql("station_docs")), "iwsr").select("station_id", "year", "iwsr", "iwsr_censored", "iwsr_lower", "iwsr_upper")


@query("a4_censored_values", f"with {_ST} select k, {m6('iwsr')} as iwsr, iwsr_censored from summ")
def _(t):
    r = t.sql("station_docs").select(F.col("doc_id").alias("k"), F.regexp_extract("value", '"IWSR": "([^"]*)"', 1).alias("txt"))
    v, c = SN.censored_value(F.col("txt"))
    return r.select("k", micro(v).alias("iwsr"), c.alias("iwsr_censored"))


@query("a10_label_merge", f"with {_ST}, p as (select station_id, cast(year as int) as year, iwsr, make_date(year::bigint, 12, 31) as as_of, false as is_summary from pan where not iwsr_censored) "
       + f"select station_id, year, as_of, {m6('iwsr')} as iwsr, is_summary, cast(iwsr < 0.944 as int) as label from (select * from p union all select station_id, 2026, iwsr, date '2026-01-01', true from sm where station_id not in (select station_id from p))")
def _(t):
    docs = t.sql("station_docs")
    panel = SN.station_panel(docs)
    out = SN.merge_labels(panel, SN.station_summary(docs), 0.944, "2026-01-01")
    return _round(out.select("station_id", "year", "as_of", "iwsr", "is_summary", "label"), "iwsr")


@query("a5_filtered_load", "select c_custkey, min(c_nationkey) as c_nationkey, min(c_acctbal) as c_acctbal from customer where lower(c_mktsegment) like '%build%' group by 1")
def _(t):
    return RD.filtered_load(t.read("customer"), "c_mktsegment", "Build", ["c_custkey", "c_nationkey", "c_acctbal"], "c_custkey")


# three report lines per order
view("permit_lines", ("orders",), """
select 'permits_20' || (10 + o_custkey % 10) as file, o_orderkey * 4 as line_no, 'BP-' || (10000 + o_orderkey) || ' ISSUED ' || substr(cast(cast(o_orderdate as date) as string), 6, 2) || '/' || substr(cast(cast(o_orderdate as date) as string), 9, 2) || '/20' || substr(cast(cast(o_orderdate as date) as string), 3, 2)
  || ' ' || (100 + o_custkey % 900) || '-' || (100 + o_custkey % 800) || '-' || (10 + o_custkey % 80) as text from {orders}
union all select 'permits_20' || (10 + o_custkey % 10), o_orderkey * 4 + 1, 'DOE JANE ' || (1 + o_orderkey % 999) || ' MAIN ST' from {orders}
union all select 'permits_20' || (10 + o_custkey % 10), o_orderkey * 4 + 2, 'C O U N T Y report page' from {orders} where o_orderkey % 7 = 0
union all select 'permits_20' || (10 + o_custkey % 10), o_orderkey * 4 + 3, case when o_orderkey % 3 = 0 then 'Install ' || (1 + o_orderkey % 20) || '.' || (10 + o_orderkey % 80) || ' kW roof mount PV system' when o_orderkey % 3 = 1 then 'reroof dwelling' else 'solar pool heater' end from {orders}""")


@query("a6_permit_text_records", """select cast(2010 + o_custkey % 10 as int) as year, 'BP-' || (10000 + o_orderkey) as app_no, strftime(o_orderdate, '%m/%d/') || '20' || strftime(o_orderdate, '%y') as date_issued,
 (100 + o_custkey % 900) || '-' || (100 + o_custkey % 800) || '-' || (10 + o_custkey % 80) as apn, case when o_orderkey % 3 = 0 then (1 + o_orderkey % 20) + (10 + o_orderkey % 80) / 100e0 end as kw,
 case when o_orderkey % 3 = 0 then 'roof-mount' end as mount, 'DOE JANE ' || (1 + o_orderkey % 999) || ' MAIN ST' as situs_raw from orders where o_orderkey % 3 <> 1""")
def _(t):
    return PE.parse_permits(t.sql("permit_lines")).select("year", "app_no", "date_issued", "apn", "kw", "mount", "situs_raw")


view("label_lines", ("part",), """
select p_partkey as tile_id, p_partkey % 3 || ' 0.1 0.2 0.' || (300 + p_size) || ' 0.2 0.' || (300 + p_size) || ' 0.' || (400 + p_size) || ' 0.1 0.' || (400 + p_size) || case when p_partkey % 2 = 0 then ' 0.' || (50 + p_size % 40) else '' end as line
from {part}""")


@query("a7_polygon_label_lines", f"""with p as (select p_partkey, p_size, (300 + p_size) / 1000e0 as x2, (400 + p_size) / 1000e0 as y2, 100e0 * 0.2e0 * 100e0 * 0.2e0 as s from part)
select p_partkey as tile_id, cast(p_partkey % 3 as int) as class_id, case when p_partkey % 2 = 0 then (50 + p_size % 40) / 100e0 else 1e0 end as confidence, 4 as n_vertices, {m6('(x2 - 0.1e0) * (y2 - 0.2e0) * s')} as area from p where (x2 - 0.1e0) * (y2 - 0.2e0) * s > 1""")
def _(t):
    tl = t.read("part").select(F.col("p_partkey").alias("tile_id"), F.array(F.lit(0.2), F.lit(0.0), F.lit(5000.0), F.lit(0.0), F.lit(-0.2), F.lit(9000.0)).alias("transform"),
                               F.lit(100).alias("width"), F.lit(100).alias("height"))
    p = PO.parse_polygon_lines(t.sql("label_lines"), tl)
    return p.select("tile_id", "class_id", "confidence", F.size("ring").alias("n_vertices"), micro(F.col("area")).alias("area"))


@query("a8_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return C.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("a8_id_set_drift", "select c_custkey, 'lost' as side from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 200000) union all select distinct o_custkey, 'gained' from orders where o_orderstatus = 'P' and o_totalprice > 200000 and o_custkey not in (select c_custkey from customer)")
def _(t):
    later = t.read("orders").filter("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return C.id_set_drift(t.read("customer"), later, ["c_custkey"])


_SHARDS = "sh as (select l_suppkey as system_id, 'shard_' || lpad(cast(l_linenumber as varchar), 2, '0') || '_' || lpad(cast(l_orderkey as varchar), 12, '0') || '_' || l_partkey || '_' || l_extendedprice as file, l_quantity as loss_pct, l_partkey as n_valid from lineitem)"


@query("a9_shard_merge", f"with {_SHARDS} select system_id, arg_min(loss_pct, file) as first_loss, arg_max(loss_pct, file) as last_loss from sh group by 1")
def _(t):
    sh = t.read("lineitem").select(
        F.col("l_suppkey").alias("system_id"), F.concat_ws("_", F.lit("shard"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                                                           F.col("l_partkey"), F.col("l_extendedprice")).alias("file"), F.col("l_quantity").alias("loss_pct"))
    a = SN.merge_shards(sh, "system_id", "file", ["loss_pct"]).withColumnRenamed("loss_pct", "first_loss")
    b = SN.merge_shards(sh, "system_id", "file", ["loss_pct"], last=True).withColumnRenamed("loss_pct", "last_loss")
    return a.join(b, "system_id")


@query("a9_skip_reasons", "select case when l_tax = 0.08 then 'no_fit' when l_returnflag = 'R' then 'degenerate' when l_linenumber < 5 then 'low_n_valid' else 'kept' end as reason, count(*) as n from lineitem group by 1")
def _(t):
    f = t.read("lineitem").select(F.when(F.col("l_tax") != 0.08, F.col("l_quantity")).alias("loss_pct"), (F.col("l_returnflag") == "R").alias("degenerate"), F.col("l_linenumber").alias("n_valid"))
    return SN.fleet_skips(f)


@query("a11_bounding_box", "select c_custkey, longitude, latitude from (select c_custkey, -125e0 + c_custkey % 100 / 10e0 as longitude, 32e0 + c_custkey % 70 / 10e0 as latitude from customer) where longitude between -122 and -118 and latitude between 34 and 37")
def _(t):
    c = t.read("customer").select("c_custkey", (-125.0 + F.col("c_custkey") % 100 / 10.0).alias("longitude"), (32.0 + F.col("c_custkey") % 70 / 10.0).alias("latitude"))
    return RD.in_bbox(c, (-122, 34, -118, 37))


@query("a12_column_names", "select l_suppkey as system_id, cast(l_shipdate as date) as day, sum(l_quantity) as energy_kwh, max(l_quantity) as power_max_kw from lineitem group by 1, 2")
def _(t):
    raw = t.read("lineitem").groupBy(F.col("l_suppkey").alias("system_id"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("inverter_1_AC_energy_daily_sum"), F.max("l_quantity").alias("inverter_1_ac_power_daily_max"), F.count(F.lit(1)).alias("other"))
    return RD.normalise_telemetry(raw, ["system_id", "day"])


@query("a13_first_stamp_wins", "with e as (select user_id, date_trunc('hour', ts) as ts, cast(event_id % 4 as int) as file, value from events) select user_id, ts, arg_min(value, {'f': file, 'v': value}) as value from e group by 1, 2")
def _(t):
    e = t.read("events").select("user_id", F.date_trunc("hour", "ts").alias("ts"), (F.col("event_id") % 4).cast("int").alias("file"), "value")
    return SN.first_stamp_wins(e, "user_id", "ts", "file", "value")


@query("a14_run_manifest", """with r as (select md5(o_custkey || '|' || o_orderkey || '|' || o_orderstatus) as h from orders),
 s as (select count(*) as n, sum(('0x' || substr(h, 1, 8))::ubigint)::hugeint as a, sum(('0x' || substr(h, 9, 8))::ubigint)::hugeint as b from r)
select 'orders' as stage, n as n_rows, md5(n || '|' || a || '|' || b) as content_hash, (select count(distinct o_custkey) from orders) as n_owners from s""")
def _(t):
    o = t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return C.run_manifest(o, "orders", {"n_owners": F.count_distinct("o_custkey")})


@query("a15_index_merge_later_wins", "select s_suppkey as k, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as v from supplier")
def _(t):
    s = t.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    both = s.withColumn("src", F.lit(1)).unionByName(s.filter("k % 3 = 0").select("k", (F.col("v") + 1).alias("v"), F.lit(2).alias("src")))
    return SN.merge_shards(both, "k", "src", ["v"], last=True)


@query("a16_review_tags_carried", """with q as (select o_custkey as apn, cast(year(o_orderdate) as int) as yr, count(*) as n from orders group by 1, 2), tg as (select apn, yr, 'tag' || apn % 4 as tag from q where apn % 3 = 0)
select q.apn, q.yr, n, coalesce(tag, '') as tag from q left join tg on q.apn = tg.apn and q.yr = tg.yr""")
def _(t):
    q = t.read("orders").groupBy(F.col("o_custkey").alias("apn"), F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    tags = q.filter("apn % 3 = 0").select("apn", "yr", F.concat(F.lit("tag"), F.col("apn") % 4).alias("tag"))
    return q.join(tags, ["apn", "yr"], "left").withColumn("tag", F.coalesce("tag", F.lit("")))


@query("a17_resumable_build_queue", f"""with l as (select c_custkey as system_id, -125e0 + c_custkey * 7 % 600 / 10e0 as lon, (c_custkey % 100) / 10e0 as loss_pct from customer)
select system_id, lon, {m6('1e0 - loss_pct / 100e0')} as iwsr, cast(1e0 - loss_pct / 100e0 < 0.97 as int) as label from l where system_id % 4 <> 0""")
def _(t):
    l = t.read("customer").select(F.col("c_custkey").alias("system_id"), (-125.0 + F.col("c_custkey") * 7 % 600 / 10.0).alias("lon"), (F.col("c_custkey") % 100 / 10.0).alias("loss_pct"))
    out = SN.build_queue(l, l.filter("system_id % 4 = 0"), "system_id", None, 0.97)
    return _round(out.select("system_id", "lon", "iwsr", "label"), "iwsr")


# ---- B: scalars -------------------------------------------------------------------------------------------------
@query("b1_apn_base", ctes("permits") + "select app_no, replace(apn, '-', '') as prefix8, replace(apn, '-', '') as digits from permits")
def _(t):
    return t.sql("permits").select("app_no", TX.apn_base(F.col("apn")).alias("prefix8"), TX.apn_base(F.col("apn"), "digits").alias("digits"))


@query("b2_clean_street", "select o_orderkey, case when o_orderkey % 5 <> 0 then (1 + o_orderkey % 999) || ' Oak Hill ' || case when o_orderkey % 2 = 0 then 'Rd' else 'Lane' end end as street from orders")
def _(t):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("SMITH JOHN "), F.when(k % 5 == 0, F.concat(F.lit("P.O. BOX "), k)).otherwise(F.concat((1 + k % 999).cast("string"), F.lit(" OAK   HILL "), F.when(k % 2 == 0, "RD").otherwise("LANE"))), F.lit(" $0.00 Install"))
    return t.read("orders").select("o_orderkey", TX.clean_street(raw).alias("street"))


@query("b3_address_parse", """select c_custkey, case when c_custkey % 7 <> 0 then (1 + c_custkey % 500) || ' Elm St' end as line1, case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then 'Apt ' || c_custkey % 9 else '' end as line2,
 case when c_custkey % 7 <> 0 then 'Aptos' end as city, case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then 'NV' when c_custkey % 4 = 1 then 'OR' else 'CA' end as state, case when c_custkey % 7 <> 0 then '95' || (100 + c_custkey % 800) end as zip from customer""")
def _(t):
    k = F.col("c_custkey")
    z = F.concat(F.lit("95"), (100 + k % 800).cast("string"))
    st = F.when(k % 4 == 0, F.concat(F.lit("Nevada, "), z)).when(k % 4 == 1, F.concat(F.lit("OR "), z, F.lit("-1234"))).otherwise(F.concat(F.lit("CA "), z))
    a = F.when(k % 7 == 0, F.lit("no address given, none")).otherwise(F.concat((1 + k % 500).cast("string"), F.lit(" Elm St, "), F.when(k % 3 == 0, F.concat(F.lit("Apt "), (k % 9).cast("string"), F.lit(", "))).otherwise(""), F.lit("Aptos, "), st))
    p = t.read("customer").select("c_custkey", TX.parse_us_address(a).alias("p"))
    return p.select("c_custkey", "p.line1", "p.line2", "p.city", "p.state", "p.zip")


@query("b17_climate_zone_one_hot", """with c as (select c_custkey, 31e0 + c_custkey % 80 / 10e0 as lat, -124e0 + c_custkey % 110 / 10e0 as lon from customer)
select c_custkey, case when lon < -120 then 1 else 0 end as zone_coastal, case when lon >= -120 and (lon > -116 or (lat < 34.5 and lon > -117.5)) then 1 else 0 end as zone_desert,
 case when lon >= -120 and not (lon > -116 or (lat < 34.5 and lon > -117.5)) then 1 else 0 end as zone_valley from c""")
def _(t):
    z = pv.climate_zone(31.0 + F.col("c_custkey") % 80 / 10.0, -124.0 + F.col("c_custkey") % 110 / 10.0)
    return t.read("customer").select("c_custkey", *[(z == n).cast("int").alias(f"zone_{n}") for n in ("coastal", "desert", "valley")])


_D = "install_date"


@query("b18_tariff_and_vintage", ctes("sites") + f"""select site_id, case when {_D} >= date '2023-04-15' then 'nbt_no_battery' when {_D} is not null then 'nem2_legacy' end as regime,
 case when {_D} is null then 'unknown' when {_D} < date '2016-12-15' then 'nem1' when {_D} < date '2023-04-15' then 'nem2' else 'nbt' end as vintage,
 least(abs(datediff('day', {_D}, date '2016-12-15')), abs(datediff('day', {_D}, date '2023-04-15'))) < 120 as ambiguous,
 case when {_D} is null then 'unknown' when {_D} < date '2020-01-01' then 'pre_flight' when {_D} <= date '2021-01-01' then 'ambiguous' else 'post_flight' end as lidar_era from sites""")
def _(t):
    d = F.col(_D)
    return t.sql("sites").select("site_id", pv.tariff_regime(d).alias("regime"), pv.vintage_class(d).alias("vintage"), pv.vintage_ambiguous(d).alias("ambiguous"), pv.lidar_era(d).alias("lidar_era"))


@query("b19_inverter_architecture", ctes("sites") + f"select site_id, case when year({_D}) >= 2019 then 'mlpe' when year({_D}) >= 2017 then 'transitional' when {_D} is not null then 'mixed_pre2017' else 'unknown' end as architecture from sites")
def _(t):
    return t.sql("sites").select("site_id", pv.inverter_architecture(F.year(_D)).alias("architecture"))


@query("b20_age_and_degradation", ctes("sites", extra=f"a as (select site_id, case when {_D} is not null then greatest(0e0, datediff('day', {_D}, date '2026-01-01') / 365.25e0) end as age, cast(year({_D}) as double) as yr from sites)")
       + f"select site_id, {m6('age')} as age_years, {m6('case when age is null then 1e0 else power(0.995e0, age) end')} as production_factor, {m6(sql_piecewise('yr', K.VINTAGE_YEARS, K.VINTAGE_W_PER_M2))} as module_w_per_m2 from a")
def _(t):
    age = pv.age_years(F.col(_D), F.to_date(F.lit("2026-01-01")))
    return t.sql("sites").select("site_id", micro(age).alias("age_years"), micro(pv.production_factor(age)).alias("production_factor"), micro(pv.module_w_per_m2(F.year(_D))).alias("module_w_per_m2"))


_CANO = "(0.4425e0 + 0.5575e0 * exp(-greatest(0e0, least(60e0, {t})) / 11.641e0))"
_LT = f"greatest(0e0, least(1e0, ({_CANO.format(t='tilt_deg')} - {_CANO.format(t='35e0')}) / ({_CANO.format(t='0e0')} - {_CANO.format(t='35e0')})))"


@query("b21_tilt_and_canopy_scores", ctes("arrays", extra=f"s as (select array_id, case when tilt_deg is null then 1e0 else {_CANO.format(t='tilt_deg')} / {_CANO.format(t='20e0')} end as tf, case when tilt_deg is null then 0e0 else {_LT} end as lt, greatest(coalesce(canopy_frac, 0e0), coalesce(greatest(0e0, 1e0 - nearest_canopy_m / 9e0), 0e0)) as cs from arrays)")
       + f"select array_id, {m6('tf')} as tilt_factor, {m6('lt')} as low_tilt_score, {m6('cs')} as canopy_score, {m6('0.7e0 * lt + 0.3e0 * cs')} as persistent_score from s")
def _(t):
    a, c, n = F.col("tilt_deg"), F.col("canopy_frac"), F.col("nearest_canopy_m")
    return t.sql("arrays").select("array_id", micro(pv.tilt_soiling_factor(a)).alias("tilt_factor"), micro(pv.low_tilt_score(a)).alias("low_tilt_score"),
                                  micro(pv.canopy_score(c, n)).alias("canopy_score"), micro(pv.persistent_score(a, c, n)).alias("persistent_score"))


@query("b22_cost_ladder", ctes("sites") + f"select site_id, cast(greatest(1e0, round_even(system_kw / 0.44e0, 0)) as bigint) as panels, {r(pro_cost_sql('system_kw'), 2)} as professional_usd, {r(rinse_cost_sql('system_kw'), 2)} as rinse_usd from sites")
def _(t):
    kw = F.col("system_kw")
    return t.sql("sites").select("site_id", pv.panels(kw).cast("long").alias("panels"), half_even(pv.professional_cost(kw), 2).alias("professional_usd"), half_even(pv.rinse_cost(kw), 2).alias("rinse_usd"))


@query("b23_area_kw_sun_hours", ctes("arrays") + f"select array_id, {m6(f'area_m2 / {K.M2_PER_KW!r}e0')} as system_kw, {m6('case when poa_rel > 0 then 5.5e0 * 1.1507e0 * poa_rel else 5.5e0 end')} as sun_hours, {m6(f'area_m2 / {K.M2_PER_KW!r}e0 * (case when poa_rel > 0 then 5.5e0 * 1.1507e0 * poa_rel else 5.5e0 end) * 365e0 * 0.84e0 * 0.028e0 * 0.3e0')} as annual_loss_usd from arrays")
def _(t):
    kw, sun = pv.kw_from_area(F.col("area_m2")), pv.sun_hours(F.col("poa_rel"))
    return t.sql("arrays").select("array_id", micro(kw).alias("system_kw"), micro(sun).alias("sun_hours"), micro(pv.annual_loss_usd(kw, sun, F.lit(0.028), F.lit(0.3))).alias("annual_loss_usd"))


@query("b24_band_loss_by_case", "with f as (select p_partkey, p_size / 50e0 as f from part) select p_partkey, " + ", ".join(
    f"{m6(f'least({100.0 * 4 / 20 if chr(109) + chr(108) + chr(112) + chr(101) in c else 100.0}e0, {sql_piecewise(chr(102), K.BAND_LOSS_F, K.BAND_LOSS_PCT[c])})')} as {c}" for c in K.BAND_LOSS_PCT) + " from f")
def _(t):
    f = F.col("p_size") / 50.0
    return t.read("part").select("p_partkey", *[micro(pv.band_loss_pct(f, c)).alias(c) for c in K.BAND_LOSS_PCT])


@query("b25_shade_and_equilibrium", ctes("arrays", extra="s as (select array_id, case when tilt_deg is not null then 1e0 + 0.6e0 * coalesce(canopy_frac, 0e0) + 0.25e0 * greatest(0e0, (35e0 - tilt_deg) / 35e0) + 0.15e0 * abs(azimuth_deg - 180e0) / 180e0 end as sh from arrays)")
       + f"select array_id, {m6('sh')} as shade, {m6('case when sh <= 1.05e0 then 0e0 else 0.3e0 * (1e0 - exp(-2.5e0 * (sh - 1.05e0))) end')} as equilibrium from s")
def _(t):
    a = t.sql("arrays")
    s = pv.shade_factor(F.coalesce("canopy_frac", F.lit(0.0)), F.col("tilt_deg"), F.col("azimuth_deg"))
    return a.select("array_id", micro(s).alias("shade"), micro(pv.roof_equilibrium(s)).alias("equilibrium"))


@query("b27_marginal_value", ctes("sites") + f"select site_id, {m6(f'case when {_D} >= date {chr(39)}2023-04-15{chr(39)} then {pv.regime_rate(chr(110) + chr(98) + chr(116) + chr(95) + "no_battery")!r}e0 when {_D} is not null then {pv.regime_rate("nem2_legacy")!r}e0 else {pv.blended_rate()!r}e0 end')} as usd_per_kwh, case when {_D} >= date '2023-04-15' then 'install_date:nbt_no_battery' when {_D} is not null then 'install_date:nem2_legacy' else 'population_mix' end as rate_source from sites")
def _(t):
    rate, src = pv.site_rate(F.col(_D))
    return t.sql("sites").select("site_id", micro(rate).alias("usd_per_kwh"), src.alias("rate_source"))


@query("b29_opaque_site_key", ctes("permits") + "select app_no, case when app_no % 10 = 0 then 's:0123456789' else 's:' || substr(sha256('salt:' || replace(apn, '-', '')), 1, 10) end as site_key from permits")
def _(t):
    site = F.when(F.col("app_no") % 10 == 0, F.lit("public:s:0123456789")).otherwise(F.concat(F.lit("apn:"), F.col("apn")))
    return t.sql("permits").select("app_no", TX.site_key(site, "salt").alias("site_key"))


@query("b32_feature_groups", ctes("weather") + "select cell_id, " + ", ".join(m6(f"avg({c})") + f" as {c}" for c in (
    "precipitation_sum", "pm10", "pm2_5", "wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max")) + " from weather group by 1")
def _(t):
    """Weather-group columns picked by name, averaged per cell."""
    w = t.weather
    cols = [c for c in w.columns if TX.feature_group(c) == "weather"]
    return w.groupBy("cell_id").agg(*[micro(F.avg(c)).alias(c) for c in cols])


@query("b33_city_and_zip", "select c_custkey, case when c_custkey % 5 <> 0 then case when c_custkey % 2 = 0 then 'Santa Cruz' else 'Aptos' end end as city, case when c_custkey % 5 <> 0 then cast(95000 + c_custkey % 900 as varchar) end as zip from customer")
def _(t):
    """City and ZIP out of free text; every fifth text has none."""
    k = F.col("c_custkey")
    place = F.concat(F.lit("owner 12 at "), F.when(k % 2 == 0, "Santa  Cruz").otherwise("Aptos"), F.lit(" CA "), (95000 + k % 900).cast("string"), F.lit("-0001 (rear)"))
    city, code = TX.city_zip(F.when(k % 5 == 0, F.lit("no place 95003")).otherwise(place))
    return t.read("customer").select("c_custkey", city.alias("city"), code.alias("zip"))


@query("b33_name_parsing", "select o_orderkey, case when o_orderkey % 4 <> 0 then 'ca' end as region, case when o_orderkey % 4 <> 0 then cast(2010 + o_custkey % 13 as int) end as vintage, 'tile_' || lpad(cast(o_orderkey as varchar), 6, '0') || '.png' as tile from orders")
def _(t):
    k = F.col("o_orderkey")
    src = F.when(k % 4 == 0, F.lit("aerial.tif")).otherwise(F.concat(F.lit("naip_ca_"), (2010 + F.col("o_custkey") % 13).cast("string"), F.lit("_512_"), k.cast("string"), F.lit(".tif")))
    name = F.concat(F.lit("tile_"), F.lpad(k.cast("string"), 6, "0"), F.when(k % 2 == 0, F.lit("_png.rf.ab12CD.jpg")).otherwise(F.lit(".png")))
    region, year = TX.region_vintage(src)
    return t.read("orders").select("o_orderkey", region.alias("region"), year.alias("vintage"), TX.canonical_tile_name(name).alias("tile"))


# ---- C13-C17 and D roll-ups -----------------------------------------------------------------------------------------
@query("c1_left_join_with_provenance", ctes("arrays", "permits", extra="p as (select parcel_no, max(kw) as kw from permits group by 1)")
       + "select array_id, p.kw as permit_kw, case when p.kw is not null then 'permit' else 'area_estimate' end as kw_source from arrays left join p on arrays.array_id = p.parcel_no")
def _(t):
    p = t.sql("permits").groupBy(F.col("parcel_no").alias("array_id")).agg(F.max("kw").alias("permit_kw"))
    j = t.sql("arrays").select("array_id").join(p, "array_id", "left")
    return j.withColumn("kw_source", F.when(F.col("permit_kw").isNotNull(), "permit").otherwise("area_estimate"))


@query("c2_one_to_one_join", "select c_custkey as k, n, c_acctbal as v from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def _(t):
    n = t.read("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return C.one_to_one(n, t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), ["k"])


@query("c13_registered_and_detected", ctes("arrays", "permits", extra="p as (select distinct parcel_no from permits where kw > 10), d as (select distinct array_id % 1500 as parcel_no from arrays where risk_score > 0.5)")
       + "select coalesce(p.parcel_no, d.parcel_no) as parcel_no, p.parcel_no is not null as registered, d.parcel_no is not null as detected from p full join d on p.parcel_no = d.parcel_no")
def _(t):
    p = t.sql("permits").filter("kw > 10").select("parcel_no").distinct().withColumn("registered", F.lit(True))
    d = t.sql("arrays").filter("risk_score > 0.5").select((F.col("array_id") % 1500).alias("parcel_no")).distinct().withColumn("detected", F.lit(True))
    return p.join(d, "parcel_no", "full").fillna(False, ["registered", "detected"])


@query("c14_cached_range_cover", """with f as (select l_suppkey as cell, cast(l_shipdate as date) as s, cast(l_shipdate as date) + 900 as e from lineitem),
 q as (select o_custkey % (select count(*) from supplier) as cell, o_orderkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 700 as e from orders)
select o_orderkey, exists (select 1 from f where f.cell = q.cell and f.s <= q.s and f.e >= q.e) as covered from q""")
def _(t):
    """Spans of one fixed length: the best file for a request is the latest one that starts in time."""
    from dustledger.operators.lookup import covered_by_span
    from dustledger.operators.ranks import attach_row

    f = t.read("lineitem").select(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("s")).withColumn("e", F.date_add("s", 900))
    n = t.read("supplier").agg(F.count(F.lit(1)).alias("_n"))
    q = attach_row(t.read("orders"), n).select((F.col("o_custkey") % F.col("_n")).alias("cell"), "o_orderkey", F.to_date("o_orderdate").alias("s"))
    q = q.withColumn("e", F.date_add("s", 700))
    return covered_by_span(q, f, "cell", "s", "e").select("o_orderkey", "covered")


@query("c15_feedback_labels", f"""with e as (select user_id as array_id, value, event_id from events where event_type = 'purchase')
select array_id, event_id, {m6('greatest(0e0, 1e0 - value / 100e0)')} as iwsr, cast(greatest(0e0, 1e0 - value / 100e0) < 0.944 as int) as label from e join (select p_partkey from part where p_partkey % 2 = 0) on p_partkey = array_id""")
def _(t):
    from dustledger.operators.lookup import feedback_labels

    e = t.read("events").filter("event_type = 'purchase'").select(F.col("user_id").alias("array_id"), F.col("value").alias("actual_recovery_pct"), "event_id")
    a = t.read("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("array_id"))
    return _round(feedback_labels(e, a, "array_id", 0.944), "iwsr").select("array_id", "event_id", "iwsr", "label")


@query("c16_cell_class_lookup", """with cl as (select l_suppkey % 50 as cx, l_partkey % 40 as cy, cast(l_linenumber as int) as priority, max(case when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 11 else 12 end) as class from lineitem group by 1, 2, 3),
 b as (select cx, cy, arg_min(class, priority) as class from cl where class <> 0 group by 1, 2), p as (select c_custkey, cast(round_even((c_custkey % 97) / 2e0, 0) as bigint) as cx, cast(round_even((c_custkey % 89) / 2e0, 0) as bigint) as cy from customer)
select c_custkey, b.class from p left join b on p.cx = b.cx and p.cy = b.cy""")
def _(t):
    from dustledger.operators.lookup import first_class

    cl = t.read("lineitem").groupBy((F.col("l_suppkey") % 50).alias("cx"), (F.col("l_partkey") % 40).alias("cy"), F.col("l_linenumber").alias("priority")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 11).otherwise(12)).alias("class"))
    p = t.read("customer").select("c_custkey", F.rint(F.col("c_custkey") % 97 / 2.0).cast("long").alias("cx"), F.rint(F.col("c_custkey") % 89 / 2.0).cast("long").alias("cy"))
    return first_class(p, cl, ["cx", "cy"], "class", "priority").select("c_custkey", "class")


@query("c17_parcel_centre_with_fallback", ctes("permits", "parcels", extra="p as (select app_no, parcel_no, app_no % 400 + 0.5e0 as gx, app_no % 300 + 0.5e0 as gy from permits)")
       + "select app_no, coalesce((q.minx + q.maxx) / 2e0, gx) as cx, coalesce((q.miny + q.maxy) / 2e0, gy) as cy, case when q.parcel_no is null then 'geocode' else 'parcel' end as centre_source from p left join parcels q on q.parcel_no = p.parcel_no")
def _(t):
    from dustledger.operators.lookup import parcel_centre

    p = t.sql("permits").select("app_no", "parcel_no", (F.col("app_no") % 400 + 0.5).alias("gx"), (F.col("app_no") % 300 + 0.5).alias("gy"))
    return parcel_centre(p, t.sql("parcels"), "parcel_no", "gx", "gy").select("app_no", "cx", "cy", "centre_source")


_SITE = "(array_id * 7919) % (select count(*) // 3 from part)"


def _sited(t):
    from dustledger.operators.ranks import attach_row

    n = t.read("part").agg(F.floor(F.count(F.lit(1)) / 3).alias("_n"))
    return attach_row(t.sql("arrays"), n).withColumn("site_id", F.col("array_id") * 7919 % F.col("_n")).drop("_n")


@query("d1_site_rollup", ctes("arrays", extra=f"s as (select *, {_SITE} as site_id from arrays)")
       + f"""select site_id, sum(area_m2) as site_area_m2, count(*) as n_polygons, arg_max(array_id, {{'a': area_m2, 'i': -array_id}}) as primary_id, {m6('sum(loss_pct_p50 * area_m2) / sum(case when loss_pct_p50 is not null then area_m2 end)')} as loss_pct_p50,
 {m6('sum(poa_rel * area_m2) / sum(case when poa_rel is not null then area_m2 end)')} as poa_rel, max(permit_kw) as permit_kw, {m6('avg(risk_score)')} as risk_score from s group by 1""")
def _(t):
    s = RU.site_rollup(_sited(t), "site_id", averaged=("loss_pct_p50", "poa_rel"), permit="permit_kw", risk="risk_score")
    return _round(s, "loss_pct_p50", "poa_rel", "risk_score")


@query("d2_primary_polygon", ctes("arrays", extra=f"s as (select *, {_SITE} as site_id from arrays)")
       + "select array_id, row_number() over (partition by site_id order by area_m2 desc, array_id) = 1 as site_primary from s")
def _(t):
    return RU.primary_flags(_sited(t), "site_id").select("array_id", "site_primary")


@query("d4_last_known_per_parcel", ctes("permits") + """select parcel_no, arg_max(kw, {'i': coalesce(issued, date '0001-01-01'), 'a': app_no}) filter (kw is not null) as last_kw, arg_max(mount, {'i': coalesce(issued, date '0001-01-01'), 'a': app_no}) filter (mount is not null) as last_mount,
 arg_min(mount, {'i': coalesce(issued, date '9999-12-31'), 'a': app_no}) filter (mount is not null) as first_mount from permits group by 1""")
def _(t):
    p = t.sql("permits")
    order = lambda undated: [F.coalesce("issued", F.lit(undated).cast("date")), F.col("app_no")]
    a = RU.last_known(p, "parcel_no", order("0001-01-01"), ["kw", "mount"]).withColumnsRenamed({"kw": "last_kw", "mount": "last_mount"})
    return a.join(RU.last_known(p, "parcel_no", order("9999-12-31"), ["mount"], first=True).withColumnRenamed("mount", "first_mount"), "parcel_no")


@query("d4_largest_and_earliest_row", ctes("permits", extra="""r as (select *, row_number() over (partition by parcel_no order by kw desc nulls last, app_no desc) as a, row_number() over (partition by parcel_no order by issued nulls last, app_no) as b from permits)""")
       + "select parcel_no, max(case when a = 1 then app_no end) as largest_app, max(case when a = 1 then kw end) as largest_kw, max(case when b = 1 then app_no end) as earliest_app from r group by 1")
def _(t):
    p = t.sql("permits")
    a = RU.whole_row(p, "parcel_no", [F.col("kw"), F.col("app_no")], ["app_no", "kw"]).withColumnsRenamed({"app_no": "largest_app", "kw": "largest_kw"})
    b = RU.whole_row(p, "parcel_no", [F.coalesce("issued", F.lit("9999-12-31").cast("date")), F.col("app_no")], ["app_no"], first=True).withColumnRenamed("app_no", "earliest_app")
    return a.join(b, "parcel_no")


@query("d5_permit_history", ctes("permits") + "select parcel_no, min(issued) as first_issued, max(issued) as last_issued, count(*) as n_permits from permits group by 1")
def _(t):
    return RU.permit_history(t.sql("permits"), "parcel_no", "issued")


@query("d9_dataset_audit", """with im as (select distinct case when l_orderkey % 3 = 0 then 'val' else 'train' end as split, l_orderkey as stem from lineitem where l_returnflag <> 'N'),
 lb as (select case when l_orderkey % 3 = 0 then 'val' else 'train' end as split, l_orderkey as stem, case when l_quantity > 3 then l_linenumber end as class, l_quantity / 49e0 as x, l_tax * 10 as y, l_discount * 10 as extent from lineitem where l_linestatus = 'O'),
 p as (select split, stem, count(class) as objects, count(case when x < 0 or x > 1 or y < 0 or y > 1 then 1 end) as bad, count(case when extent > 0.85 then 1 end) as large from lb group by 1, 2)
select coalesce(im.split, p.split) as split, count(im.stem) as images, count(p.stem) as labels, cast(coalesce(sum(objects), 0) as bigint) as objects, count(case when objects = 0 then 1 end) as empty_labels,
 count(case when p.stem is null then 1 end) as missing_labels, count(case when im.stem is null then 1 end) as orphan_labels, cast(coalesce(sum(bad), 0) as bigint) as bad_coords, cast(coalesce(sum(large), 0) as bigint) as large_objects
from im full join p on im.split = p.split and im.stem = p.stem group by 1""")
def _(t):
    l = t.read("lineitem").withColumns({"split": F.when(F.col("l_orderkey") % 3 == 0, "val").otherwise("train"), "stem": F.col("l_orderkey")})
    im = l.filter("l_returnflag <> 'N'").select("split", "stem")
    lb = l.filter("l_linestatus = 'O'").select("split", "stem", F.when(F.col("l_quantity") > 3, F.col("l_linenumber")).alias("class"), (F.col("l_quantity") / 49.0).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_discount") * 10).alias("extent"))
    return RU.dataset_audit(im, lb, "stem", "split")


@query("d10_strata_counts", "select coalesce(o_orderpriority, 'unknown') as region, count(case when o_orderstatus = 'F' then 1 end) as \"F\", count(case when o_orderstatus = 'O' then 1 end) as \"O\", count(case when o_orderstatus = 'P' then 1 end) as \"P\" from orders group by 1")
def _(t):
    o = t.read("orders").select(F.coalesce("o_orderpriority", F.lit("unknown")).alias("region"), "o_orderstatus")
    return o.groupBy("region").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


_STN = "s as (select c_custkey as k, c_custkey % 4 = 0 as censored, case when c_custkey % 9 <> 0 then c_custkey % 90 end as months from customer)"


@query("d20_censoring_by_span", f"with {_STN} select count(*) as n_stations, count(case when censored then 1 end) as n_censored, count(case when censored and months >= 24 then 1 end) as ge_2y, count(case when censored and months >= 36 then 1 end) as ge_3y, count(case when censored and months >= 60 then 1 end) as ge_5y from s where months is not null")
def _(t):
    k = F.col("c_custkey")
    return RU.censoring_by_span(t.read("customer").select((k % 4 == 0).alias("censored"), F.when(k % 9 != 0, k % 90).alias("months")))


@query("d19_sawtooth_closure", f"""with m as (select l_suppkey as st, month(l_shipdate) as m, avg(round_even(l_discount * 100, 0)) / 1000e0 - 0.004e0 as rate from lineitem group by 1, 2),
 s as (select st, avg(abs(rate)) as rate, 0.9e0 + st % 10 / 100e0 as iwsr from m group by 1)
select st, {m6('rate * 100e0')} as rate_pct_per_day, {m6('(1e0 - iwsr) * 100e0')} as loss_pct, {m6('2e0 * (1e0 - iwsr) / rate')} as implied_days from s where rate > 0""")
def _(t):
    """Twelve monthly rates per station, taken as the months' summed discounts."""
    m = t.read("lineitem").groupBy(F.col("l_suppkey").alias("st"), F.month("l_shipdate").alias("m")).agg((F.avg(F.rint(F.col("l_discount") * 100)) / 1000.0 - 0.004).alias("rate"))
    s = m.groupBy("st").agg(F.collect_list("rate").alias("rates")).withColumn("iwsr", 0.9 + F.col("st") % 10 / 100.0)
    return _round(RU.sawtooth_interval(s, "st", "iwsr", "rates"), "rate_pct_per_day", "loss_pct", "implied_days")


@query("d24_cell_spans", """with s as (select cast(round_even(c.c_custkey % 60 / 4e0, 0) as int) as cx, cast(o.o_orderdate as date) as a, cast(o.o_orderdate as date) + 300 as b from orders o join customer c on c.c_custkey = o.o_custkey)
select cx, greatest(min(a), date '1996-01-01') as span_start, least(max(b), date '2001-06-30') as span_end, count(*) as n_systems, greatest(min(a), date '1996-01-01') < least(max(b), date '2001-06-30') as usable from s group by 1""")
def _(t):
    o = t.read("orders").select(F.rint(F.col("o_custkey") % 60 / 4.0).cast("int").alias("cx"), F.to_date("o_orderdate").alias("s")).withColumn("e", F.date_add("s", 300))
    return RU.cell_spans(o, ["cx"], "s", "e", ("1996-01-01", "2001-06-30"))


_WC = ("precipitation_sum", "pm10", "pm2_5", "wind_speed_10m_max")


@query("d25_feature_coverage", ctes("weather") + " union all ".join(f"select cast(year(day) as int) as year, '{c}' as feature, {m6(f'avg(case when {c} is not null then 1e0 else 0e0 end)')} as coverage from weather group by 1" for c in _WC))
def _(t):
    w = t.weather.select(F.year("day").alias("year"), *_WC)
    return _round(RU.feature_coverage(w, ["year"]), "coverage")


@query("d26_median_imputation", ctes("weather", extra="m as (select " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) as m_{c}" for c in _WC) + " from weather where year(day) < 2000)")
       + "select cell_id, day, " + ", ".join(m6(f"coalesce({c}, m_{c})") + f" as {c}" for c in _WC) + ", 0e0 as absent from weather, m")
def _(t):
    """Medians come from the years before 2000 only; a column the table lacks is created."""
    w = t.weather.select("cell_id", "day", *_WC)
    med = RU.feature_medians(w.filter(F.year("day") < 2000).withColumn("absent", F.lit(None).cast("double")), [*_WC, "absent"])
    return _round(RU.impute(w, med, [*_WC, "absent"]), *_WC, "absent")


@query("d27_near_constant_guard", "select s_suppkey, s_acctbal from supplier")
def _(t):
    s = t.read("supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 5).alias("flat"))
    return RU.drop_near_constant(s, ["s_acctbal", "flat"])[0]


_PX = "px as (select l_suppkey as arr, case when l_linenumber <= 4 then 'panel' else 'ring' end as zone, 50e0 + l_quantity as red, 40e0 + l_discount * 500 + l_linenumber * 6 as nir from lineitem)"


@query("d28_vegetation_prevalence", f"""with {_PX}, v as (select *, (nir - red) / (nir + red) as ndvi from px),
 p as (select arr, count(*) as n_px, quantile_cont(ndvi, 0.5) as ndvi_p50, quantile_cont(ndvi, 0.9) as ndvi_p90, avg(case when ndvi >= 0.2 then 1e0 else 0e0 end) as veg from v where zone = 'panel' group by 1 having count(*) >= 6),
 q as (select arr, quantile_cont(ndvi, 0.5) as r from v where zone = 'ring' group by 1 having count(*) >= 6)
select p.arr, n_px, {m6('ndvi_p50')} as ndvi_p50, {m6('ndvi_p90')} as ndvi_p90, {m6('veg')} as veg_px_frac, {m6('r')} as roof_ndvi_p50, {m6('ndvi_p50 - r')} as ndvi_excess from p left join q on p.arr = q.arr""")
def _(t):
    l = t.read("lineitem").select(F.col("l_suppkey").alias("arr"), F.when(F.col("l_linenumber") <= 4, "panel").otherwise("ring").alias("zone"), (50.0 + F.col("l_quantity")).alias("red"), (40.0 + F.col("l_discount") * 500 + F.col("l_linenumber") * 6).alias("nir"))
    return _round(RU.vegetation_prevalence(l, "arr"), "ndvi_p50", "ndvi_p90", "veg_px_frac", "roof_ndvi_p50", "ndvi_excess")


@query("d29_run_comparison_f22_halt", f"""with r as (select yr, count(*) as n, avg(label * 1e0) as auc from (select cast(year(o_orderdate) as int) as yr, case when o_orderstatus = 'F' then 1 else 0 end as label from orders) group by 1)
select 'run_' || r.yr as run, r.n, {m6('case when r.yr = 1996 then null else auc end')} as auc, c.lo as ci_lo, {m6('case when r.yr <> 1996 then 0.34e0 - auc end')} as delta, coalesce(r.yr <> 1996 and 0.34e0 - auc > 0.005, false) as halt
from r left join (select yr, 0.1e0 * (yr - 1990) as lo from r where yr % 2 = 0) c on c.yr = r.yr""")
def _(t):
    m = t.read("orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("auc"))
    m = m.select(F.concat(F.lit("run_"), F.col("yr")).alias("run"), "yr", "n", F.when(F.col("yr") != 1996, F.col("auc")).alias("auc"))
    ci = m.filter("yr % 2 = 0").select("run", (0.1 * (F.col("yr") - 1990)).alias("ci_lo"))
    out = RU.halt_check(RU.run_table(m.drop("yr"), ci), "auc", 0.34, 0.005)
    return _round(out, "auc", "delta")


# ---- G11, G12, G14 dataset jobs --------------------------------------------------------------------------------------
@query("g11_hash_split", f"select o_orderkey, case when u < 0.8e0 then 'train' when u < 0.8e0 + 0.1e0 then 'val' else 'test' end as split from (select o_orderkey, {sql_draw_fine('''md5(cast(o_orderkey as varchar) || '|5')''')} as u from orders)")
def _(t):
    return TI.hash_split(t.read("orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "val": 0.1, "test": 0.1}, 5)


@query("g11_empty_cap_and_oversample", f"""with b as (select o_orderkey, o_orderstatus <> 'F' as empty, {sql_draw_fine('''md5(cast(o_orderkey as varchar) || '|3')''')} as u from orders),
 k as (select *, row_number() over (partition by empty order by u, o_orderkey) as rk, (select count(*) from b where not empty) as n from b)
select o_orderkey, cast(unnest(range(1, cast(2 - cast(empty as int) as bigint) + 1)) as int) as copy from k where not empty or rk <= floor(n * {0.2 / max(1e-9, 1 - 0.2)!r}e0)""")
def _(t):
    o = t.read("orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("empty"))
    kept = TI.cap_empty(o, "empty", "o_orderkey", 0.2, 3).withColumn("times", F.when(F.col("empty"), 1).otherwise(2))
    return TI.oversample(kept, "times").select("o_orderkey", "copy")


@query("g12_cleaning_reasons", "select case when l < 10 then 'dark' when n = 0 then 'no_label' when big = 0 then 'all_tiny' else 'kept' end as reason, count(*) as n, count(case when l >= 10 and n > 0 and big > 0 and big < n then 1 end) as n_pruned from (select l_orderkey, avg(l_quantity) as l, count(case when l_returnflag <> 'N' then 1 end) as n, count(case when l_returnflag <> 'N' and l_linenumber > 2 then 1 end) as big from lineitem group by 1) group by 1")
def _(t):
    lab = F.col("l_returnflag") != "N"
    s = t.read("lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("brightness"), F.count(F.when(lab, 1)).alias("n_labels"), F.count(F.when(lab & (F.col("l_linenumber") > 2), 1)).alias("n_large"))
    return TI.cleaning_reasons(s, 10.0).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pruned"), 1)).alias("n_pruned"))


@query("g14_balanced_owners", """with t as (select c_custkey as tile, 's' || c_nationkey as split, c_acctbal as x from customer),
 r as (select *, row_number() over (partition by split order by x, tile) - 1 as i, count(*) over (partition by split) as n from t),
 f as (select split, coalesce(sum(n % 2) over (order by split rows between unbounded preceding and 1 preceding), 0) % 2 as first from (select split, count(*) as n from t group by 1))
select tile, case when (case when i < (n + 1) // 2 then first else 1 - first end) = 0 then 'a' else 'b' end as owner from r join f on r.split = f.split""")
def _(t):
    c = t.read("customer").select(F.col("c_custkey").alias("tile"), F.concat(F.lit("s"), F.col("c_nationkey")).alias("split"), F.col("c_acctbal").alias("x"))
    return TI.balanced_owners(c, "split", "x", "tile").select("tile", "owner")
