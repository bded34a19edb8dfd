"""Lookups: span cover, feedback labels, cell classes, parcel centres, tiered part catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def covered_by_span(requests: DataFrame, spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Add covered: does some span of the same key contain [start, end]?

    Per (key, start day) only the furthest end matters, and the running maximum of ends over start
    days answers every request by one equal-key lookup on the last start day that is not later.
    A key has at most one such row per calendar day, so the window is bounded by the calendar.
    """
    day = spans.groupBy(key, start).agg(F.max(end).alias("_far"))
    marks = day.select(key, start, "_far", F.lit(0).alias("_q"))
    # requests of one key and day share the answer, so they enter the window once
    ask = requests.groupBy(key, start).agg(F.lit(1).alias("_q"))
    asks = ask.select(key, start, F.lit(None).cast("date").alias("_far"), "_q")
    both = marks.unionByName(asks)
    reach = F.max("_far").over(W.partitionBy(key).orderBy(start, "_q").rowsBetween(W.unboundedPreceding, 0))
    answered = both.withColumn("_reach", reach).filter("_q = 1").select(key, start, "_reach")
    return requests.join(answered, [key, start]).withColumn("covered", F.coalesce(F.col("_reach") >= F.col(end), F.lit(False))).drop("_reach")


def feedback_labels(feedback: DataFrame, arrays: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pseudo labels for feedback on known arrays: iwsr = max(0, 1 - recovery/100)."""
    iwsr = F.greatest(F.lit(0.0), 1.0 - F.col("actual_recovery_pct") / 100.0)
    return feedback.join(arrays, key).withColumns({"iwsr": iwsr, "label": (iwsr < threshold).cast("int"), "is_feedback": F.lit(True)})


def unmatched_feedback(feedback: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    return feedback.join(arrays.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def first_class(points: DataFrame, cells: DataFrame, cell: Sequence[str], value: str, priority: str) -> DataFrame:
    """Class of each point's cell: first non-zero one in priority order, else null."""
    best = cells.filter(F.col(value) != 0).groupBy(*cell).agg(F.min_by(value, priority).alias(value))
    return points.join(best, list(cell), "left")


def parcel_centre(permits: DataFrame, parcels: DataFrame, key: str, gx: str, gy: str) -> DataFrame:
    """Parcel centre where the parcel is known, else the geocoded point."""
    one = parcels.groupBy(key).agg(F.min(F.struct("minx", "miny", "maxx", "maxy")).alias("b"))
    j = permits.join(one, key, "left")
    return j.withColumns({
        "cx": F.coalesce((F.col("b.minx") + F.col("b.maxx")) / 2.0, F.col(gx)),
        "cy": F.coalesce((F.col("b.miny") + F.col("b.maxy")) / 2.0, F.col(gy)),
        "centre_source": F.when(F.col("b").isNull(), "geocode").otherwise("parcel")}).drop("b")


# ---- module temperature coefficient -----------------------------------------------------------------------
# Cell technology classes, brand prefixes in the catalogue, fleet default.
TECHNOLOGY_CLASS = {
    "mono-si": "Mono-c-Si", "mono-si ibc": "Mono-c-Si", "n-pert": "Mono-c-Si", "n-pert ibc": "Mono-c-Si", "n-shj": "Mono-c-Si",
    "n-topcon": "Mono-c-Si", "perc": "Mono-c-Si", "perc ibc": "Mono-c-Si", "perc bifacial": "Mono-c-Si", "sjt": "Mono-c-Si",
    "multi-si": "Multi-c-Si", "ribbon polycrystalline si": "Multi-c-Si", "amorphous si": "Thin Film",
    "cis family thin-film": "CIGS", "cylindrical cigs": "CIGS", "cdte": "CdTe",
}
BRAND_PREFIX = {
    "LG": "^LGELECTRONICS", "PANASONIC": "^SANYOELECTRIC|^PANASONIC", "SANYO": "^SANYOELECTRIC", "SOLARWORLD": "^SOLARWORLD",
    "TRINA": "^TRINASOLAR", "CANADIANSOLAR": "^CANADIANSOLAR", "SUNPOWER": "^SUNPOWER", "KYOCERA": "^KYOCERA", "SUNIVA": "^SUNIVA",
    "HYUNDAI": "^HYUNDAI", "REC": "^RECSOLAR|^REC", "SHARP": "^SHARP", "SUNTECH": "^SUNTECH", "YINGLI": "^YINGLI", "JINKO": "^JINKO",
    "SILIKEN": "^SILIKEN", "SCHOTT": "^SCHOTT", "SANTAN": "^SANTAN", "MITSUBISHI": "^MITSUBISHI", "EVERGREEN": "^EVERGREEN",
    "SOLARCITY": "^SOLARCITY", "SUNEDISON": "^SUNEDISON|^MEMC", "QCELLS": "^HANWHA|^QCELLS", "HANWHA": "^HANWHA", "SILFAB": "^SILFAB",
    "SEG": "^SEG", "AXITEC": "^AXITEC", "SOLARIA": "^SOLARIA", "ITEK": "^ITEK", "HELIENE": "^HELIENE", "MISSION": "^MISSIONSOLAR",
    "SERAPHIM": "^SERAPHIM", "PHONO": "^PHONOSOLAR", "ET": "^ETSOLAR", "ASTRONERGY": "^ASTRONERGY|^CHINTSOLAR",
}
FLEET_DEFAULT_GAMMA = -0.0045
GRAM = 4


def alnum(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))


def primary_module(systems: DataFrame, system: str, modules: str = "modules") -> DataFrame:
    """The module record with the most panels of each system's map."""
    best = F.reduce(F.map_values(modules), F.lit(None).cast(systems.schema[modules].dataType.valueType),
                    lambda a, v: F.when(a.isNull() | (F.coalesce(v["quantity"].try_cast("double"), F.lit(0.0)) > F.coalesce(a["quantity"].try_cast("double"), F.lit(0.0))), v).otherwise(a))
    return systems.withColumn("module", best)


def part_tokens(manufacturer: Column, model: Column) -> Column:
    """Part-number candidates: tokens (or whole names) holding a digit, upper-case alphanumeric."""
    both = F.concat(F.split(F.coalesce(manufacturer, F.lit("")), r"[\s/,;|]+"), F.split(F.coalesce(model, F.lit("")), r"[\s/,;|]+"))
    tok = F.filter(F.transform(both, alnum), lambda t: (F.length(t) >= 4) & t.rlike("[0-9]") & t.rlike("[A-Z]"))
    whole = F.filter(F.array(alnum(manufacturer), alnum(model)), lambda t: (F.length(t) >= 6) & t.rlike("[0-9]"))
    return F.array_distinct(F.concat(tok, whole))


def resolve_gamma(modules: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """(key, gamma, tier, matched): part number, else brand, else technology, else fleet default.

    ``modules`` (key, manufacturer, model, type, watts) is collapsed to distinct descriptions first.
    Contains-matches run as an equi join on 4-letter grams: the first gram of a token against all
    grams of a catalogue key. Medians of a catalogue match are over catalogue rows only.
    """
    desc = modules.select("manufacturer", "model", "type", "watts").distinct().withColumn("did", F.sha2(F.to_json(F.struct(
        F.coalesce("manufacturer", F.lit("")).alias("a"), F.coalesce("model", F.lit("")).alias("b"),
        F.coalesce("type", F.lit("")).alias("c"), F.coalesce(F.col("watts").cast("string"), F.lit("")).alias("d"))), 256))
    cat = catalogue.select("key_norm", "technology", "gamma_pdc", "stc_w")
    grams = cat.withColumn("g", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("key_norm") - GRAM + 1)), lambda i: F.substr(F.col("key_norm"), i, F.lit(GRAM))))))
    tok = desc.select("did", "watts", F.explode(part_tokens(F.col("manufacturer"), F.col("model"))).alias("tok")).withColumn("g", F.substring("tok", 1, GRAM))
    hit = tok.join(grams, "g").filter(F.contains("key_norm", "tok"))
    near = F.abs(F.col("stc_w") - F.col("watts")) <= F.greatest(F.lit(8.0), 0.06 * F.col("watts"))
    per_tok = hit.groupBy("did", "tok").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("n_near"),
        F.percentile("gamma_pdc", F.lit(0.5)).alias("g_all"), F.percentile(F.when(near, F.col("gamma_pdc")), F.lit(0.5)).alias("g_near"))
    narrow = (F.col("n") > 1) & (F.col("n_near") > 0)
    per_tok = per_tok.withColumn("g", F.when(narrow, F.col("g_near")).otherwise(F.col("g_all")))
    tier1 = per_tok.groupBy("did").agg(F.min(F.struct((-F.length("tok")).alias("len"), "tok", "g")).alias("b")).select(
        "did", F.col("b.tok").alias("m1"), F.col("b.g").alias("g1"))
    joined = F.concat_ws(" ", alnum(F.col("manufacturer")), alnum(F.col("model")))
    brand = F.lit(None).cast("string")
    for b in sorted(BRAND_PREFIX, key=len):
        brand = F.when(joined.contains(b), b).otherwise(brand)
    tags = F.array_compact(F.array(*[F.when(F.col("key_norm").rlike(p), F.lit(b)) for b, p in BRAND_PREFIX.items()]))
    by_brand = cat.withColumn("brand", F.explode(tags)).groupBy("brand").agg(F.percentile("gamma_pdc", F.lit(0.5)).alias("g2"))
    tech = F.create_map(*[F.lit(x) for kv in TECHNOLOGY_CLASS.items() for x in kv])
    by_tech = cat.groupBy(F.col("technology").alias("cls")).agg(F.percentile("gamma_pdc", F.lit(0.5)).alias("g3"))
    d = (desc.withColumns({"brand": brand, "cls": F.try_element_at(tech, F.lower(F.trim(F.coalesce("type", F.lit("")))))})
         .join(tier1, "did", "left").join(by_brand, "brand", "left").join(by_tech, "cls", "left"))
    d = d.withColumns({
        "gamma": F.coalesce("g1", "g2", "g3", F.lit(FLEET_DEFAULT_GAMMA)),
        "tier": F.when(F.col("g1").isNotNull(), "part_number").when(F.col("g2").isNotNull(), "brand").when(F.col("g3").isNotNull(), "technology").otherwise("fleet_default"),
        "matched": F.when(F.col("g1").isNotNull(), F.col("m1")).when(F.col("g2").isNotNull(), F.col("brand")).when(F.col("g3").isNotNull(), F.col("cls"))})
    m = modules
    cond = [m[c].eqNullSafe(d[c]) for c in ("manufacturer", "model", "type", "watts")]
    on = cond[0] & cond[1] & cond[2] & cond[3]
    return m.join(d, on).select(m[key], "gamma", "tier", "matched")
