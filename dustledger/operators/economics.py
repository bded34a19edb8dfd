"""Cleaning economics per site: best strategy, Monte Carlo, break-evens, sweeps.

The three strategies are fixed, so they are columns of one row and never a join. Sweep points are exploded from a literal
range inside the task and collapse in the partial aggregate; the draws of a site are an array inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import cents, draw_key, half_even, uniform
from dustledger.session import deal

ACTIONS = ("no_clean", "rinse_service", "professional")
COSTS: dict[str, Callable[[Column], Column]] = {
    "rinse_service": pv.rinse_cost, "professional": pv.professional_cost}


def recovery_pair(basis: str = "measured") -> tuple[Column, Column]:
    """(rinse, professional) recovery shares of a basis."""
    pair = K.RECOVERY[basis]
    return F.lit(pair["rinse_service"]), F.lit(pair["professional"])


def best_strategy(df: DataFrame, kw: str = "system_kw", loss_pct: str = "loss_pct",
                  hours: str = "sun_hours", rate: str = "usd_per_kwh",
                  recovery: tuple[Column, Column] | None = None) -> DataFrame:
    """Add per-strategy dollars and the strategy with the largest net, in cents.

    Rounding comes before the comparison; on ties the earlier strategy wins, and a paid strategy
    is only worth it when its net is positive.
    """
    rinse, pro = recovery or recovery_pair()
    loss = pv.annual_loss_usd(F.col(kw), F.col(hours), F.col(loss_pct) / 100.0, F.col(rate))
    out = df.withColumn("_loss", loss)
    for name, share in (("rinse", rinse), ("pro", pro)):
        cost = pv.rinse_cost(F.col(kw)) if name == "rinse" else pv.professional_cost(F.col(kw))
        out = out.withColumns({f"_rec_{name}": F.col("_loss") * share, f"_cost_{name}": cost})
        out = out.withColumns({
            f"{name}_recovered_usd": cents(F.col(f"_rec_{name}")),
            f"{name}_cost_usd": cents(F.col(f"_cost_{name}")),
            f"{name}_net_usd": cents(F.col(f"_rec_{name}") - F.col(f"_cost_{name}"))})
    n_r, n_p = F.col("rinse_net_usd"), F.col("pro_net_usd")
    action = (F.when((n_r > 0) & (n_r >= n_p), "rinse_service").when(n_p > 0, "professional")
              .when(F.col("_loss").isNotNull(), "no_clean"))
    out = out.withColumns({"annual_loss_usd": cents(F.col("_loss")), "recommended_action": action})
    is_r = F.col("recommended_action") == "rinse_service"
    worth = F.col("recommended_action") != "no_clean"
    net, cost = F.when(is_r, n_r).otherwise(n_p), F.when(is_r, F.col("rinse_cost_usd")).otherwise(F.col("pro_cost_usd"))
    rec = F.when(is_r, F.col("rinse_recovered_usd")).otherwise(F.col("pro_recovered_usd"))
    return out.withColumns({
        "worth_cleaning": worth,
        "expected_net_usd": F.when(worth, net).when(F.col("recommended_action").isNotNull(), F.lit(0.0)),
        "roi": F.when(worth & (cost > 0), half_even(net / cost, 2)),
        "payback_years": F.when(worth & (rec > 0), half_even(cost / rec, 2))}).drop(
        "_loss", "_rec_rinse", "_rec_pro", "_cost_rinse", "_cost_pro")


# ---- uncertainty -----------------------------------------------------------------------------------
#: Fractional parts of the square roots of the first primes: steps of an additive low-discrepancy sequence.
STRIDES = (0.41421356237309515, 0.7320508075688772, 0.2360679774997898, 0.6457513110645907, 0.3166247903553998)


_SITE = ("system_kw", "loss_p10", "loss_p50", "loss_p90", "sun_hours", "rate_lo", "rate_hi", "rec_rinse", "rec_pro")


def _draw_inputs(df: DataFrame, key: str, seed: int, *others: str) -> DataFrame:
    """The columns that the draws of a site need, with its five random starts, dealt over all shuffle partitions."""
    narrow = df.select(key, *others, *[F.col(c).cast("double").alias(c) for c in _SITE])
    starts = deal(narrow, key).withColumn("_k", draw_key(F.col(key), seed))
    return starts.withColumns({f"_s{i}": uniform(F.col("_k"), i) for i in range(5)}).drop("_k")


def _site_nets(batch: pa.RecordBatch, n_samples: int, cells: int = 1 << 14) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, net_rinse, net_pro) of a batch, a few sites at a time; the nets are arrays (site, draw), NaN where an input is null.

    ``fmax`` and ``fmin`` skip NaN as greatest and least skip null.
    """
    column = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*_SITE, *[f"_s{i}" for i in range(5)])}
    walk = [np.arange(1, n_samples + 1) * s for s in STRIDES]
    sigma = math.sqrt(math.log(1.0 + K.AREA_SCALE_1SIGMA**2))
    at_once = max(1, cells // n_samples)
    for first in range(0, batch.num_rows, at_once):
        rows = slice(first, min(first + at_once, batch.num_rows))
        c = {name: values[rows, None] for name, values in column.items()}
        u = [c[f"_s{i}"] + walk[i] for i in range(5)]
        u = [np.maximum(w - np.floor(w), 1e-9) for w in u]
        radius, angle = np.sqrt(-2.0 * np.log(u[1])), 6.283185307179586 * u[2]
        z1, z2 = radius * np.cos(angle), radius * np.sin(angle)
        p50 = c["loss_p50"]
        lo = np.fmax(1e-9, (p50 - np.fmin(c["loss_p10"], p50)) / K.Z90)
        hi = np.fmax(1e-9, (np.fmax(c["loss_p90"], p50) - p50) / K.Z90)
        loss = np.fmax(0.0, np.where(u[0] < lo / (lo + hi), p50 - np.abs(z1 * lo), p50 + np.abs(z1 * hi)))
        kw = np.fmax(1e-6, c["system_kw"] * np.exp(-0.5 * sigma**2 + sigma * z2))
        rate = c["rate_lo"] + (c["rate_hi"] - c["rate_lo"]) * u[3]
        share = c["rec_rinse"] + (c["rec_pro"] - c["rec_rinse"]) * u[4]
        rec = pv.annual_loss_of(kw, c["sun_hours"], loss / 100.0, rate) * share
        cost = pv.professional_cost_of(kw)
        yield rows, rec * (c["rec_rinse"] / c["rec_pro"]) - np.fmax(K.RINSE_COST_FACTOR * cost, K.MIN_RINSE_USD), rec - cost


def net_draws(df: DataFrame, key: str, n_samples: int, seed: int) -> DataFrame:
    """(key, draw, net_rinse, net_pro): one row per (site, draw).

    Needs system_kw, loss_p10, loss_p50, loss_p90, sun_hours, rate_lo, rate_hi, rec_rinse, rec_pro.
    Draws are functions of (site, draw, seed): the same on any partitioning or retry. One digest per
    site gives five random starts; draw by draw each moves on by its own irrational stride modulo 1 (a randomly
    shifted additive sequence), so a draw costs arithmetic only and covers the cube more evenly than independent draws.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rinse, pro in _site_nets(batch, n_samples):
                site = np.repeat(np.arange(part.start, part.stop), n_samples)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(site)), pa.array(np.tile(np.arange(1, n_samples + 1, dtype="int32"), len(rinse))),
                     pa.array(rinse.ravel(), from_pandas=True), pa.array(pro.ravel(), from_pandas=True)], names=[key, "draw", "net_rinse", "net_pro"])

    kind = df.schema[key].dataType.simpleString()
    return _draw_inputs(df, key, seed).mapInArrow(rows, f"`{key}` {kind}, draw int, net_rinse double, net_pro double")


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the nearest-rank quantile among n sorted draws."""
    return min(n - 1, max(0, int(round(q * (n - 1)))))


def monte_carlo(df: DataFrame, key: str, n_samples: int = 2000, seed: int = 42) -> DataFrame:
    """Spread of the net per site, for the point action or else the best paid strategy.

    ``df`` has one row per site (needs the columns of ``net_draws`` and recommended_action). Sites are dealt over all
    shuffle partitions; the draws of a few sites at a time are arrays inside the task and leave it as one row per site, so
    they are neither shuffled nor sorted on disk.
    """
    quantiles = {f"expected_net_usd_p{int(q * 100)}": nearest_rank(n_samples, q) for q in (0.10, 0.50, 0.90)}

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            action = batch.column("recommended_action").to_numpy(zero_copy_only=False)
            parts = []
            for rows, rinse, pro in _site_nets(batch, n_samples):
                mean_r, mean_p = rinse.mean(axis=1), pro.mean(axis=1)
                use = (action[rows] == "rinse_service") | ((action[rows] == "no_clean") & (mean_r >= mean_p))
                net = np.where(use[:, None], rinse, pro)
                # a net of NaN stands for null and is not positive
                positive = (net > 0).mean(axis=1)
                some = ((rinse > 0) | (pro > 0)).mean(axis=1)
                ordered = np.partition(net, sorted(set(quantiles.values())), axis=1)
                parts.append([*[ordered[:, rank] for rank in quantiles.values()], np.where(use, mean_r, mean_p), positive, some])
            if parts:
                columns = [pa.array(np.concatenate(c), from_pandas=True) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *quantiles, "_mean", "_prob", "_any"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in (*quantiles, "_mean", "_prob", "_any"))
    drawn = _draw_inputs(df, key, seed, "recommended_action").mapInArrow(summaries, schema)
    return drawn.select(
        key, *[cents(F.col(c)).alias(c) for c in quantiles], cents(F.col("_mean")).alias("expected_net_usd_mean"),
        half_even(F.col("_prob"), 4).alias("prob_net_positive"),
        half_even(F.col("_any"), 4).alias("prob_any_action_positive"),
        ((F.col("_prob") >= 0.80) | (F.col("_prob") <= 0.20)).alias("decision_robust"))


def with_default_interval(df: DataFrame, regime: str = K.DEFAULT_REGIME) -> DataFrame:
    """Fill loss interval, rate band and recovery shares where the table has none."""
    lo, hi = pv.regime_rate(regime, 1), pv.regime_rate(regime, 2)
    rinse, pro = recovery_pair()
    both = F.col("loss_p10").isNotNull() & F.col("loss_p90").isNotNull()
    return df.withColumns({
        "loss_p10": F.when(both, F.col("loss_p10")).otherwise(F.col("loss_p50") * K.LOSS_P10_OVER_P50),
        "loss_p90": F.when(both, F.col("loss_p90")).otherwise(F.col("loss_p50") * K.LOSS_P90_OVER_P50),
        "rate_lo": F.lit(min(lo, hi)), "rate_hi": F.lit(max(lo, hi)), "rec_rinse": rinse, "rec_pro": pro})


# ---- break-even ----------------------------------------------------------------------------------------
KW_GRID = 5270  # 0.1 kW steps to 30 kW, then 1 kW steps to 5000 kW


def breakeven_kw_table(spark: SparkSession, action: str, bands: int = 8) -> DataFrame:
    """Intervals (band, need_gt, need_le] -> smallest grid kW that nets more than zero.

    A site recovers ``c`` dollars per kW, so kW pays when ``cost(kW)/kW < c``. The running minimum
    of cost per kW over the fixed grid turns the search into one lookup of c. At most KW_GRID rows,
    repeated over the logarithmic bands of c they cover.
    """
    i = F.col("id")
    kw = F.when(i <= 300, i / F.lit(10.0)).otherwise(F.lit(30.0) + (i - 300))
    grid = spark.range(1, KW_GRID + 1).coalesce(1).select(i.alias("i"), kw.alias("kw"))
    from pyspark.sql import Window as W

    order = W.orderBy("i")  # fixed grid of KW_GRID rows
    g = grid.withColumn("need", COSTS[action](F.col("kw")) / F.col("kw"))
    g = g.withColumn("prev", F.min("need").over(order.rowsBetween(W.unboundedPreceding, -1)))
    g = g.filter(F.col("prev").isNull() | (F.col("need") < F.col("prev")))
    top = F.floor(F.log("prev") * bands)
    first = F.floor(F.log("need") * bands)
    last = F.coalesce(top, first + 40 * bands)
    return g.select(F.explode(F.sequence(first, last)).alias("band"), F.col("need").alias("need_gt"),
                    F.coalesce("prev", F.lit(float("inf"))).alias("need_le"), F.col("kw").alias("breakeven_kw"))


def breakeven_system_kw(df: DataFrame, key: str, action: str, recovery: Column,
                        loss_pct: str = "loss_pct", hours: str = "sun_hours",
                        rate: str = "usd_per_kwh", bands: int = 8) -> DataFrame:
    """(key, breakeven_kw): null when no size up to 5000 kW pays."""
    c = pv.annual_loss_usd(F.lit(1.0), F.col(hours), F.col(loss_pct) / 100.0, F.col(rate)) * recovery
    sites = df.select(key, c.alias("c")).withColumn("band", F.floor(F.log(F.when(F.col("c") > 0, F.col("c"))) * bands))
    table = breakeven_kw_table(df.sparkSession, action, bands)
    cond = (sites["band"] == table["band"]) & (sites["c"] > table["need_gt"]) & (sites["c"] <= table["need_le"])
    # the table is a fixed grid (KW_GRID rows and their bands), so its size is bounded
    return sites.join(F.broadcast(table), cond, "left").select(sites[key], "breakeven_kw")


def breakeven_loss_pct(kw: Column, hours: Column, rate: Column, recovery: Column, action: str,
                       pct_max: float = 30.0) -> Column:
    """First 0.1-point loss level with a positive net; null beyond ``pct_max``."""
    per_point = pv.annual_loss_usd(kw, hours, F.lit(0.01), rate) * recovery
    tenths = F.floor(COSTS[action](kw) / F.when(per_point > 0, per_point) * 10.0) + 1
    return F.when(tenths <= int(round(pct_max * 10)), F.greatest(F.lit(1), tenths) / 10.0)


def breakeven_tariff(kw: Column, hours: Column, loss_pct: Column, rate: Column, recovery: Column,
                     action: str) -> Column:
    """Electricity price at which the action just pays; null when nothing is recovered."""
    rec = pv.annual_loss_usd(kw, hours, loss_pct / 100.0, rate) * recovery
    return half_even(rate * COSTS[action](kw) / F.when(rec > 0, rec), 4)


# ---- sweeps ------------------------------------------------------------------------------------------------
def sweep(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Repeat every row for each of a few literal values (no join, no shuffle)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def rate_sensitivity(sites: DataFrame, rates: Sequence[float]) -> DataFrame:
    """Per electricity price: sites recommended to clean, share, total and mean net dollars."""
    priced = best_strategy(sweep(sites, "usd_per_kwh", rates))
    agg = priced.groupBy("usd_per_kwh").agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.sum(F.when(F.col("worth_cleaning"), 1).otherwise(0)).alias("n_clean"),
        F.sum(F.rint(F.col("expected_net_usd") * 100).cast("long")).alias("_cents"))
    return agg.select(
        "usd_per_kwh", "n_sites", "n_clean", (100.0 * F.col("n_clean") / F.col("n_sites")).alias("pct_clean"),
        (F.col("_cents") / 100.0).alias("total_net_usd"),
        (F.col("_cents") / 100.0 / F.col("n_sites")).alias("mean_net_usd"))


def flip_rates(curve: DataFrame) -> DataFrame:
    """First price at which any site, and at which half of the sites, are worth cleaning."""
    return curve.agg(F.min(F.when(F.col("pct_clean") > 0, F.col("usd_per_kwh"))).alias("flip_any"),
                     F.min(F.when(F.col("pct_clean") >= 50, F.col("usd_per_kwh"))).alias("flip_half"))


def strategy_grid(df: DataFrame, recovery: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per (input row, strategy) with dollars and is_best."""
    rinse, pro = recovery or recovery_pair()
    kw = F.col("system_kw")
    loss = pv.annual_loss_usd(kw, F.col("sun_hours"), F.col("loss_pct") / 100.0, F.col("usd_per_kwh"))
    d = df.withColumns({"_loss": loss, "_cr": pv.rinse_cost(kw), "_cp": pv.professional_cost(kw)})

    def row(i: int, name: str, share: Column, cost: Column) -> Column:
        rec = F.col("_loss") * share
        return F.struct(F.lit(i).alias("pos"), F.lit(name).alias("scenario"), rec.alias("rec"),
                        cost.alias("cost"), (rec - cost).alias("net"))

    rows = F.array(row(0, "no_clean", F.lit(0.0), F.lit(0.0)), row(1, "rinse_service", rinse, F.col("_cr")),
                   row(2, "professional", pro, F.col("_cp")))
    top = F.greatest(F.lit(0.0), F.col("_loss") * rinse - F.col("_cr"), F.col("_loss") * pro - F.col("_cp"))
    first = F.when(top <= 0.0, F.lit(0)).when(F.col("_loss") * rinse - F.col("_cr") >= top, F.lit(1)).otherwise(F.lit(2))
    d = d.withColumns({"_best": first, "_rows": rows}).withColumn("s", F.explode("_rows"))
    return d.select(
        *df.columns, F.col("s.scenario").alias("scenario"), cents(F.col("_loss")).alias("annual_loss_usd"),
        cents(F.col("s.rec")).alias("recovered_usd"), cents(F.col("s.cost")).alias("cost_usd"),
        cents(F.col("s.net")).alias("net_benefit_usd"), (F.col("s.pos") == F.col("_best")).alias("is_best"))


def coverage_needed(kw: Column, hours: Column, rate: Column, recovery: Column, case: str) -> Column:
    """Smallest of 400 coverage levels 0.01..1.0 whose band loss pays one professional wash."""
    need = 100.0 * pv.professional_cost(kw) / (kw * hours * 365.0 * K.SYSTEM_DERATE * rate * recovery)
    xs, ys = K.BAND_LOSS_F, K.BAND_LOSS_PCT[case]
    cap = 100.0 * 4 / 20 if "mlpe" in case else 100.0
    # the loss curve never falls, so the level that reaches `need` is its inverse
    target = F.when(need <= min(max(ys), cap), need)
    inv = F.lit(None).cast("double")
    for i in range(len(xs) - 1, 0, -1):
        if ys[i] > ys[i - 1]:
            seg = xs[i - 1] + (target - ys[i - 1]) / (ys[i] - ys[i - 1]) * (xs[i] - xs[i - 1])
            inv = F.when(target <= ys[i], seg).otherwise(inv)
    step = 0.99 / 399.0
    index = F.greatest(F.lit(0), F.ceil((inv - 0.01) / step - 1e-9))
    return F.when(target.isNotNull(), 0.01 + index * step)


def value_concentration(sites: DataFrame, key: str, value: str, top: int = 10) -> DataFrame:
    """Gini (clipped at 0, tie-averaged ranks) and the share held by the ``top`` rows."""
    from dustledger.operators.ranks import attach_row, cumulative, value_table

    clipped = sites.select(key, F.greatest(F.lit(0.0), F.col(value)).alias("x"))
    ranked = cumulative(value_table(clipped, [], "x"), [])
    rank = F.col("n_below") + (F.col("n") + 1) / 2.0
    n = F.col("n_total")
    gini = ranked.agg(
        F.max(n).alias("n_sites"), F.sum(F.col("v") * F.col("n")).alias("total_usd"),
        (F.sum((2.0 * rank - n - 1.0) * F.col("v") * F.col("n"))
         / F.when(F.sum(F.col("v") * F.col("n")) > 0, F.max(n) * F.sum(F.col("v") * F.col("n")))).alias("gini"))
    best = clipped.orderBy(F.desc("x"), key).limit(top).agg(F.sum("x").alias("top_usd"))
    return attach_row(gini, best).select("n_sites", "total_usd", "gini", "top_usd")
