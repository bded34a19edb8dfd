"""Folds, models and calibration on top of Spark ML; the contract is the table shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger.operators.ranks import attach_row, cumulative, rank_in_groups, row_numbers, value_table
from dustledger.operators.rollup import feature_medians, impute
from dustledger.operators.stats import dense_index
from dustledger.session import durable


# ---- regions and folds -------------------------------------------------------------------------------
def spatial_clusters(df: DataFrame, lat: str, lon: str, cluster_km: float = 10.0) -> DataFrame:
    """Add (lat_bin, lon_bin): square cells of about ``cluster_km`` at the mean latitude."""
    mean = df.agg(F.avg(lat).alias("_m"))
    deg = cluster_km / 111.0
    wide = cluster_km / (111.0 * F.greatest(F.lit(0.1), F.cos(F.radians("_m"))))
    return attach_row(df, mean).withColumns({"lat_bin": F.floor(F.col(lat) / deg), "lon_bin": F.floor(F.col(lon) / wide)}).drop("_m")


def kmeans_regions(df: DataFrame, lat: str, lon: str, k: int, seed: int = 0) -> DataFrame:
    d = df.withColumns({"_x": F.col(lat), "_y": F.col(lon) * F.cos(F.radians(F.col(lat)))})
    v = VectorAssembler(inputCols=["_x", "_y"], outputCol="_v").transform(d)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="region").fit(v)
    return model.transform(v).drop("_x", "_y", "_v")


def grouped_folds(df: DataFrame, group: str, n_folds: int) -> DataFrame:
    """(group, n_rows, fold): whole groups dealt to folds by falling size, back and forth.

    ``group`` must be numeric. Sizes are ranked across the cluster, so any number of groups works.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    r = row_numbers(sizes, "n_rows", group, "_rk").withColumn("_p", (F.col("_rk") - 1) % (2 * n_folds))
    fold = F.when(F.col("_p") < n_folds, F.col("_p")).otherwise(2 * n_folds - 1 - F.col("_p"))
    return r.select(group, "n_rows", fold.cast("int").alias("fold"))


def joint_fold_sizes(df: DataFrame, station: str, year: str) -> DataFrame:
    """Per (station, year) fold: test rows, and training rows that share neither station nor year."""
    n = df.groupBy(station, year).agg(F.count(F.lit(1)).alias("n_test"))
    s = n.groupBy(station).agg(F.sum("n_test").alias("_s"))
    y = n.groupBy(year).agg(F.sum("n_test").alias("_y"))
    t = n.agg(F.sum("n_test").alias("_t"))
    j = attach_row(n.join(s, station).join(y, year), t)
    return j.select(station, year, "n_test", (F.col("_t") - F.col("_s") - F.col("_y") + F.col("n_test")).alias("n_train"))


def leakage(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that appear in more than one fold; empty when no group is split."""
    return (df.select(group, fold).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_folds")).filter("n_folds > 1"))


def fold_diagnostics(df: DataFrame, fold: str, station: str, label: str, lat: str, lon: str, top: int = 8) -> DataFrame:
    """Per fold: rows, stations, positive rate, extent, and its largest stations."""
    per = df.groupBy(fold, station).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), F.min(lat).alias("a"), F.max(lat).alias("b"),
                                        F.min(lon).alias("c"), F.max(lon).alias("d"))
    stats = per.groupBy(fold).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_stations"), (F.sum("pos") / F.sum("n")).alias("pos_rate"),
        F.min("a").alias("lat_min"), F.max("b").alias("lat_max"), F.min("c").alias("lon_min"), F.max("d").alias("lon_max"))
    head = rank_in_groups(per, [fold], "n", station, "_rk").filter(F.col("_rk") <= top)
    # at most ``top`` rows per fold are left
    names = head.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct("_rk", F.concat(F.col(station), F.lit(":"), F.col("n")).alias("t")))).alias("h"))
    return stats.join(names, fold).withColumn("top_stations", F.concat_ws(",", F.transform("h", lambda x: x["t"]))).drop("h")


# ---- models --------------------------------------------------------------------------------------------
def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence[int], weight: str | None = None,
                kind: str = "classifier", max_iter: int = 10, max_depth: int = 3, seed: int = 42) -> DataFrame:
    """Input rows with ``oof_score``: each fold scored by a model fitted on the others.

    Medians for missing features come from the training rows of each fold. One Spark job per fold
    over the same materialised matrix.
    """
    out = None
    for f in folds:
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        med = feature_medians(train, features)
        va = VectorAssembler(inputCols=list(features), outputCol="_v")
        tr, te = va.transform(impute(train, med, features)), va.transform(impute(test, med, features))
        args = dict(featuresCol="_v", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed)
        if weight:
            args["weightCol"] = weight
        if kind == "classifier":
            scored = GBTClassifier(**args).fit(tr).transform(te).withColumn("oof_score", vector_to_array("probability")[1])
        else:
            scored = GBTRegressor(**args).fit(tr).transform(te).withColumn("oof_score", F.col("prediction"))
        scored = scored.select(*df.columns, "oof_score")
        out = scored if out is None else out.unionByName(scored)
    return out


def isotonic_calibration(df: DataFrame, score: str, label: str, out: str = "calibrated") -> DataFrame:
    """Add a monotone probability fitted on the given (out-of-fold) scores, clipped to [0, 1]."""
    d = df.withColumn(label, F.col(label).cast("double"))
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="_p").fit(d)
    return model.transform(d).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p")))).drop("_p")


#: Children of a node in the tree over ranked targets.
_WAYS = 16


def leaf_quantiles(train: DataFrame, test: DataFrame, label: str, key: str, leaves: str, quantiles: dict[str, float]) -> DataFrame:
    """(key, quantiles...) from leaf tuples: array<int> ``leaves`` with the leaf of every tree, in ``train`` and ``test``.

    A row's distribution gives every training target the mean over the trees of 1/size of the leaf they share; a quantile is the
    smallest target at which the running weight reaches it. Rows of equal leaf tuples share one distribution. Targets are ranked
    once over the whole training table, and each leaf counts its targets per block of ranks, in levels of 16 blocks. A search
    goes down these levels and looks up one block per tree and level, so the joined rows are distinct tuples x trees x
    quantiles x levels, whatever the leaves hold. Null targets are ignored.
    """
    place = durable(dense_index(train.select(F.col(label).cast("double").alias("v")).filter("v is not null"), "v"))
    ranked = durable(train.select(F.col(label).cast("double").alias("_id"), leaves).join(place, "_id").select(F.posexplode(leaves).alias("tree", "leaf"), "idx")
                     .groupBy("tree", "leaf", "idx").agg(F.count(F.lit(1)).alias("m")))
    size = ranked.groupBy("tree", "leaf").agg(F.sum("m").alias("size"))
    top = place.agg(F.max("idx").alias("n")).first()["n"]
    levels = 1
    while top is not None and top >= _WAYS**levels:
        levels += 1
    tuples = durable(test.select(leaves).distinct())
    asked = tuples.select(leaves, F.posexplode(leaves).alias("tree", "leaf")).join(size, ["tree", "leaf"])
    trees = asked.groupBy(leaves).agg(F.count(F.lit(1)).alias("_trees"))
    goals = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()]))
    state = trees.select(leaves, "_trees", goals.alias("g")).select(leaves, F.col("g.name").alias("name"), (F.col("g.q") * F.col("_trees") - 1e-12).alias("goal"),
                                                                    F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("below"))
    for level in range(levels):
        unit = _WAYS ** (levels - 1 - level)
        child = F.floor(F.col("idx") / unit) % _WAYS
        counts = ranked.groupBy("tree", "leaf", F.floor(F.col("idx") / (unit * _WAYS)).alias("block")).agg(
            *[F.sum(F.when(child == k, F.col("m")).otherwise(0)).alias(f"c{k}") for k in range(_WAYS)])
        met = asked.join(state, leaves).join(counts, ["tree", "leaf", "block"])
        shares = met.groupBy(leaves, "name", "goal", "block", "below").agg(*[F.sum(F.col(f"c{k}") / F.col("size")).alias(f"c{k}") for k in range(_WAYS)])
        upto, choices = F.col("below"), []
        for k in range(_WAYS):
            choices.append(F.struct(F.lit(k).alias("k"), upto.alias("before"), (upto + F.col(f"c{k}")).alias("after"), F.col(f"c{k}").alias("own")))
            upto = upto + F.col(f"c{k}")
        held = F.filter(F.array(*choices), lambda c: c["own"] > 0)
        # rounding can leave the last block a hair short of the goal
        pick = F.coalesce(F.get(F.filter(held, lambda c: c["after"] >= F.col("goal")), F.lit(0)), F.element_at(held, -1))
        state = shares.withColumn("_p", pick).select(leaves, "name", "goal", (F.col("block") * _WAYS + F.col("_p.k")).alias("block"), F.col("_p.before").alias("below"))
        state = durable(state)
    value = state.join(place, state["block"] == place["idx"]).groupBy(leaves).agg(*[F.max(F.when(F.col("name") == n, F.col("_id"))).alias(n) for n in quantiles])
    return test.select(key, leaves).join(value, leaves).select(key, *quantiles)


def quantile_forest(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, quantiles: dict[str, float],
                    trees: int = 10, max_depth: int = 4, seed: int = 42, lo: float = 0.0, hi: float = 25.0) -> DataFrame:
    """(key, quantiles...): weighted quantiles of the training targets that share leaves with a row; see ``leaf_quantiles``.

    Every quantile is a training target, clipped to ``lo`` and ``hi``; quantiles of one key never cross because they come from one distribution.
    """
    va = VectorAssembler(inputCols=list(features), outputCol="_v")
    model = RandomForestRegressor(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=max_depth, seed=seed, leafCol="_leaf").fit(va.transform(train))

    def leaves(df: DataFrame, column: str) -> DataFrame:
        return durable(model.transform(va.transform(df)).select(column, F.transform(vector_to_array("_leaf"), lambda x: x.cast("int")).alias("leaves")))

    out = leaf_quantiles(leaves(train, label), leaves(test, key), label, key, "leaves", quantiles)
    return out.select(key, *[F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(n))).alias(n) for n in quantiles])


def ablation(df: DataFrame, sets: dict[str, Sequence[str]], label: str, fold: str, folds: Sequence[int], seeds: Sequence[int],
             max_iter: int = 5) -> DataFrame:
    """(feature_set, n_features, mean_auc, sd_auc) over seeds; an absent feature is an error."""
    from dustledger.operators.contracts import require_columns
    from dustledger.operators.stats import auc

    for cols in sets.values():
        require_columns(df, cols)
    matrix = durable(df)
    out = None
    for name, cols in sets.items():
        for seed in seeds:
            s = out_of_fold(matrix, cols, label, fold, folds, seed=seed, max_iter=max_iter)
            row = auc(s, "oof_score", label).select(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), F.lit(seed).alias("seed"), "auc")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("feature_set", "n_features").agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc"))


# ---- physics calibration and sampling ---------------------------------------------------------------------
def physics_grid(terminal: DataFrame, eq: str, measured: str, ks: Sequence[float], sats: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Error of every (k, sl_sat) on station-years: the equivalent days do not depend on either,
    so the grid is exploded from literals over one row per station-year."""
    grid = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(s)).alias("sl_sat")) for k in ks for s in sats])
    d = terminal.withColumn("_g", F.explode(grid)).withColumns({"k": F.col("_g.k"), "sl_sat": F.col("_g.sl_sat")})
    err = (1.0 - F.col("sl_sat") * (1.0 - F.exp(-F.col(eq) / F.col("k")))) - F.col(measured)
    return d.withColumn("_e", err).groupBy(*keys, "k", "sl_sat").agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias"), F.count(F.lit(1)).alias("n"))


def best_physics(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    b = table.groupBy(*keys).agg(F.min_by(F.struct("k", "sl_sat", "mae"), F.struct(F.rint(F.col("mae") * 1e9), F.col("k"), F.col("sl_sat"))).alias("b"))
    return b.select(*keys, F.col("b.k").alias("k"), F.col("b.sl_sat").alias("sl_sat"), F.col("b.mae").alias("mae"))


def stratified_sample(df: DataFrame, value: str, id_col: str, bins: int, per_bin: int, seed: int) -> DataFrame:
    """Quantile bins of ``value`` and ``per_bin`` rows of each by seeded hash order (a sampling operator)."""
    from dustledger.functions.numeric import draw_key, uniform_fine
    from dustledger.operators.ranks import exact_quantiles

    edges = exact_quantiles(df, [], value, {f"e{i}": i / bins for i in range(1, bins)}).drop("n")
    d = attach_row(df, edges)
    b = F.lit(0)
    for i in range(1, bins):
        b = b + F.when(F.col(value) > F.col(f"e{i}"), 1).otherwise(0)
    d = d.withColumns({"bin": b, "_u": uniform_fine(draw_key(F.col(id_col), seed))})
    # the n-th smallest draw of a bin bounds the sample; draws are spread evenly over (0, 1)
    c = cumulative(value_table(d, ["bin"], "_u"), ["bin"]).filter(F.col("n_below") < per_bin).groupBy("bin").agg(F.max("v").alias("_cut"))
    return d.join(c, "bin").filter(F.col("_u") <= F.col("_cut")).select(*df.columns, "bin")


def evenly_spaced(df: DataFrame, order: str, id_col: str, m: int) -> DataFrame:
    """At most ``m`` rows at evenly spaced ranks of ``order`` (a sampling operator)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = attach_row(row_numbers(df, order, id_col, "_rk", descending=False), n)
    if m < 2:
        return r.filter("_rk = 1").select(*df.columns)
    slot = F.rint((F.col("_rk") - 1) * (m - 1) / F.nullif(F.col("_n") - 1, F.lit(0)))
    back = F.rint(slot * (F.col("_n") - 1) / F.lit(m - 1.0)) + 1
    return r.filter((F.col("_n") <= m) | (back == F.col("_rk"))).select(*df.columns)


def threshold_sweep(matched: DataFrame, split: str, n_truth: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(split, conf, tp, fp, fn, precision, recall, f1) for every confidence from one greedy match.

    Matching runs in falling score order, so the result at a threshold is the head of the full one.
    """
    d = matched.filter("class <> 'fn'").withColumn("conf", F.explode(F.filter(
        F.array(*[F.lit(float(c)) for c in grid]), lambda c: F.col("score") >= c)))
    s = d.groupBy(split, "conf").agg(F.sum(F.when(F.col("class") == "tp", 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("class") == "fp", 1).otherwise(0)).alias("fp"))
    full = n_truth.withColumn("conf", F.explode(F.array(*[F.lit(float(c)) for c in grid])))
    s = full.join(s, [split, "conf"], "left").fillna(0, ["tp", "fp"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n_truth") - F.col("tp")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return s.select(split, "conf", "tp", "fp", fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def tune_and_report(sweep: DataFrame, split: str, tune: str, report: str) -> DataFrame:
    """Confidence frozen on one split, its score on the other, and what tuning there would have gained."""
    first_best = F.max_by(F.struct("conf", "f1"), F.struct(F.rint(F.col("f1") * 1e12), -F.col("conf")))
    best = sweep.filter(F.col(split) == tune).agg(first_best.alias("b")).select(F.col("b.conf").alias("conf"), F.col("b.f1").alias("tuned_f1"))
    rep = sweep.filter(F.col(split) == report)
    top = rep.agg(F.max("f1").alias("report_best_f1"))
    return attach_row(attach_row(rep, best.withColumnRenamed("conf", "_c")).filter(F.col("conf") == F.col("_c")), top).select(
        "conf", "tuned_f1", F.col("precision").alias("report_precision"), F.col("recall").alias("report_recall"),
        F.col("f1").alias("report_f1"), (F.col("report_best_f1") - F.col("f1")).alias("tuning_penalty"))
