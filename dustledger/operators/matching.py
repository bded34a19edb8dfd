"""One-to-one matching and suppression as rounds of grouped minima over candidate pairs.

Candidates are only pairs that overlap, found through grid cells. Every round is a few
map-side-combined aggregates, is written to the checkpoint folder, and removes decided pairs, so no
tile is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.functions import geo
from dustledger.operators.spatial import BOX, box_pairs, left_box, right_box
from dustledger.session import durable, shuffled


def iou_candidates(preds: DataFrame, truths: DataFrame, pred_id: str, truth_id: str, threshold: float,
                   cell: float, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """(keys, l, r, iou) of box pairs in one tile with IoU at or above the threshold."""
    pairs = box_pairs(preds, truths, pred_id, truth_id, cell, 0.0, keys)
    iou = geo.box_iou(left_box(), right_box())
    return pairs.select(*keys, "l", "r", iou.alias("iou")).filter(F.col("iou") >= threshold)


def greedy_matches(candidates: DataFrame, priority: DataFrame) -> DataFrame:
    """(l, r, iou): predictions in priority order each claim their best free truth.

    ``priority`` gives (l, score); higher scores go first, ties by smaller id. Equal to deferred
    acceptance: a prediction proposes to its best remaining truth (first truth on equal IoU), a
    truth keeps its best proposer, and every pair the holder outranks is dropped for good.
    """
    live = durable(candidates.select("l", "r", "iou").join(priority.select("l", "score"), "l"))
    size = live.count()
    order = lambda: F.struct(-F.col("score"), F.col("l"))
    while True:
        best = F.min(F.struct((-F.col("iou")).alias("k"), F.col("r"), F.col("score")))
        proposal = live.groupBy("l").agg(best.alias("b")).select(
            "l", F.col("b.r").alias("r"), F.col("b.score").alias("score"), (-F.col("b.k")).alias("iou"))
        holder = proposal.groupBy("r").agg(F.min(order()).alias("h"))
        marked = live.join(holder, "r", "left")
        keep = marked.filter(F.col("h").isNull() | (order() <= F.col("h"))).drop("h")
        live = durable(keep)
        left = live.count()
        if left == size:
            # every proposer holds its truth; otherwise a pair went, so the loop ends
            return proposal.select("l", "r", "iou")
        size = left


def match_detections(preds: DataFrame, truths: DataFrame, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """One row per prediction and per unclaimed truth: class tp / fp / fn with ids and IoU.

    ``preds`` (tile_id, det_id, score, box), ``truths`` (tile_id, gt_id, box); ids are unique.
    """
    cand = iou_candidates(preds, truths, "det_id", "gt_id", threshold, cell)
    m = greedy_matches(cand, preds.select(F.col("det_id").alias("l"), "score")).select(
        F.col("l").alias("det_id"), F.col("r").alias("gt_id"), "iou")
    p = preds.select("tile_id", "det_id", "score").join(m, "det_id", "left")
    hits = p.select("tile_id", F.when(F.col("gt_id").isNotNull(), "tp").otherwise("fp").alias("class"),
                    "det_id", "gt_id", "iou", "score")
    missed = truths.join(m.select("gt_id"), "gt_id", "left_anti").select(
        "tile_id", F.lit("fn").alias("class"), F.lit(None).cast("long").alias("det_id"), "gt_id",
        F.lit(None).cast("double").alias("iou"), F.lit(None).cast("double").alias("score"))
    return hits.unionByName(missed)


def suppress_overlaps(boxes: DataFrame, threshold: float, cell: float = 64.0) -> DataFrame:
    """Greedy non-maximum suppression per tile: ids of kept boxes (score first, then smaller id).

    A round keeps every live box that no better live box overlaps, and removes what those overlap.
    """
    pairs = box_pairs(boxes, boxes, "det_id", "det_id", cell, 0.0, ("tile_id",)).filter("l <> r")
    over = pairs.withColumn("iou", geo.box_iou(left_box(), right_box())).filter(F.col("iou") >= threshold)
    score = boxes.select(F.col("det_id").alias("id"), "score")
    # (better, worse) edges
    e = (over.select("l", "r").join(score.select(F.col("id").alias("l"), F.col("score").alias("sl")), "l")
         .join(score.select(F.col("id").alias("r"), F.col("score").alias("sr")), "r")
         .filter((F.col("sl") > F.col("sr")) | ((F.col("sl") == F.col("sr")) & (F.col("l") < F.col("r"))))
         .select(F.col("l").alias("better"), F.col("r").alias("worse")))
    e = durable(e)
    dropped: DataFrame | None = None
    while True:
        worse = e.select(F.col("worse").alias("better")).distinct()
        free = e.select("better").distinct().join(worse, "better", "left_anti")
        out = e.join(free, "better", "left_semi").select(F.col("worse").alias("det_id")).distinct()
        out = durable(out)
        if not out.take(1):
            break
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.withColumnRenamed("det_id", "k")
        e = durable(e.join(gone, e["worse"] == gone["k"], "left_anti")
                    .join(gone, F.col("better") == gone["k"], "left_anti"))
    kept = boxes.select("tile_id", "det_id")
    return kept if dropped is None else kept.join(dropped, "det_id", "left_anti")


def carry_identity(previous: DataFrame, current: DataFrame, prev_id: str, curr_id: str, cell: float,
                   min_iou: float = 0.30, max_shift: float = 5.0) -> DataFrame:
    """(curr_id, prev_id, status matched/new/dropped) between two detection runs.

    First greedy by falling IoU: pairs that are best for both ends are settled, removed, and the
    rest looked at again. Then each unmatched current box looks at its nearest previous centre of
    all, which counts only if within ``max_shift`` and still free; the nearest claimant wins.
    """
    cand = box_pairs(current, previous, curr_id, prev_id, cell)

    def centre(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name), ((F.col("minx") + F.col("maxx")) / 2.0).alias("x"), ((F.col("miny") + F.col("maxy")) / 2.0).alias("y"))

    rated = cand.select("l", "r", geo.box_iou(left_box(), right_box()).alias("iou"))
    return settle_identity(rated, centre(previous, prev_id), centre(current, curr_id), prev_id, curr_id, cell, min_iou, max_shift)


def settle_identity(rated: DataFrame, previous: DataFrame, current: DataFrame, prev_id: str, curr_id: str, cell: float,
                    min_iou: float, max_shift: float) -> DataFrame:
    """The work of ``carry_identity`` on rated pairs (l current, r previous, iou) and on centres (id, x, y)."""
    live = durable(rated.filter(F.col("iou") >= min_iou))
    empty = live.select("l", "r").limit(0)
    settled: DataFrame | None = None
    while live.take(1):
        key = F.struct((-F.col("iou")).alias("k"), "l", "r")
        a = live.groupBy("l").agg(F.min(key).alias("b")).select("b.*")
        b = live.groupBy("r").agg(F.min(key).alias("b")).select("b.*")
        won = durable(a.join(shuffled(b), ["k", "l", "r"], "left_semi").select("l", "r"))
        settled = won if settled is None else settled.unionByName(won)
        live = durable(live.join(shuffled(won.select("l")), "l", "left_anti").join(shuffled(won.select("r")), "r", "left_anti"))
    settled = empty if settled is None else settled
    rest = current.withColumnRenamed(curr_id, "l").join(shuffled(settled), "l", "left_anti")
    prev = previous.select(F.col(prev_id).alias("r"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = box_pairs(rest.select("l", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy")),
                     prev.select("r", F.col("px").alias("minx"), F.col("py").alias("miny"), F.col("px").alias("maxx"), F.col("py").alias("maxy")),
                     "l", "r", cell, max_shift)
    d = geo.box_gap(left_box(), right_box())
    first = near.withColumn("d", d).filter(F.col("d") <= max_shift).groupBy("l").agg(F.min(F.struct("d", "r")).alias("b"))
    claim = first.select("l", F.col("b.d").alias("d"), F.col("b.r").alias("r")).join(shuffled(settled.select("r")), "r", "left_anti")
    second = claim.groupBy("r").agg(F.min(F.struct("d", "l")).alias("b")).select(F.col("b.l").alias("l"), "r")
    pairs = settled.unionByName(second)
    now = current.select(F.col(curr_id).alias("l")).join(shuffled(pairs), "l", "left").select(
        F.col("l").alias("curr_id"), F.col("r").alias("prev_id"),
        F.when(F.col("r").isNotNull(), "matched").otherwise("new").alias("status"))
    gone = previous.select(F.col(prev_id).alias("r")).join(shuffled(pairs), "r", "left_anti").select(
        F.lit(None).cast("long").alias("curr_id"), F.col("r").alias("prev_id"), F.lit("dropped").alias("status"))
    return now.unionByName(gone)


# ---- counts over matched rows ----------------------------------------------------------------------------
def confusion(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per group; a zero denominator gives 0."""
    def n(name: str) -> Column:
        return F.sum(F.when(F.col("class") == name, 1).otherwise(0))

    s = matched.groupBy(*keys).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn)})


def failure_buckets(rows: DataFrame) -> DataFrame:
    """(dim, bucket, tp, fp, fn, fn_rate, precision) by size, edge distance and density in one scan."""
    area = F.coalesce("gt_area_px", "pred_area_px")
    edge, others = F.col("distance_to_image_edge_px"), F.col("num_other_panels_in_tile")
    size = (F.when(area < 800, "small_lt800").when(area < 4000, "medium_800_4000")
            .when(area.isNotNull(), "large_ge4000").otherwise("unknown"))
    near = F.when(edge < 40, "near_lt40").when(edge < 120, "mid_40_120").when(edge.isNotNull(), "far_ge120").otherwise("unknown")
    crowd = F.when(others == 0, "alone").when(others < 4, "few_1_3").when(others.isNotNull(), "crowded_ge4").otherwise("unknown")
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), b.alias("bucket")) for d, b in (
        ("size", size), ("edge", near), ("density", crowd), ("overall", F.lit("all")))])
    s = confusion(rows.withColumn("_d", F.explode(dims)).select("class", "_d.dim", "_d.bucket"), ("dim", "bucket"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("dim", "bucket", "tp", "fp", "fn", (fn / F.nullif(tp + fn, F.lit(0))).alias("fn_rate"),
                    (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"))


def worst_tiles(rows: DataFrame, n: int = 10) -> DataFrame:
    s = confusion(rows, ("tile_id",)).select("tile_id", "tp", "fp", "fn")
    iou = rows.filter(F.col("class") == "tp").groupBy("tile_id").agg(F.avg("iou").alias("mean_iou"))
    return s.join(iou, "tile_id", "left").withColumn("errors", F.col("fp") + F.col("fn")).orderBy(
        F.desc("errors"), "tile_id").limit(n)


BUCKETS: dict[str, tuple[str, str, bool]] = {
    # name: (predicate, ranking column, descending)
    "worst_small_fn": ("class = 'fn' AND gt_area_px < 800", "gt_area_px", False),
    "edge_fn": ("class = 'fn' AND distance_to_image_edge_px < 40", "distance_to_image_edge_px", False),
    "confident_fp": ("class = 'fp'", "score", True),
    "large_fp": ("class = 'fp' AND pred_area_px >= 4000", "pred_area_px", True),
    "worst_iou_tp": ("class = 'tp'", "iou", False),
}


def bucket_rows(rows: DataFrame, preset: str, n: int, *ties: str) -> DataFrame:
    """Filter, rank and top-n of a named preset."""
    where, col, desc = BUCKETS[preset]
    return rows.filter(where).orderBy(F.desc(col) if desc else F.asc_nulls_last(col), *ties).limit(n)


def tile_disagreement(preds: DataFrame, truths: DataFrame, confident: float = 0.50, agree_iou: float = 0.50,
                      covered_iou: float = 0.30, cell: float = 64.0) -> DataFrame:
    """Per tile: overlap IoU, confident predictions on no truth, uncovered truths, bucket, score.

    Boxes stand in for masks; overlap IoU sums pair intersections over both sides' areas.
    """
    pairs = box_pairs(preds, truths, "det_id", "gt_id", cell, 0.0, ("tile_id",))
    a, b = left_box(), right_box()
    inter = (F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
             * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])))
    pairs = pairs.withColumns({"inter": inter, "iou": geo.box_iou(a, b)}).filter("inter > 0")
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    touched = pairs.select(F.col("l").alias("det_id")).distinct().withColumn("_hit", F.lit(True))
    best = pairs.groupBy(F.col("r").alias("gt_id")).agg(F.max("iou").alias("best"))
    p = preds.join(touched, "det_id", "left").groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_pred"), F.sum(area).alias("_pa"),
        F.sum(F.when(F.col("_hit").isNull() & (F.col("score") >= confident), 1).otherwise(0)).alias("confident_fps"))
    t = truths.join(best, "gt_id", "left").groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_label"), F.sum(area).alias("_ta"),
        F.sum(F.when(F.coalesce("best", F.lit(0.0)) < covered_iou, 1).otherwise(0)).alias("uncovered"))
    s = p.join(t, "tile_id", "full").join(pairs.groupBy("tile_id").agg(F.sum("inter").alias("_i")), "tile_id", "left")
    s = s.fillna(0, ["n_pred", "n_label", "confident_fps", "uncovered", "_pa", "_ta", "_i"])
    union = F.col("_pa") + F.col("_ta") - F.col("_i")
    fp, un, some = F.col("confident_fps") > 0, F.col("uncovered") > 0, F.col("n_label") > 0
    s = s.withColumn("overall_iou", F.when(union > 0, F.col("_i") / union).otherwise(F.lit(1.0)))
    bucket = (F.when((F.col("overall_iou") >= agree_iou) & ~fp & ~un, "agree")
              .when(fp & ~un & ~some, "confident_FP").when(un & ~fp, "confident_FN")
              .when(fp & un, "both_directions").when(fp & some, "confident_FP").otherwise("noisy"))
    return s.withColumns({"bucket": bucket, "disagreement_score": F.col("confident_fps") + F.col("uncovered")}).drop("_pa", "_ta", "_i")
