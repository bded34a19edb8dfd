"""Temperature mixing of sources to target weights, realised as budgeted block permutations. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from dustledger.session import durable


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def _curve(sources: DataFrame, total: int, exponents: list[float]) -> list[float]:
    """Entropy (nats) of the normalised weights share^x for each exponent, in one aggregation."""
    log_share = F.log(F.col("tokens") / F.lit(float(total)))
    cells = []
    for k, x in enumerate(exponents):
        raised = F.exp(log_share * x)
        cells += [F.sum(raised).alias(f"z{k}"), F.sum(raised * log_share * x).alias(f"e{k}")]
    row = sources.agg(*cells).first()
    return [math.log(row[2 * k]) - row[2 * k + 1] / row[2 * k] for k in range(len(exponents))]


def entropy_exponent(sources: DataFrame, total: int, target: float, levels: int = 40, at_once: int = 5) -> float:
    """The exponent in [0, 1] whose weights have entropy ``target``, by bisection, rounded to 6 digits.

    Entropy falls from log(number of sources) at 0 to that of the raw shares at 1; a target outside gives
    the nearer end. The midpoints of ``at_once`` levels of the bisection are evaluated by one aggregation.
    """
    ends = _curve(sources, total, [0.0, 1.0])
    if target >= ends[0]:
        return 0.0
    if target <= ends[1]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(0, levels, at_once):
        grid = [low + (high - low) * k / 2**at_once for k in range(1, 2**at_once)]
        value = dict(zip(range(1, 2**at_once), _curve(sources, total, grid)))
        a, b = 0, 2**at_once
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if value[mid] > target else (a, mid)
        low, high = low + (high - low) * a / 2**at_once, low + (high - low) * b / 2**at_once
    return round((low + high) / 2, 6)


def repetition_exponent(smallest: int, largest: int, limit: float, levels: int = 40) -> float:
    """The smallest exponent in [0, 1] at which no source is read over ``limit`` times as often as the largest one.

    A source of T tokens is read in proportion to T^(x - 1); found by bisection, rounded up to 6 digits.
    """
    ratio = math.log(largest / smallest)
    low, high = 0.0, 1.0
    if ratio <= math.log(limit):
        return 0.0
    for _ in range(levels):
        mid = (low + high) / 2
        low, high = (low, mid) if (1.0 - mid) * ratio <= math.log(limit) else (mid, high)
    return min(1.0, math.ceil(high * 1e6) / 1e6)


def mixing_plan(units: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, exponent, weight, budget, passes, rest, blocks): what to read of each source.

    ``units`` has source and tokens. Exactly one goal is given: ``entropy`` as a share of log(number of sources),
    or ``repetition``, the most times a source may be read. Without ``budget`` the mixture is the smallest one
    that reads every source once or more; with ``repetition`` and a budget, passes above the limit are an error.
    A source with a null name is a source of its own; sources without tokens are left out.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    sources = durable(units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).filter("tokens > 0"))
    total, least, most, count = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not count:
        x, scale = 1.0, 1.0
    elif entropy is not None:
        x = entropy_exponent(sources, total, entropy * math.log(count))
    else:
        x = repetition_exponent(least, most, repetition)
    raised = F.exp(F.log(F.col("tokens") / F.lit(float(total or 1))) * x)
    whole = sources.agg(F.sum(raised)).first()[0] or 1.0
    weight = raised / F.lit(whole)
    if budget is None:
        # tokens / weight is largest for the largest source, so that one is read exactly once
        scale = (most or 1) / (math.exp(math.log((most or 1) / (total or 1)) * x) / whole)
        target = F.greatest(F.col("tokens"), F.floor(weight * F.lit(scale) + 0.5))
    else:
        target = F.floor(weight * F.lit(float(budget)) + 0.5)
        if count and repetition is not None and math.exp(math.log(least / total) * x) / whole * budget > repetition * least * (1 + 1e-9):
            raise ValueError("the budget needs more repetitions than allowed")
    plan = sources.select("source", "tokens", "docs", F.lit(x).alias("exponent"), weight.alias("weight"), target.cast("long").alias("budget"))
    passes = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    return plan.select("*", passes.alias("passes"), (F.col("budget") - passes * F.col("tokens")).alias("rest"),
                       F.ceil(F.sqrt("docs")).cast("long").alias("blocks"))


def block_permutations(units: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(source, key, epoch, block, position, tokens, budget): the reading order of every source within its budget.

    ``units`` has source, key (unique text) and tokens. A source of n units is dealt by key digest into
    sqrt(n) blocks. Every epoch is a permutation of the blocks and of the units inside each block, both by
    digests of seed, epoch and key; ``position`` counts the tokens read before. The full passes read everything,
    the last epoch ends where the budget does (a unit is read if its first token lies inside). So the longest
    sorted run is about the square root of a source, however large the source. Units without tokens are read in
    every full pass.
    """
    nibble = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    known = units.join(plan.select("source", "passes", "rest", "blocks", F.col("tokens").alias("volume"), "budget"),
                       units["source"].eqNullSafe(plan["source"])).select(
        units["source"], "key", units["tokens"], "passes", "rest", "volume", "budget", F.pmod(nibble, F.col("blocks")).alias("block"))
    totals = known.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("mass"))
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    drawn = totals.filter(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
    name = F.coalesce("source", F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("epoch").cast("string"), F.col("block").cast("string")))
    before = Window.partitionBy("source", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("start", F.coalesce(F.sum("mass").over(before), F.lit(0)))
    open_ = placed.filter((F.col("epoch") < F.col("passes")) | (F.col("start") < F.col("rest"))).select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "epoch", "start")
    read = known.join(open_, known["source"].eqNullSafe(F.col("_source")) & (known["block"] == F.col("_block")))
    shuffle = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("key")))
    inside = Window.partitionBy("_source", "_block", "epoch").orderBy(shuffle, "key").rowsBetween(Window.unboundedPreceding, -1)
    at = read.withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    kept = at.filter((F.col("epoch") < F.col("passes")) | (F.col("at") < F.col("rest")))
    return kept.select("source", "key", "epoch", "block", (F.col("epoch") * F.col("volume") + F.col("at")).alias("position"), "tokens", "budget")


def document_units(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, source, tokens, copies): documents to mix; repeated rows (equal id, text and source) are one unit."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), digest.alias("digest"), F.col("source").cast("string"), word_count(F.col("text")).alias("tokens"))
    units = rows.groupBy("doc_id", "digest", "source").agg(F.first("tokens").alias("one"), F.count(F.lit(1)).alias("copies"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    return units.select(key.alias("key"), "doc_id", "digest", "source", (F.col("one") * F.col("copies")).alias("tokens"), "copies")


def mixed_order(docs: DataFrame, entropy: float | None = None, repetition: float | None = None,
                budget: int | str | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, epoch, block, position, tokens, share): the documents in training order, one row per reading.

    Tokens are words between white space. Sorting by ``share`` (position over the source's budget, in [0, 1))
    interleaves the sources by their weights. ``budget`` "corpus" stands for the corpus's own tokens, None for the
    smallest mixture that reads every source once. Null texts have no tokens; a source of only such rows is not
    read, as it has no share. Repeated rows are one unit and travel together. An empty table gives no row.
    """
    units = durable(document_units(docs))
    if budget == "corpus":
        budget = units.agg(F.sum("tokens")).first()[0] or 0
    plan = durable(mixing_plan(units, entropy, repetition, budget))
    order = block_permutations(units.select("source", "key", "tokens"), plan, seed)
    name = F.split(F.col("key"), r"\|")[0]
    return order.select(F.when(name != "-", name.cast("long")).alias("doc_id"), "source", "epoch", "block", "position", "tokens",
                        (F.col("position") / F.col("budget")).alias("share"))


def mixed_documents(docs: DataFrame, entropy: float | None = None, repetition: float | None = None,
                    budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the mixture reads it (see ``mixed_order``), in its own columns.

    Rows of sources without any token have no share in a mixture and are passed on once.
    """
    units = durable(document_units(docs))
    plan = durable(mixing_plan(units, entropy, repetition, budget))
    readings = block_permutations(units.select("source", "key", "tokens"), plan, seed).groupBy("key").agg(F.count(F.lit(1)).alias("_times"))
    idle = units.join(plan, units["source"].eqNullSafe(plan["source"]), "left_anti").select("key", F.lit(1).cast("long").alias("_times"))
    times = units.join(readings.union(idle), "key").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("source").alias("_source"), "_times")
    matched = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & docs["source"].cast("string").eqNullSafe(F.col("_source"))
                        & (F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col("_digest")))
    return matched.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*[docs[c] for c in docs.columns])
