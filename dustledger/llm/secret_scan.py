"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.session import durable

# The base patterns, and the least length of what counts, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # a run cannot start behind one of its own characters; said so, it is found faster
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
_STEP = 256


SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string,whole:string>>"


def with_spans(rows: DataFrame, text: str, pattern: str, kind: int, group: int, out: str) -> DataFrame:
    """``rows`` with ``out``: all matches of ``pattern`` in ``text`` as array of (start, kind, end, value, whole), in code points.

    Text between matches and matches alternate, so a start is a running sum of lengths. The sums go in blocks of _STEP, which
    keeps the cost near linear in the number of matches. Every array is a column of its own: inside a lambda an expression would be
    evaluated again for each element. ``out_cut`` keeps the text between the matches; both are null where nothing matches.
    """
    hit = F.col(text).rlike(pattern)
    long = F.lit(0).cast("bigint")

    def ahead(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    rows = rows.withColumn("_whole", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    rows = rows.withColumn("_value", F.when(F.col("_whole").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("_whole"))
    rows = rows.withColumn(f"{out}_cut", F.when(F.col("_whole").isNotNull(), F.split(text, pattern, -1)))
    rows = rows.withColumn("_gap", F.transform(f"{out}_cut", lambda x: F.length(x).cast("bigint")))
    rows = rows.withColumn("_step", F.zip_with("_gap", "_whole", lambda g, m: g + F.coalesce(F.length(m), F.lit(0))))
    rows = rows.withColumn("_part", F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_step") - 1) / _STEP).cast("int")), lambda k: F.slice("_step", k * _STEP + 1, F.lit(_STEP))))
    rows = rows.withColumn("_mass", F.transform("_part", lambda p: F.aggregate(p, long, lambda acc, x: acc + x)))
    rows = rows.withColumn("_start", F.flatten(F.zip_with("_part", ahead(F.col("_mass"), long), ahead)))
    begins = F.zip_with("_start", "_gap", lambda s, g: s + g)
    texts = F.zip_with("_whole", "_value", lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    spans = F.zip_with(begins, texts, lambda at, t: F.struct(
        at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(t["m"])).alias("end"), t["v"].alias("value"), t["m"].alias("whole")))
    return rows.withColumn(out, F.filter(spans, lambda x: x["whole"].isNotNull())).drop(
        "_whole", "_value", "_gap", "_step", "_part", "_mass", "_start")


def base_and_candidates(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, base, loose): spans of the base patterns, and the other runs of ``least`` or more token characters.

    Assignments are overwritten by blanks before runs are taken. Access keys and hex strings consist of token characters, so
    each lies inside one run, and that run is no candidate.
    """
    none = F.array().cast(SPANS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # an assignment has = or :, which is quicker to look for
    rows = rows.withColumn("maybe", F.when(F.col("text").contains("=") | F.col("text").contains(":"), F.col("text")))
    rows = with_spans(rows, "maybe", ASSIGN, 0, 2, "assign")
    rows = with_spans(rows, "text", ACCESS, 1, 0, "access")
    rows = with_spans(rows, "text", HEX, 2, 0, "hex")
    blank = F.zip_with("assign_cut", "assign", lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(
        F.length(m["value"]) >= LEAST_VALUE, F.repeat(F.lit(" "), F.length(m["whole"]))).otherwise(m["whole"])))
    rows = rows.withColumn("rest", F.when(F.col("assign").isNotNull(), F.array_join(blank, "")).otherwise(F.col("text")))
    rows = with_spans(rows, "rest", f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}", 3, 0, "run")
    base = F.concat(
        F.coalesce(F.filter("assign", lambda m: F.length(m["value"]) >= LEAST_VALUE), none),
        F.coalesce(F.filter("access", lambda m: F.length(m["value"]) >= LEAST_ACCESS), none), F.coalesce("hex", none))
    loose = F.coalesce(F.filter("run", lambda m: ~m["value"].rlike(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}|{HEX}")), none)

    def slim(spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return rows.select("doc_id", slim(base).alias("base"), slim(loose).alias("loose"))


def _pair_codes(token: Column) -> Column:
    """Numbers of the neighbouring character pairs of a token of two or more characters."""
    return F.transform(F.sequence(F.lit(2), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), token.substr(i - 1, F.lit(1))) * WIDTH
                       + F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1))))


def fit_models(samples: DataFrame, mixed: float = 0.5, pseudo: float = 1000.0) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of every character pair, from (token, is_random) rows.

    Both models are first-order chains. That of random strings is mixed with uniform characters by ``mixed``, because labelled
    secrets cover few alphabets; that of ordinary strings is smoothed by ``pseudo`` counts of its own character frequencies, so that
    a random string among the ordinary samples does not explain itself. Pairs are counted over all samples: tokens are counted first,
    then their pairs, and at most 2 * WIDTH^2 counts reach the driver. Without samples every ratio is 0.
    """
    tokens = samples.filter(F.length("token") > 1).groupBy("token", "is_random").agg(F.count(F.lit(1)).alias("times"))
    pairs = tokens.select("is_random", "times", F.explode(_pair_codes(F.col("token"))).alias("pair"))
    counts = pairs.groupBy("is_random", "pair").agg(F.sum("times").alias("n")).collect()
    seen = {True: [0.0] * WIDTH**2, False: [0.0] * WIDTH**2}
    for is_random, pair, n in counts:
        seen[is_random][pair] = float(n)
    if not counts:
        return [0.0] * WIDTH**2
    uniform = 1.0 / (WIDTH - 1)
    ordinary_total = sum(seen[False]) + 1.0
    share = [(sum(seen[False][a * WIDTH + b] for a in range(WIDTH)) + uniform) / ordinary_total for b in range(WIDTH)]
    out = []
    for a in range(WIDTH):
        random_row = sum(seen[True][a * WIDTH:(a + 1) * WIDTH])
        ordinary_row = sum(seen[False][a * WIDTH:(a + 1) * WIDTH])
        for b in range(WIDTH):
            p = mixed * uniform + (1 - mixed) * (seen[True][a * WIDTH + b] + uniform) / (random_row + 1.0)
            q = (seen[False][a * WIDTH + b] + pseudo * share[b]) / (ordinary_row + pseudo)
            out.append(round(math.log(p / q), 6))
    return out


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return F.aggregate(_pair_codes(token), F.lit(0.0), lambda acc, pair: acc + F.get(table, pair))


def secret_spans(docs: DataFrame, least: int = 16, bound: float = 12.0, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, extra) with arrays of (start, kind, end, value) per document, ordered by start and kind.

    ``base`` holds the matches of the fixed patterns; ``extra`` the other runs of ``least`` or more token characters whose
    log-likelihood ratio of random string over ordinary identifier is above ``bound`` (a number alone is never one). The two models are trained from
    labelled samples: the values of all base matches are random strings, all other runs of the corpus are ordinary
    ones; ``known`` (token, is_random) adds further samples. Each text is scanned once; what is trained and scored is the
    written list of its runs.

    Null texts count as empty and have no spans. Repeated rows are scanned alike. Further columns are ignored.
    """
    told = durable(base_and_candidates(docs, least))
    samples = told.select(F.explode("base.value").alias("token"), F.lit(True).alias("is_random")).unionByName(
        told.select(F.explode("loose.value").alias("token"), F.lit(False).alias("is_random")))
    if known is not None:
        samples = samples.unionByName(known.select("token", "is_random"))
    ratios = fit_models(samples)
    extra = F.filter("loose", lambda s: s["value"].rlike("[A-Za-z]") & (likelihood_ratio(s["value"], ratios) > bound))
    return told.select("doc_id", F.array_sort("base").alias("base"), extra.alias("extra"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def document_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) per document; see ``secret_spans``."""
    told = secret_spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return told.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("extra").cast("long").alias("n_random"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "extra"))).alias("spans"))
