"""Host reputation by empirical Bayes, and URL verdicts from rules or a posterior bound. SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.session import durable

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels under which names are registered; otherwise the suffix is the last label.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From behind the first :// to the next of / ? # or the end, A-Z lower-cased; empty without one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """From behind the host to the next of ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*double), pair).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    """The label before the suffix and the suffix; a bare suffix is its own domain."""
    return F.when(F.substring_index(host, ".", -2).isin(*double), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as struct(name, verdict); null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _concentration(level: DataFrame, parent: Column) -> Column:
    """Prior strength of a level: from the overdispersion of its groups around their parents' means, by moments.

    With a beta-binomial of intra-class correlation r the standardised square of a group of n outcomes has mean
    1 + (n - 1) r. r is kept within [0.0001, 0.9999]; the strength is (1 - r) / r.
    """
    spare = parent * (1 - parent)
    square = F.round(F.sum(F.when(spare > 0, F.pow(F.col("good") / F.col("n") - parent, 2) * F.col("n") / spare).otherwise(1.0)), 6)
    extra = F.sum(F.col("n") - 1)
    r = F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), F.when(extra > 0, (square - F.count(F.lit(1))) / extra).otherwise(0.0001)))
    return ((1 - r) / r).alias("strength")


def _levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of hosts, domains and suffixes with outcomes, and one row (mean) of all outcomes.

    Each has the beta posterior's mean and sd; domains, suffixes and the whole also have ``child_sd``, the sd of a child of
    theirs without any outcome: the prior alone, with the strength of the level below.
    """
    host = outcomes.filter("is_good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_good").cast("long")).alias("good"))
    host = durable(host.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # one row; a half good and a half bad outcome keep the mean inside (0, 1) and give one without any outcome
    whole = suffix.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mean"))

    def shrunk(level: DataFrame, parent: DataFrame, on: str | None) -> tuple[DataFrame, DataFrame]:
        """(posteriors of the level, ``parent`` with child_sd); the strength is one row."""
        prior = parent.select(*([on] if on else []), F.col("mean").alias("prior"))
        level = level.join(prior, on) if on else level.join(F.broadcast(prior), how="cross")
        strength = durable(level.agg(_concentration(level, F.col("prior"))))
        both = level.join(F.broadcast(strength), how="cross")
        a = F.col("strength") * F.col("prior") + F.col("good")
        b = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("good")
        child = parent.join(F.broadcast(strength), how="cross").withColumn("child_sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1)))
        return both.withColumns({"mean": a / (a + b), "sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))}).drop("strength"), child.drop("strength")

    top, whole = shrunk(suffix, whole, None)
    middle, top = shrunk(domain, durable(top), "suffix")
    low, middle = shrunk(host, durable(middle), "domain")
    return low, middle, top, whole


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n, good, mean, low, high): the posterior share of good pages of every host seen in ``outcomes``.

    ``outcomes`` has host and is_good (boolean; null rows teach nothing). Counts are shrunk downwards: the suffix towards all
    outcomes, the registered domain towards its suffix, the host towards its domain. A level with mean p of its parent and
    strength m gives a beta posterior with m p + good and m (1 - p) + n - good. ``low`` and ``high`` are mean -/+ z standard deviations of
    the posterior. Hosts without own outcomes have no row; see ``page_verdicts``.
    """
    low = _levels(outcomes)[0]
    return low.select("host", "domain", "suffix", "n", "good", "mean", (F.col("mean") - z * F.col("sd")).alias("low"), (F.col("mean") + z * F.col("sd")).alias("high"))


def page_verdicts(pages: DataFrame, outcomes: DataFrame, least_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_outcomes, reputation, bound) of every page.

    A rule decides where one fits (the longest). Elsewhere a page is blocked if even the upper posterior bound of its host's share
    of good pages is below ``least_good``. A host without outcomes (n_outcomes 0) has the posterior of the nearest parent with some:
    its registered domain, else its suffix, else all outcomes, each as a prior without own counts, so its bound is wider. A page
    without host is allowed (reputation and bound null). Null urls and urls without :// have an empty host and path. Repeated rows
    are judged alike. Reputations are found once per host; the join of pages with them can be split at a host with a third of
    all pages. Further columns are ignored.
    """
    low, middle, top, whole = _levels(outcomes)
    told = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    told = told.withColumn("fit", matching_rule(F.col("host"), F.col("path")))
    hosts = told.select(F.col("host").alias("_host")).filter("_host <> ''").distinct().withColumns(
        {"_domain": registered_domain(F.col("_host")), "_suffix": suffix_of(F.col("_host"))})
    own = low.select("host", "n", F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    domain = middle.select("domain", F.col("mean").alias("m1"), F.col("child_sd").alias("s1"))
    suffix = top.select("suffix", F.col("mean").alias("m2"), F.col("child_sd").alias("s2"))
    every = whole.select(F.col("mean").alias("m3"), F.col("child_sd").alias("s3"))
    known = (hosts.join(own, F.col("_host") == F.col("host"), "left").join(domain, F.col("_domain") == F.col("domain"), "left")
             .join(suffix, F.col("_suffix") == F.col("suffix"), "left").join(F.broadcast(every), how="cross"))
    mean, sd = F.coalesce("m0", "m1", "m2", "m3"), F.coalesce("s0", "s1", "s2", "s3")
    known = known.select("_host", F.coalesce("n", F.lit(0)).alias("n_outcomes"), mean.alias("mean"), (mean + z * sd).alias("high"))
    both = told.join(known, F.col("host") == F.col("_host"), "left")
    verdict = F.when(F.col("high") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return both.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", verdict).alias("verdict"),
                       F.coalesce("n_outcomes", F.lit(0)).cast("long").alias("n_outcomes"), F.round("mean", 6).alias("reputation"), F.round("high", 6).alias("bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, is_good): pages whose url ends in the number of a labelled document; good means quality 1 and not toxic.

    The number is the first run of digits that is a whole path segment, up to a dot. Null labels give no outcome.
    """
    number = F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})(?:[/.]|\z)", 1)
    page = pages.select(url_host(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("_number")).filter("_number is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("_number"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).alias("is_good"))
    return page.join(known, "_number").select("host", "is_good")
