"""Text quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dustledger.llm.language import remainder
from dustledger.session import durable

STATISTICS = (
    "log_words", "log_bytes", "word_length", "distinct_words", "upper", "digit", "punctuation", "symbol", "exclamation", "bar",
    "beyond_ascii", "white_space", "line_length", "repeated_lines", "terminated_lines", "byte_entropy", "capital_words",
    "short_words", "marked_words", "sentence_length",
)
_UPPER, _DIGIT = range(65, 91), range(48, 58)
_SYMBOL = tuple(b"#$%&*+<=>@\\^_`{}~[]|")
_PUNCTUATION = tuple(b".,;:!?'\"()-")
_END = (".", "!", "?", ":", '"')


def _share(part: float, whole: float) -> float:
    """A share as a smoothed log-odds, so that ratios near 0 or 1 are spread like a normal variable."""
    return float(np.log((part + 0.5) / (max(whole, part) - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null and empty texts have those of zero counts."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size, words, lines = float(len(raw)), text.split(), [x for x in text.split("\n") if x.strip()]
    some = max(len(words), 1)
    positive = count[count > 0]
    entropy = float(np.log(size) - (positive * np.log(positive)).sum() / size) if size else 0.0
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    return [
        float(np.log1p(len(words))), float(np.log1p(size)), float(np.log1p(size / some)), _share(len(set(words)), len(words)),
        _share(count[list(_UPPER)].sum(), size), _share(count[list(_DIGIT)].sum(), size), _share(count[list(_PUNCTUATION)].sum(), size),
        _share(count[list(_SYMBOL)].sum(), size), _share(count[33], len(words)), _share(count[124], len(words)),
        _share(count[192:].sum(), size), _share(count[32] + count[10] + count[9], size), float(np.log1p(len(words) / max(len(lines), 1))),
        _share(len(lines) - len(set(lines)), len(lines)), _share(sum(x.rstrip().endswith(_END) for x in lines), len(lines)), entropy,
        _share(sum(w[0].isupper() for w in words), len(words)), _share(sum(len(w) <= 2 for w in words), len(words)), _share(marked, len(words)),
        float(np.log1p(len(words) / (1.0 + count[46]))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row; the text is read once and goes no further."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "stats": [statistics(t) for t in part["text"]]})

    # ids pass through pandas as text: a null would turn a whole batch of longs into doubles
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(measure, "doc_id string, stats array<double>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


class QuadraticDiscriminant:
    """Two Gaussians with shrunken covariances.

    Each class covariance is (1 - own) of itself plus ``own`` of the pooled one, then (1 - round_) of that plus ``round_`` of its
    mean variance on the diagonal. The inverse of each Cholesky factor and the log determinants are computed once.
    A class without rows leaves the score at the share of the other: 1 if only class 1 was seen, 0 if only class 0,
    0.5 without any row.
    """

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], own: float = 0.2, round_: float = 0.02):
        self.classes = {}
        total = sum(m[0] for m in moments.values())
        self.fixed = moments.get(1, (0.0,))[0] / total if total else 0.5
        if any(moments.get(c, (0.0,))[0] < 1 for c in (0, 1)):
            return
        spread = {}
        for c, (n, first, second) in moments.items():
            mean = first / n
            spread[c] = (n, mean, second / n - np.outer(mean, mean))
        pooled = sum(n * cov for n, _, cov in spread.values()) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale = scale
        for c, (n, mean, cov) in spread.items():
            cov = ((1 - own) * cov + own * pooled) / np.outer(scale, scale)
            cov = (1 - round_) * cov + round_ * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (mean / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for rows of statistics."""
        if not self.classes:
            return np.full(len(x), self.fixed)
        density = {}
        for c, (mean, inverse, half_det, prior) in self.classes.items():
            z = (x / self.scale - mean) @ inverse.T
            density[c] = prior - half_det - 0.5 * (z * z).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``stats`` by ``label``: partial sums per partition, then one small aggregate.

    Only d + d^2 + 1 numbers per class reach the driver, whatever the number of rows.
    """
    d = len(STATISTICS)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for label, own in part.groupby("label"):
                x = np.array(own["stats"].tolist(), float)
                add = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                sums[int(label)] = sums.get(int(label), 0.0) + add
        for label, values in sums.items():
            yield pd.DataFrame({"label": label, "place": np.arange(len(values)), "value": values})

    summed = rows.select("label", "stats").mapInPandas(partial, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value"))
    flat: dict[int, np.ndarray] = {}
    for label, place, value in summed.collect():
        flat.setdefault(label, np.zeros(1 + d + d * d))[place] = value
    return {c: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for c, v in flat.items()}


def discriminant_score(stats: Column, model: QuadraticDiscriminant, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def score(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(values.tolist(), float).reshape(len(values), len(STATISTICS))))

    return F.pandas_udf(score, "double")(stats)


def document_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Learns from the labelled documents whose remainder modulo 5 is not 0; only the text is an input of the score. Labels
    other than 0 and 1, nulls and labels without a document teach nothing; repeated labels count as often as they stand. A row
    without id is held out. Null and empty texts are scored like any other. Further columns are ignored.
    """
    measured = durable(with_statistics(docs))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    taught = measured.filter(~held_out).join(known, F.col("doc_id") == F.col("_id"))
    model = QuadraticDiscriminant(class_moments(taught))
    scored = measured.select("doc_id", held_out.alias("held_out"), discriminant_score(F.col("stats"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
