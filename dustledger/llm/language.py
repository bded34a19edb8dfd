"""Language identification in two levels: family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Family of common language codes. A code that is not listed is a family of its own.
FAMILY = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
DIMENSION = 4096
ORDERS = (1, 2, 3, 4)
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HAS_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _HAS_LETTER.finditer(text))


def histogram(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased letters of the whole text, in bounded pieces."""
    out = np.zeros(DIMENSION, np.float64)
    line = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    reach = max(ORDERS) - 1
    for at in range(0, len(line), _CHUNK):
        raw = np.frombuffer(line[at:at + _CHUNK + reach], np.uint8).astype(np.uint32)
        own = min(_CHUNK, len(line) - at)
        code = np.zeros(len(raw), np.uint32)
        for n in ORDERS:
            count = min(own, len(raw) - n + 1)
            if count <= 0:
                break
            code = (code[:count] * np.uint32(257) + raw[n - 1:n - 1 + count]) if n > 1 else raw[:count]
            slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount(slot, minlength=DIMENSION)
    return out


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of the n-gram counts."""
    x = np.sqrt(histogram(text))
    length = np.sqrt((x * x).sum())
    return (x / length if length else x).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of an L2-regularised hinge-loss SVM, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    norm = (x * x).sum(axis=1)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] + (1.0 - y[i] * (x[i] @ w)) / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class LanguageModel:
    """Pairwise weights between families, and between the languages of each family.

    ``predict`` gives (language, score, family): votes of the pairwise machines decide (ties by the sum of
    margins, then name) first among families, then among the family's languages. The score is the product,
    over both levels, of the logistic of twice the winner's smallest margin.
    """

    def __init__(self, families: Mapping[str, list[str]], weights: Mapping[tuple[str, str], np.ndarray]):
        self.families = {k: sorted(v) for k, v in sorted(families.items())}
        self.pairs = sorted(weights)
        self.matrix = np.array([weights[p] for p in self.pairs]) if self.pairs else np.zeros((0, DIMENSION + 1))

    def _duel(self, names: list[str], margin: Mapping[tuple[str, str], float]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        own = {n: [margin[n, o] if (n, o) in margin else -margin[o, n] for o in names if o != n] for n in names}
        best = min(names, key=lambda n: (-sum(m > 0 for m in own[n]), -sum(own[n]), n))
        return best, float(1.0 / (1.0 + np.exp(-2.0 * min(own[best]))))

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        if not self.families or not has_letter(text):
            return "und", 0.0, None
        margin = dict(zip(self.pairs, self.matrix[:, :-1] @ features(text) + self.matrix[:, -1]))
        kin, sure = self._duel([f"family:{k}" for k in self.families], margin)
        kin = kin.removeprefix("family:")
        name, own = self._duel(self.families[kin], margin)
        return name, sure * own, kin


def family_of(lang: str) -> str:
    return next((family for family, codes in FAMILY.items() if lang in codes), lang)


def _sample(labelled: DataFrame, sizes: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` texts of each language, by smallest text hash, so the choice is repeatable.

    A hash threshold cuts a frequent language down before the ranks, and copies of a text count once, so no task sorts all rows; ``sizes`` (lang, _n) has
    one row per language, its number of different texts, and is broadcast, so that texts are not dealt out by language.
    """
    hashed = labelled.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    near = hashed.join(F.broadcast(sizes), "lang").filter(F.col("_h") * F.col("_n") <= float(4 * per_language) * (1 << 40))
    near = near.dropDuplicates(["lang", "text"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    return near.withColumn("_r", rank).filter(F.col("_r") <= per_language).select("text", "lang")


def fit_language_model(labelled: DataFrame, per_language: int = 800, most_languages: int = 500) -> LanguageModel:
    """Fit on (text, lang) rows. Rows with a null text or lang, or without letters, teach nothing.

    Each machine is trained by one task on a bounded sample (``per_language`` texts of each language, up
    to ``per_language`` of each family, as sparse n-gram vectors). More than ``most_languages`` different labels are an
    error, since the model is broadcast. No labelled row gives a model that answers ``und``.
    """
    spark = labelled.sparkSession
    usable = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def sparse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = [features(t) for t in part["text"]]
            slots = [np.flatnonzero(v) for v in vectors]
            yield pd.DataFrame({"lang": part["lang"], "slot": slots, "value": [v[s] for v, s in zip(vectors, slots)]})

    # different texts: with copies counted, the threshold would leave a language of many copies too few of its texts, or none
    texts = usable.select("lang", F.xxhash64("text").alias("_h")).distinct()
    counted = texts.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} different language labels")
    languages = sorted(r["lang"] for r in counted)
    sizes = spark.createDataFrame([(r["lang"], r["count"]) for r in counted], "lang string, _n long")
    sample = _sample(usable, sizes, per_language).mapInPandas(sparse, "lang string, slot array<int>, value array<float>")
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family_of(lang), []).append(lang)
    duels = [(a, b, [a], [b]) for own in families.values() for a, b in itertools.combinations(sorted(own), 2)]
    duels += [(f"family:{a}", f"family:{b}", families[a], families[b]) for a, b in itertools.combinations(sorted(families), 2)]
    sides = [(a, b, lang, side, len(own)) for a, b, left, right in duels
             for own, side in ((left, 1), (right, -1)) for lang in own]
    if not sides:
        return LanguageModel(families, {})
    roles = spark.createDataFrame(sides, "a string, b string, lang string, side int, share int")

    def train(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_key=[hash(tuple(s.tolist())) for s in part["slot"]]).sort_values(["lang", "_key"], kind="stable")
        keep = part.groupby("lang").cumcount() < np.ceil(per_language / part["share"])
        part = part[keep]
        x = np.zeros((len(part), DIMENSION), np.float32)
        for row, (slot, value) in enumerate(zip(part["slot"], part["value"])):
            x[row, np.asarray(slot, int)] = value
        w = train_svm(x, part["side"].to_numpy(float))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [w]})

    trained = sample.join(F.broadcast(roles), "lang").groupBy("a", "b").applyInPandas(train, "a string, b string, w array<double>")
    return LanguageModel(families, {(r["a"], r["b"]): np.array(r["w"]) for r in trained.collect()})


def predicted_language(text: Column, model: LanguageModel, spark) -> Column:
    """Struct column (lang, score, family) for whole texts; null and letterless texts are ``und`` with score 0."""
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score", "family"])

    return F.pandas_udf(predict, "struct<lang:string,score:double,family:string>")(text)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def document_languages(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, family) for every document.

    Learns from text and lang of the documents whose remainder modulo 3 is not 1; a row without id is
    held out and teaches nothing. Prediction reads the text only. Further columns are ignored.
    """
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    model = fit_language_model(docs.filter(~held_out).select("text", "lang"), per_language)
    told = docs.select("doc_id", held_out.alias("held_out"), predicted_language(F.col("text"), model, docs.sparkSession).alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.family")
