"""Repeated runs of lines across a corpus: winnowed line hashes find candidates, whole windows decide, later runs go."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dustledger.session import durable, skew_join

WINDOW = "doc_id string, unit long, mark binary, content binary, start int, end int"


def text_lines(text: str | None) -> list[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of every line with a word; the span includes the line break that follows.

    Lines are compared without surrounding white space.
    """
    out, at = [], 0
    for line in (text or "").split("\n"):
        end = at + len(line) + 1
        words = len(line.split())
        if words:
            out.append((at, end, blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=16).digest(), words))
        at = end
    return out


def line_windows(lines: list[tuple[int, int, bytes, int]], least_words: int) -> list[tuple[bytes, bytes, int, int]]:
    """(fingerprint, content, first line, last line) of the shortest windows of ``least_words`` words.

    One window starts at every line and one ends at every line, where enough words are left: the two families
    cover every line of a run of ``least_words`` words or more. The fingerprint is the least line digest in the window,
    so equal windows share it, and neighbouring windows mostly have the same one.
    """
    total = [0]
    for line in lines:
        total.append(total[-1] + line[3])
    found = set()
    last = 0
    for first in range(len(lines)):
        last = max(last, first)
        while last < len(lines) and total[last + 1] - total[first] < least_words:
            last += 1
        if last == len(lines):
            break
        found.add((first, last))
    first = len(lines) - 1
    for last in range(len(lines) - 1, -1, -1):
        first = min(first, last)
        while first >= 0 and total[last + 1] - total[first] < least_words:
            first -= 1
        if first < 0:
            break
        found.add((first, last))
    out = []
    for first, last in sorted(found):
        own = [line[2] for line in lines[first:last + 1]]
        out.append((min(own)[:8], blake2b(b"".join(own), digest_size=16).digest(), first, last))
    return out


def cut_lines(text: str | None, firsts, lasts) -> tuple[str | None, int, int, int, list[dict]]:
    """The text without the given runs of lines, its line count, lines and runs removed, and the removed spans."""
    lines = text_lines(text)
    if firsts is None or not len(firsts):
        return text, len(lines), 0, 0, []
    runs: list[list[int]] = []
    for first, last in sorted(zip(firsts, lasts)):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], int(last))
        else:
            runs.append([int(first), int(last)])
    spans, kept, at = [], [], 0
    for first, last in runs:
        start, end = lines[first][0], min(lines[last][1], len(text))
        spans.append({"start": start, "end": end})
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return "".join(kept), len(lines), sum(b - a + 1 for a, b in runs), len(runs), spans


def drop_repeated_runs(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_runs, spans): whole texts without runs of lines seen earlier in the corpus.

    A run of whole lines with ``least_words`` words or more is removed where the same lines stand earlier, in the order of
    (doc_id, text hash, line); the first one stays. Inside one text a window that overlaps its first occurrence is not a copy.

    1. Winnowing: every window of about ``least_words`` words is represented by its least line digest. Only windows whose
       fingerprint occurs at two places or more are looked at further; a common line alone makes no match.
    2. Joining positions: the windows that are left are grouped by their content, and each is compared with the earliest
       place of that content only, so a passage with a million copies gives a million rows and no pairs.
    3. Extension both ways: windows are taken from each line forwards and backwards, so the later windows of a run overlap
       and their union reaches to the first and the last line that the two places share.

    Lines of white space only are no lines, and go when the run around them goes. Null texts stay null, empty ones empty. Rows without
    doc_id come last in the order. Repeated rows (equal id and text) are one text, cut alike. Further columns are ignored.
    """
    unit = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long"), "text", unit.alias("unit"))

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(doc_id, unit, *w) for doc_id, unit, text in zip(part["doc_id"], part["unit"], part["text"])
                    for w in line_windows(text_lines(text), least_words)]
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "mark", "content", "start", "end"])

    # ids pass through pandas as text: a null would turn a whole batch of longs into doubles
    named = texts.withColumn("doc_id", F.col("doc_id").cast("string")).filter("text is not null")
    every = durable(named.mapInPandas(windows, WINDOW).withColumn("doc_id", F.col("doc_id").cast("long")))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "unit", F.col("start").alias("at"), F.col("end").alias("to"))
    marks = every.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("mark")
    near = skew_join(every, marks, ["mark"], "left_semi")
    first = near.groupBy("content").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    same = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("unit") == F.col("low.unit"))
    later = skew_join(near, first.select("content", "low"), ["content"]).filter(~same | (F.col("start") > F.col("low.to")))
    cuts = later.groupBy("doc_id", "unit").agg(F.collect_set(F.struct("start", "end")).alias("runs")).select(
        F.col("doc_id").alias("_id"), F.col("unit").alias("_unit"), "runs")
    joined = texts.join(cuts, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["unit"].eqNullSafe(F.col("_unit"))), "left")

    def cut(text: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_lines(*row) for row in zip(text, firsts, lasts)],
                            columns=["text", "n_lines", "n_removed", "n_runs", "spans"])

    made = F.pandas_udf(cut, "struct<text:string,n_lines:long,n_removed:long,n_runs:long,spans:array<struct<start:int,end:int>>>")
    return joined.select("doc_id", made("text", "runs.start", "runs.end").alias("c")).select("doc_id", "c.*")
