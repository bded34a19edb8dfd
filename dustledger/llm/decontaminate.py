"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dustledger.llm.words import WORD_PATTERN, folded

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:int,end:int>>>"
_WORD = re.compile(WORD_PATTERN)
_BUILT: OrderedDict[str, object] = OrderedDict()


def item_windows(text: str | None, width: int) -> list[str]:
    """The windows of ``width`` words of an item, each between single spaces; a shorter item is one window."""
    words = folded(text).decode("latin-1").split(" ")
    if words == [""]:
        return []
    return [f" {' '.join(words[i:i + width])} " for i in range(max(1, len(words) - width + 1))]


def automaton(patterns: list[tuple[str, list[int]]]):
    """The automaton over (window, item ids); a match yields (word count, length, ids)."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, ids in patterns:
        built.add_word(window, (window.count(" ") - 1, len(window), tuple(ids)))
    built.make_automaton()
    return built


def kept_automaton(key: str, patterns: list[tuple[str, list[int]]], most: int = 2):
    """The automaton of a part, built once per worker process; a worker holds at most ``most`` of them."""
    if key not in _BUILT:
        while len(_BUILT) >= most:
            _BUILT.popitem(last=False)
        _BUILT[key] = automaton(patterns)
    _BUILT.move_to_end(key)
    return _BUILT[key]


def scan(built, text: str | None) -> tuple[int, np.ndarray | None, set[int]]:
    """(word count, hit flag of each word or None, ids of items that occur) of one whole text, in one pass."""
    norm = folded(text)
    if not norm:
        return 0, None, set()
    line = f" {norm.decode('latin-1')} "
    total = line.count(" ") - 1
    found = list(built.iter(line)) if len(built) else []
    if not found:
        return total, None, set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    edges = np.zeros(total + 1, np.int64)
    items: set[int] = set()
    for end, (words, length, ids) in found:
        first = int(np.searchsorted(gaps, end - length + 1))
        edges[first] += 1
        edges[first + words] -= 1
        items.update(ids)
    return total, np.cumsum(edges[:-1]) > 0, items


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point spans of the original text."""
    out: list[dict] = []
    last = -2
    for k, word in enumerate(_WORD.finditer(text)):
        if hit[k]:
            if last == k - 1:
                out[-1]["end"] = word.end()
            else:
                out.append({"start": word.start(), "end": word.end()})
            last = k
    return out


def _patterns(benchmark: DataFrame, width: int, limit: int) -> list[list[tuple[str, list[int]]]]:
    """Windows with their item ids, cut into parts of at most ``limit`` characters of window text."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull()).distinct()
    parts: list[list[tuple[str, list[int]]]] = []
    known: dict[str, list[int]] = {}
    size = 0
    for row in rows.toLocalIterator():
        for window in item_windows(row["text"], width):
            if window not in known:
                size += len(window)
                known[window] = []
            if row["item_id"] is not None and row["item_id"] not in known[window]:
                known[window].append(row["item_id"])
        if size >= limit:
            parts.append(list(known.items()))
            known, size = {}, 0
    return [*parts, list(known.items())] if known or not parts else parts


def benchmark_hits(text: Column, benchmark: DataFrame, width: int = 13, limit: int = 32_000_000) -> Column:
    """Struct column (n_words, n_hit, items, spans): what of ``text`` occurs in the benchmark.

    Every word inside an occurrence of a window of ``width`` consecutive item words is hit; spans are
    the hit runs in code points of the original text. The test items are the small side: they are
    streamed to the driver and broadcast as parts of about ``limit`` characters, one automaton each (one
    part in the usual case), and further parts are further passes over the same row, merged by word, so
    a worker holds bounded automata whatever the benchmark's size.

    A null or wordless text has 0 words, no hit and empty lists. Items that are null or wordless have no
    window. Repeated items count once by id; an item without id marks words but is not listed.
    """
    context = benchmark.sparkSession.sparkContext
    shared = [(uuid.uuid4().hex, context.broadcast(part)) for part in _patterns(benchmark, width, limit)]

    def hits(texts: pd.Series) -> pd.DataFrame:
        texts = texts.tolist()
        words, flags, items = [0] * len(texts), [None] * len(texts), [set() for _ in texts]
        for key, part in shared:
            machine = kept_automaton(key, part.value)
            for k, one in enumerate(texts):
                words[k], hit, ids = scan(machine, one)
                if hit is not None:
                    flags[k] = hit if flags[k] is None else flags[k] | hit
                    items[k] |= ids
        return pd.DataFrame({
            "n_words": words,
            "n_hit": [0 if f is None else int(f.sum()) for f in flags],
            "items": [sorted(i) for i in items],
            "spans": [[] if f is None else spans_of(t, f) for t, f in zip(texts, flags)],
        })

    return F.pandas_udf(hits, HITS)(text)


def contaminated(hit: Column) -> Column:
    """At least one word and at least a twentieth of all words are hit."""
    return (hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) per document; see ``benchmark_hits``."""
    hit = docs.select("doc_id", benchmark_hits(F.col("text"), benchmark, width).alias("hit"))
    return hit.select("doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("long").alias("n_items"),
                      "hit.items", "hit.spans", contaminated(F.col("hit")).alias("contaminated"))
