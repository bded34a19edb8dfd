"""Small tables for the corpus operators: awkward rows, random corpora, and naive versions to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, key string, digest string, stats string, shard int, slot int, unit string"
SF = "/root/testdata/sf0.001"


def folded_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 1, "x", "k", "d", "s", 5, 6, "u") for i, t, l, s in rows], DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and wordless texts, a very long one, ties and repeated rows."""
    rng = random.Random(3)
    common = sentence(rng, 60)
    long_text = "\n".join(sentence(rng, 40) for _ in range(1500))
    rows = [
        (1, common, "en", "a"), (2, common, "en", "a"), (2, common, "en", "a"), (3, common + " tail", "en", "b"), (4, None, "en", "a"), (5, "", "de", "a"),
        (6, "%%% !!!", None, None), (7, "%%% !!!", None, None), (None, common, None, "b"), (None, "no id here at all but some words", "en", None),
        (None, None, None, None), (8, long_text, "en", "c"), (9, long_text, "en", "c"), (10, "short", "de", "c"), (11, "1234 5678", "de", "c"),
        (12, "naïve ünïcode 漢字 \U0001F600 text", "fr", "c"), (2**53 + 1, "big id", "en", "c"),
    ]
    return rows
