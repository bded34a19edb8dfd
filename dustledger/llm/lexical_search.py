"""Ranked lexical search: documents of every query item, grouped by the mask of the item's terms that they hold.

Documents are read once into postings of the items' terms (document, length, term numbers, frequencies). A task then takes its
postings block by block, keeps a bitmap of the block's documents per term, and for every item turns the bitmaps of
its terms into one mask per document. Documents of equal masks form a group; a group's score cannot exceed the sum of the
largest contributions of the mask's terms in the block. Groups are evaluated by falling bound, until the item's top list of
the task is full and no further bound reaches its last score. Only top lists leave a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from dustledger.llm.words import folded
from dustledger.session import durable

#: Postings of one block in memory, and flags (documents times terms) of one item in one block.
BLOCK_POSTINGS, BLOCK_FLAGS = 4_000_000, 64_000_000
_NO_ID = np.iinfo(np.int64).max


@dataclass
class ItemBlock:
    """Some items and the numbers of their distinct terms; the vocabulary numbers all terms of the block."""

    ids: list[int | None]
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, most_terms: int) -> Iterator[ItemBlock]:
    """Items in blocks of at most ``most_terms`` terms in all (an item with more stands alone); streamed to the driver."""
    merged = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    block, size = ItemBlock([], [], {}), 0
    for row in merged.toLocalIterator():
        own = sorted({word for text in row["texts"] for word in folded(text).split()})
        if block.ids and size + len(own) > most_terms:
            yield block
            block, size = ItemBlock([], [], {}), 0
        if own:
            block.ids.append(row["item_id"])
            block.terms.append(np.array([block.vocabulary.setdefault(w, len(block.vocabulary)) for w in own], np.int64))
            size += len(own)
    if block.ids:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with at least one term; ``terms`` are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n long, terms array<int>, tfs array<long>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            kept, lengths, ends, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column("text")):
                words = folded(text.as_py()).split()
                if words:
                    own = Counter(words)
                    found = [(number[w], c) for w, c in own.items() if w in number]
                    kept.append(k)
                    lengths.append(len(words))
                    terms.extend(t for t, _ in found)
                    tfs.extend(c for _, c in found)
                    ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
            ], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, schema)


class _Block:
    """The postings of one block of documents, by term: positions, contributions to a score, bitmap and largest contribution."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, words: int):
        ids, n = batch.column("doc_id"), batch.column("n").to_numpy()
        lists = batch.column("terms")
        term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        position = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        m = 50 + (50 * n * documents) // words
        worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[position]))
        order = np.argsort(term, kind="stable")
        self.positions, self.worths = position[order], worth[order]
        self.edges = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.size = len(n)
        self.absent = np.asarray(ids.is_null())
        self.ids = ids.fill_null(_NO_ID).to_numpy()
        self._bitmaps: dict[int, tuple[np.ndarray, int]] = {}

    def bitmap(self, term: int) -> tuple[np.ndarray, int]:
        """(bit of every document of the block, largest contribution) of a term."""
        if term not in self._bitmaps:
            flag = np.zeros(self.size, bool)
            a, b = self.edges[term], self.edges[term + 1]
            flag[self.positions[a:b]] = True
            self._bitmaps[term] = np.packbits(flag), int(self.worths[a:b].max(initial=0))
        return self._bitmaps[term]

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of documents by matched terms: (bound of each mask, documents in mask order, first of each mask)."""
        known = [self.bitmap(int(t)) for t in terms]
        rows = np.stack([bits for bits, _ in known])
        present = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), count=self.size))
        flags = np.unpackbits(rows, axis=1, count=self.size)[:, present]
        width = -(-len(terms) // 64) * 64
        bits = np.zeros((width, len(present)), np.uint8)
        bits[:len(terms)] = flags
        words = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64)
        if words.shape[1] == 1:
            order = np.argsort(words[:, 0], kind="stable")
        else:
            order = np.lexsort(words.T)
        words = words[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[1:] != words[:-1]).any(axis=1)
        first = np.flatnonzero(fresh)
        bound = np.array([most for _, most in known], np.int64) @ flags[:, order[first]].astype(np.int64)
        return bound, present[order], first

    def scores(self, terms: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Exact scores of some documents (ascending positions)."""
        total = np.zeros(len(documents), np.int64)
        for t in terms:
            a, b = self.edges[t], self.edges[t + 1]
            if a < b:
                at = np.searchsorted(self.positions[a:b], documents)
                at[at == b - a] = 0
                hit = self.positions[a:b][at] == documents
                total[hit] += self.worths[a:b][at[hit]]
        return total


class _Best:
    """The best documents of an item so far: the highest scores, equal ones by ascending id, rows without id last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.absent, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def needed(self) -> int:
        """A score below this one cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.needed()
        score, absent, ids = (np.concatenate(x) for x in ((self.score, score[keep]), (self.absent, absent[keep]), (self.ids, ids[keep])))
        order = np.lexsort((ids, absent, -score))[:self.top]
        self.score, self.absent, self.ids = score[order], absent[order], ids[order]


def search_block(block: _Block, terms: np.ndarray, best: _Best) -> int:
    """Let the documents of a block into an item's top list; returns how many of them were scored."""
    bound, documents, first = block.masks(terms)
    ends = np.append(first[1:], len(documents))
    by_bound = np.argsort(-bound, kind="stable")
    reach = np.cumsum((ends - first)[by_bound])
    at, step, scored = 0, best.top, 0
    while at < len(by_bound) and bound[by_bound[at]] >= best.needed():
        until = max(at + 1, int(np.searchsorted(reach, scored + step, side="right")))
        chosen = by_bound[at:until]
        chosen = chosen[bound[chosen] >= best.needed()]
        some = np.sort(np.concatenate([documents[first[g]:ends[g]] for g in chosen]))
        best.add(block.scores(terms, some), block.absent[some], block.ids[some])
        scored += len(some)
        at, step = until, 2 * step
    return scored


def _parts(batch: pa.RecordBatch, longest: int) -> Iterator[pa.RecordBatch]:
    """Blocks of bounded size, if the longest item has ``longest`` terms."""
    if batch.num_rows > 1 and (len(batch.column("terms").flatten()) > BLOCK_POSTINGS or batch.num_rows * longest > BLOCK_FLAGS):
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half), longest)
        yield from _parts(batch.slice(half), longest)
    elif batch.num_rows:
        yield batch


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = 50, most_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0.

    Terms are maximal runs of letters, digits and characters beyond ASCII in whole texts, with A-Z lower-cased; an item
    counts each of its terms once. The score of a document sums w * (10^9 tf div (1000 tf + 20 m)) over the item's terms, with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L over all documents with at least one term.

    Items are the stated query set: they run in blocks of at most ``most_terms`` terms, one pass over the documents each (one
    block in the usual case), and only a block's vocabulary is broadcast. Every document is in the statistics and in the search;
    masks are skipped only where their bound shows that no document of theirs can enter the task's list.

    Texts of one item_id are one item (the union of their terms); null item_ids are one item. Null and wordless items find
    nothing. Null and wordless documents are in no statistic. Repeated rows are documents of their own; rows without doc_id
    take part and rank after equal scores with ids. Further columns are ignored.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, part int")
    for block in item_blocks(items, most_terms):
        held = durable(postings(docs, block.vocabulary))
        whole = held.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        # at most most_terms rows
        df = {r["term"]: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = np.array([math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block.vocabulary))], np.int64)
        found = found.unionByName(_found(held, block, weights, whole["documents"], whole["words"], top))
    # a task sends at most ``top`` rows an item; lists of many tasks meet in lots before they meet as a whole
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lots = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = lots.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _found(held: DataFrame, block: ItemBlock, weights: np.ndarray, documents: int, words: int, top: int, lots: int = 64) -> DataFrame:
    shared = held.sparkSession.sparkContext.broadcast((block.ids, block.terms, weights))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, terms, weigh = shared.value
        best = [_Best(top) for _ in ids]
        longest = max(map(len, terms))
        for batch in batches:
            for part in _parts(batch, longest):
                one = _Block(part, weigh, documents, words)
                for own, list_of in zip(terms, best):
                    search_block(one, own, list_of)
        lot = TaskContext.get().partitionId() % lots
        for item, own in zip(ids, best):
            if len(own.score):
                size = len(own.score)
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * size, pa.int64()), pa.array(own.ids, pa.int64(), mask=own.absent), pa.array(own.score, pa.int64()),
                    pa.array([lot] * size, pa.int32())], ["item_id", "doc_id", "score", "part"])

    return held.mapInArrow(searched, "item_id long, doc_id long, score long, part int")
