"""Ranked lexical search over whole texts by NRA: sequential reads of lists that are sorted by impact.

Two passes. The first scans the texts once and writes blocks: the documents of a piece of a partition, and how often each
term of the items occurs in them. The totals of the corpus (documents, terms, documents per term) come from the blocks.
The second pass turns the counts of a block into lists of integer impacts, one per term and sorted from the highest, and
answers every item on it. Blocks are bounded, so a term that every document holds is as many bounded lists as there are
blocks, and no list is ever gathered. What leaves a task are at most ``k`` documents per item.

On a block the lists of an item are read in turn, never by document. A document that was met has a lower bound, the
impacts read so far, and an upper bound, which adds the next unread impact of every list that has not shown it yet.
Reading goes on until no document outside of the best ``k`` can reach them, ties included, and the bounds of all that
can have met, so that scores are final. Lists that no open document waits for are not read further. The worst of the
best ``k`` of the blocks before, in the same task, is a bar for the next one.

The items are a stated query set. Their terms travel with the functions; items of more than ``ITEM_BYTES`` of text are
dealt out by a hash and take a pass per share, so what is sent is bounded at any number of items.

Defined results: NULL and texts without terms are in no count and in no result; an item without terms has no rows.
Equal rows of ``items`` are one item. Every row of ``documents`` is a document, also with an id that is NULL or
repeated; among equal scores NULL comes first. Extra columns are ignored. No documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mrkit.llm.common import texts
from mrkit.session import Generations, checkpoint

TOP = 10

# Bytes of items that travel together, where an item costs some bytes besides its text, and documents and counts of a block.
ITEM_BYTES, ITEM_COST = 8 << 20, 64
BLOCK_DOCS = 1 << 13
BLOCK_COUNTS = 1 << 19

# Bytes of a long text that are split into terms at once, and cells of the table of which list has shown which document.
SLICE = 1 << 20
CELLS = 1 << 26

# Documents of a list that the first turn reads; every turn reads twice as many.
FIRST_READ = 64

# Parts that the best documents of an item are reduced in before they meet.
MERGE_PARTS = 64

# The ASCII characters that terms consist of; characters beyond ASCII belong to terms as well.
ALPHANUMERIC = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLDED = bytes(ord(" ") if c < 128 and c not in ALPHANUMERIC else c for c in range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
)

BLOCK = (
    "docs array<long>, sizes binary, terms binary, at binary, tf binary, "
    "own array<int>, own_docs array<int>, n_docs long, n_terms long"
)
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    start = 0
    while start < len(text):
        end = start + SLICE
        folded = text[start:end].translate(FOLDED)
        if end < len(text):
            # The last term may go on; without a separator in the slice, the term is taken as a whole.
            cut = folded.rfind(b" ") + 1
            while not cut and end < len(text):
                more = text[end : end + SLICE].translate(FOLDED)
                cut = len(folded) + more.find(b" ") + 1 if b" " in more else 0
                folded, end = folded + more, end + len(more)
            folded = folded[: cut or len(folded)]
        start += len(folded)
        yield folded.split()


class Items:
    """Items and their terms by number; equal terms of an item stand once, with how often they occur."""

    def __init__(self, rows: list[str | None]):
        self.numbers: dict[bytes, int] = {}
        self.terms, self.repeats = [], []
        for text in rows:
            words = [word for part in terms_of((text or "").encode()) for word in part]
            own = [self.numbers.setdefault(word, len(self.numbers)) for word in words]
            terms, repeats = np.unique(np.array(own, dtype=np.int64), return_counts=True)
            self.terms.append(terms)
            self.repeats.append(repeats)


def write_blocks(documents: DataFrame, numbers: dict[bytes, int], block_docs: int, block_counts: int) -> DataFrame:
    """``BLOCK`` rows: documents that hold a wanted term, their sizes, and the counts as ``(term, at, tf)``."""

    def block(docs: list, sizes: list, counts: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(counts)), [len(c[0]) for c in counts])
        terms = np.concatenate([c[0] for c in counts]) if counts else np.zeros(0, np.int64)
        tf = np.concatenate([c[1] for c in counts]) if counts else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        own, own_docs = np.unique(terms, return_counts=True)
        values = [(sizes, "<i8"), (terms[order], "<i4"), (at[order], "<i4"), (tf[order], "<u4")]
        packed = [pa.array([np.asarray(x).astype(kind).tobytes()], pa.binary()) for x, kind in values]
        lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (own, own_docs)]
        totals = [pa.array([n], pa.int64()) for n in (n_docs, n_terms)]
        names = [field.split()[0] for field in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), *packed, *lists, *totals], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, counts, held, n_docs, n_terms = [], [], [], 0, 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                size, wanted = 0, []
                for words in terms_of(text):
                    size += len(words)
                    wanted.append(np.array([n for n in map(numbers.get, words) if n is not None], dtype=np.int64))
                n_docs, n_terms = n_docs + (size > 0), n_terms + size
                own = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
                if len(own):
                    counts.append(np.unique(own, return_counts=True))
                    docs.append(doc_id)
                    sizes.append(size)
                    held += len(counts[-1][0])
                if len(docs) >= block_docs or held >= block_counts:
                    yield block(docs, sizes, counts, n_docs, n_terms)
                    docs, sizes, counts, held, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield block(docs, sizes, counts, n_docs, n_terms)

    return documents.select("doc_id", "text").mapInArrow(count, BLOCK)


class Corpus:
    """Documents and terms of the corpus, and the weight of every term of the items."""

    def __init__(self, blocks: DataFrame, n_terms: int):
        totals = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        self.docs, self.terms = totals.docs or 0, totals.terms or 0
        own = blocks.select(F.explode(F.arrays_zip("own", "own_docs")).alias("x")).select("x.*")
        self.weights = np.zeros(n_terms, dtype=np.int64)
        # At most a row per term of the items.
        for row in own.groupBy("own").agg(F.sum("own_docs").alias("df")).collect():
            self.weights[row.own] = math.floor(1000 * math.log((2 * self.docs + 2) / (2 * row.df + 1)))

    def length_factor(self, sizes: np.ndarray) -> np.ndarray:
        own, at = np.unique(sizes, return_inverse=True)
        return np.array([25 + 75 * n * self.docs // self.terms for n in own.tolist()], dtype=np.int64)[at]


class Lists:
    """The lists of one block, each from the highest impact to the lowest."""

    def __init__(self, n: int, terms: np.ndarray, at: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((at, -impact, terms))
        self.n, self.n_terms = n, n_terms
        self.terms, self.at, self.impact = terms[order], at[order], impact[order]
        self.starts = np.searchsorted(self.terms, np.arange(n_terms + 1))

    @classmethod
    def of_block(cls, row: dict, corpus: Corpus) -> Lists:
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind).astype(np.int64)
        terms, at, tf = read("terms", "<i4"), read("at", "<i4"), read("tf", "<u4")
        factor = corpus.length_factor(read("sizes", "<i8"))[at]
        impact = corpus.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * factor))
        some = impact > 0
        return cls(len(row["sizes"]) // 8, terms[some], at[some], impact[some], len(corpus.weights))

    def part(self, lo: int, hi: int) -> Lists:
        own = (self.at >= lo) & (self.at < hi)
        return Lists(hi - lo, self.terms[own], self.at[own] - lo, self.impact[own], self.n_terms)

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are the best ``k`` of at least ``bar``, and all that tie with the last."""
        there = self.starts[terms + 1] > self.starts[terms]
        terms, repeats = terms[there], repeats[there]
        if len(terms) > 1 and self.n > 1 and len(terms) * self.n > CELLS:
            step = max(1, CELLS // len(terms))
            found = [(lo, self.part(lo, min(lo + step, self.n)).best(terms, repeats, k, bar)) for lo in range(0, self.n, step)]
            return tuple(map(np.concatenate, zip(*((docs + lo, scores) for lo, (docs, scores) in found))))
        return self._nra(terms, repeats, k, bar)

    def _nra(self, terms: np.ndarray, repeats: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        position, end = self.starts[terms].copy(), self.starts[terms + 1]
        lower, shown = np.zeros(self.n, dtype=np.int64), np.zeros((len(terms), self.n), dtype=bool)
        reading, step = np.ones(len(terms), dtype=bool), FIRST_READ
        while True:
            for i in np.flatnonzero(reading & (position < end)):
                stop = min(position[i] + step, end[i])
                docs = self.at[position[i] : stop]
                lower[docs] += self.impact[position[i] : stop] * repeats[i]
                shown[i, docs] = True
                position[i] = stop
            step *= 2
            unread = position < end
            bound = np.zeros(len(terms), dtype=np.int64)
            bound[unread] = self.impact[position[unread]] * repeats[unread]
            met = np.flatnonzero(lower)
            least = max(bar, 1)
            if len(met) >= k:
                least = max(least, int(np.partition(lower[met], len(met) - k)[len(met) - k]))
            total = int(bound.sum())
            # What no list has shown yet reaches at most the sum of the next impacts.
            near = met[lower[met] + total >= least]
            hidden = ~shown[:, near]
            upper = lower[near] + bound @ hidden
            open_ = (upper >= least) & (upper > lower[near])
            if total < least and not open_.any():
                final = near[lower[near] >= least]
                return final, lower[final]
            # A list that has nothing more to give to open documents need not be read if unseen ones are out.
            reading = unread if total >= least else unread & hidden[:, open_].any(axis=1)


def search_blocks(blocks: DataFrame, items: Items, corpus: Corpus, k: int) -> DataFrame:
    """``FOUND`` rows: per task and item its best ``k`` documents, with their final scores."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per item and document: the score, whether the id is not NULL, and the id.
        best = [np.zeros((0, 3), dtype=np.int64) for _ in items.terms]
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lists = Lists.of_block(row, corpus)
                ids = np.array([[i is not None, i or 0] for i in row["docs"]], dtype=np.int64).reshape(-1, 2)
                for n, (terms, repeats) in enumerate(zip(items.terms, items.repeats)):
                    bar = int(best[n][-1, 0]) if len(best[n]) == k else 0
                    docs, scores = lists.best(terms, repeats, k, bar)
                    rows = np.concatenate([best[n], np.column_stack([scores, ids[docs]])])
                    best[n] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]
        rows = [np.column_stack([np.full(len(b), n), b]) for n, b in enumerate(best)]
        rows = np.concatenate([np.zeros((0, 4), dtype=np.int64), *rows])
        columns = [
            pa.array(rows[:, 0].astype(np.int32)),
            pa.array(rows[:, 3], mask=rows[:, 2] == 0),
            pa.array(rows[:, 1]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return blocks.mapInArrow(search, FOUND)


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = TOP,
    item_bytes: int = ITEM_BYTES,
    block_docs: int = BLOCK_DOCS,
    block_counts: int = BLOCK_COUNTS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest score above 0 for each of the ``items``.

    ``documents`` is ``(doc_id, text)``, ``items`` is ``(item_id, text)``. Equal scores come by ascending id.
    """
    rows = checkpoint(items.select("item_id", "text").distinct())
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_COST
    shares = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // item_bytes))
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(shares))
    results = [
        _search(documents, rows if shares == 1 else rows.where(share == n), k, block_docs, block_counts)
        for n in range(shares)
    ]
    return reduce(DataFrame.unionByName, results)


def _search(documents: DataFrame, rows: DataFrame, k: int, block_docs: int, block_counts: int) -> DataFrame:
    spark, stated = documents.sparkSession, rows.collect()
    items = Items([row.text for row in stated])
    with Generations(spark) as state:
        blocks = state.keep(write_blocks(documents, items.numbers, block_docs, block_counts))
        found = search_blocks(blocks, items, Corpus(blocks, len(items.numbers)), k)
        order = [F.desc("score"), F.asc("doc_id")]
        # An item has k rows from every task, so parts of them are reduced first.
        part = Window.partitionBy("item", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
        whole = Window.partitionBy("item").orderBy(*order)
        found = checkpoint(found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k))
    numbered = spark.createDataFrame([(n, row.item_id) for n, row in enumerate(stated)], "item int, item_id long")
    return found.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
