"""Ranked search with range-maximum tables over posting lists.

Documents are indexed in blocks of bounded size. In a block every term has a posting
list of its documents with their impacts, and a sparse table that answers the
largest impact in any stretch of the list in constant time. An item's search starts
with the whole block as one interval of documents; the sum of its terms' range
maxima bounds every score inside. The intervals with the best bounds are split at
the document of largest impact; short ones are scored document by document. It ends
when no bound reaches the k-th score. The best documents of the blocks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from testfloor.session import materialize

BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 15
CHUNK_TERMS = 1 << 18  # item terms searched in one pass over the documents
LEAF = 48
WIDE = 256  # intervals split at a time

# A-Z become a-z, what is neither a letter, a digit nor beyond ASCII becomes a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_py() or b""


def _counted(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, tfs) of every document with a term; only terms of the vocabulary are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, starts, found, counts = [], [], [0], [], []
            for place, text in enumerate(_texts(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                ids.append(place)
                lengths.append(len(words))
                own = sorted((vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary)
                found += [t for t, _ in own]
                counts += [c for _, c in own]
                starts.append(len(found))
            offsets = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids, pa.int64())),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class Index:
    """Posting lists of one block, by term and document place, with their sparse tables.

    ``quotients`` are impacts without the term's weight, so that 32 bits hold them.
    """

    def __init__(self, docs: np.ndarray, found: np.ndarray, quotients: np.ndarray, n_docs: int):
        # Documents with the same strongest term, and among these of like strength, lie side by side.
        size = np.bincount(docs, minlength=n_docs)
        order = np.lexsort((-quotients, docs))
        first = np.cumsum(size) - size
        top = np.full(n_docs, -1, np.int64)
        peak = np.zeros(n_docs, np.int64)
        held = size > 0
        top[held], peak[held] = found[order[first[held]]], quotients[order[first[held]]]
        self.place = np.lexsort((peak, top))  # place -> document
        rank = np.empty(n_docs, np.int64)
        rank[self.place] = np.arange(n_docs)

        by_doc = np.lexsort((found, rank[docs]))
        self.doc_starts = np.append(0, np.cumsum(size[self.place]))
        self.doc_terms, self.doc_quotients = found[by_doc], quotients[by_doc].astype(np.int64)

        by_term = np.lexsort((rank[docs], found))
        self.n_docs = n_docs
        spots = rank[docs][by_term]
        self.spots = spots.astype(np.int32)
        self.names, self.starts, lengths = np.unique(found[by_term], return_index=True, return_counts=True)
        self.keys = np.repeat(np.arange(len(self.names)), lengths) * (n_docs + 1) + spots
        # Level l of the sparse table holds, for every posting, the largest of the 2^l from it on (in its list).
        ends = np.repeat(self.starts + lengths, lengths)
        level = quotients[by_term].astype(np.int32)
        levels = [level]
        at = np.arange(len(level))
        for l in range(int(lengths.max(initial=1)).bit_length() - 1):
            far = at + (1 << l)
            level = np.where(far < ends, np.maximum(level, level[np.minimum(far, len(level) - 1)]), level)
            levels.append(level)
        self.table = np.stack(levels)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest quotient of the postings low..high-1 (0 where there are none)."""
        span = high - low
        some = span > 0
        level = np.frexp(np.maximum(span, 1).astype(np.float64))[1] - 1
        a, b = np.where(some, low, 0), np.where(some, high - (1 << level), 0)
        return np.where(some, np.maximum(self.table[level, a], self.table[level, b]), 0).astype(np.int64)

    def ranges(self, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the terms ``own`` (rows) inside the document intervals (columns)."""
        base = own[:, None] * (self.n_docs + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def scores(self, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents inside the intervals, from their own term lists."""
        places = _spread(low, high)
        a, b = self.doc_starts[places], self.doc_starts[places + 1]
        at = _spread(a, b)
        parts = np.append(0, np.cumsum(weights[self.doc_terms[at]] * self.doc_quotients[at]))
        ends = np.cumsum(b - a)
        return places, parts[ends] - parts[ends - (b - a)]

    def search(self, item: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) above 0 that hold all of the k best and ties with the k-th.

        ``weights`` is by term, 0 outside the item; ``floor`` is a score that k documents elsewhere reach.
        """
        own = np.flatnonzero(np.isin(self.names, item))
        own = own[weights[self.names[own]] > 0]
        factors = weights[self.names[own]][:, None]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        needed = max(floor, 1)
        if not len(own):
            return places, scores
        low, high = np.zeros(1, np.int64), np.full(1, self.n_docs)
        bound = np.full(1, np.iinfo(np.int64).max)
        while len(low):
            best = np.argsort(-bound, kind="stable")
            now, later = best[:WIDE], best[WIDE:]
            a, b = low[now], high[now]
            low, high, bound = low[later], high[later], bound[later]
            short = b - a <= LEAF
            if short.any():
                new, marks = self.scores(weights, a[short], b[short])
                keep = marks >= needed
                places, scores = np.append(places, new[keep]), np.append(scores, marks[keep])
                if len(scores) > k:
                    needed = max(needed, int(np.partition(scores, -k)[-k]))
                    places, scores = places[scores >= needed], scores[scores >= needed]
                a, b = a[~short], b[~short]
            if len(a):
                first, last = self.ranges(own, a, b)
                cut = self._strongest(factors, first, last)
                a, b = np.concatenate([a, cut, cut + 1]), np.concatenate([cut, cut + 1, b])
                a, b = a[b > a], b[b > a]
                first, last = self.ranges(own, a, b)
                sums = (factors * self.largest(first, last)).sum(axis=0)
                low, high, bound = np.append(low, a), np.append(high, b), np.append(bound, sums)
            open_ = bound >= needed
            low, high, bound = low[open_], high[open_], bound[open_]
        return self.place[places], scores

    def _strongest(self, factors: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of the document with the largest single impact inside every interval."""
        peaks = factors * self.largest(first, last)
        row = peaks.argmax(axis=0)
        column = np.arange(first.shape[1])
        low, high = first[row, column], last[row, column]
        goal = peaks[row, column] // factors[row, 0]
        while (wide := high - low > 1).any():  # halve towards the half that holds the maximum
            middle = (low + high) // 2
            left = self.largest(low, middle) == goal
            low, high = np.where(wide & ~left, middle, low), np.where(wide & left, middle, high)
        return self.spots[low].astype(np.int64)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the intervals, one after the other."""
    size = high - low
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def _kept(ids: np.ndarray, absent: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, absent, -scores))[:k]


def _searched(items: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int):
    """The k best documents of every item in the documents of a task, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        dense = np.zeros(len(weights), np.int64)

        def index(parts: list) -> None:
            ids, absent, n, sizes, found, tfs = (np.concatenate(x) for x in zip(*parts))
            docs = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * n * n_docs) // length
            block = Index(docs, found.astype(np.int64), 1_000_000_000 * tfs // (1000 * tfs + 20 * m[docs]), len(ids))
            for i, item in enumerate(items):
                dense[item] = weights[item]
                old_ids, old_absent, old_scores = best[i]
                floor = int(old_scores[-1]) if len(old_scores) == k else 0
                rows, scores = block.search(item, dense, k, floor)
                dense[item] = 0
                if len(rows):
                    merged = np.append(old_ids, ids[rows]), np.append(old_absent, absent[rows]), np.append(old_scores, scores)
                    top = _kept(*merged, k)
                    best[i] = tuple(x[top] for x in merged)

        held: list = []
        postings = documents = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, n, found, tfs = (part.column(i) for i in range(4))
                held.append(
                    (
                        ids.fill_null(0).to_numpy(),
                        ids.is_null().to_numpy(zero_copy_only=False),
                        n.to_numpy(),
                        found.value_lengths().to_numpy(),
                        found.flatten().to_numpy(),
                        tfs.flatten().to_numpy(),
                    )
                )
                postings, documents = postings + len(held[-1][4]), documents + part.num_rows
                if postings >= BLOCK_POSTINGS or documents >= BLOCK_DOCS:
                    index(held)
                    held, postings, documents = [], 0, 0
        if held:
            index(held)
        for i, (ids, absent, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), i), pa.int64()), pa.array(ids, pa.int64(), mask=absent), pa.array(scores, pa.int64())],
                    names=["item", "doc_id", "score"],
                )

    return run


def _top(rows: DataFrame, group: tuple, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _chunks(items: DataFrame, chunk_terms: int) -> Iterator[list]:
    """The items' (item_id, term list), so many at a time that a chunk's terms stay few; one item is never split."""
    chunk, size = [], 0
    for row in items.toLocalIterator():
        own = sorted(set(terms((row["text"] or "").encode())))
        if chunk and size + len(own) > chunk_terms:
            yield chunk
            chunk, size = [], 0
        if own:
            chunk.append((row["item_id"], own))
            size += len(own)
    if chunk:
        yield chunk


def search(docs: DataFrame, items: DataFrame, k: int = 50, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """The k documents that score highest for each item: (item_id, rank, doc_id, score), scores above 0.

    A term is a run of ASCII letters and digits and of characters beyond ASCII, in whole texts, A-Z lower-cased. With N
    documents that hold a term, L terms in them and df documents holding a term, its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); an occurrence count tf in a document of n terms gives the impact
    weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L. Equal scores go by doc_id, NULL last.

    Every row of ``docs`` is a document, repeated ones and those without doc_id too; a NULL or empty text has no terms
    and counts nowhere. Rows of ``items`` are searched once if wholly repeated; rows of one item_id with different texts
    are items of their own, each ranked by itself. Items without terms have no rows. Other columns are ignored. Empty
    tables give no rows.

    Items of up to ``chunk_terms`` terms together are one pass over ``docs``; more items are more passes, so that what
    the driver and a task hold of them is bounded. A task indexes its documents in blocks and sends k rows an item.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    out = None
    for chunk in _chunks(items.select("item_id", "text").distinct().orderBy("item_id", "text"), chunk_terms):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, own in chunk for t in own))}
        counted = materialize(texts.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")
        n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # As many rows as the chunk has terms.
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for t, df in held:
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        vectors = [np.array([vocabulary[t] for t in own], np.int64) for _, own in chunk]
        found = counted.mapInArrow(_searched(vectors, weights, n_docs, length, k), "item long, doc_id long, score long")
        # Merged in two steps, so that an item's rows of all tasks do not meet in one.
        found = _top(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), ("item", "part"), k)
        found = _top(found.select("item", "doc_id", "score"), ("item",), k)
        named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(chunk)], f"item long, item_id {item_type}")
        found = found.join(named, "item").select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score long")
