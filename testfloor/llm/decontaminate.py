"""Benchmark decontamination by spaced seeds.

A mask picks some of the positions of a stretch of words. The hash of the picked
words is the same in two texts that differ at the other positions, so a seed hit
survives a substituted word. Hits of documents and benchmark items are joined by
hash; each gives a diagonal (place in the document minus place in the item).
Along a diagonal the best-scoring stretch (+1 for an equal word, -4 for another)
is the overlap: at least 4 of 5 of its words are equal. An overlap of
``min_words`` equal words (or of the whole item, if shorter) is a contamination.
The masks hit every such overlap (see ``covering_masks``), so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from testfloor.llm.words import blocks, find_words, lowered, mix, text_bytes
from testfloor.session import materialize

_U = np.uint64



def covering_masks(min_words: int, penalty: int) -> tuple[str, ...]:
    """Masks of which one hits every overlap that the criterion accepts.

    No beginning of a best stretch scores below 0. So it has at least ``penalty`` equal
    words before its first other word and twice as many before its second (if there
    is one); with one other word, the ``min_words`` are around it. Looking at
    w = min(``min_words``, 2 ``penalty``) words, with a gap at the first other word or
    none, hits them all. Items shorter than w must be there as a whole, which
    masks of their lengths find.
    """
    w = max(1, min(min_words, 2 * penalty))
    gapped = [f"{'1' * n}0{'1' * (w - n)}" for n in range(max(1, penalty), w)]
    return (*("1" * n for n in range(1, w + 1)), *gapped)


MASKS = covering_masks(min_words=10, penalty=4)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:48] = PUNCTUATION[58:65] = PUNCTUATION[91:97] = PUNCTUATION[123:128] = True

FILTER_BITS = 24  # the filter of benchmark seeds has 2 ** 24 bits, whatever the table's size
FILTER_SHIFTS = (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)  # of the parts of a hash that name its bits


def _seeds(masks: tuple[str, ...]):
    """Hashes of the words under each mask, at all places of an array of words."""
    runs = [[m.span() for m in re.finditer("1+", mask)] for mask in masks]
    longest = max(b - a for mask in runs for a, b in mask)

    def hashes(words: np.ndarray) -> Iterator[np.ndarray]:
        chains = [np.zeros(len(words) + 1, _U)]  # by length, of the words from a place on
        for k in range(min(longest, len(words))):
            n = len(words) - k
            chains.append(mix(chains[-1][:n] * _U(3) + words[k : k + n]))
        for i, (mask, spans) in enumerate(zip(masks, runs, strict=True)):
            n = max(0, len(words) - len(mask) + 1)
            value = np.full(n, i + 1, _U)
            if n:
                for a, b in spans:
                    value = mix(value * _U(3) + chains[b - a][a : a + n])
            yield value

    return hashes


def _whole(masks: tuple[str, ...]) -> list[bool]:
    """Whether a mask is for whole items of its length only, as it looks at fewer words than others."""
    weights = [m.count("1") for m in masks]
    return [n < max(weights) for n in weights]


def _rows(names: tuple[str, ...], masks: tuple[str, ...], bits: np.ndarray | None):
    """(id, words, hashes, places) of rows with words; if there is a filter, of the seeds in it and rows with some."""
    hashes, whole = _seeds(masks), _whole(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = text_bytes(batch.column(1))
            for a, b in blocks(edges):
                w = find_words(lowered(data), edges[a : b + 1], PUNCTUATION)
                all_words = w.hashes()
                row_of = np.repeat(np.arange(b - a), w.counts)
                found, places, rows = [], [], []
                for mask, short, h in zip(masks, whole, hashes(all_words), strict=True):
                    at = np.arange(len(h))
                    if bits is not None:
                        for shift in FILTER_SHIFTS:
                            slot = (h[at] >> _U(shift)).astype(np.int64) & ((1 << FILTER_BITS) - 1)
                            at = at[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    row = row_of[at]
                    inside = at + len(mask) <= w.first[row + 1]
                    if short and bits is None:
                        inside &= w.counts[row] == len(mask)
                    at, row = at[inside], row[inside]
                    if short and bits is not None:
                        # All copies of a whole item are alike, the first one counts.
                        _, first = np.unique(np.stack([row.astype(_U), h[at]]), axis=1, return_index=True)
                        at, row = at[first], row[first]
                    found.append(h[at])
                    places.append(at - w.first[row])
                    rows.append(row)
                row = np.concatenate(rows)
                order = np.argsort(row, kind="stable")
                ids, starts = np.unique(row[order], return_index=True)
                edge = np.append(starts, len(row)).astype(np.int32)
                listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(edge), pa.array(values[order], kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(a + ids, pa.int64())),
                        pa.array([all_words[w.first[r] : w.first[r + 1]].view(np.int64) for r in ids], pa.list_(pa.int64())),
                        listed(np.concatenate(found).view(np.int64), pa.int64()),
                        listed(np.concatenate(places).astype(np.int32), pa.int32()),
                    ],
                    names=list(names),
                )

    return run


def _best_stretch(penalty: int) -> Column:
    """The stretch of ``equal`` (booleans) with the highest score, as (score, from, to, same)."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "start", "same", "at", "best", "b_start", "b_end", "b_same")])

    def step(acc: Column, hit: Column) -> Column:
        reached = acc["score"] + F.when(hit, 1).otherwise(-penalty)
        score = F.greatest(reached, F.lit(0))
        # A beginning that scores 0 stays, so that a tie takes the smallest place.
        start = F.when(reached < 0, acc["at"] + 1).otherwise(acc["start"])
        same = F.when(reached < 0, 0).otherwise(acc["same"] + hit.cast("int"))
        better = score > acc["best"]
        return F.struct(
            score.alias("score"),
            start.alias("start"),
            same.alias("same"),
            (acc["at"] + 1).alias("at"),
            F.greatest(score, acc["best"]).alias("best"),
            F.when(better, start).otherwise(acc["b_start"]).alias("b_start"),
            F.when(better, acc["at"] + 1).otherwise(acc["b_end"]).alias("b_end"),
            F.when(better, same).otherwise(acc["b_same"]).alias("b_same"),
        )

    return F.aggregate("equal", zero, step)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = 10,
    masks: tuple[str, ...] | None = None,
    penalty: int = 4,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_span, n_equal): the best overlap of every contaminated pair.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased;
    places count from 0. Ties take the smallest place. NULL and empty texts and
    NULL ids have no overlap. Without ``masks``, those that miss no overlap are
    taken; masks that look at fewer words than others are for whole items of
    their length. Repeated rows of a doc_id count as one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    masks = masks or covering_masks(min_words, penalty)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    names = ("item_id", "item_words", "hashes", "places")
    schema = f"item_id {item_kind}, item_words array<long>, hashes array<long>, places array<int>"
    items = materialize(
        benchmark.select("item_id", "text").filter("item_id is not null").mapInArrow(_rows(names, masks, None), schema), "items"
    )
    seeds = items.select("item_id", F.explode(F.arrays_zip("hashes", "places")).alias("s"))
    seeds = seeds.select("item_id", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_at")).distinct()
    # The filter is 2 MB whatever the benchmark's size; a full one only passes more seeds on to the join.
    slot = [F.shiftrightunsigned("hash", n).bitwiseAND((1 << FILTER_BITS) - 1) for n in FILTER_SHIFTS]
    slots = seeds.select(F.explode(F.array(*slot)).alias("slot")).distinct()
    octets = slots.groupBy(F.shiftright("slot", 3).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(slot & 7 as int))")).alias("v")
    )
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in octets.toLocalIterator():
        bits[row["at"]] = row["v"]
    shared = spark.sparkContext.broadcast(bits)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    doc_names = ("doc_id", "words", "hashes", "places")
    doc_schema = f"doc_id {doc_kind}, words array<long>, hashes array<long>, places array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(doc_names, masks, shared.value)(batches)

    found = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(scan, doc_schema)
    found = materialize(found, "seeded")
    hits = found.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("s"))
    hits = hits.select("doc_id", F.col("s.hashes").alias("hash"), F.col("s.places").alias("at"))
    hits = hits.join(seeds, "hash").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    aligned = hits.join(items.select("item_id", "item_words"), "item_id").join(found.select("doc_id", "words"), "doc_id")
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    high = F.least(F.size("item_words"), F.size("words") - F.col("diagonal"))
    length = F.greatest(high - low, F.lit(0))
    own = F.slice("words", low + F.col("diagonal") + 1, length)
    theirs = F.slice("item_words", low + 1, length)
    aligned = aligned.select(
        "doc_id",
        "item_id",
        "diagonal",
        low.alias("low"),
        F.size("item_words").alias("n_item"),
        F.zip_with(own, theirs, lambda x, y: x == y).alias("equal"),
    ).withColumn("best", _best_stretch(penalty))
    judged = aligned.select(
        "doc_id",
        "item_id",
        (F.col("low") + F.col("best.b_start")).cast("long").alias("item_word"),
        (F.col("low") + F.col("diagonal") + F.col("best.b_start")).cast("long").alias("doc_word"),
        (F.col("best.b_end") - F.col("best.b_start")).cast("long").alias("n_span"),
        F.col("best.b_same").cast("long").alias("n_equal"),
        "n_item",
    ).filter(F.col("n_equal") >= F.least(F.lit(min_words), F.col("n_item")))
    best = F.min_by(
        F.struct("doc_word", "item_word", "n_span", "n_equal"), F.struct(-F.col("n_equal"), "doc_word", "item_word")
    )
    return judged.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
