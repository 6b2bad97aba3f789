"""Repeated passages by seed and extend.

Seeds are winnowed: of every ``window`` - ``seed`` + 1 consecutive runs of
``seed`` words the one with the smallest hash is the anchor of the window they
fill, so equal windows have equal anchors, and every window has one. The windows
of one anchor start next to each other; the words they cover are its stretch.

Documents are joined on anchors, and a shared anchor is extended both ways. First
by its whole stretch: occurrences with equal stretches are one class, whose
smallest document keeps the words and all others lose them, one row each. Only
the smallest documents of an anchor with several stretches are extended window by
window, to find where their stretches part. Matching windows that touch are one
maximal repeat. Nothing is paired: a passage shared by many documents costs a row
per occurrence.

Documents with the same words are one class. All windows of a class's other
members start in its smallest document, so only that one is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from testfloor.llm.words import blocks, chain, find_words, mix, rolling, text_bytes
from testfloor.session import materialize

_U = np.uint64
_PLACES = 1 << 20


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest (first among equals) of every ``width`` consecutive hashes."""
    best, size = np.arange(len(hashes)), 1
    while size < width and len(best):
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        best, size = np.where(hashes[right] < hashes[left], right, left), size + step
    return best


def _each(batches: Iterator[pa.RecordBatch]):
    """(rows of a block, Words, hashes of its words) of every block of texts."""
    for batch in batches:
        data, edges = text_bytes(batch.column(1))
        for a, b in blocks(edges):
            w = find_words(data, edges[a : b + 1])
            yield batch.slice(a, b - a), w, w.hashes()


def _mark(hashes: np.ndarray, w, salt: int) -> np.ndarray:
    """A hash of the words of every row and their places."""
    at = np.arange(len(hashes)) - np.repeat(w.first[:-1], w.counts)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(chain(hashes ^ mix(_U([salt])), at.astype(_U)), dtype=_U)])
    return (total[w.first[1:]] - total[w.first[:-1]]).view(np.int64)


def _anchors(window: int, seed: int):
    """Of every row: its number of words, its marks, and hash, stretch, first window and number of windows of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, hashes in _each(batches):
            grams, whole = rolling(hashes, seed), rolling(hashes, window)
            starts = np.arange(len(whole))
            row = np.searchsorted(w.first, starts, "right") - 1
            starts = starts[starts + window <= w.first[row + 1]]
            owner = winnow(grams, window - seed + 1)[starts]
            edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(1, np.int64)
            first, last = starts[edge[:-1]], starts[edge[1:] - 1]
            row = np.searchsorted(w.first, first, "right") - 1
            stretch = chain(whole[first], whole[last])
            fields = [
                pa.array(grams[owner[edge[:-1]]].view(np.int64)),
                pa.array(stretch.view(np.int64)),
                pa.array((first - w.first[row]).astype(np.int32)),
                pa.array((last - first + 1).astype(np.int32)),
            ]
            found = pa.StructArray.from_arrays(fields, names=["hash", "stretch", "start", "size"])
            sizes = np.bincount(row, minlength=rows.num_rows)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(w.counts, pa.int64()),
                    pa.array(_mark(hashes, w, 1)),
                    pa.array(_mark(hashes, w, 2)),
                    pa.ListArray.from_arrays(pa.array(offsets), found),
                ],
                names=["doc_id", "n_words", "mark1", "mark2", "anchors"],
            )

    return run


def _windows(window: int):
    """(doc_id, hash, value, start) of all windows of the anchors (hash, start, size) in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, hashes in _each(batches):
            whole, lists = rolling(hashes, window), rows.column(2)
            anchors, row = lists.flatten(), np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
            key, start, size = (np.asarray(anchors.field(name)) for name in ("hash", "start", "size"))
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            row = np.repeat(row, size)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row)),
                    pa.array(np.repeat(key, size)),
                    pa.array(whole[at + w.first[row]].view(np.int64)),
                    pa.array(at.astype(np.int32)),
                ],
                names=["doc_id", "hash", "value", "start"],
            )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, _ in _each(batches):
            data, lists = w.data.tobytes(), rows.column(2)
            removed, digests, repeats, texts = [], [], [], []
            for r in range(rows.num_rows):
                span = slice(w.first[r], w.first[r + 1])
                n = span.stop - span.start
                gone = np.zeros(n + 1, np.int64)
                if lists[r].is_valid:
                    start, size = (np.asarray(lists[r].values.field(name), np.int64) for name in ("start", "size"))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + size + window - 1, -1)
                drop = np.cumsum(gone)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                kept = b" ".join(
                    data[s:e] for s, e in zip(w.starts[span][~drop].tolist(), w.ends[span][~drop].tolist())
                )
                removed.append(int(drop.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                repeats.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                texts.append(kept.decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(w.counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(repeats, kind),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"],
            )

    return run


def _with(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id is in ``ids`` and some others (left_semi), or all the rest (left_anti).

    At most _PLACES places of ids are broadcast; they keep most other texts out of the shuffle of an exact join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    places = F.broadcast(ids.select(place.alias("place")).distinct())
    return rows.withColumn("place", place).join(places, "place", how).drop("place")


def remove(docs: DataFrame, window: int = 50, seed: int = 25) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (start and stop words), kept_text of every row of (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    NULL and empty texts have no words. Rows with the same doc_id must be repeats of one row; they never remove
    from each other. Rows with a NULL doc_id neither lose words nor remove any. Texts of any length are judged
    whole, by one task each. Other columns are ignored; an empty table gives an empty result.
    Words are compared by 64-bit hashes of the anchor and of the window, both not linear.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    schema = "array<struct<hash:long,stretch:long,start:int,size:int>>"
    schema = f"doc_id {kind}, n_words long, mark1 long, mark2 long, anchors {schema}"
    marks = ["n_words", "mark1", "mark2"]
    found = materialize(rows.filter("doc_id is not null").mapInArrow(_anchors(window, seed), schema), "anchors")
    long = found.filter(F.col("n_words") >= window)
    classes = materialize(long.groupBy(*marks).agg(F.min("doc_id").alias("rep")), "classes")
    reps = long.select("doc_id", "anchors").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    seeds = materialize(reps.select("doc_id", F.inline("anchors")), "seeds")
    shared = seeds.groupBy("hash").agg((F.min("doc_id") < F.max("doc_id")).alias("many")).filter("many").select("hash")
    # Written tables on the small side: Spark then splits the partition of a passage that very many documents share.
    matched = materialize(seeds.join(materialize(shared, "shared-seeds"), "hash"), "matched")
    stretch = ["hash", "stretch", "size"]
    lowest = materialize(matched.groupBy(*stretch).agg(F.min("doc_id").alias("low")), "stretches")
    owned = materialize(matched.join(lowest, stretch), "extended")
    whole = owned.filter("doc_id > low").select("doc_id", "start", "size")
    parting = lowest.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    parting = owned.filter("doc_id = low").join(materialize(parting, "parting"), "hash", "left_semi")
    lists = parting.groupBy("doc_id").agg(F.collect_set(F.struct("hash", "start", "size")).alias("anchors"))
    lists = materialize(lists, "parting-anchors")
    texts = _with(rows, lists, "left_semi").join(lists, "doc_id").select("doc_id", "text", "anchors")
    windows = materialize(texts.mapInArrow(_windows(window), f"doc_id {kind}, hash long, value long, start int"), "windows")
    low = windows.groupBy("hash", "value").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    low = materialize(low.filter("low < high").select("hash", "value", "low"), "lowest")
    single = windows.join(low, ["hash", "value"]).filter("doc_id > low").select("doc_id", "start", F.lit(1).alias("size"))
    copies = long.select("doc_id", *marks).join(classes, marks).filter("doc_id > rep")
    copies = copies.select("doc_id", F.lit(0).alias("start"), (F.col("n_words") - window + 1).cast("int").alias("size"))
    runs = whole.union(single).union(copies).groupBy("doc_id")
    runs = materialize(runs.agg(F.collect_set(F.struct("start", "size")).alias("runs")), "repeats")
    hit = _with(rows, runs, "left_semi").join(runs, "doc_id", "left").select("doc_id", "text", "runs")
    rest = _with(rows, runs, "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,stop:long>>, kept_text string"
    return hit.union(rest).mapInArrow(_cut(window), out)
