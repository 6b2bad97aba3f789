"""MinHash near-duplicates with tensored banding.

``collections`` small collections of ``width`` minhashes are computed per
document. Every pair of collections forms the key of one table, so 14 collections
of 3 give 91 tables of 6 minhashes from 42 minhashes instead of 546. Two
documents of similarity s meet unless fewer than two of the collections agree:
with the defaults that is a chance of 7 in 10,000 at s = 0.8 and of 4 in 100,000 at 0.85.

A key can only be shared if both of its collections are, so collections whose
value no other document has are left out before pairs of them are formed.

Documents with equal shingle sets are one class with the smallest doc_id as its
representative, found by a pre-aggregated grouping; only representatives enter
the tables. Each member of a table's bucket is compared with the smallest member. Of these pairs those
go on whose sketches agree in ``agreeing`` of the minhashes (of 42, a pair of similarity 0.8 has fewer
than 23 with a chance of 1 in 10,000); they are confirmed on whole shingle sets.

Buckets whose other members are not in one component then are open. Members that meet in open
buckets, through others too, form families, and ``differences`` finds all links between the components of a family by an exact
prefix filter, without sketches: no link between components is lost, copies of
one text never expand into pairs, and members that just miss the similarity are not all compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from testfloor.llm.components import components
from testfloor.llm.differences import family_links
from testfloor.llm.words import blocks, chain, find_words, lowered, mix, text_bytes
from testfloor.session import materialize

_U = np.uint64


def shingle_sets(data: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of all rows, sorted; fewer words are one shingle."""
    w = find_words(lowered(data), edges)
    hashes, counts = w.hashes(), w.counts
    last = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), last)
    at = np.arange(len(row)) - np.repeat(np.cumsum(last) - last, last) + w.first[row]
    length = np.minimum(counts, k)[row]
    value = np.zeros(len(row), _U)
    for i in range(k):
        on = length > i
        value[on] = chain(value[on] + _U(i), hashes[at[on] + i])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = text_bytes(batch.column(1))
            for a, b in blocks(edges):
                row, value = shingle_sets(data, edges[a : b + 1], k)
                shingles = _lists(value.view(np.int64), np.bincount(row, minlength=b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), shingles], names=["doc_id", "shingles"])

    return run


def _sketch(k: int, collections: int, width: int):
    seeds = mix(np.arange(1, collections * width + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = text_bytes(batch.column(1))
            for a, b in blocks(edges):
                row, value = shingle_sets(data, edges[a : b + 1], k)
                sizes = np.bincount(row, minlength=b - a)
                filled = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[filled]
                part = np.zeros((collections, b - a), _U)
                marks = np.zeros((2, b - a), _U)
                sketch = np.zeros((b - a, collections * width), np.uint8)
                if len(filled):
                    with np.errstate(over="ignore"):
                        for c in range(collections):
                            for j in range(width):
                                low = np.minimum.reduceat(mix(value ^ seeds[c * width + j]), first)
                                part[c, filled] = chain(part[c, filled] + _U(c), low)
                                sketch[filled, c * width + j] = (low >> _U(7)).astype(np.uint8)
                        for i in range(2):
                            marks[i, filled] = np.add.reduceat(mix(value + _U(77 + i)), first)
                keys = np.ascontiguousarray(part.T[filled]).view(np.int64).ravel()
                per_row = np.where(sizes > 0, collections, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(marks[0].view(np.int64)),
                        pa.array(marks[1].view(np.int64)),
                        _lists(keys, per_row),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "mark1", "mark2", "parts", "sketch"],
                )

    return run


_PLACES = 1 << 20
_SCHEMA = "doc_id {}, n_shingles long, mark1 long, mark2 long, parts array<long>, sketch binary"


def _keys(reps: DataFrame) -> DataFrame:
    """(key, doc_id): the table keys of every representative, one for every pair of its shared collections."""
    single = reps.select("doc_id", F.posexplode("parts").alias("i", "part"))
    shared = single.groupBy("part").agg(F.count("*").alias("size")).filter("size > 1").select("part")
    shared = materialize(shared, "shared-collections")
    lists = single.join(shared, "part").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("i", "part"))).alias("p"))
    # A collection's place is part of its hash, so a pair of them names its table.
    pairs = F.flatten(F.transform("p", lambda x, at: F.transform(F.slice("p", at + 2, F.size("p")), lambda y: F.xxhash64(x.part, y.part))))
    return lists.filter(F.size("p") > 1).select("doc_id", F.explode(pairs).alias("key"))


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int, agreeing: int) -> DataFrame:
    """The pairs (a, b) whose set sizes and sketches allow the similarity."""
    x = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("an"), F.col("sketch").alias("x"))
    y = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("bn"), F.col("sketch").alias("y"))
    schema = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in (2, 3)]
            same = (sides[0] == sides[1]).reshape(batch.num_rows, -1).sum(axis=1) >= agreeing if batch.num_rows else []
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    fits = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    return pairs.join(x, "a").join(y, "b").filter(fits).select("a", "b", "x", "y").mapInArrow(run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted``, made from their texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most _PLACES places of ids are broadcast; they keep most other texts out of the shuffle of the exact join.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    places = F.broadcast(wanted.select(place.alias("place")).distinct())
    texts = docs.select("doc_id", "text", place.alias("place")).join(places, "place", "left_semi").drop("place")
    texts = texts.join(wanted, "doc_id", "left_semi")
    return texts.mapInArrow(_sets(k), f"doc_id {kind}, shingles array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, agreeing: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets, made anew from the texts of these documents only, reach the similarity."""
    pairs = materialize(_agreeing(pairs, reps, percent, agreeing), "candidates")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _sets_of(docs, wanted, k)
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return joined.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _families(open_: DataFrame) -> DataFrame:
    """(family, doc_id, component): the members of open buckets; those of one bucket are in one family."""
    first = open_.groupBy("key").agg(F.min("doc_id").alias("a"))
    meetings = open_.join(first, "key").filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    families = components(meetings).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    return families.join(open_.select("doc_id", "component").distinct(), "doc_id").select("family", "doc_id", "component")


def groups(
    docs: DataFrame, k: int = 5, percent: int = 80, collections: int = 14, width: int = 3, agreeing: int = 23
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A text without words or NULL has no shingles and is linked with nothing. Rows
    with a NULL doc_id are linked with nothing and kept. Repeated rows stay
    repeated and are in one group. Texts of any length are judged whole, by one task
    each. Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = docs.select("doc_id", "text").mapInArrow(_sketch(k, collections, width), _SCHEMA.format(kind))
    sketched = materialize(sketched, "sketches")
    filled = sketched.filter("n_shingles > 0 and doc_id is not null")
    mark = ["n_shingles", "mark1", "mark2"]
    classes = materialize(filled.groupBy(*mark).agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id"), *mark), ["doc_id", *mark], "left_semi")
    reps = materialize(reps.dropDuplicates(["doc_id", *mark]), "representatives")
    entries = materialize(_keys(reps), "keys")
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z")
    shared = materialize(shared.select("key", "a"), "shared-keys")
    members = materialize(entries.join(shared, "key"), "buckets")
    stars = members.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    links = materialize(_confirm(stars, docs, reps, k, percent, agreeing), "star-links")
    found = components(links)
    named = members.filter("a <> doc_id").select("key", "doc_id").join(
        found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("key").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed")
    open_ = materialize(named.join(mixed.select("key"), "key", "left_semi"), "open-buckets")
    if not open_.isEmpty():
        families = materialize(_families(open_), "families")
        sets = _sets_of(docs, families.select("doc_id"), k).filter("size(shingles) > 0").withColumnRenamed("shingles", "elements")
        found = components(links.union(family_links(families.join(sets, "doc_id"), percent)))
    final = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        *mark, F.coalesce("component", "rep").alias("component_id")
    )
    rows = sketched.select("doc_id", *mark).join(final, mark, "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
