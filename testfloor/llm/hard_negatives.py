"""Hard negatives by Fagin's threshold algorithm.

Candidates are dealt by a hash into blocks of bounded size. In a block every
dimension is a list of the candidates sorted by their component. For an anchor the
lists are read from the end that its sign makes the better one; every row that
comes up is scored at once from its whole vector (random access). The components
reached so far bound what an unseen row can score, and the search ends when that
threshold is strictly below the score that an unseen row would have to reach in
every open window. The best rows of the blocks are then merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from testfloor.session import materialize

BLOCK_ROWS = 4096
CHUNK_ANCHORS = 2048
SCALE = 256


class Lists:
    """Per-dimension sorted lists over some rows of a block."""

    def __init__(self, values: np.ndarray, order: np.ndarray):
        self.values, self.order = values, order  # rows x dims; dims x places, ascending

    def of(self, chosen: np.ndarray) -> Lists:
        """The lists of the rows where ``chosen`` holds."""
        keep = chosen[self.order]
        return Lists(self.values, self.order[keep].reshape(len(self.order), -1))

    def search(self, anchor: np.ndarray, required: Callable[[np.ndarray], float]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) seen until the threshold is strictly below ``required(scores)``."""
        n = self.order.shape[1]
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if n == 0 or len(up) + len(down) == 0:  # no list ranks anything: all rows score 0
            rows = self.order[0] if len(self.order) else np.zeros(0, np.int64)
            return rows, np.zeros(len(rows), self.values.dtype)
        seen = np.zeros(len(self.values), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.values.dtype)
        depth, step = 0, max(1, n // 32)
        while depth < n:
            until = min(n, depth + step)
            fresh = np.zeros_like(seen)
            fresh[self.order[up, n - until : n - depth]] = True
            fresh[self.order[down, depth:until]] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            rows, scores = np.append(rows, new), np.append(scores, self.values[new] @ anchor)
            depth, step = until, 2 * step
            if len(rows) == n:
                break
            reached = anchor[up] @ self.values[self.order[up, n - depth], up] + anchor[down] @ self.values[self.order[down, depth - 1], down]
            if reached < required(scores):
                break
        return rows, scores


def _kth(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf


def _exact(vectors: list, dims: int) -> np.ndarray:
    """Vectors filled up with zeros, as 64-bit integers."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _typed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest type in which every inner product of the two is exact."""
    most = [max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0 for x in (a, b)]
    bound = a.shape[1] * most[0] * most[1]
    if bound >= 1 << 63:
        raise ValueError("an inner product may not fit 64 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind), b.astype(kind)


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    return _exact([x.values.to_numpy(zero_copy_only=False) for x in table.column("q").combine_chunks()], dims)


def _block(left: pa.Table, right: pa.Table, dims: int) -> Iterator[tuple]:
    """For every anchor of ``right``: its table row, vector, label mask over the block and the block's lists."""
    values, anchors = _typed(_vectors(left, dims), _vectors(right, dims))
    labels = np.array(left.column("label").to_pylist(), object)
    lists = Lists(values, np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T))
    wanted = np.array(right.column("label").to_pylist(), object)
    ids, tags = (np.array(left.column(c).to_pylist(), np.int64) for c in ("vec_id", "tag"))
    for label in dict.fromkeys(wanted):
        yield lists, ids, tags, labels == label, anchors, np.flatnonzero(wanted == label)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, tags: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, smallest id."""
    if len(rows) > k:
        near = np.flatnonzero(scores >= _kth(scores, k))
    else:
        near = np.arange(len(rows))
    return near[np.lexsort((tags[rows[near]], ids[rows[near]], -scores[near]))][:k]


_POSITIVES = pa.schema([(c, pa.int64()) for c in ("anchor_id", "anchor_tag", "row_id", "row_tag", "score")])
_NEGATIVES = pa.schema([(c, pa.int64()) for c in ("anchor_id", "anchor_tag", "place", "row_id", "row_tag", "score")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{name} long" for name in schema.names)


def _positives(dims: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            own_ids, own_tags = right.column("vec_id").to_pylist(), right.column("tag").to_pylist()
            for lists, ids, tags, same, anchors, places in _block(left, right, dims):
                near = lists.of(same)
                for i in places:
                    rows, scores = near.search(anchors[i], lambda s: _kth(s, k + 1))  # one more: the anchor may be among them
                    other = (ids[rows] != own_ids[i]) | (tags[rows] != own_tags[i])
                    rows, scores = rows[other], scores[other]
                    for j in _best(rows, scores, ids, tags, k):
                        out.append((own_ids[i], own_tags[i], ids[rows[j]], tags[rows[j]], int(scores[j])))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] or [[]] * len(_POSITIVES), schema=_POSITIVES)

    return run


def _negatives(dims: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            own_ids, own_tags = right.column("vec_id").to_pylist(), right.column("tag").to_pylist()
            spans = right.column("windows").to_pylist()
            for lists, ids, tags, same, anchors, places in _block(left, right, dims):
                far = lists.of(~same)
                for i in places:
                    windows = [(w["place"], w["low"], w["high"]) for w in spans[i] if w["low"] <= w["high"]]
                    if not windows:
                        continue

                    def required(scores, windows=windows):
                        """The least score by which an unseen row could still enter a window."""
                        least = np.inf
                        for _, low, high in windows:
                            least = min(least, max(low, _kth(scores[(scores >= low) & (scores <= high)], k)))
                        return least

                    rows, scores = far.search(anchors[i], required)
                    for place, low, high in windows:
                        inside = (scores >= low) & (scores <= high)
                        kept, marks = rows[inside], scores[inside]
                        for j in _best(kept, marks, ids, tags, k):
                            out.append((own_ids[i], own_tags[i], place, ids[kept[j]], tags[kept[j]], int(marks[j])))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] or [[]] * len(_NEGATIVES), schema=_NEGATIVES)

    return run


def _first(rows: DataFrame, group: tuple[str, ...], k: int) -> DataFrame:
    """The k best rows of a group, with their ``place`` from 1 as column ``n``."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "row_id", "row_tag")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def quantize(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    block_rows: int = BLOCK_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """Negatives of other labels for each anchor and each of its best rows of the same label.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is evaluated on it. A negative's score lies between
    ``low_percent`` and ``high_percent`` of the positive's, both included, so a positive with a score below 0 has none.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a NULL vec_id, label or vector, or a NULL, NaN or infinite component take no part. Shorter vectors are
    filled up with zeros; an empty vector scores 0 with all. Whole repeated rows count once; rows of one vec_id with
    different vectors or labels are different rows, each of which can be an anchor, a positive and a negative. Equal
    scores go by vec_id. Other columns are ignored, empty tables give no rows. An inner product that may not fit 64
    bits is a ValueError.

    Every block meets every anchor, ``chunk_anchors`` at a time: a task holds ``block_rows`` candidates and one chunk,
    whatever the sizes of the table and of a label.
    """
    x = F.col("embedding")
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~wrong)
    kept = kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        quantize(x).alias("q"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    kept = materialize(kept.distinct().withColumn("tag", F.xxhash64("label", "q")), "vectors")
    total = kept.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims"), F.count_if("is_anchor").alias("anchors")).first()
    blocks, chunks = max(1, -(-total["n"] // block_rows)), max(1, -(-total["anchors"] // chunk_anchors))

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", "tag", F.lit(seed)), F.lit(n)).cast("int")
    named = ("vec_id", "tag", "label", "q")
    candidates = kept.select(*[F.col(c).alias(c) for c in named], part(blocks, 1).alias("block"), numbers(chunks).alias("chunk"))

    def search(anchors: DataFrame, run, schema: pa.Schema) -> DataFrame:
        dealt = anchors.select("*", part(chunks, 2).alias("chunk")).select("*", numbers(blocks).alias("block"))
        sides = candidates.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk"))
        return sides.applyInArrow(run, _ddl(schema))

    anchors = kept.filter("is_anchor").select(*named)
    found = search(anchors, _positives(total["dims"], positives), _POSITIVES)
    found = materialize(_first(found, ("anchor_id", "anchor_tag"), positives), "positives")

    # 100 * score between the two percentages, in exact integers: rounded up and rounded down.
    window = F.struct(
        F.col("n").cast("long").alias("place"),
        F.expr(f"cast(-floor(cast(-score as decimal(20,0)) * {low_percent} / 100) as long)").alias("low"),
        F.expr(f"cast(floor(cast(score as decimal(20,0)) * {high_percent} / 100) as long)").alias("high"),
    )
    windows = found.groupBy("anchor_id", "anchor_tag").agg(F.collect_list(window).alias("windows"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag"), "windows")
    mined = search(anchors.join(windows, ["vec_id", "tag"]), _negatives(total["dims"], negatives), _NEGATIVES)
    mined = _first(mined, ("anchor_id", "anchor_tag", "place"), negatives)
    mined = mined.select("anchor_id", "anchor_tag", "place", F.col("n").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select(
        "anchor_id", "anchor_tag", F.col("n").cast("long").alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return mined.join(pairs, ["anchor_id", "anchor_tag", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
