"""Packing token sequences by cutting-stock column generation.

A text is cut into full sequences and one rest. The histogram of rests by length
class (lengths rounded up to ``grain``) is a cutting-stock problem: a pattern says
how many rests of each class one sequence takes. A linear program over patterns
is solved by the simplex method; a knapsack dynamic program over its prices finds
the pattern that improves it most until none does. The patterns' numbers are
rounded down, what is left over is packed by patterns of the most demanding
rests first. Rests are ranked inside their class, and a rank decides which
sequence a rest goes to.

The driver sees the histogram only: one number per class, whatever the table's size.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from testfloor.llm.words import per_worker
from testfloor.session import materialize

RANK_ROWS = 50_000  # about so many pieces are ranked in one window


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1..len(prices) within ``capacity`` with the highest total price."""
    n = len(prices)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        value = best[c - m : c][::-1] + prices[:m]
        at = int(value.argmax())
        if value[at] > best[c - 1] + 1e-12:
            best[c], took[c] = value[at], at + 1
        else:
            best[c], took[c] = best[c - 1], 0
    pattern, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    # Written out: threaded linear algebra can stall beside the JVM of a Spark driver.
    return (matrix * vector).sum(axis=1)


def _invert(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots (at most 256 rows)."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(work[i:, i]).argmax())
        if j != i:
            work[[i, j]] = work[[j, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i][None, :]
    return work[:, n:]


def solve(demand: np.ndarray, capacity: int, max_steps: int = 8_000, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers that meet ``demand`` of sizes 1..n with least sequences.

    Prices divided by the best pattern's value bound the optimum from below; the search ends when the patterns are
    within ``gap`` of the bound, or when both round up to the same number of sequences.
    """
    wanted = np.flatnonzero(demand)
    m = len(wanted)
    d = demand[wanted].astype(float)
    sizes = wanted + 1
    patterns = np.zeros((m, m))
    np.fill_diagonal(patterns, capacity // sizes)  # row i: the pattern basic in row i
    inverse = np.diag(1.0 / (capacity // sizes))  # of the matrix whose columns are the basic patterns
    x = _times(inverse, d)
    prices = np.zeros(len(demand))
    for step in range(max_steps):
        if step % 200 == 199:
            inverse = _invert(patterns.T)
            x = np.maximum(_times(inverse, d), 0)
        prices[:] = 0
        prices[wanted] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = knapsack(prices, capacity)
        bound = float((prices[wanted] * d).sum()) / max(value, 1.0)
        if value <= 1 + 1e-7 or x.sum() <= bound * (1 + gap) or np.ceil(x.sum() - 0.01) <= np.ceil(bound - 0.01):
            break
        column = pattern[wanted].astype(float)
        direction = _times(inverse, column)
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / direction[able]
        out = int(ratio.argmin())
        patterns[out] = column
        moved = ratio[out]
        x = x - moved * direction
        x[out] = moved
        pivot = inverse[out] / direction[out]
        inverse -= direction[:, None] * pivot[None, :]
        inverse[out] = pivot
    x = _times(_invert(patterns.T), d)
    full = np.zeros((m, len(demand)), np.int64)
    full[:, wanted] = np.rint(patterns).astype(np.int64)
    return full, np.maximum(x, 0)


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that together place exactly ``demand`` pieces of sizes 1..n."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if not left.sum():
        return out
    for pattern, x in zip(*solve(left, capacity)):
        times = int(np.floor(x + 1e-6))
        if times and pattern.any():
            on = pattern > 0
            times = min(times, int((left[on] // pattern[on]).min()))
        if times > 0:
            left -= pattern * times
            out.append((pattern, times))
    # The rest is bounded by the number of classes, not by the data: largest first, then what fits best.
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        while room > 0:
            fit = np.flatnonzero(left[:room] > pattern[:room])
            if not len(fit):
                break
            size = int(fit[-1]) + 1
            take = min(room // size, int(left[size - 1] - pattern[size - 1]))
            pattern[size - 1] += take
            room -= take * size
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


# How a byte-level tokenizer cuts a text into words. On texts of these characters all versions of Unicode's tables
# agree on what is a letter, a digit and a space; other texts are left to the tokenizers library.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_TEXT = re.compile("[\t\n\r -~¡-¬®-ÿ]*")
_SPACES = re.compile("[\t\n\r ]++")
LONG_SPACE = 1 << 16  # longer runs of white space overflow the stack of tiktoken's pattern


def _ranks(form: dict) -> dict[bytes, int] | None:
    """The byte strings of a byte-level BPE vocabulary by id, None if the file has another kind or order of merging."""
    model, cut = form["model"], form["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    unset = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    special = all(t["special"] for t in form["added_tokens"])
    if not plain or form["normalizer"] or model["type"] != "BPE" or any(model.get(x) for x in unset) or not special:
        return None
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(ids[x + y] != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    # A byte that prints is written as itself, the others as the characters from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted({*range(256)} - {*shown})
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    left_out = {t["content"] for t in form["added_tokens"]}
    return {bytes(byte[c] for c in word): i for word, i in ids.items() if word not in left_out}


class Encoder:
    """Ids of whole texts by a file of the tokenizers library; texts never count as special tokens.

    For a byte-level file, plain texts get the same ids from the same merges by tiktoken, in a fifth of the time. Texts
    with a very long run of white space go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        self.made.encode_special_tokens = True
        ranks = _ranks(json.loads(self.made.to_str()))
        self.plain = ranks and tiktoken.Encoding(path, pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.plain and _PLAIN_TEXT.fullmatch(text) and not self._long_space(text):
            return self.plain.encode_ordinary(text)
        return self.made.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _long_space(text: str) -> bool:
        return len(text) > LONG_SPACE and any(x.end() - x.start() > LONG_SPACE for x in _SPACES.finditer(text))


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per Python worker."""
    return per_worker(f"tokenizer:{path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """Every text cut into pieces of at most ``capacity`` ids: all columns but ``text`` and of the names below, and
    start, length, ids_crc32, doc_tokens (and ids).

    ``end_id`` ends every text; a NULL text is an empty one. ``tokenizer`` is a file every worker can read.
    """
    added = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    if with_ids:
        added.append(("ids", pa.list_(pa.int32())))
    names = [n for n, _ in added] + ["text"]
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = docs.select(*kept).schema
    for name, kind in added:
        schema = schema.add(name, T.LongType() if kind == pa.int64() else T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows: list[int] = []
                values: dict[str, list] = {n: [] for n, _ in added}
                for r, value in enumerate(batch.column(len(kept))):
                    text = value.as_py() or ""
                    ids = np.array([*made.ids(text), end_id], np.uint32)
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        rows.append(r)
                        values["start"].append(start)
                        values["length"].append(len(part))
                        values["ids_crc32"].append(zlib.crc32(part.astype("<u4").tobytes()))
                        values["doc_tokens"].append(len(ids))
                        if with_ids:
                            values["ids"].append(part.astype(np.int32))
                index = pa.array(rows, pa.int64())
                columns = [batch.column(i).take(index) for i in range(len(kept))]
                columns += [pa.array(values[n], t) for n, t in added]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[n for n, _ in added]])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def _slots(spark: SparkSession, patterns: list[tuple[np.ndarray, int]]) -> DataFrame:
    """For every class the rank from which a pattern takes its pieces: at most classes x patterns rows."""
    rows, sequence = [], 0
    given: dict[int, int] = {}
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            c, per = int(i) + 1, int(pattern[i])
            first = given.get(c, 0)
            rows.append((c, first, first + per * times, per, sequence))
            given[c] = first + per * times
        sequence += times
    return spark.createDataFrame(rows, "class int, first long, last long, per int, base long")


def assign(cut: DataFrame, capacity: int = 2048, grain: int = 8, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``cut`` (with ``length`` from 1 to ``capacity``) with sequence_id, offset and seq_length.

    Columns of those names are replaced. Every row, repeated ones too, gets a place of its own; rows without a
    length are left out; an empty table gives an empty result. Offsets are gapless from 0.
    """
    spark = cut.sparkSession
    kept = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset", "seq_length")]
    units = capacity // grain
    # Written once, so that ranks do not depend on a recomputation.
    rows = cut.select(*kept).filter("length > 0")
    rows = rows.withColumn("__class", F.ceil(F.col("length") / grain).cast("int"))
    rows = materialize(rows.withColumn("__salt", F.xxhash64(*kept)), "pieces")
    counts = rows.groupBy("__class").count().collect()  # at most capacity / grain rows
    total = sum(r["count"] for r in counts)
    demand = np.zeros(units, np.int64)
    for r in counts:
        demand[r["__class"] - 1] = r["count"]
    patterns = plan(demand, units)
    # A class is ranked in salted parts, put one after the other by their counts.
    parts = max(1, -(-total // rank_rows))
    salted = rows.withColumn("__salt", F.pmod("__salt", F.lit(parts)))
    sizes = salted.groupBy("__class", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__class").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__class", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__class", "__salt").orderBy(F.xxhash64(*kept)))
    ranked = salted.withColumn("__rank", inside - 1).join(sizes, ["__class", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    slots = F.broadcast(_slots(spark, patterns))  # bounded by the classes
    on = (F.col("__class") == F.col("class")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("last"))
    placed = ranked.join(slots, on)
    placed = placed.withColumn("sequence_id", F.expr("base + (__rank - first) div per"))
    inner = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__rank")
    offset = F.coalesce(F.sum("length").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    return placed.select(*kept, "sequence_id", offset.cast("long").alias("offset"), used.cast("long").alias("seq_length"))
