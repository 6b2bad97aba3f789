"""Token counts of flat, unindexed token files by a separator scan.

A token file holds little-endian unsigned ids of 2 or 4 bytes only; an
end-of-document id closes every document. Files are read in blocks by independent tasks that look
for the end id with vectorised compares. What a block cannot know, how many ends
lie before it and where the last of them is, comes from a running sum and maximum
over the short table of block totals; it closes the documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from testfloor.llm.packing import encoder
from testfloor.session import materialize, scratch_path, write_bytes

ID_BYTES = 4  # 2 are enough for a vocabulary of up to 65,536 ids
BLOCK_IDS = 1 << 22
FILE_IDS = 1 << 24


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    known = "://" in uri or uri.startswith("file:")
    return fs.FileSystem.from_uri(uri if known else f"file://{uri}")


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS, id_bytes: int = ID_BYTES
) -> DataFrame:
    """Write the texts of ``docs`` as token files; (file, size, ordinal, doc_id) tells which document went where.

    A file is closed at ``file_ids`` ids. Files of lost or repeated tasks stay unlisted. A NULL text has no ids but the end.
    An id that does not fit ``id_bytes`` is an error.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        parts: list[np.ndarray] = []
        names: list = []

        def close():
            uri = f"{folder}/{uuid.uuid4().hex}.bin"
            ids = np.concatenate(parts)
            write_bytes(uri, ids.tobytes())
            n = len(names)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([uri] * n, pa.string()),
                    pa.array(np.full(n, len(ids), np.int64)),
                    pa.array(np.arange(n)),
                    pa.array(names, doc_type),
                ],
                names=["file", "size", "ordinal", "doc_id"],
            )
            parts.clear()
            names.clear()
            return out

        held = 0
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*made.ids(text.as_py() or ""), end_id], np.uint32)
                if int(ids.max()) >> (8 * id_bytes):
                    raise ValueError(f"id {ids.max()} needs more than {id_bytes} bytes")
                parts.append(ids.astype(f"<u{id_bytes}"))
                names.append(doc_id.as_py())
                held += len(ids)
                if held >= file_ids:
                    yield close()
                    held = 0
        if names:
            yield close()

    rows = docs.select("doc_id", "text").mapInArrow(run, f"file string, size long, ordinal long, doc_id {kind}")
    return materialize(rows, "token-manifest")


def _scan(end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, path = _open(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(n * id_bytes, start * id_bytes)
                ends = np.flatnonzero(np.frombuffer(data, f"<u{id_bytes}") == end_id) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "start", "n", "ends"],
                )

    return run


def counts(files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS, id_bytes: int = ID_BYTES) -> DataFrame:
    """(file, ordinal, first, n_tokens, closed) of every document in ``files`` (file, size in ids).

    ``first`` is the place of its first id, ``n_tokens`` counts its ids without the end id. Ids after a file's
    last end are a document with ``closed`` false. Repeated files count once; rows with NULLs and files without
    ids give no rows.
    """
    blocks = files.select("file", "size").distinct().filter("file is not null and size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_ids).cast("long"))
    blocks = blocks.select("file", "size", F.explode(starts).alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block_ids), F.col("size") - F.col("start")).alias("n"))
    blocks = blocks.repartition("file", "start")
    found = materialize(blocks.mapInArrow(_scan(end_id, id_bytes), "file string, start long, n long, ends array<long>"), "ends")
    # One row per block: a file of a terabyte has 65,536 of them.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.select("file", "start", "n", F.size("ends").cast("long").alias("k"), F.array_max("ends").alias("last"))
    totals = totals.select(
        "file",
        "start",
        F.coalesce(F.sum("k").over(before), F.lit(0).cast("long")).alias("done"),
        (F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")) + 1).alias("open"),
        F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull().alias("final"),
    )
    stitched = found.join(totals, ["file", "start"])
    bound = F.col("start") + F.col("n")
    last = F.coalesce(F.array_max("ends"), F.col("open") - 1)
    edge = F.when(F.col("final") & (last < bound - 1), F.array(bound)).otherwise(F.array().cast("array<long>"))
    stitched = stitched.withColumn("all", F.concat("ends", edge)).withColumn("firsts", F.concat(F.array("open"), F.transform("ends", lambda e: e + 1)))
    rows = stitched.select("file", "done", "firsts", "ends", F.posexplode("all").alias("i", "end"))
    first = F.col("firsts")[F.col("i")]
    return rows.select(
        "file",
        (F.col("done") + F.col("i")).alias("ordinal"),
        first.alias("first"),
        (F.col("end") - first).alias("n_tokens"),
        (F.col("i") < F.size("ends")).alias("closed"),
    )
