"""Finding the records of logs of any size.

A log is a chain of records, each of which begins where the one before ends, so a
place in the middle of a file tells nothing by itself. A file is cut into blocks
nevertheless, and every block is summed up as a map: for each offset at which the
chain may enter it, the offset at which it leaves for the next block and the number
of records it passes. Maps compose, so a prefix scan over the blocks, in groups of
bounded size, gives the true entry and the first record number of every block. After
that the blocks are framed independently, each by one read of its byte range.

Before that one pass over each file hashes it in steps and inflates compressed ones
into plain files in the shared folder. What it finds is a short table, on which
copies are dropped before anything is framed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from testfloor.session import location, materialize, scratch_path, shuffled

STEP = 1 << 20
BLOCK = 8 << 20
GROUP = 64  # maps composed by one task
TASK_BYTES = 64 << 20
# Fixed value: the largest record is its header of 4 bytes and a body of 65,535.
REACH = 65_539
FEW = 24  # so few chains are followed one by one

FILES = "source_id string, path string, plain string, size long, file_sha256 string, content_sha256 string, big_endian boolean, stopped string"


# --- files --------------------------------------------------------------------------

def byte_order(data: bytes) -> bool | None:
    """True for big-endian, False for little-endian, None where no file header is found."""
    if data[2:4] == b"\x00\x0a" and len(data) >= 6:
        if data[:2] == b"\x02\x00" and data[4] == 2:
            return False
        if data[:2] == b"\x00\x02" and data[4] == 1:
            return True
    return None


def inflated(steps: Iterator[bytes], problems: list[str]) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members, as far as it goes, in pieces of at most STEP bytes."""
    member = zlib.decompressobj(31)
    begun = False
    try:
        for step in steps:
            while step:
                begun = True
                if piece := member.decompress(step, STEP):
                    yield piece
                step = member.unused_data if member.eof else member.unconsumed_tail
                if member.eof:
                    member, begun = zlib.decompressobj(31), False
        while begun and (piece := member.decompress(member.unconsumed_tail, STEP)):
            yield piece
        if begun and not member.eof:
            problems.append("truncated gzip stream")
    except zlib.error as error:
        problems.append(f"gzip: {error}")


def _prepare(path: str, folder: str) -> tuple:
    raw, content, problems = hashlib.sha256(), hashlib.sha256(), []
    head, size, plain, sink = b"", 0, path, None
    system, name = location(path)

    def steps(first: bytes, source) -> Iterator[bytes]:
        step = first
        while step:
            raw.update(step)
            yield step
            step = source.read(STEP)

    with system.open_input_stream(name, compression=None) as source:
        first = source.read(STEP)
        pieces = steps(first, source)
        if first[:2] == b"\x1f\x8b":
            plain = f"{folder}/{uuid.uuid4().hex}.plain"
            target, inner = location(plain)
            target.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            sink, pieces = target.open_output_stream(inner, compression=None), inflated(pieces, problems)
        for piece in pieces:
            content.update(piece)
            head, size = head if len(head) >= 6 else (head + piece)[:6], size + len(piece)
            if sink:
                sink.write(piece)
        for step in steps(source.read(STEP), source) if problems else ():
            pass  # the hash of the file covers what could not be inflated
    if sink:
        sink.close()
    source_id = hashlib.sha256(path.encode()).hexdigest()
    return source_id, path, plain, size, raw.hexdigest(), content.hexdigest(), byte_order(head), problems[0] if problems else None


def tasks(df: DataFrame, amount: int, of: int) -> int:
    """As many tasks as ``amount`` is worth, and no fewer than there are cores."""
    return min(100_000, max(1, -(-amount // of), df.sparkSession.sparkContext.defaultParallelism))


def _reading_tasks(listed: DataFrame) -> int:
    """Tasks that read whole files: by their bytes where these are known, as a hand-over to Python costs as much as hundreds
    of short files; else 16 files each."""
    known = "length" in listed.columns
    found = listed.agg(F.count("*").alias("n"), (F.sum("length") if known else F.lit(None).cast("long")).alias("bytes")).first()
    if found["bytes"] is None:
        return tasks(listed, found["n"], 16)
    return max(tasks(listed, found["n"], 256), tasks(listed, found["bytes"], TASK_BYTES))


def _listed(files: DataFrame) -> DataFrame:
    """The paths of ``files``, each once, with their lengths where these are known."""
    return files.select("path", *(["length"] if "length" in files.columns else [])).filter("path is not null").dropDuplicates(["path"])


def prepare(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (column path): its plain bytes, size, hashes, byte order and what stopped inflating.

    A file is read once, in order and in steps; its size does not matter. Repeated paths count once, a NULL path not at
    all. A file that cannot be opened is an error.
    """
    folder = scratch_path(files.sparkSession, "plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_prepare(path, folder) for path in batch.column(0).to_pylist()]
            kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.bool_(), pa.string()]
            names = [x.split()[0] for x in FILES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    listed = _listed(files)
    return materialize(listed.repartition(_reading_tasks(listed)).select("path").mapInArrow(run, FILES), "files")


def hashes(files: DataFrame) -> DataFrame:
    """(path, file_sha256, length) of the files of ``files``, read in steps; nothing is inflated or kept of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found, lengths = batch.column(0).to_pylist(), [], []
            for path in paths:
                system, name = location(path)
                digest, length = hashlib.sha256(), 0
                with system.open_input_stream(name, compression=None) as source:
                    while step := source.read(STEP):
                        digest.update(step)
                        length += len(step)
                found.append(digest.hexdigest())
                lengths.append(length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(found, pa.string()), pa.array(lengths, pa.int64())], names=["path", "file_sha256", "length"]
            )

    listed = _listed(files)
    dealt = listed.repartition(_reading_tasks(listed)).select("path")
    return materialize(dealt.mapInArrow(run, "path string, file_sha256 string, length long"), "hashes")


def unique_files(prepared: DataFrame) -> DataFrame:
    """Of the files with equal content only the one with the first path."""
    first = prepared.groupBy("content_sha256").agg(F.min("path").alias("path"))
    return prepared.join(first.select("path"), "path", "left_semi").select(*prepared.columns)


# --- maps ---------------------------------------------------------------------------

class Ranges:
    """Byte ranges of files; the last file stays open."""

    def __init__(self) -> None:
        self.uri, self.source = None, None

    def read(self, uri: str, start: int, stop: int) -> bytes:
        if uri != self.uri:
            system, name = location(uri)
            self.uri, self.source = uri, system.open_input_file(name)
        data = self.source.read_at(stop - start, start)
        if len(data) != stop - start:
            raise EOFError(f"{uri} is shorter than it was")
        return data


def chain(data: bytes, position: int, stop: int, limit: int, big: bool, most: int = 1 << 62) -> tuple[list[int], str | None]:
    """Edges of the records that begin at ``position`` and before ``stop``, and why the chain cannot go on.

    ``limit`` is the end of the file. At most ``most`` records are followed.
    """
    high, low = (0, 1) if big else (1, 0)
    edges = [position]
    while position < stop and len(edges) <= most:
        if position + 4 > limit:
            return edges, "trailing bytes that form no header"
        position += 4 + (data[position + high] << 8) + data[position + low]
        if position > limit:
            return edges, "unexpected end of file in record body"
        edges.append(position)
    return edges, None


def _window(raw: np.ndarray, start: int, stop: int, limit: int, big: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every place of a window where its chain leaves the window (-1: it cannot go on), and the records passed.

    Pointer doubling: each round doubles the number of records that a place jumps over.
    """
    at = np.arange(start, stop)
    headed = at + 4 <= limit
    first, second = raw[np.minimum(at, limit - 1)].astype(np.int64), raw[np.minimum(at + 1, limit - 1)].astype(np.int64)
    to = at + 4 + ((first << 8) + second if big else (second << 8) + first)
    to = np.where(headed & (to <= limit), to, -1)
    passed = (to >= 0).astype(np.int64)
    while len(inside := np.flatnonzero((to >= 0) & (to < stop))):
        via = to[inside] - start
        passed[inside] += passed[via]
        to[inside] = to[via]
    return to, passed


def transition(data: bytes, size: int, limit: int, big: bool) -> tuple[np.ndarray, np.ndarray]:
    """The map of a block: exit and number of records for every entry offset 0 .. REACH - 1.

    ``data`` begins with the block's ``size`` bytes; ``limit`` is the end of the file as an offset in it. Exits count from
    the end of the block; -1 means that the chain cannot go on. Entries beyond the block leave it untouched.
    """
    raw = np.frombuffer(data, np.uint8)
    limit = min(limit, len(raw))
    position, passed = np.arange(REACH), np.zeros(REACH, np.int64)
    for start in range(0, size, REACH):
        stop = min(start + REACH, size)
        here = np.flatnonzero((position >= start) & (position < stop))
        places, which = np.unique(position[here], return_inverse=True)
        if len(places) > FEW:
            to, count = _window(raw, start, stop, limit, big)
            to, count = to[places - start], count[places - start]
        else:  # chains that met stay together, so later windows have only few
            walked = [chain(data, int(p), stop, limit, big) for p in places]
            to = np.array([-1 if problem else edges[-1] for edges, problem in walked], np.int64)
            count = np.array([len(edges) - 1 for edges, _ in walked], np.int64)
        if len(places):
            passed[here] += count[which]
            position[here] = to[which]
    return np.where(position < 0, -1, position - size), passed


def compose(maps: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The map of consecutive blocks."""
    position, passed = np.arange(REACH), np.zeros(REACH, np.int64)
    for exits, counts in maps:
        going = np.flatnonzero(position >= 0)
        passed[going] += counts[position[going]]
        position[going] = exits[position[going]]
    return position, passed


# A stored map is cut into pieces of so many entries, since Spark reads and writes thousands of rows at once, and ends
# with the blocks it is of: entries beyond them pass through untouched.
PIECE = 1024
_MAP = "source_id string, block long, length long, piece int, exits array<int>, counts array<long>"
_ENTRY = "source_id string, block long, entry long, number long"


def _map_rows(source: str, block: int, length: int, exits: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    known = min(length, REACH)
    starts = np.arange(0, max(known, 1), PIECE)
    n, offsets = len(starts), pa.array(np.append(starts, known).astype(np.int32))
    made = [
        pa.repeat(source, n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.repeat(pa.scalar(length, pa.int64()), n), pa.array(np.arange(n, dtype=np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(exits[:known].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts[:known].astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(made, names=["source_id", "block", "length", "piece", "exits", "counts"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = Ranges()
    for batch in batches:
        for row in batch.to_pylist():
            start, stop = row["start"], row["stop"]
            data = ranges.read(row["plain"], start, min(row["size"], stop + REACH))
            exits, counts = transition(data, stop - start, row["size"] - start, row["big_endian"])
            yield _map_rows(row["source_id"], row["block"], stop - start, exits, counts)


def _sorted_maps(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, length, exits, counts) of the stored maps in order of their blocks, whole again."""
    table = table.sort_by([("block", "ascending"), ("piece", "ascending")])
    blocks, lengths = (table.column(c).to_numpy() for c in ("block", "length"))
    lists = [table.column(c).combine_chunks() for c in ("exits", "counts")]
    offsets, values = lists[0].offsets.to_numpy(), [x.values.to_numpy() for x in lists]
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    for first, after in zip(starts, np.append(starts[1:], len(blocks))):
        low, high = offsets[first], offsets[after]
        exits, counts = np.arange(REACH) - lengths[first], np.zeros(REACH, np.int64)
        exits[: high - low], counts[: high - low] = (v[low:high] for v in values)
        yield int(blocks[first]), int(lengths[first]), exits, counts


def _compose(key: tuple, table: pa.Table) -> pa.Table:
    length = 0

    def maps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal length
        for _, size, exits, counts in _sorted_maps(table):
            length += size
            yield exits, counts

    exits, counts = compose(maps())
    return pa.Table.from_batches([_map_rows(key[0].as_py(), key[1].as_py(), length, exits, counts)])


def _follow(table: pa.Table) -> pa.Table:
    """Entries of the blocks after each block of a group, from the entry of its first block."""
    source, parent, group = (table.column(c)[0].as_py() for c in ("source_id", "parent", "size"))
    position, number = (table.column(c)[0].as_py() for c in ("entry", "number"))
    rows = []
    for block, _, exits, counts in _sorted_maps(table.select(["block", "length", "piece", "exits", "counts"])):
        if position >= 0:
            number += int(counts[position])
            position = int(exits[position])
        if (block + 1) // group == parent:
            rows.append((source, block + 1, position, number))
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string()] + [pa.int64()] * 3)], names=["source_id", "block", "entry", "number"])


def _groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[tuple[str, int, list[tuple[dict, bytes]]]]:
    """(source, group, its blocks with their bytes) of blocks in order; the bytes of a group are read once."""
    ranges = Ranges()
    rows = (row for batch in batches for row in batch.to_pylist())
    for (source, parent), found in groupby(rows, lambda row: (row["source_id"], row["block"] // group)):
        found = list(found)
        start = found[0]["start"]
        data = ranges.read(found[0]["plain"], start, min(found[0]["size"], found[-1]["stop"] + REACH))
        yield source, parent, [(row, data[row["start"] - start: row["stop"] - start + REACH]) for row in found]


def _composed(group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps of groups of blocks, from the maps of their blocks; these are not stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, parent, found in _groups(batches, group):
            maps = (transition(data, row["stop"] - row["start"], row["size"] - row["start"], row["big_endian"]) for row, data in found)
            exits, counts = compose(maps)
            yield _map_rows(source, parent, found[-1][0]["stop"] - found[0][0]["start"], exits, counts)

    return run


def _walked(group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``_follow`` finds in the maps of a group's blocks, found in their bytes, as only one entry of each is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, parent, found in _groups(batches, group):
            position, number, rows = found[0][0]["entry"], found[0][0]["number"], []
            for row, data in found:
                length = row["stop"] - row["start"]
                if position >= 0:
                    edges, problem = chain(data, position, length, row["size"] - row["start"], row["big_endian"])
                    number += len(edges) - 1
                    position = -1 if problem else edges[-1] - length
                if (row["block"] + 1) // group == parent:
                    rows.append((source, row["block"] + 1, position, number))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.string()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source_id", "block", "entry", "number"])

    return run


def entries(blocks: DataFrame, most_blocks: int, group: int = GROUP, block_bytes: int = BLOCK) -> DataFrame:
    """(source_id, block, entry, number): the offset in every block of ``blocks`` at which its first record begins, and
    that record's number. An entry of -1 means that the chain ended before.

    A task holds the maps of ``group`` blocks; a file of group^n blocks takes n rounds of composing. Maps of short blocks
    are longer than their bytes: groups of them that fit into a task are composed where they are read, and their blocks
    are followed in their bytes.
    """
    needed = blocks.filter("stop < size")  # nothing follows the last block
    read = needed.select("source_id", "block", "start", "stop", "size", "plain", "big_endian", F.floor(F.col("block") / group).alias("parent"))
    short = group * block_bytes <= TASK_BYTES and most_blocks > group
    in_order = lambda df: df.repartition(tasks(blocks, dealt, TASK_BYTES), "source_id", "parent").sortWithinPartitions("source_id", "block")
    if short:
        dealt = read.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
        followed = F.col("size") > (F.col("parent") + 1) * F.lit(group * block_bytes)  # nothing follows the last group
        levels = [materialize(in_order(read.filter(followed)).mapInArrow(_composed(group), _MAP), "maps")]
        most_blocks = -(-most_blocks // group)
    else:
        levels = [materialize(needed.repartition(tasks(blocks, most_blocks, 8), "source_id", "block").mapInArrow(_maps, _MAP), "maps")]
    while most_blocks > group:
        parents = levels[-1].withColumn("parent", F.floor(F.col("block") / group)).groupBy("source_id", "parent")
        levels.append(materialize(parents.applyInArrow(_compose, _MAP), "maps"))
        most_blocks = -(-most_blocks // group)
    found = blocks.filter("block = 0").select("source_id", "block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("number"))
    for maps in reversed(levels):
        above = found.select("source_id", F.col("block").alias("parent"), "entry", "number")
        inside = maps.withColumn("parent", F.floor(F.col("block") / group)).join(above, ["source_id", "parent"])
        inside = inside.withColumn("size", F.lit(group).cast("long")).groupBy("source_id", "parent").applyInArrow(_follow, _ENTRY)
        firsts = above.select("source_id", (F.col("parent") * group).alias("block"), "entry", "number")
        found = materialize(firsts.unionByName(inside), "entries")
    if short:
        above = found.select("source_id", F.col("block").alias("parent"), "entry", "number")
        inside = in_order(read.join(shuffled(above), ["source_id", "parent"])).mapInArrow(_walked(group), _ENTRY)
        firsts = above.select("source_id", (F.col("parent") * group).alias("block"), "entry", "number")
        found = materialize(firsts.unionByName(inside), "entries")
    return found


def locate(prepared: DataFrame, block_bytes: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The blocks of all files with the place and the number of their first record.

    Columns of ``prepared`` and block, start, stop, entry, number; files without a file header are one block.
    """
    known = F.col("big_endian").isNotNull()
    last = F.when(known, F.greatest(F.ceil(F.col("size") / block_bytes) - 1, F.lit(0))).otherwise(F.lit(0))
    blocks = prepared.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    start = F.col("block") * F.lit(block_bytes)
    stop = F.when(known, F.least(start + block_bytes, F.col("size"))).otherwise(F.col("size"))
    blocks = blocks.withColumns({"start": start, "stop": stop})
    total = blocks.agg(F.count("*").alias("n"), F.max("block").alias("most"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    zero = F.lit(0).cast("long")
    if not total["most"]:
        placed = blocks.withColumns({"entry": zero, "number": zero})
    else:
        long = blocks.filter(F.col("size") > block_bytes).filter(known)
        found = entries(long, total["most"] + 1, group, block_bytes)
        short = blocks.filter((F.col("size") <= block_bytes) | ~known).withColumns({"entry": zero, "number": zero})
        placed = short.unionByName(long.join(found, ["source_id", "block"]).select(*short.columns))
    return placed.repartition(tasks(blocks, total["bytes"] or 0, TASK_BYTES))


def frame(row: dict, ranges: Ranges, batch: int) -> Iterator[tuple[bytes, np.ndarray, int, str | None]]:
    """(bytes, edges, number, problem) of the records that begin in a located block, ``batch`` at a time.

    Edges are offsets in the bytes, which begin at ``row['start']``; ``number`` is that of the first record. A problem
    comes with the edge at which it stands.
    """
    start, size, number = row["start"], row["size"], row["number"]
    if row["big_endian"] is None:
        yield b"", np.zeros(1, np.int64), 0, "no file attributes record"
        return
    if row["entry"] < 0 or start + row["entry"] > size:
        return
    stop, limit = row["stop"] - start, size - start
    data = ranges.read(row["plain"], start, min(size, row["stop"] + REACH))
    position, problem = row["entry"], None
    while position < stop and problem is None:
        edges, problem = chain(data, position, stop, limit, row["big_endian"], batch)
        if len(edges) > 1:
            yield data, np.array(edges, np.int64), number, None
        number, position = number + len(edges) - 1, edges[-1]
    if problem == "trailing bytes that form no header" and row["stopped"]:
        problem = row["stopped"]
    if problem is None and row["stop"] == size and position == limit:
        problem = row["stopped"]
    if problem is not None:
        yield data, np.array([position], np.int64), number, problem
