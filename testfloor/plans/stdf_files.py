"""Test logs written from the driver's tables, as input of the reading queries.

Each block of 256 orders becomes one STDF file: an order is an attempt, a line
item a test. Some files are compressed, big-endian, copied or cut short.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable
from functools import cache
from itertools import groupby
from operator import attrgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from testfloor.plans import adapters
from testfloor.session import scratch_path, write_bytes
from testfloor.sources import framing, stdf

BLOCK = 256
AT_ONCE = 16  # blocks that a task takes together, since each hand-over to Python costs as much as a block


class Line(NamedTuple):
    """An order with one of its line items, or with none."""

    o_orderkey: int
    o_custkey: int
    o_orderstatus: str | None
    o_orderpriority: str
    l_linenumber: int | None
    l_suppkey: int | None
    l_extendedprice: float | None
    l_returnflag: str | None


_LINE_ORDER = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def _lines(table: pa.Table) -> Iterable[Line]:
    """The rows of a block in the order of its file."""
    ordered = table.sort_by([(name, "ascending") for name in _LINE_ORDER])
    return map(Line, *(ordered.column(name).to_pylist() for name in Line._fields))


@cache
def _struct(codes: str) -> struct.Struct:
    return struct.Struct(codes)


class Writer:
    """STDF records of one file in either byte order."""

    def __init__(self, big: bool = False):
        self.order, self.parts, self.count = ">" if big else "<", [], 0

    def pack(self, codes: str, *values) -> bytes:
        return _struct(self.order + codes).pack(*values)

    @staticmethod
    def text(value: str) -> bytes:
        raw = value.encode()
        return bytes([len(raw)]) + raw

    def add(self, typ: int, sub: int, *body: bytes) -> None:
        joined = b"".join(body)
        self.parts.append(self.pack("HBB", len(joined), typ, sub) + joined)
        self.count += 1

    def test(self, typ: int, sub: int, codes: str, values: tuple, tail: bytes) -> None:
        """A record of packed values and a tail that many records share, in one step."""
        packed = _struct(f"{self.order}HBB{codes}")
        self.parts.append(packed.pack(packed.size - 4 + len(tail), typ, sub, *values) + tail)
        self.count += 1

    def header(self) -> None:
        self.add(0, 10, bytes([1 if self.order == ">" else 2, 4]))

    def content(self) -> bytes:
        return b"".join(self.parts)


def _generic(w: Writer, *values) -> list[bytes]:
    out = [w.pack("H", len(values))]
    for kind, value in values:
        if kind == "Cn":
            out += [b"\x0a", w.text(value)]
        elif kind is None:
            out.append(b"\x00")
        else:
            tag, code = {"U1": (1, "B"), "U4": (3, "I"), "R8": (8, "d")}[kind]
            out += [bytes([tag]), w.pack(code, value)]
    return out


def _selected(block: int) -> list[str]:
    """The optional fields of a MIR up to the flow id, with what selects a step."""
    return [""] * 4 + [("P", "F", "Q")[block % 3], str(25 * (block % 2))] + [""] * 11 + [f"F{block % 4}"]


def _opening(w: Writer, block: int, flow: bool) -> None:
    w.header()
    names = [f"LOT{block % 10}", "DEVICE", "NODE", "TESTER", f"JOB{block % 8}", f"r{block % 2}"]
    w.add(1, 10, w.pack("II", 1000 + block, 2000 + block), b"\x01P  ", w.pack("H", 65535), b" ", *map(w.text, names + (_selected(block) if flow else [])))
    w.add(50, 30, w.text(f"block {block}"))
    w.add(137, 10, w.text("EVENT"), w.text("handler"), bytes([1, 0]), w.text("load"))
    w.add(99, 77, b"ABC")
    if block % 2 == 0:
        w.add(1, 80, bytes([1, 1, 4, 0, 1, 2, 3]), w.text("HT"), w.text(f"hand{block % 3}"), w.text("CT"), w.text(f"card{block % 5}"))
    w.add(2, 10, bytes([1, 1 if block % 2 == 0 else 255]), w.pack("I", 2000 + block), w.text(f"W{block % 25}"))
    axis = [("U1", 1), ("Cn", "VDD"), ("Cn", "s"), ("Cn", "DPS"), ("Cn", "r"), ("Cn", "1.0"), ("Cn", "f"), ("Cn", "0:2"), ("R8", 0.5), ("U4", 4), ("U4", 2), ("Cn", "lin"), ("U1", 1)]
    track = [("U1", 1), ("Cn", "T"), ("Cn", "s"), ("Cn", "t"), ("Cn", "n"), ("Cn", "f"), ("Cn", "1:2"), ("R8", 0.25)]
    head = [(None, None), ("Cn", "SHMOO"), ("Cn", hex(block)), ("Cn", "name"), ("Cn", "ins"), ("Cn", "title"), ("Cn", "o"), ("Cn", "N"), ("U1", 1)]
    w.add(50, 10, *_generic(w, *head, *axis, *track))


@cache
def _limits(order: str, number: int, later: int | None) -> bytes:
    """What follows the value of a parametric record."""
    w, name = Writer(order == ">"), Writer.text(f"T{number}")
    if number % 2 == 0 or later == 0:
        return name
    flag = (0, 0x30, 0x40, 0)[later or 0]
    limits = w.pack("ff", 1.0, 2.0) + w.text("mA") if later == 1 else w.pack("ff", 5000.0, 95000.0) + w.text("" if later == 2 else "mA")
    return name + w.text("") + bytes([flag, 0, 0, 0]) + limits


@cache
def _pattern(pattern: int, number: int) -> bytes:
    return b"".join(map(Writer.text, (f"pat{pattern}", "", "", f"T{number}")))


def _test(w: Writer, row: Line, site: int, later: int | None = None) -> None:
    """A test record; ``later`` (0-3) is how it differs from the definition that an earlier one gave."""
    number = int(row.l_linenumber)
    flags = {"R": 128, "A": 0}.get(row.l_returnflag, (16, 64, 1)[int(row.l_suppkey) % 3])
    price = float("nan") if row.l_extendedprice is None else row.l_extendedprice
    if number == 6:
        w.test(15, 20, "IBBBBIIIIiihHHH", (number, 1, site, flags, 0, 1, 2, 3, 4, -1, -2, -3, 0, 0, 0), _pattern(int(row.l_suppkey) % 10, number))
    elif number == 7:
        w.test(15, 15, "IBBBBHHBBff", (number, 1, site, flags, 0, 3, 2, 0x21, 0x03, price, price + 1), w.text(f"T{number}"))
    else:
        w.test(15, 10, "IBBBBf", (number, 1, site, flags, 0, price), _limits(w.order, number, later))


def _closing(w: Writer, block: int, bins: dict[int, int]) -> None:
    """Summaries of the hard bins, some of them wrong, and the end of the program section, at times left out."""
    for number, n in sorted(bins.items()):
        wrong = 1 if block % 5 == 0 and number == 2 else 0
        if not (block % 7 == 0 and number == 3):
            w.add(1, 40, w.pack("BBHI", 255, 255, number, n + wrong), b"P", w.text(f"bin {number}"))
    if block % 7:
        w.add(20, 20)


def _build(block: int, rows: Iterable[Line], flow: bool) -> tuple[bytes, int]:
    w = Writer(block % 3 == 2)
    _opening(w, block, flow)
    bins: dict[int, int] = {}
    defined: set[int] = set()
    if flow:
        w.add(20, 10, w.text("main"))
    units = 0
    for order, group in groupby(rows, attrgetter("o_orderkey")):
        tests = list(group)
        first, units = tests[0], units + 1
        site, customer = int(order % 4), int(first.o_custkey)
        w.add(5, 10, bytes([1, site]))
        real = [row for row in tests if row.l_linenumber is not None]
        for row in real:
            _test(w, row, site, int(order % 4) if flow and row.l_linenumber in defined else None)
            defined.add(row.l_linenumber)
        if order % 50 == 0:
            w.add(50, 10, *_generic(w, ("Cn", "SHMOO_RESULT"), ("U4", int(order)), ("U1", 1), ("U4", site), ("Cn", "1"), ("Cn", "0,0"), ("Cn", "i"), ("Cn", "P")))
        if flow and order % 10 == 0:
            w.add(50, 30, w.text(f"order {order}"))
        if flow and order % 15 == 0:
            w.add(137, 10, w.text("EVENT"), w.text("probe"), bytes([1, site if order % 2 else 9]), w.text("touch"))
        bins[int(first.o_orderpriority[0])] = bins.get(int(first.o_orderpriority[0]), 0) + 1
        flags = 4 if order % 41 == 0 else {"O": 0, "F": 8}.get(first.o_orderstatus, 16)
        known = customer % 17 != 0
        x, y = (customer % 50 + 1, customer // 50 % 30000 + 1) if known else (-32768, -32768)
        part = (1, site, flags, len(real), int(first.o_orderpriority[0]), int(order % 6) * 10, x, y, int(order % 1000))
        w.test(5, 20, "BBBHHHhhI", part, b"" if order % 9 == 0 else w.text(f"U{order}"))
    if flow:
        _closing(w, block, bins)
    w.add(2, 20, bytes([1, 1 if block % 2 == 0 else 255]), w.pack("II", 3000 + block, units))
    w.add(1, 20, w.pack("I", 4000 + block))
    content = w.content()
    return (content[:-3] if block % 11 == 10 else content), w.count


def _name(block: int) -> str:
    suffix = ".stdf.gz" if block % 4 == 1 else ".STD" if block % 7 == 3 else ".stdf"
    return f"S{block % 8}/run-{block:09d}{suffix}"


def write_files(spark: SparkSession, sf_dir: str, flow: bool = False) -> str:
    """Write one file per block of orders into a new shared folder and return the folder.

    With ``flow`` the files also hold what selects a flow's step, program sections, bin summaries, and text and event
    records inside of units.
    """
    folder = scratch_path(spark, "stdf")
    orders = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = adapters.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag"
    )
    # An order and its lines are in the same blocks, so both tables are dealt out once, for their join and for the files.
    dealt = [df.withColumn("blocks", F.floor(F.col("o_orderkey") / (BLOCK * AT_ONCE))).groupBy("blocks") for df in (orders, lines)]

    def write(key: tuple, orders: pa.Table, lines: pa.Table) -> pa.Table:
        counts, rows = [], orders.join(lines.drop_columns(["blocks"]), "o_orderkey", join_type="left outer", use_threads=False)
        for block, lines in groupby(_lines(rows), lambda line: line.o_orderkey // BLOCK):
            content, count = _build(block, lines, flow)
            stored = gzip.compress(content, mtime=0) if block % 4 == 1 else content
            names = [_name(block)] + ([f"copy/{_name(block)}"] if block % 5 == 0 else []) + ([f"S{block % 8}/notes-{block}.txt"] if block % 6 == 0 else [])
            for name in names:
                write_bytes(f"{folder}/{name}", stored)
            counts.append(count)
        return pa.table({"records": pa.array([sum(counts)], pa.int64())})

    dealt[0].cogroup(dealt[1]).applyInArrow(write, "records long").agg(F.sum("records")).collect()
    return folder


_FOLDERS: dict[tuple[str, str, bool], str] = {}


def folder(spark: SparkSession, sf_dir: str, flow: bool = False) -> str:
    """The folder of this application's files for ``sf_dir``, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, flow)
    if key not in _FOLDERS:
        _FOLDERS[key] = write_files(spark, sf_dir, flow)
    return _FOLDERS[key]


_PREPARED: dict[tuple[str, str], DataFrame] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with their hashes, read and inflated once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        _PREPARED[key] = framing.prepare(stdf.discover(spark, [folder(spark, sf_dir)]))
    return _PREPARED[key]


def block_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"run-(\d+)\.", 1).cast("bigint")


_RECORDS: dict[tuple[str, str], DataFrame] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed records of all files, copies included; written out once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RECORDS:
        _RECORDS[key] = stdf.stored(stdf.frames(files(spark, sf_dir)))
    return _RECORDS[key]
