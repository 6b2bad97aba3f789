"""Writing the given tables as test logs: what a file holds, and what a block costs."""

import struct
import time

import pyarrow as pa

from testfloor.plans import stdf_files

_COLUMNS = {
    "o_orderkey": pa.int64(), "o_custkey": pa.int64(), "o_orderstatus": pa.string(), "o_orderpriority": pa.string(), "l_linenumber": pa.int32(),
    "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_extendedprice": pa.float64(), "l_quantity": pa.float64(), "l_shipdate": pa.timestamp("us"),
    "l_returnflag": pa.string(),
}


def block(*rows):
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), _COLUMNS.values())], names=list(_COLUMNS))


def records(content):
    found, at = [], 0
    while at < len(content):
        size, typ, sub = struct.unpack_from("<HBB", content, at)
        found.append(((typ, sub), content[at + 4: at + 4 + size]))
        at += 4 + size
    return found


def test_rows_in_order_and_orders_without_lines():
    rows = block(
        (9, 5, "F", "2-HIGH", 2, 1, 3, 7.5, 1.0, None, "N"), (9, 5, "F", "2-HIGH", 1, 1, 4, None, 1.0, None, None),
        (3, 17, None, "1-URGENT", None, None, None, None, None, None, None),
    )
    content, count = stdf_files._build(0, stdf_files._lines(rows), False)
    found = records(content)
    assert count == len(found)
    parts = [(struct.unpack_from("<BBBHHHhhI", body), body[17:]) for kind, body in found if kind == (5, 20)]
    assert [(p[3], p[4], p[6]) for p, _ in parts] == [(0, 1, -32768), (2, 2, 6)]  # tests, hard bin, x
    assert [name for _, name in parts] == [b"\x02U3", b""]
    tests = [struct.unpack_from("<IBBBBf", body) for kind, body in found if kind == (15, 10)]
    assert [(t[0], t[2], t[3]) for t in tests] == [(1, 1, 64), (2, 1, 16)] and tests[0][5] != tests[0][5] and tests[1][5] == 7.5
    assert [struct.unpack_from("<II", body, 2)[1] for kind, body in found if kind == (2, 20)] == [2]


def test_a_block_takes_milliseconds():
    rows = [(order, order, "O", "3-MEDIUM", line, 1, line, 10.0 * line, 1.0, None, "A") for order in range(256) for line in range(1, 8)]
    began = time.process_time()
    _, count = stdf_files._build(0, stdf_files._lines(block(*rows)), True)
    assert count > 7 * 256 and time.process_time() - began < 0.5


def test_blocks_are_handed_over_many_at_once(spark, sf):
    from pathlib import Path

    folder = stdf_files.write_files(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    blocks = {r[0] for r in orders.selectExpr(f"o_orderkey div {stdf_files.BLOCK}").distinct().collect()}
    found = {int(p.name[4:13]) for p in Path(folder.removeprefix("file:")).rglob("run-*")}
    assert found == blocks and len(blocks) > 1
    assert stdf_files.AT_ONCE > 1  # a block a hand-over took as long for the hand-over as for the block
