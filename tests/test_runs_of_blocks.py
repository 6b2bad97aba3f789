"""Blocks number their runs as they are read, so that records are not stored a second time for it."""

import random

import pyarrow as pa
import pytest

from testfloor.operators import stream
from testfloor.plans.stdf_files import Writer
from testfloor.session import materialize
from testfloor.sources import stdf, tables
from tests.test_stdf import written

CONTEXT = ("lot_id", "start_t")


def log(seed, runs, big=False):
    """Runs of some parts and text; every third MIR stops before its lot."""
    rng, w = random.Random(seed), Writer(big)
    w.header()
    for run in range(runs):
        if run or seed % 2:
            whole = [b"\x01P  ", w.pack("H", 65535), b" ", *map(w.text, [f"LOT{run}", "D", "N", "T", "JOB"])]
            w.add(1, 10, w.pack("II", 5, run), *(whole if run % 3 else whole[:1]))
        for _ in range(rng.randint(0, 5)):
            w.add(5, 10, bytes([1, 2]))
            w.add(50, 30, w.text("x" * rng.randint(0, 200)))
            w.add(5, 20, w.pack("BBBHHHhhI", 1, 2, 0, 0, 1, 1, 4, 5, 7), w.text("u"))
    return w.content()


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_runs_are_those_of_the_stream(spark, block_bytes):
    files = written(spark, **{f"f{seed}": log(seed, seed, seed % 3 == 0) for seed in range(12)}, none=b"", cut=log(8, 5)[:-3])
    plain = stream.number_runs(stdf.read_events(files), CONTEXT)
    here = materialize(stdf.read_events(files, block_bytes=block_bytes, context=CONTEXT), "test")
    found = stream.number_runs(here, CONTEXT, stored=True)
    assert found.columns == plain.columns
    columns = ["source_id", "seq", "kind", "run", "site", "error", *CONTEXT]
    shown = lambda df: sorted(map(str, df.select(columns).filter("kind <> 'DECODE_ERROR'").collect()))
    assert shown(found) == shown(plain) and here.filter("not whole").isEmpty() == (block_bytes > 400)


@pytest.mark.parametrize("seed", range(4))
def test_runs_go_on_from_batch_to_batch(seed):
    rng = random.Random(seed)
    rows = [(block, rng.choice(["MIR", "bad", "PIR", "PTR"]), i) for block in range(6) for i in range(rng.randint(1, 12))]
    expected, begun = [], {}
    for block, kind, i in rows:
        n, lot = begun.get(block, (0, None))
        begun[block] = (n + 1, f"{block}.{i}") if kind == "MIR" else (n, lot)
        expected.append(begun[block])
    runs, found = stdf._Runs(("lot_id",)), []
    while rows:
        n = rng.randint(1, 9)
        now, rows = rows[:n], rows[n:]
        batch = pa.RecordBatch.from_pydict({"kind": ["MIR" if k == "bad" else k for _, k, _ in now], "block": [b for b, _, _ in now]})
        typed = [(k, f"{b}.{i}") for b, k, i in now if k in ("MIR", "bad")]
        made = [pa.RecordBatch.from_pydict({"kind": ["MIR" if k == "MIR" else "DECODE_ERROR" for k, _ in typed], "lot_id": [t for _, t in typed]})] if typed else []
        here = runs.add(batch, made)
        found += zip(here["run_here"].to_pylist(), here["lot_id"].to_pylist())
    assert found == expected


def test_records_are_stored_once(spark):
    built = tables.build(stdf.read_events(written(spark, a=log(3, 4), b=log(4, 2)), context=tables.CONTEXT))
    assert not any("numbered-records" in f for f in built.events.inputFiles())
    assert "Join" not in built.events._jdf.queryExecution().executedPlan().toString()
