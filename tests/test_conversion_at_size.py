"""Converting many logs: tests are dealt out once, and wafers are asked for once per stretch."""

import random

import pytest
from pyspark.sql import functions as F

from testfloor.operators import stream
from testfloor.plans import load, stdf_files
from testfloor.session import materialize
from testfloor.sources import eav, framing, stdf
from tests.test_stream import SCHEMA, random_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def logs(spark, sf):
    load()
    return stdf.discover(spark, [stdf_files.folder(spark, sf)])


def test_tests_are_dealt_out_once(logs):
    rows = eav.convert(stdf.read_events(logs)).rows
    shown = plan(rows)
    # The join with what is carried into a chunk; there were three windows and the joins with attempts and parts before.
    assert shown.count("SortMergeJoin") == 1 and shown.count("Exchange hashpartitioning") <= 4
    assert rows.filter("part_id is null or lot_id is null").isEmpty() and not rows.isEmpty()


def test_flattening_reads_its_rows_once(spark):
    tests = spark.createDataFrame(
        [("a", 1, 7, "PTR", "p", 0, 1.5, None, 1.0, 2.0, "V"), ("a", 2, 7, "MPR", None, 128, 9.0, [3.0, None], 1.0, 2.0, "V"),
         ("a", 3, 7, "MPR", "m", 0, None, None, 1.0, 2.0, "V"), ("a", 4, 7, "FTR", "f", 0, 9.0, [1.0], 1.0, 2.0, "V"), ("a", 5, 7, "PIR", "x", 0, None, None, None, None, None)],
        "attempt string, seq long, test_num long, kind string, test_txt string, test_flg int, result double, rtn_rslt array<double>, lo_limit double, hi_limit double, units string",
    )
    flat = stream.flatten_measurements(tests)
    assert "Union" not in plan(flat)
    found = [tuple(r)[1:] for r in flat.orderBy("seq", "expansion_index").collect()]
    assert found == [
        (1, 7, "PTR", "p", 0, 1.5, True, 1.0, 2.0, "V"), (2, 7, "MPR", " [MPR overall]", 0, None, False, None, None, "V"),
        (2, 7, "MPR", " [MPR result 0]", 1, 3.0, None, 1.0, 2.0, "V"), (2, 7, "MPR", " [MPR result 1]", 2, None, None, 1.0, 2.0, "V"),
        (3, 7, "MPR", "m [MPR overall]", 0, None, True, None, None, "V"), (4, 7, "FTR", "f", 0, None, True, None, None, None),
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_wafers_are_asked_once_per_stretch(spark, monkeypatch, seed):
    records = materialize(spark.createDataFrame(random_stream(seed, strict=False), SCHEMA), "test")
    probes = records.filter(F.col("kind").isin("PIR", "PTR", "PRR")).select("source_id", "head", "site", "seq")
    asked, groups = [], stream.site_groups
    monkeypatch.setattr(stream, "site_groups", lambda records, probes, *rest: (asked.append(probes.count()), groups(records, probes, *rest))[1])
    found = stream.open_wafers(records, probes, chunk_rows=20)
    each = stream._wafers_of(records, probes, ["source_id"], False, 20, True)  # every probe by itself
    columns = ["source_id", "head", "site", "seq", "site_group", "open_count", "own", "shared", "wafer_seq"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, each.select(columns).collect()))
    assert asked[0] < asked[1] == probes.count()


def test_hashes_know_the_lengths(spark, tmp_path):
    data = random.Random(1).randbytes(3000)
    (tmp_path / "a").write_bytes(data)
    found = framing.hashes(spark.createDataFrame([(f"file:{tmp_path}/a",), (f"file:{tmp_path}/a",), (None,)], "path string")).collect()
    assert [r.length for r in found] == [3000]
