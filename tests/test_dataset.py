"""Growing datasets: reuse, replacement, failures, verification, snapshots, streams."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from testfloor.session import scratch_path
from testfloor.sources import dataset, eav
from testfloor.streaming import ingest as streaming


def convert(files):
    """One row per line of a text file; the word 'bad' makes it fail."""
    names = [r.path for r in files.collect()]
    text = files.sparkSession.read.text(names).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("value").alias("line"))
    rows = text.select(F.sha2("path", 256).alias("source_id"), "path", "line")
    bad = rows.filter("line = 'bad'").select("source_id", "path", F.lit(0).cast("long").alias("record_seq"), F.lit("LINE").alias("kind"), F.lit("bad line").alias("error"))
    return rows.drop("path"), bad


FOLDER = tempfile.mkdtemp(prefix="texts-")


def files(spark, **content):
    for name, text in content.items():
        Path(FOLDER, name).write_text(text)
    return spark.createDataFrame([(f"file:{FOLDER}/{n}",) for n in content], "path string")


def lines(df):
    return sorted(r.line for r in df.collect())


def test_unchanged_changed_and_failed_files(spark):
    root = scratch_path(spark, "ds")
    assert dataset.ingest(spark, root, files(spark, a="1\n2", b="3"), convert) == "complete"
    assert lines(dataset.read(spark, root)) == ["1", "2", "3"] and dataset.current_version(spark, root) == 1
    assert dataset.ingest(spark, root, files(spark, a="1\n2", b="3"), convert) == "complete"
    assert dataset.current_version(spark, root) == 1  # nothing to do
    pinned = dataset.pin(spark, root)
    assert dataset.ingest(spark, root, files(spark, a="1\nbad", b="4", c="5"), convert) == "partial"
    assert lines(dataset.read(spark, root)) == ["1", "2", "4", "5"]  # the failed file keeps its previous version
    assert lines(dataset.read_pinned(spark, root, pinned)) == ["1", "2", "3"]
    assert lines(dataset.read(spark, root, 1)) == ["1", "2", "3"]
    assert [(r.path[-2:], r.error) for r in dataset.errors(spark, root).collect()] == [("/a", "bad line")]
    # only what changed is written
    assert [r["count"] for r in spark.read.parquet(f"{root}/sources").groupBy("version").count().orderBy("version").collect()] == [2, 2]
    assert dataset.ingest(spark, root, files(spark, d="bad"), convert, fail_fast=True) == "failed"
    assert dataset.current_version(spark, root) == 2 and dataset.errors(spark, root).first().path.endswith("/d")
    # other options convert the same file again
    assert dataset.ingest(spark, root, files(spark, b="4"), convert, options="v2") == "complete"
    assert lines(dataset.read(spark, root)) == ["1", "2", "4", "5"] and dataset.current_version(spark, root) == 3


def test_verification_finds_changed_and_missing_fragments(spark):
    root = scratch_path(spark, "ds")
    dataset.ingest(spark, root, files(spark, a="1\n2"), convert)
    assert dataset.verify(spark, root).count() == 0
    ident = dataset.pin(spark, root)
    listed = dataset.fragments(spark, root).first()
    extra = spark.createDataFrame([(listed.generation, "/nowhere/part.parquet", "00", 7)], dataset.FRAGMENTS.replace("version long, ", ""))
    extra.write.mode("append").parquet(f"{root}/fragments/version=1")
    found = {r.finding for r in dataset.verify(spark, root).collect()}
    assert found == {"missing fragment"}
    assert lines(dataset.read_pinned(spark, root, ident)) == ["1", "2"]


def test_a_run_that_stops_changes_nothing(spark, monkeypatch):
    """Between the fragments and the sources a run may end; the next one makes the version anew."""
    root = scratch_path(spark, "ds")
    dataset.ingest(spark, root, files(spark, a="1"), convert)
    writing = dataset.stored_files
    monkeypatch.setattr(dataset, "stored_files", lambda *a: writing(*a).withColumn("rows", F.raise_error(F.lit("stopped"))))
    with pytest.raises(Exception, match="stopped"):
        dataset.ingest(spark, root, files(spark, a="2"), convert)
    monkeypatch.undo()
    stale = spark.createDataFrame([("gone", "/nowhere/part.parquet", "00", 7)], dataset.FRAGMENTS.replace("version long, ", ""))
    stale.write.mode("append").parquet(f"{root}/fragments/version=2")
    assert lines(dataset.read(spark, root)) == ["1"] and dataset.current_version(spark, root) == 1
    assert dataset.ingest(spark, root, files(spark, a="2"), convert) == "complete"
    assert lines(dataset.read(spark, root)) == ["2"] and dataset.verify(spark, root).count() == 0
    assert lines(dataset.read(spark, root, 1)) == ["1"]


def test_stream_adds_only_new_files(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", scratch_path(spark, "ds"), scratch_path(spark, "checkpoint")
    inbox.mkdir()
    run = lambda: streaming.watch_files(spark, str(inbox), root, checkpoint, convert).awaitTermination()
    (inbox / "a.stdf").write_text("1\n2")
    (inbox / "notes.txt").write_text("ignored")
    run()
    (inbox / "b.std").write_text("3")
    run()
    assert lines(dataset.read(spark, root)) == ["1", "2", "3"] and dataset.current_version(spark, root) == 2
    run()
    assert dataset.current_version(spark, root) == 2


def test_schema_contract(spark):
    good = spark.createDataFrame([], eav.EAV)
    path = scratch_path(spark, "eav")
    good.write.parquet(path)
    assert eav.read_eav(spark, path).schema == eav.EAV
    with pytest.raises(eav.SchemaMismatch):
        eav.conform(good.drop("units"))
    with pytest.raises(eav.SchemaMismatch):
        eav.conform(good.withColumn("part_pass", F.lit("yes")))
    wide = good.withColumn("part_sequence", F.col("part_sequence").cast("decimal(20,0)")).select(*[f.name for f in eav.EAV])
    assert eav.conform(wide).schema["part_sequence"].dataType == eav.EAV["part_sequence"].dataType


def test_multisets(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, t string")
    same = rows.orderBy(F.desc("n")).repartition(3)
    digest = lambda df: eav.multiset_digest(eav.row_digest(df, ["n", "t"]), []).first().multiset_digest
    assert digest(rows) == digest(same) != digest(rows.distinct())
    diff = eav.multiset_difference(eav.row_digest(rows, ["n", "t"]), eav.row_digest(rows.distinct(), ["n", "t"]))
    assert [(r.left_rows, r.right_rows) for r in diff.collect()] == [(2, 1)]


def test_pairing_of_many_equal_rows(spark):
    left = eav.row_digest(spark.range(500).withColumn("v", F.lit("x")), ["v"]).select("digest", "id")
    right = left.withColumnRenamed("id", "other").filter("other % 2 = 0")
    pairs = eav.pair_equal_rows(left, right, ["id"], ["other"]).collect()
    assert len(pairs) == 500 and all(p.other == 2 * p.id for p in pairs if p.id < 250) and sum(p.other is None for p in pairs) == 250
