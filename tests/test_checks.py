from testfloor.operators import quality

_SCHEMA = "source_id string, offset long, record string, flow string, field string, presence string, status string, eff_text string, eff_number double"


def test_absent_fields_of_array_members(spark):
    rows = [("s", 1, "X", flow, field, "present", "valid", "v", None) for flow in ("cp",) for field in ("A[0].B", "A[0].T[1].U", "A[2].C", "N", "N")]
    rows += [("s", 2, "X", "unknown", "A[7].C", "present", "valid", " ", None), ("s", 3, "Y", "cp", "N", "present", "valid", "v", None)]
    checks = quality.check_list(spark, "X N CP|FT\nX M FT\nX A[].B CP|FT\nX A[].C CP\nX A[].T[].U CP|FT\nX A[].T[].W CP")
    found = quality.project_checks(spark.createDataFrame(rows, _SCHEMA), checks)
    absent = {(r.offset, r.flow, r.field) for r in found.filter("presence = 'omitted'").collect()}
    assert absent == {(1, "cp", "A[0].C"), (1, "cp", "A[2].B"), (1, "cp", "A[0].T[1].W"), (2, "unknown", "N"), (2, "unknown", "A[7].B")}
    listed = {(r.offset, r.field): r.status for r in found.filter("presence = 'present'").collect()}
    assert listed == {(1, "A[0].B"): "valid", (1, "A[0].T[1].U"): "valid", (1, "A[2].C"): "valid", (1, "N"): "valid", (2, "A[7].C"): "not_checked", (3, "N"): "not_checked"}


def test_fields_are_shuffled_once(spark):
    fields = spark.createDataFrame([("s", 1, "PRR", "cp", "HARD_BIN", "present", "valid", None, 1.0)], _SCHEMA)
    plan = quality.project_checks(fields, quality.check_list(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
