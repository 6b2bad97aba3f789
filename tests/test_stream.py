"""Record streams: window formulas against sequential folds on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from testfloor.operators import quality, stream

SCHEMA = (
    "source_id string, seq long, kind string, head int, site long, site_grp int, sites array<long>, wafer_id string, fabwf_id string"
)


def random_stream(seed, length=400, strict=True, free=False):
    """Records of two sources; per run and head either all sites are mapped or none, or with ``free`` any at any time."""
    rng, rows = random.Random(seed), []
    for source in ("A", "B"):
        seq, mapped, opened = 0, {}, set()

        def put(kind, head=None, site=None, grp=None, sites=None, wafer=None, fab=None):
            nonlocal seq
            rows.append((source, seq, kind, head, site, grp, sites, wafer, fab))
            seq += rng.randint(1, 3)

        def start_run():
            for h, s in sorted(opened):
                put("PRR", h, s)
            opened.clear()
            put("MIR")
            for head in (1, 2):
                mapped[head] = rng.random() < 0.5
                if mapped[head]:
                    put("SDR", head, grp=0, sites=[0, 1])
                    put("SDR", head, grp=1, sites=[2, 3])

        start_run()
        for _ in range(length):
            head, site, roll = rng.choice((1, 2)), rng.randint(0, 3), rng.random()
            grp = rng.choice((0, 1)) if mapped[head] and not free else rng.choice((0, 1, 255, None))
            if roll < 0.02:
                start_run()
            elif free and rng.random() < 0.05:
                put("SDR", head, grp=rng.choice((0, 1, 2, 255)), sites=rng.choice([None, [], [0], [1, 2], [0, 3]]))
            elif roll < 0.10:
                put("WIR", head, grp=grp, wafer=rng.choice([None, " ", f"W{seq}"]))
            elif roll < 0.18:
                put("WRR", head, grp=255 if grp is None else grp, wafer=rng.choice([None, "", f"R{seq}"]), fab=rng.choice([None, None, f"F{seq}"]))
            elif roll < 0.45 and (not strict or (head, site) not in opened):
                put("PIR", head, site)
                opened.add((head, site))
            elif roll < 0.75:
                put(rng.choice(("PTR", "FTR", "MPR")), head, site)
                opened.add((head, site))
            else:
                put("PRR", head, site)
                opened.discard((head, site))
    return rows


def clean(text):
    return text if text and text.strip() else None


def fold(rows, strict):
    """Attempts in open order: (source, head, site, open_seq) -> number, close, tests, wafer, issue."""
    found = []
    for source in ("A", "B"):
        slots, groups, active, names, number, wafer_seq = {}, {}, {}, [], 0, []
        for _, seq, kind, head, site, grp, sites, wafer, fab in (r for r in rows if r[0] == source):
            if kind == "MIR" and strict:
                slots.clear(), groups.clear()
            elif kind == "SDR":
                groups.update({(head, s): grp for s in sites or []})
            elif kind == "WIR":
                names.append(clean(wafer) if strict else wafer)
                wafer_seq.append(seq)
                slots[head, 255 if grp is None else grp] = len(names) - 1
            elif kind == "WRR":
                slot = slots.pop((head, grp), None)
                if slot is None and strict:
                    slot = slots.pop((head, 255), None)
                if slot is not None and strict:
                    names[slot] = clean(fab) or clean(wafer) or names[slot]
            if kind not in stream.SIDE_KINDS:
                continue

            def selected():
                if (head, site) in groups:
                    return slots.get((head, groups[head, site]), slots.get((head, 255)))
                if (head, 255) in slots:
                    return slots[head, 255]
                mine = [v for (h, _), v in slots.items() if h == head]
                return mine[0] if len(mine) == 1 else None

            if strict and selected() is None and ((head, site) in groups or not any(h == head for h, _ in slots)):
                names.append(None)
                wafer_seq.append(None)
                slots[head, groups.get((head, site), 255)] = len(names) - 1
            key = (head, site)
            if kind == "PIR" or key not in active:
                number += 1
                active[key] = [source, head, site, seq, number, None, 0, selected(), names, wafer_seq]
                found.append(active[key])
            if kind in ("PTR", "FTR", "MPR"):
                active[key][6] += 1
            if kind == "PRR":
                active.pop(key)[5] = seq
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_match_a_fold(spark, seed):
    rows = random_stream(seed, strict=False)
    expected = {(f[0], f[1], f[2], f[3]): (f[4], f[5], f[6]) for f in fold(rows, False)}
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (5, 1 << 16):
        got = stream.attempts(stream.sessions(df, chunk), chunk).collect()
        assert {(r.source_id, r.head, r.site, r.open_seq): (r.part_sequence, r.close_seq, r.tests) for r in got} == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_open_wafers_match_a_fold(spark, seed):
    rows = random_stream(seed)
    found = fold(rows, False)
    expected = {(f[0], f[1], f[2], f[3]): None if f[7] is None else f[9][f[7]] for f in found}
    df = spark.createDataFrame(rows, SCHEMA)
    probes = spark.createDataFrame([tuple(f[:4]) for f in found], "source_id string, head int, site long, seq long")
    got = stream.open_wafers(df, probes, chunk_rows=9).collect()
    assert {(r.source_id, r.head, r.site, r.seq): r.wafer_seq for r in got} == expected


@pytest.mark.parametrize("seed, free", [(6, False), (7, False), (8, True), (9, True), (10, True)])
def test_late_wafers_match_a_fold(spark, seed, free):
    rows = random_stream(seed, 800 if free else 400, free=free)
    found = fold(rows, True)
    expected = {
        (f[0], f[1], f[2], f[3]): (None if f[7] is None else f[8][f[7]], "ambiguous_wafer" if f[7] is None else None) for f in found
    }
    df = stream.number_runs(spark.createDataFrame(rows, SCHEMA), chunk_rows=50)
    probes = spark.createDataFrame([tuple(f[:4]) for f in found], "source_id string, head int, site long, seq long")
    probes = probes.join(df.select("source_id", "seq", "run"), ["source_id", "seq"])
    got = stream.late_wafers(df, probes, 11).collect()
    assert {(r.source_id, r.head, r.site, r.seq): (r.wafer, r.wafer_issue) for r in got} == expected


def test_text_belongs_to_the_only_open_unit(spark):
    kinds = ["PIR", "DTR", "PIR", "DTR", "PRR", "DTR", "PRR", "DTR"]
    sites = [1, 0, 2, 0, 1, 0, 2, 0]
    df = spark.createDataFrame([("s", i, k, 1, s) for i, (k, s) in enumerate(zip(kinds, sites))], "source_id string, seq long, kind string, head int, site int")
    got = {r.seq: (r.open_count, r.unit_seq) for r in stream.assign_records(df, chunk_rows=2).collect()}
    assert got == {1: (1, 0), 3: (2, None), 5: (1, 2), 7: (0, None)}


@pytest.mark.parametrize("seed", [11, 12])
def test_record_owners_match_a_fold(spark, seed):
    rng, rows, expected = random.Random(seed), [], {}
    for source in ("A", "B"):
        run, active = 0, {}
        for seq in range(0, 900, 3):
            kind = rng.choice(["PIR", "PIR", "PRR", "PRR", "PTR", "DTR", "GDR", "ATER", "CTRR", "CTSR"] if rng.random() > 0.02 else ["MIR"])
            head, site = rng.choice([(1, 0), (1, 1), (2, 0)])
            if kind in ("ATER", "CTRR") and rng.random() < 0.1:
                site = None
            if kind == "MIR":
                run += 1
                active = {}
            if kind == "PIR":
                active[head, site] = seq
            elif kind == "PRR":
                active.pop((head, site), None)
            elif kind in ("DTR", "GDR"):
                expected[source, seq] = (kind, "only_open_unit", *active.values()) if len(active) == 1 else (kind, "unresolved", None)
            elif kind in ("ATER", "CTRR"):
                unit = active.get((head, site))
                expected[source, seq] = (kind, "unresolved" if unit is None else "explicit_head_site", unit)
            plain = kind in ("MIR", "DTR", "GDR", "CTSR")
            rows.append((source, run, seq, kind, None if plain else head, None if plain else site))
    df = spark.createDataFrame(rows, "source_id string, run int, seq long, kind string, head int, site long")
    for chunk in (40, 1 << 16):
        got = stream.record_owners(df, chunk).collect()
        assert {(r.source_id, r.seq): (r.kind, r.ownership, r.unit_seq) for r in got} == expected and len(got) == len(expected)
    assert stream.record_owners(df.limit(0)).count() == 0


def test_first_definition_is_inherited(spark):
    rows = [  # seq, opt, lo, hi, lo_spec, units
        (1, 0, 1.0, 9.0, 0.5, "V"), (2, 0x10, 5.0, 8.0, 0.5, ""), (3, 0x50, 5.0, 8.0, 0.7, None), (4, None, None, None, None, "mV"), (5, 0x80, 2.0, 7.0, None, "\x00"),
    ]
    df = spark.createDataFrame(
        [("s", 1, "PTR", 7, *r[:5], None, r[5]) for r in rows],
        "source_id string, run int, kind string, test_num int, seq int, opt_flag int, lo_limit double, hi_limit double, lo_spec double, hi_spec double, units string",
    )
    got = {r.seq: r for r in stream.inherit_definitions(df).collect()}
    assert [got[i].lo_limit for i in range(1, 6)] == [1.0, 1.0, None, 1.0, 2.0]
    assert [got[i].hi_limit for i in range(1, 6)] == [9.0, 8.0, 8.0, 9.0, None]
    assert [got[i].lo_limit_status for i in range(1, 6)] == ["valid", "valid", "missing", "valid", "valid"]
    assert [got[i].lo_spec_status for i in range(1, 6)] == ["valid", "valid", "invalid", "valid", "valid"]
    assert [got[i].units for i in range(1, 6)] == ["V", "V", "V", "mV", ""]


def test_section_depth_never_drops_below_zero(spark):
    kinds = ["EPS", "BPS", "BPS", "EPS", "EPS", "EPS", "BPS"]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "source_id string, seq long, kind string")
    for chunk in (2, 100):
        depth = quality.clamped_depth(df, "BPS", "EPS", chunk).orderBy("seq").collect()
        assert [(r.depth, r.unmatched) for r in depth] == [(0, True), (1, False), (2, False), (1, False), (0, False), (0, True), (1, False)]
        found = sorted((r.record_type, r.seq) for r in quality.section_balance(df, chunk).collect())
        assert found == [("BPS", 6), ("EPS", 0), ("EPS", 5)]
    assert df.filter(F.col("kind") == "BPS").count() == 3
