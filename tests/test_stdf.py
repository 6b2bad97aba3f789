"""Reading test logs: small files byte by byte, whole files, and damaged ones."""

import gzip
import struct
import tempfile

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from testfloor.operators import quality, stream
from testfloor.plans.stdf_files import Writer
from testfloor.sources import eav, framing, stdf, tables

FAR = bytes.fromhex("0200000A0204")
PIR = bytes.fromhex("0200050A0100")
PTR = bytes.fromhex("0C000F0AE903000001000000 00005040".replace(" ", ""))
PRR = bytes.fromhex("090005140100000100010001 00".replace(" ", ""))


def written(spark, **files):
    folder = tempfile.mkdtemp(prefix="logs-")
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)
    return spark.createDataFrame([(f"file:{folder}/{name}",) for name in files], "path string")


def frames(spark, **files):
    return stdf.frames(written(spark, **files))


def name_of(path):
    return path.rsplit("/", 1)[1]


def kinds(df):
    return [(r.kind, r.offset) for r in df.orderBy("record_seq").collect()]


def test_minimal_files_in_both_byte_orders(spark):
    df = frames(spark, le=FAR, be=bytes.fromhex("0002000A0104"))
    rows = {name_of(r.path): (r.kind, r.big_endian) for r in df.collect()}
    assert rows == {"le": ("FAR", False), "be": ("FAR", True)}


def test_flow_of_one_part(spark):
    framed = frames(spark, flow=FAR + PIR + PTR + PRR)
    assert [k for k, _ in kinds(framed)] == ["FAR", "PIR", "PTR", "PRR"]
    ptr = stdf.decode(framed, "PTR").first()
    assert (ptr.test_num, ptr.head_num, ptr.site_num, ptr.result, ptr.test_txt) == (1001, 1, 0, 3.25, None)
    rows = eav.convert(stdf.decode_events(framed)).rows.collect()
    assert len(rows) == 1 and rows[0].part_pass and rows[0].part_id == "H1_S0_P1" and rows[0].result == 3.25 and rows[0].hard_bin == 1


def test_cut_body_keeps_earlier_records(spark):
    framed = frames(spark, cut=FAR + bytes.fromhex("0A000F0A0102"))
    assert kinds(framed) == [("FAR", 0), ("FRAME_ERROR", 6)]


def test_unknown_record_is_kept(spark):
    framed = frames(spark, vendor=FAR + bytes.fromhex("0300634D414243"))
    row = framed.filter("typ = 99").first()
    assert row.kind == "UNKNOWN_99_77" and bytes(row.body) == b"ABC" and row.error is None


def test_compressed_and_broken_files(spark):
    whole = FAR + PIR + PRR
    packed = gzip.compress(whole)
    framed = frames(spark, a=packed, b=packed[:-12], c=b"not a log", d=b"", e=whole + b"\x01")
    ids = {name_of(r.path): r.source_id for r in framed.filter("path is not null").collect()}
    count = lambda name: [r.kind for r in framed.filter(f"source_id = '{ids[name]}'").orderBy("record_seq").collect()]
    assert count("a") == ["FAR", "PIR", "PRR"]
    assert count("b")[-1] == "FRAME_ERROR"
    assert count("c") == ["FRAME_ERROR"] and count("d") == ["FRAME_ERROR"]
    assert count("e") == ["FAR", "PIR", "PRR", "FRAME_ERROR"]


def test_copies_count_once(spark):
    unique = stdf.unique_content(frames(spark, a=FAR + PIR, b=gzip.compress(FAR + PIR), c=FAR))
    assert sorted(name_of(r.path) for r in unique.filter("record_seq = 0").collect()) == ["a", "c"]


def multi(order):
    w = Writer(order == ">")
    w.header()
    w.add(15, 15, w.pack("IBBB", 7, 1, 2, 0), b"\x00", w.pack("HH", 3, 2), b"\x21\x03", w.pack("ff", 1.5, -2.5), w.text("multi"))
    w.add(15, 15, w.pack("IBBB", 8, 1, 2, 0), b"\x00", w.pack("HH", 0, 0), w.text(""))
    w.add(1, 63, w.pack("H", 2), w.pack("HH", 5, 6), w.pack("HH", 1, 2), bytes([3, 4]), w.text("a"), w.text("bc"))
    w.add(5, 20, w.pack("BBBHHHhhI", 1, 2, 8, 1, 9, 90, -5, 7, 33), w.text("né"), w.text(""), bytes([2, 1, 2]))
    w.add(15, 20, w.pack("IBBBB", 6, 1, 2, 0, 0), w.pack("IIIIiihHH", 1, 2, 3, 4, -1, -2, -3, 2, 1), w.pack("HH", 8, 9), b"\x43", w.pack("H", 4), b"\x05", w.pack("H", 12), b"\xff\x0f", w.text("vec"))
    w.add(50, 10, w.pack("H", 3), b"\x00\x0a", w.text("hi"), b"\x07", w.pack("f", 0.5))
    return w.content()


def test_arrays_in_both_byte_orders(spark):
    for order in "<>":
        framed = frames(spark, f=multi(order))
        first, second = stdf.decode(framed, "MPR").orderBy("record_seq").collect()
        assert (first.rtn_stat, first.rtn_rslt, first.test_txt) == ([1, 2, 3], [1.5, -2.5], "multi")
        assert (second.rtn_stat, second.rtn_rslt, second.test_txt) == ([], [], "")
        plr = stdf.decode(framed, "PLR").first()
        assert (plr.grp_indx, plr.grp_mode, plr.grp_radx, plr.pgm_char, plr.rtn_char) == ([5, 6], [1, 2], [3, 4], ["a", "bc"], None)
        prr = stdf.decode(framed, "PRR").first()
        assert (prr.x_coord, prr.y_coord, prr.test_t, prr.part_id, prr.part_txt, bytes(prr.part_fix)) == (-5, 7, 33, "né", "", b"\x01\x02")
        ftr = stdf.decode(framed, "FTR").first()
        assert (ftr.rtn_indx, ftr.rtn_stat, ftr.pgm_indx, ftr.pgm_stat, ftr.vect_nam) == ([8, 9], [3, 4], [4], [5], "vec")
        assert (ftr.fail_pin.bit_count, bytes(ftr.fail_pin.bytes)) == (12, b"\xff\x0f")
        gdr = stdf.decode(framed, "GDR").first()
        assert [(v.kind, v.value) for v in gdr.gen_data] == [("PAD", None), ("Cn", "hi"), ("R4", "0.5")]


def test_event_records_keep_their_bytes(spark):
    w = Writer()
    w.header()
    w.add(137, 10, w.text("EVENT"), w.text("handler"), bytes([1, 2]), bytes([3, 0xFF, 0x00, 0x41]))
    row = stdf.decode(frames(spark, f=w.content()), "ATER").first()
    assert (row.rec_custm, row.head_num, row.site_num, bytes(row.activity_bytes)) == ("EVENT", 1, 2, b"\xff\x00A")


def test_short_record_is_reported_at_its_field(spark):
    body = struct.pack("<HBB", 7, 15, 10) + struct.pack("<IBBB", 5, 1, 0, 0)
    framed = frames(spark, f=FAR + body)
    row = stdf.decode(framed, "PTR").first()
    assert row.decode_error == "unexpected end of record at PARM_FLG" and row.test_num == 5 and row.result is None
    states = {r.field: r.presence for r in stdf.field_evidence(framed).filter("record = 'PTR'").collect()}
    assert (states["TEST_FLG"], states["PARM_FLG"], states["RESULT"], states["TEST_TXT"]) == ("present", "truncated", "unread", "unread")


def test_events_of_files_and_of_stored_records_agree(spark):
    short = struct.pack("<HBB", 7, 15, 10) + struct.pack("<IBBB", 5, 1, 0, 0)
    files = written(spark, a=multi("<"), b=multi(">"), c=FAR + PIR + short + b"\x01")
    direct, staged = stdf.read_events(files), stdf.decode_events(stdf.stored(stdf.frames(files)))
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(direct) == key(staged)
    kinds = [r.kind for r in direct.filter(F.col("source_id") == direct.filter("path like '%/c'").first().source_id).orderBy("seq").collect()]
    assert kinds == ["FAR", "PIR", "DECODE_ERROR", "FRAME_ERROR"]
    mpr = direct.filter("kind = 'MPR' and test_num = 7").first()
    assert (mpr.rtn_rslt, mpr.rtn_stat, mpr.site) == ([1.5, -2.5], [1, 2, 3], 2)


def flow_log(cut=0):
    w = Writer()
    w.header()
    optional = ["", "", "", "", "P", "25"] + [""] * 11 + ["F1"]
    w.add(1, 10, w.pack("II", 5, 0), b"\x01P  ", w.pack("H", 65535), b" ", *map(w.text, ["LOT", "D", "N", "T", "JOB", "r1", *optional]))
    generic = lambda *texts: [w.pack("H", 1 + len(texts)), b"\x00", *[b"\x0a" + w.text(t) for t in texts]]
    w.add(50, 10, *generic("SHMOO", "0x1f", "n"))
    w.add(5, 10, bytes([1, 3]))
    w.add(50, 10, *generic("MARGIN_RESULT", "31", "1", "3", "t", "c", "i", "P"))
    w.add(50, 10, *generic("something else"))
    w.add(50, 30, w.text("inside"))
    w.add(5, 20, w.pack("BBBHHHhhI", 1, 3, 0, 0, 1, 1, 4, 5, 7), w.text("u"))
    w.add(1, 40, w.pack("BBHI", 255, 255, 1, 2), b"P", w.text("good"))
    w.add(1, 20, w.pack("I", 77))
    return w.content()[: len(w.content()) - cut]


def test_runs_owners_and_errors_of_a_log(spark):
    built = tables.build(stdf.read_events(written(spark, whole=flow_log(), cut=flow_log(3))))
    runs = {name_of(r.path): (r.run, r.lot_id, r.job_nam, r.job_rev, r.test_cod, r.tst_temp, r.flow_id, r.start_t, r.finish_t) for r in built.runs.collect()}
    same = (1, "LOT", "JOB", "r1", "P", "25", "F1", None)
    assert runs == {"whole": (*same, 77), "cut": (*same, None)}
    assert [(name_of(r.path), r.kind, r.error) for r in built.errors.collect()] == [("cut", "FRAME_ERROR", "unexpected end of file in record body")]
    assert built.attempts.count() == 2
    kinds = [(r.kind, r.char_id, r.head, r.site) for r in built.events.filter("char_id is not null").orderBy("source_id", "seq").collect()]
    assert kinds == [("CTSR", 31, None, None), ("CTRR", 31, 1, 3)] * 2
    owned = {(r.kind, r.ownership) for r in stream.record_owners(built.events).collect()}
    assert owned == {("CTRR", "explicit_head_site"), ("GDR", "only_open_unit"), ("DTR", "only_open_unit")}
    bins = built.events.filter("kind = 'HBR'").select("bin", "bin_count", "bin_name").distinct().collect()
    assert [tuple(b) for b in bins] == [(1, 2, "good")]


def test_fields_take_what_the_first_record_defined(spark):
    w = Writer()
    w.header()
    w.add(1, 10, w.pack("II", 5, 6), b"\x01P  ", w.pack("H", 65535), b" ", *map(w.text, ["LOT", "D", "N", "T", "JOB"]))

    def ptr(number, tail=b"", flg=0, parm=0):
        w.add(15, 10, w.pack("IBBBB", number, 1, 0, flg, parm), w.pack("f", 1.5), w.text("t"), w.text(""), tail)

    def tail(opt, lo, hi, units, *specs):
        return bytes([opt, 1, 2, 3]) + w.pack("ff", lo, hi) + w.text(units) + w.text("") * 3 + (w.pack("ff", *specs) if specs else b"")

    ptr(1, tail(0, 1, 9, "V", 0.5, 9.5)), ptr(1), ptr(1, tail(0x30, 5, 6, "", 0.5, 9.0)), ptr(1, tail(0x51, 5, 6, "\x00", 0.5, 9.5), flg=0x10), ptr(2), ptr(2, tail(0x10, 5, 6, "A"), parm=4)
    add = lambda number, icnt, extra: w.add(15, 15, w.pack("IBBB", number, 1, 0, 0), b"\x00", w.pack("HH", icnt, 0), b"\x00" * ((icnt + 1) // 2), w.text("m"), extra)
    multi_tail = lambda n: w.text("") + bytes([0, 0, 0, 0]) + w.pack("ffff", 1, 2, 3, 4) + w.pack("H" * n, *range(n))
    add(7, 2, multi_tail(2)), add(7, 2, b""), add(7, 3, b"")
    w.add(1, 10, w.pack("II", 5, 6), b"\x01P  ", w.pack("H", 65535), b" ", *map(w.text, ["LOT", "D", "N", "T", "JOB"]))
    ptr(1)  # another run has no definition yet
    files = written(spark, a=w.content())
    events = stream.number_runs(stdf.read_events(files)).select("source_id", F.col("seq").alias("record_seq"), "run")
    checked = quality.field_status(stdf.field_evidence(stdf.frames(files)))
    rows = quality.resolved_status(checked, events).collect()
    assert len(rows) == checked.count()
    got = {(r.record_seq, r.field): (r.status, r.eff_number if r.eff_text is None else r.eff_text, r.inherited_from) for r in rows}
    at = lambda seq, *fields: [got[seq, f] for f in fields]
    assert at(2, "LO_LIMIT", "UNITS", "HI_SPEC") == [("valid", 1.0, None), ("valid", "V", None), ("valid", 9.5, None)]
    assert at(3, "LO_LIMIT", "HI_LIMIT", "UNITS", "HI_SPEC", "RES_SCAL") == [("valid", 1.0, 2), ("valid", 9.0, 2), ("valid", "V", 2), ("valid", 9.5, 2), ("valid", 1.0, 2)]
    assert at(4, "LO_LIMIT", "UNITS", "LO_SPEC", "HI_SPEC") == [("valid", 1.0, 2), ("valid", "V", 2), ("valid", 0.5, None), ("invalid", None, None)]
    assert at(5, "LO_LIMIT", "HI_LIMIT", "UNITS", "RES_SCAL", "RESULT") == [("missing", None, None), ("valid", 6.0, None), ("valid", "", None), ("valid", 1.0, 2), ("unknown", None, None)]
    assert at(6, "LO_LIMIT", "UNITS") == [("unknown", None, None), ("missing", None, None)]
    assert at(7, "LO_LIMIT", "HI_LIMIT", "UNITS", "RESULT") == [("unknown", None, None), ("valid", 6.0, None), ("valid", "A", None), ("unknown", None, None)]
    assert at(8, "RTN_INDX", "START_IN", "OPT_FLAG") == [("valid", "[0, 1]", None), ("valid", 3.0, None), ("valid", 0.0, None)]
    assert at(9, "RTN_INDX", "START_IN", "OPT_FLAG", "LO_LIMIT") == [("valid", "[0, 1]", 8), ("valid", 3.0, 8), ("valid", 0.0, 8), ("valid", 1.0, 8)]
    assert at(10, "RTN_INDX")[0] == ("invalid", None, None)
    assert at(12, "LO_LIMIT", "UNITS") == [("unknown", None, None), ("missing", None, None)]


def test_padding_and_trailing_bytes(spark):
    w = Writer()
    w.header()
    w.add(15, 15, w.pack("IBBB", 7, 1, 2, 0), b"\x00", w.pack("HH", 1, 0), b"\xf1")
    w.add(5, 10, bytes([1, 2, 9, 9]))
    fields = stdf.field_evidence(frames(spark, f=w.content())).collect()
    assert [f.bad_padding for f in fields if f.field == "RTN_STAT"] == [True]
    assert [(f.record, f.byte_start, f.byte_len) for f in fields if f.field == "__TRAILING_BYTES"] == [("PIR", 6, 2)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_give_rows_not_errors(content):
    class Held(framing.Ranges):
        def read(self, uri, start, stop):
            return (FAR + content)[start:stop]

    size = 6 + len(content)
    row = dict(source_id="s", path="p", plain="p", size=size, content_sha256="", big_endian=False, stopped=None, start=0, stop=size, entry=0, number=0)
    batches = list(stdf._framed(row, Held()))
    kept = [r for b in batches for r in b.to_pylist()]
    assert kept[0]["kind"] == "FAR"
    for b in batches:
        for kind in set(b.column(8).to_pylist()) & set(stdf.layouts()):
            part = b.filter(__import__("pyarrow").compute.equal(b.column(8), kind))
            columns, _ = stdf._walk(kind, part.column(10), part.column(9).to_numpy(zero_copy_only=False), 4)
            assert all(len(c.values) == part.num_rows for c in columns)
            for c in columns:
                c.values.validate(full=True)


def test_events_are_stored_once(spark):
    built = tables.build(stdf.read_events(written(spark, whole=flow_log())))
    again = tables.stored(built)
    assert again.events is built.events and all("numbered-records" in f for f in again.events.inputFiles())
    assert again.attempts.collect() == built.attempts.collect()
