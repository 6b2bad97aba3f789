"""Logs framed in blocks against a walk from the first byte to the last."""

import gzip
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from testfloor.sources import framing, stdf

FAR = {False: bytes.fromhex("0200000A0204"), True: bytes.fromhex("0002000A0104")}


def record(length, big, typ=99, fill=b"\x01"):
    return length.to_bytes(2, "big" if big else "little") + bytes([typ, 1]) + (fill * length)[:length]


def walk(data, big):
    """(offset, length) of every record, and whether bytes are left over."""
    at, found = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 2], "big" if big else "little")
        if at + 4 + n > len(data):
            break
        found.append((at, n))
        at += 4 + n
    return found, at < len(data)


def log(seed, big, n, longest, cut=0):
    rng = random.Random(seed)
    parts = [record(rng.randrange(longest), big, fill=bytes([rng.randrange(256), rng.randrange(4), rng.randrange(256)])) for _ in range(n)]
    data = FAR[big] + b"".join(parts)
    return data[: len(data) - cut] if cut else data


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400), st.booleans(), st.integers(1, 60))
def test_maps_of_any_bytes(data, big, block):
    """A map says of every entry what following the chain says, and the maps of parts compose to that of the whole."""
    cut = lambda a, b: framing.transition(data[a : min(len(data), b + framing.REACH)], b - a, len(data) - a, big)
    whole = cut(0, len(data))
    for entry in range(len(data)):
        edges, problem = framing.chain(data, entry, len(data), len(data), big)
        assert whole[0][entry] == (-1 if problem else edges[-1] - len(data)) and whole[1][entry] == len(edges) - 1
    bounds = [*range(0, len(data), block), len(data)]
    parts = framing.compose(cut(a, b) for a, b in zip(bounds, bounds[1:]))
    assert (parts[0][: len(data)] == whole[0][: len(data)]).all() and (parts[1] == whole[1]).all()


@pytest.mark.parametrize("few", [0, 24, 10**9])
def test_maps_over_windows(monkeypatch, few):
    """Blocks of several windows, with chains followed one by one or by doubling."""
    monkeypatch.setattr(framing, "FEW", few)
    data = log(5, False, 1500, 900)
    exits, counts = framing.transition(data[: 400_000 + framing.REACH], 400_000, len(data), False)
    rng = np.random.RandomState(1)
    for entry in [0, 1, 5, 6, framing.REACH - 1, *rng.randint(0, framing.REACH, 60)]:
        edges, problem = framing.chain(data, int(entry), 400_000, len(data), False)
        assert (exits[entry], counts[entry]) == (-1 if problem else edges[-1] - 400_000, len(edges) - 1)


def test_blocks_equal_the_walk(spark, tmp_path):
    logs = {
        "small": log(1, False, 40, 30), "big": log(2, True, 300, 60), "cut": log(3, False, 200, 90, 7), "tail": log(4, True, 50, 9) + b"\x00",
        "long": FAR[False] + record(65_535, False) + record(3, False) + record(65_535, False), "one": FAR[True], "none": b"", "junk": b"no log at all",
        "zeros": FAR[False] + bytes(4000), "early": log(6, False, 20, 20) + record(60_000, False)[:5000],
    }
    for name, data in logs.items():
        (tmp_path / f"{name}.stdf").write_bytes(data)
        (tmp_path / f"{name} packed.std.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    files = spark.createDataFrame([(f"file:{p}",) for p in tmp_path.iterdir()] + [(None,)], "path string")
    prepared = framing.prepare(files)
    for block, group in ((700, 6), (1 << 20, 64)):
        rows = stdf.frames(prepared, block_bytes=block, group=group).collect()
        paths = {r.source_id: r.path for r in rows if r.path}
        by = {}
        for r in sorted(rows, key=lambda r: r.record_seq):
            by.setdefault(paths[r.source_id].rsplit("/", 1)[1].split(".")[0].removesuffix(" packed"), {}).setdefault(r.source_id, []).append(r)
        assert sorted(by) == sorted(logs)
        for name, data in logs.items():
            big = framing.byte_order(data[:6])
            expected, left = walk(data, big) if big is not None else ([], True)
            for found in by[name].values():
                good = [r for r in found if r.kind != "FRAME_ERROR"]
                assert [(r.offset, r.rec_len) for r in good] == expected, (name, block)
                assert [r.record_seq for r in found] == list(range(len(found))) and len(found) - len(good) == left
                assert all(bytes(r.body) == data[r.offset + 4 : r.offset + 4 + r.rec_len] for r in good)
                assert found[0].content_sha256 and all(r.content_sha256 is None for r in found[1:])
            assert len(by[name]) == 2


def test_copies_are_dropped_before_framing(spark, tmp_path):
    data = log(1, False, 40, 30)
    for name, content in (("a.stdf", data), ("b.stdf.gz", gzip.compress(data)), ("c.std", data + b"\x00")):
        (tmp_path / name).write_bytes(content)
    prepared = framing.prepare(stdf.discover(spark, [str(tmp_path)]))
    kept = stdf.frames(prepared, unique=True)
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept.filter("path is not null").collect()) == ["a.stdf", "c.std"]


def test_inflating_in_steps(monkeypatch):
    """Bounded steps give what inflating at once gives, also for bytes that shrink to almost nothing."""
    monkeypatch.setattr(framing, "STEP", 1000)
    data = bytes(300_000) + random.Random(1).randbytes(20_000)
    packed = gzip.compress(data) + gzip.compress(b"") + gzip.compress(data[:77])
    steps = lambda x, n: (x[i : i + n] for i in range(0, len(x), n))
    for n in (1, 7, 100_000):
        problems, pieces = [], list(framing.inflated(steps(packed, n), problems := []))
        assert b"".join(pieces) == data + data[:77] and not problems and max(map(len, pieces)) <= 1000
    for cut, told in ((packed[:-3], "truncated gzip stream"), (packed + b"junk", "gzip: "), (packed[:200] + b"\xff" * 50 + packed[250:], "gzip: ")):
        problems = []
        list(framing.inflated(steps(cut, 64), problems))
        assert problems and problems[0].startswith(told)
