"""Maps of blocks as they are stored between the rounds of composing."""

import random
import struct

import pyarrow as pa

from testfloor.session import materialize
from testfloor.sources import framing


def test_stored_maps_are_short_and_whole_again():
    """A map takes the room of its blocks, cut into pieces of bounded size, and says the same when read."""
    data = b"".join(struct.pack("<HBB", n, 5, 10) + bytes(n) for n in (7, 300, 2000, 40, 5000) * 4)
    maps = [framing.transition(data[a: a + 8192 + framing.REACH], min(8192, len(data) - a), len(data) - a, False) for a in range(0, len(data), 8192)]
    sizes = [min(8192, len(data) - a) for a in range(0, len(data), 8192)]
    rows = [framing._map_rows("s", i, size, *m) for i, (size, m) in enumerate(zip(sizes, maps))]
    assert sum(r.nbytes for r in rows) < 13 * len(data) and all(len(x) <= framing.PIECE for r in rows for x in r.column("exits"))
    table = pa.Table.from_batches(rows[::-1])
    for (block, size, exits, counts), (wanted, passed) in zip(framing._sorted_maps(table), maps, strict=True):
        assert size == sizes[block] and (exits == wanted).all() and (counts == passed).all()
    both = framing._compose((pa.scalar("s"), pa.scalar(0)), table)
    (_, length, exits, counts), whole = next(framing._sorted_maps(both)), framing.compose(iter(maps))
    assert length == len(data) and (exits == whole[0]).all() and (counts == whole[1]).all()


def test_maps_of_short_blocks_are_composed_where_they_are_read(spark, tmp_path, monkeypatch):
    """Of blocks of 1 KB only the maps of groups are stored, and every block is entered where a walk enters it."""
    rng = random.Random(3)
    kept, sizes = [], {}
    monkeypatch.setattr(framing, "materialize", lambda df, label: kept.append((label, materialize(df, label))) or kept[-1][1])
    for name, n in (("a", 400), ("b", 40), ("c", 3)):
        data = bytes.fromhex("0200000A0204") + b"".join(struct.pack("<HBB", k, 5, 10) + rng.randbytes(k) for k in (rng.choice([7, 30, 200, 3000]) for _ in range(n)))
        (tmp_path / name).write_bytes(data[:-3] if name == "b" else data)
        sizes[name] = len(data) - 3 * (name == "b")
    prepared = framing.prepare(spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in sizes], "path string"))
    found = {(r.path[-1], r.block): (r.entry, r.number) for r in framing.locate(prepared, 1024, 4).collect()}
    for name, size in sizes.items():
        edges, problem = framing.chain((tmp_path / name).read_bytes(), 0, size, size, False)
        for block in range(-(-size // 1024)):
            after = [i for i, at in enumerate(edges) if at >= block * 1024]
            expected = (edges[after[0]] - block * 1024, after[0]) if after else (-1, len(edges) - 1)
            assert found[name, block] == expected
    maps = [df for label, df in kept if label == "maps"]
    assert max(r.length for r in maps[0].collect()) == 4096  # a row per group and piece, none per block
