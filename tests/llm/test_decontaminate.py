import itertools
import random
import re

from testfloor.llm import decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def seeded(a, b):
    """Diagonals on which some mask's words are equal."""
    found = set()
    for mask in decontaminate.MASKS:
        picked = [i for i, c in enumerate(mask) if c == "1"]
        grams = lambda w: [tuple(w[p + i] for i in picked) for p in range(len(w) - len(mask) + 1)]  # noqa: E731, B023
        found |= {i - j for i, x in enumerate(grams(a)) for j, y in enumerate(grams(b)) if x == y}
    return found


def best(a, b, d, penalty=4):
    low, high = max(0, -d), min(len(b), len(a) - d)
    top = (0, 0)
    for i in range(low, high):
        score = same = 0
        for j in range(i, high):
            hit = a[j + d] == b[j]
            score, same = score + (1 if hit else -penalty), same + hit
            if score > top[0]:
                top = (score, same)
    return top[1]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, pick(rng.choice([4, 9, 15, 30, 50]))) for i in range(20)]
    docs = []
    for d in range(80):
        w = pick(rng.choice([0, 20, 60]))
        if d % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "changed"
            w = w + part[rng.randint(0, 5) :] + pick(10)
        docs.append((d, w))
    expected = set()
    for d, w in docs:
        for i, v in items:
            if any(best(w, v, g) >= min(10, len(v)) for g in seeded(w, v)):
                expected.add((d, i))
    left = spark.createDataFrame([(d, ", ".join(w).upper(), 1) for d, w in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontaminate.overlaps(left, right).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
    by_doc, by_item = dict(docs), dict(items)
    for r in rows:
        a = by_doc[r.doc_id][r.doc_word : r.doc_word + r.n_span]
        b = by_item[r.item_id][r.item_word : r.item_word + r.n_span]
        assert len(a) == len(b) == r.n_span and sum(x == y for x, y in zip(a, b)) == r.n_equal >= 0.8 * r.n_span


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    text = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text)], schema)
    items = spark.createDataFrame([(7, text), (8, None), (None, text), (9, "")], "item_id long, text string")
    rows = decontaminate.overlaps(docs, items).collect()
    assert [tuple(r) for r in rows] == [(1, 7, 0, 0, 20, 20)]
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_masks_hit_every_accepted_substitution():
    """All places of up to five changes: an accepted overlap has a diagonal hit."""
    picked = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS if m.count("1") == 8]
    accepted = 0
    for n in range(10, 21):
        for changes in range(5):
            for places in itertools.combinations(range(n), changes):
                copy = [i not in places for i in range(n)]
                if best(copy, [True] * n, 0) >= 10:
                    accepted += 1
                    assert any(all(copy[p + i] for i in m) for m in picked for p in range(n - m[-1])), (n, places)
    assert accepted > 1000


def test_overlaps_equal_brute_force_over_all_diagonals(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, pick(n)) for i, n in enumerate([*range(1, 14), 13, 16, 16, 20, 30])]
    changed = [("w0", "w6"), ("w5",), ("w4", "w11"), ()]
    docs = []
    for d in range(160):
        part = list(items[d % len(items)][1])
        for place in changed[d % 4] if d < 100 else rng.sample(range(30), 4):
            at = int(str(place).lstrip("w"))
            if at < len(part):
                part[at] = "changed"
        docs.append((d, pick(rng.choice([0, 7, 30])) + part + pick(rng.choice([0, 8])) + part[:3]))
    expected = set()
    for d, w in docs:
        for i, v in items:
            if any(best(w, v, g) >= min(10, len(v)) for g in range(1 - len(v), len(w))):
                expected.add((d, i))
    left = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    right = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontaminate.overlaps(left, right).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
    by_doc, by_item = dict(docs), dict(items)
    for r in rows:
        if len(by_item[r.item_id]) < 9:  # a whole item, at its first place
            n, w = len(by_item[r.item_id]), by_doc[r.doc_id]
            assert r.doc_word == next(p for p in range(len(w)) if w[p : p + n] == by_item[r.item_id])
            assert (r.item_word, r.n_span, r.n_equal) == (0, n, n)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x one two three y one two three"), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "c"), (3, "h a")], "item_id long, text string")
    rows = decontaminate.overlaps(docs, items).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 2, 0, 1, 1), (2, 1, 1, 0, 3, 3)]
