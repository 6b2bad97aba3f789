import random
import re

from testfloor.llm import neardup


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÑANDÚ"]
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 30, 60, 90]))]
        texts.append(words)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    for k in (2, 5):
        assert {tuple(r) for r in neardup.groups(docs, k=k).collect()} == brute(rows, k, 80)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.groups(spark.createDataFrame([], schema)).count() == 0
    rows = neardup.groups(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], schema)).collect()
    assert sorted(r.kept for r in rows) == [True] * 4


def test_members_no_centre_is_like(spark):
    """Texts that share a long passage meet in buckets without being alike; pairs among them still link."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    shared, rows = [word() for _ in range(120)], []
    for i in range(0, 80, 2):
        own = [word() for _ in range(60)]
        rows += [(i, " ".join(shared + own)), (i + 1, " ".join(shared + own[:-3]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.groups(docs, k=2).collect()} == brute(rows, 2, 80)


def test_texts_that_cancel_in_linear_hashes(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, " ".join(one), " ".join(other), "x " * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {tuple(r) for r in neardup.groups(docs, k=2).collect()}
    assert {r for r in rows if r[0] < 2} == {(0, 1, 0, True), (1, 1, 1, True)}
    assert (4, 1, 4, True) in rows


def test_all_links_of_the_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got, want = {tuple(r) for r in neardup.groups(docs, k=2).collect()}, brute(rows, 2, 80)
    assert len(got & want) >= 0.99 * len(want) and {r[:2] for r in got} == {r[:2] for r in want}
