import random

from testfloor.llm import differences, neardup
from tests.llm.test_neardup import brute


def near_misses(n, words, edits, seed):
    """Copies of one text whose own edits leave most pairs just below the similarity."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for place in rng.sample(range(words), rng.choice(edits)):
            text[place] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(text)))
    return rows


def sets_of(spark, rows, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.mapInArrow(neardup._sets(k), "doc_id long, elements array<long>")


def test_links_of_a_family_equal_brute_force(spark):
    rows = near_misses(90, 60, [1, 3, 5, 6, 7, 8], 1) + [(1000 + i, t) for i, t in near_misses(60, 90, [6, 9, 10, 11], 2)]
    rows += [(2000 + i, t.replace("w", "v")) for i, t in near_misses(40, 60, [2, 6, 8], 3)]
    rows += [(0, rows[95][1]), (1, rows[1][1])]  # two texts of a doc_id, and a repeated row
    for percent in (60, 80):
        members = sets_of(spark, rows, 2).selectExpr("0L as family", "doc_id as component", "doc_id", "elements")
        links = differences.family_links(members, percent).collect()
        texts = dict(enumerate(text for _, text in rows))
        own = {i: doc for i, (doc, _) in enumerate(rows)}
        root = {i: r for i, _, r, _ in brute(list(texts.items()), 2, percent)}
        want = [{own[i], own[root[i]]} for i in texts]
        assert merged(links, own) == merged(want, own)


def merged(links, own):
    groups = {doc: {doc} for doc in own.values()}
    for a, b in links if not links or not isinstance(links[0], set) else [(min(x), max(x)) for x in links]:
        both = groups[a] | groups[b]
        for doc in both:
            groups[doc] = both
    return {doc: min(group) for doc, group in groups.items()}


def test_members_that_just_miss_are_not_all_compared(spark):
    """600 copies, of which a third are like no other: all pairs of them would be 100,000 and more."""
    rows = near_misses(400, 120, [2, 4, 6], 4) + [(1000 + i, t) for i, t in near_misses(200, 120, [14, 15], 5)]
    members = sets_of(spark, rows, 2).selectExpr("0L as family", "doc_id as component", "doc_id", "elements")
    apart, shared = differences.differences(members)
    gapped = differences._gaps(apart, 80)
    pairs = differences.candidates(gapped, differences._sides(gapped), shared, 80)
    assert pairs.count() < 20 * len(rows)


def test_near_misses_in_groups(spark):
    rows = near_misses(150, 80, [2, 5, 8, 9, 10], 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.groups(docs, k=2).collect()} == brute(rows, 2, 80)
