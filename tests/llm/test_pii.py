import hashlib
import random
import re

from testfloor.llm import pii
from testfloor.llm.queries import op7_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((kind, *m.span()))
    return sorted(spans, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_equals_brute_force():
    rng = random.Random(1)
    for alphabet in ("a.@-_b ", "0123456789.. ", "0125 -+()", "+1234567890 .a@"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.find(text) == brute(text), text


def test_long_runs_take_linear_time():
    for c in ("a", "1", "1.", "+1 ", "a@", "1 ", "one "):
        pii.disguised(c * 200_000, pii.find(c * 200_000))


def shown(text):
    known = pii.find(text)
    return [(k, text[a:b]) for k, a, b in known], [(k, text[a:b]) for k, a, b in pii.disguised(text, known)]


def test_disguises_map_back_to_the_source():
    assert shown("write to jane (at) mail [dot] example.com now") == ([], [("email", "jane (at) mail [dot] example.com")])
    assert shown("é jane at mail dot com!") == ([], [("email", "jane at mail dot com")])
    assert shown("jаne@mail.com") == ([("email", "ne@mail.com")], [])  # touches what was found as it stands
    assert shown("ip １９２.168.0.1x") == ([], [("ip", "１９２.168.0.1")])
    spelled = "+" + " ".join("one two three four five six seven eight nine zero one".split())
    assert shown(f"call {spelled} ok")[1] == [("phone", spelled[0:])]
    assert shown("He is at home. She lives dot by dot at school.") == ([], [])
    assert shown("a​b@x.org") == ([("email", "b@x.org")], [])


def test_masking():
    text = "mail a@b.co or jane at mail dot com, 1.2.3.4"
    known = pii.find(text)
    assert pii.mask(text, known + pii.disguised(text, known)) == "mail <email> or <email>, <ip>"


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in op7_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, r = brute(d.text or ""), rows[d.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert {*filter(None, joined.split(","))} <= {*r.spans.split(",")}


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, base string, n_chars long"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (2, "", None, 2), (None, "a@b.co", "y", 3)], schema)
    out = pii.detect(docs).collect()
    assert sorted(len(r.base) + len(r.added) for r in out) == [0, 0, 0, 1]
    assert sorted(map(str, (r.text for r in pii.redact(docs).collect()))) == ["", "", "<email>", "None"]
    assert pii.detect(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_disguised_parts_of_shown_identifiers(spark):
    """A fragment that the plain text shows does not keep the whole from being found and masked."""
    cases = {
        "to alice.smіth@x.com now": ("email:12:20", "email:3:20", "to <email> now"),
        "a\u200bb@x.org": ("email:2:9", "email:0:9", "<email>"),
        "ask john (dot) smith@example.com": ("email:15:32", "email:4:32", "ask <email>"),
        "john@example.co (dot) uk!": ("email:0:15", "email:0:24", "<email>!"),
        "jаne@mail.com, b@c.de": ("email:2:13,email:15:21", "email:0:13", "<email>, <email>"),
        "jоhn@1.2.3.4": ("email:2:12,ip:5:12", "email:0:12", "<email>"),
        "plain@mail.com (at) x": ("email:0:14", "", "<email> (at) x"),
    }
    docs = spark.createDataFrame([(t,) for t in cases], "text string")
    listed = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in spans)
    found = {r.text: (listed(r.base), listed(r.added)) for r in pii.detect(docs).collect()}
    assert found == {t: c[:2] for t, c in cases.items()}
    assert sorted(r.text for r in pii.redact(docs).collect()) == sorted(c[2] for c in cases.values())


def test_touching_adds_what_no_span_of_its_kind_holds():
    rng = random.Random(2)
    parts = ["a", "b1", "а", "@", ".", " (at) ", " (dot) ", " ", "x.com", "１", "1.2.3.4", "+1 555 012 3456", "one two three four ", "\u200b"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        known, (plain, starts, ends) = pii.find(text), pii.normalise(text)
        whole = [(k, starts[a], ends[b - 1]) for k, a, b in pii.find(plain) if text[starts[a] : ends[b - 1]] != plain[a:b]]
        free = [s for s in whole if not any(k == s[0] and a <= s[1] and s[2] <= b for k, a, b in known)]
        assert sorted(pii.disguised(text, known, touching=True)) == sorted(free), text
        apart = [s for s in whole if not any(a < s[2] and s[1] < b for _, a, b in known)]
        assert sorted(pii.disguised(text, known)) == sorted(apart), text
