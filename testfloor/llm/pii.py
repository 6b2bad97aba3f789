"""Personal data, also where it is disguised, with places in the source text.

Identifiers are first looked for in the text as it stands. Then a transducer
rewrites the text (look-alike characters, spelled digits, ``(at)`` and ``dot``
disguises) and keeps for every character written the source characters it came
from. Identifiers of the rewritten text whose source differs from it are added,
with their source spans, unless one of their kind found before holds them. So an
added one may overlap what the plain text shows of it.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does, so runs are entered once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: around every @, what may stand before and after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """All identifiers of a text, by start, then kind."""
    spans = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# Characters that look like ASCII ones. Full-width forms and digits
# of other scripts follow a rule (see _plain).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k",
    "․": ".", "。": ".", "﹫": "@",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")

# Digits in words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}

_DIGIT_RUN = re.compile(
    r"(?i)\b(?=[zotfsen])(?:zero|one|two|three|four|five|six|seven|eight|nine)"
    r"(?:[ -](?:zero|one|two|three|four|five|six|seven|eight|nine)){3,}\b"
)
_WORD = re.compile(r"[A-Za-z]+")
# Characters that stand for others (see _plain).
_FOREIGN = re.compile(f"(?![0-9])[\\d！-～{''.join([*LOOKALIKES, *map(str.upper, LOOKALIKES), *INVISIBLE])}]")
_AT = re.compile(r"(?i) ?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}|<at>) ?")
_DOT = re.compile(r"(?i) ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}|<dot>|\[\.\]|\(\.\)) ?")
# Bare words are taken for signs only in a whole address that ends in a usual domain.
_BARE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}( at |@)[A-Za-z0-9-]{1,63}(?:(?: dot |\.)[A-Za-z0-9-]{1,63}){0,3}"
    r"(?: dot |\.)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)(?![A-Za-z0-9])"
)
_BARE_SIGN = re.compile(r"(?i) (at|dot) ")

_BRACKET = re.compile(r"[\[({<]")
_BARE_HINT = re.compile(r"(?i) (?:at|dot) ")

Mapped = tuple[str, Sequence[int], Sequence[int]]  # text, and the source span of each character


def _plain(c: str) -> str:
    """The ASCII character that ``c`` stands for; empty for invisible ones."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c.isdecimal():
        return str(int(c))
    return LOOKALIKES.get(c, LOOKALIKES.get(c.lower(), c))


def rewrite(mapped: Mapped, pattern: re.Pattern, replace) -> Mapped:
    """Every match replaced by the (text, start, end) pieces of ``replace(match)``, with places carried over."""
    text, starts, ends = mapped
    out, a, b, done = [], [], [], 0
    for m in pattern.finditer(text):
        out.append(text[done : m.start()])
        a += starts[done : m.start()]
        b += ends[done : m.start()]
        for piece, i, j in replace(m):
            out.append(piece)
            a += [starts[i]] * len(piece)
            b += [ends[j - 1]] * len(piece)
        done = m.end()
    if not done:
        return mapped
    return "".join([*out, text[done:]]), [*a, *starts[done:]], [*b, *ends[done:]]


def _inner(m: re.Match, sign: re.Pattern, value) -> Iterator[tuple[str, int, int]]:
    """The match unchanged but for what ``sign`` finds in it."""
    done, text = m.start(), m.string
    for s in sign.finditer(text, m.start(), m.end()):
        yield from ((text[i], i, i + 1) for i in range(done, s.start()))
        yield value(s), s.start(), s.end()
        done = s.end()
    yield from ((text[i], i, i + 1) for i in range(done, m.end()))


def _spelled(m: re.Match) -> Iterator[tuple[str, int, int]]:
    for w in _WORD.finditer(m.string, m.start(), m.end()):
        yield SPELLED[w[0].lower()], w.start(), w.end()


def normalise(text: str) -> Mapped:
    """The rewritten text and the source span of each of its characters."""
    mapped: Mapped = (text, range(len(text)), range(1, len(text) + 1))
    if not text.isascii():
        mapped = rewrite(mapped, _FOREIGN, lambda m: [(_plain(m[0]), *m.span())])
    mapped = rewrite(mapped, _DIGIT_RUN, _spelled)
    mapped = rewrite(mapped, _AT, lambda m: [("@", *m.span())])
    mapped = rewrite(mapped, _DOT, lambda m: [(".", *m.span())])
    if not _BARE_HINT.search(mapped[0]):
        return mapped
    sign = {"at": "@", "dot": "."}
    return rewrite(mapped, _BARE, lambda m: _inner(m, _BARE_SIGN, lambda s: sign[s[1].lower()]))


def _can_change(text: str) -> bool:
    """Whether the text has what a rewriting needs; cheap, as most texts have not."""
    if not text.isascii() and any(c >= "\x80" and _plain(c) != c for c in set(text)):
        return True
    return bool(_BARE_HINT.search(text) or _BRACKET.search(text) or _DIGIT_RUN.search(text))


def disguised(text: str, known: list[Span], touching: bool = False) -> list[Span]:
    """Identifiers that only the rewritten text shows, as source spans, by start, then kind.

    Those that touch no known span; with ``touching``, all that no known span of their kind holds.
    """
    if not _can_change(text):
        return []
    plain, starts, ends = normalise(text)
    if plain == text:
        return []
    taken, reach = {}, {}
    for kind in KINDS:
        taken[kind] = sorted((a, b) for k, a, b in known if k == kind or not touching)
        reach[kind] = list(itertools.accumulate((b for _, b in taken[kind]), max))
    added = []
    for kind, a, b in find(plain):
        i, j = starts[a], ends[b - 1]
        if text[i:j] == plain[a:b]:
            continue
        # Known spans that begin before (touching: not after the start), and how far they go.
        before = bisect.bisect_left(taken[kind], (i + 1, -1) if touching else (j, -1))
        if before and (reach[kind][before - 1] >= j if touching else reach[kind][before - 1] > i):
            continue
        added.append((kind, i, j))
    return sorted(added, key=lambda s: (s[1], KINDS.index(s[0])))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``added``: spans (kind, start, stop) in code points, stop exclusive.

    ``base`` has what the text shows as it stands, ``added`` what only the rewritten
    text shows, also where it overlaps a base span. NULL and empty texts have none. Columns of those names are replaced;
    other columns and repeated rows stay.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base", "added")]
    at = [c.lower() for c in kept].index("text")
    schema = docs.select(*kept).schema.add("base", _spans_type()).add("added", _spans_type())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                known = find(text)
                base.append([dict(zip(("kind", "start", "stop"), s)) for s in known])
                added.append([dict(zip(("kind", "start", "stop"), s)) for s in disguised(text, known, touching=True)])
            columns = [*batch.columns, pa.array(base, kind), pa.array(added, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "base", "added"])

    return docs.select(*kept).mapInArrow(run, schema)


def _spans_type():
    one = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("stop", T.IntegerType())
    return T.ArrayType(one)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch covered by spans replaced by the kind of its first one (``<email>``)."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every identifier in ``text`` masked; all columns stay, NULL texts stay NULL."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                known = find(text) if text else []
                texts.append(mask(text, known + disguised(text, known, touching=True)) if text else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def listed(spans: str) -> Column:
    """A column of spans as comma-joined ``kind:start:end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
