"""Personal data with offsets: base patterns, and the same identifiers behind disguises.

Base spans are found in the text as it is. Then a cascade of transducers rewrites what disguises
there are, each on the result of the one before: characters (look-alike letters, compatibility forms such as full-width
and mathematical ones, digits of any script, invisible ones), spelled digits in runs, bracketed marks, and marks that are written as words.
Bare words make an address only where one ends in a known top-level label behind a written stop, and an
IP only between numbers, so that prose with such words stays. Each piece of a step's text remembers the span it stands
for in the text before, so identifiers detected at the end map back through all steps to source characters; those inside a base span of their
kind are dropped. Every scan is linear in the text, however it is built.

Null text is empty. Rows are judged one by one, so repeated rows and ids are of no consequence.
Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Cyrillic and Greek letters that look like Latin ones, and those Latin letters.
_LOOKALIKE = dict(zip("абвеѕіјкмнорсԁтухһԛԝАВЕЅІЈКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "a6BesijkmHopcdTyxhqwABESIJKMHOPCTYXaeikvoptuxABEZHIKMNOPTYX", strict=True))
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Digits in words, English, French, German, Spanish.
_DIGITS = {w: str(i) for words in ("zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())}
# Words for @, for the full stop, and for other marks in a local part.
_AT, _DOT = "at|arobase|arroba|ät", "dot|point|punkt|punto"
_MARKS = {"underscore": "_", "dash": "-", "hyphen": "-", "minus": "-", "plus": "+"}
# Top-level labels that make an address of bare words; those that are common words of prose are left out.
_TOP = set("com org net edu gov mil info biz io ai tv dev fr uk eu ch nl pt pl dk fi ie ca mx br au nz jp cn ru de es".split())
# Words near which bare words are an address, by their beginnings.
_CONTACT = re.compile(r"\b(?:e-?mails?|mail|contact|write|reach|address|courriel|adresse|[ée]cri|contacte|kontakt|schreib|erreich|correo|escrib|direcci)")
#: Characters before an address of bare words, and after it, in which such a word may stand.
_BEFORE, _AFTER = 48, 24
# Words that open a phrase and no address.
_NOT = set("the a an this that its der die das dem den le la les el los las un une ein eine".split())


def _plain(c: str) -> str:
    """What a character stands for: a letter it looks like, a digit's value, its compatibility form if that is ASCII, nothing if it is invisible."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    new = unicodedata.normalize("NFKC", c)
    return "." if new == "。" else new if new.isascii() and new.strip() == new else c


#: Characters that stand for others, by that rule.
_ODD = {c: p for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x1FC00)]) if (p := _plain(c)) != c}
_ATOM, _LABEL = r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+", r"[A-Za-z0-9-]{1,63}+"
_GAP = rf"(?:\.| (?:{_DOT}) )"
_BARE_DOTS = [f" {w} " for w in _DOT.split("|")]
# the cascade: each step rewrites the result of the one before; patterns are for lower-cased text
_UNITS = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in _DIGITS if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in _DIGITS})) + ")"
_SPELT = re.compile(rf"(?:{_UNITS}|[0-9])(?:[ .-]?(?:{_UNITS}|[0-9]))++(?![^\W\d_])")
_UNIT, _APART, _TOUCHING = re.compile(_UNITS), re.compile("[ .-]"), re.compile(r"[0-9][a-zéü]{2}|[a-zéü]{2}[0-9]")
_BRACKETS = re.compile(rf"[ ]?[\[({{<][ ]?(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)|(?P<mark>{'|'.join(_MARKS)}|[_+-]))[ ]?[\])}}>][ ]?")
_ADDRESS = re.compile(rf"(?<![\w.@%+-])(?:{_ATOM})(?: (?:{_DOT}|{'|'.join(_MARKS)}) (?:{_ATOM})){{0,4}}(?P<at> (?:{_AT}) |@)(?:{_LABEL})(?:{_GAP}{_LABEL}){{1,6}}(?![\w-])")
_NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}+(?:(?: (?:{_DOT}) |\.)[0-9]{{1,3}}+){{3}}(?![\w])")
_STEP = re.compile(rf"(?P<at> (?:{_AT}) )|(?P<dot> (?:{_DOT}) )|(?P<mark> (?:{'|'.join(_MARKS)}) )")
_HAS_DOTTED = re.compile(r"[0-9]\.[0-9]")
_HAS_DIGITS = re.compile(r"[0-9][ -]?[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping within a kind; failing matches dropped."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:  # a local part begins as far left of its @ as its characters and the last match allow
        a = at
        while a > past and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, 0, m.end()))
            past = m.end()
        else:
            past = max(past, at + 1)
        at = text.find("@", past)
    if _HAS_DOTTED.search(text):
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                out.append((m.start(), 1, m.end()))
    if _HAS_DIGITS.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and _luhn(d):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Step:
    """A rewritten text and the pieces that it is made of: start in it, start and end in the text before."""

    def __init__(self, before: str, edits: list[tuple[int, int, str]]):
        parts, self.out, self.src, self.end, n, past = [], [], [], [], 0, 0
        for a, b, new in [*edits, (len(before), len(before), "")]:
            for piece, s, e in ((before[past:a], past, a), (new, a, b)):
                if piece:
                    parts.append(piece)
                    self.out.append(n)
                    self.src.append(s)
                    self.end.append(e)
                    n += len(piece)
            past = b
        self.text = "".join(parts)
        self.copied = [e - s == o2 - o for o, o2, s, e in zip(self.out, [*self.out[1:], n], self.src, self.end, strict=True)]

    def back(self, p: int, last: bool) -> int:
        """Where a character begins (or ends, for the last of a span) in the text before."""
        k = bisect_right(self.out, p) - 1
        if self.copied[k]:
            return self.src[k] + p - self.out[k] + last
        return self.end[k] if last else self.src[k]


def _lower(text: str) -> str:
    """Lower-cased, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _odd(text: str) -> list[tuple[int, int, str]]:
    some = () if text.isascii() else sorted(_ODD.keys() & set(text))
    return [(m.start(), m.end(), _ODD[m[0]]) for m in re.finditer(f"[{re.escape(''.join(some))}]", text)] if some else []


def _spelt(text: str) -> list[tuple[int, int, str]]:
    """Digits as words: two of them in a run, or one that touches a numeral."""
    out, low = [], _lower(text)
    if _DIGITS.keys().isdisjoint(_APART.split(low)) and not _TOUCHING.search(low):
        return out
    for m in _SPELT.finditer(low):
        a = m.start()
        if not m[0].isdigit() and not (a and text[a - 1].isalpha()):
            units = list(_UNIT.finditer(m[0]))
            if len(units) > 1 or _TOUCHING.search(m[0]):
                out += [(a + u.start(), a + u.end(), _DIGITS[u[0]]) for u in units]
    return out


def _brackets(text: str) -> list[tuple[int, int, str]]:
    sign = lambda m: "@" if m["at"] else "." if m["dot"] else _MARKS.get(m["mark"], m["mark"])
    return [(m.start(), m.end(), sign(m)) for m in _BRACKETS.finditer(_lower(text))]


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Written marks of addresses and numbers.

    An address of words needs a known top-level label and a written stop, and if its @ is a word, evidence that it is one: a digit
    or mark (also a written one) in its local part, or a word of contact nearby. "She works at google dot com" is prose.
    """
    low = _lower(text)
    if not any(w in low for w in _BARE_DOTS):
        return []
    out = []
    for m in _ADDRESS.finditer(low):
        # labels beyond the last known one are the sentence's, not the address's
        own, at = m[0], m.end("at") - m.start()
        tops = [k.end() for k in re.finditer(rf"(?<=[. ]){_LABEL}", own[at:]) if k[0] in _TOP and k.start()]
        prose = m["at"] != "@" and re.match(_LABEL, own[at:])[0] in _NOT
        bare = m["at"] != "@" and not re.search(r"[0-9._%+-]| ", own[: m.start("at") - m.start()])
        prose = prose or bare and not (_CONTACT.search(low, max(0, m.start() - _BEFORE), m.start()) or _CONTACT.search(low, m.end(), m.end() + _AFTER))
        if tops and not prose and any(w in own for w in _BARE_DOTS):
            out += [(m.start() + s.start(), m.start() + s.end(), "@" if s["at"] else "." if s["dot"] else _MARKS[s[0].strip()]) for s in _STEP.finditer(own[: at + tops[-1]])]
    for m in _NUMBERS.finditer(low):
        out += [(m.start() + s.start(), m.start() + s.end(), ".") for s in _STEP.finditer(m[0])]
    out.sort()
    return [x for k, x in enumerate(out) if not k or x[0] >= out[k - 1][1]]


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, by start and kind."""
    text = text or ""
    own, steps, now = base(text), [], text
    for rule in (_odd, _spelt, _brackets, _bare):
        if edits := rule(now):
            steps.append(_Step(now, edits))
            now = steps[-1].text
    if not steps:
        return own, own
    extra = []
    for a, kind, b in base(now):
        s, e = a, b
        for step in reversed(steps):
            s, e = step.back(s, False), step.back(e - 1, True)
        if not any(k == kind and x <= s and e <= y for x, k, y in own):
            extra.append((s, kind, e))
    return own, sorted(set(own + extra))


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base spans, their digest, and all spans of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        count, sha, every = [[] for _ in KINDS], [], []
        for t in b.column(1):
            own, found = spans(t.as_py())
            for k, c in enumerate(count):
                c.append(sum(x[1] == k for x in own))
            sha.append(hashlib.sha256(listed(own).encode()).hexdigest())
            every.append(listed(found))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(docs.select(doc_id, text), one, schema)


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one, by the first's kind) replaced by its kind in brackets."""
    if text is None:
        return None
    parts, past = [], 0
    for a, k, b in spans(text)[1]:
        if a >= past:
            parts += [text[past:a], f"[{KINDS[k].upper()}]"]
        past = max(past, b)
    return "".join([*parts, text[past:]]) if past else text


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced; the length column, where there is one, follows. Null texts stay null with their length."""
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        cols, old = list(b.columns), b.column(at).to_pylist()
        new = [redacted(t) for t in old]
        cols[at] = pa.array(new, cols[at].type)
        if size is not None:
            was = cols[size].to_pylist()
            cols[size] = pa.array([w if x == y else len(y) for w, x, y in zip(was, old, new, strict=True)], cols[size].type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_batches(docs, one, docs.schema)


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """The base patterns as they are stated, for tests."""
    out, text = [], text or ""
    tests = {
        0: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        1: (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        2: (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
        3: (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for k, (p, ok) in tests.items():
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out)
