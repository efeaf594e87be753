"""Personal data with offset-preserving deobfuscation.

Plain identifiers (e-mail, IP, card, phone) are found on the source text.  Then
disguised ones: a transducer rewrites the text piece by piece - homoglyphs, full-width
and zero-width characters, spelled digits, "at" / "dot" disguises - and keeps for
every written character the source span it stands for.  The same detectors run on
the rewritten text and their spans are mapped back to source characters.  A mapped
span is added unless it lies within a plain one of its kind, so a disguised identifier
stands beside the plain fragment that it holds.  Each text is handled on its own, whole,
in Arrow batches; nothing is shuffled.

Spans are code points, end exclusive.  Defined cases: null is empty text; repeated
rows get equal rows; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, leftmost and non-overlapping, found from their @ in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def detect(text: str) -> list[tuple[int, int, str]]:
    """Plain identifiers as (start, end, kind)."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if _ip_ok(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


# Look-alikes of ASCII letters and signs, by script.
_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝ", "ABESIJKMHOPCTXYaesijopcxydhqw"))
_ALIKE |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυ", "ABEZHIKMNOPTYXoavikpu"))
_ALIKE |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}                      # full-width forms
_ALIKE |= {chr(z + i): str(i) for z in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7F6) for i in range(10)}
# further dots, at signs, hyphens and spaces, and characters that show nothing
_ALIKE |= {"\u2024": ".", "\u3002": ".", "\u00b7": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-",
           "\u00a0": " ", "\u2009": " ", "\u202f": " "}
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_NUMBER = {w: str(i) for ws in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(ws.split())}
_NUMBER |= {"oh": "0"}
_SPELT = "|".join(sorted(_NUMBER, key=len, reverse=True))

_ALIKE_RUN = re.compile("[" + "".join(re.escape(c) for c in _ALIKE) + _HIDDEN + "]")
_SPELT_RUN = re.compile(rf"(?:(?<!\w)(?:plus[ -]+)?(?:{_SPELT})(?!\w)|\+)(?:[ .,()-]{{1,3}}(?:(?:{_SPELT})(?!\w)|[0-9]+)){{5,}}", re.I)
_SPELT_WORD = re.compile(rf"(?<!\w)(?:plus|{_SPELT})(?!\w)", re.I)
# Signs written otherwise than @ and dot, and what an address may be made of.  Words and spaces count as signs only between
# a local part and a host whose last label is not a number: "at 10.30" and "3 @ 4.50" are prose.  Hosts of addresses with
# // or www. are no local parts.
_AT_SIGN = r"\s*[\[({<]\s*(?:at|@|arroba)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s+@\s+|\s+@|@\s+|_at_|-at-"
_AT = rf"(?:{_AT_SIGN}|@)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punto|punkt|point)\s*[\])}>]\s*|\s+(?:dot|punto|punkt)\s+|_dot_|-dot-)"
# a label ends before _dot_ and -dot-, so that there is one way only to read a run
_LABEL = r"[A-Za-z0-9_%+-](?:(?!(?:_dot_|-dot-)[A-Za-z0-9_%+-])[A-Za-z0-9_%+-])*"
_HOST_LABEL = r"[A-Za-z0-9-](?:(?!-dot-[A-Za-z0-9-])[A-Za-z0-9-])*"
_HOST = rf"{_HOST_LABEL}(?:(?:\.|{_DOT}){_HOST_LABEL})+"
# "me at bob.smith@site.org" is prose before a plain address: a host that goes on to a plain @ and a host is a local part
_MAIL_RUN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?<!//)(?!www\.){_LABEL}(?:(?:\.|{_DOT}){_LABEL})*?(?P<at>{_AT}){_HOST}(?![A-Za-z0-9._%+-]*@{_HOST})", re.I)
_DOT_RUN, _NUMBER_END = re.compile(_DOT, re.I), re.compile(r"(?<![A-Za-z0-9-])[0-9]+\Z")
# Holds wherever _AT before a host (other than a plain @) or _DOT does, so without it no run is rewritten; one character is tried first, which is fast.
_SIGN_HINT = re.compile(rf"[\s_[({{<@-](?:(?<=\s)(?:(?:at|arroba)\s+{_HOST}|@\s*{_HOST}|(?:dot|punto|punkt)\s)|(?<=@)\s+{_HOST}|(?<=[_-])(?:at|dot)[_-]"
                        r"|(?<=[\[({<])\s*(?:at|@|arroba|dot|\.|punto|punkt|point)\s*[\])}>])", re.I)
_SPELT_HINT = re.compile(rf"(?:{_SPELT})[ .,()-]{{1,3}}(?:{_SPELT}|[0-9]+)[ .,()-]|\+[ .,()-]")      # of lower-cased text
_IP_HINT = re.compile(rf"[0-9]+(?:{_DOT})[0-9]+", re.I)


class Tape:
    """A rewritten text and, per character, the source span it stands for."""

    def __init__(self, text: str, first=None, last=None):
        self.text = text
        self.first = list(range(len(text))) if first is None else first
        self.last = list(range(1, len(text) + 1)) if last is None else last

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Apply (start, end, replacement) edits, sorted and disjoint; a replacement stands for its whole source."""
        text, first, last, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), first + self.first[at:], last + self.last[at:])


def _alike(t: Tape) -> Tape:
    return t.rewrite([(*m.span(), _ALIKE.get(m.group(), "")) for m in _ALIKE_RUN.finditer(t.text)])


def _spelt(t: Tape) -> Tape:
    edits = []
    for run in _SPELT_RUN.finditer(t.text):
        words = [(*m.span(), _NUMBER.get(m.group().lower(), "+")) for m in _SPELT_WORD.finditer(t.text, *run.span())]
        for i, (a, b, new) in enumerate(words):
            edits.append((a, b, new))
            nxt = words[i + 1][0] if i + 1 < len(words) else b
            if 0 < nxt - b <= 3 and not re.search(r"[0-9]", t.text[b:nxt]):   # spelled digits stand side by side
                edits.append((b, nxt, ""))
    return t.rewrite(edits)


def _signs(t: Tape) -> Tape:
    edits = []
    for run in _MAIL_RUN.finditer(t.text):
        a, b = run.span("at")
        sign = run.group("at")
        if sign != "@" and sign.strip().lower() in ("at", "arroba", "@") and _NUMBER_END.search(run.group()):
            continue
        if sign != "@" or _DOT_RUN.search(run.group()):
            found = {(a, b): "@"}
            for lo, hi in ((run.start(), a), (b, run.end())):
                found |= {m.span(): "." for m in _DOT_RUN.finditer(t.text, lo, hi)}
            edits += [(x, y, new) for (x, y), new in sorted(found.items())]
    taken = [e[:2] for e in edits]
    if _IP_HINT.search(t.text):
        for m in _DOT_RUN.finditer(t.text):
            if m.start() and t.text[m.start() - 1].isdigit() and t.text[m.end():m.end() + 1].isdigit() and m.span() not in taken:
                edits.append((*m.span(), "."))
    return t.rewrite(sorted(edits))


def _may_be_alike(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_ALIKE_RUN.search(text))
    return any(c in text for c in "\u00b7\u00a0\u00ad")


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Identifiers of the rewritten text as source spans; empty where nothing is disguised."""
    alike, low = not text.isascii() and _may_be_alike(text), text.lower()
    spelt, signs = _SPELT_HINT.search(low), _SIGN_HINT.search(text)
    if not (alike or spelt or signs):
        return []
    t = _alike(Tape(text)) if alike else Tape(text)
    if alike or spelt:
        t = _spelt(t)
    if alike or signs:
        t = _signs(t)
    return [(t.first[a], t.last[b - 1], kind) for a, b, kind in detect(t.text)]


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(plain spans, all spans), each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(detect(text), key=order)
    more = [s for s in dict.fromkeys(disguised(text)) if not any(a <= s[0] and s[1] <= b and k == s[2] for a, b, k in base)]
    return base, sorted(base + more, key=order)


def digest(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans); the counts are those of plain identifiers."""
    d = pick(docs, doc_id=id_col, text=text_col)
    schema = (f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS)
              + ", base_sha256 string, spans string, n_spans long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [spans(x or "") for x in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, sha, pa.array([digest(x) for _, x in rows], pa.string()), pa.array([len(x) for _, x in rows], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return d.mapInArrow(run, schema)
