"""Personal data, with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Where a text holds signs of a disguise,
transducers rewrite it (homoglyphs and full-width forms, invisible characters, digits spelled in
English, French, German or Spanish, bracketed or spelled-out at and dot) while keeping for each rewritten stretch the source characters
it comes from; the same detectors run over the rewritten text, and spans that use a rewritten
stretch are mapped back and added, unless they meet a base span of their kind.

Detectors are written to be linear in the text, for very long runs too.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; an empty table
gives an empty result; columns other than the text pass untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# -- transducers ---------------------------------------------------------------------------------
_LOOKALIKES = dict(zip("аеорсухіѕјԁкмтнвАЕОРСУХІЅЈКМТНВοανρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdkmthbAEOPCYXISJKMTHBoavpikABEZHIKMNOPTYX"))
_SIGNS = {"﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ", "&#64;": "@", "&commat;": "@", "&#46;": ".", "%40": "@"}
_HIDDEN = "­​‌‍⁠﻿"
#: Digits in English, French, German and Spanish (fixed values).
_SPOKEN_DIGITS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {w: str(i) for words in _SPOKEN_DIGITS for i, w in enumerate(words.split())} | {"zwo": "2", "fuenf": "5"}
_ONE = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
_PLUS = "(?:plus|más|mas)"
_CHARS = "".join(_LOOKALIKES) + "".join(k for k in _SIGNS if len(k) == 1)
_UNSEEN = re.compile(f"[{_HIDDEN}]+([^{_HIDDEN}]|$)")
_CHAR = re.compile("[" + re.escape(_CHARS) + "！-～٠-٩۰-۹]|&#64;|&commat;|&#46;|%40")
_FOLDED = "ıİſ\u212a"  # they match i, s and k where case is ignored
_PLAINLY = str.maketrans(_FOLDED, "iisk")
_ODD = re.compile("[" + re.escape(_CHARS + _HIDDEN + _FOLDED) + "！-～٠-٩۰-۹]")
_SPELLED = re.compile(rf"(?:\b{_PLUS}[ ,-]+)?(?<!\w){_ONE}(?:[ ,.-]{{1,2}}(?:{_ONE}|[0-9]+)){{2,}}(?!\w)", re.I)
_WORD = re.compile(rf"{_PLUS}(?=[ ,-])|{_ONE}|, ?", re.I)
_AT = r"(?:at|arroba|chez|@)"
_DOT = r"(?:dot|point|punkt|punto|\.)"
_BRACKETED = re.compile(rf"(?P<at> ?(?:\[ ?{_AT} ?\]|\( ?{_AT} ?\)|\{{ ?{_AT} ?\}}|< ?{_AT} ?>|_at_|-at-) ?)|(?P<dot> ?(?:\[ ?{_DOT} ?\]|\( ?{_DOT} ?\)|\{{ ?{_DOT} ?\}}|< ?{_DOT} ?>|_dot_|-dot-) ?)", re.I)
_PLAIN = re.compile(r"(?<=[A-Za-z0-9._%+-]) at (?=[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)|(?<=[A-Za-z0-9-]) dot (?=[A-Za-z0-9-]+)| ?@ ?(?=[A-Za-z0-9])", re.I)
_NAME = "[A-Za-z0-9-]+"
_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9._%+-]) (?P<at>at|arroba|arobase) (?P<domain>{_NAME}(?: (?:dot|punkt|punto|point) {_NAME})+|{_NAME}(?:\.{_NAME})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9-]))", re.I)
_SPOKEN_DOT = re.compile(r" (?:dot|punkt|punto|point) ", re.I)
_CUE = re.compile(r"(?:mail|contact|kontakt|write|schreib|reach|courriel|correo|escrib|address|adresse|[<(\[:\"'=])\W*(?:\w+\W+){0,2}$", re.I)
_ENTITIES = ("&#64;", "&commat;", "&#46;", "%40", " @", "@ ")
_MARKED = re.compile(rf"[\[({{<] ?(?:{_AT}|{_DOT}) ?[\])}}>]|[_-](?:at|dot)[_-]", re.I)  # in all that _BRACKETED matches
_SEPARATE = bytes(b if chr(b).isalnum() or chr(b) == "_" else 32 for b in range(128)) + bytes([32] * 128)
_RUNS_OF_LETTERS = re.compile(r"\w+")
_PLAIN_DIGITS, _ALL_DIGITS = frozenset(w.encode() for w in _DIGITS if w.isascii()), frozenset(_DIGITS)
_RUN = re.compile(rf"(?<!\w){_ONE}[ ,.-]{{1,2}}(?:{_ONE}|[0-9])", re.I)


class Rewritten:
    """A text with some stretches replaced, and the way back: pieces (start here, source start, source end, changed)."""

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), False)]

    def _source(self, at: int, end: bool) -> int:
        """The source place of a place here: of a character's start, or of its end."""
        k = bisect.bisect_right(self.starts, at if not end else at - 1) - 1
        lo, hi, changed = self.pieces[k]
        return (hi if end else lo) if changed else lo + at - self.starts[k]

    def back(self, start: int, end: int) -> tuple[int, int] | None:
        """Source start and end of a stretch that holds something rewritten; else None."""
        a, b = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_left(self.starts, end)
        return (self._source(start, False), self._source(end, True)) if any(p[2] for p in self.pieces[a:b]) else None

    def apply(self, pattern: re.Pattern, replacement) -> None:
        parts, starts, pieces, at, length = [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal length
            while a < b:
                k = bisect.bisect_right(self.starts, a) - 1
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                lo, hi, changed = self.pieces[k]
                starts.append(length)
                pieces.append((lo, hi, True) if changed else (lo + a - self.starts[k], lo + stop - self.starts[k], False))
                length += stop - a
                a = stop

        for m in pattern.finditer(self.text):
            new = replacement(m)
            if new == m[0] or m.start() == m.end():
                continue
            keep(at, m.start())
            parts += [self.text[at : m.start()], new]
            if new:
                starts.append(length)
                pieces.append((self._source(m.start(), False), self._source(m.end(), True), True))
                length += len(new)
            at = m.end()
        if at:
            keep(at, len(self.text))
            parts.append(self.text[at:])
            self.text, self.starts, self.pieces = "".join(parts), starts or [0], pieces or [(0, 0, False)]


def _one_char(m: re.Match) -> str:
    c = m[0]
    if c in _SIGNS or c in _LOOKALIKES:
        return _SIGNS.get(c) or _LOOKALIKES[c]
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else str(int(c))


def _word(m: re.Match) -> str:
    w = m[0].translate(_PLAINLY).lower()
    return "+" if w in ("plus", "más", "mas") else " " if w[0] == "," else _DIGITS[w]


def _spoken(m: re.Match) -> str:
    """'joe arroba ejemplo punto es', 'joe at beispiel punkt de'; 'joe at example.com' only where it reads as an address.

    That is: the name holds a digit or one of ._%+- inside, or stands at the very start, or a word such as mail or
    contact, a colon, bracket or quote comes within two words before it, and the last label is of one case. 'point'
    does not follow 'at'.
    """
    plain_at, domain = m["at"].lower() == "at", m["domain"]
    spelled = _SPOKEN_DOT.search(domain)
    if plain_at and spelled and " point " in domain.lower():
        return m[0]
    if plain_at and not spelled:
        if not ((last := domain.rpartition(".")[2]).islower() or last.isupper()):
            return m[0]
        before = m.string[max(0, m.start() - 120) : m.start()]
        name = re.search(r"[A-Za-z0-9._%+-]+$", before)[0]
        lead = before[: -len(name)]
        if lead and not re.search(r"[0-9._%+-]", name.strip(".-")) and not _CUE.search(lead):
            return m[0]
    return "@" + _SPOKEN_DOT.sub(".", domain)


def disguised(text: str) -> bool:
    """A quick look for any sign of a disguise; it may say yes for nothing, but never no for something."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    if any(sign in low for sign in _ENTITIES) or " dot " in low:
        return True
    if _MARKED.search(text):
        return True
    if (" at " in low or " aro" in low or " arr" in low) and any(_spoken(m) != m[0] for m in _SPOKEN.finditer(text)):
        return True
    # Most texts have no digit word at all, which is quicker seen than the lack of a run.
    some = not (_PLAIN_DIGITS.isdisjoint(low.encode().translate(_SEPARATE).split()) if text.isascii() else _ALL_DIGITS.isdisjoint(_RUNS_OF_LETTERS.findall(low)))
    return some and _RUN.search(text) is not None


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in places of the source text."""
    return rewritten_spans(text, base) if disguised(text) else []


def rewritten_spans(text: str, base: list[Span]) -> list[Span]:
    """The same without the quick look."""
    r = Rewritten(text)
    r.apply(_UNSEEN, lambda m: m[1])
    r.apply(_CHAR, _one_char)
    spelled = [(m.start(), m.end()) for m in _SPELLED.finditer(r.text)]
    if spelled:
        first = [a for a, _ in spelled]

        def inside(m: re.Match) -> str:
            k = bisect.bisect_right(first, m.start()) - 1
            return _word(m) if k >= 0 and m.end() <= spelled[k][1] else m[0]

        r.apply(_WORD, inside)
        r.apply(re.compile(r"\+ +(?=[0-9])"), lambda m: "+")
    r.apply(_BRACKETED, lambda m: "@" if m["at"] else ".")
    r.apply(_SPOKEN, _spoken)
    if "@" in r.text or " at " in r.text.lower():
        r.apply(_PLAIN, lambda m: "@" if "dot" not in m[0].lower() else ".")
    out = []
    for start, kind, end in base_spans(r.text):
        if place := r.back(start, end):
            if not any(k == kind and a < place[1] and place[0] < b for a, k, b in base):
                out.append((place[0], kind, place[1]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base = base_spans(text)
    out, at = [], 0
    for start, kind, end in sorted(base + added_spans(text, base)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added."""
    small_batches(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(f"{counts}, base_sha256 string, spans string, n_added long")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text or "")
            added = added_spans(text or "", base)
            kinds = [s[1] for s in base]
            rows.append((*map(kinds.count, range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("p"))
    return found.select("doc_id", "p.*")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of its text replaced; all other columns as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t) for t in texts], dtype=object)

    return docs.withColumn("text", run(F.col("text").cast("string")))
