"""Personal data in text, also where it is disguised, as spans of the source text.

Three steps: (1) plain patterns over the text give the *base* spans; (2) a transducer writes the
text in a normal form and remembers, for every piece, the source characters it came from:
look-alike letters and digits become ASCII, invisible characters vanish, spelled digits become
digits, ``at``/``dot`` disguises become ``@`` and ``.``; (3) the same patterns over the normal form
give spans that are mapped back to source characters. A mapped span is added if it holds
rewritten characters and every base span of its kind that it touches lies within it; base spans always stay.

Defined cases: a null or empty text has no spans; offsets are code points, the end is exclusive;
repeated rows are searched each for itself. Every pattern takes time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is only entered at its beginning; entered later it ends the same way.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: no local part is scanned more than once."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _phone(match: str) -> bool:
    return 10 <= sum(c.isdigit() for c in match) <= 15


def _octets(match: re.Match) -> bool:
    parts = [p.lstrip("0") for p in match.groups()]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, by start, then kind in the order of KINDS."""
    spans = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _octets(m)]
    spans += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if _card(m[0])]
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _phone(m[0])]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


# Spelled digits of the four languages, and the names of the two signs.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
}
_AT = r"(?:at|arroba|arobase|klammeraffe)"
_DOT = r"(?:dot|punto|punkt|point)"
# Letters of other scripts that look like a Latin one.
_LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһӏѵԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρκ",
        "ABEKMHOPCTYXaeopcyxijsdhlvqwABEZHIKMNOPTYXoviapk",
        strict=True,
    )
)
_INVISIBLE = "­​-‏⁠-⁤﻿"
# Blocks that hold look-alikes, digits of other scripts, and compatibility forms.
_FOREIGN = "Ͱ-ԯ٠-٩۰-۹०-९․‐-―！-～\U0001d400-\U0001d7ff"

_unit = rf"(?:(?:double|triple)[ -]{{1,3}})?(?:{'|'.join(sorted(_DIGIT_WORDS, key=len, reverse=True))})"
_REWRITE = re.compile(
    rf"(?P<invisible>[{_INVISIBLE}]+)"
    rf"|(?P<foreign>[{_FOREIGN}])"
    rf"|(?P<spelled>(?<!\w)(?:plus[ -]{{1,3}})?{_unit}(?:[ ,-]{{1,3}}{_unit})*(?!\w))"
    rf"|(?P<at>(?<!\s)\s{{0,3}}[\[({{<]\s{{0,3}}{_AT}\s{{0,3}}[\])}}>]\s{{0,3}}"
    rf"|(?<=\w)\s{{1,3}}{_AT}\s{{1,3}}(?=[a-z0-9-]+(?:\s{{1,3}}|\s{{0,3}}[\[({{<]\s{{0,3}}){_DOT}(?!\w)))"
    rf"|(?P<dot>(?<!\s)\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}"
    rf"|(?<=\w)\s{{1,3}}{_DOT}\s{{1,3}}(?=\w))",
    re.IGNORECASE,
)
# What no rewriting can do without: a foreign character, a sign's name, a bracketed dot, or one spelled digit.
_HINT = re.compile(
    rf"[{_INVISIBLE}{_FOREIGN}]|{_AT}|{_DOT}|[\[({{<]\s{{0,3}}\.|(?<!\w)(?:plus[ -]{{1,3}})?{_unit}(?!\w)", re.IGNORECASE
)

# Letters that a search without case takes for another one, though they are no capital of it.
_CASED = str.maketrans("ſıİ", "sii")


def _ascii(c: str) -> str:
    """What a foreign character stands for; itself if it stands for nothing in ASCII."""
    if c in _LOOK_ALIKES:
        return _LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if "‐" <= c <= "―":
        return "-"
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def _digits(spelled: str) -> str:
    out, times = [], 1
    for word in re.split(r"[ ,-]+", spelled.translate(_CASED).lower()):
        if word == "plus":
            out.append("+")
        elif word in ("double", "triple"):
            times = 2 if word == "double" else 3
        else:
            out.append(_DIGIT_WORDS[word] * times)
            times = 1
    return "".join(out)


def normalised(text: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The normal form, and its pieces (start in it, source start, source end, rewritten)."""
    parts, pieces, done, length = [], [], 0, 0
    for match in _REWRITE.finditer(text):
        kind = match.lastgroup
        if kind == "invisible":
            new = ""
        elif kind == "foreign":
            new = _ascii(match[0])
            if new == match[0]:
                continue
        elif kind == "spelled":
            new = _digits(match[0])
        else:
            new = "@" if kind == "at" else "."
        if match.start() > done:
            pieces.append((length, done, match.start(), False))
            parts.append(text[done : match.start()])
            length += match.start() - done
        if new:
            pieces.append((length, match.start(), match.end(), True))
            parts.append(new)
            length += len(new)
        done = match.end()
    if done < len(text):
        pieces.append((length, done, len(text), False))
        parts.append(text[done:])
    return "".join(parts), pieces


def hidden_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only show in the normal form, in source offsets."""
    if not _HINT.search(text):
        return []
    normal, pieces = normalised(text)
    starts = [p[0] for p in pieces]
    added = []
    for start, end, kind in plain_spans(normal):
        first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        whole = pieces[first : last + 1]
        # Between neighbouring pieces, characters that left no trace also count as rewritten.
        gap = any(a[2] != b[1] for a, b in zip(whole, whole[1:], strict=False))
        if not gap and not any(p[3] for p in whole):
            continue
        at, source, _, rewritten = pieces[first]
        begin = source if rewritten else source + start - at
        at, source, stop, rewritten = pieces[last]
        finish = stop if rewritten else source + end - at
        met = [(s, e) for s, e, k in base if k == kind and s < finish and begin < e]
        if all(begin <= s and e <= finish and (begin, finish) != (s, e) for s, e in met):
            added.append((begin, finish, kind))
    return added


def spans_of(text: str) -> list[dict]:
    base = plain_spans(text)
    both = [(*s, True) for s in base] + [(*s, False) for s in hidden_spans(text, base)]
    both.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return [
        {"kind": k, "start": s, "end": e, "base": b, "value": text[s:e]} for s, e, k, b in both
    ]


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` (kind, start, end, base, value) of every row."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    identity = rows.schema["id"].dataType.simpleString()
    piece = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]
    )

    def search(batches):
        for batch in batches:
            spans = [spans_of(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(piece))], ["id", "spans"]
            )

    return rows.mapInArrow(search, f"id {identity}, spans {SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["base"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
