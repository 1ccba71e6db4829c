"""Column functions for report text: normal form, classification key, slices, first-group extract.

Everything downstream works on the *normal form*: accents folded, every whitespace run one
space, no space at the ends. Patterns may therefore write one literal space where raw text
would need a whitespace class, and never have to cross a line end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve letters that are folded. Other accented letters stay as they are.
FOLDED_FROM = "áéíóúÁÉÍÓÚñÑ"
FOLDED_TO = "aeiouAEIOUnN"

# Unicode whitespace other than the plain space.
_OTHER_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def fold_accents(text: Column) -> Column:
    """Replace the twelve folded letters by their plain form."""
    return F.translate(text, FOLDED_FROM, FOLDED_TO)


def normalize(text: Column) -> Column:
    """Fold accents, collapse whitespace runs to one space, trim.

    One ``translate`` pass does the folding and turns every whitespace character into a
    space, so the regular expression only has to find runs of two or more spaces and is idle
    on ordinary prose.
    """
    spaced = F.translate(
        text, FOLDED_FROM + _OTHER_SPACES, FOLDED_TO + " " * len(_OTHER_SPACES)
    )
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def phrase_key(normal: Column) -> Column:
    """Lower-cased normal form, for plain searches of fixed phrases.

    The one letter whose lower case is two characters is replaced first, so that the key is as
    long as the text.
    """
    return F.lower(F.replace(normal, F.lit("İ"), F.lit("i")))


def marker_key(key: Column) -> Column:
    """The phrase key as a search that ignores case reads it: ``ı`` is ``i``, and ``ſ`` is ``s``."""
    return F.replace(F.replace(key, F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def is_ascii(text: Column) -> Column:
    """True when every character is ASCII, so that no key needs a replacement."""
    return F.octet_length(text) == F.length(text)


def openings(key: Column, word: str, length: int) -> Column:
    """What begins with ``word`` in the key, ``length`` characters of each place, joined by line feeds.

    A phrase of at most that length that begins with the word is in the key if it is in here: one search of
    the key serves all such phrases. The normal form has no line feeds, and places may overlap.
    """
    found = F.regexp_extract_all(key, F.lit(f"(?s){word}(?=(.{{0,{length - len(word)}}}))"), F.lit(1))
    return F.concat(F.lit(word), F.array_join(found, f"\n{word}"))


def unfolded_pattern(words: tuple[str, ...]) -> str:
    """Pattern that finds folded, lower-case words in raw text, whatever its accents and case.

    The accented spellings are listed in both cases, and so is the dotted capital that the
    phrase key replaces; the rest of the alphabet is plain, so plain case folding is enough.
    """
    spellings = {"i": "İ"}
    for raw, folded in zip(FOLDED_FROM, FOLDED_TO):
        letter = folded.lower()
        spellings[letter] = spellings.get(letter, "") + raw
    patterns = [
        "".join(f"[{c}{spellings[c]}]" if c in spellings else c for c in word) for word in words
    ]
    return "(?i)" + "|".join(patterns)


def contains_any(key: Column, phrases: tuple[str, ...]) -> Column:
    """True when any of the (lower-case) phrases occurs in the key."""
    test = key.contains(phrases[0])
    for phrase in phrases[1:]:
        test = test | key.contains(phrase)
    return test


def slice_between(normal: Column, start: str | None, end: str, key: Column | None = None) -> Column:
    """Text after the first ``start`` marker and before the first ``end`` marker after it.

    ``start=None`` means the beginning of the text. The result is trimmed, and empty when a
    marker is absent or nothing lies between them. If no end follows the first start then no
    end follows a later one either, so the end is looked for once, from the first start on: a
    text that repeats the start and lacks the end is read twice, not once per start.

    Markers are lower case. They are looked for in the text's marker key (``key``, if there is a
    column of it), which is as long as the text, so that a place in one is a place in the other.
    """
    key = marker_key(phrase_key(normal)) if key is None else key
    # A lambda holds what is looked at more than once, so that it is cut once.
    rests = F.array(key) if start is None else F.slice(F.split(key, start, 2), 2, 1)
    cut = F.transform(
        rests,
        lambda rest: F.transform(
            F.array(F.split(rest, end, 2)),
            lambda parts: F.when(
                F.size(parts) == 2,
                F.substring(
                    normal, F.length(normal) - F.length(rest) + 1, F.length(F.get(parts, F.lit(0)))
                ),
            ),
        ),
    )
    found = F.get(F.flatten(cut), F.lit(0))
    return F.when(normal.isNotNull(), F.coalesce(F.trim(found), F.lit("")))


def text_after(text: Column, marker: str, flags: str) -> Column:
    """Text after the first match of ``marker``; empty when the marker is absent."""
    return F.regexp_extract(text, f"(?s{flags}){marker}(.*)", 1)


def text_before_last(text: Column, marker: str, flags: str) -> Column:
    """Text before the last ``marker``; empty when it is absent."""
    if "i" in flags or re.search(r"[^\w ]", marker):
        return F.regexp_extract(text, f"(?s{flags})\\A(.*){marker}", 1)
    rest = F.length(F.substring_index(text, marker, -1))
    return F.substring(text, F.lit(1), F.length(text) - rest - len(marker))


def text_through_last(text: Column, marker: str, flags: str) -> Column:
    """Text up to the end of the last ``marker``; empty when it is absent."""
    return F.regexp_extract(text, f"(?s{flags})\\A(.*{marker})", 1)


def text_pieces(text: Column, piece: str, flags: str) -> Column:
    """What the group of ``piece`` holds at each of its matches, from left to right, in one pass.

    Every piece stands behind a line feed and the end of the text is a tab; the normal form has
    neither. Pieces do not overlap, so a search that starts at a line feed and stays in its piece
    reads no character twice.
    """
    marked = F.concat(text, F.lit("\t"))
    found = F.regexp_extract_all(marked, F.lit(f"(?{flags}){piece}"), F.lit(1))
    return F.concat(F.lit("\n"), F.array_join(found, "\n"))


def text_shortened(text: Column, stretch: str, flags: str) -> Column:
    """The text with a line feed and the group of ``stretch`` in place of each of its matches."""
    return F.regexp_replace(text, F.lit(f"(?{flags}){stretch}"), F.lit("\n$1"))


def blank_to_null(value: Column) -> Column:
    """NULL for the empty string, which is how Spark reports an unmatched group."""
    return F.when(value != "", value)


def first_group(text: Column, pattern: str, groups: int = 1) -> Column:
    """First non-empty group of the leftmost match, NULL when there is none."""
    values = [blank_to_null(F.regexp_extract(text, pattern, i)) for i in range(1, groups + 1)]
    return values[0] if groups == 1 else F.coalesce(*values)
