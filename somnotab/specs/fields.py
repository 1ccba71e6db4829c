"""The field grammar: how one value is located in normal-form text.

A pattern is written with the placeholders below and may assume single spaces. Instead of
long ``marker ... .* ... value`` expressions a field names the *region* it lives in:

* ``after=(m1, m2)``: the text after the first ``m1``, then after the first ``m2`` in that;
* ``before=m``: the text before the last ``m``. For values that some closing word follows anywhere;
* ``through=m``: the text up to the end of the last ``m``. For values that reach to the next closing word,
  whatever lies between: the first opening word in the region then has one;
* ``pieces=p``: what the group of ``p`` holds at each of its matches, each behind a line feed (``\n``), with a
  tab (``\t``) for the end of the text. For values of certain characters up to a closing word: ``p`` is the
  opening word and, in the group, all such characters behind it and the closing word if it is another one. An
  opening word inside a piece needs no piece of its own, since what closes its value closes the
  outer one as well; one that reaches past the end of the piece must not be swallowed, so ``p`` stops there.
* ``shortened=p``: the text with each match of ``p`` cut down to its group, behind a line feed. For stretches in which no
  value can end, and whose opening words would each be tried to their end.

For a leftmost search these say the same as the long expression, but a region is cut once per
record and shared by all fields that name it, and a missing marker leaves nothing to search. However often
the opening words repeat, and wherever the closing word stands, no text is read once for each of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# The placeholders of the pattern notation.
PLACEHOLDERS = {
    "{num}": r"\d+(?:[.,]\d+)?",
    "{dec}": r"\d+[.,]\d+",
    "{loose}": r"[\d.,]+",
    "{open}": r"\d+[.,]?\d*",
    "{num3}": r"\d{1,3}(?:[.,]\d+)?",
    "{dmy}": r"\d{1,2}[/-]\d{1,2}[/-]\d{4}",
    "{ymd}": r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    "{hms}": r"\d+:\d+:\d+",
    "{words}": r"[\w-](?:[\w -]*[\w-])?",
    "{two words}": r"[\w-]+ [\w -]*[\w-]",
    "{colon}": r" ?:? ?",
    "{sep}": r" ?[:|]? ?",
    "{cell}": r" ?[:|]? ?\|? ?",
    # The end of a word in a piece: what follows it belongs to the piece, unless another label cuts the word off.
    "{end}": r"(?!\n)\W",
}


def expand(pattern: str) -> str:
    for name, meaning in PLACEHOLDERS.items():
        pattern = pattern.replace(name, meaning)
    return pattern


# Inside a group: digits, number marks, quantifiers, alternatives; nothing that has a case.
_CASELESS = re.compile(r"(?:\\d|\[[\\d.,/-]+\]|\\\.|[\d{},?*+()|:/-])*")
_TOKEN = re.compile(r"\\.|\[\^?\]?[^\]]*\]|\(\?|\(|\)|[^\\]")


def _groups(pattern: str) -> list[str]:
    """Contents of the capturing groups."""
    found, open_groups = [], []
    for token in _TOKEN.finditer(pattern):
        if token.group() in ("(", "(?"):
            open_groups.append(token.end() if token.group() == "(" else None)
        elif token.group() == ")":
            start = open_groups.pop()
            if start is not None:
                found.append(pattern[start : token.start()])
    return found


@dataclass(frozen=True)
class Field:
    """One value of a record.

    ``pattern`` has one capturing group, or ``groups`` of which the first non-empty one counts.
    ``cased`` makes the pattern and its markers case-sensitive; otherwise they are written in
    lower case.
    """

    name: str
    pattern: str
    after: tuple[str, ...] = ()
    before: str | None = None
    through: str | None = None
    pieces: str | None = None
    shortened: str | None = None
    cased: bool = False
    groups: int = 1

    @property
    def lowered(self) -> bool:
        """Search the lower-cased text: the case does not matter and cannot be in the value.

        A plain search of lower-cased text is several times faster than a search that ignores
        case, and most values are numbers or dates.
        """
        return not self.cased and all(_CASELESS.fullmatch(g) for g in _groups(expand(self.pattern)))

    @property
    def flags(self) -> str:
        return "U" if self.cased or self.lowered else "iU"

    @property
    def regex(self) -> str:
        return f"(?{self.flags}){expand(self.pattern)}"

    @property
    def region(self) -> tuple:
        """Identity of the region: whose text it is cut from, then the chain of cuts."""
        cuts = tuple(("after", m, self.flags) for m in self.after)
        if self.before is not None:
            cuts += (("before", self.before, self.flags),)
        if self.through is not None:
            cuts += (("through", self.through, self.flags),)
        if self.pieces is not None:
            cuts += (("pieces", expand(self.pieces), self.flags),)
        if self.shortened is not None:
            cuts += (("shortened", expand(self.shortened), self.flags),)
        return (self.lowered, *cuts)

    def named(self, name: str) -> "Field":
        return replace(self, name=name)


def cased(*fields: Field) -> list[Field]:
    """The same fields, matched case-sensitively."""
    return [replace(f, cased=True) for f in fields]


def column(label: str, k: int, value: str = "{num}") -> str:
    """k-th number of a space-separated table row that starts with ``label``."""
    skipped = f"(?:{value} ){{{k - 1}}}" if k > 1 else ""
    return f"{label} {skipped}({value})"


def cell(label: str, k: int, skip: str = "{loose}", value: str = "{loose}") -> str:
    """k-th cell of a pipe-separated table row that starts with ``label``."""
    skipped = f"(?:{skip}\\|){{{k - 1}}}" if k > 1 else ""
    return f"{label}\\|{skipped}({value})"
