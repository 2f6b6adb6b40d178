"""Where a table's header stands, how its columns are called, and how it is delimited: decided on the head of a file."""

from __future__ import annotations

import csv
import dataclasses
import os
import re
from collections.abc import Sequence

# The header rule's limits.
MOST_SKIPPED, LOOK_AHEAD = 15, 5
DENSE, MOSTLY_TEXT = 0.5, 0.75
DELIMITERS = (",", "\t", ";", "|")
BY_EXTENSION = {".csv": ",", ".tsv": "\t", ".tab": "\t"}
SNIFFED_LINES = 20
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")

Row = tuple[int, list[str]]


@dataclasses.dataclass(frozen=True)
class Header:
    row: int | None
    labels: list[str]
    skipped: list[tuple[int, str]]
    confident: bool


def filled(cells: Sequence[str]) -> list[str]:
    return [c for c in cells if c.strip()]


def is_label(cells: Sequence[str]) -> bool:
    """A line such as ``key: value``: its first filled cell ends in a colon."""
    first = next(iter(filled(cells)), "")
    return first.rstrip().endswith(":")


def text_share(cells: Sequence[str]) -> float:
    have = filled(cells)
    return sum(not _NUMBER.fullmatch(c.strip()) for c in have) / len(have) if have else 0.0


def find_header(rows: Sequence[Row]) -> Header:
    """The first row that reads like a header decides, if all rows above it are sparse or labels; else the first row is taken."""
    rows = [r for r in rows if filled(r[1])]
    if not rows:
        return Header(None, [], [], True)
    counts = [len(filled(c)) for _, c in rows]

    def like(i: int) -> bool:
        cells = rows[i][1]
        if counts[i] < 2 or is_label(cells):
            return False
        share = text_share(cells)
        below = text_share(rows[i + 1][1]) if i + 1 < len(rows) else 0.0
        if share < 1 and (share < MOSTLY_TEXT or share <= below):
            return False
        return counts[i] > DENSE * max(counts[i : i + 1 + LOOK_AHEAD])

    def why(i: int, of: int) -> str | None:
        return "key-value-label" if is_label(rows[i][1]) else "sparse" if counts[i] <= DENSE * counts[of] else None

    at = next((i for i in range(min(len(rows), MOST_SKIPPED + 1)) if like(i)), None)
    sure = at is not None and all(why(i, at) for i in range(at))
    at = at if sure else 0
    return Header(rows[at][0], names(rows[at][1]), [(rows[i][0], why(i, at) or "") for i in range(at)], sure)


def names(labels: Sequence[str], letters: bool = False) -> list[str]:
    """Column names: blank ones by position (or sheet letter), repeated ones numbered until they are new."""
    out: list[str] = []
    for i, label in enumerate(labels):
        base = label.strip() or (letter(i) if letters else f"column_{i + 1}")
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def letter(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def compose(rows: Sequence[Sequence[str]], fill: bool = False) -> list[str]:
    """One label per column from several header rows, joined by `` / ``; ``fill`` carries a group's label to the right."""
    width = max(map(len, rows))
    grid = [[*r, *[""] * (width - len(r))] for r in rows]
    if fill:
        for r in grid[:-1]:
            last = ""
            for i, c in enumerate(r):
                last = c.strip() or last
                r[i] = last
    return [" / ".join(p for p in (r[i].strip() for r in grid) if p) for i in range(width)]


def delimiter(path: str, text: str) -> str | None:
    """The extension's delimiter if the first lines bear it out, else the one that gives the widest even table."""
    hint = BY_EXTENSION.get(os.path.splitext(path)[1].lower())
    lines = [x for x in text.splitlines()[:SNIFFED_LINES] if x.strip()]
    even = {}
    for d in DELIMITERS:
        widths = {len(r) for r in csv.reader(lines, delimiter=d)}
        if len(widths) == 1 and (w := widths.pop()) > 1:
            even[d] = w
    if not even or hint in even:
        return hint
    return max(even, key=lambda d: even[d]) if hint else next(iter(even))
