"""Runs of repeated words, found by Crochemore's partition refinement over word positions.

At length L the positions of a text fall into classes: two positions are in one class if the L words from each are the same. Going from
L to L + 1, a class splits by the classes that follow its members, and only those classes need to be looked at that are new pieces of
a class that split in the step before, all but the largest piece (the smaller half): every position is touched a logarithmic number of
times. Each class is a linked list in order of position. Two neighbours of a class at distance L when the length is L are the
halves of a square, and its root is no power, as a power would put a member between them. A neighbour's distance changes only when a
list changes, so squares are read off at that moment, from the lengths over which the two were neighbours. Squares of one period at
consecutive positions make up a run.

A run of exponent ``power`` gives each of its squares at least ``power`` - 1 members in its class at every length up to the period.
Smaller classes can never show one and are given up, with all that would follow from them; that is most of ordinary text after a few
lengths. Lengths end at size / ``power``. The steps are numpy operations over all texts of a batch at once (classes never reach
across texts).

There is no shuffle: each text is handled within its task; memory goes with a batch of some 2^18 words, or with one text if that is
longer. Recovery: a lost task is simply run again.

Defined cases: a null or empty text has no words and no runs (four nulls, digests of the empty text); repeated rows and ids give a row each; ties
for the longest run go to the smallest start, then the smallest period; an empty table gives no rows; extra columns are ignored, whatever
their names; a null id is planted like the empty text for an id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has at least LEAST words and at least POWER times its period.
LEAST, POWER = 6, 4
#: Words of a batch, and bytes of words that stay numbered from one batch to the next.
BATCH_WORDS, KNOWN_BYTES = 1 << 18, 1 << 24


class Numbers(dict):
    """Numbers words in order of appearance."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + 64
        v = self[word] = len(self)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if self.size > KNOWN_BYTES:
            self.clear()
            self.size = 0


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    """The lengths of the stretches that begin at ``first``, up to ``n``."""
    out = np.empty(len(first), np.int64)
    if len(first):
        out[:-1], out[-1] = first[1:] - first[:-1], n - first[-1]
    return out


class Refinement:
    """The classes of positions of several texts, at growing length."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, power: int) -> None:
        n, self.fewest = len(numbers), max(2, power - 1)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.head = np.zeros(n, bool)
        self.head[self.starts[sizes > 0]] = True
        self.limits = sizes // power
        self.cls, self.nxt, self.prv = (np.full(n, -1, np.int64) for _ in range(3))
        self.born = np.ones(n, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.classes = 0
        self.length = 1
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        text = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(text * (int(numbers.max(initial=0)) + 1) + numbers, kind="stable")
        first = firsts(numbers[order], text[order])
        group = lengths(first, n)
        alive = (group >= self.fewest) & (self.limits[text[order[first]]] > 0)
        self.fresh = self.link(order[np.repeat(alive, group)], group[alive])
        self.dead = np.flatnonzero(self.cls < 0)

    def link(self, members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Make classes of consecutive stretches of ``members``, each in order of position."""
        if len(sizes):
            ids = self.classes + np.arange(len(sizes))
            self.classes += len(sizes)
            if self.classes > len(self.count):
                self.count = np.concatenate([self.count, np.zeros(max(self.classes, len(self.count)), np.int64)])
            self.count[ids] = sizes
            self.cls[members] = np.repeat(ids, sizes)
            self.born[members] = self.length
            last = np.cumsum(sizes) - 1
            self.nxt[members[:-1]], self.prv[members[1:]] = members[1:], members[:-1]
            self.nxt[members[last]], self.prv[members[last - sizes + 1]] = -1, -1
        return members

    def read_off(self, at: np.ndarray) -> None:
        """Squares that these positions began, before their next neighbour changes."""
        far = self.nxt[at] - at
        hit = (far >= self.born[at]) & (far <= self.length)
        if hit.any():
            self.found.append((at[hit], far[hit]))

    def members(self, ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """All members of these classes, in order of class and position; ``inside``: one member of each."""
        total = int(self.count[ids].sum())
        if 16 * total < len(self.cls):  # walk the lists, all of them at once where they are short
            rows, steps = [inside], int(self.count[ids].max(initial=0))
            for way in (self.nxt, self.prv):
                at = inside
                for _ in range(steps):
                    at = way[at]
                    at = at[at >= 0]
                    if not len(at):
                        break
                    rows.append(at)
            found = np.concatenate(rows)
        else:
            wanted = np.zeros(self.classes + 1, bool)
            wanted[ids] = True
            found = np.flatnonzero(wanted[self.cls])
        return found[np.lexsort((found, self.cls[found]))]

    def step(self) -> None:
        """From the classes at ``length`` to those of one word more."""
        gone = self.dead[~self.head[self.dead]] - 1
        if self.length == 1:  # nothing follows a text's last word
            gone = np.concatenate([gone, self.ends[self.ends > self.starts] - 1])
        gone = gone[self.cls[gone] >= 0]
        split = self.fresh[~self.head[self.fresh]]
        split = split[self.cls[split - 1] >= 0]
        label, at = self.cls[split], split - 1
        own = self.cls[at]
        order = np.lexsort((at, own * (self.classes + 1) + label))
        at, own, label = at[order], own[order], label[order]
        first = firsts(own, label)
        sizes = lengths(first, len(at))
        # Classes that go on as they are, all of them before one class.
        whole = sizes == self.count[own[first]]
        if whole.any():
            stay = np.repeat(whole, sizes)
            at, own = at[~stay], own[~stay]
            sizes = sizes[~whole]
            first = np.cumsum(sizes) - sizes
        parents = own[first]
        moved = np.concatenate([at, gone])
        if not len(moved):
            self.fresh = self.dead = moved
            self.length += 1
            return
        home = np.concatenate([own, self.cls[gone]])
        order = np.lexsort((moved, home))
        moved, home = moved[order], home[order]
        # Take what moves out of the lists, stretch by stretch.
        self.read_off(moved)
        apart = np.ones(len(moved) + 1, bool)
        apart[1:-1] = self.nxt[moved[:-1]] != moved[1:]
        left, right, block_home = self.prv[moved[apart[:-1]]], self.nxt[moved[apart[1:]]], home[apart[:-1]]
        some = left >= 0
        self.read_off(left[some])
        begin = firsts(home)
        affected, n_moved = home[begin], lengths(begin, len(home))
        self.length += 1
        self.nxt[left[some]], self.born[left[some]] = right[some], self.length
        some_right = right >= 0
        self.prv[right[some_right]] = left[some_right]
        self.count[affected] -= n_moved
        self.cls[moved] = -1
        # A member of what is left of each class, if anything is.
        entry = np.full(len(affected), -1, np.int64)
        slot = np.searchsorted(affected, block_home)
        entry[slot[some]] = left[some]
        entry[slot[some_right]] = right[some_right]
        rest = self.count[affected]
        largest = np.zeros(len(affected), np.int64)
        group_slot = np.searchsorted(affected, parents)
        np.maximum.at(largest, group_slot, sizes)
        few = (rest > 0) & (rest < self.fewest)
        turned = (rest >= self.fewest) & (largest > rest)
        dying = self.members(affected[few], entry[few]) if few.any() else moved[:0]
        fresh_rest = self.members(affected[turned], entry[turned]) if turned.any() else moved[:0]
        if len(dying):
            self.read_dying(dying)
        # The moved groups become classes of their own, or are given up.
        big = sizes >= self.fewest
        mask = np.repeat(big, sizes)
        self.link(at[mask], sizes[big])
        # Only the largest piece of a class that split need not be looked at in the next step.
        spare = np.zeros(len(sizes), bool)
        if len(sizes):
            candidates = np.flatnonzero((sizes == largest[group_slot]) & (largest[group_slot] > rest[group_slot]))
            spare[candidates[firsts(group_slot[candidates])]] = True
        self.fresh = np.concatenate([at[np.repeat(big & ~spare, sizes)], fresh_rest])
        self.dead = np.concatenate([gone, at[~mask], dying])

    def read_dying(self, at: np.ndarray) -> None:
        """Give these members up. They were neighbours up to the length before this one, unless their list changed just now."""
        self.length -= 1
        self.read_off(at)
        self.length += 1
        self.cls[at] = -1

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of all squares in classes that were kept."""
        order = np.argsort(self.limits, kind="stable")
        limits, done = self.limits[order], 0
        while done < len(order):
            until = int(np.searchsorted(limits, self.length, "right"))
            for text in order[done:until]:  # no longer period is possible in these
                a, b = self.starts[text], self.ends[text]
                rest = a + np.flatnonzero(self.cls[a:b] >= 0)
                if len(rest):
                    self.read_off(rest)
                    self.cls[rest] = -1
            done = max(done, until)
            if done == len(order):
                break
            if len(self.fresh) or len(self.dead):
                self.step()
            else:
                self.length = int(limits[done])  # nothing splits any more
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) if c else none for c in (zip(*self.found, strict=True) if self.found else ((), ())))


def find(numbers: np.ndarray, sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; ``numbers`` holds the words of all texts, ``sizes`` their counts."""
    at, period = Refinement(numbers, sizes, power).squares()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = firsts(at - np.arange(len(at)), period)
    period = period[first]
    runs = np.stack([at[first], lengths(first, len(at)) - 1 + 2 * period, period], 1)
    runs = runs[runs[:, 1] >= np.maximum(least, power * period)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic texts: a tenth of all ids repeat a stretch of their own words to the end."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def as_is(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


Prepare = Callable[[int | None, list[bytes]], list[bytes]]
Found = tuple[int | None, list[bytes], np.ndarray]


def texts_with_runs(batches: Iterator[pa.RecordBatch], prepare: Prepare, least: int, power: int) -> Iterator[list[Found]]:
    """(doc_id, text) in; per text its id, words and runs (start, length, period), a batch at a time."""
    numbers, ids, texts, n = Numbers(), [], [], 0

    def solve() -> list[Found]:
        sizes = np.array([len(w) for w in texts], np.int64)
        coded = [numbers.of(w) for w in texts]
        runs = find(np.concatenate(coded), sizes, least, power)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(runs[:, 0], np.r_[ends - sizes, ends[-1]])
        runs[:, 0] -= np.repeat(ends - sizes, np.diff(cuts))
        numbers.trim()
        return [(i, w, runs[cuts[k] : cuts[k + 1]]) for k, (i, w) in enumerate(zip(ids, texts, strict=True))]

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            piece = batch.slice(k, 256)
            for i, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()), strict=True):
                ids.append(i)
                texts.append(prepare(i, text.as_py().split()))
                n += len(texts[-1]) + 1
                if n >= BATCH_WORDS:
                    yield solve()
                    ids, texts, n = [], [], 0
    if texts:
        yield solve()


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))


def runs(docs: DataFrame, least: int = LEAST, power: int = POWER, prepare: Prepare = as_is) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in texts_with_runs(batches, prepare, least, power):
            table = np.concatenate([r for *_, r in done])
            ids = [i for i, _, r in done for _ in range(len(r))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(table[:, c], pa.int64()) for c in range(3))], names=["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST, power: int = POWER, prepare: Prepare = as_is) -> DataFrame:
    """(doc_id, text): each text's words, runs cut down to their first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in texts_with_runs(batches, prepare, least, power):
            texts = [b" ".join(collapsed(w, r)) for _, w, r in done]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in done], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return _rows(docs).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, least: int = LEAST, power: int = POWER, prepare: Prepare = planted) -> DataFrame:
    """Per row of ``docs``: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    names = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in texts_with_runs(batches, prepare, least, power):
            numbers, listed, left = [], [], []
            for _, words, found in done:
                longest = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist() if len(found) else None
                numbers.append((len(found), *(longest + [1000 * longest[1] // longest[2]] if longest else (None,) * 4)))
                listed.append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found.tolist()).encode()).hexdigest())
                left.append(hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
            columns = [pa.array([i for i, *_ in done], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)), pa.array(listed), pa.array(left)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "runs_sha256", "collapsed_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", runs_sha256 string, collapsed_sha256 string")
