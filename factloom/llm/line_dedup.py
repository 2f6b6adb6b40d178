"""Line deduplication by a range-partitioned sort of line hashes; documents get compressed keep bitmaps, not new texts.

Every long line becomes a narrow record (128-bit hash of its key, document, position). Records are range-partitioned and sorted by
hash, then document (largest first), then position, and streamed: a run of equal hashes is decided as soon as it has shown enough
documents, so a task remembers one run's first few documents and no more. The sort key goes down to the position, so a line that
stands in a third of all documents is cut into many ranges like any other rows. Only the run at each edge of a partition may go on
next door: its few undecided rows and its first few documents are settled in a small join afterwards.

Positions to drop are then gathered per document (a document's own lines bound the group) as a bitmap. Texts move once, and only
where the kept text itself is asked for: ``bitmaps`` never moves them.

A document is an id. Rows that repeat an id with another text are told apart by a hash of the text.

Recovery: records, decisions and bitmaps are written tables; every later task rereads files.

Defined cases: a null or empty text is one empty line; a null id counts as the smallest id; rows that repeat an id count as one
document, and all lines of the largest id that holds a key stay, in every row of that id; equal rows get equal results; a document
that loses all its lines keeps the empty text; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys of fewer code points stay; keys in fewer documents stay.
MIN_CHARS, MIN_DOCS = 40, 5
#: White space that is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Undecided rows of one run that a task holds before it passes them on undecided (an id may be repeated without end).
HELD_ROWS = 1 << 16
LEAST_ID = -(1 << 63)
DROPPED, OPEN, SEEN = 0, 1, 2
KEYS = ("high", "low", "back", "digest", "pos")
NAMES = ("high", "low", "back", "digest", "n_lines", "pos")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def keyed_rows(docs: DataFrame) -> DataFrame:
    """back: the id with its order turned round; digest: tells texts of one id apart."""
    text = common.text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))).alias("back"), F.xxhash64(text).alias("digest"), text.alias("text"))


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or null where the key is short."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def splitter(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                found, at, sizes, counts = [], [], [], []
                for text in piece.column(2).cast(pa.binary()).to_pylist():
                    lines, before = text.split(b"\n"), len(found)
                    for i, line in enumerate(lines):
                        if len(line) >= min_chars and (h := key_of(line, min_chars)) is not None:
                            found.append(h)
                            at.append(i)
                    sizes.append(len(lines))
                    counts.append(len(found) - before)
                h = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype(np.int64)
                own = [np.repeat(c.to_numpy(zero_copy_only=False), counts) for c in (piece.column(0), piece.column(1))]
                columns = (h[:, 0], h[:, 1], *own, np.repeat(np.array(sizes, np.int32), counts), np.array(at, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=list(NAMES))

    return run


class Run:
    """The run of equal hashes that a stream stands in; ``rows`` are those that wait for a decision."""

    def __init__(self, key: tuple[int, int], edge: bool) -> None:
        self.key, self.edge, self.open = key, edge, edge
        self.docs: list[int] = []
        self.rows: list[np.ndarray] = []
        self.n_rows = 0


def stream(min_docs: int):
    """Sorted records in; out: rows to drop, rows that wait for the neighbours' word, and the first documents of such runs."""

    def emit(kind: int, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(table), kind, np.int8)), *(pa.array(table[:, i], pa.int64()).cast(t) for i, t in enumerate(KINDS))], names=["kind", *NAMES])

    def grow(run: Run, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the run's key, in order."""
        if len(run.docs) < min_docs:
            back = rows[:, 2]
            for b in back[np.flatnonzero(np.r_[True, back[1:] != back[:-1]])][: min_docs + 1].tolist():
                if len(run.docs) < min_docs and (not run.docs or run.docs[-1] != b):
                    run.docs.append(b)
        run.rows.append(rows if run.edge else rows[rows[:, 2] != run.docs[0]])  # the largest id is known unless the run began next door
        run.n_rows += len(run.rows[-1])
        if len(run.docs) >= min_docs:
            held = np.concatenate(run.rows)
            first = held[:, 2] == run.docs[0]
            yield emit(DROPPED, held[~first])
            if run.edge:
                yield emit(OPEN, held[first])
            run.rows, run.n_rows = [], 0
        elif run.n_rows > HELD_ROWS:
            yield emit(OPEN, np.concatenate(run.rows))
            run.rows, run.n_rows, run.open = [], 0, True

    def close(run: Run | None, last: bool) -> Iterator[pa.RecordBatch]:
        if run and (run.open or last):
            if run.rows:
                yield emit(OPEN, np.concatenate(run.rows))
            seen = np.zeros((len(run.docs), len(NAMES)), np.int64)
            seen[:, :2], seen[:, 2] = run.key, run.docs
            yield emit(SEEN, seen)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            starts = np.r_[0, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1, len(rows)]
            key = (int(rows[0, 0]), int(rows[0, 1]))
            if run is None or run.key != key:
                yield from close(run, False)
                run = Run(key, run is None)
            yield from grow(run, rows[: starts[1]])
            if len(starts) == 2:
                continue
            yield from close(run, False)
            whole = rows[starts[1] : starts[-2]]
            if len(whole):
                sizes = np.diff(starts[1:-1])
                begins = np.repeat(starts[1:-2] - starts[1], sizes)
                new = np.r_[True, (whole[1:, :3] != whole[:-1, :3]).any(1)]
                docs = np.repeat(np.add.reduceat(new, starts[1:-2] - starts[1]), sizes)
                yield emit(DROPPED, whole[(docs >= min_docs) & (whole[:, 2] != whole[begins, 2])])
            run = Run((int(rows[starts[-2], 0]), int(rows[starts[-2], 1])), False)
            yield from grow(run, rows[starts[-2] :])
        yield from close(run, True)

    return task


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written: (back, digest, n_lines, n_dropped, keep) of the texts that lose lines; ``keep`` is a zlib-compressed bitmap, the
    first line in the highest bit of the first byte. Texts that are not listed keep all their lines."""
    kinds = ", ".join(f"{n} {t}" for n, t in zip(NAMES, ("long",) * 4 + ("int",) * 2, strict=True))
    lines = common.materialise(keyed_rows(docs).select("back", "digest", "text").mapInArrow(splitter(min_chars), kinds), "lines")
    ordered = lines.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    told = common.materialise(ordered.mapInArrow(stream(min_docs), f"kind tinyint, {kinds}"), "told")
    of = lambda kind: told.filter(F.col("kind") == kind)
    runs = of(SEEN).groupBy("high", "low").agg(F.count_distinct("back").alias("docs"), F.min("back").alias("largest"))
    late = of(OPEN).join(runs.filter(F.col("docs") >= min_docs), ["high", "low"]).filter(F.col("back") != F.col("largest"))
    columns = ("back", "digest", "n_lines", "pos")
    drops = of(DROPPED).select(*columns).unionAll(late.select(*columns))
    gathered = drops.groupBy("back", "digest").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, maps = batch.column(3), []
            for n, gone in zip(batch.column(2).to_pylist(), dropped, strict=True):
                keep = np.ones(n, bool)
                keep[gone.values.to_numpy(zero_copy_only=False)] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(dropped.offsets.to_numpy()), pa.int32()), pa.array(maps, pa.binary())], names=["back", "digest", "n_lines", "n_dropped", "keep"])

    return common.materialise(gathered.mapInArrow(packed, "back long, digest long, n_lines int, n_dropped int, keep binary"), "bitmaps")


def kept_lines(text: bytes, keep: bytes) -> bytes:
    """The text without the lines whose bit is off."""
    lines = text.split(b"\n")
    on = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join([lines[i] for i in np.flatnonzero(on)])


def joined(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, text, n_dropped, keep); the bitmaps are far smaller than the texts, so they are the side that is hashed."""
    rows, maps = keyed_rows(docs), bitmaps(docs, min_chars, min_docs).select("back", "digest", "n_dropped", "keep")
    return rows.join(maps.hint("shuffle_hash"), ["back", "digest"], "left").select("doc_id", "text", "n_dropped", "keep")


def kept(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text): the texts that the bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None else kept_lines(t, k) for t, k in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return joined(docs, min_chars, min_docs).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines before dropping, n_dropped, SHA-256 of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for text, keep in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sizes.append(text.count(b"\n") + 1)
                sums.append(hashlib.sha256(text if keep is None else kept_lines(text, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2).fill_null(0).cast(pa.int64()), pa.array(sums)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined(docs, min_chars, min_docs).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
