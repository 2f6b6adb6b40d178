"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in a join on the hash of a run of ``SEED`` words. Pairs whose shared seeds could cover
enough of the item are tiled: a running Karp-Rabin hash finds the longest run of words that stands unmarked in both, all such
runs are marked from left to right, then the next shorter length, until no match of the least length is left. The tiles' share of
the item's words is its coverage, in which order does not matter: an item whose sentences stand in another order is caught
all the same. Matches are compared word by word (as 64-bit hashes) before they are marked.

Scale: one pass over the documents asks a bit table of fixed size whether a seed may be one of the benchmark's (its errors
cost traffic and change no result) and leaves only documents that may match, once per text and task. An item is looked for by
its rarer seeds only: the commonest ones, counted over all texts, stay out of the join as far as they could not cover enough by
themselves, so a licence line in many texts and items makes no pairs. Seeds, pairs and words
then meet in joins of written tables, so the benchmark may be of any size and nothing of it but the bit table passes through the
driver. Equal texts and equal items are tiled once. A pair's work grows with its shared runs, not with the products of
repeated words.

Defined cases: null text is empty; empty documents and items match nothing; an item shorter than the seed must occur
whole; repeated rows each report; an empty table on either side gives no pairs; extra columns are ignored by ``contaminated``
and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .shingles import WordHash, hashes, shingles, words_of

SEED = 5
THRESHOLD = 0.6
#: Bits of the table that says whether a seed may be the benchmark's; two of them stand for a seed.
TABLE_BITS = 1 << 26
#: Texts that a task remembers to skip repeats; forgetting costs repeated rows only.
REMEMBERED = 200_000
# The base of the running hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of every window of a word sequence, by sums that run along it, and which words are marked."""

    def __init__(self, words: np.ndarray, marked: np.ndarray) -> None:
        self.words, self.marked = words, marked
        power = np.cumprod(np.full(len(words), BASE, np.uint64))
        self.back = np.cumprod(np.full(len(words), INVERSE, np.uint64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window of ``n`` words without a marked one."""
        if n > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` occur in ``b``."""
    if not len(b):
        return np.zeros(len(a), bool)
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def stretches(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the document that windows of the least length share with the item, a marked word between them."""
    hit = both(shingles(doc, least), shingles(item, least))
    inside = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + least, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(kept):
        return doc[:0], np.zeros(0, bool)
    gap = np.flatnonzero(np.diff(kept) > 1) + 1
    return np.insert(doc[kept], gap, 0), np.insert(np.zeros(len(kept), bool), gap, True)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles of a greedy tiling: the longest match first, of equal ones the leftmost in the document, then the item."""
    if not len(item) or len(doc) < least:
        return []
    d, t = Running(*stretches(doc, item, least)), Running(item, np.zeros(len(item), bool))
    out: list[int] = []
    longest = min(len(d.words), len(item))
    while True:
        low, high = least - 1, longest  # a run of some length holds runs of every smaller one, so halving finds the longest
        while low < high:
            n = (low + high + 1) // 2
            if both(d.windows(n)[1], t.windows(n)[1]).any():
                low = n
            else:
                high = n - 1
        if low < least:
            return out
        longest = low
        at, found = d.windows(longest)
        places: dict[int, deque[int]] = defaultdict(deque)
        for j, h in zip(*(x.tolist() for x in t.windows(longest)), strict=True):
            places[h].append(j)
        hit = both(found, np.fromiter(places, np.uint64, len(places)))
        begun = len(out)
        for i, h in zip(at[hit].tolist(), found[hit].tolist(), strict=True):
            if d.marked[i : i + longest].any():
                continue
            free = places[h]
            while free and t.marked[free[0] : free[0] + longest].any():
                free.popleft()
            if free and (d.words[i : i + longest] == t.words[free[0] : free[0] + longest]).all():
                d.marked[i : i + longest] = t.marked[free[0] : free[0] + longest] = True
                out.append(longest)
        if len(out) == begun:
            longest -= 1  # only where two windows share a hash and differ


def items_of(benchmark: DataFrame) -> DataFrame:
    """Written: (item, item_words, least, words, seeds): every distinct text of the benchmark that holds words, keyed by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            found = [hashes(words_of(x.as_py()), known) for x in batch.column(0)]
            found = [h for h in found if len(h)]
            least = [min(SEED, len(h)) for h in found]
            seeds = [dict(zip(*(x.tolist() for x in np.unique(shingles(h, k), return_counts=True)), strict=True)) for h, k in zip(found, least, strict=True)]
            seeds = [[{"seed": s - (1 << 64) if s >> 63 else s, "windows": n} for s, n in x.items()] for x in seeds]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("windows", pa.int32())])))
            columns = ([key_of(h) for h in found], [len(h) for h in found], least, [h.tobytes() for h in found], seeds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "item_words", "least", "words", "seeds"])

    made = benchmark.select(common.text_of().alias("text")).mapInArrow(run, "item binary, item_words int, least int, words binary, seeds array<struct<seed:long,windows:int>>")
    return common.materialise(made.dropDuplicates(["item"]), "items")


def key_of(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def seed_table(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table of all seeds, and the seed lengths in use (at most ``SEED`` of them). Set word by word, so the driver
    receives at most that table."""
    seeds = items.select(F.explode("seeds.seed").alias("s"))
    bit = F.explode(F.array(F.col("s").bitwiseAND(TABLE_BITS - 1), F.shiftrightunsigned("s", 32).bitwiseAND(TABLE_BITS - 1)))
    words = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(TABLE_BITS >> 6, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64), sorted(r[0] for r in items.select("least").distinct().collect())


def maybe(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The seeds whose two bits are set."""
    for shift in (0, 32):
        bit = (seeds >> np.uint64(shift)) & np.uint64(TABLE_BITS - 1)
        seeds = seeds[(table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return seeds


def marked(docs: DataFrame, items: DataFrame, every: bool) -> tuple[DataFrame, str]:
    """Written: the documents with a further column (its name comes second), a struct of text key, words and possible seeds, or
    null where no seed is the benchmark's. Without ``every`` only the documents where it is not null."""
    held = docs.sparkSession.sparkContext.broadcast(seed_table(items))
    at, mark = docs.columns.index("text"), common.fresh(docs.columns)
    kind = pa.struct([("key", pa.binary()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, lengths), known = held.value, WordHash()
        for batch in common.slices(batches):
            out: list[dict | None] = []
            for text in batch.column(at):
                h = hashes(words_of(text.as_py()), known)
                seeds = [maybe(table, shingles(h, k)) for k in lengths if len(h) >= k]
                seeds = np.unique(np.concatenate(seeds)) if seeds else h[:0]
                out.append({"key": key_of(h), "words": h.tobytes(), "seeds": seeds.view(np.int64)} if len(seeds) else None)
            columns = [*batch.columns, pa.array(out, kind)]
            if not every:
                # Words are kept; the text itself is not needed any more.
                columns[at] = pa.repeat("", batch.num_rows).cast(batch.schema.field(at).type)
            made = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, mark])
            yield made if every else made.filter(made.column(len(columns) - 1).is_valid())

    ddl = T.StructType([*docs.schema.fields, T.StructField(mark, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("seeds", T.ArrayType(T.LongType()))]))])
    return common.materialise(docs.mapInArrow(common.lean(run), ddl), "marked"), mark


def rare_seeds(seeds: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(seed, item, least): the seeds by which an item is looked for. A text that covers enough of an item shares ``need`` of its
    windows at least, so the item's commonest seeds can stay out as long as they make fewer windows than that: whoever
    shares enough shares one of the others. A phrase that a third of all texts and many items hold is among those."""
    index = items.select("item", "item_words", "least", F.explode("seeds").alias("s")).select("item", "item_words", "least", "s.seed", "s.windows")
    texts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("texts"))
    known = index.join(texts, "seed")
    order = Window.partitionBy("item").orderBy(F.desc("texts"), "seed")
    common_windows = F.sum("windows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    need = F.ceil(F.lit(threshold) * F.col("item_words") / F.col("least"))
    return known.withColumn("so_far", common_windows).filter(F.col("so_far") >= need).select("seed", "item", "least")


def covered(found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Written: (key, item, covered_words, item_words, n_tiles) of the texts (key, words, seeds) that cover an item by ``threshold``."""
    texts = common.materialise(found.dropDuplicates(["key"]), "texts")
    seeds = texts.select("key", F.explode("seeds").alias("seed"))
    met = seeds.join(rare_seeds(seeds, items, threshold), "seed").select("key", "item", "least").distinct()
    pairs = common.materialise(met, "pairs")
    both_sides = pairs.join(texts.select("key", "words"), "key").join(items.select("item", F.col("words").alias("item_text")), "item").select("key", "item", "least", "words", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, item, least, words, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, doc = np.frombuffer(text, np.uint64), np.frombuffer(words, np.uint64)
                if both(shingles(own, least), shingles(doc, least)).sum() * least < threshold * len(own):
                    continue  # a window covers ``least`` words, so these cannot cover enough
                laid = tiles(doc, own, least)
                if laid and sum(laid) >= threshold * len(own):
                    out.append((key, item, sum(laid), len(own), len(laid)))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names=["key", "item", "covered_words", "item_words", "n_tiles"])

    return common.materialise(both_sides.mapInArrow(common.lean(run), "key binary, item binary, covered_words int, item_words int, n_tiles int"), "covered")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id) whose tiles cover at least ``threshold`` of the item, with what they cover."""
    items = items_of(benchmark)
    rows, mark = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")), items, every=False)
    found = covered(rows.select(f"{mark}.*"), items, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key_of(hashes(words_of(x.as_py()), known)) for x in batch.column(1)], pa.binary())], names=["item_id", "item"])

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).mapInArrow(keyed, "item_id long, item binary")
    pairs = rows.select("doc_id", F.col(f"{mark}.key").alias("key")).join(found, "key").join(named, "item")
    return pairs.select("doc_id", "item_id", "covered_words", "item_words", "n_tiles", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that cover no item by ``threshold``, columns unchanged. Only documents that may match move to be judged."""
    items = items_of(benchmark)
    rows, mark = marked(docs, items, every=True)
    maybe_hit = rows.filter(F.col(mark).isNotNull())
    found = covered(maybe_hit.select(f"{mark}.*"), items, threshold).select(F.col("key").alias(mark)).distinct()
    same = [F.col(f"`{c}`") for c in docs.columns]
    free = maybe_hit.select(*same, F.col(f"{mark}.key").alias(mark)).join(found, mark, "left_anti").select(*same)
    return rows.filter(F.col(mark).isNull()).select(*same).unionByName(free)
