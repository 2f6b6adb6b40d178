"""Language-model scoring with a hashed maximum-entropy model, its softmax factored by classes.

The probability of a token is that of its class given the words before it, times that of its place in the class given the
class and the words before it: two softmaxes over hashed features (the word before, the word before that as a skip, and both
together) and a bias, the second with features of its own for every class. The ``OWN`` most frequent words and the end token
have a place of their own, so for most tokens the softmax runs down to the token. Rarer words share the places of the last
classes by their endings; which of them it is has the closed-form solution for a bias per token, its add-one count. An unseen
token takes the one spare count of its place, so the model is a proper distribution over the vocabulary and one unseen type.

Counts cover all training documents: tasks combine words before the shuffle. The feature weights are trained by rounds of
distributed gradient updates: every task of a round runs AdaGrad over its documents from the current weights, sends its
change in blocks, and the changes are averaged by tokens seen. Rounds split the documents by hash of the id, and together
they cover all of them once. Texts are split in Arrow and equal words of a batch are looked up once; training and scoring run in
numpy batches.

Scale: the ``TOP`` most frequent words (a fixed bound) and the end token are broadcast with their counts and answer most
tokens in place; only rarer words are joined by key, and none of those is hot. Weights are two fixed tables. Nothing per
document reaches the driver.

Defined cases: null text is empty, and an empty text is one end token; a null id counts as the empty text for the fold;
repeated rows count and score as often as they occur; with no training document every count is zero and places are
uniform; an empty table gives no rows; extra columns are ignored. Words are the runs between ASCII white space, A-Z lower-cased; the end token is kept
as the empty word.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FOLDS, HELD = 7, 2
TOP = 1 << 17
#: Classes, and places in each. The first places are the end token's and the most frequent words', one each in order of
#: frequency; words without one share the last places by the hash of their last two bytes.
CLASSES = WIDTH = 16
SUFFIXES = 64
OWN = CLASSES * WIDTH - SUFFIXES - 1
BUCKETS = 1 << 15
ROUNDS, RATE, BATCH = 2, 0.15, 16384
#: Equal features of a batch that are added together.
SHORT = 16
#: Logits up to here, of either sign, need no shift before they are exponentiated.
SAFE = 60
BLOCKS = 16
#: Documents whose words are looked up together, and those of a training step's batches.
SPLIT_ROWS, TRAIN_ROWS = 512, 64
#: Counts of words that a task holds before it adds up those of equal words and sends them.
HELD_COUNTS = 1_000_000
RARE = (1 << 20) - 1
END = b""


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts laid end to end, as ``words_of`` gives them, and the number of each text's words."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, size = pieces.flatten(), pc.list_value_length(pieces).to_numpy()
    kept = pc.binary_length(words).to_numpy() > 0
    if not kept.all():  # white space at a text's ends leaves empty pieces there
        before = np.append(0, np.cumsum(kept))
        last = np.cumsum(size)
        words, size = words.filter(pa.array(kept)), before[last] - before[last - size]
    return words.cast(pa.binary()), size.astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): tokens of all rows, combined per task and then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
                held.clear()
                yield from sums.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches(max_chunksize=50_000)

        for batch in common.slices(batches, SPLIT_ROWS):
            words, size = split(batch.column(0))
            found = words.value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([len(size)], pa.int64())}))
            rows += len(found) + 1
            if rows > HELD_COUNTS:
                yield from out()
                rows = 0
        yield from out()

    return docs.select("text").mapInArrow(common.lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_place(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % SUFFIXES


def unlisted(words: Sequence[bytes]) -> np.ndarray:
    """For each word one number: its hash, its place if it has none of its own, and the rank of a rare word."""
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    endings = np.fromiter(map(zlib.crc32, (w[-2:] for w in words)), np.int64, len(words))
    return hashes << 28 | (endings % SUFFIXES + 1 + OWN) << 20 | RARE


def suffix_column(word: Column) -> Column:
    """``suffix_place`` as an expression."""
    return F.crc32(F.when(F.octet_length(word) >= 2, F.substring(word, -2, 2)).otherwise(word)) % SUFFIXES + 1 + OWN


class Packed(dict):
    """Maps a word to one number: its hash, place and rank among the frequent words. Holds the listed words only."""

    def __init__(self, rank: dict[bytes, int], own: dict[bytes, int]) -> None:
        ranks = np.fromiter(rank.values(), np.int64, len(rank))
        super().__init__(zip(rank, (unlisted(list(rank)) - RARE + ranks).tolist(), strict=True))
        for w, place in own.items():
            self[w] = zlib.crc32(w) << 28 | place << 20 | rank.get(w, RARE)

    def __missing__(self, word: bytes) -> int:
        return int(unlisted([word])[0])

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.fromiter(map(self.get, words, itertools.repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero(out < 0)
        out[rest] = unlisted(words[rest])
        return out


class Lexicon:
    """What a worker knows of words."""

    def __init__(self, top: list[tuple[bytes, int]], own: list[bytes]) -> None:
        self.known = Packed({w: i for i, (w, _) in enumerate(top)}, {w: 1 + i for i, w in enumerate(own)} | {END: 0})
        self.log_count = np.append(np.log10(np.array([n for _, n in top], float) + 1), 0.0)
        self.count = np.append(np.array([n for _, n in top], np.int64), 0)

    def encoded(self, words: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number per word, each document's end token appended, laid end to end; and the documents' sizes with it.

        ``words`` and ``size`` are as ``split`` gives them. Equal words are looked up once."""
        coded = words.dictionary_encode()
        known = self.known.of(coded.dictionary.to_numpy(zero_copy_only=False))
        size = size + 1
        flat = np.full(int(size.sum()), self.known[END], np.int64)
        flat[inner(size)] = known[coded.indices.to_numpy()]
        return flat, size

    def packed(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """``encoded`` of documents given as lists of words."""
        return self.encoded(pa.array(list(itertools.chain.from_iterable(docs)), pa.binary()), np.array([len(d) for d in docs], np.int64))


def inner(size: np.ndarray) -> np.ndarray:
    """Which tokens of documents of these sizes are not the end token."""
    out = np.ones(int(size.sum()), bool)
    out[np.cumsum(size) - 1] = False
    return out


class Tokens:
    """Documents laid end to end: places, ranks, the features of both softmaxes (rows of their weights) and bounds."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.size = size
        self.first = np.cumsum(self.size) - self.size
        self.place = (flat >> 20 & 255).astype(np.int64)
        self.rank = (flat & RARE).astype(np.int32)
        h = (flat >> 28).astype(np.uint64) + np.uint64(1)
        one = np.concatenate([[np.uint64(0)], h[:-1]])
        two = np.concatenate([[np.uint64(0)], one[:-1]])
        one[self.first] = 0
        two[self.first] = 0
        second = self.first[self.size > 1] + 1
        two[second] = 0
        spread = lambda x, m: (x * np.uint64(m)) >> np.uint64(32)
        self.wide = np.stack([spread(one + np.uint64(3), 0x9E3779B97F4A7C15), spread(two + np.uint64(5), 0xC2B2AE3D27D4EB4F), spread(one * np.uint64(31) + two + np.uint64(7), 0x165667B19E3779F9)])

    def level(self, depth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows of a batch's features, the bias as the last, and what is to be told: the class, or the place in it."""
        wide, cls = self.wide[:, k : k + BATCH], self.place[k : k + BATCH] // WIDTH
        if depth == 0:
            rows, bias, told = wide, np.full(len(cls), BUCKETS), cls
        else:
            rows, bias, told = (wide + cls.astype(np.uint64) * np.uint64(0x9E3779B1)) * np.uint64(0x85EBCA6B) >> np.uint64(13), BUCKETS + cls, self.place[k : k + BATCH] % WIDTH
        return np.concatenate([(rows & np.uint64(BUCKETS - 1)).astype(np.int64), bias[None]]), told


#: A table of weights for each softmax: a row a bucket, and the rows of its biases.
SHAPES = ((BUCKETS + 1, CLASSES), (BUCKETS + CLASSES, WIDTH))


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits that can be exponentiated: shifted by each token's largest if any of them is far from 0."""
    x = np.take(weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        x += np.take(weights, r, axis=0, mode="clip")
    if not (x.max() <= SAFE and x.min() >= -SAFE):
        x -= x.max(1)[:, None]
    return x


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def log_probability(weights: tuple[np.ndarray, np.ndarray], t: Tokens) -> np.ndarray:
    """Natural log of the probability of each token's place."""
    out = np.zeros(len(t.place), np.float64)
    for k in range(0, len(out), BATCH):
        for depth, table in enumerate(weights):
            rows, told = t.level(depth, k)
            x = logits(table, rows)
            hit = x[np.arange(len(told)), told]
            out[k : k + BATCH] += hit - np.log(row_sums(np.exp(x, out=x)))
    return out


def bucket_sums(p: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``p[order]`` over the segments that begin at ``first``. Segments are cut into pieces of at most ``SHORT``
    rows; pieces, longest first, are added place by place, all at once, and the sums of a segment's pieces likewise."""
    lens = np.diff(np.append(first, len(order)))
    pieces = (lens + SHORT - 1) // SHORT
    start = np.cumsum(pieces) - pieces
    cut = (np.arange(pieces.sum()) - np.repeat(start, pieces)) * SHORT
    first, lens = np.repeat(first, pieces) + cut, np.minimum(np.repeat(lens, pieces) - cut, SHORT)
    by = np.argsort((SHORT - lens).astype(np.uint8), kind="stable")
    begin, longer = first[by], len(by) - np.cumsum(np.bincount(lens, minlength=SHORT + 1))
    out = np.take(p, order[begin], axis=0, mode="clip")
    for k in range(1, SHORT):
        m = longer[k]
        if not m:
            break
        out[:m] += np.take(p, order[begin[:m] + k], axis=0, mode="clip")
    at = np.empty_like(by)
    at[by] = np.arange(len(by))
    sums = np.take(out, at[start], axis=0, mode="clip")
    if len(at) > len(start):
        more = pieces > 1
        sums[more] = bucket_sums(out, at[np.repeat(more, pieces)], np.cumsum(pieces[more]) - pieces[more])
    return sums


def descend(weights: tuple[np.ndarray, ...], scale: tuple[np.ndarray, ...], t: Tokens) -> None:
    """AdaGrad over the tokens in batches; weights and scale change in place."""
    for k in range(0, len(t.place), BATCH):
        for depth, (table, sums) in enumerate(zip(weights, scale, strict=True)):
            rows, told = t.level(depth, k)
            p = logits(table, rows)
            np.exp(p, out=p)
            p *= (1 / row_sums(p))[:, None]
            p.ravel()[np.arange(len(told)) * p.shape[1] + told] -= 1
            flat = rows[:-1].astype(np.uint16).ravel()
            order = np.argsort(flat, kind="stable")  # a radix sort, as rows take two bytes
            flat = flat[order]
            first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
            biases = np.arange(BUCKETS, len(table))
            at = np.concatenate([flat[first].astype(np.int64), biases])
            g = np.concatenate([bucket_sums(p, order % len(told), first), (rows[-1] == biases[:, None]).astype(p.dtype) @ p])
            total = np.take(sums, at, axis=0, mode="clip")
            total += g * g
            sums[at] = total
            total += 1
            np.sqrt(total, out=total)
            g *= RATE
            g /= total
            np.subtract(np.take(table, at, axis=0, mode="clip"), g, out=g)
            table[at] = g


def frequent_words(vocabulary: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """At most ``top`` words, the most frequent: counts fall into logarithmic steps, and whole steps are taken while they fit.
    The end token comes besides if it is not among them: every document has one, so it must not be joined by key.
    Neither the steps nor the words that reach the driver grow with the corpus."""
    step = F.floor(F.log2("n") * 64)
    cut, held = None, 0
    for r in vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        if held + r["words"] > top:
            break
        cut, held = r["step"], held + r["words"]
    taken = F.octet_length("word") == 0
    if cut is not None:
        taken |= step >= cut
    return sorted(((bytes(r[0]), r[1]) for r in vocabulary.where(taken).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def round_of(docs: DataFrame, weights: tuple[np.ndarray, ...], lexicon: tuple) -> tuple[np.ndarray, ...]:
    """One round: every task trains from the weights; gives the weights moved by the mean change.

    A task sends only rows that it has changed, in blocks of rows; a block's changes are added up by one task each and weighed by
    the tokens that the tasks have seen, and the driver receives the tables once."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((weights, lexicon))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = held.value
        lexicon, own, scale, seen = Lexicon(*words), tuple(w.copy() for w in start), tuple(np.zeros_like(w) for w in start), 0
        for batch in common.slices(batches, SPLIT_ROWS):
            flat, size = lexicon.encoded(*split(batch.column(0)))
            bounds = np.append(0, np.cumsum(size))
            for k in range(0, len(size), TRAIN_ROWS):
                some = size[k : k + TRAIN_ROWS]
                descend(own, scale, Tokens(flat[bounds[k] : bounds[k + len(some)]], some))
            seen += len(flat)
        if not seen:
            return
        out: list[list] = [[], [], [], [], []]
        for depth, (a, b, touched) in enumerate(zip(own, start, scale, strict=True)):
            rows = np.flatnonzero(touched.any(1)).astype(np.int32)
            change = (a[rows] - b[rows]).astype(np.float16)
            for block in range(BLOCKS):
                low, high = np.searchsorted(rows, [len(a) * block // BLOCKS, len(a) * (block + 1) // BLOCKS])
                for column, x in zip(out, (depth, block, seen, rows[low:high].tobytes(), change[low:high].tobytes()), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["depth", "block", "seen", "rows", "change"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for depth, block, seen, rows, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                height, width = SHAPES[depth]
                low = height * block // BLOCKS
                s = sums.setdefault((depth, block), [0, np.zeros((height * (block + 1) // BLOCKS - low, width))])
                s[0] += seen
                s[1][np.frombuffer(rows, np.int32) - low] += np.frombuffer(change, np.float16).reshape(-1, width).astype(np.float64) * seen
        moved = [(d, b, (x / n).astype(np.float32).tobytes()) for (d, b), (n, x) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["depth", "block", "change"])

    changes = docs.select("text").mapInArrow(common.lean(train), "depth int, block int, seen long, rows binary, change binary")
    moved = tuple(w.copy() for w in weights)
    for r in changes.repartition(2 * BLOCKS, "depth", "block").mapInArrow(total, "depth int, block int, change binary").collect():  # the fixed tables, once
        part = np.frombuffer(r["change"], np.float32).reshape(-1, SHAPES[r["depth"]][1])
        low = SHAPES[r["depth"]][0] * r["block"] // BLOCKS
        moved[r["depth"]][low : low + len(part)] += part
    return moved


def score(docs: DataFrame, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", FOLDS) == HELD).alias("held_out"), common.text_of().alias("text"))
    train = rows.filter(~F.col("held_out"))
    vocabulary = common.materialise(counted(train), "vocabulary")
    total, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_words(vocabulary, top)
    own = [bytes(r[0]) for r in vocabulary.where(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(OWN).select("word").collect()]
    # What the words of a shared place come to, the spare count included; a place of one word or of the end token is certain.
    mass = np.ones(CLASSES * WIDTH)
    for c, n in vocabulary.where(F.octet_length("word") > 0).groupBy(suffix_column(F.col("word")).alias("c")).agg(F.sum(F.col("n") + 1)).collect():  # one row a place
        mass[c] += n
    counts = {bytes(w): n for w, n in vocabulary.where(F.col("word").isin([bytearray(w) for w in own]) | (F.octet_length("word") == 0)).select("word", "n").collect()}
    mass[0] = counts.get(END, 0) + 1
    for i, w in enumerate(own):
        mass[1 + i] = counts[w] + 1
        mass[suffix_place(w)] -= counts[w] + 1
    lexicon = (frequent, own)
    weights = tuple(np.zeros(shape, np.float32) for shape in SHAPES)
    # Biases begin at the frequencies, so the features have only to learn what the context adds.
    by_class = mass.reshape(CLASSES, WIDTH)
    weights[0][BUCKETS], weights[1][BUCKETS:] = np.log(by_class.sum(1) / mass.sum()), np.log(by_class / by_class.sum(1)[:, None])
    if total:
        for r in range(rounds):
            weights = round_of(train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r), weights, lexicon)
    held = spark.sparkContext.broadcast((weights, lexicon, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words, log_mass = held.value
        lexicon = Lexicon(*words)
        for b in common.slices(batches, SPLIT_ROWS):
            split_words, n = split(b.column(2))
            t = Tokens(*lexicon.encoded(split_words, n))
            model = log_probability(weights, t) / np.log(10) - log_mass[t.place]
            rank = np.minimum(t.rank, len(lexicon.count) - 1)
            counts, sums = lexicon.count[rank] > 0, lexicon.log_count[rank]
            add = lambda x, t=t: np.add.reduceat(x, t.first)
            word = inner(t.size)
            far = (t.rank == RARE) & word  # the end token is frequent wherever it was counted
            bounds = np.append(0, np.cumsum(add(far.astype(np.int64)))).astype(np.int32)
            names = ["doc_id", "held_out", "n_tokens", "known", "counts", "model", "rare"]
            listed = pa.ListArray.from_arrays(pa.array(bounds), split_words.filter(pa.array(far[word])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.size.astype(np.int64)), pa.array(add(counts.astype(np.int64))), pa.array(add(sums)), pa.array(add(model)), listed], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, known long, counts double, model double, rare array<binary>"
    parts = common.materialise(rows.mapInArrow(common.lean(run), schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = parts.select("row", F.explode("rare").alias("word")).join(vocabulary, "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_counts"))
    out = parts.drop("rare").join(rare, "row", "left")
    counts = F.col("counts") + F.coalesce("more_counts", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (counts - F.col("n_tokens") * F.log10(F.lit(float(total + types + 1)))).alias("base_score"), (counts + F.col("model")).alias("score"),
    )
