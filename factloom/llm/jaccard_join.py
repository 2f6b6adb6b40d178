"""Exact n-gram Jaccard self-join in metric space, and its connected components.

Jaccard distance is a metric, but nearly all pairs of a corpus stand at distance 1, where whole documents as pivots prune
nothing. So the first level works in sub-spaces. For sets of sizes s and up to s/t, a similarity of t bounds the symmetric
difference by k; shingles are dealt by hash into more than k parts, so two linked sets agree in at least one part, and one
that holds shingles. Every distinct content of a part is a pivot, a document falls into the Voronoi region of the pivot at
distance zero, and the window that the triangle inequality asks for is zero wide. Sizes are cut into classes, and a set is
replicated to the scheme of its own class and of the one below: that is the window for sizes. Shingles that many documents share
would fill parts alone and draw strangers together, so sets with enough other shingles are placed by those only (see ``keys``).

Regions that share documents form one area, and a small area is one group. A large area is taken apart again: all regions with
the same smallest node form a group around it, which holds every pair of each of its regions. Inside a group distances are
informative: documents as pivots create Voronoi regions, a document is replicated to every region within twice the radius of its
own pivot (the triangle inequality), and regions split again until they are small; small ones are compared as sparse matrices. A
pair that several groups hold counts in the one with the smallest pivot. All links are exact; none is missed.

Scale: equal sets are one node from the start. One pass over the texts gives the rows of the documents and of the regions; regions only
ever leave (node, smallest node) rows. Sets are made once more and shipped for nodes of areas only: the second scan hashes each
text and asks a bit table of fixed size, whose errors cost traffic and change no result. Groups above
``GROUP_DOCS`` documents are cut into blocks that meet pairwise, each pair a task of its own, so no task holds an unbounded group;
links leave a task as a spanning forest with counts per node.

Defined cases: a set has the distinct shingles of a text, the whole word sequence where it has fewer words than a shingle,
and is empty without words; empty sets link with nothing, not even each other; null text is empty; rows that repeat or
share a text are one node and report the same component; of null ids the smallest other id is taken; extra columns are
ignored. Nodes are half of the set's 128-bit digest, and the other half is compared (see ``survey``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .components import connected
from .shingles import WordHash, hashes, mixed, shingles, words_of

#: Up to so many documents an area is one group.
AREA_DOCS = 256
#: A group with more documents, or more shingles in all, is cut into blocks.
GROUP_DOCS, GROUP_SHINGLES = 1024, 1_500_000
#: Bits of the filter that says whether a text may be needed.
FILTER_BITS = 1 << 23
#: Documents that are compared as one matrix.
LEAF = 384
#: Documents of the sample that shows which shingles are hot, and how many of them must hold one.
HOT_SAMPLE, HOT_DOCS = 8192, 4
#: Sets that a task remembers to skip repeats; forgetting costs repeated rows only.
REMEMBERED = 200_000
#: Region rows that leave a task together.
ROWS_A_TIME = 50_000


class Similarity:
    """Jaccard of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def linked(self, common_size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common_size >= self.num * (a + b - common_size)

    def largest(self, size: int) -> int:
        """The largest set that can link with one of this size."""
        return size * self.den // self.num

    def difference(self, size: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has this size."""
        top = size + self.largest(size)
        # The last few totals hold the maximum, as it rises by less than one over them but for rounding.
        return max(t - 2 * -(-self.num * t // (self.num + self.den)) for t in range(max(2 * size, top - 8), top + 1))

    def scheme(self, low: int, top: int) -> tuple[int, int]:
        """For pairs whose smaller set has ``low`` to ``top`` shingles: how many parts can differ, and parts in all (none where
        only equal sets link). The parts beyond the need are as many as chance leaves empty even in a rather uneven set."""
        k = max(self.difference(s) for s in range(max(1, top - 20), top + 1))
        if not k:
            return 0, 0
        empty = (k + 1) * math.exp(-low / (k + 1))
        return k, k + 1 + math.ceil(empty + 4 * math.sqrt(empty) + 1)


class Classes:
    """Size classes: sets that link lie in the same class or in neighbouring ones."""

    def __init__(self, similarity: Similarity) -> None:
        self.similarity, self.starts, self.schemes = similarity, [1, 2], {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, self.similarity.largest(self.starts[-1] - 1) + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def scheme(self, i: int) -> tuple[int, int]:
        if i not in self.schemes:
            while len(self.starts) <= i + 1:
                self.of(self.starts[-1])
            self.schemes[i] = self.similarity.scheme(self.starts[i], self.starts[i + 1] - 1)
        return self.schemes[i]


def set_of(text: str | None, n: int, known: WordHash) -> np.ndarray:
    return np.unique(shingles(hashes(words_of(text), known), n))


def node_of(s: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The low 63 bits of the set's digest; the high ones where different sets share the low ones."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    low = digest & ((1 << 63) - 1)
    return digest >> 65 if low in shared else low


def without(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set less its widely shared shingles; both are sorted."""
    if not len(hot):
        return s
    return s[hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] != s]


def part_keys(s: np.ndarray, scheme: int, m: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of every part that holds shingles, and the parts that hold none."""
    seed = np.uint64(((2 * scheme + tag + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    mix = mixed(s + np.uint64(((scheme + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
    part = (mix >> np.uint64(20)) % np.uint64(m)
    order = np.argsort(part)
    part = part[order]
    first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1]) if len(s) else np.zeros(0, np.int64)
    sums, held = (np.add.reduceat(mixed(mix[order]), first), part[first]) if len(s) else (mix, part)
    none = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
    name = lambda sums, held: mixed(mixed(sums + held * np.uint64(0xC2B2AE3D27D4EB4F)) + seed)
    return name(sums, held), name(np.zeros(len(none), np.uint64), none)


def keys(s: np.ndarray, classes: Classes, hot: np.ndarray) -> np.ndarray:
    """The regions of a set, in the schemes of its size class and the one below.

    Parts are first made of the shingles that are not hot. A linked partner differs in at most ``k`` of them, so a set with
    more than ``k`` filled ones meets each partner in one. A set with fewer also takes part with all its shingles, and with
    its empty parts if even those fill too few; two such sets meet there. Which shingles count as hot is free, as long as
    all sets agree.
    """
    own, out = classes.of(len(s)), []
    cold = without(s, hot)
    for scheme in (own, own - 1):
        k, m = classes.scheme(scheme) if scheme >= 0 else (0, 0)
        if not m:
            continue
        filled, _ = part_keys(cold, scheme, m, 0)
        out.append(filled)
        if len(filled) <= k:
            whole, none = part_keys(s, scheme, m, 1)
            out += [whole] if len(whole) > k else [whole, none]
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def hot_shingles(docs: DataFrame, n: int, rows: int) -> np.ndarray:
    """Shingles of at least ``HOT_DOCS`` among about ``HOT_SAMPLE`` documents: a hint that spares traffic and changes no
    result. At most the sample's shingles over ``HOT_DOCS`` reach the driver, a number that does not grow with the corpus."""
    share = min(1.0, HOT_SAMPLE / max(rows, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for t in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(set_of(t.as_py(), n, known).view(np.int64))], names=["shingle"])

    few = _texts(docs).where((F.xxhash64("text", "doc_id").bitwiseAND((1 << 30) - 1)) < int(share * (1 << 30)))
    found = few.mapInArrow(common.lean(run), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_DOCS)
    return np.sort(np.array([r[0] for r in found.select("shingle").collect()], np.int64).view(np.uint64))


def key_of(text: bytes) -> int:
    """A text's own hash: by it later passes tell which texts they need, before they make any set."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


SURVEY = "region long, node long, doc_id long, n_shingles long, rest long, text long"


def survey(docs: DataFrame, n: int, similarity: Similarity | None = None, hot: np.ndarray | None = None, shared: frozenset[int] = frozenset()) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """By one pass over the texts, two written tables: a row a document (doc_id, n_shingles, node, null for the empty set, text: its
    text's hash), and (a, b) where b is the smallest node of a region that holds a; and the halves of digests that sets share.

    Document rows travel with those of the regions, each under a key of its own, so texts are split and hashed once. A node is half a digest, and every node's
    other half is compared: where halves meet, which some ten in 10^10 sets do, those sets are named by their other half
    instead and the pass is made again. Only such halves reach the driver."""
    held = docs.sparkSession.sparkContext.broadcast(hot if hot is not None else np.zeros(0, np.uint64))
    names = [x.split(" ")[0] for x in SURVEY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, seen = WordHash(), Classes(similarity) if similarity else None, set()
        at = TaskContext.get().partitionId() << 33
        for ids, texts in (batch.columns for batch in common.slices(batches)):
            found = [set_of(t.as_py(), n, known) for t in texts]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in found]
            nodes = [node_of(s, shared) if len(s) else None for s in found]
            count = len(found)
            own = mixed(np.arange(at, at + count, dtype=np.uint64))
            at += count
            none = pa.nulls(count, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(nodes, pa.int64()), ids, pa.array([len(s) for s in found], pa.int64()), pa.array([d >> 65 if d is not None else None for d in digests], pa.int64()), pa.array([key_of(t) for t in raw(texts)], pa.int64())], names=names)
            if not similarity:
                continue
            where, who = [], []
            for s, node in zip(found, nodes, strict=True):
                if node is None or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                k = keys(s, classes, held.value)
                where.append(k)
                who.append(np.full(len(k), node, np.int64))
            if where:
                where, who = np.concatenate(where), np.concatenate(who)
                for k in range(0, len(where), ROWS_A_TIME):
                    part = where[k : k + ROWS_A_TIME]
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(who[k : k + ROWS_A_TIME]), none, none, none, none], names=names)

    rows = _texts(docs).mapInArrow(common.lean(run), SURVEY)
    if similarity:
        least = F.min("node").over(Window.partitionBy("region"))
        rows = rows.withColumn("b", least).filter(F.col("text").isNotNull() | (F.col("node") != F.col("b"))).drop("region")
    else:
        rows = rows.withColumn("b", F.col("node")).drop("region")
    rows = common.materialise(rows, "survey")
    of_docs = rows.filter("text is not null")
    met = of_docs.filter("node is not null").groupBy("node").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).filter("a != b")
    clash = frozenset(r["node"] for r in met.select("node").collect())
    if clash and shared:
        raise ValueError("sets share both halves of their digests")
    if clash:
        return survey(docs, n, similarity, hot, clash)
    edges = rows.filter("text is null").select(F.col("node").alias("a"), "b").distinct()
    return of_docs.select("doc_id", "n_shingles", "node", "text"), edges, shared


def sets(docs: DataFrame, n: int, shared: frozenset[int] = frozenset()) -> tuple[DataFrame, frozenset[int]]:
    """The document rows of ``survey`` alone, and the halves of digests that sets share."""
    rows, _, shared = survey(docs, n, shared=shared)
    return rows.drop("text"), shared


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two short lists of sets, as one product of sparse columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([*left, *right])
    if not len(flat):
        return out.astype(np.int64)
    of = np.repeat(np.arange(len(left) + len(right), dtype=np.int32), [len(s) for s in (*left, *right)])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    del flat, order
    column = np.cumsum(new, dtype=np.int32) - 1
    many = np.bincount(column)[column] > 1  # a shingle of one set meets nothing
    column, of = column[many], of[many]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for a in range(0, int(column[-1]) + 1, 4096):
            low, high = np.searchsorted(column, [a, a + 4096])
            block = np.zeros((len(left) + len(right), 4096), np.float32)
            block[of[low:high], column[low:high] - a] = 1
            out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def centre_gaps(all_sets: list[np.ndarray]) -> np.ndarray:
    """Distances to the set of the shingles that more than half of the sets hold; any set will do as a pivot, and this one is near
    to all members of a close group."""
    held, n = np.unique(np.concatenate(all_sets), return_counts=True)
    centre = held[n * 2 > len(all_sets)]
    if not len(centre):
        return np.ones(len(all_sets))
    both = np.array([np.count_nonzero(centre[np.minimum(np.searchsorted(centre, s), len(centre) - 1)] == s) for s in all_sets])
    return 1 - both / (np.array([len(s) for s in all_sets]) + len(centre) - both)


class Forest:
    """Links found so far: a union-find over positions, and each position's linked copies. ``before`` holds the smaller pivots
    of each position: a pair that shares one is counted in that one's group. ``gap`` is each position's distance to a common
    pivot; a pair whose gaps add up to the radius at most is linked by the triangle inequality, without being compared."""

    def __init__(self, copies: np.ndarray, before: list[np.ndarray] | None = None, gap: np.ndarray | None = None) -> None:
        self.up, self.copies, self.links = list(range(len(copies))), copies, np.zeros(len(copies), np.int64)
        self.before = before or [np.zeros(0, np.uint64)] * len(copies)
        self.gap = np.ones(len(copies)) if gap is None else gap

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def add(self, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
        """Links between the positions ``x`` and ``y`` by a matrix. Rows are joined as wholes: one that tells nothing new costs one look."""
        at = np.unique(np.concatenate([x, y]))
        rows, columns = np.searchsorted(at, x), np.searchsorted(at, y)
        label = np.array([self.root(k) for k in at.tolist()])
        for i in np.flatnonzero(hit.any(1)).tolist():
            met = np.append(label[columns[hit[i]]], label[rows[i]])
            if (met != met[0]).any():
                label[np.isin(label, met)] = met.min()
        for k, to in zip(at.tolist(), label.tolist(), strict=True):
            a, b = self.root(k), self.root(to)
            self.up[max(a, b)] = min(a, b)


def compare(all_sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, similarity: Similarity, forest: Forest) -> None:
    """Compare left with right, or left with itself, matrix by matrix; only sets with a pair that the gaps leave open are multiplied."""
    size = np.array([len(s) for s in all_sets])
    left = left[np.argsort(forest.gap[left], kind="stable")]  # near ones first, so that whole matrices need no comparison
    other = left if right is None else right[np.argsort(forest.gap[right], kind="stable")]
    radius = 1 - similarity.num / similarity.den - 1e-9
    for i in range(0, len(left), LEAF):
        x = left[i : i + LEAF]
        for j in range(i if right is None else 0, len(other), LEAF):
            y = other[j : j + LEAF]
            hit = forest.gap[x][:, None] + forest.gap[y][None, :] <= radius
            rows, columns = np.flatnonzero(~hit.all(1)), np.flatnonzero(~hit.all(0))
            if len(rows):
                both = intersections([all_sets[k] for k in x[rows]], [all_sets[k] for k in y[columns]])
                hit[np.ix_(rows, columns)] = similarity.linked(both, size[x[rows]][:, None], size[y[columns]][None, :])
            if right is None and i == j:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            counts = hit & (intersections([forest.before[k] for k in x], [forest.before[k] for k in y]) == 0)
            np.add.at(forest.links, x, counts @ forest.copies[y])
            np.add.at(forest.links, y, counts.T @ forest.copies[x])
            forest.add(x, y, hit)


def join_area(all_sets: list[np.ndarray], members: np.ndarray, similarity: Similarity, forest: Forest) -> None:
    """All links among the members: Voronoi regions of pivots, windows by the triangle inequality, regions again until small."""
    if len(members) <= LEAF:
        compare(all_sets, members, None, similarity, forest)
        return
    size = np.array([len(all_sets[k]) for k in members], float)
    pivots = members[np.linspace(0, len(members) - 1, 8).astype(int)]
    both = intersections([all_sets[k] for k in members], [all_sets[k] for k in pivots])
    distance = 1 - both / (size[:, None] + np.array([len(all_sets[k]) for k in pivots])[None, :] - both)
    radius = 1 - similarity.num / similarity.den
    home = distance.argmin(1)
    near = distance <= distance.min(1)[:, None] + 2 * radius + 1e-9
    largest = max(near[:, r].sum() for r in range(len(pivots)))
    if largest > 0.8 * len(members):
        compare(all_sets, members, None, similarity, forest)  # too close together for pivots to tell apart
        return
    for r in range(len(pivots)):
        own, guests = home == r, near[:, r] & (home > r)
        if own.any():
            join_area(all_sets, members[own], similarity, forest)
            if guests.any():
                compare(all_sets, members[own], members[guests], similarity, forest)


def places(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Written: (node, group, before, copies, blocks): the groups of a node, the smaller pivots it has, and how a group is cut."""
    areas = connected(edges)
    sizes = areas.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    areas = common.materialise(areas.join(sizes, "label"), "areas")
    small = areas.where(F.col("docs") <= AREA_DOCS).select("node", F.col("label").alias("group"))
    large = edges.join(areas.where(F.col("docs") > AREA_DOCS).select(F.col("node").alias("a")), "a")
    large = large.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(large.select(F.col("b").alias("node"), F.col("b").alias("group"))).distinct()
    pivots = large.groupBy("node").agg(F.collect_list("group").alias("pivots"))  # at most one per region of the node
    large = pivots.select("node", "pivots", F.explode("pivots").alias("group"))
    large = large.select("node", "group", F.filter("pivots", lambda p: p < F.col("group")).alias("before"))
    placed = small.withColumn("before", F.array().cast("array<long>")).unionByName(large)
    heads = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    placed = common.materialise(placed.join(heads, "node"), "placed")
    totals = placed.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.ceil(F.col("total") / GROUP_SHINGLES)).cast("int")
    return common.materialise(placed.drop("n").join(totals.select("group", blocks.alias("blocks")), "group"), "places")


def node_filter(placed: DataFrame) -> np.ndarray:
    """The numbers in the column ``node`` as a bit table of fixed size; set word by word, so the driver receives at most that table."""
    bit = F.col("node").bitwiseAND(FILTER_BITS - 1)
    words = placed.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((node & {FILTER_BITS - 1}) & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def listed(table: np.ndarray, node: int) -> bool:
    return bool(int(table[(node & FILTER_BITS - 1) >> 6]) >> (node & 63) & 1)


def group_links(docs: DataFrame, rows: DataFrame, placed: DataFrame, n: int, similarity: Similarity, shared: frozenset[int] = frozenset()) -> DataFrame:
    """Written: (a, b, links): a forest edge from a to b (b null: none), and copies linked to a through other sets. Sets are made of
    those texts only whose hash stands in ``rows`` beside a placed node."""
    wanted = rows.join(placed.select("node").distinct(), "node", "left_semi").select(F.col("text").alias("node"))
    held = docs.sparkSession.sparkContext.broadcast(node_filter(wanted))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, table = WordHash(), set(), held.value
        for texts in (batch.column(1) for batch in common.slices(batches)):
            nodes, content = [], []
            for t in texts:
                text = t.cast(pa.binary()).as_py()
                at = key_of(text)
                if at in seen or not listed(table, at):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(at)
                s = set_of(text.decode(), n, known)
                if len(s):
                    nodes.append(node_of(s, shared))
                    content.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(content, pa.binary())], names=["node", "content"])

    content = _texts(docs).mapInArrow(common.lean(fetch), "node long, content binary").dropDuplicates(["node"]).join(placed, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = content.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "copies", "before", "content")

    def join(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        column = lambda name: table.column(name).combine_chunks().take(pa.array(at))
        content = column("content")
        all_sets = [np.frombuffer(content[k].as_buffer(), np.uint64) for k in range(len(at))]
        block = column("own").to_numpy()
        forest = Forest(column("copies").to_numpy().astype(np.int64), [np.array(x, np.uint64) for x in column("before").to_pylist()], centre_gaps(all_sets))
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        if x == y:
            join_area(all_sets, np.arange(len(nodes)), similarity, forest)
        else:
            compare(all_sets, np.flatnonzero(block == x), np.flatnonzero(block == y), similarity, forest)
        roots = [forest.root(k) for k in range(len(nodes))]
        told = [k for k in range(len(nodes)) if forest.links[k] or roots[k] != k]
        to = [int(nodes[roots[k]]) if roots[k] != k else None for k in told]
        return pa.table([pa.array(nodes[told]), pa.array(to, pa.int64()), pa.array(forest.links[told])], names=["a", "b", "links"])

    return common.materialise(spread.groupBy("group", "x", "y").applyInArrow(join, "a long, b long, links long"), "links")


def components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, node, component_id (smallest id reachable by links), n_links (linked documents), one row per row."""
    return labelled(docs, n, num, den)[0].drop("label", "text")


def labelled(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, frozenset[int]]:
    """The same with text, the hash of the text, and label: the smallest node of the component, which tells components apart where ids
    are null or repeat; and what ``survey`` tells of shared halves."""
    similarity = Similarity(num, den)
    rows, edges, shared = survey(docs, n, similarity, hot_shingles(docs, n, docs.count()))
    placed = places(rows, common.materialise(edges, "regions"))
    links = group_links(docs, rows, placed, n, similarity, shared)
    labels = connected(links.filter("b is not null").select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    heads = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = heads.join(labels, "node", "left").join(counts.withColumnRenamed("a", "node"), "node", "left")
    heads = heads.withColumn("label", F.coalesce("label", "node"))
    firsts = heads.groupBy("label").agg(F.min("head").alias("component_id"))
    heads = heads.join(firsts, "label").select("node", "label", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    heads = common.materialise(heads, "classes")
    out = rows.join(heads, "node", "left")
    return out.select("doc_id", "n_shingles", "node", "text", "label", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), shared


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component: the one with the smallest id, and of several texts with that id (or with null ids only)
    the one of the smallest node; documents with an empty set all stay. Columns unchanged.

    Only documents that may have a partner, by a bit table of fixed size, move to be judged; the others pass where they are.
    """
    found, shared = labelled(docs, n, num, den)
    found = common.materialise(found, "components")
    keep = found.filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("node").alias("node"), F.min("component_id").alias("id"))
    mark = common.fresh(docs.columns)
    first = common.fresh([*docs.columns, mark])
    keep = keep.select(F.col("node").alias(mark), F.col("id").alias(first))
    held = docs.sparkSession.sparkContext.broadcast(node_filter(found.filter("n_links > 0").select(F.col("text").alias("node")).distinct()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHash(), held.value
        for batch in common.slices(batches):
            maybe = [t.decode() if listed(table, key_of(t)) else "" for t in raw(batch.column(at).cast(pa.string()).fill_null(""))]
            nodes = [node_of(s, shared) if len(s) else None for s in (set_of(t, n, known) for t in maybe)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, mark])

    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])
    marked = common.materialise(docs.mapInArrow(common.lean(run), schema), "marked")
    unique = marked.filter(F.col(mark).isNotNull()).join(keep, mark).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(first))).dropDuplicates([mark])
    same = [F.col(f"`{c}`") for c in docs.columns]
    return unique.select(*same).unionByName(marked.filter(F.col(mark).isNull()).select(*same))
