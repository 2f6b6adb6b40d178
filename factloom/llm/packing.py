"""Sequence packing by concatenate and cut, with two passes of prefix sums.

Pass one tokenises every document once and writes its ids together with the number of tokens before it in its partition.
The driver receives one total per partition, never per document, and turns the totals into global offsets. Pass two cuts
the global token stream into windows of ``length`` tokens; a document that crosses a boundary leaves one record per piece.
Only the very last sequence can need padding.

Scale: both passes are partition-local; nothing is shuffled. Ids are stored once in two bytes each while the vocabulary
allows it. Words repeat, so a task looks up the distinct words of some 8 MB of text at once, as Arrow arrays, and a bounded
cache maps pieces of words to their ids; ids are those of the tokenizer library itself, since no token crosses white space
and its normalisation works inside words.

Recovery: pass two reads pass one's written table, so a lost executor repeats reads only.

Defined cases: null text is empty, and an empty document holds just the closing id; repeated rows are packed as often as
they occur; an empty table gives no pieces; extra columns are ignored; order between documents is that of the partitions.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The id that closes every document.
END = 1
LENGTH = 2048
#: Pieces of words whose ids a worker remembers; beyond, those of the last texts alone are kept. Bounds its memory.
CACHED_WORDS = 800_000
#: Longer pieces are not remembered.
CACHED_BYTES = 64
#: New words that are coded in one call, and new pieces.
TOGETHER = 128
PIECES_TOGETHER = 512
#: Bytes of text whose words are looked up together.
STEP_BYTES = 1 << 23

# The rules of tokenizers whose plain words are cut here. A plain word has printable characters below U+0180 but for U+0130; there NFC
# changes nothing and lower-casing goes letter by letter. It holds nothing that may begin a special token.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_SPECIAL = "<|"
_PLAIN = "^[!-~¡-įı-ſ]+$"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+"


def _ragged(codes: pa.LargeBinaryArray, groups: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbouring codes run together; ``groups`` are the bounds of those that make one."""
    bounds = np.frombuffer(codes.buffers()[1], np.int64)[groups]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(groups) - 1, [None, pa.py_buffer(bounds), codes.buffers()[2] or pa.py_buffer(b"")])


class WordIds:
    """Maps the white-space words of texts to the bytes of their ids, by the tokenizer library.

    Distinct words are looked up, not all. Where the tokenizer has the rules above, plain words are lower-cased and cut to pieces, and
    only new pieces go through the library's model: as many words differ by case and punctuation alone, these are fewer, and the
    library's slower rules are spared for them. Any other word is a piece of its own and goes through the whole library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        self.pieces = pa.array([""], pa.large_string())
        self.codes = pa.array([b""], pa.large_binary())
        told, vocab = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab(True)
        model, suffix = told["model"], told["model"].get("end_of_word_suffix")
        self.model = None
        if (
            {k: told[k] for k in _RULES} == _RULES and all(x["content"].startswith(_SPECIAL) for x in told["added_tokens"]) and not told["truncation"] and not told["padding"]
            and model["type"] == "BPE" and not model["dropout"] and suffix and all(c in vocab and c + suffix in vocab for c in pre_tokenizers.ByteLevel.alphabet())
        ):
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = None
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    @property
    def known(self) -> list[bytes]:
        """The pieces that are remembered."""
        return self.pieces.cast(pa.large_binary()).to_pylist()

    def plain(self, words: pa.Array) -> pa.Array:
        return pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, _SPECIAL)))

    def by_library(self, words: list[str]) -> Iterator[bytes]:
        """Code words, many in one text; a token's offset tells its word, as tokens never cross white space."""
        for k in range(0, len(words), TOGETHER):
            texts = words[k : k + TOGETHER]
            ends = np.cumsum([len(x) + 1 for x in texts])
            coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.searchsorted(ends, [x for x, _ in coded.offsets], "right")
            raw, size = np.array(coded.ids, self.kind).tobytes(), self.kind.itemsize
            cuts = np.searchsorted(at, np.arange(len(texts) + 1)) * size
            for a, b in itertools.pairwise(cuts):
                yield raw[a:b]

    def by_model(self, pieces: list[str]) -> Iterator[bytes]:
        """Code pieces of plain words, many in one text; the last token of a piece says that it is."""
        for k in range(0, len(pieces), PIECES_TOGETHER):
            some = pieces[k : k + PIECES_TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
            for _, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
                yield raw[a:b]

    def learn(self, pieces: pa.Array) -> pa.Array:
        """The codes of new pieces."""
        if not self.model:
            return pa.array(self.by_library(pieces.to_pylist()), pa.large_binary())
        plain = self.plain(pieces)
        other = pc.invert(plain)
        codes = [*self.by_model(pieces.filter(plain).to_pylist()), *self.by_library(pieces.filter(other).to_pylist())]
        order = np.concatenate([pc.indices_nonzero(plain).to_numpy(), pc.indices_nonzero(other).to_numpy()]).astype(np.int64)
        return pa.array(codes, pa.large_binary()).take(pa.array(np.argsort(order)))

    def coded(self, words: pa.Array) -> pa.Array:
        """The codes of distinct words."""
        cut = words
        if self.model:
            cut = pc.if_else(self.plain(words), pc.replace_substring_regex(pc.utf8_lower(words), _PIECE, r"\0 "), words)
        lists = pc.split_pattern(cut, " ")
        parts = lists.flatten().dictionary_encode()
        at = pc.index_in(parts.dictionary, value_set=self.pieces)
        new = parts.dictionary.filter(pc.is_null(at))
        pieces, codes = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.codes, self.learn(new)])
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.pieces) + np.arange(len(new))
        out = _ragged(codes.take(pa.array(at)).take(parts.indices), np.concatenate([[0], lists.value_lengths().to_numpy().cumsum()]))
        if len(pieces) > CACHED_WORDS:
            at = pa.array(np.union1d([0], at[:CACHED_WORDS]))
            pieces, codes = pieces.take(at), codes.take(at)
        short = pc.less_equal(pc.binary_length(pieces), CACHED_BYTES)  # a text without white space is one word
        self.pieces, self.codes = pieces.filter(short), codes.filter(short)
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the closing one. Words are looked up once for all texts given."""
        if not len(texts):
            return
        lists = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        coded = _ragged(self.coded(words.dictionary).take(words.indices), np.concatenate([[0], lists.value_lengths().to_numpy().cumsum()]))
        for raw in coded:
            yield raw.as_py() + self.end


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary: later tasks of the process find its words."""
    return WordIds(path)


def tokeniser(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, part = word_ids(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            heavy = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // STEP_BYTES
            cuts = [*np.flatnonzero(np.diff(heavy, prepend=-1)).tolist(), batch.num_rows]
            for first, stop in itertools.pairwise(cuts):
                pa.default_memory_pool().release_unused()  # what one step takes is much more than what stays
                piece = batch.slice(first, stop - first)
                coded = list(ids.encode(piece.column(1)))
                sizes = np.array([len(x) // ids.kind.itemsize for x in coded], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(coded), part, np.int32)), pa.array(starts), pa.array(sizes), pa.array(coded, pa.binary())], names=["doc_id", "part", "before", "doc_tokens", "ids"])

    return run


def cutter(base: np.ndarray, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """base: the global offset of each partition of pass one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, part, before, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                first, start = int(base[part]) + before, 0
                while start < n:
                    at = first + start
                    size = min(length - at % length, n - start)
                    row = (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, at // length, at % length)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pass one, written: doc_id, part, before (tokens before it in its partition), doc_tokens, ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return common.materialise(rows.mapInArrow(common.lean(tokeniser(tokenizer_path)), "doc_id long, part int, before long, doc_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: where the ids of a document lie in the packed sequences."""
    coded = tokens(docs, tokenizer_path)
    totals = {r["part"]: r["n"] for r in coded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    sizes = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        sizes[part + 1] = n
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return coded.mapInArrow(common.lean(cutter(np.cumsum(sizes), length)), schema)
