"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best fit: each task keeps a fixed number of open bins. A bitset holds the free
spaces for which some bin is open, so the tightest bin that a piece fits is one shift and one lowest set
bit away. Once all bins are open, the fullest closes. No shuffle: a task packs the rows of its
partition, and sequence ids are numbered within partitions; only the last bins of a task stay part
full, a fixed number whatever the input.

Documents longer than a sequence are cut into whole pieces, of which the first may be shorter. Null and
empty texts are one piece that holds the closing id. Repeated rows are packed row by row, and null keys stay
null. Of pieces of equal length the earlier row goes first. Texts of any length are encoded whole, long runs of
white space as one pre-token; memory follows the longest text. Columns besides the named ones are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CAPACITY = 1024
OPEN_BINS = 512
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space too long for a backtracking matcher; the pattern takes such a run but for its last character, or whole at the end.
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
#: Bytes of text that are tokenized at once.
BLOCK = 1 << 21

SCHEMA = "{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """A fixed number of open bins; place() gives a piece's sequence and the place in it."""

    def __init__(self, capacity: int, bins: int, first: int):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels = 0  # bit f is set while a bin with f free is open
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.levels >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.bins:
                self._take((self.levels & -self.levels).bit_length() - 1)  # the fullest closes
            free, sequence, self.next = self.capacity, self.next, self.next + 1
        if free > length:
            self._put(free - length, sequence)
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        self.open -= 1
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.levels &= ~(1 << free)
        return sequence

    def _put(self, free: int, sequence: int) -> None:
        self.open += 1
        self.by_free[free].append(sequence)
        self.levels |= 1 << free


class Coder:
    """Token ids of texts as unsigned 32-bit bytes of this machine's (little-endian) order.

    The ids are those of the tokenizer file. Its vocabulary is handed to a byte-pair encoder that keeps no
    offsets, which takes a fifth of the CPU time; that encoder merges by id, so a file is refused unless it
    is byte-level with the usual pattern, without normalizer, and its merges are in the order of their ids.
    Names of special tokens in a text are their ids, as the file has them.
    """

    def __init__(self, tokenizer: str):
        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            file = json.load(f)
        refuse_unless_byte_level(file)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        letters = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ids = special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")" if special else "(?!)")

    def __call__(self, text: str) -> bytes:
        if not self.special.search(text):
            return array("I", self.ordinary(text)).tobytes()
        parts = [[self.ids[part]] if i % 2 else self.ordinary(part) for i, part in enumerate(self.special.split(text))]
        return b"".join(array("I", ids).tobytes() for ids in parts)

    def ordinary(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        out: list[int] = []
        at = 0
        for run in LONG_BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoder.encode_ordinary(text[at : run.start()])
            out += self.encoder._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + self.encoder.encode_ordinary(text[at:]) if at else self.encoder.encode_ordinary(text)


def refuse_unless_byte_level(file: dict) -> None:
    """ValueError if ids of this tokenizer file aren't those of byte-pair merges by id after PATTERN."""
    model, split = file["model"], file["pre_tokenizer"] or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    fine = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    fine &= file["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    fine &= -1 not in made and made == sorted(set(made)) and len(model["vocab"]) - len(made) - sum(t["content"] in model["vocab"] for t in file["added_tokens"]) == 256
    if not fine or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"]):
        raise ValueError("not a byte-level tokenizer file whose merges are in the order of their ids")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, after a first one with what is over."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in blocks of about `most` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """SCHEMA's rows, a row for each piece; `tokenizer` is the path of a tokenizer file on every executor."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        fit = BestFit(capacity, bins, (context.partitionId() if context else 0) << 40)
        coder, end = Coder(tokenizer), np.array([end_id], "<u4").tobytes()
        for block in blocks(batches, text):
            rows = []
            ids = [coder(t or "") + end for t in block.column(text).to_pylist()]
            todo = [(length, start, i, k) for i, own in enumerate(ids) for k, (start, length) in enumerate(pieces(len(own) // 4, capacity))]
            for length, start, i, k in sorted(todo, key=lambda x: -x[0]):
                sequence, offset = fit.place(length)
                rows.append((i, k, start, length, zlib.crc32(ids[i][4 * start : 4 * (start + length)]), sequence, offset))
            cols = list(zip(*rows))
            keys = block.column(key).take(pa.array(cols[0]))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return docs.select(key, text).mapInArrow(packed, SCHEMA.format(key=key))


def op10(docs: DataFrame) -> DataFrame:
    """Every document, packed into sequences of CAPACITY tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))
