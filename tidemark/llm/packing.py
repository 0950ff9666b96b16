"""Sum-of-squares online packing of tokenised documents into training windows.

A document's ids are its tokens and one closing id.  Whole windows are cut from
its front; what is left, shorter than a window, is placed on arrival into the
open fill level that makes the sum of the squared counts of partially filled
windows smallest (a window of its own is level 0).  The counts are one array
with an entry for each level.

Every task packs its own rows, so nothing is shuffled and no key is hot.  It
holds the ids of open windows only; beyond ``HELD`` of them, and at its end, the
open windows are drained: the emptiest are cut up to fill the fullest, and the
last one is cut into windows of power-of-two lengths, which need no padding.
A lost task is packed again from the same rows, with the same sequence ids
(partition number and a counter).

Words between ASCII white space, and their parts, are tokenised once for each
task and looked up afterwards.  This gives the ids of the whole text where the
tokenizer folds case, drops white space and splits letters, digits and signs, as
``word_bpe_49k.json`` does; ``split=False`` cuts at white space alone.

Defined results: null and empty texts have the closing id alone; a text of any
length is cut into pieces of at most a window, and is read in blocks of
``BLOCK`` bytes; repeated rows are packed one by one; rows without an id keep a
null id; an empty table packs to no piece.  Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

from .grams import as_text

WINDOW = 4096
CLOSING = 2
#: ids in open windows that a task holds before it drains them
HELD = 1 << 23
#: bytes of a text that are tokenised at once
BLOCK = 4 << 20
#: parts of words that a task remembers
PARTS_HELD = 1_000_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


# Parts of a word that the tokenizer handles apart from the rest: a digit, a run of
# letters, a run of ASCII signs.  What a mark or letter beyond Latin-1 may join, or
# what follows an apostrophe, stays one part with the rest of the word.
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
PARTS = re.compile(rb"[0-9]|" + _LETTER + rb"++(?![\x80-\xff])"
                   rb"|(?!')[^a-z0-9\x20\x09-\x0d\x80-\xff]++(?![\x80-\xff])|[^\x20\x09-\x0d]+")
PLAIN = re.compile(rb"[0-9]|" + _LETTER + rb"+|[!-/:-@\[-`{-~]+")


class WordIds(dict):
    """Token ids, as bytes, of the parts of words; the tokenizer sees each part once.  ``split`` tells whether words may be cut."""

    def __init__(self, tokenizer, split: bool = True):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model, self.split = tokenizer, tokenizer.model, split
        self.signs = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        if self.split and PLAIN.fullmatch(part):
            # one piece of the tokenizer's own splitting: its model alone remains
            if not text.isascii():
                text = self.signs.pre_tokenize_str(text.lower())[0][0]
            ids = [x.id for x in self.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[part] = out = array("I", ids).tobytes()
        return out

    def word(self, word: bytes) -> bytes:
        parts = PARTS.findall(word) if self.split else [word]
        return b"".join([self[p] for p in parts]) if len(parts) > 1 else self[word]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, and the end)."""
        if len(self) > PARTS_HELD:
            self.clear()
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.split else texts)
        found = words.flatten().dictionary_encode()
        known = self.get
        lists = [known(w) or self.word(w) for w in found.dictionary.cast(pa.large_binary()).to_pylist()]
        flat = np.frombuffer(b"".join(lists), np.uint32)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        at = found.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)]
        return ids, ends[words.offsets.to_numpy() - words.offsets[0].as_py()]


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut at ASCII white space only."""
    lo = 0
    for space in re.finditer(rb"[\x20\x09-\x0d]", text):
        if space.start() - lo >= size:
            yield text[lo:space.start()]
            lo = space.start()
    yield text[lo:]


def documents_ids(texts: pa.Array, words: WordIds) -> Iterator[np.ndarray]:
    """The ids of one text after another, about ``BLOCK`` bytes at a time."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(texts):
        total = np.cumsum(sizes[lo:])
        n = max(1, int(np.searchsorted(total, BLOCK, "right")))
        part = texts.slice(lo, n)
        if n == 1 and sizes[lo] > BLOCK:
            parts = [pa.array([b.decode()], pa.large_string()) for b in blocks(part[0].as_py().encode())]
            yield np.concatenate([words.ids(p)[0] for p in parts])
        else:
            flat, cut = words.ids(part)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield flat[a:b]
        lo += n


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` as they come; ``done``
    receives the rows of closed windows."""

    def __init__(self, first_id: int = 0, window: int = WINDOW, held: int = HELD):
        self.window, self.limit, self.next_id = window, held, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.held = 0
        self.done: list[tuple] = []

    def level(self, size: int) -> int:
        """The level to place ``size`` ids on: the least sum of squares afterwards,
        of equal ones the fullest; 0 is a new window."""
        n = self.levels
        below = n[1:self.window - size + 1]
        if not below.size:
            return 0
        # a window moves from level h to h + size, or is full and leaves
        cost = 2 * (n[size + 1:] - below) + 2
        cost[-1] -= 1
        cost[below == 0] = np.iinfo(np.int64).max
        at = int(cost.size - 1 - np.argmin(cost[::-1]))
        return at + 1 if cost[at] <= 2 * n[size] + 1 else 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for lo in range(0, whole, self.window):
            self._close([(doc_id, lo, ids[lo:lo + self.window], total)])
        if whole < total:
            self._place((doc_id, whole, ids[whole:], total))
        if self.held > self.limit:
            self.drain()

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        h = self.level(size)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.levels[h] -= 1
        pieces.append(piece)
        if h + size == self.window:
            self.held -= h
            self._close(pieces)
        else:
            self.levels[h + size] += 1
            self.open.setdefault(h + size, []).append(pieces)
            self.held += size

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def drain(self) -> None:
        """Close all open windows: the emptiest are cut up to fill the fullest."""
        windows = [(h, p) for h in sorted(self.open) for p in self.open[h]]
        lo, hi = 0, len(windows) - 1
        spare: list[tuple] = []  # pieces of cut windows, the next one last
        while lo <= hi:
            fill, pieces = windows[hi]
            hi -= 1
            while fill < self.window:
                if not spare:
                    if lo > hi:
                        break
                    spare = windows[lo][1][::-1]
                    lo += 1
                doc_id, start, ids, total = spare.pop()
                room = self.window - fill
                pieces.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
                fill += min(room, len(ids))
            if fill == self.window:
                self._close(pieces)
            else:
                spare = pieces[::-1]
        left = sum(len(p[2]) for p in spare)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            pieces, fill = [], 0
            while fill < size:
                doc_id, start, ids, total = spare.pop()
                room = size - fill
                pieces.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
                fill += min(room, len(ids))
            self._close(pieces)
        self.levels[:] = 0
        self.open, self.held = {}, 0


_tokenizers: dict[tuple[str, bool], WordIds] = {}


def _words(name: str, split: bool) -> WordIds:
    if (name, split) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        _tokenizers[name, split] = WordIds(tokenizer, split)
    return _tokenizers[name, split]


def _rows(done: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, ids, total, seq, offset = zip(*done)
    crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids]
    columns = [doc, start, [len(x) for x in ids], crc, total, seq, offset]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    if with_ids:
        arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def _task(name: str, split: bool, window: int, closing: int, held: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(name, split)
        packer = Packer(TaskContext.get().partitionId() << 40, window, held)
        end = np.array([closing], np.uint32)
        for batch in batches:
            texts = as_text(batch.column("text")).cast(pa.large_string())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), documents_ids(texts, words)):
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(packer.done) >= 2048:
                    yield _rows(packer.done, with_ids)
                    packer.done = []
        packer.drain()
        if packer.done:
            yield _rows(packer.done, with_ids)
    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing: int = CLOSING,
         held: int = HELD, split: bool = True, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents and the sequences that hold them; with ``with_ids``
    also the ids of each piece.  The tokenizer's file is sent to the executors."""
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_task(os.path.basename(tokenizer_path), split, window, closing, held, with_ids), schema)


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path, with_ids=False)
