"""Packing tokenised documents into fixed-length sequences: bounded-space online best-fit.

A fixed number of bins is open at a time. A bitset over free space says which amounts are on hand, so the fullest bin
that still takes a piece is the lowest set bit at or above the piece's length; when all bins are open and none fits, the
fullest closes first. Pieces come in mixed order and are taken in runs of as many as bins may be open, each run longest
first. Only their lengths are moved; token ids stay where they were made unless asked for.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import blocks
from palisade.session import ship

SEQUENCE_TOKENS = 1024
OPEN_BINS = 4096
END_OF_TEXT = 2
#: Entries of a worker's table from a word to its ids.
CACHED_WORDS = 500_000
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The pre-tokenizer's pattern of byte-level BPE, for texts in which each character's class is the same to
# every regular-expression engine (SIMPLE); others go through the tokenizer whole.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_SIMPLE = re.compile("[^\t-\r -±´-¸º»¿-ɏ–—‘-„…€]|<\\|")

#: Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others in order from U+0100 on.
_BYTE_LETTER = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

_TOKENIZERS: dict[str, "CachedTokenizer"] = {}


class CachedTokenizer:
    """A byte-level BPE tokenizer that splits a text into words once and looks their ids up.

    BPE merges never cross the pre-tokenizer's words, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.ids: dict[str, bytes] = {}
        self.most_words = CACHED_WORDS

    @classmethod
    def of(cls, path: str) -> "CachedTokenizer":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        split = [None if _NOT_SIMPLE.search(t) else _WORD.findall(t) for t in texts]
        if len(self.ids) > self.most_words:
            self.ids.clear()
        known = self.ids
        new = list({w for words in split if words for w in words if w not in known})
        merge = self.inner.model.tokenize
        for word in new:
            known[word] = array("I", [t.id for t in merge(word.encode().decode("latin-1").translate(_BYTE_LETTER))]).tobytes()
        look = known.__getitem__
        return [np.array(self.inner.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(look, words)) for t, words in zip(texts, split, strict=True)]


def pieces(docs: DataFrame, *, tokenizer: str | None = None, text: str = "text", most: int = SEQUENCE_TOKENS, end: int = END_OF_TEXT, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row for each piece of each document, with all columns but the text; a document is its ids, then ``end``.

    ``cached_words`` bounds a worker's table of words, which outlives its tasks.
    Only documents of over ``most`` tokens are cut: into pieces of ``most``, the first of which may be shorter. A null or
    empty text is one piece, of ``end`` alone. Rows that repeat stay repeated; an empty table gives an empty one; columns
    called like an added one are replaced.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    passed = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids")]
    added = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    head = docs.select(*passed).schema
    for f in docs.sparkSession.createDataFrame([], PIECE_SCHEMA + (", ids array<int>" if with_ids else "")).schema:
        head = head.add(f)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = CachedTokenizer.of(path)
        tokenizer.most_words = cached_words
        encode = tokenizer.encode
        for whole in batches:
            for batch in blocks(whole, text):
                column = batch.column(batch.schema.get_field_index(text)).to_pylist()
                row, number, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encode([t or "" for t in column])):
                    raw += tail
                    n, at = len(raw) // 4, 0
                    size = n % most or most if n > most else n
                    k = 0
                    while at < n:
                        part = raw[4 * at : 4 * (at + size)]
                        row.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        at, size, k = at + size, most, k + 1
                made = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in passed]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*passed, *added])

    return docs.mapInArrow(run, head)


class BestFit:
    """The packer: ``place(length)`` gives (bin, offset)."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.opened = self.count = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens")
        above = self.free >> length
        if above:
            room = length + ((above & -above).bit_length() - 1)
            number, used = self._take(room)
        else:
            if self.opened == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, used, room = self.count, 0, self.capacity
            self.count += 1
        if room > length:
            self.bins[room - length].append((number, used + length))
            self.free |= 1 << (room - length)
            self.opened += 1
        return number, used

    def _take(self, room: int) -> tuple[int, int]:
        found = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
            self.free &= ~(1 << room)
        self.opened -= 1
        return found


def assign(cut: DataFrame, *, key: str = "doc_id", most: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Pieces are dealt by a hash of key and number, which splits a document and every hot key evenly, and come in an order
    that their hash mixes; each partition packs its own. Numbers are the partition's, shifted, plus a count: unique, and
    the same if a task runs again. Unless asked for more, Spark joins small partitions, so that few bins end partly
    filled. Pieces that repeat, null keys included, each get a place; an empty table gives an empty one.
    """
    mixed = F.xxhash64(key, "piece", "start")
    dealt = cut.repartition(mixed).sortWithinPartitions(mixed, key, "piece", "length", "ids_crc32")
    schema = cut.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(most, open_bins), TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, open_bins):
                batch = whole.slice(k, open_bins)
                lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
                number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
                for i in np.argsort(-lengths, kind="stable").tolist():
                    number[i], offset[i] = packer.place(int(lengths[i]))
                kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c not in ("sequence_id", "offset")]
                yield pa.RecordBatch.from_arrays([*(v for _, v in kept), pa.array(base + number), pa.array(offset)], names=[*(c for c, _ in kept), "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def pack(docs: DataFrame, *, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", most: int = SEQUENCE_TOKENS, end: int = END_OF_TEXT, open_bins: int = OPEN_BINS, with_ids: bool = True, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Tokenise and pack: a row for each piece with key, piece, start, length, ids_crc32, sequence_id, offset and, if
    wanted, ids. Other columns of the table are not carried.

    A null or empty text is the end token alone. Rows that repeat a key are packed each for itself. Sequences have no
    gaps and hold at most ``most`` tokens; no piece is dropped. An empty table gives no rows.
    """
    return assign(pieces(docs.select(key, text), tokenizer=tokenizer, text=text, most=most, end=end, with_ids=with_ids, cached_words=cached_words), key=key, most=most, open_bins=open_bins)
