"""SentencePiece encoding and decoding by weighted finite-state transduction.

The model file is compiled to three machines over the tropical semiring (a path's weight is the sum of its arcs', the
least path wins):

* the normaliser: the model's character map, if it has one, as a machine that applies the longest rule at each place,
  then single spaces, a space mark before the text and for every space;
* the pieces with byte fallback: an arc for every piece that the text spells from a place, and for a character that no
  piece spells the arcs of its bytes;
* for BPE models a machine over pairs of pieces, whose states are the last piece: weight zero where BPE leaves the two
  side by side, infinite where it would have merged across them. A segmentation all of whose pairs have weight zero is
  the one that merging by rank gives, so the shortest path is BPE's result. Unigram models have their pieces' costs on
  the arcs instead, and need no such machine.

An input is composed with them arc by arc and the shortest path is taken by Viterbi's recursion. No arc spans two
segments if no piece holds the two characters where they meet, so a text is cut there and equal segments are looked up.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import blocks
from palisade.session import ship

SPACE = "▁"
#: Entries of a worker's tables from segments to ids, and from pairs of pieces to weights.
CACHED_SEGMENTS, CACHED_PAIRS = 500_000, 2_000_000
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Weight, beyond the least piece's, of a character without a piece in unigram models.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The model's normaliser: a deterministic machine over bytes, of which the longest rule that fits is applied.

    It comes as a double array, each state a number that holds the byte leading to it, where its successors stand, and
    whether a rule ends there; replacements follow as zero-ended strings. Runs of ASCII in which no rule can begin are
    copied whole.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.states = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.replacements = compiled[4 + size :]
        ascii_rule = lambda c: (at := self._step(self._root(), c)) is not None and (self.states[at] >> 8 & 1 or any(self._step(self._below(at), d) is not None for d in range(128)))
        free = bytes(c for c in range(32, 127) if not ascii_rule(c))
        self.plain = re.compile(b"[" + re.escape(free) + rb"]+(?=[\x00-\x7f]|\Z)") if free else None

    def _below(self, at: int) -> int:
        state = self.states[at]
        return at ^ (state >> 10) << ((state & 1 << 9) >> 6)

    def _root(self) -> int:
        return self._below(0)

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.states) and self.states[at] & 0x800000FF == byte else None

    def _longest(self, raw: bytes, start: int) -> tuple[int, int]:
        """(bytes, place of the replacement) of the longest rule that fits here; no bytes if none does."""
        base, found = self._root(), (0, 0)
        for n in range(start, len(raw)):
            at = self._step(base, raw[n])
            if at is None:
                break
            base = self._below(at)
            if self.states[at] >> 8 & 1:
                found = (n + 1 - start, self.states[base] & 0x7FFFFFFF)
        return found

    def apply(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            if self.plain is not None and (run := self.plain.match(raw, at)):
                out.append(run.group())
                at = run.end()
                continue
            size, place = self._longest(raw, at)
            if size:
                out.append(self.replacements[place : self.replacements.index(b"\0", place)])
            else:
                first = raw[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                out.append(raw[at : at + size])
            at += size
        return b"".join(out).decode()


class PieceTransducer:
    """The compiled model: ``encode`` and ``decode``."""

    _loaded: dict[str, "PieceTransducer"] = {}

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.trim, self.map = UNIGRAM, True, True, None
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, 1))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.map = CharacterMap(spec[2]) if spec.get(2) else None
                self.dummy_prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.spelled = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, USER_DEFINED)}
        self.longest = max(map(len, self.spelled), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        if self.kind == BPE:
            # pieces that merging never reaches have no arc
            self.spelled = {p: i for p, i in self.spelled.items() if len(p) == 1 or self._merged(p) == [p]}
        #: Every beginning of a piece: the piece, or -1 where none ends.
        self.begun = {p[:k]: -1 for p in self.spelled for k in range(1, len(p))} | self.spelled
        self.joins = {p[k : k + 2] for p in self.spelled for k in range(len(p) - 1)}
        self.cut = self._cutter()
        self.cache: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    @classmethod
    def of(cls, path: str) -> "PieceTransducer":
        if path not in cls._loaded:
            with open(path, "rb") as f:
                cls._loaded[path] = cls(f.read())
        return cls._loaded[path]

    def _merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours, the leftmost of equals, makes of a text."""
        parts, spelled, scores = list(text), self.spelled, self.scores
        while len(parts) > 1:
            found = [(-scores[spelled[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in spelled]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _cutter(self) -> re.Pattern:
        """Runs from one space mark to the next, if no piece goes on from another character to a space mark."""
        if any(b == SPACE and a != SPACE for a, b in self.joins):
            return re.compile(r"(?s).+")
        return re.compile(r"(?s)▁+[^▁]*|[^▁]+")

    def _segment(self, segment: str) -> bytes:
        """Ids of a segment, cut further where no piece holds both neighbours."""
        joins, cache, out, start = self.joins, self.cache, [], 0
        for k in range(1, len(segment) + 1):
            if k == len(segment) or segment[k - 1 : k + 1] not in joins:
                part = segment[start:k]
                ids = cache.get(part)
                if ids is None:
                    ids = cache[part] = array("I", self.shortest_path(part)).tobytes()
                out.append(ids)
                start = k
        return b"".join(out)

    def weight(self, left: int, right: int) -> bool:
        """Whether BPE leaves two pieces side by side: a pair arc of weight zero."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            got = self.pairs[key] = a[-1] + b[0] not in self.joins or self._merged(a + b) == [a, b]
        return got

    def shortest_path(self, segment: str) -> list[int]:
        """Ids on the least path through a segment's composed machine. -1 stands for a character without a piece."""
        n = len(segment)
        least: list[tuple[float, int, int] | None] = [None] * (n + 1)  # weight, piece, place it starts at
        least[0] = (0.0, -2, -1)
        begun, scores, pairs = self.begun, self.scores, self.pairs
        unigram = self.kind == UNIGRAM
        penalty = UNKNOWN_PENALTY - min(scores) if unigram else 0.0
        for start in range(n):
            state = least[start]
            if state is None:
                continue
            total, last, _ = state
            for end in range(start + 1, n + 1):
                piece = begun.get(segment[start:end])
                if piece is None:
                    if end > start + 1:
                        break  # no piece begins so
                    piece = -1
                if piece < 0 and end > start + 1:
                    continue
                old = least[end]
                if unigram:
                    cost = total + (penalty if piece < 0 else -scores[piece])
                    if old is None or cost < old[0]:
                        least[end] = (cost, piece, start)
                elif old is None:  # paths of weight zero to one place end in the same piece
                    if last >= 0 <= piece:
                        fits = pairs.get((last, piece))
                        if not (self.weight(last, piece) if fits is None else fits):
                            continue
                    least[end] = (0.0, piece, start)
                if piece < 0 and segment[start:end] not in begun:
                    break
        out, at = [], n
        while at:
            _, piece, start = least[at]
            out += [piece] if piece >= 0 else self._fallback(segment[start:at])
            at = start
        return out[::-1]

    def _fallback(self, character: str) -> list[int]:
        """A character's bytes, last first."""
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in reversed(character.encode("utf-8", "surrogatepass"))]

    def normalise(self, text: str) -> str:
        if self.map is not None:
            text = self.map.apply(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        segments = self.cut.findall(self.normalise(text))
        cache = self.cache
        if len(cache) > CACHED_SEGMENTS:
            cache.clear()
        for s in segments:
            if s not in cache:
                cache[s] = self._segment(s)
        return b"".join(map(cache.__getitem__, segments))

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte pieces that aren't UTF-8 read as U+FFFD."""
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def encode(docs: DataFrame, *, model: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (array of int). A null or empty text has no ids; whole texts are read, and repeated rows stay.

    A space mark (U+2581) in a text reads as a space. Columns of the input called ``ids`` are replaced; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    path = model or default_model()
    passed = [c for c in docs.columns if c != "ids" and (keep_text or c != text)]
    schema = docs.select(*passed).withColumn("ids", F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = PieceTransducer.of(path)
        for whole in batches:
            for batch in blocks(whole, text):
                at = batch.schema.get_field_index
                ids = [np.frombuffer(machine.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(at(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in passed), pa.array(ids, pa.list_(pa.int32()))], names=[*passed, "ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, *, model: str | None = None, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of an array of ids; null ids give null, an id outside the model is an error."""
    ship(rows.sparkSession)
    path = model or default_model()
    kept = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = PieceTransducer.of(path)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids))
            out = [None if v is None else machine.decode(np.array(v, "<u4").tobytes()) for v in values.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("string")).schema)


def digests(docs: DataFrame, *, model: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_ids, ids_crc32, decoded_sha256, round_trip) of every text, encoded and decoded in one pass.

    ``round_trip`` says whether the decoded text is the text; ids and texts stay in the workers. Null and empty texts have
    no ids and an empty decoded text. Rows that repeat stay repeated, other columns of whatever name aren't carried, and
    an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = PieceTransducer.of(path)
        for whole in batches:
            for batch in blocks(whole, "text"):
                rows = []
                for t in batch.column(1).to_pylist():
                    ids = machine.encode(t or "")
                    back = machine.decode(ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")))
                n, crc, sha, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=[key, "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"{key} long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
