"""Document fingerprints: context-triggered piecewise hashing (CTPH), compared by edit distance.

A rolling hash over seven bytes ends a chunk wherever its value is divisible by the block size, a power of two fixed by
the text's length; each chunk gives one of 64 signs. A fingerprint is "block size:signs:signs at twice that size", so two
texts whose block sizes differ by a factor of two at most share a size at which their signs are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import BLOCK_BYTES, BYTE_VALUE, U, blocks, buffers, prefix_hash, row_of, span_hash
from palisade.session import persisted, ship

#: Bytes of context that decide a boundary, the smallest block size, and the most signs of one signature.
WINDOW, LEAST_LEVEL, MOST_SIGNS = 7, 0, 64
#: Signatures of so many signs or more are alike only if they share a run of this length.
COMMON_RUN = 3
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGN = np.frombuffer(SIGNS.encode(), np.uint8)


@dataclass
class Signatures:
    """Of a run of texts: block-size exponents, and the signs (0-63) at that size and at twice it, padded with 255."""

    level: np.ndarray
    signs: tuple[np.ndarray, np.ndarray]
    lengths: tuple[np.ndarray, np.ndarray]

    def text(self, i: int) -> str:
        one, two = (_SIGN[s[i, : n[i]]].tobytes().decode() for s, n in zip(self.signs, self.lengths, strict=True))
        return f"{1 << int(self.level[i])}:{one}:{two}"

    def take(self, rows: np.ndarray) -> "Signatures":
        return Signatures(self.level[rows], tuple(s[rows] for s in self.signs), tuple(n[rows] for n in self.lengths))


def levels(sizes: np.ndarray) -> np.ndarray:
    """Exponent of the block size: 24 to 48 chunks are expected, fewer only for the shortest texts."""
    return np.maximum(LEAST_LEVEL, np.ceil(np.log2(np.maximum(sizes, 1) / 48)).astype(np.int64))


def signatures(data: np.ndarray, offsets: np.ndarray) -> Signatures:
    """Fingerprints of the texts data[offsets[i]:offsets[i+1]], all at once."""
    n, sizes = len(data), np.diff(offsets)
    level = levels(sizes)
    rows = len(sizes)
    if not n:
        return Signatures(level, (np.zeros((rows, 0), np.uint8),) * 2, (np.zeros(rows, np.int64),) * 2)
    values = BYTE_VALUE[data].astype(np.uint32)
    rolling = np.zeros(n, np.uint32)
    for k in range(min(WINDOW, n)):
        part = values * np.uint32(pow(0x01000193, k + 1, 1 << 32))
        rolling[k:] += part[: n - k] if k else part
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x2C1B3C6D)
    rolling ^= rolling >> np.uint32(12)
    # the first bytes of a row see bytes of the row before it: no boundary there
    need = (np.uint32(1) << level.astype(np.uint32)) - np.uint32(1)
    place = np.flatnonzero((rolling & np.repeat(need, sizes)) == 0)
    row = row_of(offsets, place)
    inside = place - offsets[row] >= WINDOW - 1
    place, row = place[inside], row[inside]
    h = prefix_hash(BYTE_VALUE[data])
    out, lengths = [], []
    for twice in (False, True):
        if twice:
            keep = (rolling[place] & ((need[row] << np.uint32(1)) | np.uint32(1))) == 0
            place, row = place[keep], row[keep]
        # cuts inside a row, and its end; of more than MOST_SIGNS chunks the last runs to the end
        last = offsets[1:] - 1
        full = np.flatnonzero(sizes > 0)
        inner = place != last[row]
        all_row = np.concatenate([row[inner], full])
        all_end = np.concatenate([place[inner], last[full]]) + 1
        order = np.argsort(all_end, kind="stable")
        all_row, all_end = all_row[order], all_end[order]
        first = np.searchsorted(all_row, np.arange(rows))
        number = np.arange(len(all_row)) - first[all_row]
        total = np.bincount(all_row, minlength=rows)
        keep = (number < MOST_SIGNS - 1) | (number == total[all_row] - 1)
        all_row, all_end, number = all_row[keep], all_end[keep], np.minimum(number[keep], MOST_SIGNS - 1)
        start = np.where(number == 0, offsets[all_row], np.concatenate([[0], all_end[:-1]]))
        sign = (span_hash(h, start, all_end) >> U(58)).astype(np.uint8)
        grid = np.full((rows, MOST_SIGNS), 255, np.uint8)
        grid[all_row, number] = sign
        out.append(grid)
        lengths.append(np.minimum(total, MOST_SIGNS))
    return Signatures(level, tuple(out), tuple(lengths))


def _common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of a and of b, bit-parallel: 64 steps for all rows."""
    rows = len(a)
    where = np.zeros((rows, 256), U)
    at = np.arange(rows)
    for j in range(a.shape[1]):
        where[at, a[:, j]] |= np.where(j < na, U(1) << U(j), U(0))
    v = np.full(rows, ~U(0))
    for j in range(b.shape[1]):
        u = v & where[at, b[:, j]]
        v = np.where(j < nb, (v + u) | (v - u), v)
    held = ~v & np.where(na >= 64, ~U(0), (U(1) << np.minimum(na, 63).astype(U)) - U(1))
    return np.bitwise_count(held).astype(np.int64)


def _share_run(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether each pair of rows shares COMMON_RUN signs in a row; short signatures need not."""
    def grams(x: np.ndarray, n: np.ndarray, none: int) -> np.ndarray:
        x = x.astype(np.int32)
        g = (x[:, :-2] * 64 + x[:, 1:-1]) * 64 + x[:, 2:]
        return np.where(np.arange(g.shape[1]) + COMMON_RUN <= n[:, None], g, none)

    if a.shape[1] < COMMON_RUN or b.shape[1] < COMMON_RUN:
        return np.ones(len(a), bool)
    ga, gb = np.sort(grams(a, na, -1), axis=1), grams(b, nb, -2)
    found = np.zeros(len(a), bool)
    width = ga.shape[1]
    shift = (np.arange(len(a), dtype=np.int64) * (1 << 20))[:, None]
    flat = (ga + shift).ravel()
    at = np.minimum(np.searchsorted(flat, (gb + shift).ravel()), len(flat) - 1)
    found = (flat[at] == (gb + shift).ravel()).reshape(len(a), width) & (gb >= 0)
    return found.any(axis=1) | (np.minimum(na, nb) < 2 * COMMON_RUN)


def likeness(a: Signatures, b: Signatures) -> np.ndarray:
    """0 to 1 for each pair: 1 - edit distance / total length, an edit being one sign put in or taken out.

    The best of the block sizes both have; 0 where they have none. Two empty texts have 1, an empty and another 0.
    """
    best = np.zeros(len(a.level))
    for i in (0, 1):
        for j in (0, 1):
            rows = np.flatnonzero(a.level + i == b.level + j)
            if not len(rows):
                continue
            x, nx, y, ny = a.signs[i][rows], a.lengths[i][rows], b.signs[j][rows], b.lengths[j][rows]
            total = nx + ny
            same = np.where(total == 0, 1.0, 2.0 * _common(x, nx, y, ny) / np.maximum(total, 1)) if x.shape[1] and y.shape[1] else (total == 0).astype(float)
            if i == j == 0:
                equal = (nx == ny) & (x == y).all(axis=1) if x.shape == y.shape else total == 0
                same = np.where(equal, 1.0, same)
            best[rows] = np.maximum(best[rows], np.where(_share_run(x, nx, y, ny), same, 0.0))
    return best


def of_texts(texts: list[str]) -> Signatures:
    """Fingerprints of Python strings."""
    return signatures(*buffers(pa.array(texts, pa.large_string())))


def _runs(sizes: list[int]) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > BLOCK_BYTES and i > start:
            yield slice(start, i)
            start, held = i, 0
        held += n
    yield slice(start, len(sizes))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """One result row for each text, given the text that follows it."""
    parts: list[list] = [[] for _ in range(7)]
    for run in _runs([len(t) + len(f) // 2 for t, f in zip(texts, following, strict=True)]):
        own, after = texts[run], following[run]
        changed = [edited(t, f) for t, f in zip(own, after, strict=True)]
        # texts that follow within the run are its own: only the last needs a fingerprint more
        chain = of_texts([*own, *([after[-1]] if after else [])])
        size = len(own)
        inside = all(after[i] is own[i + 1] for i in range(size - 1))
        nexts = chain.take(np.arange(1, size + 1)) if inside else of_texts(after)
        mine, other = chain.take(np.arange(size)), of_texts(changed)
        parts[0] += ids[run]
        parts[1] += map(len, own)
        parts[2] += [hashlib.sha256(c.encode()).hexdigest() for c in changed]
        parts[3] += map(mine.text, range(size))
        parts[4] += map(other.text, range(size))
        parts[5] += likeness(mine, other).tolist()
        parts[6] += likeness(mine, nexts).tolist()
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to every row; a null text reads as empty. No shuffle."""
    ship(docs.sparkSession)
    kept = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text):
                found = signatures(*buffers(batch.column(batch.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found.text(i) for i in range(batch.num_rows)], pa.string())], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, kept.select("*", F.lit("").alias("fingerprint")).schema)


def compare_neighbours(docs: DataFrame, *, key: str = "doc_id", text: str = "text", partition_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprint each text, its edited form and the document that follows it, in descending order of the key.

    Texts are dealt by ranges of the key, so each partition holds neighbours. Its last text is handed on with the first
    of the next partition that has rows: two texts of each partition are moved again, not the table. After the last
    document comes the first; a single document follows itself. Null texts are empty, null keys come last, rows that
    repeat a key are ordered by a hash of their text. Other columns of the table are not carried.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, min(size // partition_bytes + 1, 1 << 20)))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(parts, 2), *order).sortWithinPartitions(*order)
    schema = _RESULT + ", part long, place int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def ends(place: int, doc_id: int | None, value: str) -> pa.RecordBatch:
            blank = _judge([], [], [])
            nothing = [pa.nulls(1, f.type) for f in blank.schema]
            nothing[0] = pa.array([doc_id], pa.int64())
            return pa.RecordBatch.from_arrays([*nothing, pa.array([part], pa.int64()), pa.array([place], pa.int32()), pa.array([value], pa.string())], names=[*blank.schema.names, "part", "place", "text"])

        held: tuple | None = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if held is None:
                yield ends(0, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                out = _judge(ids[:-1], texts[:-1], texts[1:])
                n = out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=[*out.schema.names, "part", "place", "text"])
        if held is not None:
            yield ends(1, *held)

    made = persisted(dealt.mapInArrow(run, schema))
    result = [f.split()[0] for f in _RESULT.split(", ")]
    heads = made.where("place = 0").select("part", F.col("text").alias("following"))
    seen = sorted(r.part for r in heads.select("part").collect())  # one number for each partition
    if not seen:
        return made.select(*result)
    after = spark.createDataFrame(list(zip(seen, [*seen[1:], seen[0]], strict=True)), "part long, next long")
    tails = made.where("place = 1").select("doc_id", "text", "part").join(after, "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _judge(*(c.to_pylist() for c in batch.columns))

    return made.where("place is null").select(*result).unionByName(tails.mapInArrow(finish, _RESULT))
