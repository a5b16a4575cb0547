"""Suffix-array deduplication: remove bytes covered by a string of a given length that also starts elsewhere.

1. Every window of ``length`` bytes is given to an anchor: the k-gram of least hash inside it, the leftmost of equals.
   Equal windows have equal anchors at equal offsets, so a repeated window is a repeat among the windows of one anchor
   value. Consecutive windows of one anchor are a run; its context is the bytes they span.
2. Runs are counted by (anchor, context hash). Equal contexts are repeats as they stand, however many there are, and
   are counted before anything is shuffled whole.
3. Of anchors that have different contexts, one copy of each context goes to the anchor's shard. A shard's suffix array
   is built by induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings are sorted and named, the named
   string is sorted recursively, and both passes of induction are run bucket by bucket over whole arrays, or suffix by
   suffix where buckets hold few. Permuted common prefixes then tell which windows repeat.
4. An anchor of more contexts than a shard should hold, such as a passage that a large part of all documents has in
   different surroundings, is dealt out further: its runs are cut down to single windows, whose contexts are counted as
   in step 2, by a mergeable aggregate. No group is gathered in one task.
5. The repeated windows of a document are merged to byte spans.

Contexts are told apart by 128 bits of hashes, those of the anchor and of the context, windows of step 4 likewise; among
n contexts of one anchor two different ones pass as equal with a probability of at most n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import BLOCK_BYTES, BYTE_VALUE, U, blocks, buffers, mix, powers, prefix_hash, row_of, span_hash
from palisade.llm.membership import MAYBE, maybe_in
from palisade.session import dropped, persisted, ship

LENGTH = 400
#: Bytes of an anchor's k-gram; at most a third of the window.
GRAM = 48
#: A shard's suffix array is built once it holds so many bytes (whole anchors only).
SHARD_BYTES = 1 << 20
#: Longer documents are cut into overlapping segments for the search of anchors.
SEGMENT_BYTES = 8 << 20
#: Anchors of more different contexts are dealt out window by window.
MOST_CONTEXTS = 1024
#: Induction runs bucket by bucket where buckets hold so many suffixes on average, else suffix by suffix.
BUCKET_SUFFIXES = 64
#: Words of the bitmap of anchors that two places have: 16 million bits, a table of some 6 MB.
ANCHOR_WORDS = 1 << 18
K, TH, WINDOWS = "_palisade_k", "_palisade_th", "_palisade_windows"


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type: less than the one after it. The last symbol is the unique least."""
    n = len(s)
    up = np.zeros(n, bool)
    step = np.flatnonzero(s[1:] != s[:-1])
    at = np.searchsorted(step, np.arange(n - 1))  # the next place at which symbols differ
    where = step[np.minimum(at, len(step) - 1)]
    up[:-1] = s[where + 1] > s[where]
    up[-1] = True
    return up


def _ranks(sorted_symbols: np.ndarray) -> np.ndarray:
    """Number of each entry among its equals, in a sorted array."""
    first = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    starts = np.flatnonzero(first)
    return np.arange(len(sorted_symbols)) - starts[np.cumsum(first) - 1]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in order: larger suffixes left to right, then smaller ones right to left."""
    return (_induce_buckets if BUCKET_SUFFIXES * len(size) <= len(s) else _induce_suffixes)(s, small, lms, size)


def _induce_suffixes(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One suffix at a time, for the many small buckets of a named string."""
    symbol, is_small = s.tolist(), small.tolist()
    end = np.cumsum(size)
    head, tail, sa = (end - size).tolist(), end.tolist(), [0] * len(symbol)
    for i in reversed(lms.tolist()):
        c = symbol[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in sa:  # the list grows ahead of the place that is read
        if i:
            i -= 1
            if not is_small[i]:
                c = symbol[i]
                sa[head[c]] = i
                head[c] += 1
    tail = end.tolist()
    for at in range(len(sa) - 1, -1, -1):
        i = sa[at]
        if i:
            i -= 1
            if is_small[i]:
                c = symbol[i]
                tail[c] -= 1
                sa[tail[c]] = i
    return np.array(sa, np.int64)


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bucket at a time, over whole arrays."""
    n, symbols = len(s), len(size)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int64)
    leftmost = s[lms]
    by = np.argsort(leftmost, kind="stable")
    lms, leftmost = lms[by], leftmost[by]
    lms_count = np.bincount(leftmost, minlength=symbols)
    lms_start = np.cumsum(lms_count) - lms_count
    head = start.copy()

    def push_larger(front: np.ndarray) -> None:
        front = front[front > 0] - 1
        front = front[~small[front]]
        if len(front):
            c = s[front]
            by = np.argsort(c, kind="stable")
            c = c[by]
            sa[head[c] + _ranks(c)] = front[by]
            np.add(head, np.bincount(c, minlength=symbols), out=head)

    for c in range(symbols):
        at = start[c]
        while at < head[c]:
            stop = head[c]
            push_larger(sa[at:stop])
            at = stop
        if lms_count[c]:
            push_larger(lms[lms_start[c] : lms_start[c] + lms_count[c]])
    tail = end.copy()

    def push_smaller(front: np.ndarray) -> None:
        front = front[front > 0] - 1
        front = front[small[front]]
        if len(front):
            c = s[front]
            by = np.argsort(c, kind="stable")
            c = c[by]
            sa[tail[c] - 1 - _ranks(c)] = front[by]
            np.subtract(tail, np.bincount(c, minlength=symbols), out=tail)

    for c in range(symbols - 1, -1, -1):
        if c == 0:
            sa[0] = n - 1
            continue
        at = end[c]
        while at > tail[c]:
            stop = tail[c]
            push_smaller(sa[stop:at][::-1])
            at = stop
        if head[c] > start[c]:
            push_smaller(sa[start[c] : head[c]][::-1])
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers, the last of which is 0 and occurs nowhere else."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    size = np.bincount(s)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = _induce(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    following = np.append(lms[1:], n - 1)
    stop = np.zeros(n, np.int64)
    stop[lms] = following + 1
    h = prefix_hash(mix(s.astype(U) + U(1)))
    value, length = span_hash(h, ordered, stop[ordered]), stop[ordered] - ordered
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (length[1:] != length[:-1])
    name_of = np.zeros(n, np.int64)
    name_of[ordered] = np.cumsum(fresh) - 1
    if not fresh.all():
        ordered = lms[suffix_array(name_of[lms])]  # the last symbol's name is the unique least
    return _induce(s, small, ordered, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): phi[i] stands before suffix i in the array (-1: none), plcp[i] is their common prefix's length.

    Only irreducible places, those whose pair doesn't continue the pair one place to the left, are measured; each other
    place has one less than its left neighbour.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    continues = np.zeros(n, bool)
    continues[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (s[:-1] == s[np.maximum(phi[1:] - 1, 0)])
    at = np.flatnonzero(~continues)
    h = prefix_hash(mix(s.astype(U) + U(1)))
    _, inverse = powers(n + 1)
    a, b = at.copy(), phi[at].copy()
    ok = b >= 0
    found = np.zeros(len(at), np.int64)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step:
        reach = np.flatnonzero(ok & (np.maximum(a, b) + found + step <= n))
        x, y = a[reach] + found[reach], b[reach] + found[reach]
        same = (h[x + step] - h[x]) * inverse[x] == (h[y + step] - h[y]) * inverse[y]
        found[reach[same]] += step
        step >>= 1
    plcp = np.zeros(n, np.int64)
    run = np.cumsum(~continues) - 1
    plcp = np.maximum(found[run] - (np.arange(n) - at[run]), 0)
    plcp[phi < 0] = 0
    return plcp, phi


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the starts of the windows of ``length`` bytes that occur at another place of any of them."""
    sizes = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    s = np.ones(int(sizes.sum()) + len(contexts) + 1, np.uint16)
    s[-1] = 0
    s[np.arange(len(flat)) + np.repeat(np.arange(len(contexts)), sizes)] = flat.astype(np.uint16) + 2
    plcp, phi = permuted_prefixes(s, suffix_array(s))
    hit = np.zeros(len(s), bool)
    pair = np.flatnonzero(plcp >= length)
    hit[pair] = True
    hit[phi[pair]] = True
    return [np.flatnonzero(hit[a : a + max(0, n - length + 1)]) for a, n in zip(first, sizes, strict=True)]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window's place, number of windows, anchor hash, context hash)."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    width = length - gram + 1
    if n < length:
        return none
    if n >= 1 << 24:
        raise ValueError("segments of at most 16 MB")
    h = prefix_hash(BYTE_VALUE[data])
    _, inverse = powers(n + 1)
    value = mix((h[gram:] - h[:-gram]) * inverse[: n - gram + 1])
    keyed = (value & ~U((1 << 24) - 1)) | np.arange(len(value), dtype=U)
    # sliding minimum over ``width`` values: the least of a block's end and of the next block's beginning
    count = len(value) - width + 1
    pad = -len(keyed) % width
    grid = np.concatenate([keyed, np.full(pad, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & U((1 << 24) - 1)).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[:count] - np.arange(count)
    valid = left >= length
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & new)
    if not len(start):
        return none
    stops = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    return row_of(offsets, start), start, stops - start, value[anchor[start]], span_hash(h, start, stops - 1 + length)


def _segments(batch: pa.RecordBatch, text: str, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, place of the first byte in its row) of runs of short texts, or of pieces of a long one."""
    for part in blocks(batch, text):
        data, offsets = buffers(part.column(part.schema.get_field_index(text)))
        if len(data) <= SEGMENT_BYTES:
            yield part, data, offsets, 0
            continue
        for k in range(0, len(data) - length + 1, SEGMENT_BYTES):
            piece = data[k : k + SEGMENT_BYTES + length - 1]
            yield part, piece, np.array([0, len(piece)]), k


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows under (K, TH): the key and a hash of the text, so that rows which repeat a key keep their own results."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({K: F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), TH: F.xxhash64(value, F.lit("text"))})


def _wanted_pieces(rows: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, each with the places c of its contexts that are asked for; the stored table of the places)."""
    place = F.struct("fp", "copies", "one.at", "one.n")
    wanted = persisted(contexts.select("one.k", "one.th", place.alias("c")).groupBy("k", "th").agg(F.collect_list("c").alias("c")))
    return maybe_in(rows, wanted.select("th"), "th").where(MAYBE).join(wanted, ["k", "th"]).select("k", "th", "text", "c"), wanted


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, shard_bytes: int = SHARD_BYTES, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(k, th, windows): the repeated windows of each row that has any, as an array of (start, number of windows).

    ``windows`` of one row are gathered in one place; they are at most as many as its text has bytes. The result is a
    stored table, for the caller to drop. Null and empty texts, and texts shorter than ``length``, have no windows; an
    empty table gives an empty one. Rows that share a key are told apart by a hash of their texts, and rows that share
    that as well have equal results.
    """
    ship(docs.sparkSession)
    gram = gram or max(1, min(GRAM, length // 3))
    rows = _keyed(docs, key, text).select(F.col(K).alias("k"), F.col(TH).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets, base in _segments(batch, "text", length):
                row, start, count, fp, ctx = anchors(data, offsets, length, gram)
                if len(row):
                    k, th = (part.column(i).to_numpy() for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[row], th[row], start - offsets[row] + base, count, fp.view(np.int64), ctx.view(np.int64))], names=["k", "th", "at", "n", "fp", "ctx"])

    def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, th, value, wants in zip(*(batch.column(i) for i in range(4)), strict=True):
            raw = value.as_py().encode()
            fp, copies, at, n = (x.to_numpy() for x in wants.values.flatten())
            for f, c, a, m in zip(fp.tolist(), copies.tolist(), at.tolist(), n.tolist(), strict=True):
                yield k.as_py(), th.as_py(), f, c, a, raw[a : a + m + length - 1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for piece in pieces_of(batch):
                held.append(piece)
                size += len(piece[5])
                if size >= BLOCK_BYTES:
                    yield _piece_batch(held)
                    held, size = [], 0
            if held:
                yield _piece_batch(held)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, th, fp, copies, at, raw in pieces_of(batch):
                h = prefix_hash(BYTE_VALUE[np.frombuffer(raw, np.uint8)])
                start = np.arange(len(raw) - length + 1)
                same = [pa.array(np.full(len(start), x)) for x in (k, th, fp, copies)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + start), pa.array(span_hash(h, start, start + length).view(np.int64))], names=["k", "th", "fp", "copies", "at", "window"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            out: list[tuple] = []
            for (k, th, _, copies, at, raw), starts in zip(held, repeated_windows([x[5] for x in held], length), strict=True):
                if copies > 1 or not len(starts):
                    continue  # contexts with copies are known already; here they stand for what others may repeat
                edge = np.flatnonzero(np.diff(starts) != 1)
                a, b = np.concatenate([[0], edge + 1]), np.append(edge, len(starts) - 1)
                out += [(k, th, at + int(x), int(y - x) + 1) for x, y in zip(starts[a], starts[b], strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "th", "at", "n"])

        held, size = [], 0
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_bytes and item[2] != held[-1][2]:
                    yield solve()
                    held, size = [], 0
                held.append(item)
                size += len(item[5])
        if held:
            yield solve()

    stored: list[DataFrame] = []

    def step(df: DataFrame) -> DataFrame:
        stored.append(persisted(df))
        return stored[-1]

    try:
        found = step(rows.mapInArrow(find, "k long, th long, at long, n long, fp long, ctx long"))
        # most anchors stand at one place only: their runs are told by a count and go no further
        often = found.groupBy("fp").count().where("count > 1").select("fp")
        near = maybe_in(found, often, "fp", ANCHOR_WORDS).where(MAYBE).drop(MAYBE)
        contexts = step(near.groupBy("fp", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("k", "th", "at", "n")).alias("one")))
        kinds = step(contexts.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"))  # stored, as is ``again``, so that a skewed join may split what meets it
        several = step(contexts.join(kinds, "fp").select("fp", "copies", "kinds", "one"))
        met = contexts.where("copies > 1").select("fp", "ctx")
        equal = maybe_in(found, met.select("ctx"), "ctx", ANCHOR_WORDS).where(MAYBE).join(met, ["fp", "ctx"], "left_semi").select("k", "th", "at", "n")
        pieces, wanted = _wanted_pieces(rows, several.where(F.col("kinds") <= most_contexts))
        stored.append(wanted)
        shards = pieces.mapInArrow(cut, "k long, th long, fp long, copies long, at long, bytes binary").repartition("fp").sortWithinPartitions("fp", "k", "th", "at")
        every = equal.unionByName(shards.mapInArrow(search, "k long, th long, at long, n long"))
        crowded = several.where(F.col("kinds") > most_contexts)
        if crowded.limit(1).count():
            pieces, wanted = _wanted_pieces(rows, crowded)
            stored.append(wanted)
            windows = step(pieces.mapInArrow(slide, "k long, th long, fp long, copies long, at long, window long"))
            again = step(windows.groupBy("fp", "window").agg(F.sum("copies").alias("total")).where("total > 1").select("fp", "window"))
            every = every.unionByName(windows.where("copies = 1").join(again, ["fp", "window"], "left_semi").select("k", "th", "at", F.lit(1).cast("long").alias("n")))
        return persisted(every.groupBy("k", "th").agg(F.collect_list(F.struct("at", "n")).alias("windows")))
    finally:
        dropped(*stored)


def _piece_batch(pieces: list[tuple]) -> pa.RecordBatch:
    *numbers, raw = zip(*pieces, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(raw, pa.binary())], names=["k", "th", "fp", "copies", "at", "bytes"])


def _merge(at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans covered by windows, as starts and ends that neither touch nor overlap."""
    order = np.argsort(at, kind="stable")
    start, end = at[order], at[order] + n[order] - 1 + length
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = True, digests: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts at least twice in the table.

    Adds n_bytes, n_removed, n_spans and spans (byte starts and ends, before removal); with ``digests`` kept_sha256, over
    the remaining bytes. ``keep_text`` replaces the text by what remains: a code point cut by a span's edge stays whole.
    A null text counts as empty and stays null; texts shorter than ``length`` stay as they are. Rows that repeat, or
    that share a key, repeat each other's texts where these are equal. Other columns pass through, but for those called
    like an added one, which are replaced, and names that begin with ``_palisade_``, which are reserved; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "spans", *(["kept_sha256"] if digests else [])]
    docs = docs.drop(*added)
    spans = repeated_spans(docs, key=key, text=text, length=length).select(F.col("k").alias(K), F.col("th").alias(TH), F.col("windows").alias(WINDOWS))
    marked = maybe_in(_keyed(docs, key, text), spans.select(TH), TH)
    # rows without repeats stay where they are
    joined = marked.where(MAYBE).join(spans, [K, TH], "left").select(*docs.columns, WINDOWS)
    joined = joined.unionByName(marked.where(f"not {MAYBE}").select(*docs.columns, F.lit(None).cast(spans.schema[WINDOWS].dataType).alias(WINDOWS)))
    passed = [c for c in docs.columns if keep_text or c != text]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    extra = [F.lit(0).cast("long").alias(c) for c in added[:3]] + [F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans")] + ([F.lit("").alias("kept_sha256")] if digests else [])
    schema = docs.select(*passed, *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text, 4 * BLOCK_BYTES):
                at = batch.schema.get_field_index
                column, windows = batch.column(at(text)), batch.column(at(WINDOWS))
                data, offsets = buffers(column)
                has = windows.is_valid().to_numpy(zero_copy_only=False)
                removed, number, all_spans, digest, kept = [], [], [], [], []
                nulls = column.is_null().to_numpy(zero_copy_only=False)
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    start = end = np.zeros(0, np.int64)
                    if has[i]:
                        start, end = _merge(*(x.to_numpy() for x in windows[i].values.flatten()), length)
                    removed.append(int((end - start).sum()))
                    number.append(len(start))
                    all_spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(raw)]])
                    if digests:
                        sha = hashlib.sha256()
                        for a, b in edges.reshape(-1, 2):
                            sha.update(raw[a:b])
                        digest.append(sha.hexdigest())
                    if keep_text:
                        kept.append(None if nulls[i] else _whole_characters(raw, edges))
                out = {c: batch.column(at(c)) for c in passed}
                if keep_text:
                    out[text] = pa.array(kept, pa.string())
                out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), "spans": pa.array(all_spans, span_type)}
                if digests:
                    out["kept_sha256"] = pa.array(digest, pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return joined.mapInArrow(run, schema)


def _whole_characters(raw: np.ndarray, edges: np.ndarray) -> str:
    """The bytes outside the spans; a span gives back the parts of characters that its edges cut."""
    parts = []
    for a, b in edges.reshape(-1, 2).tolist():
        while a > 0 and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        parts.append(raw[a:b].tobytes())
    return b"".join(parts).decode("utf-8", "ignore")
