"""N-gram Jaccard join: a size-aware heavy-light set join that keeps every link and never lists a group's pairs.

A text is its set of word shingles. Texts with equal sets are one node from the start. For the others:

* Tokens are ordered rarest first: a quarter of the token space by its true document frequency, the rest by hash. Two
  linked sets, each of which must hold ``t`` tokens of the other, share ``l`` of their first ``n - t + l`` tokens.
* Light (small) sets are indexed under all pairs of those tokens (l = 2), heavy (large) sets under each single token
  (l = 1), whose inverted lists are scanned. The boundary is where both cost the same, by the length of the lists that
  prefixes reach in the whole table. Heavy sets that may be linked with light ones are indexed both ways.
* A token that only one set holds makes no key, so a text unlike all others costs nothing further.
* Under each key, sets are compared by size and by a parity bitmap, whose differing bits never exceed the differing
  tokens: what it turns away is no link. Each set proposes its nearest, proposals are checked on the whole sets, linked
  sets are contracted, and only sets of different components are compared again. A last round proposes all that remain.
* A key of many sets is dealt out: by salted blocks, other ones in each round, while sets propose their nearest; in the
  last round as a grid, whose cells hold a block of the sets outside the key's largest component and a block of all, so
  that each pair which remains meets in one cell. No group of over some BLOCK rows is held by a task.

Shingles are told apart by 64 bits, whole sets by 128 and their size: among n different shingles two pass as equal with a
probability of at most n * n / 2 ** 65 anywhere in the table, which could only add one to a pair's intersection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import BYTE_VALUE_FOLDED, U, blocks, buffers, mix, prefix_hash, row_of, span_hash, words
from palisade.llm.components import connected_components
from palisade.llm.membership import MAYBE, maybe_in
from palisade.session import dropped, persisted, ship

#: Words of a shingle and least similarity, in percent, unless a caller has its own.
SHINGLE, PERCENT = 5, 80
#: Tokens whose hash lies below this are ordered by document frequency.
RANKED = U(1 << 62)
BITMAP_WORDS = 8
#: Rounds in which each set proposes one partner, before the round that proposes all that remain.
NEAREST_ROUNDS = 3
#: Each of those rounds looks under one in so many keys: sets that are alike share many. The last looks under all.
KEY_SHARE = 8
#: Sets under a key that one task compares; keys of more are dealt out.
BLOCK = 1024
#: Index keys that a light set makes at most: a set of whatever size needs bounded memory.
LIGHT_KEYS = 4096
#: Words of the bitmap of tokens that two sets hold: 16 million bits, a table of some 6 MB.
TOKEN_WORDS = 1 << 18
#: Slots of the filter that tells whose tokens are fetched; a fixed size, and only a filter.
FILTER_BITS = 22


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that any partner of a set of n must share with it."""
    return (percent * n + 99) // 100


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending. A text of fewer than k words is one shingle; without words none."""
    starts, ends = words(data, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, U)] * rows
    h = span_hash(prefix_hash(BYTE_VALUE_FOLDED[data]), starts, ends)
    row = row_of(offsets, starts)
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    total = h * U(0xD6E8FEB86659FD93)
    for j in range(1, k):
        total[: len(h) - j] += h[j:] * U((0xD6E8FEB86659FD93 * (2 * j + 1) ** 3) % (1 << 64))
    total = mix(total)
    out = []
    for i in range(rows):
        n = int(count[i])
        if n >= k:
            out.append(np.unique(total[first[i] : first[i] + n - k + 1]))
        elif n:
            own = h[first[i] : first[i] + n]
            out.append(mix(np.sum(own * (np.arange(1, n + 1, dtype=U) * U(2) + U(1)), dtype=U, keepdims=True) + U(n)))
        else:
            out.append(np.zeros(0, U))
    return out


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit."""
    odd = np.bincount((mix(tokens) >> U(64 - 9)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    a, b = mix(tokens ^ U(0x5851F42D4C957F2D)), mix(tokens + U(0x14057B7EF767814F))
    return int(np.sum(a, dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64)) if len(tokens) else 0


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """(key, text_hash, node, check, n, bitmap) of every row; node and check are two hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = token_sets(*buffers(batch.column(1)), k)
                node, check = zip(*map(_set_hash, sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_bitmap(s) for s in sets], pa.binary())], names=["key", "text_hash", "node", "check", "n", "bitmap"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "key long, text_hash long, node long, check long, n long, bitmap binary")


def _postings(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, node, n, ranked): a set's ranked tokens, with as many of the others as its prefix may need.

    ``ranked`` is the number of ranked tokens of the set. A set met again in the same task is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in blocks(whole, "text"):
                out: list[np.ndarray] = []
                node, size, ranked = [], [], []
                for tokens in token_sets(*buffers(batch.column(1)), k):
                    n = len(tokens)
                    if n < 2 or (mark := _set_hash(tokens)) in seen:
                        continue
                    if len(seen) < 1 << 18:
                        seen.add(mark)
                    low = int(np.searchsorted(tokens, RANKED))
                    longest = n - int(need(np.int64(n), percent)) + 2
                    take = tokens[: max(low, min(n, longest))]
                    out.append(take)
                    node.append(np.full(len(take), mark[0]))
                    size.append(np.full(len(take), n))
                    ranked.append(np.full(len(take), low))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (node, size, ranked))], names=["token", "node", "n", "ranked"])

    return docs.mapInArrow(run, "token long, node long, n long, ranked long")


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Whole groups of the first column, from sorted batches, as arrays of one or more groups each."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [_column(batch.column(i)) for i in range(columns)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in now]
        held = [c[cut:] for c in now]
    if held is not None and len(held[0]):
        yield held


def _column(c: pa.Array) -> np.ndarray:
    if pa.types.is_binary(c.type):
        data, offsets = buffers(c)
        return data.reshape(len(c), -1).view(U) if len(c) else np.zeros((0, BITMAP_WORDS), U)
    return c.to_numpy()


def _shared_tokens(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, token, n, ranked, df) of tokens that at least two sets list, each once.

    Tokens are counted where they are; of the postings only those that the bitmap of such tokens lets pass are moved. A
    token that a large part of all sets holds is one row of ``counts``, so that a skewed join can split its postings.
    """
    near = maybe_in(postings, counts.select("token"), "token", TOKEN_WORDS).where(MAYBE).drop(MAYBE)
    # dealt anew before copies of a set are merged, so that the join needn't keep a token's postings together
    listed = near.join(counts, "token").repartition("node", "token")
    return listed.groupBy("node", "token").agg(*[F.first(c).alias(c) for c in ("n", "ranked", "df")])


def _token_counts(postings: DataFrame) -> DataFrame:
    """(token, df) of tokens that two different sets list. ``df`` orders tokens, the same everywhere; copies count."""
    counted = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("df"))
    return counted.where("lo < hi").select("token", "df")


def boundary(list_length: float, percent: int) -> int:
    """Largest size that is light: all pairs of its prefix cost no more than its keys with a scan of their lists.

    Prefixes hold the rarest tokens, so a list's length is that at the prefix's share of all listed tokens, in order. A
    set of more than LIGHT_KEYS pairs is heavy however long the lists are.
    """
    n = 2
    while True:
        extra = n + 1 - int(need(np.int64(n + 1), percent))
        if math.comb(extra + 2, 2) > min((extra + 1) * (1 + list_length), LIGHT_KEYS):
            return n
        n += 1


def _keys(shared: DataFrame, light: int, percent: int) -> DataFrame:
    """(key, node, n): the index entries of each set. A set's shared tokens are gathered in one place, and are no more
    than its tokens."""
    bridge = 100 * light // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, token, size, ranked, df in _groups(batches, 5):
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            out, who, n_of = [], [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
                n, known = int(size[a]), int(ranked[a])
                extra = n - int(need(np.int64(n), percent))
                t, d = token[a:b].view(U), df[a:b]
                is_ranked = t < RANKED
                order = np.lexsort((t[is_ranked], d[is_ranked]))
                head, tail = t[is_ranked][order], t[~is_ranked]
                alone = known - len(head)  # ranked tokens that no other set has come first in the order

                def prefix(length: int) -> np.ndarray:
                    front = head[: max(0, length - alone)]
                    beyond = length - known
                    return np.concatenate([front, tail]) if beyond > 0 else front

                before = len(out)
                if n > light:
                    out.append(mix(prefix(extra + 1) ^ U(0x2545F4914F6CDD1D)))
                if n <= bridge:
                    p = prefix(extra + 2)
                    i, j = np.triu_indices(len(p), 1)
                    low, high = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                    out.append(mix(low * U(0x9E3779B97F4A7C15) + mix(high)))
                made = sum(map(len, out[before:]))
                who.append(np.full(made, node[a]))
                n_of.append(np.full(made, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(n_of))], names=["key", "node", "n"])

    return shared.repartition("node").sortWithinPartitions("node").mapInArrow(run, "key long, node long, n long")


def _passing(x: np.ndarray, y: np.ndarray, n: np.ndarray, bitmap: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, differing bits) of those pairs of places that the bitmaps let pass."""
    apart = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(axis=1).astype(np.int64)
    ok = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
    return x[ok], y[ok], apart[ok]


def _dealt(entries: DataFrame, *order: str) -> DataFrame:
    return entries.repartition("deal").sortWithinPartitions("deal", *order)


def _propose_nearest(entries: DataFrame, crowded: DataFrame, bitmaps: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b, apart) from entries (key, n, node, label) and bitmaps (node, bitmap): under each key, each set's nearest smaller-or-equal one
    of another component by the bitmap. A crowded key's sets meet in blocks, dealt anew with each turn."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal, n, node, label, bitmap in _groups(batches, 5):
            rows = len(deal)
            best, partner = np.full(rows, 1 << 30), np.full(rows, -1, np.int64)
            at = np.arange(rows)
            for step in range(1, rows):
                at = at[at + step < rows]
                other = at + step
                alike = (deal[at] == deal[other]) & (100 * n[at] >= percent * n[other])
                at, other = at[alike], other[alike]
                if not len(at):
                    break
                test = (label[at] != label[other]) & (node[at] != node[other])
                x, y, apart = _passing(at[test], other[test], n, bitmap, percent)
                nearer = apart < best[y]
                best[y[nearer]], partner[y[nearer]] = apart[nearer], x[nearer]
            if (found := np.flatnonzero(partner >= 0)).size:
                yield _pairs(node[partner[found]], node[found], best[found])

    block = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("total") / BLOCK))
    deal = F.when(F.col("total").isNull(), F.col("key")).otherwise(F.xxhash64("key", block))
    blocks = entries.join(crowded, "key", "left").select(deal.alias("deal"), "n", "node", "label").join(bitmaps, "node")
    return _dealt(blocks.select("deal", "n", "node", "label", "bitmap"), "n", "node").mapInArrow(nearest, "a long, b long, apart long")


def _propose_remaining(entries: DataFrame, crowded: DataFrame, bitmaps: DataFrame, percent: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, apart): of each key all pairs of sets of different components that size and bitmap let pass."""

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sets outside the key's largest component meet all sets of the key; those inside are linked already
        for key, n, node, label, bitmap in _groups(batches, 5):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if b - a < 2:
                    continue
                names, group = np.unique(label[a:b], return_inverse=True)
                if len(names) < 2:
                    continue
                count = np.bincount(group)
                order = np.argsort(-count, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                place = place[group]  # 0: the largest component
                for i in np.flatnonzero(place > 0).tolist():
                    other = np.flatnonzero((place < place[i]) & (100 * np.minimum(n[a:b], n[a + i]) >= percent * np.maximum(n[a:b], n[a + i]))) + a
                    x, y, apart = _passing(other, np.full(len(other), a + i), n, bitmap, percent)
                    if len(x):
                        yield _pairs(node[x], node[y], apart)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # side 1: sets outside the largest component; side 0: all sets, ``outside`` marking the same ones
        for deal, n, node, label, bitmap, side, outside in _groups(batches, 7):
            starts = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(deal)], strict=True):
                here = np.arange(a, b)
                every = here[side[here] == 0]
                for i in here[side[here] == 1].tolist():
                    alike = 100 * np.minimum(n[every], n[i]) >= percent * np.maximum(n[every], n[i])
                    # two sets outside meet in two cells, and are taken in one of them
                    other = every[alike & (label[every] != label[i]) & ((outside[every] == 0) | (node[every] < node[i]))]
                    x, y, apart = _passing(other, np.full(len(other), i), n, bitmap, percent)
                    if len(x):
                        yield _pairs(node[x], node[y], apart)

    pairs = "a long, b long, apart long"
    few = entries.join(crowded, "key", "left_anti").join(bitmaps, "node").select(F.col("key").alias("deal"), "n", "node", "label", "bitmap")
    proposed = _dealt(few, "n", "node").mapInArrow(remaining, pairs)
    if not crowded.limit(1).count():
        return proposed
    many = entries.join(crowded.select("key"), "key")
    parts = many.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"))
    blocks = lambda count: F.ceil(count / F.lit(BLOCK)).cast("int")
    grid = parts.where("all > most.c").select("key", F.col("most.label").alias("largest"), blocks(F.col("all")).alias("rows"), blocks(F.col("all") - F.col("most.c")).alias("columns"))
    grid = step(grid)
    many = many.join(grid, "key").withColumn("outside", (F.col("label") != F.col("largest")).cast("long"))
    spot = lambda salt, count: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
    through = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    every = many.withColumns({"row": spot(0, "rows"), "side": F.lit(0).cast("long")}).withColumn("column", through("columns"))
    outer = many.where("outside = 1").withColumns({"column": spot(1, "columns"), "side": F.lit(1).cast("long")}).withColumn("row", through("rows"))
    dealt = every.unionByName(outer).select(F.xxhash64("key", "row", "column").alias("deal"), "n", "node", "label", "side", "outside").join(bitmaps, "node")
    dealt = dealt.select("deal", "n", "node", "label", "bitmap", "side", "outside")
    return proposed.unionByName(_dealt(dealt).mapInArrow(cells, pairs))


def _pairs(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(apart.astype(np.int64))], names=["a", "b", "apart"])


def _fetch(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the given nodes, from the texts; a fixed-size filter keeps others from being written."""
    spark = docs.sparkSession
    slot = F.pmod(F.col("node"), F.lit(1 << FILTER_BITS))
    filled = nodes.select(slot.alias("slot")).selectExpr("cast(slot div 32 as int) as word", "shiftleft(1L, cast(slot % 32 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros((1 << FILTER_BITS) // 32, np.int64)
    for r in filled:  # at most one row for each word of the filter
        table[r.word] = r.bits
    handle = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = handle.value, set()
        for whole in batches:
            for batch in blocks(whole, "text"):
                node, tokens = [], []
                for s in token_sets(*buffers(batch.column(1)), k):
                    if len(s) < 2:
                        continue
                    mark = _set_hash(s)
                    at = mark[0] % (1 << FILTER_BITS)
                    if (int(table[at // 32]) >> (at % 32)) & 1 and mark not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(mark)
                        node.append(mark[0])
                        tokens.append(s.tobytes())
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return docs.mapInArrow(run, "node long, tokens binary").join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), U) for c in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, component, text_hash) for every row: the size of its set, the least key that links
    reach, a number that is the same for linked rows and for no others (null without words), and a hash of the text, by
    which rows that share a key are told apart.

    Words are what lies between x20 and x09-x0D, with A-Z lower-cased. A null or blank text has an empty set and its own
    key as component_id. Rows with equal sets are linked. Rows that repeat a key each get a result; a null key stays null
    and its row takes part as a text, so that its component_id is the least key among the others, or null. An empty table
    gives an empty result; other columns are not carried. The result is a stored table.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stored: list[DataFrame] = []

    def step(df: DataFrame) -> DataFrame:
        stored.append(persisted(df))
        return stored[-1]

    try:
        found = step(_summaries(rows, shingle))
        classes = step(found.where("n > 0").groupBy("node", "check", "n").agg(F.min("key").alias("least"), F.first("bitmap").alias("bitmap")))
        labels = _join_classes(rows, classes, shingle, percent, step)
        named = classes.select("node", "check", "n", "least", F.xxhash64("node", "check", "n").alias("component"))
        if labels is not None:
            grouped = classes.join(labels, "node").groupBy("label").agg(F.min("least").alias("lowest"))
            named = named.join(labels.join(grouped, "label").select("node", "lowest", "label"), "node", "left").withColumns({"least": F.coalesce("lowest", "least"), "component": F.when(F.col("label").isNotNull(), F.xxhash64("label")).otherwise(F.col("component"))})
        out = found.select("key", "text_hash", "node", "check", "n").join(named.select("node", "check", "n", "least", "component"), ["node", "check", "n"], "left")
        return persisted(out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"), "component", "text_hash"))
    finally:
        dropped(*stored)


def _join_classes(rows: DataFrame, classes: DataFrame, shingle: int, percent: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(node, label) of the sets that are linked with another, or None. ``step`` stores a table until the join's end."""
    postings = _postings(rows, shingle, percent)
    counts = persisted(_token_counts(postings))
    shared = persisted(_shared_tokens(postings, counts))
    dropped(counts)
    # length of the list, copies apart, that a posting at the end of a prefix stands in; tokens of one length count at once
    lists = shared.groupBy("token").agg(F.count("*").alias("c")).groupBy("c").agg((F.count("*") * F.col("c")).alias("postings"))
    scanned = lists.agg(F.expr(f"percentile(c, {(100 - percent) / 100}, postings)")).first()[0]
    if scanned is None:
        dropped(shared)
        return None
    entries = step(_keys(shared, boundary(float(scanned), percent), percent))
    dropped(shared)
    totals = step(entries.groupBy("key").agg(F.count("*").alias("total"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"))
    crowded = totals.where(f"total > {BLOCK}").select("key", "total")
    tokens = step(_fetch(rows, entries.join(totals.select("key"), "key", "left_semi").select("node").distinct(), shingle))
    bitmaps = classes.select("node", "bitmap").dropDuplicates(["node"])
    links = labels = checked = None
    for turn in range(NEAREST_ROUNDS + 1):
        every = turn == NEAREST_ROUNDS
        current = entries if every else entries.where(F.pmod("key", F.lit(KEY_SHARE)) == turn)
        if labels is None:
            current = current.withColumn("label", F.col("node"))
        else:
            current = current.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            open_keys = step(current.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
            current = current.join(open_keys, "key", "left_semi")
        if every:
            proposed = _propose_remaining(current, crowded, bitmaps, percent, step).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            nearest = _propose_nearest(current, crowded, bitmaps, percent, turn).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m"))
            proposed = nearest.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()
        if checked is not None:
            proposed = proposed.join(checked, ["a", "b"], "left_anti")
        proposed = step(proposed)
        checked = proposed if checked is None else checked.unionByName(proposed)
        new = step(_linked(proposed, tokens, percent))
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            components = connected_components(links)
            step_labels = components.select(F.col("id").alias("node"), "label")
            if labels is not None:
                dropped(held)
            held, labels = components, step_labels
    if labels is not None:
        labels = step(labels)
        dropped(held)
    return labels
