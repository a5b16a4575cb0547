"""Toxicity: noisy-channel deobfuscation, then a word model over the restored text.

Writers hide words by leetspeak, spacing and repetition. Each suspicious span becomes a lattice, at every place the
letters it may stand for with the channel's costs; the Viterbi path under a character trigram model of the corpus is the
restored text. A noisy-or over words and word beginnings, learned from labelled documents, scores what was read
together with what was restored: each is a cause of its own, so one sure word is enough. Plain words never pass the lattice, and a span met again is taken from a bounded cache.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import BYTE_VALUE, U, blocks, buffers, prefix_hash, row_of, span_hash, words
from palisade.llm.language_id import folded
from palisade.llm.sampling import held_out, per_class
from palisade.session import ship

#: Bounds of the labelled sample: documents of each label, and their length in characters.
TRAIN_DOCS, TRAIN_CHARS = 2500, 20_000
#: Features kept, the least number of documents that must hold one, and its least log-likelihood ratio: what chance
#: would give once among some thousands of features stays under it.
FEATURES, LEAST_DOCS, LEAST_GAIN = 4096, 3, 8.0
#: Features that are likelier by chance or company than as a cause are left out.
LEAST_CHANCE, SURE_ALONE, MOST_IMPURE = 0.5, 0.85, 0.01
#: Bytes of the words by which copies of a text, near ones too, are told.
FAMILY_WORD = 9
#: Word beginnings that count as features besides whole words, in bytes.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Slots in which features are counted while they are selected.
SLOT_BITS = 22
#: Spans held in the cache, and the length up to which a span is held.
CACHE, CACHED_CHARS = 100_000, 64

# The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "£": "l", "€": "e",
}
#: Costs, in nats, of the channel's steps: a sign for a letter, a letter doubled, a sign passed over, a word end put in.
COST_LEET, COST_DOUBLE, COST_SKIP, COST_BREAK = 0.5, 0.7, 15.0, 3.0
ALPHABET = " abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i for i, c in enumerate(ALPHABET)}
#: The letter model's codes: ALPHABET, and one for every other letter.
OTHER, CODES = len(ALPHABET), len(ALPHABET) + 1

_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes that go on with a character, and first bytes of letters of two and three bytes; xE2 leads signs.
_GOES_ON = np.zeros(256, bool)
_GOES_ON[128:192] = True
_LEADS = {2: np.zeros(256, bool), 3: np.zeros(256, bool)}
_LEADS[2][0xC3:0xE0] = True
_LEADS[3][[0xE0, 0xE1, *range(0xE3, 0xEE)]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".-_*~"]] = True
_EDGE_RUN = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}[.,;:!?]*$|^[^\w\s@$|+]+|[.,;:?!\"')\]}]+$")


@dataclass
class CharModel:
    """Trigram costs over ALPHABET and, as one sign, every other letter."""

    cost: np.ndarray = field(default_factory=lambda: np.full((CODES, CODES, CODES), math.log(CODES)))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "CharModel":
        """Trigrams backed off to bigrams and letters by linear interpolation."""
        tri = counts.reshape(CODES, CODES, CODES).astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + CODES)
        p2 = (bi + CODES * p1) / (bi.sum(axis=1, keepdims=True) + CODES)
        p3 = (tri + 10 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 10)
        return cls(-np.log(0.98 * p3 + 0.02 / CODES))

    def text_cost(self, word: str) -> float:
        a = b = 0
        total = 0.0
        for c in [*word, " "]:
            k = _CODE.get(c, OTHER)
            total += self.cost[a, b, k]
            a, b = b, k
        return total


def _slots(span: str) -> list[tuple[list[tuple[str, float]], bool]]:
    """The lattice of a span: at each place the outputs with their costs, and whether a word may end before it."""
    out, spaced, i = [], bool(re.search(r"(?:^|[\s.\-_*~])\S(?:[\s.\-_*~]+\S){3,}(?:$|[\s.\-_*~])", span)), 0
    while i < len(span):
        c = span[i]
        j = i + 1
        while j < len(span) and span[j] == c:
            j += 1
        if c.isspace() or c in ".-_*~":
            if not spaced and c.isspace():
                out.append(([(" ", 0.0)], False))
            i = j
            continue
        itself = c in _CODE or c not in LEET and unicodedata.category(c)[0] in "LM"  # marks belong to their letters
        letters = [(c, 0.0)] if itself else [(x, COST_LEET) for x in LEET.get(c, "")]
        twice = j - i == 2
        steps = [(x, k + (COST_DOUBLE if twice else 0.0)) for x, k in letters]
        if j - i > 1:
            steps += [(x * 2, k + (0.0 if twice else COST_DOUBLE)) for x, k in letters]
        if not itself:
            steps.append(("", COST_SKIP) if letters else ("", 0.0))
        out.append((steps, spaced))
        i = j
    return out


def restore_span(span: str, model: CharModel) -> str:
    """The most likely plain text of a lower-cased span: the lattice's shortest path under channel and letter costs."""
    cost = model.cost
    # a path's text is a chain of (text before, piece), so that a step costs the same in a long span
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for steps, may_break in _slots(span):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, text) in paths.items():
            for output, price in steps:
                for lead in ("", " ") if may_break and b and output else ("",):
                    x, y, c = a, b, total + price + (COST_BREAK if lead else 0.0)
                    for letter in lead + output:
                        k = _CODE.get(letter, OTHER)
                        c += cost[x, y, k]
                        x, y = y, k
                    if (x, y) not in new or c < new[x, y][0]:
                        new[x, y] = (c, (text, lead + output))
        paths = new or paths
    (a, b), (_, text) = min(paths.items(), key=lambda p: p[1][0] + cost[p[0][0], p[0][1], 0])
    pieces = []
    while text is not None:
        text, piece = text
        pieces.append(piece)
    return "".join(reversed(pieces)).strip()


def _suspicious(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the spans that may hide words: signs among letters, long runs, letters set apart."""
    starts, ends = words(data, offsets)
    if not len(starts):
        return []
    letter = _LETTER[data]

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    letters = within(letter & ~_GOES_ON[data])
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (data[2:] < 128)
    for size, leads in _LEADS.items():
        if len(data) >= 3 * size:
            same = np.zeros(len(data) - size + 1, np.int32)
            np.cumsum(data[size:] == data[:-size], out=same[1:])
            run[: len(data) - 3 * size + 1] |= (same[2 * size :] - same[: -2 * size] == 2 * size) & leads[data[: len(data) - 3 * size + 1]]
    signed = (within(_LEET_BYTE[data]) > 0) & (letters > 0)
    joined = np.zeros(len(data), bool)
    if len(data) > 2:
        joined[1:-1] = letter[:-2] & _JOINT[data[1:-1]] & letter[2:]
    apart = (within(joined) >= 3) & (within(joined) * 2 + 1 >= letters)
    odd = np.flatnonzero((signed | (within(run) > 0) | apart))
    rows = row_of(offsets, starts)
    found = [(int(rows[i]), int(starts[i]), int(ends[i])) for i in odd]
    single = (ends - starts == 1) & (_LETTER[data[starts]] | _LEET_BYTE[data[starts]])
    for i in np.flatnonzero((ends - starts > 1) & (ends - starts <= 4) & (within(~_GOES_ON[data]) == 1)).tolist():
        c = data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
        single[i] = c.isalpha() or c in LEET
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            while a < b:  # words apart in different rows are different spans
                c = a + int(np.searchsorted(rows[a:b], rows[a], "right"))
                if c - a >= 4:
                    found.append((int(rows[a]), int(starts[a]), int(ends[c - 1])))
                a = c
    return found


class Restorer:
    """Restores spans under one character model, with a bounded cache of short spans."""

    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def __call__(self, span: str) -> str:
        if len(span) > CACHED_CHARS:
            return self._restored(span)
        if span not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[span] = self._restored(span)
        return self.cache[span]

    def _restored(self, span: str) -> str:
        core = _EDGE_RUN.sub("", _EDGE_RUN.sub("", span.lower()))
        plain = all(c.isalpha() for c in core) and not re.search(r"(.)\1\1", core)
        return "" if plain or not core else restore_span(core, self.model)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[str], list[tuple[int, int]]]:
        """Row, restored text and byte range of every span that changed."""
        rows, out, where = [], [], []
        for row, a, b in _suspicious(data, offsets):
            if text := self(data[a:b].tobytes().decode("utf-8", "replace")):
                rows.append(row)
                out.append(text)
                where.append((a - int(offsets[row]), b - int(offsets[row])))
        return rows, out, where


def _word_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash) of every word and word beginning; a word is a run of letters, in lower case."""
    stream = folded(data)
    starts, ends = words(stream, offsets)
    if not len(starts):
        return
    h = prefix_hash(BYTE_VALUE[stream])
    rows = row_of(offsets, starts)
    yield rows, span_hash(h, starts, ends) ^ U(1)
    for n in BEGINNINGS:
        long = ends - starts >= n
        yield rows[long], span_hash(h, starts[long], starts[long] + n)


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    #: -log(1 - chance) of each feature.
    weights: np.ndarray
    base: float
    letters: CharModel
    _slot: np.ndarray | None = None

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are features, and their numbers."""
        if self._slot is None:
            order = np.argsort(self.hashes)
            self.hashes, self.weights = self.hashes[order], self.weights[order]
            self._slot = np.zeros(1 << 20, bool)
            self._slot[(self.hashes >> U(44)).astype(np.int64)] = True
        near = np.flatnonzero(self._slot[(hashes >> U(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[near])
        ok = at < len(self.hashes)
        near, at = near[ok], at[ok]
        same = self.hashes[at] == hashes[near]
        return near[same], at[same]

    def present(self, data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> np.ndarray:
        """Distinct (row, feature) pairs, as row * features + feature."""
        width, found = max(1, len(self.hashes)), []
        rows, texts, _ = restore.texts(data, offsets)
        more = buffers(pa.array(texts, pa.large_string()))
        for (d, o), names in (((data, offsets), None), (more, np.array(rows, np.int64))):
            for row, h in _word_features(d, o):
                near, at = self._places(h)
                row = row[near] if names is None else names[row[near]]
                found.append(row.astype(np.int64) * width + at)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def scores(self, data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> np.ndarray:
        pairs = self.present(data, offsets, restore)
        width = max(1, len(self.hashes))
        z = np.bincount(pairs // width, weights=self.weights[pairs % width] if len(self.weights) else None, minlength=len(offsets) - 1)
        return 1 - (1 - self.base) * np.exp(-z)


def _document_features(text: str, restore: Restorer) -> np.ndarray:
    """Distinct feature hashes of a text and of what is restored from it."""
    data, offsets = buffers(pa.array([text], pa.large_string()))
    _, restored, _ = restore.texts(data, offsets)
    found = [h for d, o in ((data, offsets), buffers(pa.array(restored, pa.large_string()))) for _, h in _word_features(d, o)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def _family(text: str) -> int:
    """The least hash among a text's long words, which copies share even after small edits; without one, the text's."""
    data, offsets = buffers(pa.array([text], pa.large_string()))
    stream = folded(data)
    starts, ends = words(stream, offsets)
    long = ends - starts >= FAMILY_WORD
    h = prefix_hash(BYTE_VALUE[stream])
    return int(span_hash(h, starts[long], ends[long]).min()) if long.any() else int(span_hash(h, offsets[:1], offsets[1:])[0])


def _gain(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of presence and class; 0 for what doesn't lean to the toxic side."""
    p1, p0, p = k1 / n1, k0 / n0, (k1 + k0) / (n1 + n0)

    def part(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(share / p)) + np.nan_to_num((n - k) * np.log((1 - share) / (1 - p)))

    return np.where((p1 > p0) & (k1 + k0 >= LEAST_DOCS), part(k1, n1, p1) + part(k0, n0, p0), 0.0)


def _select(texts: list[str], toxic: np.ndarray, restore: Restorer) -> np.ndarray:
    """Hashes of the features that lean most surely to the toxic side.

    Features are counted by slot first, in arrays of a fixed size; only those in promising slots are then held by hash.
    """
    shift, counts = U(64 - SLOT_BITS), np.zeros((2, 1 << SLOT_BITS), np.int32)
    for text, label in zip(texts, toxic, strict=True):
        counts[int(label), np.unique((_document_features(text, restore) >> shift).astype(np.int64))] += 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    held = np.flatnonzero(counts.sum(axis=0) >= LEAST_DOCS)
    gain = _gain(counts[1, held].astype(float), counts[0, held].astype(float), n1, n0)
    best = np.argsort(-gain, kind="stable")[: 2 * FEATURES]
    promising = np.zeros(1 << SLOT_BITS, bool)
    promising[held[best[gain[best] > LEAST_GAIN / 2]]] = True
    exact: dict[int, list[int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        found = _document_features(text, restore)
        for h in found[promising[(found >> shift).astype(np.int64)]].tolist():
            exact.setdefault(h, [0, 0])[int(label)] += 1
    hashes = np.array(sorted(exact), U)
    table = np.array([exact[h] for h in hashes.tolist()], float).reshape(-1, 2)
    gain = _gain(table[:, 1], table[:, 0], n1, n0)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    return hashes[best[gain[best] > LEAST_GAIN]]


def train(texts: list[str], toxic: list[int], letters: CharModel, *, prior: float | None = None) -> ToxicityModel:
    """Fit the word model on whole labelled texts; ``prior`` is the share of toxic rows where the sample is balanced.

    Copies would make every word of a toxic text look like a cause, so one text of each family is used. Features are
    taken strongest first. A feature's chance to be a cause is the lower end of the Wilson interval of its precision, on
    the toxic texts that no feature before it explains and on all others, with both classes weighted back to the prior:
    company of a toxic word, and a beginning that harmless words share with it, are thus no causes, unless so many
    families hold them, and hardly any other text, that chance is out of the question. The base score is that of texts without any feature.
    """
    seen: dict[tuple[int, bool], str] = {}
    for text, label in zip(texts, toxic, strict=True):
        seen.setdefault((_family(text), bool(label)), text)
    texts, y = list(seen.values()), np.array([label for _, label in seen], bool)
    share = float(y.mean()) if len(y) else 0.0
    prior = share if prior is None else prior
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(0, U), np.zeros(0), 0.98 if share else 0.02, letters)
    restore = Restorer(letters)
    model = ToxicityModel(_select(texts, y, restore), np.zeros(0), 0.0, letters)
    ranks = {h: i for i, h in enumerate(model.hashes.tolist())}
    model.weights = np.zeros(len(model.hashes))
    held = [model.present(*buffers(pa.array([t], pa.large_string())), restore) for t in texts]
    width = len(model.hashes)
    docs_of: list[list[int]] = [[] for _ in range(width)]
    for doc, found in enumerate(held):
        for f in found.tolist():
            docs_of[f].append(doc)
    explained, chances = np.zeros(len(texts), bool), np.zeros(width)

    def lowest(rows: np.ndarray) -> float:
        k1, k0 = np.count_nonzero(y[rows]) * (prior / share), np.count_nonzero(~y[rows]) * ((1 - prior) / (1 - share))
        n, z = max(k1 + k0, 1e-9), 1.64
        p = k1 / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    for f in sorted(range(width), key=lambda f: ranks[int(model.hashes[f])]):
        rows = np.array(docs_of[f], np.int64)
        low = lowest(rows[~(explained[rows] & y[rows])])
        whole = lowest(rows)
        if low >= LEAST_CHANCE or whole >= SURE_ALONE and np.count_nonzero(~y[rows]) <= MOST_IMPURE * len(rows):
            chances[f] = min(max(low, whole), 0.999)
            explained[rows] = True
    sure = chances > 0
    bare = np.array([not sure[found].any() for found in held])
    base = float(np.clip((bare & y).sum() * (prior / share) / max(1.0, (bare & y).sum() * (prior / share) + (bare & ~y).sum() * ((1 - prior) / (1 - share))), 0.001, 0.2))
    return ToxicityModel(model.hashes[sure], -np.log1p(-chances[sure]), base, letters)


def letter_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Trigram counts over the letter model's codes of all texts; CODES**3 sums, however large the table."""
    ship(docs.sparkSession)
    code = np.zeros(256, np.int32)
    code[97:123] = np.arange(1, OTHER)
    code[128:] = OTHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, np.int64)
        for whole in batches:
            for batch in blocks(whole, text):
                data, offsets = buffers(batch.column(0))
                c = code[folded(data)[~_GOES_ON[data]]]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CODES**3, np.int64)
    for r in rows:
        out[r.gram] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> ToxicityModel:
    """Letter model from all texts, word model from a bounded sample of labelled rows that are not held out.

    A document labelled more than once counts as toxic if any label says so; labels without a document and null labels
    are passed over.
    """
    letters = CharModel.of_counts(letter_counts(docs, text=text))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
    ids = per_class(known, "label", "key", train_docs)
    drawn = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text").between(1, train_chars))
    rows = drawn.join(F.broadcast(ids), "key").collect()  # as bounded as the sample
    rows.sort(key=lambda r: (r.key, r.text))
    return train([r.text for r in rows], [int(r.label > 0) for r in rows], letters, prior=share)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True, with_restored: bool = False) -> DataFrame:
    """Add score (0 to 1), predicted (1 from ``threshold`` on) and, on demand, restored: the spans read anew.

    A null or empty text has no feature and gets the model's base score. Whole texts are read. Columns of the input that
    are called like an added one are replaced; repeated rows stay repeated; an empty table gives an empty result.
    ``restored`` is an array of (start, end, text), places counted in UTF-8 bytes.
    """
    ship(docs.sparkSession)
    kept = docs.drop("score", "predicted", "restored")
    passed = [c for c in kept.columns if keep_text or c != text]
    handle = docs.sparkSession.sparkContext.broadcast(model)
    spans = "array<struct<start:long,end:long,text:string>>"
    columns = [F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *([F.lit(None).cast(spans).alias("restored")] if with_restored else [])]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        restore = Restorer(model.letters)
        for whole in batches:
            for batch in blocks(whole, text):
                at = batch.schema.get_field_index
                data, offsets = buffers(batch.column(at(text)))
                s = model.scores(data, offsets, restore)
                out = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                if with_restored:
                    found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                    for row, new, (a, b) in zip(*restore.texts(data, offsets), strict=True):
                        found[row].append({"start": a, "end": b, "text": new})
                    out.append(pa.array(found, span_type))
                yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in passed), *out], names=[*passed, "score", "predicted", *(["restored"] if with_restored else [])])

    return kept.mapInArrow(run, kept.select(*passed, *columns).schema)
