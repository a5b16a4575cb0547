"""The fuzzy pass over texts of many windows: Arrow batches, without a shuffle.

Every window is a run of the text's characters, so its SimHash votes are a difference of two running sums of the text's
n-gram hashes, and each window of each text is hashed. Phonetic codes are computed for all windows whose length allows
them; gram sets are compared where enough of a window's n-grams are the lexicon's. These tests leave out no match, and
what passes one is judged by ``first_match``, which states the pass for one window.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.patterns import SPACES
from palisade.operators.fuzzy import MATCH, _GramHashes, simhashes

#: Characters of text that are handled at once; temporaries are some hundred times as large.
BLOCK_CHARS = 1 << 17
#: Windows whose match is remembered.
_REMEMBERED = 1 << 18
_BLANK = re.compile(f"[{SPACES}]+")
_LETTERS = re.compile("[^A-Za-zıſ]")
_CODES = dict(zip("BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000", strict=True))
#: By code point: the phonetic class of a letter (7: no letter), and its number from A.
_CLASS, _NUMBER = np.full(0x180, 7, np.uint8), np.zeros(0x180, np.uint8)
for _c in [chr(i) for i in range(0x180) if not _LETTERS.match(chr(i))]:
    _CLASS[ord(_c)], _NUMBER[ord(_c)] = int(_CODES[_c.upper()]), ord(_c.upper()) - ord("A")


def soundex(text: str) -> str:
    """``text.soundex`` of one text."""
    letters = _LETTERS.sub("", text).upper()
    if not letters:
        return "Z000"
    digits = re.sub(r"([1-6])\1+", r"\1", "".join(map(_CODES.__getitem__, letters[1:]))).replace("0", "")
    return (letters[0] + digits + "000")[:4]


def _code_number(code: str) -> int:
    return (ord(code[0]) - ord("A")) * 343 + int(code[1:], 7)


def gram_set(text: str, n: int) -> frozenset[str]:
    """``text.char_ngrams`` of one text."""
    padded = f" {text} "
    return frozenset(padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))


def _numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers, from 0 without gaps; by hashing, which is cheaper than sorting."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


class Scan:
    """A lexicon's tables, and the search of texts for windows that match it."""

    def __init__(self, config: Config) -> None:
        self.config, self.n, self.seen, self.known = config, config.ngram, _GramHashes(), {}
        self.terms = [t for t in config.lexicon if t not in config.adult_assertions]
        self.sims = simhashes(self.terms, self.n, self.seen) if self.terms else np.zeros(0, np.int64)
        self.grams, self.codes = [gram_set(t, self.n) for t in self.terms], [soundex(t) for t in self.terms]
        self.members = frozenset().union(*self.grams)
        self.numbers = np.unique([_code_number(c) for c in self.codes])
        self.longest = max(map(len, self.terms), default=0) + 2
        self.need = min((-(-config.jaccard_percent * len(g) // 100) for g in self.grams), default=0)
        self.largest = max((100 * len(g) // max(1, config.jaccard_percent) for g in self.grams), default=0)

    def first_match(self, window: str, sim: int) -> dict | None:
        """The window's first matching term in term order."""
        if window in self.known:
            return self.known[window]
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[window] = found = self._judged(window, sim)
        return found

    def _judged(self, window: str, sim: int) -> dict | None:
        c, grams, code = self.config, gram_set(window, self.n), soundex(window)
        for term, other, its, its_code in zip(self.terms, self.sims.tolist(), self.grams, self.codes, strict=True):
            dist, both, either = ((sim ^ other) & ((1 << 64) - 1)).bit_count(), len(grams & its), len(grams | its)
            match = {"window": window, "match_type": "simhash", "term": term, "dist": None, "sim": None}
            if dist <= c.hamming_threshold:
                return match | {"dist": dist}
            if 100 * both >= c.jaccard_percent * either:
                return match | {"match_type": "jaccard", "sim": both / either}
            if abs(len(term) - len(window)) <= 2 and len(window) >= c.soundex_min_len and code == its_code:
                return match | {"match_type": "soundex"}
        return None

    def _named(self, chars: np.ndarray, text: str, at: np.ndarray, length: int) -> tuple[np.ndarray, list[str]]:
        """(a number for each run of ``length`` characters, the runs by number)."""
        name = np.zeros(len(at), np.int64)
        for j in range(length):
            if j > 2:  # three code points fit a number
                name = _numbered(name)
            name = name << 21 | chars[at + j]
        name = _numbered(name)
        first = np.empty(int(name.max(initial=-1)) + 1, np.int64)
        first[name[::-1]] = at[::-1]
        return name, [text[i : i + length] for i in first.tolist()]

    def _sims(self, chars: np.ndarray, text: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(SimHash of each window, numbers of the text's n-grams, whether such a number is one of the lexicon's)."""
        n = self.n
        sims = np.zeros(len(a), np.int64)
        for length in range(n):
            some = np.flatnonzero(b - a == length)
            if len(some):
                name, runs = self._named(chars, text, a[some], length)
                sims[some] = simhashes(runs, n, self.seen)[name]
        long = np.flatnonzero(b - a >= n)
        if not len(long):
            return sims, np.zeros(0, np.int64), np.zeros(0, bool)
        name, runs = self._named(chars, text, np.arange(len(chars) - n + 1), n)
        hashed = np.array([self.seen[g] for g in runs], np.uint64).view(np.uint8).reshape(-1, 8)
        votes = np.unpackbits(hashed, axis=1, bitorder="little")
        # counts of a byte are added eight at once: a window's fit, so that none carries into the next, whatever the sums do
        kind, lanes = (np.uint8, np.uint64) if self.config.window_chars < 256 else (np.int64, np.int64)
        votes = votes.astype(kind, copy=False).view(lanes)
        sums = np.zeros((len(name) + 1, votes.shape[1]), lanes)
        np.cumsum(votes[name], axis=0, dtype=lanes, out=sums[1:])
        for i in range(0, len(long), 1 << 15):
            x, y = a[long[i : i + (1 << 15)]], b[long[i : i + (1 << 15)]] - n + 1
            won = np.packbits((sums[y] - sums[x]).view(kind) > ((y - x) // 2).astype(kind)[:, None], axis=1, bitorder="little")
            sims[long[i : i + (1 << 15)]] = won.view(np.uint64).ravel().byteswap().view(np.int64)
        return sims, name, np.array([g in self.members for g in runs])

    def _sounding(self, chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a window's phonetic code is one of the lexicon's."""
        low = np.minimum(chars, 0x17F)  # that is the long s, which no other sign may pass for
        kinds = np.append(np.where(chars <= 0x17F, _CLASS[low], 7).astype(np.uint8), np.uint8(7))
        numbers = np.append(_NUMBER[low], np.uint8(0))
        size, weights = b - a, np.array([49, 7, 1, 0], np.int16)
        first, code = np.full(len(a), 25, np.int16), np.zeros(len(a), np.int16)
        begun, last, count = np.zeros(len(a), bool), np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
        for j in range(int(size.max(initial=0))):
            at = np.where(j < size, a + j, len(chars))
            kind = kinds[at]
            letter = kind < 7
            counts = letter & begun & (kind > 0) & (kind != last)
            code += np.where(counts, kind * weights[np.minimum(count, 3)], 0).astype(np.int16)
            count += counts
            last = np.where(letter & begun, kind, last)
            first = np.where(letter & ~begun, numbers[at], first)
            begun |= letter
        return np.isin(first.astype(np.int64) * 343 + code, self.numbers)

    def _alike(self, a: np.ndarray, b: np.ndarray, name: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Whether a window's gram set may be as similar to a term's as is asked for. The two n-grams at its ends, with
        blanks, aren't looked at and may be any."""
        if self.need <= 2:
            return np.ones(len(a), bool)
        out = np.zeros(len(a), bool)
        if not len(name):
            return out
        sums = np.concatenate([[0], np.cumsum(member[name])])
        stop = np.maximum(a, b - self.n + 1)
        some = np.flatnonzero((stop > a) & (sums[np.minimum(stop, len(name))] - sums[np.minimum(a, len(name))] + 2 >= self.need))
        for i in range(0, len(some), 1 << 14):
            part = some[i : i + (1 << 14)]
            width = np.arange(int((stop[part] - a[part]).max()))
            inside = width < (stop[part] - a[part])[:, None]
            own = np.sort(np.where(inside, name[np.minimum(a[part, None] + width, len(name) - 1)], -1), axis=1)
            fresh = own >= 0
            fresh[:, 1:] &= own[:, 1:] != own[:, :-1]
            distinct, common = fresh.sum(1), (fresh & member[own]).sum(1) + 2
            out[part] = (common >= self.need) & (100 * common >= self.config.jaccard_percent * distinct) & (distinct <= self.largest)
        return out

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """``fuzzy.second_pass`` of each text."""
        found: list[dict[str, dict]] = [{} for _ in texts]
        if not self.terms:
            return [[] for _ in texts]
        over = self.config.window_chars + 1  # of a token that is in no window only that much is kept
        texts = [" ".join(w[:over] for w in _BLANK.split(t)) for t in texts]
        text = " ".join(texts)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) + 1 for t in texts])
        blank = np.flatnonzero(chars == 32)
        start, end = np.append(0, blank + 1), np.append(blank, len(chars))
        row = np.searchsorted(np.cumsum(size), start, "right")
        a, b, of = [], [], []
        for k in range(self.config.window_tokens):
            x, y = start[: len(start) - k], end[k:]
            fits = np.flatnonzero((row[: len(start) - k] == row[k:]) & (y - x <= self.config.window_chars))
            a.append(x[fits])
            b.append(y[fits])
            of.append(row[fits])
        a, b, of = map(np.concatenate, (a, b, of))
        sims, name, member = self._sims(chars, text, a, b)
        hit = self._alike(a, b, name, member)
        for t in self.sims:
            hit |= np.bitwise_count(sims ^ t) <= self.config.hamming_threshold
        short = np.flatnonzero((b - a >= self.config.soundex_min_len) & (b - a <= self.longest))
        hit[short[self._sounding(chars, a[short], b[short])]] = True
        at = np.flatnonzero(hit)
        for i, x, y, sim in zip(of[at].tolist(), a[at].tolist(), b[at].tolist(), sims[at].tolist(), strict=True):
            if (match := self.first_match(text[x:y], sim)) is not None:
                found[i][match["window"]] = match
        return [[f[w] for w in sorted(f)] for f in found]


def _pieces(text: str, config: Config) -> list[str]:
    """Parts of a text of about BLOCK_CHARS characters each; every window is in one of them."""
    if len(text) <= BLOCK_CHARS:
        return [text]
    over = config.window_chars + 1
    words = [w[:over] for w in _BLANK.split(text)]
    step = BLOCK_CHARS // (over + 1) + 1
    return [" ".join(words[i : i + step + config.window_tokens - 1]) for i in range(0, len(words), step)]


def second_pass_scan(squashed: Column, config: Config = Config()) -> Column:
    """The rows of ``fuzzy.second_pass``; null for null."""
    kind = pa.list_(pa.struct([("window", pa.string()), ("match_type", pa.string()), ("term", pa.string()), ("dist", pa.int32()), ("sim", pa.float64())]))

    def run(column: pa.Array) -> pa.Array:
        scan, texts = _scan(config), column.to_pylist()
        out: list[dict[str, dict] | None] = [None if t is None else {} for t in texts]
        pieces = [(i, p) for i, t in enumerate(texts) if t is not None for p in _pieces(t, config)]
        at = 0
        while at < len(pieces):  # so many characters at a time
            end, size = at + 1, len(pieces[at][1])
            while end < len(pieces) and size + len(pieces[end][1]) <= BLOCK_CHARS:
                size += len(pieces[end][1])
                end += 1
            for (i, _), found in zip(pieces[at:end], scan.matches([p for _, p in pieces[at:end]]), strict=True):
                out[i] |= {m["window"]: m for m in found}
            at = end
        return pa.array([None if f is None else [f[w] for w in sorted(f)] for f in out], kind)

    return F.arrow_udf(run, f"array<{MATCH}>")(squashed)


_SCANS: list[tuple[Config, Scan]] = []


def _scan(config: Config) -> Scan:
    """The scan of a worker's latest configuration."""
    if not _SCANS or _SCANS[0][0] != config:
        _SCANS[:] = [(config, Scan(config))]
    return _SCANS[0][1]
