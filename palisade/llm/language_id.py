"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in NumPy.

A text is its stream of case-folded letters with every run of other bytes read as a space. The byte n-grams of that
stream are hashed to embedding rows; their mean goes through a linear layer. As mean and layer are both linear, each
row's logits are multiplied out once after training, and a text then costs one gather for each n-gram and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrow_text import U, blocks, buffers, mix
from palisade.llm.sampling import held_out, per_class
from palisade.session import ship

#: Fixed settings of the production model.
BITS, DIM, GRAMS = 16, 16, (2, 3, 4)
#: Labelled documents drawn for each language at most, and the longest that are drawn, in characters.
TRAIN_DOCS, TRAIN_CHARS = 800, 20_000
#: Share of validation documents whose confidence may lie below the rejection threshold (before the margin).
REJECT_SHARE, REJECT_MARGIN = 0.0005, 0.6
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z and U+00C0-U+00DE), all other ASCII bytes as spaces."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def _gram_buckets(stream: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at every place, and whether it counts (within a row, not only spaces)."""
    n = len(stream)
    values = _VALUES[stream]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    h = values.copy()
    for size in range(2, max(GRAMS) + 1):
        if n < size:
            return
        h = h[: n - size + 1] * U(0x9E3779B97F4A7C15) + values[size - 1 :]
        if size in GRAMS:
            yield (mix(h + U(size)) >> U(64 - bits)).astype(np.int32), (left[: n - size + 1] >= size) & ~((stream[: n - size + 1] == 32) & (stream[1 : n - size + 2] == 32))


@dataclass
class LanguageModel:
    langs: list[str]
    #: A row of logits for each bucket, and the bias; float32.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    bits: int = BITS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.langs))), np.zeros(rows)
        stream = folded(data)
        for bucket, ok in _gram_buckets(stream, offsets, self.bits):
            bucket = np.where(ok, bucket, len(self.table) - 1)
            pad = np.full(len(data) - len(bucket) + 1, len(self.table) - 1, np.int32)
            bucket = np.concatenate([bucket, pad])
            filled = np.flatnonzero(np.diff(offsets) > 0)
            for k in range(len(self.langs)):
                total[filled, k] += np.add.reduceat(self.table[:, k][bucket], offsets[:-1][filled], dtype=np.float32)[: len(filled)]
            count[filled] += np.add.reduceat(np.concatenate([ok, np.zeros(len(pad), bool)]), offsets[:-1][filled], dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.logits(data, offsets) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(texts, pa.large_string()))


def _features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets of its n-grams and their shares."""
    out = []
    for text in texts:
        data, offsets = _flat([text])
        found = [bucket[ok] for bucket, ok in _gram_buckets(folded(data), offsets, bits)]
        ids, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int32)]), return_counts=True)
        out.append((ids.astype(np.uint32 if bits > 16 else np.uint16), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], *, dim: int = DIM, bits: int = BITS, epochs: int = 6, rate: float = 0.6, seed: int = 7, reject_share: float = REJECT_SHARE) -> LanguageModel:
    """Fit on labelled texts. A fifth is kept for the temperature and the rejection threshold."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if not langs:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(texts))
    cut = len(texts) // 5 if len(texts) >= 50 else 0
    checked, used = order[:cut], order[cut:]
    features = _features([texts[i] for i in used], bits)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((len(langs), dim), np.float32), np.zeros(len(langs), np.float32)
    step, steps = 0, max(1, epochs * len(used))
    for _ in range(epochs):
        for k in rng.permutation(len(used)):
            ids, share = features[k]
            step += 1
            if not len(ids):
                continue
            rows = table[ids]
            mean = share @ rows
            z = layer @ mean + bias
            z = np.exp(z - z.max())
            slope = z / z.sum()
            slope[y[used[k]]] -= 1
            slope *= rate * (1 - step / (steps + 1))
            table[ids] = rows - share[:, None] * (slope @ layer) * len(ids) ** 0.5
            layer -= np.outer(slope, mean)
            bias -= 0.02 * slope
    logits = np.vstack([table @ layer.T, np.zeros((1, len(langs)), np.float32)]).astype(np.float32)
    model = LanguageModel(langs, logits, bias, bits=bits)
    if cut:
        data, offsets = _flat([texts[i] for i in checked])
        raw, truth = model.logits(data, offsets), y[checked]

        def loss(t: float) -> float:
            x = raw / t
            x = x - x.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(cut), truth]))

        model.temperature = min(np.geomspace(0.25, 20, 60), key=loss)
        model.threshold = float(np.quantile(model.probabilities(data, offsets).max(axis=1), reject_share)) * REJECT_MARGIN
        model.threshold = min(model.threshold, REJECT_MARGIN)
    return model


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> LanguageModel:
    """Train on a bounded sample of the rows that have a language and are not held out (see ``sampling.held_out``)."""
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    labelled = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    labelled = labelled.where(F.length("text").between(1, train_chars))
    rows = per_class(labelled, "lang", "key", train_docs).collect()
    rows.sort(key=lambda r: (r.key is None, r.key, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score (calibrated confidence, 0 to 1) and rejected.

    A null text, one without any letter, and every text where no language was learned is ``und`` with score 0 and is
    rejected; else a row is rejected when its confidence lies under the model's threshold. Whole texts are read, however
    long. Columns of the input that are called like an added one are replaced; repeated rows stay repeated. Without
    ``keep_text`` the text is read in the Python workers but not sent back.
    """
    ship(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected", "_letters").withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    passed = [c for c in kept.columns if keep_text or c != text]
    schema = kept.select(*passed, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for whole in batches:
            for batch in blocks(whole, text):
                at = batch.schema.get_field_index
                letters = batch.column(at("_letters")).to_numpy(zero_copy_only=False)
                if model.langs:
                    p = model.probabilities(*buffers(batch.column(at(text))))
                    best = p.argmax(axis=1)
                    score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                    names = np.where(letters, np.array(model.langs, object)[best], UNKNOWN)
                    rejected = ~letters | (score < model.threshold)
                else:
                    score, names, rejected = np.zeros(len(letters)), np.full(len(letters), UNKNOWN, object), np.ones(len(letters), bool)
                yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in passed), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=[*passed, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema).drop("_letters")
