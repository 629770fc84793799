"""Language identification with string kernels.

The kernel of two texts is the blended spectrum over byte n-grams of ``ORDERS``: per order
the number of n-grams present in both, over the root of the product of the numbers present
in each, averaged over the orders. It compares windows of at most ``WINDOW`` bytes, into
which a text is cut evenly, and a text's kernel is the mean of its windows', so that
presence says as much of a long text as of a short one. N-grams are hashed into ``SLOTS``
slots an order, of which no window can fill more than it has bytes. The feature map of a
text is its kernel with ``LANDMARKS`` landmark windows, whitened by the landmarks' own
kernel (Nyström); one-versus-rest kernel ridge regression is a linear ridge in that space.
Scoring multiplies a batch's presence matrix with the landmarks' and the result with the
weights.

The model is fitted on a bounded sample: the ``PER_LANGUAGE`` labelled training rows of
each language that come first by a hash of their ids; more than ``MAX_LANGUAGES``
languages are an error, so sample and model have a fixed size whatever the corpus. Every text is scored
whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; without a
labelled training row every text is; repeated rows get equal results; ties go to the
language first in code point order; an empty table gives an empty table; other columns are
carried along and one named like an added one is replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table
from tidemark.llm.perfect_hash import mix64

ORDERS = (1, 2, 3, 4)
SLOTS = 4096
WINDOW = 3072
LANDMARKS = 160
PER_LANGUAGE = 400
MAX_LANGUAGES = 200
#: Characters of sample text that the driver holds at most, shared evenly by the languages (whole texts only;
#: a language without a text that fits takes its shortest sampled one).
SAMPLE_CHARS = 16_000_000
RIDGE = 1e-2
UNKNOWN = "und"
#: Windows whose presence is held at a time.
_ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")
_SALT = mix64(np.arange(101, 101 + 8, dtype=np.uint64))


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  #: packed presence bits of the landmarks
    scales: np.ndarray  #: per landmark and order, one over the root of the n-grams present
    weights: np.ndarray  #: landmarks x languages


def windows(text: str) -> list[bytes]:
    """A text's letters in lower case, all else one space, as UTF-8 in even windows, which share the bytes of an n-gram at a cut."""
    data = b" %b " % re.sub(r"[\W\d_]+", " ", text).lower().encode("utf-8", "surrogatepass").strip()
    parts = -(-len(data) // WINDOW)
    cuts = [len(data) * k // parts for k in range(parts + 1)]
    return [data[max(0, a - max(ORDERS) + 1) : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def presence(rows: list[bytes]) -> np.ndarray:
    """Which hashed n-grams each window has: windows x (orders x slots), 0 or 1."""
    out = np.zeros((len(rows), len(ORDERS) * SLOTS), np.float32)
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    code = np.zeros(len(data), np.uint64)
    for k, n in enumerate(ORDERS):
        # bytes i .. i+n-1 as one number; stretches that leave the window are dropped
        code = data.copy() if n == 1 else (code[:-1] << np.uint64(8)) | data[n - 1 :]
        inside = row[: len(code)] == row[n - 1 :]
        slot = code if n == 1 else (code * np.uint64(0x9E3779B97F4A7C15) + _SALT[k]) >> np.uint64(64 - SLOTS.bit_length() + 1)
        out[row[: len(code)][inside], k * SLOTS + slot[inside].astype(np.int64)] = 1
    return out


def _scales(present: np.ndarray) -> np.ndarray:
    counts = present.reshape(len(present), len(ORDERS), SLOTS).sum(axis=2)
    return 1 / np.sqrt(np.maximum(counts, 1))


def kernel(present: np.ndarray, landmarks: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Kernel values of texts with landmarks."""
    own, total = _scales(present), np.zeros((len(present), len(landmarks)), np.float32)
    for k in range(len(ORDERS)):
        block = slice(k * SLOTS, (k + 1) * SLOTS)
        total += (present[:, block] @ landmarks[:, block].T) * own[:, k : k + 1] * scales[:, k]
    return total / len(ORDERS)


def text_kernel(texts: list[str], landmarks: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Kernel values of whole texts with landmarks: the means of their windows'."""
    total, count = np.zeros((len(texts), len(landmarks)), np.float32), np.zeros(len(texts), np.float32)
    held: list[bytes] = []
    owner: list[int] = []

    def add() -> None:
        np.add.at(total, owner, kernel(presence(held), landmarks, scales))
        np.add.at(count, owner, 1)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for window in windows(text):
            held.append(window)
            owner.append(i)
            if len(held) == _ROWS:
                add()
    if held:
        add()
    return total / count[:, None]


def fit(texts: list[str], languages: list[str]) -> Model:
    """Kernel ridge regression on labelled texts, with landmarks spread over the languages."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    nth = np.zeros(len(label), np.int64)
    for k in range(len(names)):
        nth[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, nth))[:LANDMARKS]
    present = presence([(w := windows(texts[i]))[len(w) // 2] for i in chosen])
    scales = _scales(present)
    own = kernel(present, present, scales).astype(np.float64)
    features = text_kernel(texts, present, scales).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > values.max() * 1e-6
    white = vectors[:, good] / np.sqrt(values[good])
    mapped = features @ white
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = (1 / np.bincount(label))[label] * len(label) / len(names)
    gram = (mapped * balance[:, None]).T @ mapped + RIDGE * len(label) * np.eye(mapped.shape[1]) * 0.01
    weights = white @ np.linalg.solve(gram, (mapped * balance[:, None]).T @ target)
    return Model(names, np.packbits(present.astype(np.uint8), axis=1), scales, weights.astype(np.float32))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.landmarks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        worded = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.model.languages:
            return names, scores
        if worded:
            values = text_kernel([texts[i] for i in worded], self.landmarks, self.model.scales) @ self.model.weights
            best = values.argmax(axis=1)
            for i, k, v in zip(worded, best.tolist(), values[np.arange(len(worded)), best].tolist(), strict=True):
                names[i], scores[i] = self.model.languages[k], min(1.0, max(0.0, (v + 1) / 2))
        return names, scores


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of the sample; only its ids are ranked, its texts are fetched after."""
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    found = ids.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    # at most MAX_LANGUAGES * PER_LANGUAGE ids: a proven bound for this broadcast
    picked = labelled.join(F.broadcast(chosen.select("doc_id", "lang", "draw", "nth")), ["doc_id", "lang"])
    held, shortest, texts, languages = {}, {}, [], []
    for row in picked.select("lang", "text", "nth", "doc_id").orderBy("lang", "nth", "doc_id").toLocalIterator():
        size = held.get(row.lang, 0) + len(row.text)
        if size <= SAMPLE_CHARS // found:
            held[row.lang] = size
            texts.append(row.text)
            languages.append(row.lang)
        elif row.lang not in shortest or len(row.text) < len(shortest[row.lang]):
            shortest[row.lang] = row.text
    for lang in sorted(shortest.keys() - held.keys()):
        texts.append(shortest[lang])
        languages.append(lang)
    return texts, languages


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on ``doc_id, text, lang``; rows without label, text or letter are left out."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts, languages = training_sample(usable, per_language)
    good = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    if not good:
        empty = np.zeros((0, len(ORDERS) * SLOTS // 8), np.uint8)
        return Model([], empty, np.zeros((0, len(ORDERS))), np.zeros((0, 0), np.float32))
    return fit([texts[i] for i in good], [languages[i] for i in good])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``. The model's size is bounded by the landmarks."""
    added = {"lang_pred": "string", "score": "double"}
    kept = [c for c in df.columns if c not in added]
    made: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(model))
        names, scores = made[0].predict(batch.column(text).to_pylist())
        columns = {c: batch.column(c) for c in kept}
        return pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in added.items())])
    return map_arrow(df, run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
