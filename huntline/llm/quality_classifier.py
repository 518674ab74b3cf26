"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of hashed features: its words,
the byte 3-grams inside its words (with word boundaries), and, for each window
of three words, whether the text had it before. Each kind is averaged by
itself and the kinds weigh the same. A softmax over two classes sits on top;
vectors and weights are trained together by stochastic gradient descent in
numpy, one document at a step, with a falling rate.

Training looks at `sample` labelled documents at most, the first by a seeded
hash of the key, so one task holds them all; scoring runs over every text.
Because the model is linear after training, a feature's vector and the output
weights fold into one number, and the model that scoring tasks carry has a
fixed size.

Defined results: null, empty and blank texts have no features and get the
prior of the training sample; labels that are null are not used, nor are keys
whose labels disagree; repeated rows are scored one by one; without any label
every score is 0.5; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved
from .text import SPACE, Words, mix64, pieces, split

BITS = 16
DIM = 16
SAMPLE = 6000
EPOCHS = 6
RATE = 0.1
#: A feature has a small share of its document, so its vector takes larger steps than the weights.
BOOST = 30
KINDS = 3
#: Bytes of text that training turns into features at once.
FIT_PIECE = 1 << 18
SIZE = 2 * (1 << BITS) + 2


def features(ws: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind (text number, feature) of each occurrence."""
    mask = np.uint64((1 << BITS) - 1)
    n_docs, word_doc, hashes = len(ws.first) - 1, ws.doc(), ws.hashes()
    words = word_doc, (mix64(hashes + np.uint64(1)) & mask).astype(np.int64)

    data = np.where(SPACE[ws.data], np.uint8(0x20), ws.data)
    byte_doc = np.zeros(len(data), np.int64)  # of the word at or before a byte
    if len(ws):
        byte_doc = np.searchsorted(ws.starts, np.arange(len(data)), side="right") - 1
        byte_doc = word_doc[np.maximum(byte_doc, 0)]
    if len(data) >= 3:
        inner = (data[1:-1] != 0x20) & (byte_doc[:-2] == byte_doc[2:])
        at = np.flatnonzero(inner)
        code = data[at].astype(np.uint64) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2].astype(np.uint64) << np.uint64(16)
        grams = byte_doc[at], (mix64(code) & mask).astype(np.int64) + (1 << BITS)
    else:
        grams = np.zeros(0, np.int64), np.zeros(0, np.int64)

    first = np.arange(len(ws))
    first = first[first + 3 <= np.repeat(ws.first[1:], ws.counts())]
    with np.errstate(over="ignore"):
        window = mix64(mix64(mix64(hashes[first]) + hashes[first + 1]) + hashes[first + 2]) if len(first) else hashes[:0]
        window = mix64(window ^ mix64(word_doc[first].astype(np.uint64) + np.uint64(77)))
    again = np.ones(len(first), np.int64)
    again[np.unique(window, return_index=True)[1]] = 0
    return [words, grams, (word_doc[first], again + 2 * (1 << BITS))] if n_docs else []


def _shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Per text its features and their shares of the average; None without words."""
    docs: list[list] = [[] for _ in range(len(texts))]
    for doc_of, feature in features(split(texts)):
        pairs, counts = np.unique(doc_of * SIZE + feature, return_counts=True)
        cuts = np.searchsorted(pairs // SIZE, np.arange(len(docs) + 1))
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                docs[d].append(((pairs[a:b] % SIZE).astype(np.int32), (counts[a:b] / counts[a:b].sum() / KINDS).astype(np.float32)))
    return [(np.concatenate([i for i, _ in d]), np.concatenate([c for _, c in d])) if d else None for d in docs]


def train(texts: pa.Array, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> np.ndarray:
    """The folded model: one number per feature, and the bias at the end."""
    if not len(labels):
        return np.zeros(SIZE + 1, np.float32)
    shares = [d for piece in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", FIT_PIECE) for d in _shares(piece.column("text"))]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (SIZE, dim)).astype(np.float32)
    w = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    b = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    ready = [(*d, int(y)) for d, y in zip(shares, labels, strict=True) if d]
    step, steps = 0, epochs * len(ready)
    for _ in range(epochs):
        for at in rng.permutation(len(ready)):
            ids, share, label = ready[at]
            lr = np.float32(rate * (1 - step / steps))
            h = share @ e[ids]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # gradient of the cross-entropy
            back = w @ p
            w -= lr * np.outer(h, p)
            e[ids] -= lr * np.outer(share, back) * np.float32(BOOST)
            step += 1
    return np.append(e @ (w[:, 1] - w[:, 0]), b[1] - b[0]).astype(np.float32)


def score(ws: Words, model: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each text."""
    n = len(ws.first) - 1
    z = np.full(n, float(model[-1]))
    for doc, feature in features(ws):
        total = np.bincount(doc, minlength=n)
        z += np.bincount(doc, weights=model[feature], minlength=n) / np.maximum(total, 1) / KINDS
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("label", pa.int32())])).sort_by([("label", "ascending"), ("text", "ascending")])
    model = train(table.column("text").combine_chunks(), np.asarray(table.column("label")))
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "label") -> np.ndarray:
    """Trains on at most `sample` labelled rows of labels (key, label) and returns the model (half a megabyte)."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    chosen = known.filter(F.col("label") == F.col("other")).orderBy(F.xxhash64(F.lit(11), "k"), "k").limit(sample).select("k", "label")
    # At most `sample` rows, so broadcasting is safe; a key with many rows of documents gives one example.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label")
    model = saved(rows.repartition(1).mapInArrow(_fit, "model binary"), "quality-model").first()
    return np.frombuffer(model[0], np.float32) if model else np.zeros(SIZE + 1, np.float32)


def scored(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score(split(batch.column("text")), model), pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("key").withColumn("score", F.lit(0.0)).schema).withColumnRenamed("key", key)
