"""Toxicity by averaged subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the vectors of its hashed character n-grams (3 to 5
characters of the word in marks) and of the word itself; a text is the mean of
its words; a linear softmax over two classes reads it. Vectors and softmax are
trained together in numpy with Adam. A misspelling that was never seen shares
most n-gram vectors with the word it hides.

The training sample is bounded: about SAMPLE rows of each label, chosen by a
hash of the id; class shares over all labelled rows correct the bias. One task
fits the sample's bags of n-grams; only the model, some 4 MB, reaches the
driver. As the softmax is linear, scoring
needs one number for each n-gram bucket; distinct words of a block are scored
once.

Defined results: null or blank texts score as the bias alone. Labels that are
null are left out; repeated labels of an id count once, the larger. Without
training rows of both classes every score is the share of label 1 (0 without
labels). Empty tables give empty results; other columns pass through, save one
named like the output, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folds, tokens

#: Labelled rows of each class that the model is fitted on, about.
SAMPLE = 1500
BUCKETS, DIM, STEPS, BATCH, RATE, SCALE = 1 << 17, 8, 600, 64, 0.02, 30.0
INIT, EPS = 1e-3, 3e-3
#: Words without any n-gram that are averaged in, so that a few words alone say little.
PSEUDO = 20
NGRAMS = (3, 4, 5)
#: Shares travel as half-precision numbers times this.
_HALF = 1024.0
BLOCK_BYTES = 2 << 20


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def bucket_scores(self) -> np.ndarray:
        """What a bucket adds to the log odds of label 1."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def subwords(vocabulary: tokens.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word its n-gram buckets: (word, bucket) in parallel arrays."""
    points, word = vocabulary.text(np.arange(len(vocabulary.hash)), "<", ">")
    parts = [(vocabulary.hash, np.arange(len(vocabulary.hash))), *(tokens.char_ngrams(points, word, n) for n in NGRAMS)]
    bucket = np.concatenate([h for h, _ in parts]) & tokens.U64(BUCKETS - 1)
    return np.concatenate([w for _, w in parts]), bucket.astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, "text", BLOCK_BYTES):
            words = tokens.cut(part.column("text"), lower=True)
            vocabulary = tokens.Vocabulary(words)
            word, bucket = subwords(vocabulary)
            order = np.argsort(word, kind="stable")
            word, bucket = word[order], bucket[order]
            edges = np.searchsorted(word, np.arange(len(vocabulary.hash) + 1))
            each = 1.0 / np.diff(edges)
            ids, shares = [], []
            for i in range(part.num_rows):
                own = vocabulary.of[words.first[i] : words.first[i + 1]]
                total = np.zeros(BUCKETS)
                some, times = np.unique(own, return_counts=True)
                if len(some):
                    size = edges[some + 1] - edges[some]
                    at = np.repeat(edges[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    total = np.bincount(bucket[at], np.repeat(times * each[some] / (len(own) + PSEUDO), size), BUCKETS)
                full = np.flatnonzero(total)
                ids.append(full.astype(np.uint32).tobytes())
                shares.append((total[full] * _HALF).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["label", "buckets", "shares"])


def fit(bags: list, counts: dict, seed: int = 7) -> Model:
    """bags: (label, buckets, shares) of each text; counts: labelled rows of each class in the whole table."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, INIT, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2))
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    labels = np.array([label for label, _, _ in bags], dtype=np.int64)
    here = np.bincount(labels, minlength=2)[:2]
    if not (n0 and n1 and here.all()):
        share = np.clip(n1 / (n0 + n1), 1e-6, 1 - 1e-6) if n0 + n1 else 1e-6
        return Model(np.zeros_like(model.vectors), np.zeros_like(model.weights), np.array([0.0, np.log(share / (1 - share))]))
    held = [(np.frombuffer(b, np.uint32), np.frombuffer(s, np.float16)) for _, b, s in bags]
    moments = [(np.zeros_like(p, dtype=np.float32), np.zeros_like(p, dtype=np.float32)) for p in (model.vectors, model.weights, model.bias)]
    order, batches = rng.permutation(len(bags)), []
    for low in range(0, len(bags), BATCH):
        some = order[low : low + BATCH]
        columns, place = np.unique(np.concatenate([held[j][0] for j in some]), return_inverse=True)
        row = np.repeat(np.arange(len(some), dtype=np.uint8), [len(held[j][0]) for j in some])
        batches.append((labels[some], columns, place.astype(np.int32), row, np.concatenate([held[j][1] for j in some])))
    del held
    bags.clear()
    pa.default_memory_pool().release_unused()
    even = (len(labels) / (2 * here)).astype(np.float32)
    step = 0
    while step < STEPS:
        rate = RATE * (1 - step / STEPS)
        for truth, columns, place, row, shares in [batches[i] for i in rng.permutation(len(batches))]:
            x = np.zeros((len(truth), len(columns)), np.float32)
            x[row, place] = shares.astype(np.float32) * np.float32(SCALE / _HALF)
            vectors = model.vectors[columns]
            h = x @ vectors
            logits = h @ model.weights + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(truth)), truth] -= 1
            p = (p * even[truth][:, None] / len(truth)).astype(np.float32)
            step += 1
            grads = ((columns, x.T @ (p @ model.weights.T)), (slice(None), h.T @ p), (slice(None), p.sum(0)))
            for param, (m, v), (at, g) in zip((model.vectors, model.weights, model.bias), moments, grads, strict=True):
                m[at] = now = 0.9 * m[at] + 0.1 * g
                v[at] = spread = 0.99 * v[at] + 0.01 * g * g
                param[at] -= rate * (now / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + EPS)
    model.vectors *= np.float32(SCALE)
    model.bias = model.bias + np.log([n0, n1])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on about sample rows of each class; labels: (id, label 0 or 1)."""
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    some, counts = folds.about(labels, "label", "doc_id", sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")  # some has about 2 * sample rows, whatever the tables' sizes
    bags = rows.select("label", "text").mapInArrow(_bags, "label int, buckets binary, shares binary").repartition(1)
    found = bags.mapInArrow(_fitted(counts), "vectors binary, weights binary, bias binary").first()
    if found is None:  # no task runs for an empty sample
        return fit([], counts)
    vectors, weights = (np.frombuffer(found[c], np.float32) for c in ("vectors", "weights"))
    return Model(vectors.reshape(BUCKETS, DIM), weights.reshape(DIM, 2), np.frombuffer(found["bias"], np.float64))


def _fitted(counts: dict):
    """Fits all bags of its task; these are a sample's, whose size doesn't grow with the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = []
        for batch in batches:
            bags += zip(*(batch.column(c).to_pylist() for c in ("label", "buckets", "shares")), strict=True)
        bags.sort(key=_order)
        model = fit(bags, counts)
        parts = model.vectors.astype(np.float32), model.weights.astype(np.float32), model.bias.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["vectors", "weights", "bias"])

    return run


def _order(bag: tuple) -> tuple:
    """An order of the sample that doesn't depend on how it was dealt out."""
    label, buckets, shares = bag
    return zlib.crc32(buckets), zlib.crc32(shares), label


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the probability of label 1 in out_col."""
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket, bias = shared.value
        for batch in batches:
            for part in tokens.slices(batch, text_col, BLOCK_BYTES):
                words = tokens.cut(part.column(text_col), lower=True)
                vocabulary = tokens.Vocabulary(words)
                word, bucket = subwords(vocabulary)
                n = len(vocabulary.hash)
                of_word = np.bincount(word, of_bucket[bucket], n) / np.maximum(1, np.bincount(word, minlength=n))
                odds = tokens.doc_sums(of_word[vocabulary.of], words) / (words.count + PSEUDO) + bias
                p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
