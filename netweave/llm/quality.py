"""Quality classifier: supervised subword embeddings.

Every text is a bag of hashed features, its words, word pairs and character n-grams, each with a learned vector; the
vectors are averaged and a softmax over the mean gives the label. Features are looked up by rolling hashes over the
bytes of whole texts, without a vocabulary. Training is plain numpy stochastic gradient descent on the driver, over
a sample of labelled rows whose size is a parameter. Their texts are taken whole, but what reaches the driver is the bag
of each, never larger than ``buckets`` numbers however long the text. As the mean and the output layer are both linear, scoring needs
one number a feature: the difference of the two logits it contributes; that table, of ``buckets`` floats, is what
the tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from netweave.llm.words import CHUNK_BYTES, mix, text_chunks, tidied, tidy, word_hashes

BUCKETS = 1 << 18
DIM = 8
#: Character n-grams of these lengths, over the raw bytes, so that case and punctuation count.
NGRAMS = (2, 3, 4)
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 2000

#: Empty features that every text has besides its own, so that a few words don't decide much.
PADDING = 16

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _feature_blocks(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers of one kind of feature in text order, and the bounds of each text's run."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    lengths = np.diff(offsets)
    n = len(data)
    if n:
        roll = _BYTE[data]
        for width in range(2, max(NGRAMS) + 1):
            # the hash of the last `width` bytes, by shifting the hash of one byte fewer
            roll = roll[:-1] * np.uint64(0x9FB21C651E98DF25) + _BYTE[data[width - 1 :]] if n >= width else roll[:0]
            if width not in NGRAMS:
                continue
            held = np.maximum(lengths - width + 1, 0)
            if held.sum() == len(roll):
                picked = roll
            else:  # leave out the n-grams that run from one text into the next
                inside = np.ones(len(roll), bool)
                for back in range(1, width):
                    cut = offsets[1:-1] - back
                    inside[cut[(cut >= 0) & (cut < len(roll))]] = False
                picked = roll[inside]
            bounds = np.concatenate([[0], np.cumsum(held)])
            yield ((picked + np.uint64(width)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32), bounds
    words, bounds = word_hashes(data, offsets)
    yield (words * np.uint64(0xA0761D6478BD642F) >> shift).astype(np.int32), bounds
    pairs = np.zeros(len(words), np.uint64)
    pairs[:-1] = words[:-1] * np.uint64(3) + words[1:] * np.uint64(5)
    pairs[:-1][words[:-1] == words[1:]] = 1  # a word said twice is one feature, whatever the word
    inside = np.ones(len(words), bool)
    inside[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
    held = np.maximum(np.diff(bounds) - 1, 0)
    yield (mix(pairs[inside]) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(held)])


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """The bucket numbers of each text."""
    blocks = list(_feature_blocks(data, offsets, buckets))
    return [np.concatenate([f[b[i] : b[i + 1]] for f, b in blocks]) for i in range(len(offsets) - 1)]


@dataclass(frozen=True)
class QualityModel:
    """``weights``: the logit difference of each bucket; ``bias``: what a text without features gets."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; null counts as empty."""
        out = np.zeros(len(texts))
        for first, data, offsets in text_chunks(texts, CHUNK_BYTES // 2):
            total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
            for feature, bounds in _feature_blocks(data, offsets, len(self.weights)):
                held = np.diff(bounds)
                some = held > 0
                if some.any():
                    total[some] += np.add.reduceat(self.weights[feature], bounds[:-1][some], dtype=np.float64)
                    count += held
            out[first : first + len(total)] = total / (count + PADDING)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def pack_bag(bucket: np.ndarray) -> bytes:
    """A text's bucket numbers as their different values and how often each occurs."""
    held, n = np.unique(bucket, return_counts=True)
    raw = np.diff(held, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes()
    return len(held).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def open_bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, and the share of the text's features, padding included, that each of them is."""
    n = int.from_bytes(raw[:4], "little")
    step, count = np.frombuffer(pa.decompress(raw[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), "<u4").reshape(2, n)
    return np.cumsum(step.astype(np.int32), dtype=np.int32), (count / (count.sum() + PADDING)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 5, rate: float = 0.4, seed: int = 11, buckets: int = BUCKETS) -> QualityModel:
    """Fit on the bags of the given rows; with one class or none, the bias alone says what there is."""
    y = np.asarray(labels, np.int64)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(buckets, np.float32), bias)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    off = np.array([0.0, bias], np.float32)
    # the rarer label weighs as much as the other, so that one half stays the dividing score
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            idx, share = bags[i]
            share_of = share[:, None]
            hidden = (emb[idx] * share_of).sum(0)
            logits = out @ hidden + off
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = p * np.float32(weight[y[i]] * rate * (1 - done / steps))
            back = out.T @ g
            out -= np.outer(g, hidden)
            off -= g * np.float32(0.05)
            # features of one text share its gradient in proportion to how often they occur
            emb[idx] -= share_of * back * np.float32(len(idx) ** 0.5)
            done += 1
    model = QualityModel((emb @ (out[1] - out[0])).astype(np.float32), float(off[1] - off[0]))
    del emb
    tidy()
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> QualityModel:
    """Train on ``labels.quality``, of rows whose crc32(id as text) mod 3 is not 1, which are held out.

    At most ``sample_rows`` rows are taken, half of each label, those with the smallest hash of the id, whole texts of
    any length. Null ids or labels, and ids whose labels disagree, teach nothing; a null text counts as empty; of rows
    that share an id those with the smallest hash of the text come first. Text is the only input. Without labels the
    model gives every text the same score.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))
        .groupBy(id_col).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select(F.col(id_col).alias("__id"), "y")
        .withColumn("__key", F.md5(F.col("__id").cast("string")))
    )
    half = [known.where(F.col("y") == y).orderBy("__key").limit(sample_rows // 2 * 2) for y in (0, 1)]
    wanted = half[0].unionByName(half[1])
    # at most twice the sample's ids, so small enough to be broadcast whatever the corpus
    found = docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(wanted), "__id").select("y", "__key", F.md5("text").alias("t"), "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column("text")):
                part = batch.slice(first, len(offsets) - 1)
                made = pa.array([pack_bag(f) for f in features(data, offsets)], pa.binary())
                yield pa.record_batch([*(part.column(c) for c in ("y", "__key", "t")), made], ["y", "__key", "t", "bag"])

    kind = labels.schema["quality"].dataType.simpleString()
    bags = found.mapInArrow(tidied(bag), f"y {kind}, __key string, t string, bag binary")
    best = [bags.where(F.col("y") == y).orderBy("__key", "t").limit(sample_rows // 2) for y in (0, 1)]
    rows = best[0].unionByName(best[1]).select("y", "bag").collect()
    return train([open_bag(bytes(r["bag"])) for r in rows], [r["y"] for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out, score, predicted`` (columns of these names are replaced); no shuffle.

    ``score`` is from 0 to 1, higher where label 1 is likelier; a null or empty text gets the score of a text
    without features. ``predicted`` is 1 from a score of one half on. A null id is not held out. Texts of any length are
    scored whole; repeated rows get the same score, an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    plain = docs.select(*kept).withColumn("held_out", held)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(batch.column("text"))
            made = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.record_batch([*batch.columns, *made], [*batch.schema.names, "score", "predicted"])

    return plain.mapInArrow(tidied(score), schema)
