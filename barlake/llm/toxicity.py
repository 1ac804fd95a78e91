"""Toxicity by a linear classifier on averaged subword embeddings.

A word is the bag of its character n-grams with word bounds, and of the whole word; each of these has a hashed embedding. A
passage (a stretch of `window` words, or the whole text) is the average of its embeddings and goes into a linear softmax of two classes. A
text's score is that of its most toxic passage, so that a few words count alike in short and in long texts. Embeddings
and softmax are trained jointly in numpy by Adam: each step picks a text's currently most toxic passage and learns from
its label. A misspelt word that was never seen shares most of its n-grams with the word that was.

With averages and a linear layer, a passage's log odds are the average of one number per n-gram (embedding times the
difference of the two classes' weights). Scoring gathers those numbers from a table and needs no embeddings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import discard, materialize
from barlake.llm.textbytes import WORD, Piece, lowered, pieces, range_hashes, text_of

BITS, SIZES, WINDOW = 18, (3, 4, 5, 6), 8
DIMENSIONS, STEPS, BATCH, RATE = 8, 600, 64, 0.05
#: The sample's bounds: documents, and bytes of their texts (fitting takes some 20 times these).
MAX_LABELLED, MAX_BYTES = 3_000, 24 << 20
TOXIC_AT = 0.7


@dataclass
class Grams:
    """N-grams of a piece in order of their word: bucket, word; words in order of their row."""

    buckets: np.ndarray
    word: np.ndarray
    first_word: np.ndarray  # of each row


def subwords(piece: Piece) -> Grams:
    piece = lowered(piece)
    rows, sizes = piece.rows, np.diff(piece.offsets)
    # one blank before each row and one at the end: every word has bounds
    data = np.full(len(piece.data) + rows + 1, 0x20, np.uint8)
    solid = WORD[piece.data]
    data[np.arange(len(piece.data)) + np.repeat(np.arange(1, rows + 1), sizes)] = np.where(solid, piece.data, 0x20)
    inside = data != 0x20
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    first_word = np.searchsorted(begins, np.concatenate([piece.offsets[:-1] + np.arange(rows) + 1, [len(data)]]))
    buckets, owners = [], []
    lengths = ends - begins
    for n in SIZES:  # positions from the blank before the word
        counts = np.maximum(lengths + 2 - n + 1, 0)
        at = np.repeat(begins - 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        h = np.full(len(at), 0x811C9DC5 + n, np.uint32)
        for j in range(n):
            h = (h ^ data[at + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        buckets.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32))
        owners.append(np.repeat(np.arange(len(begins)), counts))
    buckets.append((range_hashes(data, begins, ends) >> np.uint64(64 - BITS)).astype(np.int32))  # the word itself
    owners.append(np.arange(len(begins)))
    return Grams(np.concatenate(buckets), np.concatenate(owners), first_word)


def word_sums(grams: Grams, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: sum of the table over its n-grams, and their number."""
    n = int(grams.first_word[-1])
    return np.bincount(grams.word, table[grams.buckets], n), np.bincount(grams.word, minlength=n)


def window_bounds(first_word: np.ndarray, window: int | None = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of each passage: `window` words every half window; a shorter text is one passage, and so is every
    text if window is None."""
    counts = np.diff(first_word)
    window = window or max(int(counts.max(initial=1)), 1)
    stride = max(window // 2, 1)
    per_row = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - window) // stride)))
    row = np.repeat(np.arange(len(counts)), per_row)
    number = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = np.repeat(first_word[:-1], per_row) + number * stride
    return row, begin, np.minimum(begin + window, np.repeat(first_word[1:], per_row))


@dataclass
class Model:
    table: np.ndarray  # log odds of each n-gram bucket
    bias: float
    window: int | None = WINDOW

    def odds(self, piece: Piece) -> np.ndarray:
        """Log odds of each row; a text without words has those of an empty bag."""
        grams = subwords(piece)
        sums, counts = (np.concatenate([[0], np.cumsum(x)]) for x in word_sums(grams, self.table))
        row, begin, end = window_bounds(grams.first_word, self.window)
        average = (sums[end] - sums[begin]) / np.maximum(counts[end] - counts[begin], 1)
        out = np.full(piece.rows, -np.inf)
        np.maximum.at(out, row, average)
        return np.where(np.isinf(out), min(self.bias, 0.0), out + self.bias)


def fit(sample: list[tuple[str, int]], window: int | None = WINDOW) -> Model:
    """sample: (text, 1 if toxic else 0); passages of `window` words, or whole texts where it is None. Without both classes every score is the one class's (0.5 without rows)."""
    sample = sorted(s for s in sample if s[0])
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0), window)
    rng = np.random.default_rng(3)
    bags = []
    for piece in pieces(pa.array([t for t, _ in sample], pa.string()), 1):
        grams = subwords(piece)
        order = np.argsort(grams.word, kind="stable")
        bags.append((grams.buckets[order], np.concatenate([[0], np.cumsum(np.bincount(grams.word, minlength=int(grams.first_word[-1])))]), *window_bounds(grams.first_word, window)[1:]))
    size = 1 << BITS
    e = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    u = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    b = np.zeros(2, np.float32)
    m_e, v_e, last = np.zeros_like(e), np.zeros_like(e), np.zeros(size, np.int32)
    m_u, v_u, m_b, v_b = np.zeros_like(u), np.zeros_like(u), np.zeros_like(b), np.zeros_like(b)
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, STEPS + 1):
        picks = np.concatenate([rng.choice(toxic, BATCH // 2), rng.choice(clean, BATCH // 2)])
        flat = (e @ (u[1] - u[0])).astype(np.float64) if step % 10 == 1 else flat  # noqa: F821
        grams, owner, weight = [], [], []
        for k, i in enumerate(picks):
            buckets, starts, begin, end = bags[i]
            if not len(begin):
                continue
            upto = np.concatenate([[0.0], np.cumsum(flat[buckets])])
            average = (upto[starts[end]] - upto[starts[begin]]) / np.maximum(starts[end] - starts[begin], 1)
            best = int(np.argmax(average))
            own = buckets[starts[begin[best]] : starts[end[best]]]
            grams.append(own)
            owner.append(np.full(len(own), k))
            weight.append(np.full(len(own), 1 / max(len(own), 1), np.float32))
        ids, who, share = np.concatenate(grams), np.concatenate(owner), np.concatenate(weight)
        hidden = np.zeros((len(picks), DIMENSIONS), np.float32)
        np.add.at(hidden, who, e[ids] * share[:, None])
        logits = hidden @ u.T + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(picks)), y[picks].astype(int)] -= 1
        p /= len(picks)
        g_u, g_b, g_h = p.T @ hidden, p.sum(axis=0), p @ u
        rate = RATE * (1 - step / (STEPS + 1))
        for value, grad, m, v in ((u, g_u, m_u, v_u), (b, g_b, m_b, v_b)):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        touched, at = np.unique(ids, return_inverse=True)
        grad = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(grad, at, g_h[who] * share[:, None])
        last[touched] += 1
        age = last[touched][:, None]
        m_e[touched] += 0.1 * (grad - m_e[touched])
        v_e[touched] += 0.001 * (grad * grad - v_e[touched])
        e[touched] -= rate * (m_e[touched] / (1 - 0.9**age)) / (np.sqrt(v_e[touched] / (1 - 0.999**age)) + 1e-8)
    return Model((e @ (u[1] - u[0])).astype(np.float32), float(b[1] - b[0]), window)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, window: int | None = WINDOW) -> Model:
    """Fit on at most `max_labelled` labelled documents, half of them toxic if there are as many: those whose ids hash least. Their whole
    texts come to the driver, at most `max_bytes` together and half of that a class: a text that doesn't fit in what is left is passed over.

    Null ids and labels teach nothing, a null text is an empty one. An id counts once, however often it is labelled or stored: one whose
    labels disagree teaches nothing, and of several texts of an id that of the least digest is taken. So copies of rows, and their
    order, don't change the model. Other columns aren't read; empty tables give even scores."""
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col).cast("int") == 1).cast("int").alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("most")).where("__label = most").drop("most")
    half = max_labelled // 2
    chosen = known.where("__label = 1").orderBy(F.xxhash64("__id"), "__id").limit(half).unionByName(known.where("__label <> 1").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled - half))
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    one = slim.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min_by(text, F.sha2(text.cast("binary"), 256)).alias("text"))
    sample = materialize(one.withColumn("tag", F.monotonically_increasing_id()), "labelled")
    order = [F.xxhash64("__id"), F.sha2(F.col("text").cast("binary"), 256)]
    left, tags = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for tag, label, size in sample.orderBy(*order).select("tag", "__label", F.octet_length("text")).collect():  # max_labelled rows
        if size <= left[label]:
            left[label] -= size
            tags.append(tag)
    rows = sample.where(F.col("tag").isin(tags)).select("text", "__label").collect()  # max_labelled rows of max_bytes
    discard(sample)
    return fit([(r["text"], r["__label"]) for r in rows], window)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from TOXIC_AT up); columns of these names are replaced.

    Null and empty texts, and texts without words, are scored as an empty bag. Repeated rows get equal scores; an empty
    table gives no rows."""
    base = docs.drop("score", "predicted")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.concatenate([np.zeros(0), *(shared.value.odds(piece) for piece in pieces(text_of(batch, text_col)))])
            score = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= TOXIC_AT).astype(np.int32))], names=schema.names)

    return base.mapInArrow(run, schema)
