"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a text are counted on its bytes, many texts at once. Trees are grown in numpy on histograms of a
bounded sample of labelled documents (`max_labelled`, drawn by hash), with Newton leaf values. On features that have
a sign in MONOTONE the score may only rise (+1) or fall (-1) with the feature: a split that would order its sides the
other way isn't taken, and the middle of its two values bounds all that grows below. The trees are flattened into
arrays of feature, threshold, child and value, so that a batch of documents goes down all trees together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.textbytes import LEADS, NONSPACE, Piece, grams, mix, pieces, range_hashes, runs, text_of, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "punctuation_share", "distinct_share", "words_per_line"]
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1}
MAX_LABELLED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_SCORE = 50, 50, 0.5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_BANG = np.isin(np.arange(256), np.frombuffer(b"!", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:?'\"-()", np.uint8))


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: is its hash in its row twice or more; is it the first such."""
    keys = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        same[1:] = keys[order][1:] == keys[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    more, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    more[order] = twice
    first[order] = ~same
    return more, first


def statistics(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text of a piece, in the order of COUNTS and FEATURES."""
    data, offsets = piece.data, piece.offsets
    found = words(piece, NONSPACE)
    row, n = found.row, found.counts
    solid = NONSPACE[data]
    chars = _by_row(solid & LEADS[data], offsets)
    symbols = _by_row(_SYMBOL[data], offsets)
    covered = np.zeros(len(row), bool)
    three = grams(found.hashes, 3)
    inside = row[: len(three)] == row[2:] if len(three) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[_repeats(three[at], row[at])[0]]
    for j in range(3):
        covered[again + j] = True
    repeated = np.bincount(row[covered], minlength=piece.rows)
    distinct = np.bincount(row[_repeats(found.hashes, row)[1]], minlength=piece.rows)
    starts, ends = runs(data != 10, offsets)
    line_row = np.searchsorted(offsets, starts, "right") - 1
    upto = np.concatenate([[0], np.cumsum(solid)])
    with_word = upto[ends] > upto[starts]
    starts, ends, line_row = starts[with_word], ends[with_word], line_row[with_word]
    first_lines = _repeats(range_hashes(data, starts, ends), line_row)[1]
    lines = np.bincount(line_row, minlength=piece.rows)
    dup_lines = lines - np.bincount(line_row[first_lines], minlength=piece.rows)
    counts = np.column_stack([n, chars, symbols, dup_lines, repeated]).astype(np.int64)
    some, letters = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.column_stack([
        np.log1p(n), chars / some, symbols / some, dup_lines / np.maximum(lines, 1), repeated / some,
        _by_row(_UPPER[data], offsets) / letters, _by_row(_BANG[data], offsets) / some, _by_row(_DIGIT[data], offsets) / letters,
        _by_row(_MARK[data], offsets) / some, distinct / some, n / np.maximum(lines, 1),
    ])
    return counts, features


@dataclass
class Trees:
    """Flattened trees; node i goes left where its feature is at most its threshold, leaves point to themselves."""

    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    base: float = 0.0
    depth: int = 0

    def leaf(self, value: float) -> int:
        i = len(self.value)
        for array, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, i), (self.right, i), (self.value, value)):
            array.append(x)
        return i

    def flat(self) -> Trees:
        return Trees(*(np.array(x) for x in (self.roots, self.feature, self.threshold, self.left, self.right, self.value)), self.base, self.depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.tile(np.asarray(self.roots), (len(x), 1))
        at = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0, monotone: list[int] | None = None) -> Trees:
    """Boost logistic loss. With one class only, or no rows, the score is that class's (or keeps all)."""
    made = Trees(depth=depth)
    share = float(y.mean()) if len(y) else 1.0
    made.base = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -8, 8))
    if not len(y) or share in (0.0, 1.0):
        return made.flat()
    signs = monotone or [0] * x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    raw = np.full(len(y), made.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        out = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            total_g, total_h = g[rows].sum(), h[rows].sum()  # noqa: B023
            own = float(np.clip(-total_g / (total_h + l2), low, high))
            best: tuple = (1e-6, None)
            if level < depth:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    sum_g = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]  # noqa: B023
                    sum_h = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]  # noqa: B023
                    rest_g, rest_h = total_g - sum_g, total_h - sum_h
                    gain = sum_g**2 / (sum_h + l2) + rest_g**2 / (rest_h + l2) - total_g**2 / (total_h + l2)
                    one, two = np.clip(-sum_g / (sum_h + l2), low, high), np.clip(-rest_g / (rest_h + l2), low, high)
                    gain[(sum_h < least) | (rest_h < least) | (signs[j] * (two - one) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(one[k]), float(two[k]))
            i = made.leaf(rate * own)
            if best[1] is None:
                out[rows] = rate * own  # noqa: B023
                return i
            _, j, k, one, two = best
            middle = (one + two) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            goes = binned[rows, j] <= k
            made.feature[i], made.threshold[i] = j, float(cuts[j][k])
            made.left[i] = grow(rows[goes], level + 1, *bounds[0])
            made.right[i] = grow(rows[~goes], level + 1, *bounds[1])
            return i

        made.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        raw += out
    return made.flat()


_COUNT_FIELDS = [T.StructField(n, T.LongType()) for n in COUNTS]
STATISTICS = T.StructType([*_COUNT_FIELDS, *(T.StructField(n, T.DoubleType()) for n in FEATURES)])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees that score quality, from at most `max_labelled` labelled documents: those whose ids have the least hashes.

    Null ids and labels teach nothing, a null text is an empty one. An id counts once, however often it is labelled or stored: one whose
    labels disagree teaches nothing, and of several texts of an id that of the least digest is taken. So copies of rows, and their
    order, don't change the trees. Other columns aren't read; without rows, or with labels of one class only, the trees
    score that class's share, or 1."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("most")).where("__label = most").drop("most")
    sample = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))  # bounded by max_labelled
    schema = T.StructType([T.StructField("label", T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [statistics(piece)[1] for piece in pieces(text_of(batch))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.concatenate(parts).T)], names=schema.names)

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    one = slim.join(sample, "__id").groupBy("__id", "__label").agg(F.min_by(text, F.sha2(text.cast("binary"), 256)).alias("text"))
    rows = one.select("__label", "text").mapInArrow(run, schema).toPandas().sort_values(schema.names)  # max_labelled rows
    return fit(rows[FEATURES].to_numpy(), rows["label"].to_numpy(), monotone=[MONOTONE.get(n, 0) for n in FEATURES])


def judged(docs: DataFrame, trees: Trees, *, text_col: str = "text") -> DataFrame:
    """docs with the counts of COUNTS, `base_failed`, `quality_score` (0 to 1) and `kept`; columns of these names are replaced.

    A text with under MIN_WORDS words, or with over MAX_REPEAT_PERCENT percent of its words in repeated 3-word windows, fails the base rules; of
    the rest those are kept that score KEEP_SCORE or more. A null or empty text has no words and fails. Repeated rows are
    each judged; an empty table gives no rows."""
    added = [*_COUNT_FIELDS, T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    base = docs.drop(*(f.name for f in added))
    schema = T.StructType([*base.schema.fields, *added])
    model = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(piece) for piece in pieces(text_of(batch, text_col))]
            counts = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(COUNTS)), np.int64)
            features = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, len(FEATURES)))
            score = model.value.score(features)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_SCORE))], names=schema.names)

    return base.mapInArrow(run, schema)
