"""Language identification by hierarchical discrimination.

First the family is predicted, then one-versus-one linear support vector machines decide between the languages of that
family; families too are told apart one against one. All machines work on the same features: relative frequencies of
hashed byte 1- to 4-grams of the lower-cased letters, each scaled by the square root of its frequency in the sample.
A linear machine's margin is then a sum of one weight per n-gram of the text, gathered from a table, so a text is
scored without building its feature vector.

The sample is bounded: at most `per_language` documents of each language, those whose hashes are least, with short
snippets of the same texts so that short texts are met in training. Between families at most `PER_FAMILY` times as many
of each family count, evenly from its languages. Features are sparse rows in a table, and each machine is fitted in a task
of its own by dual coordinate descent, so the driver holds the finished machines only: 64 kB each, at most MAX_MACHINES.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import materialize
from barlake.llm.textbytes import Piece, lowered, pieces, text_of

#: Language codes by family; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "hi", "mr", "ne", "pa", "ur"],
}
BITS, ORDERS = 14, (1, 2, 3, 4)
PER_LANGUAGE, PER_FAMILY, SNIPPETS = 400, 2, (30, 120)
MAX_MACHINES = 2000
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def family_of(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes), language)


def gram_ids(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-grams at each byte, and whether there is one (inside a row, not of blanks only)."""
    letters = _LETTER[piece.data]
    data = np.where(letters, piece.data, 0x20).astype(np.uint32)
    row_end = np.repeat(piece.offsets[1:], np.diff(piece.offsets))
    at = np.arange(len(data))
    packed, some = np.zeros(len(data), np.uint32), np.zeros(len(data), bool)
    for n in ORDERS:
        shifted = np.zeros(len(data), np.uint32)
        shifted[: len(data) - n + 1] = data[n - 1 :]
        packed = packed | (shifted << np.uint32(8 * (n - 1)))
        some = some.copy()
        some[: len(data) - n + 1] |= letters[n - 1 :]
        mixed = (packed ^ np.uint32(0x51ED270B * n & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), some & (at + n <= row_end)


@dataclass
class Machine:
    """Decides between two names: the first where the margin is positive."""

    first: str
    second: str
    bias: float
    slope: float


@dataclass
class Model:
    weights: np.ndarray  # machine by n-gram bucket
    families: list[Machine]
    within: dict[str, list[Machine]]
    members: dict[str, list[str]]

    @property
    def machines(self) -> list[Machine]:
        return [*self.families, *(m for ms in self.within.values() for m in ms)]

    def predict(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row."""
        piece = lowered(piece)
        names, scores = np.full(piece.rows, UNKNOWN, object), np.zeros(piece.rows)
        at = np.flatnonzero(has_letter(piece))
        if not len(at) or not self.members:
            return names, scores
        places = list(gram_ids(piece))
        counts = sum(np.diff(np.concatenate([[0], np.cumsum(valid)])[piece.offsets]) for _, valid in places)
        column = {id(m): i for i, m in enumerate(self.machines)}

        def margin(m: Machine) -> np.ndarray:
            weights, total = self.weights[column[id(m)]], np.zeros(piece.rows)
            for ids, valid in places:
                got = weights[ids]
                got[~valid] = 0
                total += np.diff(np.concatenate([[0.0], np.cumsum(got, dtype=np.float64)])[piece.offsets])
            return total / np.maximum(counts, 1)

        families = sorted(self.members)
        chosen, p = _vote(families, self.families, margin, piece.rows)
        for k, family in enumerate(families):
            own = at[chosen[at] == k]
            if len(own):
                languages = self.members[family]
                best, q = _vote(languages, self.within[family], margin, piece.rows)
                names[own], scores[own] = np.array(languages, object)[best[own]], (p * q)[own]
        return names, scores


def _vote(names: list[str], machines: list[Machine], margin, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the name that won most duels; ties by the summed chances, then by name. The score is the winner's
    least chance in a duel."""
    wins, chances, least = np.zeros((len(names), rows)), np.zeros((len(names), rows)), np.ones((len(names), rows))
    place = {n: i for i, n in enumerate(names)}
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(m.slope * (margin(m) + m.bias), -30, 30)))
        for i, x in ((place[m.first], p), (place[m.second], 1 - p)):
            wins[i] += x > 0.5
            chances[i] += x
            np.minimum(least[i], x, out=least[i])
    best = np.zeros(rows, np.int64)
    at = np.arange(rows)
    for i in range(1, len(names)):
        better = (wins[i] > wins[best, at]) | ((wins[i] == wins[best, at]) & (chances[i] > chances[best, at]))
        best[better] = i
    return best, least[best, at]


def has_letter(piece: Piece) -> np.ndarray:
    """Does a row hold a letter of any script."""
    latin = _LETTER[piece.data | np.uint8(0x20)] & (piece.data < 0x80) & (piece.data >= 0x41)
    found = np.diff(np.concatenate([[0], np.cumsum(latin)])[piece.offsets]) > 0
    for r in np.flatnonzero(~found):
        found[r] = any(c.isalpha() for c in piece.raw(int(r)).decode("utf-8", "replace"))
    return found


@dataclass
class Sparse:
    """Rows of (bucket, relative frequency), one after another."""

    begin: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray


def _features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and the share of its n-grams that fall into them."""
    for piece in pieces(pa.array(texts, pa.binary()).cast(pa.string(), safe=False)):
        places = [(ids, valid) for ids, valid in gram_ids(lowered(piece))]
        for lo, hi in zip(piece.offsets[:-1], piece.offsets[1:], strict=True):
            counts = np.bincount(np.concatenate([ids[lo:hi][valid[lo:hi]] for ids, valid in places]), minlength=1 << BITS)
            buckets = np.flatnonzero(counts)
            yield buckets.astype(np.int16), (counts[buckets] / max(counts.sum(), 1)).astype(np.float32)


def examples(text: str) -> list[bytes]:
    """A sample document and snippets of it; parts without a letter are left out."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    parts = [text]
    for size in SNIPPETS:
        if len(text) > size:
            begin = int(rng.integers(len(text) - size))
            parts.append(text[begin : begin + size])
    return [part.encode("utf-8", "replace") for part in parts if any(c.isalpha() for c in part)]


def _svm(rows: Sparse, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias for the squared hinge, by dual coordinate descent; the bias counts as one more feature."""
    n = len(y)
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(n)
    parts = [(rows.buckets[lo:hi], rows.shares[lo:hi]) for lo, hi in zip(rows.begin[:-1].tolist(), rows.begin[1:].tolist(), strict=True)]
    diagonal = np.array([float(v @ v) + 1 + 1 / (2 * cost) for _, v in parts])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n).tolist():
            at, share = parts[i]
            gradient = y[i] * (float(weights[at] @ share) + bias) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                step = y[i] * (new - alpha[i])
                weights[at] += step * share
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights, bias


def _slope(margins: np.ndarray, y: np.ndarray) -> float:
    """Scale that turns margins into chances (one-parameter logistic fit)."""
    best, least = 1.0, np.inf
    for slope in np.geomspace(0.25, 16, 13):
        loss = np.logaddexp(0, -slope * margins * y).mean()
        if loss < least:
            best, least = float(slope), loss
    return best


def fit_machine(rows: Sparse, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights for relative frequencies, bias and slope of one machine; y is 1 for its first name and -1 for its second."""
    shares = rows.shares * scale[rows.buckets]
    norms = np.add.reduceat(shares * shares, rows.begin[:-1])
    top = max(float(np.median(norms)), 1e-12)
    scaled = Sparse(rows.begin, rows.buckets, shares / np.sqrt(top))
    weights, bias = _svm(scaled, y)
    margins = np.add.reduceat(weights[scaled.buckets] * scaled.shares, scaled.begin[:-1]) + bias
    return (weights * scale / np.sqrt(top)).astype(np.float32), bias, _slope(margins, y)


def _pairs(languages: list[str]) -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """Languages by family, and the machines: (family, "" between families; first; second)."""
    members: dict[str, list[str]] = {}
    for language in sorted(languages):
        members.setdefault(family_of(language), []).append(language)
    duels = [("", a, b) for a, b in combinations(sorted(members), 2)]
    duels += [(f, a, b) for f, names in sorted(members.items()) for a, b in combinations(names, 2)]
    if len(duels) > MAX_MACHINES:
        raise ValueError(f"{len(duels)} pairs of languages or families; at most {MAX_MACHINES} fit into a model")
    return members, duels


def _roles(members: dict[str, list[str]], duels: list[tuple[str, str, str]], per_language: int) -> list[tuple[str, int, int, int]]:
    """(language, machine, 1 or -1, documents of the language that the machine learns from)."""
    out = []
    for k, (family, *names) in enumerate(duels):
        for name, side in zip(names, (1, -1), strict=True):
            if family:
                out.append((name, k, side, per_language))
            else:
                each = -(-PER_FAMILY * per_language // len(members[name]))
                out += [(language, k, side, min(each, per_language)) for language in members[name]]
    return out


def _model(members: dict[str, list[str]], duels: list[tuple[str, str, str]], fitted: dict[int, tuple[bytes, float, float]]) -> Model:
    weights = np.array([np.frombuffer(fitted[k][0], np.float32) for k in range(len(duels))], np.float32).reshape(-1, 1 << BITS)
    machines = [Machine(first, second, *fitted[k][1:]) for k, (_, first, second) in enumerate(duels)]
    within: dict[str, list[Machine]] = {f: [] for f in members}
    for (family, *_), m in zip(duels, machines, strict=True):
        if family:
            within[family].append(m)
    return Model(weights, [m for (f, *_), m in zip(duels, machines, strict=True) if not f], within, members)


FEATURES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.ShortType())), T.StructField("shares", T.ArrayType(T.FloatType()))])
MACHINES = T.StructType([T.StructField("machine", T.IntegerType()), T.StructField("weights", T.BinaryType()), T.StructField("bias", T.DoubleType()), T.StructField("slope", T.DoubleType())])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, text) to FEATURES, a few megabytes at a time."""
    for batch in batches:
        for lang, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = list(_features(examples(text)))
            if rows:
                cells = [pa.array([lang] * len(rows), pa.string()), pa.array([place] * len(rows), pa.int32()), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([b for b, _ in rows], pa.list_(pa.int16())), pa.array([s for _, s in rows], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cells, names=FEATURES.names)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << BITS), 0
    for batch in batches:
        n += batch.num_rows
        total += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), 1 << BITS)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, place, text): of each language up to `per_language` documents, those with the least hashes of id and text. Repeated rows
    count once. A draw by the language's count of different rows comes first, so that few rows are ranked."""
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    known = known.withColumn("h", F.xxhash64("i", "text"))
    counts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a language
    drawn = known.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.lit((1.5 * per_language + 50) * (1 << 30)) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "i", "text")
    ranked = drawn.select("lang", "h", "i", "text").distinct().withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= per_language).select("lang", "place", "text")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on up to `per_language` documents of each language.

    Rows with a null text or language aren't learned from, a null id is as good as another; texts without a letter teach nothing, and a
    language with no other texts isn't learned. Ties of the hash go by id, then by text; repeated rows count once. Without any
    row to learn from, every prediction is `und`. Other columns aren't read."""
    spark = docs.sparkSession
    rows = materialize(sampled(docs, id_col, text_col, lang_col, per_language).mapInArrow(_sparse_rows, FEATURES), "lang-features")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())  # MAX_MACHINES bounds what may follow
    members, duels = _pairs(languages)
    if not duels:
        return Model(np.zeros((0, 1 << BITS), np.float32), [], {f: [] for f in members}, members)
    parts = rows.select("buckets", "shares").mapInArrow(_sums, "n long, total binary").collect()  # a row a task
    scale = 1 / np.sqrt(sum(np.frombuffer(r["total"]) for r in parts) / sum(r["n"] for r in parts) + 1e-5)
    roles = spark.createDataFrame(_roles(members, duels, per_language), "lang string, machine int, side int, upto int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "descending"), ("lang", "ascending"), ("place", "ascending"), ("part", "ascending")]).combine_chunks()
        buckets = table.column("buckets").combine_chunks()
        own = Sparse(np.concatenate([[0], np.cumsum(table.column("sizes").to_numpy())]), buckets.flatten().to_numpy(), table.column("shares").combine_chunks().flatten().to_numpy())
        weights, bias, slope = fit_machine(own, table.column("side").to_numpy().astype(float), scale)
        return pa.table({"machine": pa.array([table.column("machine")[0].as_py()], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias], "slope": [slope]})

    dealt = rows.join(F.broadcast(roles), "lang").where("place <= upto").withColumn("sizes", F.size("buckets"))
    fitted = dealt.drop("upto").groupBy("machine").applyInArrow(run, MACHINES).collect()  # 64 kB a machine
    return _model(members, duels, {r["machine"]: (bytes(r["weights"]), r["bias"], r["slope"]) for r in fitted})


def fit(sample: list[tuple[str, str]], per_language: int = PER_LANGUAGE) -> Model:
    """The same fit of a small sample (text, language) in memory."""
    rows: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for text, language in sample:
        place = 1 + max((p for p, *_ in rows.get(language, [])), default=0)
        for buckets, shares in _features(examples(text)):
            rows.setdefault(language, []).append((place, buckets, shares))
    members, duels = _pairs(list(rows))
    every = [x for own in rows.values() for x in own]
    scale = 1 / np.sqrt(sum(np.bincount(b, s, 1 << BITS) for _, b, s in every) / max(len(every), 1) + 1e-5)
    fitted = {}
    for k in range(len(duels)):
        roles = sorted((-side, language, upto) for language, machine, side, upto in _roles(members, duels, per_language) if machine == k)
        own = [(-side, b, s) for side, language, upto in roles for place, b, s in rows[language] if place <= upto]
        sparse = Sparse(np.concatenate([[0], np.cumsum([len(b) for _, b, _ in own])]), np.concatenate([b for _, b, _ in own]), np.concatenate([s for *_, s in own]))
        weights, bias, slope = fit_machine(sparse, np.array([y for y, *_ in own], float), scale)
        fitted[k] = (weights.tobytes(), bias, slope)
    return _model(members, duels, fitted)


def identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`; columns of these names are replaced.

    A null text, and a text without a letter, is `und` with score 0. Repeated rows get equal answers; an even vote goes to the
    likelier, then to the lesser name; an empty table gives no rows."""
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 kB a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(piece) for piece in pieces(text_of(batch, text_col))]
            names, scores = (np.concatenate([np.zeros(0, kind), *(x[k] for x in got)]) for k, kind in enumerate((object, float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return base.mapInArrow(run, schema)
