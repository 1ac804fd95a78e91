"""Benchmark decontamination by winnowing.

Of each `span` words one after another the k-gram of least hash is kept, of equal ones the last (winnowing). Equal stretches of
`span` words keep the same k-gram at the same place, so every shared passage of `span` words or more has a kept k-gram in common,
and only some 2 in span - k + 2 k-grams are kept. Items of fewer words than `span` are one fingerprint of all their words.

1. The benchmark's kept k-grams become a table: fingerprint, needed length, digest of the k-gram, its context (the span - k words
   to either side, nearest first) and item.
2. Documents are read once and thinned alike. A kept k-gram stays a candidate if its fingerprint is set in a bitmap of the
   benchmark's fingerprints; the bitmap has a fixed size (BITS), so a large benchmark lets more candidates through and loses none.
3. Candidates are joined with the different contexts on fingerprint, length and digest, and extended word by word to both sides.
   What reaches the needed length is a hit, and all its words lie in shared windows.
4. A k-gram with more than CROWD different contexts isn't extended context by context: its stretches of `span` words (at most
   span - k + 1) are joined by equality, so a stock phrase of many items meets only the stretches that it really shares.
5. Hits of a document that overlap or touch make one shared span.

Tables are broadcast if they were counted to be small; else both sides are dealt by key and a salt, so that a passage which a
third of the documents share is spread over tasks. Documents without a candidate aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import materialize
from barlake.llm.textbytes import Piece, Words, grams, lowered, pieces, text_of, words

SPAN, K = 10, 5
#: The bitmap's size (8 MB), rows up to which a table is broadcast (at most 700 bytes each), parts of a hot key, contexts of a
#: k-gram that are extended one by one, bytes from which a word is known by its digest.
BITS, BROADCAST_WINDOWS, SALTS, CROWD, LONG_WORD = 26, 100_000, 16, 32, 17

SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
KEYS = ["print", "n", "gram"]
_MARK = [T.StructField("print", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("gram", T.BinaryType())]
_CONTEXT = [T.StructField("before", T.ArrayType(T.BinaryType())), T.StructField("after", T.ArrayType(T.BinaryType()))]
_CANDIDATES = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), *_MARK, *_CONTEXT]))
_WORDS = pa.list_(pa.binary())
_MARK_ARROW = [("print", pa.int64()), ("n", pa.int32()), ("gram", pa.binary()), ("before", _WORDS), ("after", _WORDS)]
_CANDIDATE = pa.struct([("at", pa.int64()), *_MARK_ARROW])


def winnowed(hashes: np.ndarray, row: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept k-grams of words one after another, and their hashes. No stretch crosses a row's bounds."""
    every, n = grams(hashes, k), len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, shift = every[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span - k + 1):
        later = every[j : j + n] <= least
        least[later], shift[later] = every[j : j + n][later], j
    at = np.unique((np.arange(n) + shift)[row[:n] == row[span - 1 :]])
    return at, every[at]


class Bitmap:
    """Which fingerprints, by their last bits, the benchmark has."""

    def __init__(self, places: np.ndarray, words_: np.ndarray, bits: int):
        self.mask, self.bits = np.uint64((1 << bits) - 1), np.zeros(1 << max(bits - 6, 0), np.uint64)
        self.bits[places] = words_.view(np.uint64)

    def has(self, prints: np.ndarray) -> np.ndarray:
        low = prints & self.mask
        return (self.bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def _marks(found: Words, lengths: list[int], span: int, k: int, known: Bitmap) -> np.ndarray:
    """A document's candidates: rows of (row, place, needed length, fingerprint), by row."""
    row, parts = found.row, [np.zeros((0, 4), np.int64)]
    for length in lengths:
        if length == span:
            at, prints = winnowed(found.hashes, row, span, k)
        else:
            prints = grams(found.hashes, length)
            at = np.flatnonzero(row[: len(prints)] == row[length - 1 :]) if len(prints) else np.zeros(0, np.int64)
            prints = prints[at]
        hit = known.has(prints)
        parts.append(np.column_stack([row[at[hit]], at[hit], np.full(hit.sum(), length), prints[hit].view(np.int64)]))
    every = np.concatenate(parts)
    return every[np.argsort(every[:, 0], kind="stable")]


def _item_marks(found: Words, span: int, k: int) -> np.ndarray:
    """An item's fingerprints, in the same form: kept k-grams, or all words of an item of fewer than `span`."""
    at, prints = winnowed(found.hashes, found.row, span, k)
    parts = [np.column_stack([found.row[at], at, np.full(len(at), span), prints.view(np.int64)])]
    for length in range(1, span):
        rows = np.flatnonzero(found.counts == length)
        parts.append(np.column_stack([rows, found.first[rows], np.full(len(rows), length), grams(found.hashes, length)[found.first[rows]].view(np.int64)]))
    return np.concatenate(parts)


def _described(piece: Piece, found: Words, marks: np.ndarray, span: int, k: int) -> list[pa.Array]:
    """Columns print, n, gram, before and after of these marks. Words stand for themselves, and long ones for a digest behind a zero
    byte, which no word has: equal words have equal forms, and others don't."""

    def form(i: int) -> bytes:
        word = piece.data[found.starts[i] : found.ends[i]].tobytes()
        return word if len(word) < LONG_WORD else b"\0" + hashlib.blake2b(word, digest_size=16).digest()

    inner, before, after = [], [], []
    for row, at, n in marks[:, :3].tolist():
        size, reach = (k, span - k) if n == span else (n, 0)
        end = at + size
        inner.append(hashlib.blake2b(b" ".join(map(form, range(at, end))), digest_size=16).digest())
        before.append([form(i) for i in range(at - 1, max(int(found.first[row]), at - reach) - 1, -1)])
        after.append([form(i) for i in range(end, min(int(found.first[row + 1]), end + reach))])
    return [pa.array(marks[:, 3]), pa.array(marks[:, 2].astype(np.int32)), pa.array(inner, pa.binary()), pa.array(before, _WORDS), pa.array(after, _WORDS)]


INDEX = T.StructType([*_MARK, *_CONTEXT, T.StructField("item", T.StringType())])


def fingerprint_index(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """The benchmark's fingerprints as a table, each once an item and context. Null and empty texts and texts without words have none; an item
    without an id counts, and has a null `item`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                piece = lowered(piece)
                found = words(piece)
                marks = _item_marks(found, span, k)
                items = batch.column(0).take(pa.array(marks[:, 0] + piece.lo))
                yield pa.RecordBatch.from_arrays([*_described(piece, found, marks, span, k), items], names=INDEX.names)

    slim = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    context = F.sha2(F.concat_ws(" ", F.col("n").cast("string"), F.hex("gram"), *(F.array_join(F.transform(c, lambda w: F.hex(w)), "-") for c in ("before", "after"))).cast("binary"), 256)
    return materialize(slim.mapInArrow(run, INDEX).withColumn("context", context).distinct(), "fingerprints")


def _bitmap(index: DataFrame, bits: int) -> Bitmap:
    """At most 2 ** (bits - 6) numbers come to the driver, whatever the benchmark's size."""
    low = f"(print & {(1 << bits) - 1}L)"
    marked = index.select(F.expr(f"shiftright({low}, 6)").alias("place"), F.expr(f"shiftleft(1L, cast({low} & 63L as int))").alias("bit"))
    table = marked.groupBy("place").agg(F.bit_or("bit").alias("word")).toArrow()
    return Bitmap(table.column("place").to_numpy(), table.column("word").to_numpy(), bits)


def _scanned(docs: DataFrame, index: DataFrame, text_col: str, span: int, k: int, bits: int, keep_text: bool) -> DataFrame:
    """docs as a table with `n_words`, a tag for each row and its candidates."""
    base = docs.drop("n_words", "hit_spans", "hit_items")
    kept = [f for f in base.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("__marks", _CANDIDATES)])
    lengths = sorted(r["n"] for r in index.select("n").distinct().collect())  # at most `span`
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(index, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, cells = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], []
            for piece in pieces(text_of(batch, text_col).cast(pa.string())):
                piece = lowered(piece)
                found = words(piece)
                marks = _marks(found, lengths, span, k, known.value)
                counts.append(found.counts)
                offsets.append(np.cumsum(np.bincount(marks[:, 0], minlength=piece.rows)) + offsets[-1][-1])
                at = pa.array(marks[:, 1] - found.first[marks[:, 0]])
                cells.append(pa.StructArray.from_arrays([at, *_described(piece, found, marks, span, k)], fields=list(_CANDIDATE)))
            inner = pa.concat_arrays(cells) if cells else pa.array([], _CANDIDATE)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), inner)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in kept), pa.array(np.concatenate(counts)), lists], names=schema.names)

    return materialize(base.mapInArrow(run, schema).withColumn("__tag", F.monotonically_increasing_id()), "scanned")


def _met(many: DataFrame, table: DataFrame, on: list[str], broadcast_windows: int) -> DataFrame:
    """many joined with a stored table: by broadcast where that was counted to be small, else dealt by key and salt."""
    if table.count() <= broadcast_windows:
        return many.join(F.broadcast(table), on)
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("__tag", "at"), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"]).drop("salt")


def _shared(one: str, two: str) -> Column:
    """How many words of two contexts are equal, from the nearest on."""
    unlike = F.array_position(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike == 0, F.size(one)).otherwise(unlike - 1).cast("long")


def _stretches(marks: DataFrame, k: int) -> DataFrame:
    """Each mark once for every stretch of n words that holds its k-gram: `left` words before it, and the words to both sides."""
    right = F.col("n") - k - F.col("left")
    each = marks.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("n") - k))).where((F.size("before") >= F.col("left")) & (F.size("after") >= right))
    return each.withColumns({"before": F.slice("before", F.lit(1), F.col("left")), "after": F.slice("after", F.lit(1), right)})


def occurrences(candidates: DataFrame, index: DataFrame, *, k: int = K, span: int = SPAN, broadcast_windows: int = BROADCAST_WINDOWS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Hits (__tag, lo, hi) of candidates (__tag, at, print, n, gram, before, after), and (__tag, item) of what they hit. `crowd` is
    1 or more: items of fewer than `span` words have one context, and are never crowded."""
    contexts = index.drop("item").distinct()
    crowded = materialize(contexts.groupBy(*KEYS).count().where(F.col("count") > crowd).select(*KEYS), "crowded")
    few = materialize(contexts.join(crowded, KEYS, "left_anti").withColumnsRenamed({"before": "own_before", "after": "own_after"}), "contexts")
    size = F.when(F.col("n") == span, k).otherwise(F.col("n"))
    left, right = _shared("before", "own_before"), _shared("after", "own_after")
    extended = _met(candidates, few, KEYS, broadcast_windows).select("__tag", "n", "context", (F.col("at") - left).alias("lo"), (F.col("at") + size + right).alias("hi")).where("hi - lo >= n")
    stretches = materialize(_stretches(index.join(crowded, KEYS, "left_semi"), k).drop("context").distinct(), "stretches")
    held = _stretches(_met(candidates, crowded, KEYS, broadcast_windows), k)
    equal = _met(held, stretches, [*KEYS, "left", "before", "after"], broadcast_windows).withColumn("lo", F.col("at") - F.col("left"))
    one = extended.select("__tag", "lo", "hi", "context", F.lit(None).cast("string").alias("item"))
    two = equal.select("__tag", "lo", (F.col("lo") + F.col("n")).alias("hi"), F.lit(None).cast("string").alias("context"), "item")
    hits = materialize(one.unionByName(two), "hits")
    owners = index.select("context", "item").distinct()
    named = _met(hits.where("context is not null").select("__tag", F.col("__tag").alias("at"), "context").distinct(), owners, ["context"], broadcast_windows)
    return hits.select("__tag", "lo", "hi").distinct(), named.select("__tag", "item").unionByName(hits.where("context is null").select("__tag", "item"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, bits: int = BITS, broadcast_windows: int = BROADCAST_WINDOWS, crowd: int = CROWD, keep_text: bool = True) -> DataFrame:
    """docs with three more columns: `n_words` long, `hit_spans` array of [lo, hi) in words, `hit_items` sorted array
    of item ids as strings. Columns of these names that docs already has are replaced.

    Null and empty texts have no words and no hits; an item without words is never hit, one without an id makes spans but isn't
    named; repeated rows are each reported and tied fingerprints each looked up; very long texts are taken whole. An empty
    benchmark hits nothing, an empty table gives no rows."""
    own = {c: f"given{c}" for c in docs.columns if c in ("__tag", "__marks")}
    docs = docs.withColumnsRenamed(own)
    index = fingerprint_index(benchmark, item_col=item_col, text_col=item_text_col, span=span, k=k)
    scanned = _scanned(docs, index, text_col, span, k, bits, keep_text)
    names = [c for c in scanned.columns if c not in ("__tag", "__marks")]
    found = scanned.where("size(__marks) > 0").select("__tag", F.explode("__marks").alias("m")).select("__tag", "m.*")
    hits, items = occurrences(found, index, k=k, span=span, broadcast_windows=broadcast_windows, crowd=crowd)
    order = Window.partitionBy("__tag").orderBy("lo", "hi")  # a document's hits
    spans = hits.withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = spans.withColumn("island", F.sum(F.when(F.col("before") >= F.col("lo"), 0).otherwise(1)).over(order)).groupBy("__tag", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    merged = islands.groupBy("__tag").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("hit_spans"))
    named = items.groupBy("__tag").agg(F.sort_array(F.collect_set("item")).alias("hit_items"))
    none = {"hit_spans": F.array().cast(SPANS), "hit_items": F.array().cast("array<string>")}
    clean = scanned.where("size(__marks) = 0").withColumns(none)
    some = scanned.where("size(__marks) > 0").join(merged.join(named, "__tag"), "__tag", "left").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})
    return clean.select(*names, *none).unionByName(some.select(*names, *none)).withColumnsRenamed({given: c for c, given in own.items()})


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, items hit and a checksum of their ids. Contaminated is what has a hit word."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, x: total + x["hi"] - x["lo"])
    return found.select(
        F.col(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
