"""Near-duplicates by SimHash and deletion-variant signatures.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half the hashes (XXH64, seed 42) of the text's three-word shingles.
Fingerprints that differ in at most DISTANCE = 3 bits are linked.

1. Equal fingerprints collapse to one row, by a pre-aggregated grouping.
2. A fingerprint is cut into two segments of 32 bits, fewer than the four that exact matching would need: of three
   differing bits at most one lies in one of the segments. So two linked fingerprints agree in a segment, or in a segment
   with one bit made a wildcard. The 2 + 64 signatures of a fingerprint are written (mask, bits under the mask). Wildcard signatures are
   made of the distinct segments and not of the fingerprints, so that a signature has at most two owners.
3. Fingerprints with a common signature form a bucket. Each is compared with that of the bucket which most documents have, and
   what this links is one part from then on. Where all but SMALL of a bucket's fingerprints are in one part, pairs of different parts are
   compared, at most SMALL times its size. What is left is cut again, the open 32 bits in two segments of 16, and where that isn't
   enough, once more: the open 16 bits with as many wildcards as are left. All fingerprints under such a signature differ in
   at most three bits, so they are joined without a comparison. So the work of a fingerprint is bounded at every step,
   however large a bucket is, and no link between parts is left out.
4. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.ordermh import components
from barlake.llm.store import materialize
from barlake.llm.textbytes import NONSPACE, Piece, lowered, pieces, text_of, words

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints outside a bucket's largest part up to which pairs between parts are compared.
SMALL = 32
#: Shingles hashed at a time.
BLOCK = 1 << 16
#: A fingerprint of more than this share of the documents is joined by broadcast: at most 10,000 of them.
HEAVY_SHARE = 1e-4

_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def normalised(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a piece joined by one blank: bytes, starts and ends of the words in them, first word of each row."""
    found = words(piece, NONSPACE, hashed=False)
    solid = NONSPACE[piece.data]
    sizes = found.ends - found.starts
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = piece.data[solid]
    return out, ends - sizes, ends, found.first


def fingerprint(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> int:
    """The fingerprint of one text's words in `data`; of fewer words than `size` the whole is one shingle, of none it is 0."""
    if not len(starts):
        return 0
    heads, tails = (starts[: len(starts) - size + 1], ends[size - 1 :]) if len(starts) >= size else (starts[:1], ends[-1:])
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(heads), BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(heads[lo : lo + BLOCK].tolist(), tails[lo : lo + BLOCK].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(heads), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with `fingerprint`, a long whose bits are the fingerprint's; a column of that name is replaced. A null text is an empty one,
    and one without words has fingerprint zero."""
    base = docs.drop("fingerprint")
    schema = T.StructType([*base.schema.fields, T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for piece in pieces(text_of(batch, text_col)):
                data, starts, ends, first = normalised(lowered(piece))
                data = data.tobytes()
                for r in range(piece.rows):
                    own = slice(first[r], first[r + 1])
                    found[piece.lo + r] = fingerprint(data, starts[own], ends[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    return base.mapInArrow(run, schema)


LOWER, UPPER = 0xFFFFFFFF, _signed(0xFFFFFFFF << 32)


def _upper(mask: str) -> Column:
    """Is a signature's mask one of the upper segment."""
    return F.col(mask).bitwiseAND(F.lit(LOWER)) == 0


def _masks(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)).cast("long") for m in masks))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of the buckets (mask, key) that several fingerprints share."""
    counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return materialize(rows.join(counts.select("mask", "key"), ["mask", "key"]), "buckets")  # a large bucket's rows can be split among tasks


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _starred(rows: DataFrame) -> DataFrame:
    """Links of each fingerprint of a bucket with the one that most documents have."""
    heads = rows.groupBy("mask", "key").agg(F.max_by("fp", F.struct("docs", "fp")).alias("head"))
    met = rows.join(heads, ["mask", "key"]).where((F.col("fp") != F.col("head")) & _near("fp", "head"))
    return materialize(met.select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct(), "links")


def _pairs(rows: DataFrame) -> DataFrame:
    """Links between the parts of each bucket."""
    one, two = (rows.select("mask", "key", F.col("fp").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    met = one.join(two, ["mask", "key"]).where((F.col("part_a") < F.col("part_b")) & _near("a", "b"))
    return materialize(met.select("a", "b").distinct(), "links")


def _joined(parts: DataFrame | None, found: DataFrame) -> DataFrame:
    """(fp, part) of the fingerprints that have links, after the links (a, b) of fingerprints, or of parts, in addition to those before."""
    if parts is None:
        return materialize(components(found).select(F.col("node").alias("fp"), F.col("root").alias("part")), "parts")
    ends = [parts.select(F.col("fp").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab"]
    between = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    between = materialize(between.where("a <> b").distinct(), "between")
    if between.limit(1).count() == 0:
        return parts
    roots = materialize(components(between), "roots")
    moved = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("fp", F.coalesce("root", "part").alias("part"))
    alone = roots.select(F.col("node").alias("fp"), F.col("root").alias("part")).join(parts, "fp", "left_anti")
    return materialize(moved.unionByName(alone), "parts")


def _open(rows: DataFrame, parts: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Rows, with their part, of the buckets that several parts share: those of which all but `small` fingerprints are in one part, and others."""
    named = materialize(rows.drop("part").join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp")), "named")
    held = named.groupBy("mask", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    wide = held.groupBy("mask", "key").agg((F.sum("n") - F.max("n")).alias("beside")).where("beside > 0")
    rows = materialize(named.join(wide, ["mask", "key"]), "open")
    return rows.where(F.col("beside") <= small), rows.where(F.col("beside") > small)


def segment_buckets(distinct: DataFrame) -> DataFrame:
    """(mask, key, fp, docs): the signatures of fingerprints that others share too."""
    halves = F.array(*(F.struct(F.lit(m).alias("half"), F.col("fp").bitwiseAND(F.lit(m)).alias("segment")) for m in (UPPER, LOWER)))
    cut = distinct.select("fp", "docs", F.explode(halves).alias("s")).select("fp", "docs", "s.*")
    segments = materialize(cut.groupBy("half", "segment").agg(F.count(F.lit(1)).alias("count")), "segments")
    wild = F.when(_upper("half"), _masks([1 << i for i in range(32, 64)])).otherwise(_masks([1 << i for i in range(32)]))
    variants = segments.select("half", "segment", F.explode(wild).alias("bit")).select((F.col("half").bitwiseXOR(F.col("bit"))).alias("mask"), F.col("segment").bitwiseAND(F.bitwise_not("bit")).alias("key"))
    met = variants.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("count")).where("count = 2").drop("count")
    half = F.when(_upper("mask"), F.lit(UPPER)).otherwise(F.lit(LOWER))
    bit = F.col("mask").bitwiseXOR(half)
    owners = met.select("mask", "key", half.alias("half"), F.explode(F.array("key", F.col("key").bitwiseOR(bit))).alias("segment"))
    exact = segments.where("count > 1").select(F.col("half").alias("mask"), F.col("segment").alias("key"), "half", "segment")
    owners = materialize(owners.unionByName(exact), "owners")
    return cut.join(owners, ["half", "segment"]).select("mask", "key", "fp", "docs")


def _deeper(rows: DataFrame) -> DataFrame:
    """The open 32 bits cut in two segments of 16, whole or with one wildcard."""
    cuts = [_masks([part ^ wild for at in (lo, lo + 16) for part in (0xFFFF << at,) for wild in (0, *(1 << i for i in range(at, at + 16)))]) for lo in (0, 32)]
    more = rows.withColumn("more", F.explode(F.when(_upper("mask"), cuts[0]).otherwise(cuts[1])))
    return more.select(F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp", "docs", "part").withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()


def _last(rows: DataFrame) -> DataFrame:
    """The open 16 bits under all choices of the wildcards that are left: (mask, key, part), three wildcards in all."""
    choices = F.array(*(_masks([_ALL ^ sum(1 << i for i in c) for c in combinations(range(lo, lo + 16), n)]) for lo in (0, 16, 32, 48) for n in (1, 2, 3)))
    # zero bits of a mask: 16 that are open and one for each wildcard so far
    used = F.lit(48) - F.bit_count("mask")
    zeros = F.bitwise_not("mask")
    lanes = [F.bit_count(zeros.bitwiseAND(F.lit(_signed(0xFFFF << lo)))) == 16 for lo in (0, 16, 32, 48)]
    lane = F.when(lanes[0], 0).when(lanes[1], 1).when(lanes[2], 2).otherwise(3)
    open_bits = F.element_at(_masks([0xFFFF << lo for lo in (0, 16, 32, 48)]), lane + 1)
    wild = F.explode(F.element_at(choices, (lane * 3 + (F.lit(3) - used)).cast("int")))
    more = rows.withColumn("__open", open_bits).withColumn("__wild", wild)
    mask = F.col("mask").bitwiseOR(F.col("__open")).bitwiseAND(F.col("__wild"))
    return more.select(mask.alias("mask"), F.col("fp").bitwiseAND(mask).alias("key"), "part")


def parts_of(distinct: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(fp, part) of those distinct fingerprints (fp, docs) that are linked with others: the least fingerprint reachable."""
    rows = _sized(segment_buckets(distinct))
    parts = _joined(None, _starred(rows))
    few, many = _open(rows, parts, small)
    parts = _joined(parts, _pairs(few))
    if many.limit(1).count() == 0:
        return parts
    rows = _sized(_deeper(many))
    parts = _joined(parts, _starred(rows))
    few, many = _open(rows, parts, small)
    parts = _joined(parts, _pairs(few))
    if many.limit(1).count() == 0:
        return parts
    # all that share three wildcards are linked, so each part is joined with the least
    last = materialize(_last(many).groupBy("mask", "key", "part").agg(F.count(F.lit(1)).alias("count")), "wildcards")
    least = last.groupBy("mask", "key").agg(F.min("part").alias("a"))
    found = last.join(least, ["mask", "key"]).where("a < part").select("a", F.col("part").alias("b")).distinct()
    return _joined(parts, materialize(found, "links"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per row of docs: id, `fingerprint` (16 lower-case hex digits), `component_id`, the least id reachable over links.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows are linked. A null id is
    a member, but names a component only if it has no other. An empty table gives no rows. Other columns aren't read, whatever
    their names."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = materialize(fingerprinted(slim).select("doc_id", F.col("fingerprint").alias("fp")), "fingerprints")
    distinct = materialize(every.groupBy("fp").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least_id")), "distinct")
    parts = parts_of(distinct.select("fp", "docs"), small=small)
    rooted = distinct.join(parts.withColumnRenamed("part", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = materialize(rooted.join(named, "root").select("fp", "docs", "component_id"), "components")
    bound = max(1, int(every.count() * HEAVY_SHARE))
    heavy = F.broadcast(known.where(F.col("docs") > bound).select("fp", "component_id"))  # 1 / HEAVY_SHARE rows at most
    rest = every.join(heavy, "fp", "left_anti").join(known.where(F.col("docs") <= bound).select("fp", "component_id"), "fp")
    both = every.join(heavy, "fp").unionByName(rest)
    return both.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
