"""Near-duplicates by Order MinHash and banded alignment.

Texts are taken as sequences of five-word shingles (lower-cased words; a shorter text is one shingle). The similarity of two
is L / (n + m - L), L the length of their longest common subsequence of shingles: 1 for equal sequences, and lower the
more of them is edited or moved. Documents at 0.8 or more are linked, and linked documents form classes.

1. Equal texts (after normalisation) collapse to one node, by a pre-aggregated grouping.
2. Each node gets SKETCHES keys. For a key all shingles, labelled with their occurrence number so that repeats count,
   are hashed under the key's seed; the TAKE least are kept *in text order*, and the key is the hash of that sequence. Two
   texts share a key with a chance of about (shingle overlap) ** TAKE, less if the order differs; at similarity 0.8 all
   SKETCHES keys differ with a chance under 1e-4.
3. Nodes that share a key are candidates, and none is left out. A key of up to SMALL nodes pairs all of them. In a key of
   more nodes, each is first paired with a leader, the node that shares its keys with most others and so stands near the
   middle of its group. Nodes of keys that this doesn't join into one are then matched by their rarest shingles: two texts
   at the threshold share one of the first n - ceil(0.8 n) + 1 of their n shingles in any order that is the same for all
   texts, and here the rarest stand first. So a group is those who share such a shingle, whatever the key's size; in it one node of
   each part is paired with one leader first, and then those are that are still apart, unless their lengths or the places of
   the shingle leave too little to share. Where more than HOT still share a shingle, they are grouped by it and a second one:
   of n shingles the first n - ceil(0.8 n) + 2 hold two in common, so texts that share just that one don't meet.
4. Candidates are verified exactly: longest common subsequence within the diagonal band that the threshold allows, bit-parallel.
5. Classes are the connected components of the links (least-label hooking on shared tables, never on the driver).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import materialize
from barlake.llm.textbytes import Piece, grams, lowered, mix, pieces, text_of, words

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKE, SMALL = 14, 3, 16
#: Texts of different parts under a rare shingle from which a second one is asked for, and the most shingles in front of which that is done: each of
#: them makes a row with each one after it. Longer texts meet under one shingle.
HOT, FRONT = 64, 64
#: Bits of a shingle's hash under which shingles are counted for the order by rarity: a table of 4 MB, whatever the input.
RARITY_BITS = 20
#: Stands for a null id: after all others.
NULL_ID = (1 << 63) - 1

_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
NODES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles one after another, and where each row's begin."""
    counts = np.diff(first)
    per_row = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    begin = np.concatenate([[0], np.cumsum(per_row)])
    at = np.repeat(first[:-1] - begin[:-1], per_row) + np.arange(begin[-1])
    whole = grams(np.concatenate([hashes, np.zeros(size, np.uint64)]), size)
    out = whole[at] if len(at) else np.zeros(0, np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        out[begin[r]] = grams(hashes[first[r] : first[r + 1]], int(counts[r]))[0] ^ np.uint64(counts[r])
    return out, begin


def labelled(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each shingle hashed with its occurrence number in its row."""
    keys = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return hashes
    ordered = keys[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if starts.all():
        return mix(hashes)
    head = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    number = np.empty(len(order), np.uint64)
    number[order] = (np.arange(len(order)) - head).astype(np.uint64)
    return mix(hashes + number * np.uint64(0xA0761D6478BD642F))


def sketch(hashes: np.ndarray, begin: np.ndarray, sketches: int = SKETCHES, take: int = TAKE) -> np.ndarray:
    """Order MinHash keys, rows by sketches; rows without shingles get zeros."""
    rows = len(begin) - 1
    out = np.zeros((rows, sketches), np.uint64)
    filled = np.flatnonzero(np.diff(begin))
    if not len(filled):
        return out
    counts = np.diff(begin)[filled]
    heads = begin[filled]
    row = np.repeat(np.arange(len(filled)), counts)
    own = labelled(hashes, row)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        h = (own ^ _SEEDS[s]) * np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(32)
        places = np.full((len(filled), take), len(hashes), np.int64)
        for t in range(take):
            least = np.minimum.reduceat(h, heads)
            at = np.flatnonzero(h == np.repeat(least, counts))
            live = least[row[at]] != top
            at = at[live]
            places[row[at][::-1], t] = at[::-1]  # the first where hashes tie
            h[places[:, t][places[:, t] < len(hashes)]] = top
        places.sort(axis=1)
        padded = np.concatenate([hashes, np.zeros(1, np.uint64)])
        key = np.full(len(filled), _SEEDS[128 + s])
        for t in range(take):
            key = mix(key * np.uint64(0x8EBC6AF09C88C6E3) + padded[places[:, t]])
        out[filled, s] = key
    return out


def sequence_of(piece: Piece, found, row: int) -> bytes:
    """The row's words joined by one blank: equal for equal normalised texts."""
    lo, hi = int(found.first[row]), int(found.first[row + 1])
    return found.hashes[lo:hi].tobytes()


def node_of(words_hashed: bytes) -> bytes:
    return hashlib.blake2b(words_hashed, digest_size=16).digest()


def nodes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(text_of(batch)):
                piece = lowered(piece)
                found = words(piece)
                hashes, begin = shingles(found.hashes, found.first)
                keys = sketch(hashes, begin).view(np.int64)
                ids = [node_of(sequence_of(piece, found, r)) for r in range(piece.rows)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.rows), pa.array(ids, pa.binary()), pa.array(np.diff(begin).astype(np.int64)), lists], names=NODES.names)

    return docs.mapInArrow(run, NODES)


SEQUENCES = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("seq", T.BinaryType())])


def sequences(docs: DataFrame) -> DataFrame:
    """node and its word hashes (32 bits each) for rows of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(text_of(batch)):
                piece = lowered(piece)
                found = words(piece)
                ids = [node_of(sequence_of(piece, found, r)) for r in range(piece.rows)]
                short = (found.hashes >> np.uint64(32)).astype("<u4")
                seqs = [short[found.first[r] : found.first[r + 1]].tobytes() for r in range(piece.rows)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(seqs, pa.binary())], names=SEQUENCES.names)

    return docs.mapInArrow(run, SEQUENCES)


def common_length(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence, exact if an alignment within `band` of the diagonal attains it.

    Bit-parallel: bit i of v is 0 where the length grows at a[i]. Bits left behind by the band are counted and dropped."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    n, base, done = len(a), 0, 0
    width = min(n, band + 256)
    v = (1 << width) - 1
    for j, x in enumerate(b):
        low = j - band
        if low - base >= 256:
            step = min(low - base, n - base)
            done += step - (v & ((1 << step) - 1)).bit_count()
            base += step
            v >>= step
            width = max(width - step, 0)
        top = min(n, j + band + 1) - base
        if top > width:
            grow = min(n - base, top + 256)
            v |= ((1 << (grow - width)) - 1) << width
            width = grow
        own = places.get(x)
        if own:
            mask = 0
            for i in own:
                if base <= i and abs(i - j) <= band and i - base < width:
                    mask |= 1 << (i - base)
            if mask:
                hit = v & mask
                v = ((v + hit) | (v & ~mask)) & ((1 << width) - 1)
    return done + width - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n + m - L) of two shingle sequences; 0 where it is surely under `least`."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    x, one = np.unique(a, return_counts=True)
    y, two = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    most = int(np.minimum(one[i], two[j]).sum())
    if most < least * (n + m - most):
        return 0.0
    k = min(n, m)
    head = int(np.argmin(np.concatenate([a[:k] == b[:k], [False]])))
    tail = int(np.argmin(np.concatenate([a[::-1][: k - head] == b[::-1][: k - head], [False]])))
    inner = common_length(a[head : n - tail].tolist(), b[head : m - tail].tolist(), int((n + m) * (1 - least) / (1 + least)) + 1)
    length = head + tail + inner
    return length / (n + m - length)


def _shingled(seq: bytes) -> np.ndarray:
    hashes = np.frombuffer(seq, "<u4").astype(np.uint64)
    return shingles(mix(hashes), np.array([0, len(hashes)]))[0]


def verified(pairs: DataFrame, seqs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is `least` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, np.zeros(0, np.uint64)
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                sa = sa.as_py()
                if sa != last:
                    last, left = sa, _shingled(sa)
                keep.append(similarity(left, _shingled(sb.as_py()), least) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b")
    both = with_b.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, LINKS)


def _of_length(x: str, y: str, least: float):
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


PREFIXES = T.StructType([T.StructField("token", T.LongType()), T.StructField("place", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("comp", T.BinaryType()), T.StructField("n", T.LongType())])


def _numbered(seq: bytes) -> np.ndarray:
    """A text's shingles, each hashed with its occurrence number."""
    own = _shingled(seq)
    return labelled(own, np.zeros(len(own), np.int64))


def rarities(texts: DataFrame, bits: int = RARITY_BITS) -> np.ndarray:
    """How many shingles of texts (seq) begin with each pattern of `bits` bits: counted in tasks, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for seq in batch.column(0):
                counts += np.bincount((_numbered(seq.as_py()) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        held = np.flatnonzero(counts)
        for lo in range(0, len(held), 100_000):
            some = held[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "count"])

    sums = texts.select("seq").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()  # 2 ** bits rows at most
    out = np.zeros(1 << bits, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("count").to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def prefixes(texts: DataFrame, least: float = SIMILARITY, bits: int = RARITY_BITS, common: int = 1) -> DataFrame:
    """The rarest shingles of each row of texts (node, comp, seq), as many as surely hold `common` in common with any text at `least` (that shares so many at
    all): rows of `token`, its `place` in the text's order, node, comp, and n (shingles of the text)."""
    counts = texts.sparkSession.sparkContext.broadcast(rarities(texts, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            sizes = [len(f) for f in firsts]
            of = np.repeat(np.arange(len(firsts)), sizes)
            places = np.concatenate([np.arange(k) for k in sizes])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(places), *(pa.array(x, pa.binary()).take(pa.array(of)) for x in (nodes, comps)), pa.array(np.array(whole)[of])], names=PREFIXES.names)

        for batch in batches:
            nodes, comps, whole, firsts = [], [], [], []
            for node, comp, seq in zip(*batch.columns, strict=True):
                own = _numbered(seq.as_py())
                n = len(own)
                firsts.append(own[np.lexsort((own, counts.value[(own >> np.uint64(64 - bits)).astype(np.int64)]))[: n - int(np.ceil(least * n - 1e-9)) + common]])
                nodes.append(node.as_py())
                comps.append(comp.as_py())
                whole.append(n)
                if n > 50_000 or len(firsts) >= 1000:
                    yield flushed()
                    nodes, comps, whole, firsts = [], [], [], []
            if firsts:
                yield flushed()

    return texts.select("node", "comp", "seq").mapInArrow(run, PREFIXES)


def _apart(rows: DataFrame) -> DataFrame:
    """Rows of the tokens that several parts share."""
    several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return materialize(rows.join(several, "token"), "apart")


def rare_links(texts: DataFrame, seqs: DataFrame, least: float = SIMILARITY, bits: int = RARITY_BITS, hot: int = HOT) -> DataFrame:
    """Links between parts (comp) of texts (node, comp, seq), enough of them to join all that are similar."""
    rows = _apart(materialize(prefixes(texts, least, bits), "prefixes"))
    # one node of each part under a token meets one leader
    reps = rows.groupBy("token", "comp").agg(F.min(F.struct(F.xxhash64("node", "token").alias("h"), "node", "n")).alias("rep"))
    reps = materialize(reps.select("token", "comp", "rep.*"), "parts")
    heads = reps.groupBy("token").agg(F.min(F.struct("h", "node", "n", "comp")).alias("head"))
    met = reps.join(heads, "token").where((F.col("comp") != F.col("head.comp")) & _of_length("n", "head.n", least))
    met = materialize(met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct(), "met")
    found = materialize(verified(met, seqs, least), "links")
    # parts that these links join are one from now on
    ends = [texts.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
    joined = components(found.join(ends[0], "a").join(ends[1], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    rows = rows.join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    rows = _apart(rows)
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    sized = materialize(rows.join(counts, "token").withColumn("refined", (F.col("count") > hot) & (F.col("n") * (1 - least) < FRONT)), "sized-tokens")
    once = (F.col("node_a") < F.col("node_b")) | F.col("refined_b")  # a text that meets under one shingle meets all
    pairs = _meeting(sized.where(~F.col("refined")), sized, ["token"], "place", least, once)
    if sized.where("refined").limit(1).count():
        pairs = pairs.unionByName(_refined(sized.where("refined"), texts, least, bits))
    return found.unionByName(materialize(verified(pairs.distinct().join(met, ["a", "b"], "left_anti"), seqs, least), "links"))


def _meeting(one: DataFrame, two: DataFrame, on: list[str], place: str, least: float, once: Column, before: int = 0) -> DataFrame:
    """Pairs of nodes of different parts under a token, one of them of `one`, that can share enough if its `place` is that of the next
    shingle that they share after `before` others."""
    a, b = (side.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in (place, "node", "comp", "n", "refined"))) for side, x in ((one, "a"), (two, "b")))
    most = before + F.least(F.col("n_a") - F.col(f"{place}_a"), F.col("n_b") - F.col(f"{place}_b"))
    near = once & (F.col("comp_a") != F.col("comp_b")) & _of_length("n_a", "n_b", least) & (most * (1 + least) >= (F.col("n_a") + F.col("n_b")) * least - 1e-6)
    return a.join(b, on).where(near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _refined(rows: DataFrame, texts: DataFrame, least: float, bits: int) -> DataFrame:
    """Pairs under hot tokens that share a second shingle: rows of hot tokens, each with every later shingle of its text's front. Texts of one shingle share
    it with none but their equals, which are one node."""
    own = texts.join(rows.select("node").distinct(), "node", "left_semi")
    fronts = prefixes(own, least, bits, common=2).select("node", F.col("token").alias("next"), F.col("place").alias("next_place"))
    both = rows.join(fronts, "node").where("next_place > place").select("token", "next", "next_place", "node", "comp", "n", "refined")
    several = both.groupBy("token", "next").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "next")
    both = materialize(both.join(several, ["token", "next"]), "refined")
    return _meeting(both, both, ["token", "next"], "next_place", least, F.col("node_a") < F.col("node_b"), before=1)


def links(members: DataFrame, seqs: DataFrame, *, least: float = SIMILARITY, small: int = SMALL, rarity_bits: int = RARITY_BITS) -> DataFrame:
    """Verified pairs among nodes that share a key, enough of them to connect all that are similar. members: (key, node, n)."""

    def all_pairs(rows: DataFrame) -> DataFrame:
        one, two = rows.select("key", F.col("node").alias("a"), F.col("n").alias("na")), rows.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
        return one.join(two, "key").where((F.col("a") < F.col("b")) & _of_length("na", "nb", least)).select("a", "b")

    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    sized = materialize(members.select("key", "node", "n").join(materialize(counts, "counts"), "key"), "sized")  # a hot key's rows can be split
    found = materialize(verified(all_pairs(sized.where(F.col("count") <= small)).distinct(), seqs, least), "links")
    hot = sized.where(F.col("count") > small)
    if hot.limit(1).count() == 0:
        return found
    # a node that shares its keys with many is near the middle of its group: the best leader
    known = hot.groupBy("node").agg(F.sum("count").alias("shared"))
    pool = materialize(hot.select("key", "node", "n").join(known, "node"), "pool")
    best = F.min(F.struct((-F.col("shared")).alias("s"), F.xxhash64("node", "key").alias("h"), F.col("node"), F.col("n"))).alias("best")
    leaders = materialize(pool.groupBy("key").agg(best).select("key", F.col("best.node").alias("leader"), F.col("best.n").alias("nl")), "leaders")
    stars = pool.join(leaders, "key").where((F.col("node") != F.col("leader")) & _of_length("nl", "n", least)).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    found = found.unionByName(materialize(verified(stars.distinct().join(found, ["a", "b"], "left_anti"), seqs, least), "links"))
    linked = materialize(pool.join(components(found), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")), "linked")
    wide = linked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    texts = materialize(linked.join(wide, "key").select("node", "comp").distinct().join(seqs, "node"), "open")
    if texts.limit(1).count() == 0:
        return found
    return found.unionByName(rare_links(texts, seqs, least, rarity_bits))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node of its component.

    Alternates large and small stars: each node hooks its greater neighbours, then its lesser ones, to the least it
    knows, until nothing changes. Grouping is pre-aggregated, and a hub's edges are spread by the join's skew handling."""
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "large")
        # small star: edges now point from greater (a) to lesser (b)
        lesser = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lesser, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "small")
        # done when each node has one root and no root has another
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("held")), F.struct(F.col("b").alias("v"), F.lit(0).alias("held")))).alias("e")).select("e.*")
        if not ends.groupBy("v").agg(F.sum("held").alias("roots"), F.min("held").alias("held")).where("roots > 1 OR (roots = 1 AND held = 0)").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(doc_id, node, n, keys, root) of every row of docs: root is the least node of its class, null for a text without words."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = materialize(nodes(slim), "nodes")
    some = every.where("n > 0")
    distinct = materialize(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "distinct")
    keyed = distinct.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = materialize(keyed.join(shared, "key"), "members").select("key", "node", "n")
    wanted = distinct.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "node")
    texts = slim.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    seqs = materialize(sequences(texts).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sequences")
    roots = components(links(members, seqs, least=least, small=small))
    return every.join(roots, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """One row per row of docs: id, `class_id` (the least id of its class), `class_size` (rows of the class).

    Null and empty texts and texts without words are alone, each a class of its own id. Rows of one id may stand in
    several classes if their texts differ; repeated rows share one. Null ids are members, but name a class only if it has no
    other. An empty table gives no rows. Other columns aren't read."""
    named = rooted(docs, id_col=id_col, text_col=text_col, least=least, small=small)
    sizes = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = named.join(materialize(sizes, "sizes"), "root", "left")  # a hot class's rows can then be split among tasks
    back = [F.nullif(c, F.lit(NULL_ID)) for c in (F.col("doc_id"), F.coalesce("class_id", "doc_id"))]
    return out.select(back[0].alias(id_col), back[1].alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def with_node(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `__node`, null for a text without words."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.BinaryType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at).cast(pa.string())):
                piece = lowered(piece)
                found = words(piece)
                ids = [node_of(sequence_of(piece, found, r)) if found.first[r + 1] > found.first[r] else None for r in range(piece.rows)]
                yield pa.RecordBatch.from_arrays([*batch.slice(piece.lo, piece.rows).columns, pa.array(ids, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that have a near-duplicate of lesser id: of each class one row stays, that of its least id, and of the least
    node where that id has several texts in it; rows of a null id stay if their class has no other id, one of them. Texts
    without words are alone: one row of each id stays, and every row of a null id."""
    roots = rooted(docs, id_col=id_col, text_col=text_col, **how).where("root IS NOT NULL")
    keep = roots.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__node"))
    own = with_node(docs, text_col).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))
    some = own.where("__node IS NOT NULL").join(keep, ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"])
    none = own.where("__node IS NULL")
    named = none.where(F.col(id_col).isNotNull()).dropDuplicates(["__id"])
    return some.select(docs.columns).unionByName(named.select(docs.columns)).unionByName(none.where(F.col(id_col).isNull()).select(docs.columns))
