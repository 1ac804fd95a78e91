"""Sharding by minimax contiguous partition.

Documents of equal text form one atomic group. Groups stand in the order of their text's hash, so that no join is
needed to bring a group together and the order is the same on every run. The smallest feasible capacity over the
ordered group sizes is found by binary search, each try checked greedily (fill a shard until the next group doesn't
fit), and the sequence is cut there. A group larger than an even share takes a shard of its own where that
costs no capacity, and what lies on its two sides is divided the same way, so that the other shards stay even.

The driver never sees all groups: it works on the edges of at most a few hundred thousand blocks of groups, finds
the cuts among those, and asks for finer edges around the cuts until they are single groups' edges. Moving a cut by
less than a block moves the capacity by less than a block, so the best cuts lie in those windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.prefix import running_totals
from barlake.llm.store import materialize

BLOCKS, MAX_EDGES = 20_000, 200_000


def _greedy(edges: np.ndarray, lo: int, hi: int, shards: int, capacity: int) -> list[int] | None:
    """Edges at which a shard ends, filled one after another; None if `shards` don't do."""
    cuts, at = [], lo
    while hi - at > capacity:
        i = int(np.searchsorted(edges, at + capacity, "right")) - 1
        if edges[i] <= at or len(cuts) + 1 >= shards:
            return None
        at = int(edges[i])
        cuts.append(at)
    return cuts


def _least(edges: np.ndarray, lo: int, hi: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity for (lo, hi], by binary search, and its cuts."""
    if hi <= lo:
        return 0, []
    low, high = -(-(hi - lo) // shards) - 1, hi - lo
    while high - low > 1:
        middle = (low + high) // 2
        if _greedy(edges, lo, hi, shards, middle) is None:
            low = middle
        else:
            high = middle
    return high, _greedy(edges, lo, hi, shards, high) or []


def divide(edges: np.ndarray, shards: int, lo: int | None = None, hi: int | None = None) -> list[int]:
    """The cuts of minimax contiguous partition: edges are the positions between atomic groups, first and last included."""
    lo, hi = int(edges[0]) if lo is None else lo, int(edges[-1]) if hi is None else hi
    if shards <= 1 or hi <= lo:
        return []
    own = edges[(edges >= lo) & (edges <= hi)]
    sizes = np.diff(own)
    big = int(np.argmax(sizes))
    capacity, cuts = _least(own, lo, hi, shards)
    if sizes[big] * shards <= hi - lo or len(sizes) == 1:
        return cuts
    left, right = int(own[big]), int(own[big + 1])
    best = None
    for k in range(shards):
        rest = shards - 1 - k
        if (k == 0 and left > lo) or (rest == 0 and right < hi):
            continue
        worst = max(_least(own, lo, left, max(k, 1))[0], _least(own, right, hi, max(rest, 1))[0])
        best = min(best or (worst, k), (worst, k))
    if best is None or max(best[0], sizes[big]) > capacity:
        return cuts
    k = best[1]
    return [*divide(own, k, lo, left), *([left] if left > lo else []), *([right] if right < hi else []), *divide(own, shards - 1 - k, right, hi)]


def _cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    width = max(1, total // BLOCKS)

    def edges_of(part: DataFrame, width: int) -> np.ndarray:
        """Starts of blocks: groups that start in the same stretch of `width`; a group longer than that is alone."""
        block = part.groupBy(F.floor(F.col("start") / F.lit(float(width))).alias("b"), (F.col("size") > width).alias("big")).agg(F.min("start").alias("start"))
        return np.array([r[0] for r in block.select("start").collect()], np.int64)

    edges = np.unique(np.concatenate([edges_of(groups, width), [0, total]]))
    while True:
        cuts = divide(edges, shards)
        if width == 1 or not cuts:
            return cuts
        near = F.lit(False)
        reach = 8 * (shards + 1) * width
        for cut in cuts:
            near |= F.col("start").between(cut - reach, cut + reach)
        window = groups.where(near)
        if window.count() <= MAX_EDGES:
            return divide(np.unique(np.concatenate([edges, np.array([r[0] for r in window.select("start").collect()], np.int64)])), shards)
        width = max(1, width // 256)
        edges = np.unique(np.concatenate([edges, edges_of(window, width)]))


def shards_of(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, `size` (UTF-8 bytes and one), `text_crc32`, `shard` from 0, `slot` (gapless from 0 in its
    shard).

    A null text counts as an empty one. Equal texts share a shard, repeated rows too; within a group rows stand by
    id, nulls first. More shards than groups leave the last shards empty; an empty table gives no rows. Columns of
    docs besides id and text aren't read, whatever their names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.monotonically_increasing_id().alias("tag"))
    ordered = running_totals(materialize(slim, "sizes"), ["text_key", "doc_id", "tag"], ["size"])  # the tag deals rows of one text and id among tasks
    total = ordered.agg(F.sum("size")).first()[0] or 0
    groups = materialize(ordered.groupBy("text_key").agg(F.min("before_size").alias("start"), F.sum("size").alias("size")).drop("text_key"), "groups")
    cuts = _cuts(groups, total, shards) if total else []
    shard = sum((F.when(F.col("before_size") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")
    placed = ordered.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_row"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_row")).alias("slot"))
