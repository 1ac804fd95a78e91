"""Incremental line dedup that can be undone.

The state of a corpus is three tables:

- references (key, doc_id, part): one row for each document row that holds a line of that key; part is the CRC-32 of the row's
  text, so that rows without an id, or of one id, don't gather in one group,
- counts (key, shard, refs, first_doc, last_doc): the exact reference count of each key, with its least and greatest id,
- filters (shard, filter): per shard a cuckoo filter of the keys that two or more documents hold.

Keys are dealt to shards by hash. A line is looked up in its shard's filter first; only lines that the filter knows
are joined to the exact counts, so false positives cost a lookup and never a line. The filters are broadcast while their
summed bytes, which are counted, stay under BROADCAST_BYTES; beyond, references meet the filter of their shard in groups of shard
and salt of about GROUP_ROWS rows. Keys with more than a HEAVY_PARTS-th of all references, of which there are fewer than
HEAVY_PARTS, are joined by broadcast, so that no task gets all lines of a key. Inserting documents adds
references, raises counts and inserts keys that came to be shared; deleting documents takes references away, lowers
counts, and deletes from the filters the keys that are no longer shared, which a cuckoo filter (unlike a Bloom filter)
permits. Deduplicating after a deletion gives what deduplicating without those documents would have given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import materialize
from barlake.llm.textbytes import mix, text_of

MIN_POINTS = 10
#: Keys a shard's filter is meant for, filter bytes up to which all filters go to every task; see above.
KEYS_PER_SHARD, BROADCAST_BYTES = 100_000, 64 << 20
GROUP_ROWS, HEAVY_PARTS = 500_000, 10_000
_STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for a null id: after all others.
NULL_ID = (1 << 63) - 1


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; inserts move entries where both are full."""

    SLOTS, KICKS = 4, 500

    def __init__(self, keys: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(keys, 1) / (self.SLOTS * 0.85)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (hashes & mask).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ mix(prints.astype(np.uint64))) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(hashes)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if some entry found no place: the caller makes a larger filter."""
        rng = np.random.default_rng(len(hashes))
        for print_, bucket in zip(*(x.tolist() for x in self.places(hashes)[:2]), strict=True):
            for _ in range(self.KICKS):
                other = int(self.other(np.array([bucket]), np.array([print_], np.uint16))[0])
                for b in (bucket, other):
                    free = np.flatnonzero(self.table[b] == 0)
                    if len(free):
                        self.table[b, free[0]] = print_
                        break
                else:
                    slot = int(rng.integers(self.SLOTS))
                    print_, self.table[other, slot] = int(self.table[other, slot]), print_
                    bucket = other
                    continue
                break
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one entry for each key, which must have been inserted."""
        for print_, *buckets in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            for b in buckets:
                at = np.flatnonzero(self.table[b] == print_)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        size = len(hashes)
        while True:
            filled = cls(size)
            if filled.insert(hashes):
                return filled
            size *= 2


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """64 bits of 16-byte keys."""
    return mix(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0].copy())


def line_key(line: bytes) -> bytes | None:
    """The key's 128-bit digest; None where the key is too short to count."""
    key = line.strip(_STRIP).translate(_LOWER)
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


REFERENCES = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("part", T.LongType())])


def _part(text_col: str):
    return F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def line_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, part) once for each row of docs and key that its lines hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            counts = []
            for text in pc.cast(text_of(batch), pa.binary()).to_pylist():
                own = {line_key(line) for line in text.split(b"\n")} if text else set()
                own.discard(None)
                keys += own
                counts.append(len(own))
            ids, parts = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), counts) for c in ("doc_id", "part"))
            whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], names=REFERENCES.names)
            for lo in range(0, whole.num_rows, 10_000):
                yield whole.slice(lo, 10_000)

    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), _part(text_col).alias("part"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, REFERENCES)


@dataclass
class LineIndex:
    """State of incremental line dedup; every change gives a new state and leaves the old one as it was."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def _counted(references: DataFrame) -> DataFrame:
        return references.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    @staticmethod
    def _sharded(counts: DataFrame, shards: int) -> DataFrame:
        return counts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    @classmethod
    def build(cls, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """The state of a corpus. Null and empty texts hold no key; rows of one id, and rows without one, count as one document; a row
        that repeats is one reference more. An empty table makes an empty state. Other columns aren't read."""
        references = materialize(line_references(docs, id_col, text_col), "references")
        counts = materialize(cls._counted(references), "counts")
        shared = counts.where("first_doc < last_doc").count()
        shards = max(1, -(-shared // keys_per_shard))
        counts = cls._sharded(counts, shards)
        filters = materialize(counts.where("first_doc < last_doc").groupBy("shard").applyInPandas(_build_filter, "shard int, filter binary"), "filters")
        return cls(references, counts, filters, shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The state with these documents. One whose id is there already takes its place; rows without an id are added to those
        without. Odd rows are as in `build`."""
        new = materialize(line_references(docs, id_col, text_col), "references")
        ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        old = self.references.join(ids, "doc_id", "left_semi")
        touched = new.select("key").unionByName(old.select("key")).distinct()
        return self._changed(materialize(self.references.join(ids, "doc_id", "left_anti").unionByName(new), "references"), touched)

    def delete(self, docs: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The state without the documents of these ids; ids that it doesn't have change nothing, a null one stands for all rows without."""
        ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        touched = self.references.join(ids, "doc_id", "left_semi").select("key").distinct()
        return self._changed(materialize(self.references.join(ids, "doc_id", "left_anti"), "references"), touched)

    def _changed(self, references: DataFrame, touched: DataFrame) -> LineIndex:
        touched = materialize(touched, "touched")
        again = self._counted(references.join(touched, "key", "left_semi"))
        counts = self._sharded(materialize(self.counts.drop("shard").join(touched, "key", "left_anti").unionByName(again), "counts"), self.shards)
        old, new = (x.join(touched, "key", "left_semi").where("first_doc < last_doc").select("key", "shard") for x in (self.counts, counts))
        moves = new.join(old, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(old.join(new, "key", "left_anti").withColumn("add", F.lit(False)))
        filters = moves.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_change_filter, "shard int, filter binary")
        filters = materialize(filters, "filters")
        full = filters.where("filter IS NULL").select("shard")
        rebuilt = counts.where("first_doc < last_doc").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build_filter, "shard int, filter binary")
        return LineIndex(references, counts, materialize(filters.where("filter IS NOT NULL").unionByName(rebuilt), "filters"), self.shards)

    def known(self, broadcast_bytes: int = BROADCAST_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
        """The references whose keys the filters know."""
        bytes_ = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        rows = self._sharded(self.references.select(*REFERENCES.names), self.shards)
        if bytes_ <= broadcast_bytes:
            filters = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}  # broadcast_bytes at most
            return rows.mapInArrow(_known(rows.sparkSession.sparkContext.broadcast(filters)), REFERENCES)
        salts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("salts"))  # a row a shard
        salts = materialize(salts.join(self.filters, "shard"), "salts")
        dealt = rows.join(F.broadcast(salts.select("shard", "salts")), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "part", "key"), F.col("salts")).cast("int"))
        filters = salts.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return dealt.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(_known_in_group, REFERENCES)

    def dropped(self, broadcast_bytes: int = BROADCAST_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
        """(doc_id, part, key) of lines that a document loses, since a lesser id holds the key."""
        known = materialize(self.known(broadcast_bytes, group_rows), "known")
        shared = self.counts.where("first_doc < last_doc").select("key", "refs", "first_doc")
        total = self.counts.agg(F.sum("refs")).first()[0] or 0
        heavy = materialize(shared.where(F.col("refs") > max(total // HEAVY_PARTS, 1)).select("key", "first_doc"), "heavy")  # under HEAVY_PARTS rows
        light = shared.where(F.col("refs") <= max(total // HEAVY_PARTS, 1)).select("key", "first_doc")
        both = known.join(F.broadcast(heavy), "key").unionByName(known.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key"))
        return both.where("first_doc < doc_id").select("doc_id", "part", "key")


def _build_filter(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [CuckooFilter.build(key_hashes([bytes(k) for k in rows["key"]])).to_bytes()]})


def _change_filter(moves: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A filter that can't take a key more is null here and built anew."""
    shard = int((moves if len(moves) else old)["shard"].iloc[0])
    data: bytes | None = bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(1000).to_bytes()
    if len(moves):
        changed = CuckooFilter.of_bytes(data)
        added = moves["add"].to_numpy(bool)
        keys = [bytes(k) for k in moves["key"]]
        away = [k for k, new in zip(keys, added, strict=True) if not new]
        new = [k for k, new in zip(keys, added, strict=True) if new]
        if away:
            changed.delete(key_hashes(away))
        data = changed.to_bytes() if not new or changed.insert(key_hashes(new)) else None
    return pd.DataFrame({"shard": [shard], "filter": [data]})


def _known(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {shard: CuckooFilter.of_bytes(data) for shard, data in filters.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            hashes = key_hashes(batch.column(0).to_pylist())
            hit = np.zeros(batch.num_rows, bool)
            for shard, filled in own.items():
                at = np.flatnonzero(shards == shard)
                hit[at] = filled.contains(hashes[at])
            yield batch.select(REFERENCES.names).filter(pa.array(hit))

    return run


def _known_in_group(rows: pa.Table, filters: pa.Table) -> pa.Table:
    """Rows of one shard and salt that the shard's filter knows."""
    rows = rows.select(REFERENCES.names)
    if not rows.num_rows or not filters.num_rows:
        return rows.slice(0, 0)
    return rows.filter(pa.array(CuckooFilter.of_bytes(filters.column("filter")[0].as_py()).contains(key_hashes(rows.column("key").to_pylist()))))


def deduplicated(docs: DataFrame, index: LineIndex | None = None, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with its text freed of lines that a document of lesser id in the index holds, and `n_lines` (before), `n_dropped`.

    Keys are lines stripped of ASCII white space at both ends, with A-Z in lower case; keys under 10 code points are left
    alone. A null or empty text is one empty line and stays empty (null becomes empty). Rows of one id are one
    document: none of them loses a line to another. A null id stands after all others. Very long texts are taken whole, an empty
    table gives no rows, and other columns pass through. `how` goes to `LineIndex.dropped`."""
    index = index or LineIndex.build(docs, id_col=id_col, text_col=text_col)
    lost = index.dropped(**how).groupBy(F.col("doc_id").alias("__id"), F.col("part").alias("__part")).agg(F.collect_set("key").alias("__lost"))
    base = docs.drop("n_lines", "n_dropped").withColumn(text_col, F.col(text_col).cast("string"))
    own = base.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__part": _part(text_col)})
    joined = own.join(lost, ["__id", "__part"], "left").drop("__id", "__part")
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, counts, gone = [], [], []
            for text, own in zip(pc.cast(batch.column(names.index(text_col)), pa.binary()).to_pylist(), batch.column(names.index("__lost")).to_pylist(), strict=True):
                text = text or b""
                lines = text.split(b"\n")
                if own:
                    lost_keys = set(own)
                    kept = [line for line in lines if line_key(line) not in lost_keys]
                    texts.append(b"\n".join(kept))
                    gone.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    gone.append(0)
                counts.append(len(lines))
            new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(names.index(n)) for n in schema.names], names=schema.names)

    return joined.mapInArrow(run, schema)
