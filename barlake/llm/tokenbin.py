"""Token ids in length-delimited binary files, with a separate offset index.

A data file holds one record a document, in ascending order of id:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the 8 length bytes
    payload  the ids, little-endian, 2 or 4 bytes each (`width`)
    check    4 bytes: masked CRC-32 of the payload

A masked checksum is the CRC rotated right by 15 bits plus 0xA282EAD8, so that a checksum stored inside other
checksummed data is harmless. The index file beside it holds, for each record, 32 bytes, little-endian: the record's offset,
its payload's length, the document's id (signed) and 1, or 0 for both where it has no id. So a reader can fetch records
in any shuffled order, or by id, without a scan. The manifest, a small table in the shared folder, names the files in order with
their counts.

Each attempt at a task writes files under a name of its own, and nothing is moved or replaced. The manifest's rows are committed
by Spark, one attempt a task, so it names whole files of the attempts that count; what a lost executor leaves is named by
no manifest and goes with the folder.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.store import fresh_path, materialize, row_count_tasks
from barlake.llm.textbytes import text_of

MASK_DELTA = 0xA282EAD8
END_ID = 2
ROWS_PER_FILE = 50_000
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("id", "<i8"), ("known", "<u8")])
#: Entries a worker keeps of chunk -> ids and of word -> ids in each of two generations (some 150 bytes an entry).
CACHE_CHUNKS, CACHE_WORDS = 500_000, 300_000
FLUSH_BYTES = 4 << 20
#: Letters below this code point compose and change case one by one, alike in Python and in the tokenizer (but for U+0130).
LATIN_END, DOTTED_I = "\u0250", "\u0130"


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, the others in order from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


_PRINTABLE = _printable_bytes()
#: Letters (or what lies beyond ASCII), then ASCII marks; not the apostrophe nor <, which begin words of their own.
_WORD_AND_MARKS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:;=-@\[-`{-~]*)")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, offset: int = 0) -> bytes:
    """The payload of the record at offset; ValueError where a checksum doesn't agree."""
    head = bytes(data[offset : offset + 8])
    if len(head) < 8 or struct.unpack("<I", data[offset + 8 : offset + 12])[0] != masked_crc(head):
        raise ValueError(f"bad length at {offset}")
    n = struct.unpack("<Q", head)[0]
    payload = bytes(data[offset + 12 : offset + 12 + n])
    if len(payload) < n or struct.unpack("<I", data[offset + 12 + n : offset + 16 + n])[0] != masked_crc(payload):
        raise ValueError(f"bad payload at {offset}")
    return payload


#: Parts of a tokenizer file for which ids can be found chunk by chunk: fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_chunks(model: bytes) -> bool:
    """Does this tokenizer file drop white space, merge nothing across it and spell Latin words as ChunkIds does? Any other file's
    texts are encoded whole."""
    parts = json.loads(model)
    plain = all(parts.get(k) is None for k in ("truncation", "padding")) and parts.get("normalizer") == NORMALIZER and parts.get("pre_tokenizer") == PRE_TOKENIZER
    marked = all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in parts.get("added_tokens", []))
    merges = parts["model"]
    return plain and marked and merges["type"] == "BPE" and not merges.get("dropout")


class ChunkIds(dict):
    """chunk of bytes between ASCII white space -> its ids as bytes.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of its chunks in order.
    A chunk of Latin letters is one word to the merge model, in lower case and with its bytes as printable characters; the
    marks after it are a word of their own. All other chunks go through the whole tokenizer."""

    def __init__(self, tokenizer, width: int):
        super().__init__()
        self.tokenizer, self.model, self.code = tokenizer, tokenizer.model, {2: "H", 4: "I"}[width]
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.older_words.get(word)
            if found is None:
                found = self._pack([t.id for t in self.model.tokenize(word.decode("latin-1").translate(_PRINTABLE))])
            if len(self.words) >= CACHE_WORDS:
                self.older_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def _chunk(self, chunk: bytes) -> bytes:
        split = _WORD_AND_MARKS.fullmatch(chunk)
        if not split:
            return self._encode(chunk.decode("utf-8", "replace"))
        core, mark = split.groups()
        if core.isalpha():
            word = core.lower()
        else:
            text = core.decode("utf-8", "replace")
            if not (text.isalpha() and max(text) < LATIN_END and DOTTED_I not in text and is_normalized("NFC", text)):
                return self._encode(chunk.decode("utf-8", "replace"))
            word = text.lower().encode()
        if not mark:
            return self._word(word)
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self._encode(mark.decode())
        return self._word(word) + self.marks[mark]

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._chunk(chunk)
        if len(self) >= CACHE_CHUNKS:  # what is used again comes back from the older generation
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found


class WholeIds:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, tokenizer, width: int):
        self.tokenizer, self.width = tokenizer, width

    def of(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, f"<u{self.width}").tobytes()


_LOADED: dict[tuple[str, int], ChunkIds | WholeIds] = {}


def _chunk_ids(name: str, shipped: Broadcast, width: int) -> ChunkIds | WholeIds:
    """One tokenizer a worker process, kept over its tasks."""
    if (name, width) not in _LOADED:
        from tokenizers import Tokenizer

        kind = ChunkIds if by_chunks(shipped.value) else WholeIds
        _LOADED[name, width] = kind(Tokenizer.from_buffer(shipped.value), width)
    return _LOADED[name, width]


def encode(text: bytes, ids: ChunkIds | WholeIds) -> bytes:
    return ids.of(text) if isinstance(ids, WholeIds) else b"".join(map(ids.__getitem__, text.split()))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("data_path", T.StringType()), ("index_path", T.StringType()), ("width", T.IntegerType()), ("n_records", T.LongType()), ("n_tokens", T.LongType()))])


def write_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, vocabulary: int | None = None, path: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Tokenise every whole text, write data and index files to `path` (a new folder in the shared one) and return the manifest.

    `tokenizer_path` is a tokenizer file on the driver (a few megabytes), which is broadcast. Rows are dealt by range of id,
    nulls first; rows of one id, or of none, follow one another by a hash of their text and are dealt among tasks too. Ids are
    read as longs. A null or empty text is a record of the end id alone, and a repeated row is a record each time. An empty table
    gives files without records. Other columns aren't read. Ids of tokens take 2 bytes where the vocabulary fits, else 4."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    root = (path or fresh_path(spark, "tokens")).rstrip("/")
    model = Path(tokenizer_path).read_bytes()
    if vocabulary is None:
        vocabulary = Tokenizer.from_buffer(model).get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
    end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
    name, shipped = hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)
    tasks = row_count_tasks(docs.count(), rows_per_file, spark)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("tag"))
    types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, ids = context.partitionId(), _chunk_ids(name, shipped, width)
        own = f"{root}/part-{part:06d}-attempt-{context.taskAttemptId()}"
        store, file = _place(own)
        store.create_dir(file.rpartition("/")[0], recursive=True)
        records = tokens = at = 0
        with store.open_output_stream(f"{file}.data") as data, store.open_output_stream(f"{file}.index") as index:
            held = io.BytesIO()
            for batch in batches:
                lengths = []
                for text in pc.cast(text_of(batch), pa.binary()).to_pylist():
                    payload = encode(text or b"", ids) + end
                    held.write(frame(payload))
                    lengths.append(len(payload))
                    if held.tell() >= FLUSH_BYTES:
                        data.write(held.getvalue())
                        held.seek(0)
                        held.truncate()
                entries = np.zeros(len(lengths), ENTRY)
                entries["length"] = lengths
                steps = np.cumsum(entries["length"] + np.uint64(16))
                entries["offset"] = at + steps - entries["length"] - 16
                entries["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                entries["id"] = batch.column(0).fill_null(0).to_numpy()
                index.write(entries.tobytes())
                at += int(steps[-1]) if lengths else 0
                records += len(lengths)
                tokens += sum(lengths) // width
            data.write(held.getvalue())
        values = (part, f"{own}.data", f"{own}.index", width, records, tokens)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=MANIFEST.names)

    order = ["doc_id", "text_hash", "tag"]
    return materialize(slim.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "manifest")


def read_index(index_path: str) -> np.ndarray:
    """A file's index as an array with the fields of ENTRY."""
    store, index = _place(index_path)
    with store.open_input_file(index) as f:
        return np.frombuffer(f.read(), ENTRY)


def read_records(data_path: str, places: np.ndarray) -> Iterator[bytes]:
    """Payloads of one file in the order of its index, each verified. The file is read in stretches."""
    store, data = _place(data_path)
    begins, ends = places["offset"].astype(np.int64), (places["offset"] + places["length"]).astype(np.int64) + 16
    with store.open_input_file(data) as f:
        lo = 0
        while lo < len(places):
            begin = int(begins[lo])
            hi = max(lo + 1, int(np.searchsorted(begins, begin + FLUSH_BYTES)))
            f.seek(begin)
            block = memoryview(f.read(int(ends[hi - 1]) - begin))
            for offset, n in zip(begins[lo:hi].tolist(), places["length"][lo:hi].tolist(), strict=True):
                payload = unframe(block, offset - begin)
                if len(payload) != n:
                    raise ValueError(f"index and file disagree at {offset} of {data_path}")
                yield payload
            lo = hi


def read_record(data_path: str, index_path: str, record: int) -> bytes:
    """One payload by its number, with two short reads: shuffled reading."""
    store, data = _place(data_path)
    with store.open_input_file(_place(index_path)[1]) as f:
        f.seek(ENTRY.itemsize * record)
        place = np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]
    with store.open_input_file(data) as f:
        f.seek(int(place["offset"]))
        return unframe(f.read(int(place["length"]) + 16))


def token_digest(manifest: DataFrame) -> DataFrame:
    """Read the files back: a row per record with `doc_id`, `start`, `n_tokens`, `ids_crc32`, and where it lies (`data_path`,
    `index_path`, `record`). A task reads one file. A manifest without records gives no rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spark: SparkSession = manifest.sparkSession
    n = max(1, manifest.count())
    tasks = max(1, min(n, 10 * spark.sparkContext.defaultParallelism))
    longs = ("doc_id", "start", "n_tokens", "ids_crc32")
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in longs), *(T.StructField(x, T.StringType()) for x in ("data_path", "index_path")), T.StructField("record", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = read_index(row["index_path"])
                crcs = [zlib.crc32(np.frombuffer(payload, f"<u{row['width']}").astype("<u4").tobytes()) for payload in read_records(row["data_path"], places)]
                counts = places["length"].astype(np.int64) // row["width"]
                ids = pa.array(places["id"].copy(), mask=places["known"] == 0)
                paths = [pa.array([row[c]] * len(places), pa.string()) for c in ("data_path", "index_path")]
                whole = pa.RecordBatch.from_arrays([ids, pa.array(row["base"] + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64()), *paths, pa.array(np.arange(len(places)))], names=schema.names)
                for lo in range(0, whole.num_rows, 10_000):
                    yield whole.slice(lo, 10_000)

    return files.select("part", "data_path", "index_path", "width", "base").repartition(tasks).mapInArrow(run, schema)
