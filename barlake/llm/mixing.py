"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share by weight of `volume` times all sizes, at most `most` times its own size; what is
above goes to the other sources by weight until none is above (water filling). Whole passes over a source (epochs)
come first. The rest is a weighted sample without replacement: each row draws an exponential key -ln(u) / w
from a hash of its id and text, w its quality weight, and rows are taken in ascending order of key until their sizes,
prefix-summed within the source, reach what the target still lacks; the last one is taken if its middle lies within.

Keys are sorted by range over (source, key, id, text, rest of the row, tag), so a source of any size is spread over as many
tasks as it needs, and so are rows of one id or rows that repeat; only rows that are alike in everything are told
apart by a tag that differs between runs, and for those it makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.prefix import running_totals
from barlake.llm.store import discard, materialize
from barlake.llm.textbytes import NONSPACE, pieces, runs, text_of

CYCLE, VOLUME, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix"
#: Characters that mark a text as less worth taking.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!", np.uint8))
#: Sources up to this number are joined by broadcast (some 40 bytes each).
BROADCAST_SOURCES = 1_000_000


def text_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, without its text, with `size` (words `[^\\x20\\x09-\\x0D]+`) and `quality` (0.1 to 1: the less of the bytes that are
    not white space are symbols, the higher). Null and empty texts have size 0 and quality 1."""
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "size", "quality")]
    schema = T.StructType([*kept, T.StructField("size", T.LongType()), T.StructField("quality", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, quality = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows)
            for piece in pieces(text_of(batch, text_col)):
                solid = NONSPACE[piece.data]
                starts, _ = runs(solid, piece.offsets)
                sizes[piece.lo : piece.hi] = np.diff(np.searchsorted(starts, piece.offsets))
                inner = np.concatenate([[0], np.cumsum(solid)])[piece.offsets]
                marks = np.concatenate([[0], np.cumsum(SYMBOLS[piece.data])])[piece.offsets]
                quality[piece.lo : piece.hi] = 0.1 + 0.9 * (1 - np.diff(marks) / np.maximum(np.diff(inner), 1))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in kept), pa.array(sizes), pa.array(quality)], names=schema.names)

    return docs.select(*(f.name for f in kept), text_col).mapInArrow(run, schema)


def targets(sizes: DataFrame, source_col: str = "source", *, cycle: tuple[float, ...] = CYCLE, volume: float = VOLUME, most: float = MOST) -> DataFrame:
    """One row per source: `source_rank`, `source_size`, `target`. Sources weigh as in `cycle`, repeating, in code point order with
    null last. Windows here run over one row a source."""
    sums = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("source_rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("source_rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    weighed = ranked.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(most)}).withColumn("level", F.col("cap") / F.col("w"))
    by = Window.orderBy("level", "source_rank")
    wanted = F.sum("source_size").over(Window.partitionBy()) * F.lit(volume)
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    tried = weighed.withColumn("try", (wanted - capped) / free)
    level = F.min(F.when(F.col("try") <= F.col("level") * (1 + 1e-12), F.col("level"))).over(Window.partitionBy())
    chosen = F.max(F.when(F.col("level") == F.col("first_level"), F.col("try"))).over(Window.partitionBy())
    return tried.withColumn("first_level", level).withColumn("water", chosen).select("source", "source_rank", "source_size", F.least(F.col("cap"), F.col("water") * F.col("w")).alias("target"))


def unit(drawn: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of a text."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), drawn)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _planned(docs: DataFrame, tag: Column, *, id_col: str, text_col: str, source_col: str, quality_col: str | None, cycle: tuple[float, ...], volume: float, most: float, seed: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    rest = [F.col(c).cast("string") if kind != "binary" else F.hex(c) for c, kind in docs.dtypes if c not in (id_col, text_col, source_col) and not c.startswith("__")]
    given = F.lit(None).cast("double") if quality_col is None else F.greatest(F.lit(1e-3), F.coalesce(F.col(quality_col).cast("double"), F.lit(1e-3)))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"), F.xxhash64(*rest, F.lit(0)).alias("rest"), given.alias("given"), tag.alias("tag"), text.alias("text"))
    drawn = text_sizes(named).withColumn("quality", F.coalesce("given", "quality")).drop("given")
    drawn = drawn.withColumn("key", -F.log(unit(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_md5")), seed)) / F.col("quality"))
    slim = materialize(drawn, "drawn")
    sources = materialize(targets(slim, cycle=cycle, volume=volume, most=most), "targets")
    few = sources.count() <= BROADCAST_SOURCES
    with_target = slim.join(F.broadcast(sources) if few else sources, slim["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    ordered = running_totals(with_target, ["source_rank", "key", "doc_id", "text_md5", "rest", "tag"], ["size"])
    bases = sources.select("source_rank", F.coalesce(F.sum("source_size").over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = ordered.join(F.broadcast(bases) if few else bases, "source_rank")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    rest_size = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = F.when((F.col("epochs") < most) & (F.col("before_size") - F.col("base") + F.col("size") / 2 <= F.col("rest_size")), 1).otherwise(0)
    discard(slim)
    return placed.withColumn("epochs", epochs.cast("long")).withColumn("rest_size", rest_size).withColumn("copies", F.col("epochs") + extra)


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, cycle: tuple[float, ...] = CYCLE, volume: float = VOLUME, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id, `source`, `size`, `quality`, `source_size`, `target`, `copies` (times that it is
    taken), `taken` (words, repeats counted).

    The weight is the share of characters that aren't symbols, or `quality_col` where given (null or under 0.001: 0.001). A null
    source is a source of its own; null and empty texts have size 0 and take nothing. Rows of one id or of none draw by their
    texts and are each counted; rows alike in id and text follow one another by the hash of their other columns. A source
    without words has target 0; an empty table gives no rows."""
    how = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "quality_col": quality_col, "cycle": cycle, "volume": volume, "most": most, "seed": seed}
    plan = _planned(docs, F.monotonically_increasing_id(), **how)
    return plan.select(F.col("doc_id").alias(id_col), "source", "size", "quality", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, cycle: tuple[float, ...] = CYCLE, volume: float = VOLUME, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, and without those that it doesn't take.

    Every row is judged by itself, whatever ids are null or repeat: rows are tagged in a table first, and the plan is joined on the tag.
    Ties, repeated rows, nulls and empty tables are as in `mixed`; columns of docs may have any names but `__tag` and `__copy`."""
    how = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "quality_col": quality_col, "cycle": cycle, "volume": volume, "most": most, "seed": seed}
    tagged = materialize(docs.withColumn("__tag", F.monotonically_increasing_id()), "tagged")
    plan = _planned(tagged, F.col("__tag"), **how).where("copies > 0").select(F.col("tag").alias("__tag"), F.col("copies").alias("__copy"))
    return tagged.join(plan, "__tag").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copy")))).select(*docs.columns)
