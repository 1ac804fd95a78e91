"""Symbol universes: building, snapshots, and what to load for each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.exprs import finite

#: Lower-case names of listings that aren't common shares.
EXCLUDED_NAMES = [r"\betfs?\b", r"\bfunds?\b", r"\bwarrants?\b", r"\brights?\b", r"\bunits?(?:,| each\b| consisting\b|$)", r"\bpreferred (?:stock|shares?)\b", r"\bdepositary\b", r"\bnotes? due\b", "%"]
DORMANT_DAYS = 30


def build_universe(rows: DataFrame, top_n: int = 3000) -> DataFrame:
    """(symbol, name, market_cap as text with commas[, sector]) to the top_n common shares by value; the largest cap of a symbol counts,
    then the lesser name.

    Texts are trimmed. Empty, unreadable and non-positive caps, symbols with ^ or ~, and names of excluded listings are dropped; a
    null name is kept. A missing sector is an empty text."""
    cap = F.expr("try_cast(nullif(replace(market_cap, ',', ''), '') AS DOUBLE)")
    sector = F.coalesce(F.trim("sector"), F.lit("")) if "sector" in rows.columns else F.lit("")
    tidy = rows.select(F.trim("symbol").alias("symbol"), F.trim("name").alias("name"), cap.alias("market_cap"), sector.alias("sector"))
    listed = F.coalesce(F.lower("name").rlike("|".join(EXCLUDED_NAMES)), F.lit(False))
    good = tidy.where(finite("market_cap") & (F.col("market_cap") > 0) & ~F.col("symbol").rlike(r"[\^~]") & ~listed)
    best = Window.partitionBy("symbol").orderBy(F.desc("market_cap"), "name", "sector")
    one = good.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    return one.orderBy(F.desc("market_cap"), "symbol").limit(top_n)


def latest_snapshot(universe: DataFrame) -> DataFrame:
    newest = universe.agg(F.max("as_of").alias("as_of"))  # one row
    return universe.join(F.broadcast(newest), "as_of", "left_semi")


def all_symbols(universe: DataFrame) -> DataFrame:
    """Every symbol of any snapshot with its greatest cap."""
    return universe.groupBy("symbol").agg(F.max("market_cap").alias("market_cap"))


def last_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


def ingest_plan(symbols: DataFrame, last: DataFrame, meta: DataFrame, *, today: str, start: str, dormant_days: int = DORMANT_DAYS) -> DataFrame:
    """What to load for each symbol: `backfill` from the start where nothing or no covered start is stored, nothing (`dormant`) where the
    last bar is older than dormant_days, else the `tail` from the last bar on."""
    known = symbols.join(last.select("symbol", "last_date"), "symbol", "left").join(meta.select("symbol", F.col("from_date").alias("covered")), "symbol", "left")
    new = F.col("last_date").isNull() | F.col("covered").isNull() | (F.col("covered") > F.lit(start).cast("date"))
    old = F.col("last_date") < F.date_sub(F.lit(today).cast("date"), dormant_days)
    return known.select("symbol", F.when(new, "backfill").when(old, "dormant").otherwise("tail").alias("action"), F.when(new, F.lit(start).cast("date")).when(old, None).otherwise(F.col("last_date")).alias("from_date"))


def classify_missing(plan: DataFrame, last: DataFrame, returned: DataFrame) -> DataFrame:
    """Planned symbols that came back empty: `skipped` where the stored bars cover the planned start, else `failed`."""
    missing = plan.where("action <> 'dormant'").join(returned.select("symbol"), "symbol", "left_anti").join(last.select("symbol", "last_date"), "symbol", "left")
    return missing.select("symbol", F.when(F.col("last_date") >= F.col("from_date"), "skipped").otherwise("failed").alias("outcome"))
