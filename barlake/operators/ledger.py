"""Reading the experiments ledger: reference runs, what is done, what is pending, and who may be promoted."""

from __future__ import annotations

import json
from itertools import product
from statistics import NormalDist

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.exprs import EPSILON, EVENT, canonical_params, tail_quantile
from barlake.operators.exits import halves_by

MONTHS, TOP_N = 12, 20
LIFT_BAND, REFERENCE_SHARE = 0.1, 0.9
ALPHA, LIFT_ERROR, BAND_FLOOR = 0.05, 0.08, 0.27
MAX_FAMILY = 64


def _json(name: str, column: str = "params"):
    return F.get_json_object(column, f"$.{name}")


def standard(ledger: DataFrame, months: int = MONTHS, top_n: int = TOP_N) -> DataFrame:
    """Touch-era rows of the standard window; unreadable JSON doesn't count."""
    return ledger.where((F.col("event") == EVENT) & (_json("months") == str(months)) & (_json("top_n") == str(top_n)))


def own_config(ledger: DataFrame) -> DataFrame:
    """Rows without parameters of their own."""
    given = _json("strategy_params")
    return ledger.where(given.isNull() | given.isin("{}", "null"))


def latest_standard_experiment(ledger: DataFrame) -> DataFrame:
    """Per strategy its newest standard run of the default configuration."""
    newest = Window.partitionBy("strategy").orderBy(F.desc("run_ts"), F.desc("id"))
    return own_config(standard(ledger)).withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def reference_run(ledger: DataFrame, daily: DataFrame, share: float = REFERENCE_SHARE) -> DataFrame:
    """Per strategy the newest default run among those nearly as long as its longest."""
    counted = daily.groupBy(F.col("seq").alias("id")).agg(F.count_distinct("target_date").alias("n_days"))
    era = ledger.where(F.col("event") == EVENT).join(counted, "id")
    sized = era.withColumn("best", F.max("n_days").over(Window.partitionBy("strategy")))
    order = Window.partitionBy("strategy").orderBy(F.desc(F.col("n_days") >= share * F.col("best")), F.desc("run_ts"), F.desc("id"))
    return own_config(sized.where(_json("months").isNotNull())).withColumn("n", F.row_number().over(order)).where("n = 1").select("strategy", "id", "n_days")


def recorded_configs(ledger: DataFrame) -> DataFrame:
    return standard(ledger).select("strategy", canonical_params(F.coalesce(_json("strategy_params"), F.lit("{}"))).alias("params_key")).distinct()


def param_grid(spark: SparkSession, space: dict[str, dict[str, list]]) -> DataFrame:
    """Every combination of each strategy's values as JSON, in a fixed order; at most MAX_FAMILY."""
    rows = []
    for strategy in sorted(space):
        keys = sorted(space[strategy])
        for values in product(*(space[strategy][k] for k in keys)):
            rows.append((strategy, json.dumps(dict(zip(keys, values, strict=True))), len(rows)))
    if len(rows) > MAX_FAMILY:
        raise ValueError(f"{len(rows)} combinations; widening the search needs a wider promotion band first")
    return spark.createDataFrame(rows, "strategy string, params string, place int")


def pending_configs(queue: DataFrame, grid: DataFrame, ledger: DataFrame, budget: int) -> DataFrame:
    """What to run next, at most `budget` configurations (strategy, params, place, `origin`): those of the queue (strategy, params, place) that the ledger
    doesn't hold, in its order, then those of the grid that neither the ledger nor the queue holds. None comes twice: of equal ones, by canonical
    parameters, the first counts. Params that aren't an object are no configuration."""
    key = ["strategy", "params_key"]
    sides = [side.select("strategy", "params", "place", canonical_params("params").alias("params_key"), F.lit(origin).alias("origin"), F.lit(n).alias("turn")) for n, (side, origin) in enumerate(((queue, "queue"), (grid, "grid")))]
    first = Window.partitionBy(*key).orderBy("turn", "place")
    once = sides[0].unionByName(sides[1]).where("params_key IS NOT NULL").withColumn("n", F.row_number().over(first)).where("n = 1")
    return once.join(recorded_configs(ledger), key, "left_anti").orderBy("turn", "place").limit(budget).select("strategy", "params", "place", "origin")


def promotion_band(n_trials: int) -> float:
    """Margin in lift that the best of so many trials must clear (Bonferroni)."""
    return max(BAND_FLOOR, round(NormalDist().inv_cdf(1 - ALPHA / (2 * max(n_trials, 1))) * LIFT_ERROR, 4))


def family_correction(n_trials: int) -> float:
    one = NormalDist().inv_cdf(1 - ALPHA / 2)
    return round(NormalDist().inv_cdf(1 - ALPHA / (2 * max(n_trials, 1))) / one, 4)


def _z(n: str) -> Column:
    """The quantile that the best of n trials is held against."""
    return tail_quantile(f"({ALPHA}D / (2 * greatest({n}, 1)))")


def with_band(sized: DataFrame, n: str = "n") -> DataFrame:
    """sized (one row a family) with the `band` of exactly its number of trials."""
    return sized.withColumn("band", F.greatest(F.lit(BAND_FLOOR), F.round(_z(n) * LIFT_ERROR, 4)))


def with_correction(sized: DataFrame, n: str = "n") -> DataFrame:
    """sized with `correction`: by how much a threshold for one comparison widens for the best of n."""
    return sized.withColumn("correction", F.round(_z(n) / _z("1"), 4))


def with_forward_margin(sized: DataFrame, single: str = "band", n: str = "n") -> DataFrame:
    """sized with `forward_margin`: the threshold in the column `single` for the best of n challengers that are shadowed at once."""
    return with_correction(sized, n).withColumn("forward_margin", F.round(F.col(single) * F.col("correction"), 4))


def daily_precision(daily: DataFrame) -> DataFrame:
    """daily (seq, target_date, hit) to (id, target_date, precision)."""
    return daily.where("hit IS NOT NULL").groupBy(F.col("seq").alias("id"), "target_date").agg(F.avg(F.col("hit").cast("double")).alias("precision"))


def promotion_verdicts(batches: DataFrame, champion: DataFrame, family: DataFrame, daily: DataFrame) -> DataFrame:
    """Of each batch (`batch`, id, lift) the best run (ties: the lesser id): does it beat the champion (one row: id, lift) by the band of the
    family (one row: n), and hold in both halves of the days that they share; `promoted` if both.

    Null lifts are never best. Without a champion no row comes out."""
    first = Window.partitionBy("batch").orderBy(F.desc("lift"), "id")
    best = batches.where("lift IS NOT NULL").withColumn("n", F.row_number().over(first)).where("n = 1").select("batch", "id", "lift")
    than = champion.select(F.col("id").alias("champion"), F.col("lift").alias("champion_lift")).join(with_band(family).select("band"), F.lit(True))  # one row
    met = best.join(F.broadcast(than), F.lit(True))
    by_day = daily_precision(daily)
    own = by_day.join(met.select("id"), "id", "left_semi")
    theirs = by_day.join(F.broadcast(than.select(F.col("champion").alias("id"))), "id", "left_semi").drop("id")
    halves = halves_by(own, theirs)
    beats = F.coalesce(F.col("lift") >= F.col("champion_lift") + F.col("band") - EPSILON, F.lit(False))
    judged = met.join(halves.select("id", "holds"), "id", "left").withColumns({"beats": beats, "holds": F.coalesce("holds", F.lit(False))})
    return judged.select("batch", "id", "lift", "band", "beats", "holds", (F.col("beats") & F.col("holds")).alias("promoted"))


def _judged_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of the JSON lists in the files at path (strategy, params, note, place, sound); places go on from file to file by name."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    items = files.select("file", F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("at", "item"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = items.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    items = items.join(F.broadcast(starts), "file").select((F.col("start") + F.col("at")).cast("int").alias("place"), "item")

    def kind(name: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(try_parse_json(item), '$.{name}', 'variant'))")

    strategy, params = F.get_json_object("item", "$.strategy"), F.get_json_object("item", "$.params")
    sound = F.coalesce((kind("strategy") == "STRING") & (strategy != "") & (params.isNull() | kind("params").startswith("OBJECT")), F.lit(False))
    note = F.coalesce(F.get_json_object("item", "$.note"), F.lit(""))
    return items.select(strategy.alias("strategy"), F.coalesce(params, F.lit("{}")).alias("params"), note.alias("note"), "place", sound.alias("sound"))


def load_queue(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Entries (strategy, params as JSON, note, place) of a queue, a JSON list in a file, or in several that are read by name, and how many are
    malformed: no text under strategy, or params that aren't an object. A file that holds no list has no entries; a missing file raises."""
    judged = _judged_items(spark, path)
    return judged.where("sound").select("strategy", "params", "note", "place"), judged.where("NOT sound").count()


ROSTER = "place int, strategy string, params string, note string, challenger string, status string"


def load_roster(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """The entries of a roster file (place, strategy, params, note, `challenger`, `status`): `malformed` ones, which don't count against the cap, the first
    `cap` sound ones `kept`, and the others `dropped`. A challenger is its strategy and canonical parameters.

    A missing file, and one that holds no list, has no entries: then nothing is shadowed."""
    try:
        judged = _judged_items(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], ROSTER)
    nth = F.row_number().over(Window.partitionBy("sound").orderBy("place"))  # one roster
    status = F.when(~F.col("sound"), "malformed").when(nth <= cap, "kept").otherwise("dropped")
    named = judged.withColumn("params", F.when(F.col("sound"), canonical_params("params"))).withColumn("status", status)
    challenger = F.when(F.col("sound"), F.concat_ws(" ", "strategy", "params"))
    return named.select("place", F.when(F.col("sound"), F.col("strategy")).alias("strategy"), "params", "note", challenger.alias("challenger"), "status")


def shadow_challengers(log: DataFrame) -> DataFrame:
    """Every challenger of a shadow log (challenger, strategy, params, signal_date, event) with its touch-era signal days: number, first and last. A
    challenger with archived days only is there with none."""
    day = F.when(F.col("event") == EVENT, F.col("signal_date"))
    return log.groupBy("challenger", "strategy", "params").agg(F.count_distinct(day).alias("touch_days"), F.min(day).alias("first_touch"), F.max(day).alias("last_touch"))


def shadow_signal_dates(log: DataFrame) -> DataFrame:
    """(challenger, signal_date) of the touch era: the days whose outcomes a challenger waits for or has."""
    return log.where(F.col("event") == EVENT).select("challenger", "signal_date").distinct()


def compare_verdict(a: DataFrame, b: DataFrame, band: float = LIFT_BAND) -> DataFrame:
    """Side by side lifts of two one-row metric frames (lift), and the winner outside the noise band."""
    both = a.select(F.col("lift").alias("lift_a")).join(b.select(F.col("lift").alias("lift_b")), F.lit(True))
    gap = F.col("lift_a") - F.col("lift_b")
    verdict = F.when(F.col("lift_a").isNull() | F.col("lift_b").isNull(), "undecided").when(gap == 0, "tie").when(F.abs(gap) < band - EPSILON, "within_noise").when(gap > 0, "a").otherwise("b")
    return both.withColumn("verdict", verdict)
