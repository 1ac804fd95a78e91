"""Strategies as Spark ML pipelines, walk-forward validation and prediction."""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.exprs import EVENT, LIQUIDITY
from barlake.operators.calibration import auc, benchmark_metrics, calibration_report, pick_calibration
from barlake.operators.features import FEATURES, formula_score, select_top
from barlake.operators.ledger import compare_verdict
from barlake.sources.shared import stored
from barlake.sources.writers import record_experiment, replace_slice

MIN_TRAIN_ROWS = 10_000
#: Training rows a task of a boosting round or a fold's fit, of which there are many short ones.
ROWS_PER_TASK = 100_000
#: Folds fitted at a time: a fit is a chain of short jobs, which leave cores free. Each holds its training rows in the executors' cache.
FOLDS_AT_ONCE = 4
LABEL = "did_2pct_next"


def month_folds(frame: DataFrame, months: int) -> DataFrame:
    """The last so many calendar months of target dates; one row a month."""
    firsts = frame.where("target_date IS NOT NULL").select(F.trunc("target_date", "MM").alias("month_start")).distinct()
    return firsts.orderBy(F.desc("month_start")).limit(months).select("month_start", F.last_day("month_start").alias("month_end"))


def walk_forward_split(frame: DataFrame, months: int, min_train: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Per fold the rows before and in its month, and whether it runs. Counts per month first, so folds meet months and not rows."""
    labelled = frame.where(F.col(LABEL).isNotNull()).groupBy(F.trunc("target_date", "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    folds = month_folds(frame.where(F.col(LABEL).isNotNull()), months)
    met = folds.join(F.broadcast(labelled), F.col("m") <= F.col("month_start"))  # months by folds
    sums = met.groupBy("month_start", "month_end").agg(F.coalesce(F.sum(F.when(F.col("m") < F.col("month_start"), F.col("n"))), F.lit(0)).cast("long").alias("n_train"), F.coalesce(F.sum(F.when(F.col("m") == F.col("month_start"), F.col("n"))), F.lit(0)).cast("long").alias("n_test"))
    return sums.withColumn("runs", (F.col("n_train") >= min_train) & (F.col("n_test") > 0))


class Formula:
    """The fixed score, as a strategy."""

    def fit(self, train: DataFrame) -> Formula:
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        return formula_score(rows)


class Constant:
    """The same probability for every name: what selection by symbol alone gives, to compare against."""

    def fit(self, train: DataFrame) -> Constant:
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prob", F.lit(0.5))


class MLStrategy:
    """A Spark ML classifier on imputed features. Features that are null throughout the training rows are dropped, and features with some nulls get
    an indicator; with `keep_empty` there are no indicators and empty features stay, as constants."""

    def __init__(self, classifier, scale: bool = False, balanced: str | None = None, keep_empty: bool = False):
        self.classifier, self.scale, self.balanced, self.keep_empty = classifier, scale, balanced, keep_empty

    def _plan(self, train: DataFrame) -> tuple[list, DataFrame]:
        """What the features go through before the classifier, and the training rows with their `label` and weight `w`."""
        filled = train.agg(*(F.count(c).alias(c) for c in FEATURES), F.avg(F.col(LABEL).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).first()
        self.used = [c for c in FEATURES if filled[c]]
        self.gaps = [] if self.keep_empty else [c for c in self.used if filled[c] < filled["n"]]
        self.empty = [c for c in FEATURES if not filled[c]] if self.keep_empty else []
        if not self.used and not self.empty:
            raise ValueError("no feature has a value in the training rows")
        share = filled["share"]
        stages = [Imputer(strategy="median", inputCols=self.used, outputCols=[f"{c}_f" for c in self.used])] if self.used else []
        stages.append(VectorAssembler(inputCols=[*(f"{c}_f" for c in [*self.used, *self.empty]), *(f"{c}_gap" for c in self.gaps)], outputCol="raw"))
        if self.scale:
            stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
        else:
            stages[-1].setOutputCol("features")
        y = F.col(LABEL) == 1
        weight = {"both": F.when(y, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)), "positive": F.when(y, (1 - share) / max(share, 1e-9)).otherwise(1.0)}.get(self.balanced, F.lit(1.0))
        return stages, self._prepared(train).withColumns({"label": F.col(LABEL).cast("double"), "w": weight.cast("double")})

    def fit(self, train: DataFrame) -> MLStrategy:
        stages, rows = self._plan(train)
        self.model = Pipeline(stages=[*stages, self.classifier.copy()]).fit(rows)
        return self

    def _prepared(self, rows: DataFrame) -> DataFrame:
        cast = {c: F.col(c).cast("double") for c in self.used}
        cast |= {f"{c}_f": F.lit(0.0) for c in self.empty}
        return rows.withColumns({**cast, **{f"{c}_gap": F.col(c).isNull().cast("double") for c in self.gaps}})

    def score(self, rows: DataFrame) -> DataFrame:
        """A logistic regression scores by its coefficients: Spark's model takes its training summary into each task and with that the session,
        which can't be serialised once anything was observed in it."""
        *before, last = self.model.stages
        if not isinstance(last, LogisticRegressionModel):
            return self.model.transform(self._prepared(rows)).withColumn("prob", vector_to_array("probability")[1]).select(*rows.columns, "prob")
        seen = PipelineModel(before).transform(self._prepared(rows))
        terms = F.zip_with(vector_to_array("features"), F.array(*(F.lit(float(b)) for b in last.coefficients)), lambda x, b: x * b)
        margin = F.aggregate(terms, F.lit(float(last.intercept)), lambda so_far, term: so_far + term)
        return seen.withColumn("prob", 1 / (1 + F.exp(-margin))).select(*rows.columns, "prob")


class StochasticTrees(MLStrategy):
    """Boosting with a draw of rows and a draw of columns a tree.

    Spark's own boosting draws columns at every node. Here a tree is fitted with the columns that it may not use held at 0, so that it can't split
    on them. Its target is the Newton step g / h of the logistic loss with weight h, so its leaves are sums of g over sums of h. Rows are drawn by a hash of
    symbol, date and tree. Margins so far are kept by the executors and written every `written` trees, which bounds the plan and what a lost executor costs; the trees then form one of Spark's
    ensembles, whose margin counts twice in the probability."""

    def __init__(self, n_estimators: int, learning_rate: float, max_depth: int, min_child: int, subsample: float, colsample: float, seed: int, written: int = 10):
        super().__init__(None, balanced="positive")
        self.n, self.rate, self.subsample, self.colsample, self.seed, self.written = n_estimators, learning_rate, subsample, colsample, seed, written
        self.tree = DecisionTreeRegressor(featuresCol="shown", labelCol="step", weightCol="trust", predictionCol="grown", maxDepth=max_depth, minInstancesPerNode=min_child, seed=seed)

    def fit(self, train: DataFrame) -> StochasticTrees:
        stages, rows = self._plan(train)
        prepared = Pipeline(stages=stages).fit(rows)
        slim = prepared.transform(rows).select("features", "label", "w", F.xxhash64("symbol", "signal_date").alias("row"), F.lit(0.0).alias("margin"))
        draw, width = random.Random(self.seed), len(self.used) + len(self.gaps)
        self.columns, trees = [], []
        now, older = stored(slim, "boosting"), None
        now = now.coalesce(-(-now.count() // ROWS_PER_TASK) or 1)
        for k in range(self.n):
            chosen = sorted(draw.sample(range(width), max(1, round(self.colsample * width))))
            self.columns.append(chosen)
            p = 1 / (1 + F.exp(-F.col("margin")))
            trust = F.greatest(p * (1 - p), F.lit(1e-6))
            shown = ElementwiseProduct(scalingVec=Vectors.dense([float(j in chosen) for j in range(width)]), inputCol="features", outputCol="shown")
            every = shown.transform(now.withColumns({"step": (F.col("label") - p) / trust, "trust": trust * F.col("w")}))
            drawn = every.where(F.pmod(F.xxhash64("row", F.lit(self.seed + k)), F.lit(1_000_000)) < self.subsample * 1_000_000)
            trees.append(self.tree.fit(drawn))
            before, now = now, trees[-1].transform(every).select("features", "label", "w", "row", (F.col("margin") + self.rate * F.col("grown")).alias("margin"))
            now = stored(now, "boosting") if k % self.written == self.written - 1 else now.persist()
            if older is not None:
                older.unpersist()  # the fit after has read what stands on it
            older = before
        for kept in (older, now):
            kept.unpersist()
        self.model = PipelineModel([*prepared.stages, _ensemble(train.sparkSession, trees, self.rate / 2)])
        return self


def _ensemble(spark: SparkSession, trees: list, weight: float) -> GBTClassificationModel:
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    grown = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for k, tree in enumerate(trees):
        grown[k], weights[k] = tree._java_obj, weight
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel("stochastic-trees", grown, weights))


def gbt(max_iter: int = 150, learning_rate: float = 0.1, max_depth: int = 5, seed: int = 42) -> MLStrategy:
    return MLStrategy(GBTClassifier(maxIter=max_iter, stepSize=learning_rate, maxDepth=max_depth, seed=seed))


def logreg(max_iter: int = 1000, reg: float = 1e-4) -> MLStrategy:
    return MLStrategy(LogisticRegression(maxIter=max_iter, regParam=reg, standardization=False, weightCol="w"), scale=True, balanced="both", keep_empty=True)


def stochastic_gbt(n_estimators: int = 300, learning_rate: float = 0.05, max_depth: int = 6, min_child: int = 5, subsample: float = 0.8, colsample: float = 0.8, seed: int = 42) -> MLStrategy:
    """Spark's own boosting, which draws columns at every node."""
    return MLStrategy(GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, minInstancesPerNode=min_child, subsamplingRate=subsample, featureSubsetStrategy=str(colsample), weightCol="w", seed=seed), balanced="positive")


def stochastic_trees(n_estimators: int = 300, learning_rate: float = 0.05, max_depth: int = 6, min_child: int = 5, subsample: float = 0.8, colsample: float = 0.8, seed: int = 42) -> StochasticTrees:
    """The same with columns drawn once a tree: exact in that, and some three times slower, a fit a tree."""
    return StochasticTrees(n_estimators, learning_rate, max_depth, min_child, subsample, colsample, seed)


REGISTRY: dict[str, Callable] = {"constant": Constant, "formula": Formula, "gbt": gbt, "logreg": logreg, "stochastic_gbt": stochastic_gbt, "stochastic_trees": stochastic_trees}


def register(name: str, factory: Callable) -> None:
    if name in REGISTRY:
        raise ValueError(f"strategy {name!r} is registered already")
    REGISTRY[name] = factory


def strategy(name: str, **params):
    """A new strategy; an unknown name or parameter raises."""
    if name not in REGISTRY:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(REGISTRY))}")
    try:
        return REGISTRY[name](**params)
    except TypeError as e:
        raise ValueError(f"strategy {name!r} doesn't take {params}") from e


def walk_forward(frame: DataFrame, name: str, months: int, min_train: int = MIN_TRAIN_ROWS, **params) -> DataFrame | None:
    """Out-of-sample scores: each month by a model of strictly earlier target dates. The driver has at most `months` folds, and fits some at a time."""
    labelled = frame.where(F.col(LABEL).isNotNull())

    def scored(fold) -> DataFrame:
        train = labelled.where(F.col("target_date") < fold["month_start"]).coalesce(-(-fold["n_train"] // ROWS_PER_TASK) or 1)
        return strategy(name, **params).fit(train).score(labelled.where(F.col("target_date").between(fold["month_start"], fold["month_end"])))

    folds = [fold for fold in walk_forward_split(frame, months, min_train).orderBy("month_start").collect() if fold["runs"]]
    with ThreadPool(FOLDS_AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(frame.sparkSession)(scored), folds, chunksize=1)
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


@dataclass
class Benchmark:
    """What a walk-forward run found: `metrics` in one row (none if no fold ran), an outcome row per rank and day in `daily`, and the
    calibration of all names and of the picks, a row each."""

    strategy: str
    params: dict
    metrics: DataFrame
    daily: DataFrame
    calibration: DataFrame
    pick_calibration: DataFrame


def run_benchmark(frame: DataFrame, name: str, months: int = 12, top_n: int = 20, min_train: int = MIN_TRAIN_ROWS, **params) -> Benchmark:
    """A strategy under walk-forward validation. The frame is read once a fold: pass a table. Scores are written once and read by all
    reports. Folds with fewer training rows don't run; if none does, every part has no rows."""
    scored = walk_forward(frame, name, months, min_train, **params)
    if scored is None:
        scored = frame.limit(0).withColumn("prob", F.lit(None).cast("double"))
    rows = stored(scored.select(F.col("target_date").alias("date"), "symbol", "signal_date", "prob", F.col(LABEL).alias("label"), "median_vol_20", "next_oc_return", "next_high_return", "next_low_return"), "scored")
    picks = stored(select_top(rows, top_n, LIQUIDITY), "picks")
    metrics = benchmark_metrics(rows, picks).join(auc(rows), F.lit(True)).where("n_rows > 0").withColumn("strategy", F.lit(name))
    daily = picks.select(F.col("date").alias("target_date"), "rank", "symbol", F.col("next_oc_return").alias("ret"), F.col("label").alias("hit"), F.col("next_high_return").alias("oh"), F.col("next_low_return").alias("ol"))
    return Benchmark(name, {"months": months, "top_n": top_n, **({"strategy_params": params} if params else {})}, metrics, daily, calibration_report(rows), pick_calibration(picks, top_n))


def record_benchmark(spark: SparkSession, made: Benchmark, ledger_path: str, daily_path: str, *, run_id: int, run_ts: str) -> None:
    """Append a run to the ledger: its outcome rows, then its row with parameters, metrics and calibration as JSON."""
    row = made.metrics.join(made.calibration.select(F.to_json(F.struct(F.expr("*"))).alias("calibration")), F.lit(True)).join(made.pick_calibration.select(F.to_json(F.struct(F.expr("*"))).alias("pick_calibration")), F.lit(True))
    metrics = F.to_json(F.struct(*made.metrics.columns, "calibration", "pick_calibration"))
    ledger = row.select(F.lit(run_id).cast("long").alias("id"), F.lit(run_ts).cast("timestamp").alias("run_ts"), "strategy", F.lit(json.dumps(made.params, sort_keys=True)).alias("params"), metrics.alias("metrics"), "lift", F.lit(EVENT).alias("event"))
    record_experiment(spark, ledger_path, daily_path, ledger, made.daily.withColumn("seq", F.lit(run_id).cast("long")))


def compare_strategies(frame: DataFrame, a: str, b: str, params_a: dict | None = None, params_b: dict | None = None, **how) -> DataFrame:
    """Two strategies on the same folds: every metric side by side (`_a`, `_b`), and which lift wins beyond the noise band."""
    one, two = (run_benchmark(frame, n, **how, **(p or {})).metrics for n, p in ((a, params_a), (b, params_b)))
    verdict = compare_verdict(one, two)
    sides = [m.select(*(F.col(c).alias(f"{c}_{side}") for c in m.columns if c != "lift")) for m, side in ((one, "a"), (two, "b"))]
    return verdict.join(sides[0], F.lit(True)).join(sides[1], F.lit(True))  # one row each


def predict_for(frame: DataFrame, name: str, signal_date, top_n: int = 20, **params) -> DataFrame:
    """Ranked picks of a signal date, by a model of target dates up to it. A date without rows, and one before which nothing is labelled,
    raises. The frame is read several times: pass a table."""
    train, rows = frame.where(F.col(LABEL).isNotNull() & (F.col("target_date") <= signal_date)), frame.where(F.col("signal_date") == signal_date)
    if rows.isEmpty():
        raise ValueError(f"no feature rows for signal date {signal_date}")
    if train.isEmpty():
        raise ValueError(f"no labelled history before {signal_date} to train on")
    scored = strategy(name, **params).fit(train).score(rows)
    return select_top(scored, top_n, LIQUIDITY).select("signal_date", "symbol", "prob", "rank")


def predict_and_log(frame: DataFrame, logged: DataFrame, name: str, signal_date, *, run_ts: Column, universe_as_of, top_n: int = 20, **params) -> DataFrame:
    """The prediction log (strategy, signal_date, ...) with the picks of a date in place of earlier ones, which keep the time at which the date was
    first logged."""
    picks = predict_for(frame, name, signal_date, top_n, **params).withColumn("strategy", F.lit(name))
    return replace_slice(logged, picks, ["strategy", "signal_date"], run_ts=run_ts, universe_as_of=F.lit(universe_as_of).cast("date"), event=F.lit(EVENT))


def shadow_predict(frame: DataFrame, roster: DataFrame, signal_date, top_n: int = 20) -> tuple[DataFrame | None, DataFrame]:
    """Picks of the roster's kept challengers, and the roster with what became of each: `status` is `ran`, `failed`, `malformed` or `dropped`, and
    `problem` says why a fit failed.

    A challenger's fit and its first action are one attempt: whatever goes wrong in it, in Python or in the JVM, fails that challenger alone. The driver
    loops over the kept entries, of which the roster's cap bounds the number."""
    out, made = None, []
    for entry in roster.where("status = 'kept'").orderBy("place").collect():
        try:
            picks = predict_for(frame, entry["strategy"], signal_date, top_n, **json.loads(entry["params"]))
            picks = stored(picks.select(F.lit(entry["challenger"]).alias("challenger"), F.lit(entry["strategy"]).alias("strategy"), F.lit(entry["params"]).alias("params"), *picks.columns), "challenger")
        except Exception as e:  # noqa: BLE001
            made.append((entry["place"], "failed", f"{type(e).__name__}: {e}".splitlines()[0]))
            continue
        made.append((entry["place"], "ran", None))
        out = picks if out is None else out.unionByName(picks)
    became = F.broadcast(roster.sparkSession.createDataFrame(made, "place int, became string, problem string"))  # at most the cap
    return out, roster.join(became, "place", "left").withColumn("status", F.coalesce("became", "status")).drop("became")


def shadow_report(roster: DataFrame) -> DataFrame:
    """One row: how many entries were rostered (sound), and how many of these ran, failed or were dropped; malformed ones apart."""
    counts = {s: F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ran", "failed", "dropped", "malformed")}
    return roster.agg(F.count(F.when(F.col("status") != "malformed", 1)).alias("rostered"), *counts.values())


def run_shadow(frame: DataFrame, logged: DataFrame, roster: DataFrame, signal_date, *, run_ts: Column, universe_as_of, top_n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The shadow log with the day's picks of every challenger, replacing earlier ones of that day, and the roster with what became of each."""
    picks, became = shadow_predict(frame, roster, signal_date, top_n)
    if picks is None:
        return logged, became
    return replace_slice(logged, picks, ["challenger", "signal_date"], run_ts=run_ts, keep_created=False, universe_as_of=F.lit(universe_as_of).cast("date"), event=F.lit(EVENT)), became
