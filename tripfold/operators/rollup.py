"""Averages over trials, summaries by group, shares, histograms and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions import fixed


def mean(x: Column) -> Column:
    """The average of an exact decimal, as one division of doubles."""
    return F.sum(x).cast("double") / F.count(x)


def trial_means(trials: DataFrame, task: str, score: str, failed: str) -> DataFrame:
    """A2: the mean score of each task's trials that didn't fail, their number, and whether any failed."""
    ok = F.coalesce(~F.col(failed), F.lit(True)) & F.col(score).isNotNull()
    valid = F.when(ok, F.col(score))
    return trials.groupBy(task).agg(mean(valid).alias("avg_score"), F.count(valid).alias("valid"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_failed"))


def with_difficulty(df: DataFrame, tasks: DataFrame, task: str, difficulty: str, line: str | None = None) -> DataFrame:
    """Df with each task's difficulty; unknown where the task or its difficulty is missing. Of a task that is
    listed again the last line holds (line: its column; without one, repeated tasks must say the same)."""
    last = F.max(difficulty) if line is None else F.max_by(difficulty, line)
    known = tasks.groupBy(F.col(task).alias("_task")).agg(last.alias("_difficulty"))
    return df.join(known, F.col(task) == F.col("_task"), "left").withColumn("difficulty", F.coalesce("_difficulty", F.lit("unknown"))).drop("_task", "_difficulty")


def by_group(df: DataFrame, group: str, metric: str) -> DataFrame:
    """A4, A5: average, least, greatest and number of values, a missing value counting 0, overall and by group.

    Values are added as whole millionths, so the average doesn't depend on the order of addition.
    """
    x = F.coalesce(F.col(metric), F.lit(0.0))
    return (
        df.groupingSets([[], [group]], group)
        .agg(F.sum(F.floor(x * 1_000_000)).alias("_s"), F.count("*").alias("tasks"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(metric).alias("valid"))
        .select(F.coalesce(F.col(group), F.lit("overall")).alias("grp"), (F.col("_s").cast("double") / 1e6 / F.col("tasks")).alias("avg_metric"), "lo", "hi", "tasks", "valid")
    )


def expand(tasks: DataFrame, n: int) -> DataFrame:
    """Each task with trial numbers 0 to n-1."""
    return tasks.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def with_settings(tasks: DataFrame, difficulty: str) -> DataFrame:
    """The run's settings of each task by difficulty; the ones of the middle where it isn't known."""
    known = fixed.DIFFICULTY_SETTINGS
    pick = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v[i])]), F.col(difficulty)), F.lit(known["medium"][i]))
    return tasks.withColumn("max_turn", pick(0)).withColumn("interval", pick(1))


def may_pass() -> Column:
    """Whether a run failed for a reason that may pass, so that it is worth another try."""
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    return failed & F.coalesce(F.col("reason").isin(*fixed.RETRYABLE_REASONS), F.lit(False))


def purge_retryable(results: DataFrame, keys: list[str]) -> DataFrame:
    """results(keys, success, reason) but those of keys with a run that failed for a reason that may pass: the
    trial is run again, so none of its rows may stay. A run that succeeded isn't one, whatever its reason."""
    return pending(results, results.where(may_pass()), keys)


def resumed(wanted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted that are still to be run: those without a result that succeeded or failed for good."""
    return pending(wanted, results.where(~may_pass()), keys)


def gate(runs: DataFrame) -> DataFrame:
    """A1: why a trial has no scores, the first that holds: a failed run, no reference, no plan, a plan that can't
    be read. runs(success, reference, planned, plan); error is null where all scores count."""
    error = F.when(~F.coalesce("success", F.lit(False)), "run_failed").when(F.col("reference").isNull(), "no_reference")
    return runs.withColumn("error", error.when(~F.coalesce("planned", F.lit(False)), "no_plan").when(F.col("plan").isNull(), "plan_unreadable"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted whose keys aren't among done; null keys are keys."""
    have = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.join(have, same, "left_anti")


def shares(df: DataFrame, value: str) -> DataFrame:
    """How often each value occurs, and its share of all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.select(value, "n", (F.col("n").cast("double") / df.count()).alias("share"))


RATE_BUCKETS = ("0", "(0,.25]", "(.25,.5]", "(.5,.75]", "(.75,1]")


def rate_histogram(df: DataFrame, rate: str) -> DataFrame:
    """The number of rates in each bucket, 0 for an empty one."""
    r = F.col(rate)
    bucket = F.when(r <= 0, 0).when(r <= 0.25, 1).when(r <= 0.5, 2).when(r <= 0.75, 3).when(r <= 1, 4)
    counts = df.select(bucket.alias("_b")).where("_b is not null").groupBy("_b").agg(F.count("*").alias("_n"))
    all_ = df.sparkSession.createDataFrame(list(enumerate(RATE_BUCKETS)), "ord int, bucket string")
    return all_.join(counts, F.col("ord") == F.col("_b"), "left").select("ord", "bucket", F.coalesce("_n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, score: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """A10: the number of rows with each score from lo to hi, 0 where there is none."""
    counts = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    return df.sparkSession.range(lo, hi + 1).join(counts, F.col("id") == F.col("_s"), "left").select(F.col("id").alias("score"), F.coalesce("_n", F.lit(0)).alias("n"))


def composite(df: DataFrame, completeness: str, fairness: str, validity: str, judge: str) -> DataFrame:
    """The mean of completeness x 100, fairness, validity x 100 and the judge's score."""
    x = F.col(completeness) * 100 + F.col(fairness) + F.col(validity) * 100 + F.col(judge)
    return df.withColumn("composite", x / 4)


def report_table(summary: DataFrame, group: str, metrics: list[str], columns: list[str]) -> DataFrame:
    """A row for each metric, a column for each group."""
    long = summary.select(group, F.expr(f"stack({len(metrics)}, " + ", ".join(f"'{m}', cast({m} as double)" for m in metrics) + ") as (metric, value)"))
    return long.groupBy("metric").pivot(group, columns).agg(F.max("value"))


def families(scores: DataFrame, trial: str) -> DataFrame:
    """Mean of each dimension and overall, in four families of scores, 0 where nothing was scored.

    scores(trial, dim, raw, norm, penalised, final). Overall is the mean of the trials' means, but in the
    final family the mean of the dimensions' means.
    """
    names = ["raw", "norm", "penalised", "final"]
    long = scores.select(trial, "dim", F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).cast("double").alias("x")) for n in names])).alias("_s")).select(trial, "dim", "_s.*")
    by_dim = long.groupBy("family", "dim").agg(F.coalesce(mean(F.col("x")), F.lit(0.0)).alias("mean"))
    by_trial = long.where("family <> 'final'").groupBy("family", trial).agg(mean(F.col("x")).alias("_m")).groupBy("family").agg(F.coalesce(mean(F.col("_m")), F.lit(0.0)).alias("mean"))
    final = by_dim.where("family = 'final'").groupBy("family").agg(mean(F.col("mean")).alias("mean"))
    return by_dim.unionByName(by_trial.unionByName(final).withColumn("dim", F.lit("overall")).select("family", "dim", "mean"))
