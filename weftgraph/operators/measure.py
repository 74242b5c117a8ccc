"""Statistics of measurements: distributions by operation, medians against a base, and slow drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.running import running

#: What a regression must exceed, and the window and limits of drift.
LEAST_CYCLES, LEAST_SHARE, DRIFT_WINDOW, DRIFT_SHARE = 40.0, 0.05, 20, 0.10
#: Samples of one key that one task looks at together.
DRIFT_BLOCK = 10_000


def distributions(samples: DataFrame, key: str = "op", value: str = "value") -> DataFrame:
    """n, least, p50, p90, p99, mean, cv, re by key; the p-th value is the one at place floor(n p), not interpolated.

    Places come from counting distinct values, not from gathering a key's samples.
    """
    basic = samples.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    joined = _places(samples, key, value).join(basic.select(key, "n"), key)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    places = joined.groupBy(key).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    cv = F.when(F.col("mean") != 0, F.coalesce("sd", F.lit(0.0)) / F.col("mean")).otherwise(0.0)
    return basic.join(places, key).select(key, "n", "least", "p50", "p90", "p99", "mean", cv.alias("cv"), (cv / F.sqrt("n")).alias("re"))


def _places(samples: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, upto: how many samples of the key are no larger; a row for each distinct value."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    return running(counts, [key], [value], upto="k")


def medians(runs: DataFrame, key: str = "op", value: str = "value") -> DataFrame:
    """key, median: the middle sample, or the mean of the two about the middle."""
    n = runs.groupBy(key).agg(F.count(value).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    middle = _places(runs, key, value).join(n, key).groupBy(key).agg(at(F.floor((F.col("n") - 1) / 2)).alias("low"), at(F.floor(F.col("n") / 2)).alias("high"))
    return n.join(middle, key, "left").select(key, ((F.col("low") + F.col("high")) / 2).alias("median"))


def compared(base: DataFrame, head: DataFrame, reference: str = "reference") -> DataFrame:
    """op, base, head (corrected by how the reference operation moved), delta, regressed: medians of two sets of runs."""
    one, two = medians(base).withColumnRenamed("median", "base"), medians(head).withColumnRenamed("median", "raw")
    both = one.join(two, "op", "left")
    scale = both.filter(F.col("op") == reference).select((F.col("base") / F.col("raw")).alias("s")).first()
    rows = both.withColumn("head", F.col("raw") * F.lit(float(scale[0]) if scale and scale[0] else 1.0)).withColumn("delta", F.col("head") - F.col("base"))
    return rows.select("op", "base", "head", "delta", (F.col("delta") > F.greatest(F.lit(LEAST_CYCLES), F.col("base") * LEAST_SHARE)).alias("regressed"))


def drift(history: DataFrame, key: str = "op", seq: str = "seq", value: str = "value") -> DataFrame:
    """key, seq, value, rolling (median of the DRIFT_WINDOW samples before), drifted: over it by a tenth and by LEAST_CYCLES."""
    places = running(history.withColumn("_one", F.lit(1)), [key], [seq, value], place="_one").withColumn("place", F.col("place") - 1)
    # a key goes in blocks of its places; the last samples of a block go with the next one too, to be looked back at
    own = F.floor(F.col("place") / DRIFT_BLOCK)
    ahead = F.col("place") % DRIFT_BLOCK >= DRIFT_BLOCK - DRIFT_WINDOW
    rows = places.withColumn("block", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("mine", F.col("block") == own)
    before = Window.partitionBy(key, "block").orderBy("place").rowsBetween(-DRIFT_WINDOW, -1)
    rows = rows.withColumn("rolling", F.expr(f"percentile({value}, 0.5)").over(before)).filter("mine")
    over = F.col(value) - F.col("rolling")
    return rows.select(key, seq, value, "rolling", F.coalesce((over > F.col("rolling") * DRIFT_SHARE) & (over > LEAST_CYCLES), F.lit(False)).alias("drifted"))


def call_summary(calls: DataFrame) -> DataFrame:
    """calls (tool, ms, ok, is_error, timed_out) -> n, protocol and tool errors, timeouts, longest and mean time by tool."""
    late, lost = F.col("timed_out"), ~F.col("timed_out") & ~F.col("ok")
    wrong = F.col("is_error") & F.col("ok") & ~F.col("timed_out")
    return calls.groupBy("tool").agg(F.count("*").alias("n"), *(F.sum(c.cast("int")).alias(n) for c, n in ((lost, "protocol_errors"), (wrong, "tool_errors"), (late, "timeouts"))), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms"))


#: Upper bounds in seconds of a duration histogram's buckets.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def duration_histogram(calls: DataFrame, key: str = "op", seconds: str = "value", bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """key, upto (null: beyond the last bound), n, total of durations by bucket."""
    bucket = F.coalesce(*(F.when(F.col(seconds) <= b, F.lit(b)) for b in bounds))
    return calls.groupBy(key, bucket.alias("upto")).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"))
