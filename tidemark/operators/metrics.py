"""Performance, probability metrics, paired series, block-bootstrap intervals, run comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.ordered import ranged, running_before


def performance(equity: DataFrame, initial: float | str, fills: DataFrame | None = None, annual: int = 252) -> DataFrame:
    """Per run, from ``equity`` (run, session, equity) and fills' notionals (run, notional).

    ``initial`` is the value that all runs start from, or the name of the column with each run's own. Figures:
    cumulative_return; cagr (null in one day); max_drawdown from the initial value on, positive; annualised
    volatility (0 below two returns); sharpe_ratio (null without spread); turnover = notional / mean equity.
    """
    w = W.partitionBy("run").orderBy("session")
    start = F.col(initial) if isinstance(initial, str) else F.lit(initial)
    peak = F.greatest(F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)), start)
    before = F.coalesce(F.lag("equity", 1).over(w), start)
    steps = equity.withColumn("_ret", ratio(F.col("equity"), before) - 1).withColumn("_down", ratio(F.col("equity"), peak) - 1)
    m = steps.groupBy("run").agg(
        ratio(F.max_by("equity", "session"), F.max(start)).alias("ratio"), F.datediff(F.max("session"), F.min("session")).alias("days"),
        F.least(F.min("_down"), F.lit(0.0)).alias("down"), F.stddev_samp("_ret").alias("std"), F.avg("_ret").alias("mean"), F.avg("equity").alias("mean_equity"),
    )
    if fills is not None:
        m = m.join(fills.groupBy("run").agg(F.sum("notional").alias("traded")), "run", "left")
    else:
        m = m.withColumn("traded", F.lit(0.0))
    std = F.coalesce("std", F.lit(0.0))
    return m.select(
        "run",
        (F.col("ratio") - 1).alias("cumulative_return"),
        F.when(F.col("days") > 0, F.pow("ratio", 365.25 / F.col("days")) - 1).alias("cagr"),
        (-F.col("down")).alias("max_drawdown"),
        (std * math.sqrt(annual)).alias("annualized_volatility"),
        F.when(std > 0, F.col("mean") / std * math.sqrt(annual)).alias("sharpe_ratio"),
        ratio(F.coalesce("traded", F.lit(0.0)), F.col("mean_equity")).alias("turnover"),
    )


def running_drawdown(equity: DataFrame) -> DataFrame:
    w = W.partitionBy("run").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    return equity.select("run", "session", (ratio(F.col("equity"), F.max("equity").over(w)) - 1).alias("drawdown"))


def _bin(p: Column) -> Column:
    """Of ten bins by exact comparison with tenths; the last includes 1."""
    out = F.lit(0)
    for i in range(1, 10):
        out = out + (p >= i / 10).cast("int")
    return out


def calibration(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per bin that has rows: count, mean_probability, observed_frequency."""
    return pairs.groupBy(*by, _bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_probability"), F.avg("y").alias("observed_frequency"))


def probability_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: count, accuracy, precision, recall, roc_auc (ties count half), brier_score, log_loss, expected_calibration_error; null on empty denominators.

    The area comes from the ranks of the distinct scores: these are counted, cut into ranges, and each range starts at
    the count below it, so no task holds a group's scores.
    """
    hit = (F.col("p") >= 0.5).cast("int")
    y = F.col("y")
    loss = -(y * F.log(F.greatest("p", F.lit(1e-15))) + (1 - y) * F.log(F.greatest(1 - F.col("p"), F.lit(1e-15))))
    main = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg((hit == y).cast("double")).alias("accuracy"), F.try_divide(F.sum(hit * y), F.sum(hit)).alias("precision"), F.try_divide(F.sum(hit * y), F.sum(y)).alias("recall"),
        F.avg(F.pow(F.col("p") - y, 2)).alias("brier_score"), F.avg(loss).alias("log_loss"),
    )
    scores = pairs.groupBy(*by, "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    scores = running_before(ranged(scores, by, ["p"]), by, ["p"], {"_below": F.col("neg")})
    auc = scores.withColumn("_won", F.col("pos") * (F.col("_below") + F.col("neg") / 2)).groupBy(*by).agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))
    bins = calibration(pairs, by).groupBy(*by).agg((F.sum(F.col("count") * F.abs(F.col("mean_probability") - F.col("observed_frequency"))) / F.sum("count")).alias("expected_calibration_error"))
    return main.join(auc, by).join(bins, by)


def _block_sums(series: DataFrame, n: DataFrame, block: int, by: tuple[str, ...]) -> DataFrame:
    """by, i, tail, value, weight: circular sums of ``block`` entries from i on, and of the last block's (``tail``)."""
    key = list(by)
    sized = series.join(n, key) if key else series.crossJoin(F.broadcast(n))  # one row
    # The first entries stand again behind the last, and one more place ends the sums.
    far = sized.where(F.col("i") <= block).withColumn("i", F.col("i") + F.col("n"))
    w = W.partitionBy(*key).orderBy("i")
    places = sized.unionByName(far)
    before = [(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("value", "weight")]
    sums = places.select(*key, "i", "n", *before)
    left = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block  # entries of the last block
    starts = sums.where(F.col("i") < F.col("n"))
    starts = starts.select(*key, "i", F.col("value").alias("_v"), F.col("weight").alias("_w"), F.posexplode(F.array(F.lit(block).cast("long"), left)).alias("tail", "_len"))
    ends = sums.select(*key, F.col("i").alias("_end"), "value", "weight")
    found = starts.withColumn("_end", F.col("i") + F.col("_len")).join(ends, [*key, "_end"])
    return found.select(*key, "i", "tail", (F.col("value") - F.col("_v")).alias("value"), (F.col("weight") - F.col("_w")).alias("weight"))


def bootstrap_interval(series: DataFrame, replicates: int, block: int, confidence: float, seed: int, statistic: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, lower, upper, reason of a circular block bootstrap over each ``series`` (i from 0, value[, weight]).

    Block b of replicate r starts at (r * 7919 + b * 104729 + seed) mod n; the last one is cut so that a replicate has n
    entries. The statistic is the mean of values, or their sum over the sum of weights. Bounds are the values of rank
    floor(a (R - 1)) and ceil((1 - a)(R - 1)), a = (1 - confidence) / 2. Fewer than two blocks give null bounds. A
    series is one row a session; a block's sum is the difference of two prefix sums, so a replicate costs a lookup a
    block instead of a row an entry.
    """
    n = series.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n"))
    weight = F.col("weight") if statistic == "ratio" else F.lit(1)
    held = series.select(*by, F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"), weight.cast("double").alias("weight"))
    enough = n.where(F.col("n") >= 2 * block)
    sums = _block_sums(held, enough, block, by)
    draws = enough.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    draws = draws.select(*by, "n", "r", blocks.alias("_blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
    start = (F.col("r").cast("long") * 7919 + F.col("b") * 104729 + seed) % F.col("n")
    draws = draws.select(*by, "r", start.alias("i"), (F.col("b") == F.col("_blocks") - 1).cast("int").alias("tail"))
    stats = draws.join(sums, [*by, "i", "tail"]).groupBy(*by, "r").agg((F.sum("value") / F.sum("weight")).alias("s"))
    ranked = stats.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("s", "r")) - 1)  # over the replicates
    a = (1 - confidence) / 2
    lo, hi = math.floor(a * (replicates - 1)), math.ceil((1 - a) * (replicates - 1))
    bounds = ranked.groupBy(*by).agg(F.max(F.when(F.col("_k") == lo, F.col("s"))).alias("lower"), F.max(F.when(F.col("_k") == hi, F.col("s"))).alias("upper"))
    out = n.join(bounds, list(by), "left") if by else n.crossJoin(bounds)  # one row each
    return out.select(*by, "lower", "upper", F.when(F.col("n") < 2 * block, "insufficient_blocks").alias("reason"))


def return_difference(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, session, difference of two return series (session, ret) of each run; ``mismatch`` marks a session that
    only one of them has."""
    key = [*by, "session"]
    a, b = first.select(*key, F.col("ret").alias("_a"), F.lit(True).alias("_ina")), second.select(*key, F.col("ret").alias("_b"), F.lit(True).alias("_inb"))
    joined = a.join(b, key, "full_outer")
    return joined.select(*key, (F.col("_a") - F.col("_b")).alias("difference"), (F.col("_ina").isNull() | F.col("_inb").isNull()).alias("mismatch"))


def returns(equity: DataFrame, initial: float) -> DataFrame:
    """run, session, ret of equity paths that start from ``initial``."""
    w = W.partitionBy("run").orderBy("session")
    return equity.select("run", "session", (ratio(F.col("equity"), F.lag("equity", 1, initial).over(w)) - 1).alias("ret"))


def difference_interval(difference: DataFrame, replicates: int, block: int, confidence: float, seed: int) -> DataFrame:
    """run, mean_difference, lower, upper, reason: the interval of each run's mean return difference over sessions that
    both series have."""
    paired = difference.where("NOT mismatch AND difference IS NOT NULL")
    series = paired.select("run", (F.row_number().over(W.partitionBy("run").orderBy("session")) - 1).alias("i"), F.col("difference").alias("value"))
    mean = paired.groupBy("run").agg(F.avg("difference").alias("mean_difference"))
    return mean.join(bootstrap_interval(series, replicates, block, confidence, seed, by=("run",)), "run")


def best_candidate(runs: DataFrame, by: list[str]) -> DataFrame:
    """Highest return, ties by name."""
    return runs.groupBy(*by).agg(F.min_by("name", F.struct((-F.col("ret")).alias("r"), "name")).alias("name"), F.max("ret").alias("ret"))


def comparable_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group whether all its runs share one condition, and their number."""
    return runs.groupBy(*by).agg((F.count_distinct("condition") == 1).alias("comparable"), F.count(F.lit(1)).alias("runs"))


def cost_totals(fills: DataFrame, by: list[str]) -> DataFrame:
    return fills.groupBy(*by).agg(F.sum(F.col("commission") + F.col("slippage_cost")).alias("cost"))
