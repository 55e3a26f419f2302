"""One ranking from several scores of different scale and shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_by_key, ranked
from ..plans.stage import stage

#: Lower bound of a squashed score; a missing score stands there.  Above, scores are told apart however large they are.
FLOOR = 1e-9
#: From so many scales on, the logarithm of the logistic is taken from its series: it is too close to 0 for the formula.
FAR = 15.0
#: Accuracy of the quantile summaries: a median is off by at most one 10,000th of the group's ranks.
ACCURACY = 10_000


def _usable(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))


def pair_scores(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row a (group, item) with the highest usable value of each score by itself."""
    rows = df.select(F.col(group).cast("string").alias(group), F.col(item).cast("string").alias(item), *(F.col(s).cast("double").alias(s) for s in scores))
    rows = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(group, item).agg(*(F.max(_usable(s)).alias(s) for s in scores))


def robust_bounds(pairs: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """Add ``l_<score>``, the logarithm of a value in (0, 1): logistic of (x - median) / scale, taken in each group.

    The scale is 1.4826 times the median absolute deviation; where more than half the values are equal it is 1.2533
    times the mean absolute deviation from the median; where all are equal every value gets 0.5.  Quantiles are bounded
    summaries that merge, so a hot group is never held by one task; its row of statistics reaches its rows by broadcast.
    """
    total = pairs.count()
    mids = pairs.groupBy(group).agg(F.count("*").alias("_n"), *(F.percentile_approx(s, 0.5, ACCURACY).alias(f"m_{s}") for s in scores))
    mids = stage(mids, "medians")
    at = join_by_key(pairs, mids, group, "_n", total).drop("_n")
    off = lambda s: F.abs(F.col(s) - F.col(f"m_{s}"))
    spread = at.groupBy(group).agg(F.count("*").alias("_n"), *(x for s in scores for x in (F.percentile_approx(off(s), 0.5, ACCURACY).alias(f"d_{s}"), F.avg(off(s)).alias(f"a_{s}"))))
    out = join_by_key(at, stage(spread, "spreads"), group, "_n", total).drop("_n")
    for s in scores:
        scale = F.when(F.col(f"d_{s}") > 0, F.col(f"d_{s}") * 1.4826).otherwise(F.col(f"a_{s}") * 1.2533)
        z = F.when(scale > 0, (F.col(s) - F.col(f"m_{s}")) / scale).otherwise(F.lit(0.0))
        log = F.when(z > FAR, F.exp(-2 * z) / 2 - F.exp(-z)).otherwise(-F.ln(1 + F.exp(-z)))
        out = out.withColumn(f"l_{s}", F.when(F.col(s).isNull(), F.lit(math.log(FLOOR))).otherwise(F.greatest(F.lit(math.log(FLOOR)), log)))
    return out.drop(*(f"{k}_{s}" for s in scores for k in "mda"))


def fused(df: DataFrame, group: str, item: str, weights: dict[str, float]) -> DataFrame:
    """Every (group, item) once, with its scores, the logarithms of their bounded forms, ``fused``, the weighted
    geometric mean of these, and ``log_fused``, its logarithm, which tells apart what is too close to 1 for ``fused``.

    Null and NaN values of a score don't count; an item without a score at all stands at the lower bound in it; rows
    with a null group or item are left out; an empty table gives no rows; other columns are ignored.  Each step is
    monotone, so an item at least as good as another in every score never gets a lower ``fused``.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and sum to more than 0")
    names = list(weights)
    pairs = stage(pair_scores(df, group, item, names), "pairs")
    out = robust_bounds(pairs, group, names)
    mean = sum((F.lit(float(w)) * F.col(f"l_{s}") for s, w in weights.items()), F.lit(0.0)) / F.lit(float(sum(weights.values())))
    return out.withColumn("log_fused", mean).withColumn("fused", F.exp("log_fused"))


def fused_ranking(df: DataFrame, group: str, item: str, weights: dict[str, float]) -> DataFrame:
    """``fused`` with its 1-based ``rank`` in the group, by ``log_fused`` (equal ones, to nine digits, by item)."""
    out = fused(df, group, item, weights).withColumn("_o", F.round(F.ln(F.greatest(-F.col("log_fused"), F.lit(1e-300))), 9))
    return ranked(out, [group], [F.col("_o"), F.col(item)], "rank").drop("_o")


def leaders(df: DataFrame, group: str, item: str, weights: dict[str, float], k: int) -> DataFrame:
    """Items that stand among the first ``k`` of their group by every score, taken from the head of the fused ranking.

    An item among the first k by each of m scores is beaten in at least one score by every item whose ``fused`` is
    higher, and fewer than k beat it in each: at most m(k-1) items are ahead.  So the first m(k-1)+1 values of ``fused``
    hold all of them; whether an item is among the first k of each score is then checked exactly.
    """
    names = list(weights)
    rows = stage(fused(df, group, item, weights).select(group, item, *names, "fused", "log_fused"), "fused")
    total = rows.count()

    def nth(c: str, n: int) -> DataFrame:
        """The n-th highest value of ``c`` in a group (the lowest, if there are fewer): partial limits come before the exchange."""
        from pyspark.sql import Window

        by = Window.partitionBy(group).orderBy(F.desc(c))
        head = rows.where(F.col(c).isNotNull()).select(group, c).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n)
        return head.groupBy(group).agg(F.min(c).alias(f"_t_{c}"))

    limits = rows.groupBy(group).agg(F.count("*").alias("_n")).join(nth("log_fused", len(names) * (k - 1) + 1), group)
    for s in names:
        limits = limits.join(nth(s, k), group)
    near = join_by_key(rows, stage(limits, "limits"), group, "_n", total)
    for c in ["log_fused", *names]:
        near = near.where(F.col(c) >= F.col(f"_t_{c}"))
    return near.select(group, item, *names, "fused")
