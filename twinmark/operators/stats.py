"""Aggregations (G4-G6, G9-G12) and evaluation of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import distance as D
from ..session import cut_lineage

VALID_MODES = ("size", "mean", "std", "max", "min", "median")


def _modes(modes) -> list[str]:
    if isinstance(modes, str):
        modes = [modes]
    out = []
    for m in modes:
        if m.lower() not in VALID_MODES:
            raise ValueError(f"unknown aggregate {m!r}; one of {VALID_MODES}")
        out.append(m.lower())
    return out


def mode_column(mode: str, x: str) -> Column:
    c = F.col(x).cast("double")
    return {
        "size": F.count(c),
        "mean": F.avg(c),
        "std": F.stddev_pop(c),
        "max": F.max(c),
        "min": F.min(c),
        "median": F.percentile_approx(c, 0.5, 10000),  # bounded memory; the exact one is ``exact_quantiles``
    }[mode]


def aggregate(df: DataFrame, x: str, modes, by: list[str] | None = None, exact_median: bool = True) -> DataFrame:
    """Size, mean, std (population), max, min, median of ``x``, per group when ``by`` is given.

    An array column is exploded first.  All combine map-side (partial aggregation), so a hot group costs
    no more than a cold one; the exact median is selected by rank (``exact_quantiles``).
    """
    ms = _modes(modes)
    by = list(by or [])
    if isinstance(df.schema[x].dataType, ArrayType):
        df = df.select(*by, F.explode(x).alias(x))
    plain = [m for m in ms if m != "median" or not exact_median]
    out = (df.groupBy(*by) if by else df).agg(*[mode_column(m, x).alias(f"{x}_{m}") for m in plain] or [F.count(F.lit(1)).alias("_n")])
    if len(plain) == len(ms):
        return out
    half = exact_quantiles(df, x, [0.5], by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q0").alias(f"{x}_median"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(half, same, "left").select(*by, *[f"{x}_{m}" for m in ms])


def _bucket(x: Column, low: Column, high: Column, buckets: int) -> Column:
    """A bucket that never goes down as x goes up: the infinities and NaN (last) have their own."""
    step = high / buckets - low / buckets
    step = F.when(step > 0, step).otherwise(high - low)
    inner = F.when(high > low, F.least(F.greatest(F.floor((x - low) / step), F.lit(0)), F.lit(buckets - 1))).otherwise(F.lit(0))
    return (F.when(F.isnan(x), F.lit(buckets + 1)).when(x == float("inf"), F.lit(buckets)).when(x == float("-inf"), F.lit(-1)).otherwise(inner)).cast("int")


def exact_quantiles(df: DataFrame, x: str, shares: list[float], by: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """(by.., q0, q1, ..): the quantiles of ``x`` at ``shares`` for each group, exact, interpolated between neighbours.

    Selection by rank: a histogram of every group's range (one partial aggregate) tells the bucket of each
    wanted rank; only rows of such buckets go on, in ranges narrowed to what the bucket holds, until a bucket
    has one value.  Ranges narrow ``buckets`` times a pass, and equal values end it at once, so a group of any
    size, ties included, is never gathered in one task.  Nulls are left out; a group of nulls has none; NaN is
    the largest value.
    """
    by = list(by or [])
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = cut_lineage(df.select(key.alias("k"), F.lit(0).alias("part"), F.col(x).cast("double").alias("x")).where(F.col("x").isNotNull()))
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    groups = cut_lineage(rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = [F.struct(F.lit(2 * i + j).alias("t"), f(place(q)).cast("long").alias("r")) for i, q in enumerate(shares) for j, f in enumerate((F.floor, F.ceil))]
    targets = groups.select("k", "part", F.explode(F.array(*ranks)).alias("w")).select("k", "part", "w.t", "w.r")
    ranges, found = groups.select("k", "part", "low", "high"), None
    while True:
        placed = rows.join(ranges, ["k", "part"]).select("k", "part", "x", _bucket(F.col("x"), F.col("low"), F.col("high"), buckets).alias("bucket"))
        cells = placed.groupBy("k", "part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        up_to = Window.partitionBy("k", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` + 3 rows at most
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
        hit = targets.join(cells, ["k", "part"]).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("n")))
        hit = cut_lineage(hit.select("k", "part", "t", (F.col("r") - F.col("before")).alias("r"), "bucket", "low", "high"))
        one = F.col("low") == F.col("high")  # in Spark, NaN equals NaN
        done = hit.where(one).select("k", "t", F.col("low").alias("v"))
        found = done if found is None else found.unionByName(done)
        left = hit.where(~one)
        if left.isEmpty():
            break
        chosen = left.groupBy("k", "part", "bucket").agg(F.min("t").alias("next"), F.first("low").alias("low"), F.first("high").alias("high"))
        rows = cut_lineage(placed.join(chosen.select("k", "part", "bucket", "next"), ["k", "part", "bucket"]).select("k", F.col("next").alias("part"), "x"))
        targets = left.join(chosen.select("k", "part", "bucket", "next"), ["k", "part", "bucket"]).select("k", F.col("next").alias("part"), "t", "r")
        ranges = chosen.select("k", F.col("next").alias("part"), "low", "high")
    at = groups.select("k", "n")
    each = found.groupBy("k").agg(*[F.max(F.when(F.col("t") == t, F.col("v"))).alias(f"v{t}") for t in range(2 * len(shares))]).join(at, "k")
    def between(i):
        low, high, share = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), place(shares[i]) - F.floor(place(shares[i]))
        return F.when(low == high, low).otherwise(low + (high - low) * share).alias(f"q{i}")

    return each.select(*[F.col("k")[c].alias(c) for c in by], *[between(i) for i in range(len(shares))])


def corr_with_label(x, y) -> Column:
    """Pearson correlation, 0 when either side is constant (no division error under ANSI).

    A list of several columns for ``x`` has no single coefficient; its contract value is 1.
    """
    if isinstance(x, (list, tuple)):
        if len(x) > 1:
            return F.lit(1.0)
        x = x[0]
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    den = F.stddev_pop(x.cast("double")) * F.stddev_pop(y.cast("double"))
    return F.coalesce(F.covar_pop(x.cast("double"), y.cast("double")) / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, positives and positive rate."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"),
                  F.avg(F.col(label).cast("double")).alias("pos_rate"))


def log_loss(y, p) -> Column:
    """Binary cross entropy after clipping."""
    c = D.cut_prob(p)
    y = F.col(y) if isinstance(y, str) else y
    return F.avg(-(y * F.ln(c) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - c)))


def accuracy(y, p, threshold: float = 0.5) -> Column:
    """Share of rows where ``p > threshold`` equals the label."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    return F.avg(((p > threshold).cast("int") == y).cast("double"))


def ensemble_mean(predictions: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Mean of several prediction sets stacked as rows (key, set, score)."""
    return predictions.groupBy(key).agg(F.avg(score).alias("score"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half (M11), over the scores as they are.

    Rows with one score are one row of counts.  These are range-sorted and checkpointed; negatives
    below a score are counted within its partition and added to the totals of the partitions
    before, one row each.  Rows without a score or a label are left out.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    per = cut_lineage(per.orderBy("s")).withColumn("part", F.spark_partition_id())
    totals = per.groupBy("part").agg(F.sum("neg").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("neg_before"))
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = per.withColumn("neg_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(totals, "part")
    return below.agg(D.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg_inside") + F.col("neg") / 2.0)),
                                  F.sum("pos") * F.sum("neg")).alias("auc"))


def evaluate(df: DataFrame, label: str = "label", score: str = "score", fold: str | None = None) -> DataFrame:
    """Log-loss and accuracy overall (and the mean of per-fold log-loss)."""
    overall = df.agg(log_loss(label, score).alias("log_loss"), accuracy(label, score).alias("accuracy"),
                     F.avg(score).alias("mean_score"))
    if fold is None:
        return overall
    per_fold = df.groupBy(fold).agg(log_loss(label, score).alias("fold_loss"))
    return overall.join(per_fold.agg(F.avg("fold_loss").alias("mean_fold_loss")), how="cross")
