"""Entropy per group, rolling means, change points and interval bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach, cut_lineage, hot_keys, running, with_stats


def entropy_by(df: DataFrame, keys: list[str], cat: str, weighted: bool = False) -> DataFrame:
    """Shannon entropy (natural log) of the category shares per group.

    With n the count of a category and N the rows of the group, entropy is
    ln N - sum(n ln n) / N, which needs no join or window. The weighted form counts
    a category's rate once per row, so its weights are n * n.
    """
    counts = df.where(F.col(cat).isNotNull()).groupBy(*keys, cat).agg(
        F.count(F.lit(1)).cast("double").alias("_n")
    )
    n = F.col("_n")
    if weighted:
        value = F.ln(F.sum(n * n)) - F.sum(n * n * F.ln(n)) / F.sum(n * n)
    else:
        value = F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)
    return counts.groupBy(*keys).agg(F.greatest(value, F.lit(0.0)).alias("entropy"))


ENTROPY_MEASURES = [
    "topic_entropy",
    "topic_sentiment_entropy",
    "sentiment_entropy",
    "positive_topic_entropy",
    "negative_topic_entropy",
]


def chapter_entropy(
    df: DataFrame, chapter: str, topic: str, sentiment: str, positive: str, negative: str, weighted: bool = False
) -> DataFrame:
    """Five entropy measures per chapter; rows whose topic is -1 or null are left out."""
    t = F.col(topic).cast("string")
    s = F.col(sentiment)
    cats = df.where(F.col(topic) > -1).select(
        chapter,
        t.alias("topic_entropy"),
        F.concat_ws("_", t, s).alias("topic_sentiment_entropy"),
        s.alias("sentiment_entropy"),
        F.when(s == positive, t).alias("positive_topic_entropy"),
        F.when(s == negative, t).alias("negative_topic_entropy"),
    )
    long = cats.unpivot([chapter], ENTROPY_MEASURES, "variable", "value")
    return entropy_by(long, [chapter, "variable"], "value", weighted)


def rolling_mean(df: DataFrame, keys: list[str], order: str, x: str, width: int, name: str) -> DataFrame:
    """Right-aligned mean of ``width`` rows, null until full or when a value is missing.

    A series small enough for one task uses a plain row frame. Otherwise rows are
    numbered, cut into runs, and each run borrows the last ``width - 1`` rows before
    it, so every run is computed on its own.
    """

    def frame(w: Window) -> Column:
        over = w.rowsBetween(-(width - 1), Window.currentRow)
        return F.when(F.count(x).over(over) == width, F.avg(x).over(over))

    if hot_keys(df, keys) is None:
        return df.withColumn(name, frame(Window.partitionBy(*keys).orderBy(order)))
    placed = running(df, keys, [order], _at=F.lit(1))
    size = max(width * 64, 65_536)
    run = F.floor(F.col("_at") / size)
    lends = F.col("_at") % size >= size - (width - 1)
    copies = placed.withColumn("_run", F.explode(F.when(lends, F.array(run, run + 1)).otherwise(F.array(run))))
    rolled = copies.withColumn(name, frame(Window.partitionBy(*keys, "_run").orderBy("_at")))
    return rolled.where(F.col("_run") == run).drop("_run", "_at")


def interval_bin(col: Column, breaks: list[float]) -> Column:
    """Bin number over (a, b] intervals, the first closed below, outside gives null."""
    expr = F.when((col >= breaks[0]) & (col <= breaks[1]), F.lit(1))
    for i in range(1, len(breaks) - 1):
        expr = expr.when((col > breaks[i]) & (col <= breaks[i + 1]), F.lit(i + 1))
    return expr.cast("long")


LOG_2PI = math.log(2 * math.pi)


def _cost(n: Column, s1: Column, s2: Column) -> Column:
    """Twice the negative normal log-likelihood of a segment, mean and variance free."""
    var = (s2 - s1 * s1 / n) / n
    var = F.when(var <= 0, F.lit(1e-11)).otherwise(var)
    return n * (F.lit(LOG_2PI) + F.ln(var) + 1)


def change_points(
    df: DataFrame, keys: list[str], order: str, x: str, q: int = 15, min_len: int = 2, penalty: float | None = None
) -> DataFrame:
    """Mean-and-variance change points per series by binary segmentation.

    Each round splits, in every series at once, the segment whose best split lowers
    the cost most, until ``q`` points or no split beats the penalty (default
    4 ln n). Costs come from running sums, so a round is one narrow pass over the
    rows of the segments made in the round before, and only one row per open
    segment is kept between rounds. The result has one row per change point: the
    last position (``at``, from 1), its order value and the gain.
    """
    src = df.where(F.col(x).isNotNull()).select(*keys, F.col(order).alias("_t"), F.col(x).cast("double").alias("_x"))
    src = with_stats(src, keys, _mu=F.avg("_x"))  # centring keeps the squares small
    src = src.withColumn("_x", F.col("_x") - F.col("_mu"))
    sums = running(src, keys, ["_t"], _n=F.lit(1), _s1=F.col("_x"), _s2=F.col("_x") * F.col("_x"))
    sums = cut_lineage(
        sums.select(
            *keys,
            "_t",
            (F.col("_n") + 1).alias("_n"),
            (F.col("_s1") + F.col("_x")).alias("_s1"),
            (F.col("_s2") + F.col("_x") * F.col("_x")).alias("_s2"),
        )
    )
    whole = sums.groupBy(*keys).agg(
        F.max("_n").alias("_len"), F.max_by("_s1", "_n").alias("_b1"), F.max_by("_s2", "_n").alias("_b2")
    )
    pen = F.lit(float(penalty)) if penalty is not None else 4 * F.ln(F.col("_len").cast("double"))
    fresh = whole.select(
        *keys,
        pen.alias("_pen"),
        F.lit(0).cast("long").alias("_a"),
        F.lit(0.0).alias("_a1"),
        F.lit(0.0).alias("_a2"),
        F.col("_len").cast("long").alias("_b"),
        "_b1",
        "_b2",
    )
    seg_cols = fresh.columns
    hot = hot_keys(sums, keys)

    def scored(segments: DataFrame) -> DataFrame:
        """Best split of each segment; at most two fresh segments per series."""
        packed = segments.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in seg_cols if c not in keys])).alias("_segs"))
        rows = attach(sums, packed, keys, "inner", hot)
        rows = rows.select(*keys, "_t", "_n", "_s1", "_s2", F.explode("_segs").alias("_g")).where(
            (F.col("_n") >= F.col("_g._a") + min_len) & (F.col("_n") <= F.col("_g._b") - min_len)
        )
        g = {c: F.col(f"_g.{c}") for c in seg_cols if c not in keys}
        left = _cost(F.col("_n") - g["_a"], F.col("_s1") - g["_a1"], F.col("_s2") - g["_a2"])
        right = _cost(g["_b"] - F.col("_n"), g["_b1"] - F.col("_s1"), g["_b2"] - F.col("_s2"))
        both = _cost(g["_b"] - g["_a"], g["_b1"] - g["_a1"], g["_b2"] - g["_a2"])
        rows = rows.withColumn("_gain", both - left - right)
        pick = F.struct(F.round("_gain", 9), -F.col("_n"))
        best = rows.groupBy(*keys, *[v.alias(c) for c, v in g.items()]).agg(
            F.max_by(F.struct("_gain", "_n", "_s1", "_s2", "_t"), pick).alias("_best")
        )
        return best.where(F.col("_best._gain") > F.col("_pen"))

    found = None
    open_segs = cut_lineage(scored(fresh))
    for step in range(q):
        if open_segs.isEmpty():
            break
        fields = F.struct(*[c for c in open_segs.columns if c not in keys])
        pick = F.struct(F.round("_best._gain", 9), -F.col("_a"))
        top = open_segs.groupBy(*keys).agg(F.max_by(fields, pick).alias("_top")).select(*keys, "_top.*")
        b = F.col("_best")
        point = top.select(*keys, b["_n"].alias("at"), b["_t"].alias("at_order"), b["_gain"].alias("gain"))
        found = point if found is None else found.unionByName(point)
        if step == q - 1:
            break
        cut = {"_n": b["_n"].cast("long"), "_s1": b["_s1"], "_s2": b["_s2"]}
        low = top.select(*keys, "_pen", "_a", "_a1", "_a2", cut["_n"].alias("_b"), cut["_s1"].alias("_b1"), cut["_s2"].alias("_b2"))
        high = top.select(*keys, "_pen", cut["_n"].alias("_a"), cut["_s1"].alias("_a1"), cut["_s2"].alias("_a2"), "_b", "_b1", "_b2")
        rest = open_segs.join(top.select(*keys, "_a"), [*keys, "_a"], "left_anti")
        open_segs = cut_lineage(rest.unionByName(scored(low.unionByName(high))))
    if found is None:
        return sums.select(*keys, F.col("_n").alias("at"), F.col("_t").alias("at_order"), F.col("_s1").alias("gain")).limit(0)
    return found


def segments(df: DataFrame, keys: list[str], order: str, points: DataFrame) -> DataFrame:
    """Segment number of each row: 1 plus the change points before its order value.

    A series has at most a few dozen points, so they travel as one short array.
    """
    cuts = points.groupBy(*keys).agg(F.collect_list("at_order").alias("_cuts"))
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))
    return attach(df, cuts.withColumn("_cuts", F.col("_cuts").cast("array<double>")), keys).withColumn(
        "segment", (before + 1).cast("long")
    ).drop("_cuts")
