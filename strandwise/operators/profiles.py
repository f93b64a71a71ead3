"""Quantile profiles, summary tables and macro averages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail
from .skew import cut_lineage, hot_keys, null_safe_join, running, with_parts

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float], **extra: Column) -> DataFrame:
    """Exact linearly interpolated quantiles (position (n-1)p) per group.

    ``extra`` names further aggregates for the same pass. Ordinary groups use
    Spark's exact ``percentile``. Groups too large for one aggregation buffer are
    reduced to counts per distinct value, ranked by running totals over value
    slices, and read off at the wanted positions.
    """
    src = df.withColumn("_x", F.col(x).cast("double"))
    qs = F.array(*[F.lit(p) for p in probs.values()])
    more = [c.alias(n) for n, c in extra.items()]

    def builtin(part: DataFrame) -> DataFrame:
        found = part.groupBy(*keys).agg(F.percentile("_x", qs).alias("_q"), *more)
        return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)], *extra)

    hot = hot_keys(src, keys)
    if hot is None:
        return builtin(src)
    split = with_parts(src, hot, keys, "_parts")
    small = builtin(split.where(F.col("_parts").isNull()))
    large = split.where(F.col("_parts").isNotNull())
    counts = cut_lineage(large.where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")))
    sizes = large.groupBy(*keys).agg(F.count("_x").alias("_rows"), *more)  # hot keys only: bounded
    placed = running(counts, keys, ["_x"], _before=F.col("_n"))
    placed = null_safe_join(placed, F.broadcast(sizes.select(*keys, "_rows")), keys)
    aggs: list[Column] = []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("_rows") - 1)
        low, high = F.floor(at), F.ceil(at)

        def here(pos: Column) -> Column:
            return (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_n"))

        aggs += [
            F.max(F.when(here(low), F.col("_x"))).alias(f"_{n}_a"),
            F.max(F.when(here(high), F.col("_x"))).alias(f"_{n}_b"),
            F.max(at - low).alias(f"_{n}_f"),
        ]
    ends = placed.groupBy(*keys).agg(*aggs)
    big = null_safe_join(sizes, ends, keys).select(
        *keys,
        *[(F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")).alias(n) for n in probs],
        *extra,
    )
    return small.unionByName(big)


def quantile_summary(df: DataFrame, keys: list[str], x: str, probs: dict[str, float] | None = None) -> DataFrame:
    """Rows, mean and quantiles of a measure per group."""
    return exact_quantiles(df, keys, x, probs or QUARTILES, n=F.count(F.lit(1)), mean=F.avg(x))


def profile_by_each(df: DataFrame, dims: list[str], x: str, probs: dict[str, float] | None = None) -> DataFrame:
    """The same profile by each of many dimensions, stacked as (class, type)."""
    rows = cut_lineage(df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(x).alias("_m")))
    long = rows.unpivot(["_m"], dims, "class", "type")  # read again by each step for hot groups
    return quantile_summary(long, ["class", "type"], "_m", probs)


def macro_mean(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Mean over groups of the group means (one row)."""
    means = df.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])
    return means.agg(*[F.avg(v).alias(v) for v in values])


def group_profile(df: DataFrame, type_col: str, id_col: str, measures: list[str]) -> DataFrame:
    """Distinct ids, mean and quartiles per (type, measure)."""
    long = df.where(F.col(type_col).isNotNull()).unpivot(
        [type_col, id_col], [F.col(m).cast("double").alias(m) for m in measures], "variable", "value"
    )
    ids = long.groupBy(type_col, "variable").agg(F.count_distinct(id_col).alias("n"))
    q = exact_quantiles(long, [type_col, "variable"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, mean=F.avg("value"))
    return ids.join(q, [type_col, "variable"])


def table_one_numeric(df: DataFrame, measures: list[str], strata: str) -> DataFrame:
    """Mean and standard deviation per stratum, with the one-way F statistic.

    F comes from grouped sums only: one pass, then a handful of rows per measure.
    """
    long = df.unpivot([strata], [F.col(m).cast("double").alias(m) for m in measures], "variable", "value").where(
        F.col("value").isNotNull()
    )
    by = long.groupBy("variable", strata).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("_var")
    )
    w = Window.partitionBy("variable")  # one row per stratum
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    groups = F.count(F.lit(1)).over(w)
    total = F.sum("n").over(w)
    by = by.withColumn("_grand", grand).withColumn("_k", groups).withColumn("_total", total)
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).over(w) / (F.col("_k") - 1)
    within = F.sum((F.col("n") - 1) * F.coalesce(F.col("_var"), F.lit(0.0))).over(w) / (F.col("_total") - F.col("_k"))
    return by.select(
        "variable",
        strata,
        "n",
        "mean",
        F.sqrt("_var").alias("sd"),
        (between / F.nullif(within, F.lit(0.0))).alias("f_stat"),
        (F.col("_k") - 1).alias("df1"),
        (F.col("_total") - F.col("_k")).alias("df2"),
    )


def table_one_categorical(df: DataFrame, variables: list[str], strata: str) -> DataFrame:
    """Count and percent of each level per stratum, with the chi-square statistic."""
    long = df.select(F.col(strata), *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(
        [strata], variables, "variable", "level"
    )
    cells = long.groupBy("variable", "level", strata).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("variable", "level").agg(F.sum("n").alias("_row"))
    cols = cells.groupBy("variable", strata).agg(F.sum("n").alias("_col"))
    alls = cells.groupBy("variable").agg(F.sum("n").alias("_all"))
    full = cells.join(rows, ["variable", "level"]).join(cols, ["variable", strata]).join(alls, "variable")
    expected = F.col("_row") * F.col("_col") / F.col("_all")
    # Empty cells add their expected count; summed per variable as N minus what the
    # filled cells expect.
    stat = full.groupBy("variable").agg(
        (F.sum(F.pow(F.col("n") - expected, 2) / expected) + F.max("_all") - F.sum(expected)).alias("chi2"),
        ((F.count_distinct("level") - 1) * (F.count_distinct(strata) - 1)).alias("df"),
    )
    return full.join(stat, "variable").select(
        "variable", "level", strata, "n", (F.col("n") * 100 / F.col("_col")).alias("percent"), "chi2", "df"
    )


def with_p_value(df: DataFrame, stat: str, df1: str, df2: str | None = None) -> DataFrame:
    """Add the upper tail area ``p``: F when two degrees of freedom, else chi-square.

    Meant for summary tables, which have a handful of rows.
    """
    @F.pandas_udf("double")
    def f_area(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_tail(*v) if v[0] == v[0] else None for v in zip(s, a, b)], dtype="float64")

    @F.pandas_udf("double")
    def chi_area(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(*v) if v[0] == v[0] else None for v in zip(s, a)], dtype="float64")

    return df.withColumn("p", f_area(stat, df1, df2) if df2 else chi_area(stat, df1))
