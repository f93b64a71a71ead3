"""Lookups, set membership, dense grids, shares, rankings and category handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach, cut_lineage, numbered, pick_hot, with_stats


def first_by_key(dim: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in ``order`` (combines on the map side)."""
    rest = [c for c in dim.columns if c != key]
    picked = dim.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, dim_key: str, order: str, name: str) -> DataFrame:
    """Put ``dim.value`` on each row by key; first match wins, unmatched gives null."""
    side = dim.groupBy(F.col(dim_key).alias(key)).agg(F.min_by(value, order).alias(name))
    return attach(df, side, [key])


def keep_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return attach(df, other.select(*keys).distinct(), keys, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return attach(df, other.select(*keys).distinct(), keys, "left_anti")


def map_columns(df: DataFrame, cols: list[str], fn) -> DataFrame:
    """Apply one column function over many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def recode(col: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Level to label, as one conditional expression."""
    expr = F.lit(None).cast("string") if default is None else default
    for level, label in reversed(list(mapping.items())):
        expr = F.when(col == level, F.lit(label)).otherwise(expr)
    return expr


def level_rank(col: Column, levels: list[str]) -> Column:
    """Position of a level in its declared order, from 1; other levels give null."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(pos > 0, pos).cast("long")


def others(col: Column, keep: list[str], label: str = "Others") -> Column:
    """Levels outside a fixed list become one level."""
    return F.when(col.isin(*keep), col).otherwise(F.lit(label))


def experience_bin(col: Column) -> Column:
    """Years as text (``None`` for none) to the bins 0, 1~2, 3~4, 5+."""
    years = F.when(col == "None", F.lit(0)).otherwise(col.try_cast("int"))
    return (
        F.when(years == 0, F.lit("0"))
        .when(years < 3, F.lit("1~2"))
        .when(years < 5, F.lit("3~4"))
        .when(years >= 5, F.lit("5+"))
    )


def densify(df: DataFrame, keys: list[str], cat: str, cats: list[str], values: list[str]) -> DataFrame:
    """One row per key and category of a fixed list; missing cells are 0.

    The keys are deduplicated and the list exploded beside them, which needs no
    cross join.
    """
    grid = df.select(*keys).distinct().withColumn(cat, F.explode(F.array(*[F.lit(c) for c in cats])))
    return grid.join(df.select(*keys, cat, *values), [*keys, cat], "left").na.fill(0, values)


def with_total(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Group total on each row: aggregate, then join back (no window over a group)."""
    if not keys:
        return df.withColumn(name, df.agg(F.sum(value).alias("_t")).scalar())
    return with_stats(df, keys, **{name: F.sum(value)})


def share_of(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Value divided by the total of its group (or of the table when no keys)."""
    return with_total(df, keys, F.col(value), "_total").withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def group_stat(df: DataFrame, keys: list[str], stat: Column, name: str) -> DataFrame:
    """Any group aggregate on each row."""
    return with_stats(df, keys, **{name: stat})


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark trims each input partition to k rows per
    group before the shuffle, so a hot group never gathers in one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def lump_n(df: DataFrame, col: str, n: int, other: str = "Other", name: str | None = None) -> DataFrame:
    """Keep the n most frequent levels (ties kept), the rest become ``other``."""
    counts = cut_lineage(df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")))
    hot = pick_hot(counts.withColumnRenamed("_n", "_rows"))
    nth = counts.orderBy(F.desc("_n")).limit(n).agg(F.min("_n").alias("_m")).scalar()
    kept = counts.where(F.col("_n") >= nth).select(col, F.lit(True).alias("_keep"))
    level = F.when(F.col("_keep"), F.col(col)).otherwise(F.lit(other))
    return attach(df, kept, [col], "left", hot).withColumn(name or col, level).drop("_keep")


def category_order(df: DataFrame, col: str, by: Column, descending: bool = True) -> DataFrame:
    """Order number of each level by an aggregate, ties by the level itself."""
    levels = df.groupBy(col).agg(by.alias("_by"))
    lead = F.desc("_by") if descending else F.asc("_by")
    return numbered(levels, [lead, F.col(col)], "position").select(col, "position")


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Dense numbering 1..n of the distinct keys in their sort order."""
    return numbered(df.select(*keys).distinct(), [F.col(k) for k in keys], name)


def overlap_regions(df: DataFrame, id_col: str, set_col: str, sets: list[str]) -> DataFrame:
    """Ids per region of overlapping sets (three sets give seven cells).

    Each id carries one bit per set, merged with ``bit_or`` on the map side.
    """
    pos = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col(set_col)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), pos - 1)
    masks = df.where(F.col(set_col).isin(*sets)).groupBy(id_col).agg(F.bit_or(bit).alias("_mask"))
    parts = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(s)) for i, s in enumerate(sets)]
    return masks.groupBy("_mask").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws("&", *parts).alias("region"), "n"
    )


def label_rate(entities: DataFrame, labels: DataFrame, id_col: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Share of the entities that carry each label, overall or by segment.

    Only entities with at least one label count; each (entity, label) counts once.
    """
    by = by or []
    pairs = labels.select(id_col, label).distinct()
    joined = attach(pairs, entities.select(id_col, *by), [id_col], "inner")
    base = joined.groupBy(*by).agg(F.count_distinct(id_col).alias("total"))
    counts = joined.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if by:
        counts = counts.join(base, by)
    else:
        counts = counts.withColumn("total", base.scalar())
    return counts.withColumn("rate", F.col("n") / F.col("total"))


def distinct_over_rows(df: DataFrame, group: list[str], sub: list[str], id_col: str) -> DataFrame:
    """Distinct ids of a subgroup over the *row* count of its group.

    The two units differ on purpose: that is the rate the analyses report.
    """
    rows = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    ids = df.groupBy(*group, *sub).agg(F.count_distinct(id_col).alias("n"))
    return ids.join(rows, group).withColumn("rate", F.col("n") / F.col("total"))


def indicators(df: DataFrame, id_col: str, label: str, prefix: str, values: list[str] | None = None) -> DataFrame:
    """Multi-label long table to one boolean column per label.

    Without ``values`` the distinct labels are read first; like Spark's own pivot
    this refuses more than ``spark.sql.pivotMaxValues`` columns.
    """
    if values is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"more than {limit} labels: pass values")
        values = sorted(found)
    cols = [F.coalesce(F.bool_or(F.col(label) == v), F.lit(False)).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(id_col).agg(*cols)


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """One row per key with its values as an array in order, whatever the length.

    The array is the result that is asked for; profiles and rates are counted from
    the long table instead, so only callers that want lists hold one.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(items.alias("_items")).select(*keys, F.transform("_items", lambda s: s["_v"]).alias(name))


def repeat_to_total(col: Column, unit: float) -> Column:
    """Array of whole units followed by the remainder (0.05 by 0.02 is 0.02, 0.02, 0.01)."""
    whole = F.floor(col / F.lit(unit))
    return F.concat(
        F.array_repeat(F.lit(unit), whole.cast("int")), F.array(col - whole * F.lit(unit))
    )


def scaled(df: DataFrame, col: str, name: str, signed: bool = False) -> DataFrame:
    """Min-max scaling over the table to [0, 1], or to [-1, 1] when signed.

    A column with a single value gives null.
    """
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("_e"))
    lo, hi = ends.select("_e.lo").scalar(), ends.select("_e.hi").scalar()
    unit = (F.col(col) - lo) / F.nullif(hi - lo, F.lit(0))
    return df.withColumn(name, unit * 2 - 1 if signed else unit)
