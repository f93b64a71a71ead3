"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash of its doc_id and text. Per source, tokens are summed by the high hash bits;
the bucket in which the budget runs out is the only one that is refined, by the next bits,
until one hash value is left. A document is taken when its hash lies below the threshold of
its source, so nothing is sorted and no row moves but in small sums.

Defined cases: a null text has size 0; null sources form one source, last in order; rows
that share a doc_id (or have none) are told apart by their texts, rows equal in both are taken together; a source without tokens has target 0; an
empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import numbered
from .common import fresh, lookup, n_words, settled

#: Bits of the hash, refined in these steps; the first step bounds the buckets of a source by 4,096.
BITS, STEPS = 60, (12, 24, 24)
WEIGHTS = (1, 2, 3)
MOST = 3


def _hash() -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """Sources as text that is never null; the null source differs from every other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: its tokens and its target.

    Sources in code point order, null last, carry the weights in turn and share all tokens.
    A target stops at ``most`` times the tokens of its source and the excess is shared again:
    the level (target per unit of weight) rises until no further source is capped.
    """
    per = sizes.groupBy("_src", "_null").agg(F.sum("_size").alias("source_size"))
    ranked = numbered(per, ["_null", "_src"], "_rn")
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = settled(ranked.select("_src", "source_size", share.cast("long").alias("_w"), (most * F.col("source_size")).alias("_cap")))
    level = None
    while True:  # each round caps at least one more source, or ends
        over = F.lit(False) if level is None else F.col("_w") * F.lit(level) > F.col("_cap")
        total, capped, free = src.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))
        ).first()
        now = ((total or 0) - (capped or 0)) / free if free else 0.0
        if level is not None and (not free or now <= level):
            break
        level = now
    return src.select(
        "_src", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_cap").cast("double")).alias("target")
    )


def _boundary(rows: DataFrame, done: int, step: int) -> DataFrame:
    """Per source the bucket in which the budget ``_left`` runs out, and what is left there."""
    bucket = F.shiftright("_hash", BITS - done - step).bitwiseAND(F.lit((1 << step) - 1))
    sums = rows.groupBy("_src", bucket.alias("_b")).agg(F.sum("_size").alias("_s"), F.max("_left").alias("_left"))
    so_far = Window.partitionBy("_src").orderBy("_b")
    cut = sums.withColumn("_cum", F.sum("_s").over(so_far)).where(F.col("_cum") > F.col("_left"))
    return cut.groupBy("_src").agg(F.min_by(F.struct("_b", "_s", (F.col("_left") - F.col("_cum") + F.col("_s")).alias("_left")), "_b").alias("_x")).select(
        "_src", F.col("_x._b").alias("_b"), F.col("_x._s").alias("_s"), F.col("_x._left").alias("_left")
    )


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: how often every document is taken, and the hash below which once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = settled(goal.withColumn("_whole", whole).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")))
    rows = lookup(sizes.where(F.col("_size") > 0), plan.select("_src", "_left"), ["_src"], "inner")
    at, done = None, 0
    for step in STEPS:
        found = settled(_boundary(rows, done, step))
        done += step
        edge = found.select("_src", "_b", "_left")
        rows = settled(
            lookup(rows.drop("_left"), edge, ["_src"], "inner")
            .where(F.shiftright("_hash", BITS - done).bitwiseAND(F.lit((1 << step) - 1)) == F.col("_b"))
            .drop("_b")
        )
        bits = found.select("_src", F.shiftleft("_b", BITS - done).alias("_bits"), "_s", "_left")
        at = bits if at is None else settled(
            at.select("_src", F.col("_bits").alias("_high")).join(bits, "_src").select("_src", (F.col("_high") + F.col("_bits")).alias("_bits"), "_s", "_left")
        )
    upto = at.select("_src", (F.col("_bits") + F.when(2 * F.col("_left") >= F.col("_s"), 1).otherwise(0)).alias("_upto"))
    return settled(plan.join(upto, "_src", "left").select("_src", "source_size", "target", "_whole", F.coalesce("_upto", F.lit(0).cast("long")).alias("_upto")))


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = docs.select(
        "doc_id", F.col("source").isNull().alias("_null"), _key(F.col("source")).alias("_src"),
        n_words(F.col("text")).alias("_size"), _hash().alias("_hash"),
    )
    sizes = settled(sizes)
    return sizes, thresholds(sizes, targets(sizes))


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    sizes, plan = _planned(docs)
    times = F.col("_whole") + (F.col("_hash") < F.col("_upto")).cast("long")
    return lookup(sizes, plan, ["_src"]).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (times * F.col("_size")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    _, plan = _planned(docs)
    key, mark = fresh(docs, "_src"), fresh(docs, "_copy")
    names = {"_whole": fresh(docs, "_whole"), "_upto": fresh(docs, "_upto")}
    side = plan.select("_src", "_whole", "_upto").withColumnsRenamed({"_src": key} | names)
    joined = lookup(docs.withColumn(key, _key(F.col("source"))), settled(side), [key])
    times = F.col(names["_whole"]) + (_hash() < F.col(names["_upto"])).cast("long")
    return (
        joined.where(times > 0)
        .withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), times)))
        .select(*docs.columns)
    )
