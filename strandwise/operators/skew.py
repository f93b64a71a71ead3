"""Shared handling of hot keys, ordering and lineage.

A key is *hot* when it holds more rows than ``max(hot.minRows, rows / 100_000)``.
By arithmetic there are at most 100,000 hot keys, and cutting each into
``ceil(rows / threshold)`` parts makes at most 200,000 parts in total, so tables
of hot keys and of their parts have a proven bound and are safe to broadcast.
Every other key fits comfortably into one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_ROWS_CONF = "strandwise.hot.minRows"
MIN_ROWS = 1_000_000
MAX_HOT = 100_000
#: Rows of a task where rows are dealt out by number.
TASK_ROWS = 400_000
#: Slices of a hot key per part, and boundaries that one step of the search for a slice reads.
SLICES, STEP = 4, 512
#: Checkpoint folder of local sessions that name none; a cluster has to name a shared one.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def pick_hot(counts: DataFrame) -> DataFrame | None:
    """The hot rows of a table of keys with their row counts (``_rows``)."""
    spark = counts.sparkSession
    floor = int(spark.conf.get(MIN_ROWS_CONF, str(MIN_ROWS)))
    total = counts.agg(F.sum("_rows").alias("_total")).scalar()
    limit = F.greatest(F.lit(floor), F.ceil(total / F.lit(MAX_HOT)))
    found = counts.where(F.col("_rows") > limit).withColumn("_parts", F.ceil(F.col("_rows") / limit).cast("int"))
    rows = found.collect()  # at most MAX_HOT rows, see the module text
    if not rows:
        return None
    return spark.createDataFrame(rows, found.schema)


def hot_keys(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame | None:
    """Hot keys of ``df`` with ``_rows``, ``_parts`` and optional extra aggregates.

    Returns ``None`` when no key is hot, so callers keep the plain plan. One
    narrow, map-side combined pass over the key columns decides it.
    """
    return pick_hot(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in stats.items()]))


def null_safe_join(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys."""
    renamed = side.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def with_parts(df: DataFrame, hot: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Put columns of the bounded hot-key table on every row (null for other keys)."""
    return null_safe_join(df, F.broadcast(hot.select(*keys, *cols)), keys)


def _hashable(df: DataFrame) -> list[Column]:
    """The columns as hash input; maps, which Spark does not hash, as their JSON text."""
    return [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]


_ASK = object()


def attach(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left", hot=_ASK) -> DataFrame:
    """Equi-join ``df`` with ``side`` on ``keys``, spreading hot keys of ``df``.

    Rows of a hot key get a salt from a hash of the whole row (stable when a task
    is run again), and the matching rows of ``side`` are repeated once per salt.
    Rows that are equal in every column share a salt. Other keys join as usual.
    Loops pass the ``hot_keys`` result they already have.
    """
    if hot is _ASK:
        hot = hot_keys(df, keys)
    if hot is None:
        return df.join(side, keys, how)
    salted = with_parts(df, hot, keys, "_parts").withColumn(
        "_salt", F.pmod(F.xxhash64(*_hashable(df)), F.coalesce("_parts", F.lit(1)))
    )
    copies = with_parts(side, hot, keys, "_parts").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
    )
    return salted.drop("_parts").join(copies.drop("_parts"), [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, keys: list[str], most: int = TASK_ROWS) -> DataFrame:
    """Rows hashed by their keys to tasks of about ``most`` rows each; as they are if a key is hot.

    Adaptive plans join small shuffle parts up to a size in bytes, compressed; what a task then sorts
    or hashes is many times that, and grows with the table. A given number of parts is left alone.
    """
    if hot_keys(df, keys) is not None:
        return df
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Group aggregates on each row.

    The aggregate table is written once; it also names the hot keys, so the rows
    themselves are read only twice (aggregate, join).
    """
    table = cut_lineage(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in stats.items()])
    )
    return attach(df, table.drop("_rows"), keys, "left", pick_hot(table.select(*keys, "_rows")))


def _slice_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted cuts lie below the value; reads two short runs of them."""
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / STEP).cast("int")), lambda i: F.get(cuts, i * STEP))
    group = F.greatest(F.size(F.filter(heads, lambda h: h < value)) - 1, F.lit(0))
    return group * STEP + F.size(F.filter(F.slice(cuts, group * STEP + 1, STEP), lambda c: c < value))


def blocked(df: DataFrame, keys: list[str], order: Column) -> tuple[DataFrame, bool]:
    """Add ``_block``: 0 for ordinary keys, a rising slice number inside hot keys.

    ``order`` is the numeric leading sort value. A hot key is cut at quantiles of its own
    values (equal values stay in one slice), so that (key, block) is a balanced grouping
    that still follows the order, whatever outliers there are. Keys of like size are cut
    together, so all boundaries are within 16 times the parts (see the module text).
    Returns the frame and whether any key is hot.
    """
    src = df.withColumn("_ord", order.cast("double"))
    hot = hot_keys(src, keys)
    if hot is None:
        return src.withColumn("_block", F.lit(0).cast("long")).drop("_ord"), False
    sized = hot.withColumn("_size", F.ceil(F.log2("_parts")).cast("int"))
    cuts = None
    for (size,) in sized.select("_size").distinct().collect():  # a row per power of two
        n = SLICES * 2**size
        rows = with_parts(src, sized.where(F.col("_size") == size), keys, "_size").where("_size is not null")
        part = rows.groupBy(*keys).agg(F.percentile_approx("_ord", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("_cuts"))
        cuts = part if cuts is None else cuts.unionByName(part)
    cut = with_parts(src, cut_lineage(cuts), keys, "_cuts")
    block = F.when(F.size("_cuts") > 0, _slice_of(F.col("_ord"), F.col("_cuts")))
    return cut.withColumn("_block", F.coalesce(block, F.lit(0)).cast("long")).drop("_ord", "_cuts"), True


def running(df: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Sum over the earlier rows of the key (exclusive) for each named expression.

    ``order[0]`` must be numeric; the full list must be a total order in the key.
    Hot keys are summed slice by slice, with the slice totals carried forward.
    """
    values = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    cut, is_hot = blocked(values, keys, F.col(order[0]))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    if is_hot:
        totals = cut.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
        )
        out = null_safe_join(out, carry, [*keys, "_block"])
        out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums})
        out = out.drop(*[f"_c_{n}" for n in sums])
    return out.drop("_block", *[f"_v_{n}" for n in sums])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session without one uses a folder of its machine; elsewhere executors could
    not read such a folder, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """Row number 1..n over a total order, without one task seeing all rows.

    Range partitions are sorted and written once; each row's number is its place
    in the partition plus the sizes of the earlier partitions (one row each).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_at") + F.col("_off") + 1)
        .drop("_part", "_at", "_off")
    )


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the checkpoint folder and read from there.

    For loops that join what they have settled: a checkpoint keeps the size estimate of its
    plan, and joins multiply estimates round by round; a table has its true size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and that no later plan reads; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        root = f"{checkpoint_dir(spark).rstrip('/')}/table-"
        files = df.inputFiles()
        at = files[0].find("/table-") if files else -1
        if at >= 0 and root.split("://")[-1].split(":", 1)[-1].strip("/") in files[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0][: at + len("/table-") + 32])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of a total order, without one task seeing all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row per range partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_off")
    )


def scalar_of(df: DataFrame, agg: Column) -> Column:
    """One aggregate of the whole table, usable in expressions over any table."""
    return df.agg(agg.alias("_one")).scalar()

