"""State sequences in long form ``(keys, pos, state)``: distributions, transitions,
costs, distances and clusters.

A sequence holds at most one row per minute of its time span, so a window or an
array over a single sequence is bounded by the calendar, not by the input size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .run_alignment import align_runs
from .sessions import MINUTE_US, MISSING, record_spells
from .skew import attach, cut_lineage, numbered

TILE = 2_000
#: Coordinates that the grid of close pairs is cut along, and its cells' width in radii.
GRID, WIDTH = 4, 4
#: Spells of all pairs that one step of the alignment works on.
LINE_PLACES = 50_000


def state_distribution(seqs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and share of each state per position, overall or by group."""
    by = by or []
    counts = seqs.groupBy(*by, "pos", "state").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "pos"))  # one row per state
    return counts.withColumn("share", F.col("n") / total)


def modal_state(seqs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Most frequent state per position with its share, ties by state name."""
    by = by or []
    w = Window.partitionBy(*by, "pos").orderBy(F.desc("n"), "state")  # one row per state
    return state_distribution(seqs, by).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def state_shares(seqs: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """Share of time in each state, one row per sequence."""
    n = F.count(F.lit(1))
    return seqs.groupBy(*keys).agg(*[(F.count_if(F.col("state") == s) / n).alias(f"p_{s}") for s in states])


def transition_rates(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Rate of each next state given the current one. Positions without a row inside
    a sequence count as the state ``missing``; after the last row there is nothing."""
    w = Window.partitionBy(*keys).orderBy("pos")
    nxt = seqs.select(
        F.col("state").alias("_s"),
        F.lead("state").over(w).alias("_t"),
        (F.lead("pos").over(w) - F.col("pos")).alias("_gap"),
    ).where(F.col("_t").isNotNull())
    gap = F.lit(MISSING)

    def step(a: Column, b: Column, n: Column) -> Column:
        return F.struct(a.alias("from_state"), b.alias("to_state"), n.cast("long").alias("_n"))

    one = F.lit(1)
    steps = F.when(F.col("_gap") == 1, F.array(step(F.col("_s"), F.col("_t"), one))).otherwise(
        F.array(
            step(F.col("_s"), gap, one), step(gap, F.col("_t"), one), step(gap, gap, F.col("_gap") - 2)
        )
    )
    counts = (
        nxt.select(F.inline(steps))
        .groupBy("from_state", "to_state")
        .agg(F.sum("_n").alias("n"))
        .where(F.col("n") > 0)
    )
    total = F.sum("n").over(Window.partitionBy("from_state"))  # one row per state
    return counts.withColumn("rate", F.col("n") / total)


def future_cost(rates: DataFrame) -> DataFrame:
    """Substitution cost of two states: chi-square distance of their next-state rates.

    Each next state is weighted by the inverse of its share of all rates. Sums of
    products stand in for the dense matrix; the table has one row per state pair.
    """
    grand = rates.agg(F.sum("rate").alias("_g")).scalar()
    weight = rates.groupBy("to_state").agg((F.sum("rate") / grand).alias("_w"))
    p = rates.join(weight, "to_state").select("from_state", "to_state", "rate", "_w")
    norm = p.groupBy("from_state").agg(F.sum(F.col("rate") * F.col("rate") / F.col("_w")).alias("_nn"))
    x = p.select("to_state", F.col("from_state").alias("a"), F.col("rate").alias("_ra"), "_w")
    y = p.select("to_state", F.col("from_state").alias("b"), F.col("rate").alias("_rb"))
    cross = x.join(y, "to_state").where("a <> b").groupBy("a", "b").agg(
        F.sum(F.col("_ra") * F.col("_rb") / F.col("_w")).alias("_x")
    )
    # The alphabet is a handful of states, so all ordered pairs fit one small array.
    states = rates.agg(F.array_sort(F.collect_set("from_state")).alias("_all"))
    pairs = states.select(F.explode("_all").alias("a"), "_all").select("a", F.explode("_all").alias("b")).where("a <> b")
    sq = F.col("_na") + F.col("_nb") - 2 * F.coalesce(F.col("_x"), F.lit(0.0))
    return (
        pairs.join(norm.select(F.col("from_state").alias("a"), F.col("_nn").alias("_na")), "a")
        .join(norm.select(F.col("from_state").alias("b"), F.col("_nn").alias("_nb")), "b")
        .join(cross, ["a", "b"], "left")
        .select("a", "b", F.sqrt(F.greatest(sq, F.lit(0.0))).alias("cost"))
    )


def sequence_order(seqs: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """Number the sequences by their states from the start, in alphabet order."""
    code = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state")).cast("int")
    codes = F.array_sort(F.collect_list(F.struct(F.col("pos"), code.alias("code"))))
    lists = seqs.groupBy(*keys).agg(codes.alias("_c")).select(*keys, F.transform("_c", lambda s: s["code"]).alias("_codes"))
    return numbered(lists, [F.col("_codes"), *[F.col(k) for k in keys]], "position").drop("_codes")


def record_order(df: DataFrame, keys: list[str], start: str, end: str, state: str, tie: str, states: list[str]) -> DataFrame:
    """``sequence_order`` of the minutes of timed records, from their spells.

    Lists of minutes compare like lists of runs (code, rank): of two runs of one code the shorter
    is followed first by another code. If that is higher, the shorter list comes later, otherwise (also
    at the end) earlier; so a run before a higher code ranks behind all others, by falling length.
    """
    code = F.array_position(F.array(*[F.lit(s) for s in states]), F.col(state))
    coded = df.withColumn("_code", F.coalesce(code, F.lit(-1).cast("long")).cast("string"))  # null comes first
    runs = record_spells(coded, keys, start, end, "_code", tie).where(F.col("state") != MISSING)
    # records without a key have no first start to count from and share one place
    loose = coded.where(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) & (F.col(end) - F.col(start) > -MINUTE_US))
    first = F.min_by("_code", F.struct(F.col(start), F.col(tie)))
    runs = runs.unionByName(loose.groupBy(*keys).agg(
        F.lit(0).cast("long").alias("start"), first.alias("state"), F.lit(1).cast("long").alias("length")
    ))
    runs = runs.select(*keys, "start", F.col("state").try_cast("int").alias("code"), "length")
    w = Window.partitionBy(*keys).orderBy("start")
    prev = F.lag("code").over(w)
    held = runs.withColumn("_new", (prev.isNull() | (prev != F.col("code"))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    held = held.groupBy(*keys, "_run", "code").agg(F.sum("length").alias("length"))
    follow = F.lead("code").over(Window.partitionBy(*keys).orderBy("_run"))
    rank = F.when(follow > F.col("code"), F.lit(1 << 40) - F.col("length")).otherwise(F.col("length"))
    codes = F.array_sort(F.collect_list(F.struct("_run", "code", "_rank")))
    lists = held.withColumn("_rank", rank).groupBy(*keys).agg(codes.alias("_c"))
    lists = lists.select(*keys, F.transform("_c", lambda s: F.struct(s["code"], s["_rank"])).alias("_codes"))
    return numbered(lists, [F.col("_codes"), *[F.col(k) for k in keys]], "position").drop("_codes")


def spells(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of one state: (keys, start, state, length), inner gaps as ``missing``."""
    w = Window.partitionBy(*keys).orderBy("pos")
    step = seqs.withColumn("_prev", F.lag("state").over(w)).withColumn("_gap", F.col("pos") - F.lag("pos").over(w))
    fresh = (F.col("_prev").isNull()) | (F.col("_prev") != F.col("state")) | (F.col("_gap") > 1)
    runs = step.withColumn("_run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.groupBy(*keys, "_run").agg(
        F.min("pos").alias("start"), F.first("state").alias("state"), F.count(F.lit(1)).alias("length")
    ).drop("_run")
    holes = step.where(F.col("_gap") > 1).select(
        *keys,
        (F.col("pos") - F.col("_gap") + 1).alias("start"),
        F.lit(MISSING).alias("state"),
        (F.col("_gap") - 1).alias("length"),
    )
    return held.unionByName(holes)


def spell_lists(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Spells of a sequence as one ordered array of (start, state, length)."""
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "state", "length"))).alias("spells"))


def spell_counts(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pos, state, n): how many sequences hold each state at each position, from their spells.

    A difference table: a spell adds one at its start and takes it away past its end. Only these
    sums are moved; running sums go over the positions of a state, of which the calendar bounds the number.
    """
    by = by or []
    ends = F.inline(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("_d")),
        F.struct((F.col("start") + F.col("length")).alias("pos"), F.lit(-1).alias("_d")),
    ))
    steps = runs.where(F.col("state") != MISSING).select(*by, "state", ends).groupBy(*by, "state", "pos").agg(F.sum("_d").alias("_d"))
    w = Window.partitionBy(*by, "state").orderBy("pos")
    level = steps.withColumns({"n": F.sum("_d").over(w), "_to": F.lead("pos").over(w)}).where("n > 0")
    return level.select(*by, F.explode(F.sequence("pos", F.col("_to") - 1)).alias("pos"), "state", "n")


def spell_distribution(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``state_distribution`` from spells."""
    by = by or []
    total = F.sum("n").over(Window.partitionBy(*by, "pos"))  # one row per state
    return spell_counts(runs, by).withColumn("share", F.col("n") / total)


def spell_modal_state(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``modal_state`` from spells."""
    by = by or []
    w = Window.partitionBy(*by, "pos").orderBy(F.desc("n"), "state")  # one row per state
    return spell_distribution(runs, by).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def spell_transitions(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``transition_rates`` from spells: a spell stays length - 1 times, then goes to the next one."""
    follow = F.lead("state").over(Window.partitionBy(*keys).orderBy("start"))
    stay = F.struct(F.col("state").alias("from_state"), F.col("state").alias("to_state"), (F.col("length") - 1).alias("_n"))
    move = F.struct(F.col("state").alias("from_state"), F.col("_next").alias("to_state"), F.lit(1).cast("long").alias("_n"))
    steps = runs.withColumn("_next", follow).select(F.inline(F.array(stay, move))).where("to_state is not null")
    counts = steps.groupBy("from_state", "to_state").agg(F.sum("_n").alias("n")).where("n > 0")
    total = F.sum("n").over(Window.partitionBy("from_state"))  # one row per state
    return counts.withColumn("rate", F.col("n") / total)


def spell_shares(runs: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """``state_shares`` from spells."""
    held = runs.where(F.col("state") != MISSING)
    return held.groupBy(*keys).agg(
        *[(F.sum(F.when(F.col("state") == s, F.col("length")).otherwise(0)) / F.sum("length")).alias(f"p_{s}") for s in states]
    )


def distinct_vectors(df: DataFrame, cols: list[str], id_expr: Column) -> DataFrame:
    """Collapse equal vectors to one row: smallest id as ``rep``, and the copies."""
    return df.groupBy(*cols).agg(F.min(id_expr).alias("rep"), F.count(F.lit(1)).alias("copies"))


def meet_in_tiles(left: DataFrame, right: DataFrame, cells: list[str]) -> DataFrame:
    """Rows of ``left`` (id ``a``) and ``right`` (id ``b``) that share a cell.

    A crowded cell is cut into tiles of at most ``TILE`` by ``TILE`` rows, each tile its own join key.
    """
    lsize = left.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_lp"))
    rsize = right.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_rp"))
    sizes = lsize.join(rsize, cells)
    left = attach(left, sizes, cells, "inner")
    right = attach(right, sizes, cells, "inner")
    zero = F.lit(0).cast("long")
    left = left.withColumn("_ti", F.pmod(F.xxhash64("a"), "_lp")).withColumn(
        "_tj", F.explode(F.sequence(zero, F.col("_rp") - 1))
    )
    right = right.withColumn("_tj", F.pmod(F.xxhash64("b"), "_rp")).withColumn(
        "_ti", F.explode(F.sequence(zero, F.col("_lp") - 1))
    )
    return left.drop("_lp", "_rp").join(right.drop("_lp", "_rp"), [*cells, "_ti", "_tj"])


def near_pairs(df: DataFrame, id_col: str, cols: list[str], radius: float) -> DataFrame:
    """All pairs (a < b) with Euclidean distance up to ``radius``, exactly.

    Rows meet in the grid cells of the first ``GRID`` coordinates, each ``WIDTH`` times the radius wide
    and centred on 0: a row is copied only to the cells that its radius touches. Crowded cells are
    tiled, so no task works through all pairs of a cell.
    """
    df = cut_lineage(df)  # both sides and the cell sizes read it
    grid = cols[:GRID]
    width, reach = WIDTH * float(radius), float(radius) * (1 + 1e-9)
    cells = [f"_g{i}" for i in range(len(grid))]

    def cell(value: Column) -> Column:
        return F.floor(value / F.lit(width) + 0.5).cast("long")

    left = df.select(F.col(id_col).alias("a"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(cols)], *[cell(F.col(c)).alias(n) for c, n in zip(grid, cells)])
    right = df.select(F.col(id_col).alias("b"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(cols)])
    for i, n in enumerate(cells):
        right = right.withColumn(n, F.explode(F.sequence(cell(F.col(f"_b{i}") - reach), cell(F.col(f"_b{i}") + reach))))
    met = meet_in_tiles(left, right, cells)
    sq = sum((F.pow(F.col(f"_a{i}") - F.col(f"_b{i}"), 2) for i in range(1, len(cols))), F.pow(F.col("_a0") - F.col("_b0"), 2))
    return met.where(F.col("a") < F.col("b")).select("a", "b", F.sqrt(sq).alias("distance")).where(F.col("distance") <= radius)


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts), default=0)), dtype=parts[0].dtype)
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def _align(sub, drop: list[np.ndarray], add: list[np.ndarray]) -> np.ndarray:
    """Cheapest alignments of pairs of sequences, longest first, line by line.

    ``sub(n, i)`` has the substitution costs of place i of the first n pairs, one line a pair.
    Two lines are held, never a whole table. What lies behind the end of a sequence is not read.
    """
    n_drop, ends = np.array([len(x) for x in drop]), np.array([len(x) for x in add])
    drop, add = _padded(drop), _padded(add)
    adds = np.concatenate((np.zeros((len(add), 1)), np.cumsum(add, axis=1)), axis=1)
    row, out = adds, np.zeros(len(add))
    for i in range(drop.shape[1] + 1):
        n = int(np.searchsorted(-n_drop, -i, side="left"))  # pairs with more than i places
        done = np.arange(n, len(row))
        out[done] = row[done, ends[done]]
        if not n:
            break
        best = row[:n] + drop[:n, i, None]
        np.minimum(best[:, 1:], row[:n, :-1] + sub(n, i), out=best[:, 1:])
        best -= adds[:n]
        np.minimum.accumulate(best, axis=1, out=best)
        best += adds[:n]
        row = best
    return out


def edit_distances(pairs: DataFrame, id_cols: list[str], costs: DataFrame, link: float = 0.5, origin: float = 0.5) -> DataFrame:
    """Optimal-matching distances of given sequence pairs (spell arrays ``a``, ``b``).

    ``om`` aligns single states; ``om_spell`` whole spells, where changing a length
    by one costs ``link``; ``om_slen`` states made cheaper inside long spells;
    ``om_stran`` states together with the transition that leaves them. An insertion or
    deletion costs half the largest substitution. The caller chooses the pairs; the
    cost table has one row per state pair and goes to the workers as a small matrix.
    """
    table = costs.limit(40_001).collect()
    if len(table) > 40_000:
        raise ValueError("cost table exceeds 200 states")
    names = sorted({r["a"] for r in table} | {r["b"] for r in table})
    index = {s: i for i, s in enumerate(names)}
    sm = np.zeros((len(names), len(names)))
    for r in table:
        sm[index[r["a"]], index[r["b"]]] = r["cost"]
    indel = float(sm.max()) / 2

    def spell_scores(pairs: list[tuple]) -> np.ndarray:
        by_spells = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][0]))
        out = np.empty(len(pairs))
        sa, la, sb, lb = zip(*(pairs[k] for k in by_spells))
        ps, pl, qs, ql = map(_padded, (sa, la, sb, lb))

        def spell(n, i):
            x, m = ps[:n, i, None], pl[:n, i, None]
            return np.where(x == qs[:n], link * np.abs(m - ql[:n]), sm[x, qs[:n]] + link * (m + ql[:n] - 2))

        out[by_spells] = _align(spell, [indel + link * (x - 1) for x in la], [indel + link * (x - 1) for x in lb])
        return out

    def runs(states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lengths, prices, states and weights: a position weighs the less the longer its spell is."""
        t = lengths**-0.5
        return lengths, np.full(len(lengths), indel), indel * t, states, t

    def moves(states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spells without their last positions, and these, which go to another state: lengths, prices, states, next states and whether they move."""
        then = np.append(states[1:], states[-1:])
        move = (states != then).astype(float)
        last = np.append(np.ones(len(lengths) - 1, int), 0) if len(lengths) else lengths
        parts = [np.stack(v, axis=1).ravel() for v in ((lengths - last, last), (states, states), (states, then), (0 * move, move))]
        n, x, nx, m = (v[parts[0] > 0] for v in parts)
        return n, origin * indel + (1 - origin) * m, x, nx, m

    def plain(x: tuple, y: tuple) -> np.ndarray:
        return sm[x[2], y[2]]

    def slen(x: tuple, y: tuple) -> np.ndarray:
        return plain(x, y) * (x[3] + y[3]) / 2

    def stran(x: tuple, y: tuple) -> np.ndarray:
        differs = (x[2] != y[2]) | (x[3] != y[3])
        return origin * plain(x, y) + (1 - origin) * np.where(differs, x[4] + y[4], 0.0)

    def score(pairs: list[tuple]) -> np.ndarray:
        """The four distances of each pair (states and lengths of both), run by run for all pairs at once."""
        out = np.empty((len(pairs), len(OM_NAMES)))
        step = max(1, LINE_PLACES // max((len(v) for p in pairs for v in p[::2]), default=1))
        for at in range(0, len(pairs), step):
            out[at : at + step, 1] = spell_scores(pairs[at : at + step])
        xs, ys = ([(s[n > 0], n[n > 0]) for s, n in side] for side in (((p[0], p[1]) for p in pairs), ((p[2], p[3]) for p in pairs)))
        a, b = [runs(*x) for x in xs], [runs(*y) for y in ys]
        out[:, 0] = align_runs([(n, p, s) for n, p, _, s, _ in a], [(n, p, s) for n, p, _, s, _ in b], plain)
        out[:, 2] = align_runs([(n, p, s, t) for n, _, p, s, t in a], [(n, p, s, t) for n, _, p, s, t in b], slen)
        out[:, 3] = align_runs([moves(*x) for x in xs], [moves(*y) for y in ys], stran)
        return out

    def coded(runs) -> tuple[np.ndarray, np.ndarray]:
        return np.array([index[r["state"]] for r in runs]), np.array([r["length"] for r in runs])

    def run(batches):
        for pdf in batches:
            pairs = [(*coded(a), *coded(b)) for a, b in zip(pdf["a"], pdf["b"])]
            scores = score(pairs)
            out = pdf[id_cols].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(scores, columns=OM_NAMES)], axis=1)

    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*id_cols).schema)
    # a pair costs four alignments: deal pairs to all cores, however small the table is
    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pairs.select(*id_cols, "a", "b").repartition(n, *id_cols).mapInPandas(run, ids + "".join(f", {n} double" for n in OM_NAMES))


OM_NAMES = ["om", "om_spell", "om_slen", "om_stran"]


def cluster_sequences(shares: DataFrame, keys: list[str], cols: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Type of each sequence (``Type i``) by bisecting k-means on its state shares."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    # The fit reads its input many times: settle it once.
    vec = cut_lineage(VectorAssembler(inputCols=cols, outputCol="_v").transform(shares).select(*keys, "_v"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vec)
    return model.transform(vec).select(*keys, F.concat(F.lit("Type "), (F.col("_c") + 1).cast("string")).alias("type"))
