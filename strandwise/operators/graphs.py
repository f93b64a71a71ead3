"""Graphs as tables: edges ``(src, dst, weight)`` and vertices, and topic hierarchies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .skew import attach, cut_lineage, hot_keys, null_safe_join, numbered, written

#: Levels and rounds a level that the search for communities takes at most.
LEVELS, MOVES = 10, 12
#: Links (both directions) and vertices whose rounds go over arrays in the driver: some 50 bytes a link.
HERE_LINKS, HERE_VERTICES = 6_000_000, 500_000


def hierarchy_edges(h: DataFrame, parent: str, left: str, right: str) -> DataFrame:
    """(parent, left, right) rows to (source, target) edges."""
    cols = [F.col(left).alias("l"), F.col(right).alias("r")]
    return (
        h.select(F.col(parent).alias("source"), *cols)
        .unpivot(["source"], ["l", "r"], "_side", "target")
        .where(F.col("target").isNotNull())
        .select("source", "target")
    )


def both_ways(edges: DataFrame, src: str, dst: str, *more: str) -> DataFrame:
    back = edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"), *more)
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more).unionByName(back)


def depth_from(
    edges: DataFrame, root: Column, src: str = "source", dst: str = "target", max_depth: int | None = None
) -> DataFrame:
    """Steps from the root to every vertex it reaches, ignoring edge direction.

    One join of the last frontier per round; only new vertices move on. The walk ends
    when nothing new is reached, or at ``max_depth`` where only the top is wanted.
    """
    adjacent = written(both_ways(edges, src, dst).where("src <> dst").distinct())
    hot = hot_keys(adjacent, ["src"])
    kind = adjacent.schema["src"].dataType
    frontier = adjacent.select(root.cast(kind).alias("id")).limit(1).withColumn("depth", F.lit(0))
    seen = frontier = written(frontier)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reach = attach(adjacent, frontier.select(F.col("id").alias("src")), ["src"], "inner", hot)
        fresh = reach.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = written(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen = written(seen)
    return seen


def members_at_depth(h: DataFrame, depths: DataFrame, parent: str, topics: str, depth: int) -> DataFrame:
    """(cluster, topic_id) rows for the hierarchy nodes at a depth; topics as list text."""
    at = depths.where(F.col("depth") == depth).select(F.col("id").alias(parent))
    return (
        h.join(at, parent, "left_semi")
        .select(F.col(parent).alias("cluster"), F.explode(text.split_list(F.col(topics))).alias("topic_id"))
        .withColumn("topic_id", F.col("topic_id").try_cast("long"))
        .where(F.col("topic_id").isNotNull())
        .distinct()
    )


def words_at_depth(members: DataFrame, topic_words: DataFrame) -> DataFrame:
    """Distinct top-word texts of a cluster's topics merged to one text.

    The word table has one row per topic of a fixed topic model.
    """
    words = topic_words.select("topic_id", F.regexp_replace("top_words", " - ", ", ").alias("_w"))
    pairs = members.join(words, "topic_id").select("cluster", "_w").distinct()
    return pairs.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("_w")), ", ").alias("words"))


def topic_share(docs: DataFrame, members: DataFrame, chapter: str, topic: str, width: int | None = None) -> DataFrame:
    """Share of the sentences of a chapter (or a run of ``width`` chapters) per cluster.

    A full join keeps both sides: a sentence whose topic is in no cluster counts as
    cluster -1, and a clustered topic without sentences shows a null chapter.
    """
    rows = docs.select(F.col(chapter).alias("chapter"), F.col(topic).alias("topic_id"))
    if width:
        rows = rows.withColumn("chapter", F.floor((F.col("chapter") - 1) / width))
    # Counting before the join leaves one row per chapter and topic.
    counts = rows.groupBy("chapter", "topic_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = members.join(counts, "topic_id", "full_outer")
    per = joined.groupBy("chapter", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")).agg(
        F.sum(F.coalesce("_n", F.lit(1))).alias("n")
    )
    known = null_safe_join(per, per.groupBy("chapter").agg(F.sum("n").alias("_all")), ["chapter"])
    return known.select(F.col("chapter").cast("long").alias("chapter"), "cluster", "n", (F.col("n") / F.col("_all")).alias("share"))


def dense_topic_share(docs: DataFrame, members: DataFrame, chapter: str, topic: str, band: int) -> DataFrame:
    """``topic_share`` per single chapter with a row for every cluster (0 where it has no sentence)
    and the number of the run of ``band`` chapters that the chapter falls into, from 1."""
    share = cut_lineage(topic_share(docs, members, chapter, topic))
    every = share.agg(F.array_sort(F.collect_set("cluster"))).scalar()  # as many as the hierarchy is cut into
    grid = share.where("chapter is not null").select("chapter").distinct().withColumn("cluster", F.explode(every))
    full = grid.join(share, ["chapter", "cluster"], "left").fillna(0, ["n", "share"])
    return full.withColumn("band", F.floor((F.col("chapter") - 1) / band).cast("long") + 1)


def _chained(lines: DataFrame) -> DataFrame:
    """Compose y = a * y(next) + b along runs of parents that each wait for one child.

    Pointers double in each round, so a run of n parents takes log2(n) rounds; a run
    that has not ended by then is a cycle.
    """
    lines = written(lines)
    for _ in range(lines.count().bit_length() + 1):
        ahead = lines.select(F.col("p").alias("next"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("next").alias("_next"))
        joined = written(lines.join(ahead, "next", "left"))
        if joined.where("_a is not null").isEmpty():
            return lines
        lines = joined.select(
            "p",
            (F.col("a") * F.coalesce("_a", F.lit(1.0))).alias("a"),
            (F.col("b") + F.col("a") * F.coalesce("_b", F.lit(0.0))).alias("b"),
            F.coalesce("_next", "next").alias("next"),
        )
    raise ValueError("the hierarchy has a cycle")


def hierarchy_layout(h: DataFrame, parent: str, left: str, right: str, height: str) -> DataFrame:
    """Dendrogram lines bottom-up: (p, pend, x, xend, y, yend).

    A leaf's y is its rank by the height of its parent; a parent's y is the mean of
    its children. A round places the parents whose children are placed, and whole runs
    of parents that wait for one child each, so the rounds grow with the logarithm of
    the vertices, however deep the tree is.
    """
    edges = written(
        h.select(F.col(parent).alias("pend"), F.col(height).alias("xend"), F.inline(F.array(
            F.struct(F.col(left).alias("p")), F.struct(F.col(right).alias("p"))))).where("p is not null")
    )
    heights = edges.groupBy(F.col("pend").alias("p")).agg(F.max("xend").cast("double").alias("x"))
    leaves = edges.join(heights.select("p"), "p", "left_anti")
    placed = numbered(leaves.select("p", "xend"), ["xend", "p"], "_r").select("p", F.col("_r").cast("double").alias("y"))
    placed = written(placed)
    waiting = written(heights.select(F.col("p").alias("pend")))
    while not waiting.isEmpty():
        known = edges.join(waiting, "pend", "left_semi").join(placed, "p", "left").groupBy("pend").agg(
            F.count(F.lit(1)).alias("_n"), F.count("y").alias("_k"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("_s"),
            F.max(F.when(F.col("y").isNull(), F.col("p"))).alias("next"),
        )
        known = written(known)
        ready = known.where("_n = _k").select(F.col("pend").alias("p"), (F.col("_s") / F.col("_n")).alias("y"))
        runs = _chained(known.where("_n - _k = 1").select(
            F.col("pend").alias("p"), (1.0 / F.col("_n")).alias("a"), (F.col("_s") / F.col("_n")).alias("b"), "next"
        ))
        ended = runs.join(ready.select(F.col("p").alias("next"), F.col("y").alias("_y")), "next")
        fresh = written(ready.unionByName(ended.select("p", (F.col("a") * F.col("_y") + F.col("b")).alias("y"))))
        if fresh.isEmpty():
            raise ValueError("the hierarchy has a cycle")
        placed = written(placed.unionByName(fresh))
        waiting = written(waiting.join(fresh.select(F.col("p").alias("pend")), "pend", "left_anti"))
    top = placed.select(F.col("p").alias("pend"), F.col("y").alias("yend"))
    return edges.join(placed, "p").join(heights, "p", "left").join(top, "pend").select(
        "p", "pend", F.coalesce("x", F.lit(0.0)).alias("x"), F.col("xend").cast("double").alias("xend"), "y", "yend"
    )


def simplify_edges(edges: DataFrame) -> DataFrame:
    """No loops, and one edge per unordered pair with the summed weight."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").groupBy(a.alias("src"), b.alias("dst")).agg(F.sum("weight").alias("weight"))


def filter_edges(edges: DataFrame, least: float) -> DataFrame:
    """Drop weights of exactly 1, below zero, and below ``least``."""
    w = F.col("weight")
    return edges.where((w != 1) & (w >= 0) & (w >= least))


def filter_edges_quantile(edges: DataFrame, prob: float = 0.5) -> DataFrame:
    """Keep edges at or above a quantile of the positive weights."""
    from .profiles import exact_quantiles

    edges = cut_lineage(edges)  # read for the cut and again for the filter
    positive = edges.where(F.col("weight") > 0).withColumn("_all", F.lit(1))
    cut = exact_quantiles(positive, ["_all"], "weight", {"_q": prob}).select("_q").scalar()
    return edges.where(F.col("weight") >= cut)


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges, "src", "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def filter_vertices(edges: DataFrame, least_degree: int) -> DataFrame:
    """Edges between vertices of at least this degree, in one pass (not repeated)."""
    edges = cut_lineage(edges)
    keep = degree(edges).where(F.col("degree") >= least_degree)
    src, dst = keep.select(F.col("id").alias("src")), keep.select(F.col("id").alias("dst"))
    kept = attach(edges, src, ["src"], "left_semi", hot_keys(edges, ["src"]))
    return attach(kept, dst, ["dst"], "left_semi", hot_keys(edges, ["dst"]))


def label_communities(edges: DataFrame) -> DataFrame:
    """Communities by weighted label propagation, deterministic.

    A vertex wants the label with the largest summed edge weight among its neighbours
    (of equal ones the smallest) if that is more than its own label's weight. Of
    neighbours that want to move, only the one with the largest gain moves (of equal
    ones the smallest id). So each move raises the weight of the edges within
    labels by its gain, labels cannot swap for ever, and the rounds end when nobody
    gains.
    """
    links = written(both_ways(edges, "src", "dst", "weight").where("src <> dst"))
    hot = hot_keys(links, ["src"])
    labels = written(both_ways(edges, "src", "dst").select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    while True:
        heard = attach(links, labels.withColumnRenamed("id", "src"), ["src"], "inner", hot)
        votes = heard.groupBy(F.col("dst").alias("id"), "label").agg(F.round(F.sum("weight"), 9).alias("_w"))
        ranked = votes.join(labels.withColumnRenamed("label", "_own"), "id").groupBy("id").agg(
            F.min(F.struct((-F.col("_w")).alias("w"), "label")).alias("_best"),
            F.coalesce(F.max(F.when(F.col("label") == F.col("_own"), F.col("_w"))), F.lit(0)).alias("_now"),
        )
        wish = ranked.select("id", F.col("_best.label").alias("label"), (-F.col("_best.w") - F.col("_now")).alias("gain"))
        wish = written(wish.where("gain > 0"))
        if wish.isEmpty():
            return labels.select("id", F.col("label").alias("community"))
        near = attach(links, wish.select(F.col("id").alias("src"), "gain"), ["src"], "inner", hot)
        rival = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("src").alias("id"))).alias("_first"))
        moves = wish.join(rival, "id", "left").where(
            F.col("_first").isNull() | (F.struct((-F.col("gain")).alias("g"), F.col("id").alias("id")) < F.col("_first"))
        )
        labels = written(
            labels.join(moves.select("id", F.col("label").alias("_new")), "id", "left").select("id", F.coalesce("_new", "label").alias("label"))
        )


def _votes(links: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(id, label, _links, _w): a vertex's links into each community and their weight, links to itself apart (_loop).

    The one step of a round that reads the links. Modularity and wishes are both taken from it.
    """
    heard = attach(links, labels.select(F.col("id").alias("src"), "label"), ["src"], "inner", hot)
    loop = F.col("src") == F.col("dst")
    return written(heard.groupBy(F.col("dst").alias("id"), "label").agg(
        F.count_if(~loop).alias("_links"), F.sum(F.when(~loop, F.col("weight"))).alias("_w"),
        F.coalesce(F.sum(F.when(loop, F.col("weight"))), F.lit(0.0)).alias("_loop"),
    ))


def _share_within(votes: DataFrame, labels: DataFrame, whole: float) -> float:
    """Modularity of labels (id, label, k), given their votes."""
    inside = votes.join(labels.select("id", F.col("label").alias("_own")), "id").where("label = _own")
    within = inside.agg(F.coalesce(F.sum(F.coalesce("_w", F.lit(0.0)) + F.col("_loop")), F.lit(0.0)).alias("within"))
    chance = labels.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / whole, 2)).alias("chance"))
    found = within.crossJoin(chance).first()  # one row each
    return found["within"] / whole - found["chance"]


def _wishes(votes: DataFrame, labels: DataFrame, whole: float) -> DataFrame:
    """(id, _new, gain): the neighbouring community where a vertex that gains by moving gains most."""
    votes = votes.where("_links > 0").drop("_links", "_loop")
    totals = labels.groupBy("label").agg(F.sum("k").alias("_tot"))
    own = labels.join(totals, "label").select("id", F.col("label").alias("_own"), F.col("_tot").alias("_own_tot"), "k")
    each = votes.join(own, "id").join(totals, "label")
    at_home = F.col("label") == F.col("_own")
    gain = F.round(F.col("_w") - F.col("k") * (F.col("_tot") - F.when(at_home, F.col("k")).otherwise(0.0)) / whole, 9)
    ranked = each.groupBy("id").agg(
        F.min(F.when(~at_home, F.struct((-gain).alias("g"), "label"))).alias("_best"),
        F.coalesce(F.max(F.when(at_home, gain)), F.max(F.round(-F.col("k") * (F.col("_own_tot") - F.col("k")) / whole, 9))).alias("_stay"),
    )
    rise = -F.col("_best.g") - F.col("_stay")
    return ranked.where(rise > 0).select("id", F.col("_best.label").alias("_new"), rise.alias("gain"))


def _risen(links: DataFrame, labels: DataFrame, whole: float, hot: DataFrame | None, rounds: int) -> tuple[DataFrame, bool]:
    """Labels after rounds of moves that raise modularity, and whether any did."""
    votes = _votes(links, labels, hot)
    now, share, risen, wishes = _share_within(votes, labels, whole), 2, False, None
    for turn in range(rounds):
        if wishes is None:
            wishes = written(_wishes(votes, labels, whole))
        # the largest gains go first; of equal ones a hash that differs from turn to turn decides
        rank = F.col("gain") * (1 + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20)) / 2.0**40)
        least = wishes.agg(F.percentile_approx(rank, 1 - 1 / share, 10_000)).first()[0]
        if least is None:
            break  # nobody gains
        goes = wishes.where(rank >= least).drop("gain")
        after = written(labels.join(goes, "id", "left").select("id", "k", F.coalesce("_new", "label").alias("label")))
        heard = _votes(links, after, hot)
        q = _share_within(heard, after, whole)
        if q > now + 1e-9:
            labels, votes, now, risen, wishes = after, heard, q, True, None
        elif share < 64:
            share *= 2  # fewer at once get less into each other's way
    return labels, risen


def _votes_here(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_votes`` without loops: vertex, label and weight, sorted."""
    key = dst * np.int64(len(label)) + label[src]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], first) if len(key) else np.zeros(0)
    return key[first] // len(label), key[first] % len(label), sums


def _wishes_here(votes: tuple[np.ndarray, ...], label: np.ndarray, k: np.ndarray, whole: float) -> tuple[np.ndarray, ...]:
    """``_wishes``: vertex, label and gain."""
    at, to, w = votes
    tot = np.bincount(label, k, len(label))
    home = to == label[at]
    gain = np.round(w - k[at] * (tot[to] - np.where(home, k[at], 0.0)) / whole, 9)
    stay = np.round(-k * (tot[label] - k) / whole, 9)
    stay[at[home]] = gain[home]
    at, to, gain = at[~home], to[~home], gain[~home]
    if not len(at):
        return at, to, gain
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    best = np.maximum.reduceat(gain, first)
    top = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(first, len(at)))))
    top = top[np.concatenate([[True], at[top][1:] != at[top][:-1]])]  # of equal ones the smallest label
    rise = gain[top] - stay[at[top]]
    return at[top][rise > 0], to[top][rise > 0], rise[rise > 0]


def _risen_here(links: tuple[np.ndarray, ...], label: np.ndarray, k: np.ndarray, hashes: np.ndarray, whole: float) -> tuple[np.ndarray, bool]:
    """``_risen`` over arrays; ``hashes`` has a line for each round."""
    src, dst, weight = links
    other = src != dst
    loops = float(weight[~other].sum())
    src, dst, weight = src[other], dst[other], weight[other]

    def share_within(votes: tuple[np.ndarray, ...], label: np.ndarray) -> float:
        at, to, w = votes
        return (float(w[to == label[at]].sum()) + loops) / whole - float(((np.bincount(label, k, len(label)) / whole) ** 2).sum())

    votes = _votes_here(src, dst, weight, label)
    now, share, risen, wishes = share_within(votes, label), 2, False, None
    for turn in hashes:
        if wishes is None:
            wishes = _wishes_here(votes, label, k, whole)
        at, to, gain = wishes
        if not len(at):
            break
        rank = gain * (1 + turn[at] / 2.0**40)
        least = np.sort(rank)[max(0, math.ceil((1 - 1 / share) * len(rank)) - 1)]
        after = label.copy()
        after[at[rank >= least]] = to[rank >= least]
        heard = _votes_here(src, dst, weight, after)
        q = share_within(heard, after)
        if q > now + 1e-9:
            label, votes, now, risen, wishes = after, heard, q, True, None
        elif share < 64:
            share *= 2
    return label, risen


def _merged_here(links: DataFrame, whole: float, levels: int, rounds: int, again: bool) -> DataFrame:
    """(id, label) after the levels over links of a bounded number, which are brought to the driver as arrays.

    The same rounds as over tables. ``again``: vertices move once more between the final communities.
    """
    turns = F.array(*[F.pmod(F.xxhash64("id", F.lit(t)), F.lit(1 << 20)).cast("int") for t in range(rounds)])
    ids = cut_lineage(numbered(links.select(F.col("src").alias("id")).distinct(), ["id"], "code").select("id", (F.col("code") - 1).alias("code")))
    codes = F.broadcast(ids)
    half = links.where("src <= dst").join(codes.toDF("src", "_a"), "src").join(codes.toDF("dst", "_b"), "dst")
    found = half.select(F.col("_a").cast("int"), F.col("_b").cast("int"), "weight").toArrow()
    a, b, w = (np.asarray(found[c].to_numpy()) for c in ("_a", "_b", "weight"))
    own = a != b
    src, dst, weight = np.concatenate([a, b[own]]), np.concatenate([b, a[own]]), np.concatenate([w, w[own]])
    drawn = ids.select(F.col("code"), turns.alias("h")).toArrow()
    n = drawn.num_rows
    hashes = np.empty((rounds, n))
    hashes[:, drawn["code"].to_numpy()] = drawn["h"].combine_chunks().flatten().to_numpy().reshape(n, rounds).T
    base = links_now = (src, dst.astype(np.int64), weight)
    k = np.bincount(src, weight, n)
    members = np.arange(n)
    for _ in range(levels if whole else 0):
        label, risen = _risen_here(links_now, np.arange(n), np.bincount(links_now[0], links_now[2], n), hashes, whole)
        if not risen:
            break
        members = label[members]
        at, to, w = _votes_here(label[links_now[0]], label[links_now[1]], links_now[2], np.arange(n))
        links_now = (to, at, w)
    if whole and again:
        members, _ = _risen_here(base, members, k, hashes, whole)
    spark = links.sparkSession
    named = spark.createDataFrame(pa.table({"_c": np.arange(n), "_l": members.astype(np.int64)}))
    labels = ids.toDF("id", "_c").join(named, "_c")
    return written(labels.join(ids.toDF("label", "_l"), "_l").select("id", "label"))


def _fits_here(links: DataFrame) -> bool:
    n, m = links.agg(F.count(F.lit(1)), F.count_distinct("src")).first()
    return n <= HERE_LINKS and m <= HERE_VERTICES


def communities(edges: DataFrame, levels: int = LEVELS, rounds: int = MOVES) -> DataFrame:
    """Communities (id, community: the least id of the group) by multi-level modularity.

    On each level vertices go to the neighbouring community where modularity gains most, in a round
    the half of them that gains more, as two neighbours that move at once can undo each other's gain. A
    round counts only if modularity rises, otherwise half as many go in the next; a level ends when nobody
    gains by moving, at the latest after ``rounds``. Its communities are the vertices of the next level, with summed weights. At the
    end single vertices move once more between the final communities. There are at most ``levels``
    levels, so at most ``(levels + 1) * rounds`` rounds whatever the graph; modularity never falls.
    Weights must not be negative; vertices without edges are not listed.

    From the level on whose links are few enough (``HERE_LINKS``) the rounds go over arrays, as jobs over small
    tables take far longer than their work; larger levels stay tables.
    """
    base = both_ways(edges, "src", "dst", "weight").where("src <> dst")
    base = links = written(base.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")))
    whole = base.agg(F.sum("weight")).first()[0]
    if _fits_here(base):
        members = _merged_here(base, whole, levels, rounds, True)
    else:
        base_hot = hot = hot_keys(base, ["src"])
        weights = written(base.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
        members = weights.select("id", F.col("id").alias("label"))
        for level in range(levels if whole else 0):
            here = level > 0 and _fits_here(links)
            if here:
                names = _merged_here(links, whole, levels - level, rounds, False)
            else:
                start = written(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).withColumn("label", F.col("id")))
                labels, risen = _risen(links, start, whole, hot, rounds)
                if not risen:
                    break
                names = labels.select("id", "label")
            members = written(attach(members.toDF("id", "_c"), names.toDF("_c", "label"), ["_c"], "inner").select("id", "label"))
            if here:
                break
            joined = attach(links, names.toDF("src", "_a"), ["src"], "inner", hot)
            joined = attach(joined, names.toDF("dst", "_b"), ["dst"], "inner", hot and hot.withColumnRenamed("src", "dst"))
            links = written(joined.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")))
            hot = hot_keys(links, ["src"])
        if whole:
            members, _ = _risen(base, written(members.join(weights, "id")), whole, base_hot, rounds)
    least = members.groupBy("label").agg(F.min("id").alias("community"))
    return attach(members, least, ["label"], "inner").select("id", "community")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Modularity of a grouping as one row."""
    links = cut_lineage(both_ways(edges, "src", "dst", "weight"))
    hot = hot_keys(links, ["src"])  # doubled edges: the same for dst
    g = groups.select("id", "community")
    tagged = attach(links, g.toDF("src", "_a"), ["src"], "inner", hot)
    tagged = attach(tagged, g.toDF("dst", "_b"), ["dst"], "inner", hot and hot.withColumnRenamed("src", "dst"))
    per = tagged.groupBy("_a").agg(
        F.sum("weight").alias("_tot"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0)).alias("_in")
    )
    whole = links.agg(F.sum("weight").alias("_m")).scalar()
    return per.agg(F.sum(F.col("_in") / whole - F.pow(F.col("_tot") / whole, 2)).alias("modularity"))


def node_table(edges: DataFrame, sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """Vertices with size, degree and community, ready for export."""
    return degree(edges).join(sizes, "id").join(groups, "id")
