"""Near-duplicate classes by ProbMinHash.

Each text is a multiset of shingles of ``WORDS`` words, weighted by how often they occur. Every
shingle sends a Poisson stream of arrivals at the rate of its weight; each arrival falls into
one of ``REGISTERS`` registers, which keeps the shingle of its earliest arrival. Streams stop
as soon as no register can change. Two texts agree in a register with the probability Jaccard
similarity of their weighted shingles.

Exact copies are one node. Nodes meet in bands of ``ROWS`` registers. In each bucket every node
is compared with the bucket's hub, the node that meets the most others in all its buckets; so
the buckets of one group of copies mostly share their hub. Further hubs come from the nodes outside the
bucket's largest component for as long as hubs find links (``PAYS``). Then every node outside it
is compared with the bucket's nodes of other components, block by block: blocks of about
``BLOCK_BYTES`` with registers and shingles meet, each pair in the first bucket that the two
share, and only links leave the task. So n copies that link make about n pairs; nodes of one
bucket that do not link are compared by their registers, which is quadratic in their number,
but make no rows. No link is lost within the bands: two texts of similarity 0.8
share none of them with probability 0.00007. Candidates pass an estimate from the registers
(five standard errors below the threshold), then the exact similarity of their shingles, and
links are joined to components by alternating large and small stars.

Defined cases: a null or empty text, or one without a word, is a class of its own; a text of
fewer than ``WORDS`` words is one shingle; equal texts are one class; of repeated rows ``keep``
leaves one; a null doc_id is the last choice for the one that stays; an empty table gives an
empty table; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import discard
from .common import SPACES, fresh, lookup, settled

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Least share of equal registers for the exact comparison: five standard errors below.
LEAST_ESTIMATE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: A round of hubs is followed by another one if this share of its pairs were links.
PAYS = 0.125
#: Size of one block of nodes, on average; the shingles of one text stay together.
BLOCK_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, b in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(b, k, 2**64))])
    return _powers


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word, from prefix sums over the joined words."""
    line = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    up, down = _powers_of(len(line) + 1)
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[: len(line)])])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their weights."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mix(out * np.uint64(3) + h[k : k + n])
    return np.unique(out, return_counts=True)


def registers(ids: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers: the shingle with the earliest arrival in each."""
    best, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    live, rate, clock = ids, weights.astype(float), np.zeros(len(ids))
    done, width = 0, max(1, int(m * (np.log(m) + 2) / max(1, len(ids))))
    while len(live):
        k = np.arange(done + 1, done + width + 1, dtype=np.uint64)
        h = _mix(live[:, None] + k[None, :] * _BASE)
        gaps = -np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        times = clock[:, None] + np.cumsum(gaps, axis=1) / rate[:, None]
        clock = times[:, -1]
        at, who = times.ravel(), np.repeat(live, width)
        place = ((_mix(h ^ _BASE) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64).ravel()
        near = np.flatnonzero(at < best[place])
        order = near[np.argsort(-at[near], kind="stable")]  # the earliest is written last
        best[place[order]], owner[place[order]] = at[order], who[order]
        stay = clock < best.max()
        live, rate, clock = live[stay], rate[stay], clock[stay]
        done += width
    return owner


def band_keys(owner: np.ndarray) -> np.ndarray:
    rows = owner.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * np.uint64(5) + rows[:, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets of sorted ids."""
    if (wa == 1).all() and (wb == 1).all():
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared / max(1, len(a) + len(b) - shared)
    ids = np.union1d(a, b)
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a)], y[np.searchsorted(ids, b)] = wa, wb
    both = (x > 0) & (y > 0)
    total = 0.0
    pairs, times = np.unique(np.stack([x[both], y[both]]), axis=1, return_counts=True)
    for (p, q), n in zip(pairs.T, times):
        total += n / np.maximum(x / p, y / q).sum()
    return total


def _few(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` dealt to as many tasks as its measured size asks for.

    Links and buckets are small next to the texts and are settled many times; a file, or a
    call to Python, for each shuffle partition would cost more than the work. What ``df`` is
    made of runs at its own width: only its rows move to the fewer tasks.
    """
    return df.repartition(max(1, -(-rows // per_task)))


def _in_few(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    return settled(_few(df, rows, per_task))


def _text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _wordless(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)) == ""


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the exact text; texts without a word are left out."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), t.alias("text"), _text_key(t).alias("key")).where(~_wordless(t))


def _nodes(docs: DataFrame) -> DataFrame:
    """One node an exact text: nid, key, first doc_id, bands, low bits of the registers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bands, low = [], []
            for text in b["text"]:
                owner = registers(*shingles(text))
                bands.append(band_keys(owner))
                low.append((owner >> np.uint64(48)).astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "bands": bands, "low": low})

    keyed = _keyed(docs).select(F.col("doc_id").cast("long"), "key", "text")
    marked = keyed.mapInPandas(run, "doc_id bigint, key binary, bands array<bigint>, low binary")
    one = marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    return settled(one.withColumn("nid", F.monotonically_increasing_id()))


def _estimated(pairs: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """The pairs (u, v) whose registers (nid, low) agree often enough for the exact comparison."""

    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype="<u2").reshape(-1, REGISTERS)
        y = np.frombuffer(b"".join(b), dtype="<u2").reshape(-1, REGISTERS)
        return pd.Series((x == y).mean(axis=1))

    both = pairs.join(low.select(F.col("nid").alias("u"), F.col("low").alias("a")), "u").join(
        low.select(F.col("nid").alias("v"), F.col("low").alias("b")), "v"
    )
    return _few(both, rows, 10_000).where(agree("a", "b") >= LEAST_ESTIMATE).select("u", "v")


def _sets(nodes: DataFrame, docs: DataFrame, nids: DataFrame) -> DataFrame:
    """nid, shingle ids and weights of the nodes that share a bucket, from one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({
                "nid": b["nid"], "ids": [(i >> np.uint64(16)).astype("<u8").tobytes() for i, _ in found],
                "weights": [w.astype("<u4").tobytes() if (w > 1).any() else b"" for _, w in found],
            })

    # of exact copies only the text of the least doc_id is read on; a null one counts as the least number
    row = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)).cast("long"))
    wanted = _in_few(nodes.join(nids, "nid").select("nid", "key", row("first").alias("first")), nids.count(), 100_000)
    texts = lookup(_keyed(docs).select("key", row("doc_id").alias("first"), "text"), wanted, ["key", "first"], "inner")
    return settled(texts.select("nid", "text").mapInPandas(run, "nid bigint, ids binary, weights binary").dropDuplicates(["nid"]))


def _alike(ids_a: bytes, weights_a: bytes, ids_b: bytes, weights_b: bytes) -> bool:
    """Whether two packed sets of shingles reach the threshold."""

    def one(ids, weights):
        i = np.frombuffer(ids, dtype="<u8")
        return i, np.frombuffer(weights, dtype="<u4") if weights else np.ones(len(i))

    return similarity(*one(ids_a, weights_a), *one(ids_b, weights_b)) >= SIMILARITY - 1e-9


def _exact(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of ``near`` (settled) of exact similarity at or above the threshold: u, v."""
    need = settled(near.select(F.explode(F.array("u", "v")).alias("nid")).distinct())
    held = lookup(sets, need, ["nid"], "left_semi")  # only these sets move

    @F.pandas_udf("boolean")
    def alike(ia: pd.Series, wa: pd.Series, ib: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([_alike(*pair) for pair in zip(ia, wa, ib, wb)])

    side = lambda k, a, w: held.select(F.col("nid").alias(k), F.col("ids").alias(a), F.col("weights").alias(w))
    both = near.join(side("u", "ia", "wa"), "u").join(side("v", "ib", "wb"), "v")
    out = settled(_few(both, near.count(), 2_000).where(alike("ia", "wa", "ib", "wb")).select("u", "v"))
    discard(need)
    return out


def _verified(pairs: DataFrame, low: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The pairs of exact similarity at or above the threshold: u, v. ``rows``: of the buckets."""
    near = settled(_estimated(pairs, low, rows))
    out = _exact(near, sets)
    discard(near)
    return out


def _by_blocks(placed: DataFrame, marks: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: links between nodes outside and the nodes of other components in their buckets.

    ``placed`` has all nodes of these buckets (band, b, nid, root, out), ``marks`` the bands and
    low bits of the registers of a node, ``sets`` its shingles. Each pair is compared once, in the
    first of the buckets that it shares.
    """
    nids = settled(placed.select("nid").distinct())
    marks = settled(marks.join(nids, "nid").join(sets, "nid").withColumn("bytes", F.length("ids") + F.length("weights") + 500))
    nodes = placed.join(marks.select("nid", "bytes"), "nid")
    parts = settled(nodes.groupBy("b").agg(
        F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("parts"), F.ceil(F.sum(F.when(F.col("out"), F.col("bytes"))) / BLOCK_BYTES).alias("turns")
    ))
    share = lambda n: F.pmod(F.xxhash64("nid"), F.col(n))
    dealt = placed.join(parts, "b").withColumns({"part": share("parts"), "turn": share("turns")}).join(marks.drop("bytes"), "nid")
    fields = ("nid", "root", "low", "bands", "ids", "weights")

    def blocks(df: DataFrame, keys: list[str], to: str, more: tuple = ()) -> DataFrame:
        packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*fields, *more)).alias("x"))
        return settled(packed.select(*keys, *[F.col(f"x.{c}").alias(f"{to}_{c}") for c in (*fields, *more)]))

    left = blocks(dealt, ["b", "band", "part", "turns"], "m", ("out",))
    right = blocks(dealt.where("out"), ["b", "turn"], "h")
    met = left.select("b", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        regs = lambda x: np.frombuffer(b"".join(x), dtype="<u2").reshape(-1, REGISTERS)
        for batch in batches:
            found = []
            for r in batch.itertuples():
                nid, root, out = np.array(r.m_nid), np.array(r.m_root), np.array(r.m_out)
                low, keys = regs(r.m_low), np.stack(r.m_bands)
                for hub, of, mark, bands, ids, weights in zip(r.h_nid, r.h_root, regs(r.h_low), r.h_bands, r.h_ids, r.h_weights):
                    # two nodes that are both outside meet twice; the greater one is the hub
                    at = np.flatnonzero((root != of) & (~out | (nid < hub)))
                    at = at[(keys[at] == bands).argmax(axis=1) == r.band]
                    at = at[(low[at] == mark).mean(axis=1) >= LEAST_ESTIMATE]
                    found += [
                        (max(nid[k], hub), min(nid[k], hub)) for k in at if _alike(r.m_ids[k], r.m_weights[k], ids, weights)
                    ]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    joined = met.join(left.drop("turns"), ["b", "part"]).join(right, ["b", "turn"]).drop("b", "part", "turn")
    out = settled(joined.repartition(max(1, -(-met.count() // 8))).mapInPandas(run, "u bigint, v bigint"))
    discard(nids, marks, parts, left, right)
    return out


def components(links: DataFrame) -> DataFrame:
    """nid, root (least nid of the component) of every node that has a link."""
    links = settled(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows = links.count()
    few = lambda df: _in_few(df, rows, 100_000)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.where("u <> v").distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = few(small.where("u <> v").distinct())
        # done when every node points to one root, and no root points on
        again = links.groupBy("u").count().where("count > 1").select("u").unionByName(
            links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi")
        )
        if again.isEmpty():
            break
    return links.select(F.col("u").alias("nid"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("nid"), F.col("v").alias("root")).distinct()
    )


def _links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Components over all links of the bands: nid, root."""
    spread = nodes.select("nid", F.posexplode("bands").alias("band", "b"))
    shared = spread.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = settled(spread.join(shared, "b").select("b", "band", "nid", "n"))
    rows = entries.count()
    few = lambda df: _in_few(df, rows, 200_000)
    nids = few(entries.groupBy("nid").agg(F.sum("n").alias("meets")))
    marks, sets = few(nodes.select("nid", "low", "bands").join(nids.select("nid"), "nid")), _sets(nodes, docs, nids.select("nid"))
    low = marks.select("nid", "low")
    entries = few(entries.join(nids, "nid"))
    central = lambda df: df.groupBy("b").agg(F.max(F.struct("meets", "nid")).alias("x")).select("b", F.col("x.nid").alias("hub"))
    pair = lambda df: df.select(F.greatest("nid", "hub").alias("u"), F.least("nid", "hub").alias("v"))
    seen = few(pair(entries.join(central(entries), "b").where("nid <> hub")).distinct())
    links = _verified(seen, low, sets, rows)
    found, paid = few(components(links)), links.count() >= PAYS * seen.count()
    # buckets of two are seen; larger ones may hold nodes of several components that have not met
    many = entries.where("n > 2").select("b", "band", "nid", "meets")
    while True:
        placed = few(many.join(found, "nid", "left").withColumn("root", F.coalesce("root", "nid")))
        groups = placed.groupBy("b", "root").agg(F.count(F.lit(1)).alias("c"))
        top = groups.groupBy("b").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        placed = few(placed.join(top.select("b", F.col("top.root").alias("main")), "b"))
        outside = placed.where("root <> main")
        if outside.isEmpty():
            return found
        last = not paid
        if not last:
            hubs = outside.join(central(outside), "b").where("nid = hub").select("b", "hub", F.col("root").alias("hub_root"))
            pairs = pair(placed.join(hubs, "b").where("root <> hub_root")).distinct()
            pairs = few(pairs.join(seen, ["u", "v"], "left_anti"))  # no pair is compared twice
            fresh_links = _verified(pairs, low, sets, rows)
            paid, seen = fresh_links.count() >= max(1, PAYS * pairs.count()), seen.unionByName(pairs)
        else:
            out = (F.col("root") != F.col("main")).alias("out")
            fresh_links = _by_blocks(placed.select("b", "band", "nid", "root", out), marks, sets)
        if not fresh_links.isEmpty():
            stars = found.where("nid <> root").select(F.col("nid").alias("u"), F.col("root").alias("v"))
            before, found = found, few(components(stars.unionByName(fresh_links)))
            discard(before)
        discard(placed, fresh_links)
        if last:
            return found


def _classes(docs: DataFrame) -> DataFrame:
    """key, root: the class of every exact text with a word."""
    nodes = _nodes(docs)
    return nodes.select("nid", "key").join(_links(nodes, docs), "nid", "left").select("key", F.coalesce("root", "nid").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size (rows) of every document."""
    classes = settled(_classes(docs))
    rows = settled(_keyed(docs).select("doc_id", "key").join(classes, "key").select("doc_id", "root"))
    per = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = docs.where(_wordless(F.col("text"))).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return lookup(rows, settled(per), ["root"]).select("doc_id", "class_id", "class_size").unionByName(alone)


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that of least doc_id."""
    classes = settled(_classes(docs))
    ids = _keyed(docs).select("doc_id", "key").groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "rows")
    best = settled(
        ids.join(classes, "key").groupBy("root").agg(F.min(first).alias("x"))
        .select(F.col("x.key").alias("_key"), F.col("x.doc_id").alias("_id"), F.col("x.rows").alias("_rows"))
    )
    names = {k: fresh(docs, k) for k in ("_key", "_id", "_rows")}
    t = F.coalesce(F.col("text"), F.lit(""))
    side = best.withColumnsRenamed(names)
    joined = docs.withColumn(names["_key"], _text_key(t)).join(side, names["_key"]).where(
        F.col("doc_id").eqNullSafe(F.col(names["_id"]))
    )
    single = joined.where(F.col(names["_rows"]) == 1).select(*docs.columns)
    repeated = joined.where(F.col(names["_rows"]) > 1).dropDuplicates([names["_key"]]).select(*docs.columns)
    alone = docs.where(_wordless(F.col("text")))
    return single.unionByName(repeated).unionByName(alone)
