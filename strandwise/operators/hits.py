"""Term incidence in documents, co-occurrence, correlation and evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import top_k
from .skew import attach, cut_lineage, hot_keys, numbered, pick_hot

TILE = 1_000
#: Pairs (or hits) of one task.
TASK_PAIRS = 400_000
BROADCAST_CHARS, BROADCAST_ROWS = 16_000_000, 1_000_000
WINDOW = 256
SPACE = r"\s+"


def _inside(pieces: DataFrame, terms: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(pid, term) for every term that is a substring of a piece (pid, piece).

    Terms are taken in classes of 2^k to 2^(k+1) - 1 characters. Each place of a piece gives
    one row a class: its next characters, met with the terms by the first 2^k of them and
    then compared in full. The piece itself is not carried along, so the work and what
    is moved grow with the text's length.
    """
    out = None
    for k in sorted({n.bit_length() - 1 for n in lengths}):
        least, longest = 1 << k, max(n for n in lengths if n.bit_length() - 1 == k)
        some = terms.where(F.char_length("term").between(least, longest)).select("term", F.substring("term", 1, least).alias("seed"))
        size = F.char_length("piece")
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(WINDOW)).cast("int"), F.lit(1)) - 1)
        # Windows keep substrings near the front of short strings, whatever the piece's size.
        view = F.substring("piece", F.col("_w") * WINDOW + 1, F.lit(WINDOW + longest - 1))
        cut = pieces.where(size >= least).select("pid", "piece", F.explode(starts).alias("_w")).select("pid", view.alias("_v"))
        last = F.least(F.lit(WINDOW), F.char_length("_v") - least + 1)
        at = cut.where(last >= 1).select("pid", "_v", F.explode(F.sequence(F.lit(1), last)).alias("_at"))
        rows = at.select("pid", F.substring("_v", F.col("_at"), F.lit(longest)).alias("_next"))
        rows = rows.withColumn("seed", F.substring("_next", 1, least))
        met = rows.join(F.broadcast(some) if small else some, "seed").where(F.col("_next").startswith(F.col("term")))
        found = met.select("pid", "term")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def term_hits(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """Distinct (document, term) where the literal term occurs anywhere in the text.

    Texts are reduced to their distinct space-separated pieces; a term with spaces in it
    is searched in whole texts. There is no document-by-term comparison. The
    vocabulary is broadcast only when its measured size is at most
    ``BROADCAST_CHARS`` characters and ``BROADCAST_ROWS`` terms. Then each document's pieces are searched
    where its text is read, and only hits move. Otherwise the vocabulary is joined by shuffle, and only the
    distinct pieces of the whole collection are searched.
    """
    spark = docs.sparkSession
    vocab = terms.select(terms.columns[0]).toDF("term").where(F.char_length("term") > 0).distinct()
    spaced_term = F.col("term").rlike(SPACE)
    shape = vocab.groupBy(spaced_term.alias("spaced"), F.char_length("term").alias("n")).agg(F.count(F.lit(1)).alias("m"))
    found = [(r["spaced"], r["n"], r["m"]) for r in shape.collect()]  # one row per term length
    small = sum(n * m for _, n, m in found) <= BROADCAST_CHARS and sum(m for _, _, m in found) <= BROADCAST_ROWS
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for spaced in (False, True):
        lengths = sorted(n for s, n, _ in found if s == spaced)
        if not lengths:
            continue
        part = F.array(F.col(text_col)) if spaced else F.array_distinct(F.split(text_col, SPACE))  # a document moves each of its pieces once
        pieces = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(part).alias("piece"))
        pieces = pieces.where(F.char_length("piece") >= lengths[0])
        wanted = vocab.where(spaced_term if spaced else ~spaced_term)
        if small:
            hits = _inside(pieces.withColumnRenamed("doc_id", "pid"), wanted, lengths, small).withColumnRenamed("pid", "doc_id")
            out = hits if out is None else out.unionByName(hits)  # a term is in one of both parts
            continue
        # Cutting pieces up is far more work than their bytes suggest: keep all tasks.
        unique = pieces.select("piece").distinct().repartition(tasks, "piece")
        unique = cut_lineage(unique.withColumn("pid", F.monotonically_increasing_id()))
        matched = cut_lineage(_inside(unique, wanted, lengths, small).join(unique, "pid").select("piece", "term"))
        hits = attach(pieces, matched, ["piece"], "inner").select("doc_id", "term").distinct()
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("term")).limit(0)
    return out


def doc_freq(hits: DataFrame) -> DataFrame:
    """Documents per term, and the logarithm used as vertex size."""
    n = hits.groupBy("term").agg(F.count_distinct("doc_id").alias("n_docs"))
    return n.withColumn("log_docs", F.ln("n_docs"))


def frequent_only(hits: DataFrame, least: int) -> DataFrame:
    """Hits of terms found in at least ``least`` documents. Applied before pairs are
    formed, it gives the same graph as dropping small vertices afterwards."""
    counts = cut_lineage(doc_freq(hits).select("term", F.col("n_docs").alias("_rows")))
    return attach(hits, counts.where(F.col("_rows") >= least).select("term"), ["term"], "left_semi", pick_hot(counts))


def cooccurrence(hits: DataFrame, mean_of: str | None = None) -> DataFrame:
    """Documents per pair of terms (a < b), optionally with the mean of a document value.

    Documents are dealt to as many tasks as their pairs need (``TASK_PAIRS`` each), so what a task
    holds does not grow with the input; a document's pairs come from its sorted terms. Where the
    terms are so few that pairs must repeat in a task, they are counted before they move. A document
    with more than ``TILE`` terms is cut into blocks, and each pair of blocks becomes its own join
    key, so it spreads over many tasks.
    """
    cols = ["doc_id", "term", *([mean_of] if mean_of else [])]
    rows = hits.select(*cols).where("doc_id is not null and term is not null").dropDuplicates(["doc_id", "term"])
    rows = cut_lineage(rows)  # read for sizes, terms and pairs
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    few = F.when(F.col("_rows") <= TILE, F.col("_rows"))
    n_rows, n_pairs, most = sizes.agg(F.sum(few), F.sum(few * (few - 1) / 2), F.max("_rows")).first()
    need = math.ceil(max(n_rows or 0, n_pairs or 0) / TASK_PAIRS)
    parts = max(hits.sparkSession.sparkContext.defaultParallelism, need)
    n_terms = rows.agg(F.approx_count_distinct("term")).first()[0]
    repeats = (n_pairs or 0) / parts >= n_terms * n_terms / 4  # half of all pairs there can be
    sums = [F.count(F.lit(1)).alias("_n")]
    if mean_of:
        sums += [F.sum(mean_of).alias("_s"), F.count(mean_of).alias("_k")]
    if (most or 0) <= TILE:
        counts = _listed_pairs(rows, mean_of, parts, sums, repeats)
    else:
        crowded = cut_lineage(sizes.where(F.col("_rows") > TILE))
        hot = pick_hot(crowded)
        plain = attach(rows, crowded.select("doc_id"), ["doc_id"], "left_anti", hot)
        blocks = crowded.select("doc_id", F.ceil(F.col("_rows") / TILE).alias("_p"))
        tiled = attach(rows, blocks, ["doc_id"], "inner", hot)
        counts = _listed_pairs(plain, mean_of, parts, sums, repeats).unionByName(_tiled_pairs(tiled, cols, sums))
    aggs = [F.sum("_n").alias("weight")]
    if mean_of:
        aggs.append(F.try_divide(F.sum("_s"), F.sum("_k")).alias(f"mean_{mean_of}"))
    return counts.repartition(parts, "a", "b").groupBy("a", "b").agg(*aggs)


def _listed_pairs(rows: DataFrame, mean_of: str | None, parts: int, sums: list[Column], repeats: bool) -> DataFrame:
    """Sums per pair over documents of few terms, one row a pair and task or (not ``repeats``) a pair and document."""
    task = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = rows.withColumns({"_task": task, "_v": F.col(mean_of) if mean_of else F.lit(0)}).repartitionById(parts, F.col("_task"))
    lists = rows.groupBy("_task", "doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "_v"))).alias("_l"))
    firsts = lists.select("_task", "_l", F.posexplode("_l").alias("_i", "_x"))
    rest = F.slice("_l", F.col("_i") + 2, F.size("_l"))
    met = firsts.select("_task", F.col("_x.term").alias("a"), F.col("_x._v").alias(mean_of or "_v"), F.explode(rest).alias("_y"))
    met = met.withColumn("b", F.col("_y.term")).drop("_y")
    if repeats:
        return met.groupBy("_task", "a", "b").agg(*sums).drop("_task")
    one = [F.lit(1).cast("long").alias("_n")]
    if mean_of:
        one += [F.col(mean_of).alias("_s"), F.col(mean_of).isNotNull().cast("long").alias("_k")]
    return met.select("a", "b", *one)


def _tiled_pairs(rows: DataFrame, cols: list[str], sums: list[Column]) -> DataFrame:
    """Sums per pair over documents of many terms, which are cut into ``_p`` blocks."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("term"), "_p"))
    other = F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)
    tiles = rows.withColumn("_o", F.explode(other)).select(
        *cols, "_b", F.least("_b", "_o").alias("_ti"), F.greatest("_b", "_o").alias("_tj")
    )
    left = tiles.withColumnRenamed("term", "a")
    right = tiles.select("doc_id", F.col("term").alias("b"), F.col("_b").alias("_c"), "_ti", "_tj")
    # A tile of two blocks pairs across them; a tile of one block pairs inside it.
    met = left.join(right, ["doc_id", "_ti", "_tj"]).where(
        (F.col("a") < F.col("b")) & ((F.col("_ti") == F.col("_tj")) | (F.col("_b") != F.col("_c")))
    )
    return met.groupBy("a", "b").agg(*sums)


def term_correlation(hits: DataFrame, n_docs: Column | int) -> DataFrame:
    """Pearson correlation of the 0/1 columns of co-occurring terms, from counts.

    Pairs that never meet correlate at zero or below, so the sparse pairs suffice
    for every graph built on positive weights.
    """
    hits = cut_lineage(hits.select("doc_id", "term"))  # read for sizes, pairs and counts
    pairs = cut_lineage(cooccurrence(hits))
    hot_a, hot_b = hot_keys(pairs, ["a"]), hot_keys(pairs, ["b"])
    n = hits.groupBy("term").agg(F.count_distinct("doc_id").alias("_n"))
    total = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    rows = attach(pairs, n.select(F.col("term").alias("a"), F.col("_n").alias("_na")), ["a"], "inner", hot_a)
    rows = attach(rows, n.select(F.col("term").alias("b"), F.col("_n").alias("_nb")), ["b"], "inner", hot_b)
    na, nb, nn = F.col("_na").cast("double"), F.col("_nb").cast("double"), total.cast("double")
    below = F.sqrt(na * (nn - na) * nb * (nn - nb))
    return rows.select("a", "b", "weight", ((nn * F.col("weight") - na * nb) / F.nullif(below, F.lit(0.0))).alias("r"))


def pair_evidence(
    hits: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = 5, sure: Column | None = None
) -> DataFrame:
    """All texts holding both ends of the k heaviest pairs, one row per text.

    Pairs are weighed over all hits; ``sure`` says which of ``docs`` are read as evidence.
    Rows carry the pair's rank and are read in document order; ``evidence_texts`` joins them.
    """
    top = cooccurrence(hits).orderBy(F.desc("weight"), "a", "b").limit(k)
    top = numbered(top, [F.desc("weight"), "a", "b"], "rank").select("rank", "a", "b", "weight")
    ends = F.broadcast(top)  # k rows
    a = hits.join(ends, F.col("term") == F.col("a")).select("doc_id", "rank", "a", "b", "weight")
    b = hits.join(ends.select(F.col("rank").alias("_r"), F.col("b").alias("_b")), F.col("term") == F.col("_b"))
    both = a.join(b.select("doc_id", F.col("_r").alias("rank")), ["doc_id", "rank"])
    texts = (docs if sure is None else docs.where(sure)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return both.join(texts, "doc_id").select("rank", "a", "b", "weight", "doc_id", "text")


def evidence_texts(evidence: DataFrame, most: int = 1000) -> DataFrame:
    """One string a pair: its texts in document order, one a line, and how many there are.

    A string holds the first ``most`` texts; ``n_texts`` counts all, and the rows of
    ``pair_evidence`` hold them all.
    """
    pair = ["rank", "a", "b", "weight"]
    sizes = evidence.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_texts"))
    first = top_k(evidence, pair, [F.col("doc_id"), F.col("text")], most, "_at")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])
    return sizes.join(first.groupBy(*pair).agg(F.array_join(lines, "\n").alias("text")), pair)
