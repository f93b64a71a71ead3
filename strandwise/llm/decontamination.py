"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (term, document row, word position) for every occurrence of the
terms that are asked for; it is written once, without a shuffle, by the tasks that split the
texts. A phrase is looked up from its rarest terms: the posting lists of its two rarest words are
moved to the start that they would share and intersected by a join; the rows that are left meet
the lists of all other words of the phrase, moved the same way, and a start counts when every
word is there. Phrases that share a pair of rarest words at one distance share its join. A
proximity search starts from the postings of the rarest term and gathers those of the other
terms nearby. Every step is a Spark join or aggregate over hashed (document, position) keys, so
neither a long document, nor a frequent word, nor a passage that many documents copy gathers in
one task. What the phrases need of the vocabulary is broadcast only if its measured size is small.

Defined cases: a null text has no words, and a null item neither; rows are counted one by one, so
repeated or null doc_ids keep rows of their own; item rows with one item_id are one item, a null
item_id is written as the empty text; a very long text is read whole; words that tie in frequency
are taken in order of their place; empty tables give no match and empty tables of documents an
empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lexical_words, lookup, settled

#: Consecutive words of an item that make a window.
WINDOW = 10


class PositionalIndex(NamedTuple):
    """Settled tables of an index."""

    terms: DataFrame  #: term, tid, n (occurrences in all documents)
    postings: DataFrame  #: tid, rid, pos
    rows: DataFrame  #: rid, doc_id, n_words: one row a document


def build_index(docs: DataFrame, terms: DataFrame) -> PositionalIndex:
    """Postings of the given terms (column ``term``) in all documents, from one pass over the texts.

    The empty word, which no text has, stands behind the last word of each document: its
    posting carries the document itself, and its position is the number of words.
    """
    ids = terms.where("term <> ''").select("term").distinct().withColumn("tid", F.monotonically_increasing_id())
    ids = settled(ids)
    end = ids.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid"))
    listed = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
        F.array_append(lexical_words(F.col("text")), "").alias("w"),
    )
    placed = listed.select("rid", "doc_id", F.posexplode("w").alias("pos", "term"))
    stored = settled(
        lookup(placed, settled(ids.unionByName(end)), ["term"], "inner")
        .select("tid", "rid", F.col("pos").cast("long"), F.when(F.col("tid") < 0, F.col("doc_id")).alias("doc_id"))
    )
    postings = stored.where("tid >= 0").select("tid", "rid", "pos")
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    known = settled(ids.join(counts, "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0)).alias("n")))
    return PositionalIndex(known, postings, stored.where("tid < 0").select("rid", "doc_id", F.col("pos").alias("n_words")))


def _ordered(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """pid and the places (n, at, tid) of its words, rarest first; phrases with an unseen word are left out."""
    placed = phrases.select("pid", F.posexplode("words").alias("at", "term")).join(index.terms, "term", "left")
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("at").cast("long").alias("at"), "tid")
    lists = placed.groupBy("pid").agg(F.array_sort(F.collect_list(place)).alias("p"))
    return settled(lists.where(F.get("p", F.lit(0))["n"] > 0))


def phrase_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """pid, rid, start: every place where the words of a phrase (pid, words) stand in a row."""
    plan = _ordered(index, phrases)
    first, second = F.get("p", F.lit(0)), F.get("p", F.least(F.lit(1), F.size("p") - 1))
    pairs = settled(plan.select(
        "pid", first["tid"].alias("t1"), second["tid"].alias("t2"), first["at"].alias("at"),
        (second["at"] - first["at"]).alias("step"),
    ))
    key = ["t1", "t2", "step"]
    asked = settled(pairs.select(*key).distinct())
    one = lookup(index.postings.withColumnRenamed("tid", "t1"), asked, ["t1"], "inner")
    two = lookup(index.postings.withColumnRenamed("tid", "t2"), asked, ["t2"], "inner")
    met = one.join(two.withColumn("pos", F.col("pos") - F.col("step")), [*key, "rid", "pos"])
    seen = settled(lookup(met, pairs, key, "inner").select("pid", "rid", (F.col("pos") - F.col("at")).alias("start")))
    rest = settled(plan.select("pid", F.greatest(F.size("p") - 2, F.lit(0)).alias("more"), F.explode_outer(F.slice("p", 3, 2**31 - 1)).alias("x")))
    needs = lookup(seen, rest, ["pid"], "inner").select(
        "pid", "rid", "start", "more", (F.col("start") + F.col("x.at")).alias("pos"), F.col("x.tid").alias("tid")
    )
    rids = settled(seen.select("rid").distinct())
    lists = lookup(index.postings, rids, ["rid"], "left_semi")
    found = needs.where("more > 0").join(lists, ["rid", "pos", "tid"]).groupBy("pid", "rid", "start", "more").agg(F.count(F.lit(1)).alias("c"))
    return found.where("c = more").select("pid", "rid", "start").unionByName(needs.where("more = 0").select("pid", "rid", "start"))


def proximity_matches(index: PositionalIndex, queries: DataFrame, within: int) -> DataFrame:
    """pid, rid, at, start: every place of a query's rarest term that some ``within`` consecutive
    words share with all other terms of the query (pid, words); ``start`` is the first such stretch.

    Each anchor meets at most ``2 * within - 2`` postings, as a position holds one term.
    """
    plan = _ordered(index, queries.select("pid", F.array_distinct("words").alias("words")))
    first = F.get("p", F.lit(0))
    heads = settled(plan.select("pid", first["tid"].alias("tid"), F.size("p").alias("m")))
    others = settled(plan.select("pid", F.explode(F.slice("p", 2, 2**31 - 1)).alias("x")).select("pid", "x.tid"))
    anchors = lookup(index.postings, heads, ["tid"], "inner").select("pid", "m", "rid", F.col("pos").alias("at"))
    block = F.floor(F.col("at") / within).cast("long")
    near = lookup(index.postings, others, ["tid"], "inner").withColumn("block", F.floor(F.col("pos") / within).cast("long"))
    met = anchors.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).join(near, ["pid", "rid", "block"], "left")
    close = F.when(F.abs(F.col("pos") - F.col("at")) < within, F.struct("pos", "tid"))
    held = met.groupBy("pid", "rid", "at", "m").agg(F.collect_list(close).alias("near"))

    def whole(s: Column) -> Column:
        inside = F.filter("near", lambda x: (x["pos"] >= s) & (x["pos"] < s + within))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["tid"]))) == F.col("m") - 1

    starts = F.sequence(F.greatest(F.col("at") - within + 1, F.lit(0)), F.col("at"))
    return held.withColumn("start", F.get(F.filter(starts, whole), F.lit(0))).where("start is not null").select("pid", "rid", "at", "start")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item (its id as text) and words of every window of an item; a shorter item is one window."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), lexical_words(F.col("text")).alias("w"))
    k = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - k + 1)
    cut = F.explode(F.transform(starts, lambda s: F.slice("w", s, k)))
    return listed.where(F.size("w") > 0).select("item", cut.alias("words")).distinct()


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[PositionalIndex, DataFrame]:
    """The index, and (item, rid, start, k): each place where a window of an item stands in a document."""
    cuts = settled(windows(items, size))
    phrases = settled(cuts.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()))
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    found = phrase_matches(index, phrases)
    owner = settled(cuts.join(phrases, "words").select("pid", "item", F.size("words").cast("long").alias("k")))
    return index, settled(lookup(found, owner, ["pid"], "inner").select("item", "rid", "start", "k"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document its words, the words inside windows of items, the items, and whether there are any."""
    index, found = occurrences(docs, items)
    inside = F.explode(F.sequence("start", F.col("start") + F.col("k") - 1))
    places = found.select("rid", "start", "k").distinct().select("rid", inside.alias("pos")).distinct()
    hit = places.groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("rid", "item").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    each = index.rows.join(hit.join(named, "rid"), "rid", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return each.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """rid, doc_id, start, end: stretches of words inside windows of items, overlapping ones joined.

    The window functions go over the windows of one document, never over a group of documents.
    """
    index, found = occurrences(docs, items)
    each = found.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("k")).alias("end"))
    w = Window.partitionBy("rid").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    joined = marked.withColumn("run", F.sum("new").over(w)).groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.join(index.rows.select("rid", "doc_id"), "rid").select("rid", "doc_id", "start", "end")
