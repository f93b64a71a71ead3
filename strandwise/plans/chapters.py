"""Sentence tables of a long text: clean columns, chapter words, topic streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.relational import lump_n
from ..operators.series import change_points

LIST_COLUMNS = ["rep_ori", "rep_keybert", "rep_mmr"]


def sentence_table(docs: DataFrame, topics: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Sentences, topics and sentiment joined by row key, list texts as arrays."""
    rows = docs.join(topics, "id").join(sentiment, "id")
    rows = rows.withColumns({c: text.split_list(F.col(c)) for c in LIST_COLUMNS})
    return rows.withColumn("top_words", text.split_words(F.col("top_words")))


def segment_keywords(sentences: DataFrame, last_chapter, names: DataFrame) -> DataFrame:
    """Topic keywords of the chapters up to ``last_chapter`` that are also names."""
    sure = sentences.where((F.col("title_id") <= last_chapter) & (F.col("prob") == 1))
    words = sure.select(F.explode(F.array_distinct(F.concat(*LIST_COLUMNS))).alias("name")).distinct()
    return words.intersect(names.select("name"))


def first_segment_end(series_df: DataFrame, key: str, order: str, x: str, q: int = 15, penalty: float | None = None) -> DataFrame:
    """Per series the last chapter before its first change point (the last of all without one): key, last_chapter."""
    points = change_points(series_df, [key], order, x, q=q, penalty=penalty)
    first = points.groupBy(key).agg(F.min("at_order").alias("_first"))
    ends = series_df.where(F.col(x).isNotNull()).groupBy(key).agg(F.max(order).alias("_last"))
    return ends.join(first, key, "left").select(key, F.coalesce("_first", "_last").alias("last_chapter"))


def segment_terms(hits: DataFrame, docs: DataFrame, id_col: str, chapter: str, last_chapter, sure: Column, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents up to ``last_chapter``, and their hits of terms that a sure one holds and that are ``names``."""
    chosen = docs.where(F.col(chapter) <= last_chapter)
    inside = hits.join(chosen.select(F.col(id_col).alias("doc_id"), sure.alias("_sure")), "doc_id")
    terms = inside.where("_sure").select("term").intersect(names.select("term"))
    return chosen, inside.drop("_sure").join(terms, "term", "left_semi")


def topic_stream(sentences: DataFrame, n: int = 5) -> DataFrame:
    """Sentences per chapter and topic for the n most frequent topics, with the
    keywords of the first sentence."""
    rows = lump_n(sentences.withColumn("topic_id", F.col("topic_id").cast("string")), "topic_id", n)
    return (
        rows.where(F.col("topic_id") != "Other")
        .groupBy("title_id", "topic_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("rep_ori", "id").alias("words"))
    )


def stream_keywords(sentences: DataFrame, n: int = 5) -> DataFrame:
    """Sorted distinct keywords of the n most frequent topics, one row each."""
    rows = lump_n(sentences.withColumn("topic_id", F.col("topic_id").cast("string")), "topic_id", n)
    every = F.array_distinct(F.concat(*LIST_COLUMNS))
    return rows.where(F.col("topic_id") != "Other").select(F.explode(every).alias("word")).distinct()
