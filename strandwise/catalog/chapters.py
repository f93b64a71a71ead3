"""Entropy, series and topic streams: documents as sentences, sources as chapters,
languages as topics, quality as sentiment; daily order values as series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..operators.profiles import exact_quantiles
from ..operators.relational import group_stat
from ..plans import chapters as plan
from .tables import longs, r6, rounded, table

LANGS = ["en", "fr", "de", "es"]


def _sentences(spark, d):
    """Documents with chapter, topic (``es`` is -1), sentiment and list texts."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    base = docs.select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("title_id"), "n_chars"
    )
    topic = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("long") - 1
    topic = F.when(topic == 3, F.lit(-1)).otherwise(topic)
    listed = F.concat(F.lit("['"), F.col("source"), F.lit("', '"), F.col("lang"), F.lit("', 'all']"))
    topics = docs.select(
        F.col("doc_id").alias("id"),
        topic.alias("topic_id"),
        (F.col("n_chars") > 1000).cast("double").alias("prob"),
        listed.alias("rep_ori"),
        F.concat(F.lit("['"), F.col("lang"), F.lit("']")).alias("rep_keybert"),
        F.concat(F.lit("['"), F.col("source"), F.lit("']")).alias("rep_mmr"),
        F.concat_ws(" - ", "lang", "source").alias("top_words"),
    )
    mood = docs.select(F.col("doc_id").alias("id")).join(labels.withColumnRenamed("doc_id", "id"), "id", "left").select(
        "id",
        F.when(F.col("quality") == 1, F.lit("Positive")).when(F.col("quality") == 0, F.lit("Negative"))
        .otherwise(F.lit("Neutral")).alias("sentiment_label"),
    )
    return plan.sentence_table(base, topics, mood)


def topic_entropy(spark, d):
    rows = _sentences(spark, d).where("topic_id > -1")
    return rounded(series.entropy_by(rows, ["title_id"], "topic_id"), "entropy")


def weighted_entropy(spark, d):
    rows = _sentences(spark, d).where("topic_id > -1")
    return rounded(series.entropy_by(rows, ["title_id"], "topic_id", weighted=True), "entropy")


def chapter_entropy(spark, d):
    out = series.chapter_entropy(_sentences(spark, d), "title_id", "topic_id", "sentiment_label", "Positive", "Negative")
    return rounded(out, "entropy")


def _daily(spark, d):
    o = table(spark, d, "orders")
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return o.groupBy("o_orderpriority", day.alias("day")).agg(F.avg("o_totalprice").alias("price"))


def _smoothed(spark, d):
    return series.rolling_mean(_daily(spark, d), ["o_orderpriority"], "day", "price", 50, "ma")


def rolling_mean(spark, d):
    return rounded(_smoothed(spark, d).select("o_orderpriority", "day", "ma"), "ma")


def change_points(spark, d):
    cut = series.change_points(_smoothed(spark, d), ["o_orderpriority"], "day", "ma", q=15)
    return cut.select("o_orderpriority", F.col("at").cast("long").alias("at"), "at_order", r6("gain").alias("gain"))


def first_change_point(spark, d):
    """The best single split of each raw daily series, whatever its gain."""
    cut = series.change_points(_daily(spark, d), ["o_orderpriority"], "day", "price", q=1, penalty=-1e9)
    return cut.select("o_orderpriority", F.col("at").cast("long").alias("at"), "at_order", F.round("gain", 3).alias("gain"))


def change_segments(spark, d):
    """Rows and mean of the smoothed series per segment."""
    rows = _smoothed(spark, d).where("ma is not null")
    points = series.change_points(rows, ["o_orderpriority"], "day", "ma", q=15)
    return series.segments(rows, ["o_orderpriority"], "day", points).groupBy("o_orderpriority", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.avg("ma").alias("mean")
    )


def interval_bins(spark, d):
    o = table(spark, d, "orders")
    b = series.interval_bin(F.col("o_totalprice"), [50000.0, 100000.0, 200000.0, 400000.0])
    return o.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high"))


def bin_mean_on_rows(spark, d):
    o = table(spark, d, "orders").withColumn(
        "bin", F.coalesce(series.interval_bin(F.col("o_orderkey"), [0.0, 500.0, 1000.0, 1e12]), F.lit(0))
    )
    out = group_stat(o, ["bin"], F.avg("o_totalprice"), "mean")
    return rounded(out.select("o_orderkey", "bin", "mean"), "mean")


def segment_keywords(spark, d):
    s = _sentences(spark, d)
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return plan.segment_keywords(s, 9, names)


def topic_stream(spark, d):
    out = plan.topic_stream(_sentences(spark, d), 2)
    return out.select("title_id", "topic_id", "n", F.array_join("words", ", ").alias("words"))


def stream_keywords(spark, d):
    return plan.stream_keywords(_sentences(spark, d), 2)


def weight_deciles(spark, d):
    """Deciles of the positive values of a measure."""
    probs = {f"p{i * 10}": i / 10 for i in range(11)}
    rows = table(spark, d, "customer").where("c_acctbal > 0").withColumn("all_rows", F.lit(1))
    q = exact_quantiles(rows, ["all_rows"], "c_acctbal", probs)
    return rounded(longs(q, "all_rows"), *probs)


QUERIES = {
    f.__name__: f
    for f in (
        topic_entropy, weighted_entropy, chapter_entropy, rolling_mean, change_points, first_change_point,
        change_segments, interval_bins, bin_mean_on_rows, segment_keywords, topic_stream, stream_keywords,
        weight_deciles,
    )
}

_SENT = """sent AS (
  SELECT documents.doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS title_id,
    CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END AS BIGINT) AS topic_id,
    n_chars > 1000 AS sure, lang, source,
    CASE quality WHEN 1 THEN 'Positive' WHEN 0 THEN 'Negative' ELSE 'Neutral' END AS mood
  FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id
)"""
_DAY = """daily AS (
  SELECT o_orderpriority, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day,
    avg(o_totalprice) AS price FROM orders GROUP BY 1, 2
)"""
_TOPTWO = """cnt AS (SELECT topic_id, count(*) AS n FROM sent GROUP BY 1),
  kept AS (SELECT topic_id FROM (SELECT topic_id, rank() OVER (ORDER BY n DESC) AS k FROM cnt) WHERE k <= 2)"""
_V = " UNION ALL ".join(
    f"SELECT title_id, '{n}' AS variable, {e} AS v FROM sent WHERE topic_id > -1"
    for n, e in (
        ("topic_entropy", "topic_id || ''"),
        ("topic_sentiment_entropy", "topic_id || '_' || mood"),
        ("sentiment_entropy", "mood"),
        ("positive_topic_entropy", "CASE WHEN mood = 'Positive' THEN topic_id || '' END"),
        ("negative_topic_entropy", "CASE WHEN mood = 'Negative' THEN topic_id || '' END"),
    )
)
_COST = "{n} * (ln(2 * pi()) + ln(({s2} - ({s1}) * ({s1}) / ({n})) / ({n})) + 1)"

SQL = {
    "topic_entropy": f"""WITH {_SENT}, c AS (SELECT title_id, topic_id, count(*) AS n FROM sent WHERE topic_id > -1 GROUP BY 1, 2),
        p AS (SELECT title_id, n * 1.0 / sum(n) OVER (PARTITION BY title_id) AS p FROM c)
        SELECT title_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY 1""",
    "weighted_entropy": f"""WITH {_SENT}, c AS (SELECT title_id, topic_id, count(*) AS n FROM sent WHERE topic_id > -1 GROUP BY 1, 2),
        p AS (SELECT title_id, n, n * 1.0 / sum(n * n) OVER (PARTITION BY title_id) AS p FROM c)
        SELECT title_id, round(-sum(n * p * ln(p)) , 6) AS entropy FROM p GROUP BY 1""",
    "chapter_entropy": f"""WITH {_SENT}, l AS ({_V}), c AS (SELECT title_id, variable, v, count(*) AS n FROM l
          WHERE v IS NOT NULL GROUP BY 1, 2, 3),
        p AS (SELECT title_id, variable, n * 1.0 / sum(n) OVER (PARTITION BY title_id, variable) AS p FROM c)
        SELECT title_id, variable, round(abs(sum(p * ln(p))), 6) AS entropy FROM p GROUP BY 1, 2""",
    "rolling_mean": f"""WITH {_DAY} SELECT o_orderpriority, day, round(CASE WHEN count(price) OVER w = 50
        THEN avg(price) OVER w END, 6) AS ma FROM daily
        WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "first_change_point": f"""WITH {_DAY}, x AS (SELECT o_orderpriority, day, price - avg(price) OVER (PARTITION BY o_orderpriority) AS v FROM daily),
        r AS (SELECT o_orderpriority, day, row_number() OVER w AS n, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2,
              count(*) OVER a AS m, sum(v) OVER a AS t1, sum(v * v) OVER a AS t2 FROM x
              WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY o_orderpriority)),
        g AS (SELECT o_orderpriority, n, day, {_COST.format(n="m", s1="t1", s2="t2")} - {_COST.format(n="n", s1="s1", s2="s2")}
              - {_COST.format(n="(m - n)", s1="(t1 - s1)", s2="(t2 - s2)")} AS gain FROM r WHERE n >= 2 AND n <= m - 2)
        SELECT o_orderpriority, arg_max(n, gain) AS at, arg_max(day, gain) AS at_order, round(max(gain), 3) AS gain FROM g GROUP BY 1""",
    "interval_bins": """SELECT CASE WHEN o_totalprice >= 50000 AND o_totalprice <= 100000 THEN 1
        WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 2 WHEN o_totalprice > 200000 AND o_totalprice <= 400000 THEN 3
        END::BIGINT AS bin, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY 1""",
    "bin_mean_on_rows": """WITH b AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey <= 500 THEN 1
          WHEN o_orderkey <= 1000 THEN 2 ELSE 3 END::BIGINT AS bin FROM orders)
        SELECT o_orderkey, bin, round(avg(o_totalprice) OVER (PARTITION BY bin), 6) AS mean FROM b""",
    "segment_keywords": f"""WITH {_SENT} SELECT DISTINCT source AS name FROM sent WHERE title_id <= 9 AND sure""",
    "topic_stream": f"""WITH {_SENT}, {_TOPTWO} SELECT title_id, topic_id || '' AS topic_id, count(*) AS n,
        arg_min(source || ', ' || lang || ', all', id) AS words FROM sent WHERE topic_id IN (SELECT topic_id FROM kept) GROUP BY 1, 2""",
    "stream_keywords": f"""WITH {_SENT}, {_TOPTWO}, k AS (SELECT * FROM sent WHERE topic_id IN (SELECT topic_id FROM kept))
        SELECT source AS word FROM k UNION SELECT lang FROM k UNION SELECT 'all' FROM k""",
    "weight_deciles": "SELECT CAST(1 AS BIGINT) AS all_rows, "
    + ", ".join(f"round(quantile_cont(c_acctbal, {i / 10}), 6) AS p{i * 10}" for i in range(11))
    + " FROM customer WHERE c_acctbal > 0",
}
