"""Job tables from ``customer`` (jobs) and ``orders`` (description segments)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from ..operators.skew import attach, cut_lineage
from ..plans import jobs
from .tables import longs, rounded, table

REGIONS = [*list(jobs.DISTRICT_NAMES)[:7], "台北市北投區", "新北市板橋區"]
INDUSTRIES = {"AUTOMOBILE": "製造業", "BUILDING": "專業服務", "FURNITURE": "製造業", "HOUSEHOLD": "金融保險"}


def _topics(spark, d):
    o = table(spark, d, "orders")
    tid = F.col("o_orderkey") % 27 - 1
    return o.select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("index"),
        F.col("o_orderpriority").alias("desc"),
        tid.alias("topic_id"),
        F.concat(F.lit("['Topic "), tid.cast("string"), F.lit("']")).alias("openai"),
    )


def _infos(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("industry"),
        F.when(n % 8 == 0, F.lit("None")).otherwise((n % 8 - 1).cast("string")).alias("experience"),
        F.when(n % 3 == 0, F.lit("")).when(n % 3 == 1, F.lit("Master")).otherwise(F.lit("Doctor")).alias("education"),
        F.element_at(F.array(*[F.lit(r) for r in REGIONS]), F.col("c_custkey").cast("int") % 9 + 1).alias("region"),
        (F.col("c_acctbal") > 5000).alias("management"),
    )


def _categories(spark, d):
    """Two category rows per job; a MACHINERY job's rows carry an id that no job has."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_mktsegment") == "MACHINERY", -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    a = c.select(key.alias("id"), F.lit("Analyst ").alias("p"), "c_nationkey", F.lit(1).alias("row"))
    b = c.select(key.alias("id"), F.lit("Ignored ").alias("p"), "c_nationkey", F.lit(2).alias("row"))
    return a.union(b).select("id", F.concat("p", (F.col("c_nationkey") % 4).cast("string")).alias("category"), "row")


def _salaries(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("年薪 up")).otherwise(F.lit("月薪")).alias("salary"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("salary_min"),
    )


def _info(spark, d):
    return jobs.job_info(_infos(spark, d), _topics(spark, d), _categories(spark, d), INDUSTRIES)


def job_info(spark, d):
    return _info(spark, d)


def job_topics(spark, d):
    return jobs.job_topics(_topics(spark, d))


def job_summary(spark, d):
    topic = cut_lineage(jobs.job_topics(_topics(spark, d)))
    return rounded(jobs.job_summary(_info(spark, d), topic, _salaries(spark, d)), "salary")


def category_keywords(spark, d):
    return jobs.category_keywords(jobs.job_topics(_topics(spark, d)))


def label_rate(spark, d):
    out = relational.label_rate(_info(spark, d), jobs.job_topics(_topics(spark, d)), "id", "topic_category")
    txt = F.concat(text.comma(F.col("n")), F.lit("\n("), text.percent(F.col("rate"), 0), F.lit(")"))
    return rounded(out, "rate").withColumn("label_text", txt)


def label_rate_by_segment(spark, d):
    out = relational.label_rate(_info(spark, d), jobs.job_topics(_topics(spark, d)), "id", "topic_category", ["category"])
    return rounded(out.where("category is not null"), "rate")


def label_rate_pivot(spark, d):
    out = relational.label_rate(_info(spark, d), jobs.job_topics(_topics(spark, d)), "id", "topic_category", ["category"])
    wide = out.where("category is not null").groupBy("category").pivot("topic_category", ["AD/GA", "AI/ML", "Database/SQL"]).agg(F.max("rate"))
    return rounded(wide.toDF("category", "ad_ga", "ai_ml", "database_sql"), "ad_ga", "ai_ml", "database_sql")


def rate_units(spark, d):
    """Each rate cut into units of 0.02 and a remainder."""
    out = relational.label_rate(_info(spark, d), jobs.job_topics(_topics(spark, d)), "id", "topic_category")
    cut = out.select("topic_category", F.posexplode(relational.repeat_to_total(F.round("rate", 4), 0.02)).alias("pos", "unit"))
    return rounded(longs(cut, "pos"), "unit")


def category_overlap(spark, d):
    return jobs.category_overlap(_info(spark, d), jobs.job_topics(_topics(spark, d)))


def status_overlap(spark, d):
    """Customers per region of the three order statuses."""
    return relational.overlap_regions(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


def topic_rate_over_rows(spark, d):
    t = attach(jobs.job_topics(_topics(spark, d)), _info(spark, d), ["id"], "inner")
    return rounded(relational.distinct_over_rows(t, ["topic_category"], ["topic_name"], "id"), "rate")


def top_topics_per_industry(spark, d):
    t = attach(jobs.job_topics(_topics(spark, d)), _info(spark, d), ["id"], "inner")
    n = t.groupBy("industry", "topic_category", "topic_name").agg(F.count_distinct("id").alias("n"))
    return longs(relational.top_k(n, ["industry"], [F.desc("n"), F.asc("topic_name")], 5), "rank")


def _features(spark, d):
    """Jobs with pay, and their labels, from the long topic table."""
    topic = cut_lineage(jobs.job_topics(_topics(spark, d)))
    return jobs.job_pay(_info(spark, d), topic, _salaries(spark, d)), jobs.job_labels(topic, "topic_category")


def topic_indicators(spark, d):
    return relational.indicators(_features(spark, d)[1], "id", "label", "tc_")


def salary_profile(spark, d):
    s, long = _features(spark, d)
    flags = relational.indicators(long, "id", "label", "tc_", ["ai_ml", "database_sql"])
    data = s.where("salary is not null").join(flags, "id")
    labels = {"tc_ai_ml": ("tc", "AI/ML"), "tc_database_sql": ("tc", "Database/SQL")}
    out = jobs.salary_profile(data, ["industry", "education", "management", "min_experience"], labels)
    return rounded(out, "mean", "q25", "q50", "q75")


def median_pivot(spark, d):
    """Median salary per category and experience, formatted in thousands."""
    from ..operators.profiles import exact_quantiles

    s = _features(spark, d)[0].where("salary is not null and category is not null")
    q = exact_quantiles(s, ["category", "min_experience"], "salary", {"q2": 0.5})
    wide = q.groupBy("category").pivot("min_experience", ["0", "1~2", "3~4", "5+"]).agg(F.max("q2"))
    names = ["y0", "y1", "y3", "y5"]
    wide = wide.toDF("category", *names)
    text_cols = {f"{n}_text": text.comma(F.col(n), 1, 0.001, "NT$", "K") for n in names}
    return rounded(wide.withColumns(text_cols), *names)


QUERIES = {
    f.__name__: f
    for f in (
        job_info, job_topics, job_summary, category_keywords, label_rate, label_rate_by_segment, label_rate_pivot,
        rate_units, category_overlap, status_overlap, topic_rate_over_rows, top_topics_per_industry,
        topic_indicators, salary_profile, median_pivot,
    )
}

_MAP = "tmap(topic_id, topic_category) AS (VALUES " + ", ".join(
    f"({i}, '" + c.replace("\n", "' || chr(10) || '") + "')" for c, ids in jobs.TOPIC_CATEGORIES.items() for i in ids
) + ")"
_TOP = (
    _MAP
    + """, seg AS (
  SELECT o_custkey AS id, o_orderkey AS idx, o_orderpriority AS "desc", o_orderkey % 27 - 1 AS topic_id FROM orders
), topic AS (
  SELECT id, "desc", 'Topic ' || topic_id AS topic_name, topic_category, min(idx) AS first_index
  FROM seg LEFT JOIN tmap USING (topic_id) WHERE topic_id <> -1 GROUP BY 1, 2, 3, 4
)"""
)
_DIST = "[" + ", ".join(f"'{jobs.DISTRICT_NAMES.get(r, 'Others')}'" for r in REGIONS) + "]"
_INFO = (
    _TOP
    + f""", info AS (
  SELECT c_custkey AS id,
    CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{jobs.SECTOR_NAMES[v]}'" for k, v in INDUSTRIES.items())} END AS industry,
    CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Master' ELSE 'Doctor' END AS education,
    c_acctbal > 5000 AS management,
    CASE WHEN c_nationkey % 8 IN (0, 1) THEN '0' WHEN c_nationkey % 8 - 1 < 3 THEN '1~2'
         WHEN c_nationkey % 8 - 1 < 5 THEN '3~4' ELSE '5+' END AS min_experience,
    {_DIST}[c_custkey % 9 + 1] AS district,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'Analyst ' || (c_nationkey % 4) END AS category
  FROM customer WHERE c_custkey IN (SELECT id FROM seg)
)"""
)
_SUM = (
    _INFO
    + """, lists AS (
  SELECT id, arg_min("desc", first_index) AS "desc",
    '[[' || string_agg('"' || topic_name || '"', ',' ORDER BY first_index, topic_name) || ']]' AS topic_name,
    '[[' || string_agg('"' || replace(topic_category, chr(10), '\\n') || '"', ',' ORDER BY first_index, topic_name) || ']]' AS topic_category
  FROM topic GROUP BY 1
), pay AS (
  SELECT c_custkey AS id, CASE WHEN c_acctbal <= 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN c_acctbal / 12
    ELSE c_acctbal END AS salary FROM customer
), summ AS (SELECT * FROM info JOIN lists USING (id) JOIN pay USING (id))"""
)
_SNAKE = "lower(regexp_replace(topic_category, '[^A-Za-z0-9]+', '_', 'g'))"
_RATE = (
    _INFO
    + """, pairs AS (SELECT DISTINCT id, topic_category, category FROM topic JOIN info USING (id))"""
)
_SEG_RATE = (
    _RATE
    + """, sr AS (SELECT category, topic_category, count(*) AS n, max(total) AS total, count(*) * 1.0 / max(total) AS rate
  FROM pairs JOIN (SELECT category, count(DISTINCT id) AS total FROM pairs GROUP BY 1) USING (category) GROUP BY 1, 2)"""
)
_ALL_RATE = (
    _RATE
    + """, ar AS (SELECT topic_category, count(*) AS n, (SELECT count(DISTINCT id) FROM pairs) AS total,
  count(*) * 1.0 / (SELECT count(DISTINCT id) FROM pairs) AS rate FROM pairs GROUP BY 1)"""
)
_FLAGS = (
    _SUM
    + """, flag AS (SELECT id, bool_or(topic_category = 'AI/ML') AS ai, bool_or(topic_category = 'Database/SQL') AS db
  FROM topic GROUP BY 1), dat AS (SELECT * FROM summ JOIN flag USING (id) WHERE salary IS NOT NULL)"""
)
_PROF = " UNION ALL ".join(
    [
        "SELECT 'industry' AS \"group\", industry AS name, salary FROM dat",
        "SELECT 'education', CASE WHEN education = '' THEN 'None' ELSE education END, salary FROM dat",
        "SELECT 'management', CASE WHEN management THEN 'Yes' ELSE 'No' END, salary FROM dat",
        "SELECT 'min_experience', min_experience, salary FROM dat",
        "SELECT 'tc', 'AI/ML', salary FROM dat WHERE ai",
        "SELECT 'tc', 'Database/SQL', salary FROM dat WHERE db",
    ]
)
_LABELS = ["ad_ga", "ai_ml", "computer_vision_deep_learning", "data_project_etl", "database_sql", "report_business_visualization"]

SQL = {
    "job_info": f"WITH {_INFO} SELECT * FROM info",
    "job_topics": f"WITH {_TOP} SELECT * FROM topic",
    "job_summary": f"""WITH {_SUM} SELECT id, industry, education, management, min_experience, district, category,
        "desc", topic_name, topic_category, round(salary, 6) AS salary FROM summ""",
    "category_keywords": f"""WITH {_TOP}, k AS (SELECT topic_category, topic_name, min(first_index) AS o FROM topic GROUP BY 1, 2)
        SELECT topic_category || ': ' || string_agg(topic_name, ', ' ORDER BY o) AS text FROM k GROUP BY topic_category""",
    "label_rate": f"WITH {_ALL_RATE} SELECT topic_category, n, total, round(rate, 6) AS rate, format('{{:,}}', n) || chr(10) || '(' || format('{{:.0f}}', round(100 * rate)) || '%)' AS label_text FROM ar",
    "label_rate_by_segment": f"WITH {_SEG_RATE} SELECT category, topic_category, n, total, round(rate, 6) AS rate FROM sr",
    "label_rate_pivot": f"""WITH {_SEG_RATE} SELECT category,
        round(max(rate) FILTER (topic_category = 'AD/GA'), 6) AS ad_ga,
        round(max(rate) FILTER (topic_category = 'AI/ML'), 6) AS ai_ml,
        round(max(rate) FILTER (topic_category = 'Database/SQL'), 6) AS database_sql FROM sr GROUP BY 1""",
    "rate_units": f"""WITH {_ALL_RATE}, u AS (SELECT topic_category, round(rate, 4) AS r,
          unnest(range(0, CAST(floor(round(rate, 4) / 0.02) AS BIGINT) + 1)) AS pos FROM ar)
        SELECT topic_category, pos, round(CASE WHEN pos < floor(r / 0.02) THEN 0.02
          ELSE r - floor(r / 0.02) * 0.02 END, 6) AS unit FROM u""",
    "category_overlap": f"""WITH {_TOP}, s AS (SELECT DISTINCT id, CASE WHEN topic_category LIKE 'Data%' THEN 'A'
          WHEN topic_category LIKE 'AD%' OR topic_category LIKE 'Report%' THEN 'B' ELSE 'C' END AS g FROM topic),
        r AS (SELECT id, string_agg(g, '&' ORDER BY g) AS region FROM s GROUP BY 1)
        SELECT region, count(*) AS n FROM r GROUP BY 1""",
    "status_overlap": """WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '&' ORDER BY o_orderstatus) AS region
        FROM orders GROUP BY 1) SELECT region, count(*) AS n FROM s GROUP BY 1""",
    "topic_rate_over_rows": f"""WITH {_TOP}, c AS (SELECT topic_category, topic_name, count(DISTINCT id) AS n FROM topic GROUP BY 1, 2),
        t AS (SELECT topic_category, count(*) AS total FROM topic GROUP BY 1)
        SELECT topic_category, topic_name, n, total, round(n * 1.0 / total, 6) AS rate FROM c JOIN t USING (topic_category)""",
    "top_topics_per_industry": f"""WITH {_INFO}, c AS (SELECT industry, topic_category, topic_name, count(DISTINCT id) AS n
          FROM topic JOIN info USING (id) GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, topic_name) AS rank FROM c QUALIFY rank <= 5""",
    "topic_indicators": f"WITH {_TOP}, l AS (SELECT DISTINCT id, {_SNAKE} AS k FROM topic) SELECT id, "
    + ", ".join(f"bool_or(k = '{v}') AS tc_{v}" for v in _LABELS)
    + " FROM l GROUP BY 1",
    "salary_profile": f"""WITH {_FLAGS}, p AS ({_PROF}) SELECT "group", name, count(*) AS n, round(avg(salary), 6) AS mean,
        round(quantile_cont(salary, 0.25), 6) AS q25, round(quantile_cont(salary, 0.5), 6) AS q50,
        round(quantile_cont(salary, 0.75), 6) AS q75 FROM p GROUP BY 1, 2""",
    "median_pivot": f"WITH {_SUM} SELECT category, "
    + ", ".join(
        f"round(quantile_cont(salary, 0.5) FILTER (min_experience = '{e}'), 6) AS {n}, "
        f"'NT$' || format('{{:,.1f}}', quantile_cont(salary, 0.5) FILTER (min_experience = '{e}') * 0.001) || 'K' AS {n}_text"
        for e, n in (("0", "y0"), ("1~2", "y1"), ("3~4", "y3"), ("5+", "y5"))
    )
    + " FROM summ WHERE salary IS NOT NULL AND category IS NOT NULL GROUP BY 1",
}
