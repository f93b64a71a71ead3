"""Job and responsibility tables: dimension table, topic table, summary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from ..operators.skew import attach

# Topic ids per responsibility category.
TOPIC_CATEGORIES = {
    "AI/ML": [9, 15, 18],
    "Computer Vision\nDeep Learning": [10, 12, 19],
    "Database/SQL": [1, 24],
    "Data Project\nETL": [0, 2, 3, 5, 8, 11, 14, 20, 21, 22],
    "AD/GA": [16, 23, 25],
    "Report/Business\nVisualization": [4, 6, 7, 13, 17],
}

# Sector names.
SECTOR_NAMES = {
    "健康醫療社會福利政府機構": "Healthcare and Social Welfare",
    "專業服務": "Professional Services",
    "廣告出版新聞媒體": "Advertising, Publishing, and Media",
    "服務批發零售通路餐旅運輸": "Service, Wholesale, Retail, and Transportation",
    "製造業": "Manufacturing",
    "資通訊軟體業科技": "Information and Communication Technology",
    "金融保險": "Finance and Insurance",
}

# Districts that keep their own level.
DISTRICT_NAMES = {
    "台北市中山區": "Zhongshan",
    "台北市中正區": "Zhongzheng",
    "台北市信義區": "Xinyi",
    "台北市內湖區": "Neihu",
    "台北市南港區": "Nanngang",
    "台北市大安區": "Daan",
    "台北市松山區": "Songshan",
    "Others": "Others",
}

# Responsibility categories merged to three sets.
CATEGORY_SETS = {
    "Database/SQL": "A",
    "Data Project\nETL": "A",
    "AD/GA": "B",
    "Report/Business\nVisualization": "B",
    "Computer Vision\nDeep Learning": "C",
    "AI/ML": "C",
}

YEARLY = "年薪"


def topic_map(spark: SparkSession) -> DataFrame:
    """Constant topic to category table (26 rows)."""
    rows = [(i, name) for name, ids in TOPIC_CATEGORIES.items() for i in ids]
    return spark.createDataFrame(sorted(rows), "topic_id long, topic_category string")


def job_topics(topics: DataFrame) -> DataFrame:
    """Distinct (id, desc, topic_name, topic_category), topic -1 left out.

    ``first_index`` keeps the first appearance, which orders lists later on.
    """
    named = topics.where(F.col("topic_id") != -1).select(
        "id", "index", "desc", "topic_id", text.strip_list(F.col("openai")).alias("topic_name")
    )
    mapped = named.join(F.broadcast(topic_map(topics.sparkSession)), "topic_id", "left")  # 26 rows
    return mapped.groupBy("id", "desc", "topic_name", "topic_category").agg(F.min("index").alias("first_index"))


def job_info(infos: DataFrame, topics: DataFrame, categories: DataFrame, industries: dict[str, str]) -> DataFrame:
    """One cleaned row per job that has topic segments.

    ``industries`` maps an industry to its sector; an unknown industry or sector
    gives null. Repeated category rows: the first in ``row`` order wins.
    """
    kept = relational.keep_matching(infos, topics, ["id"])
    sectors = {i: SECTOR_NAMES[s] for i, s in industries.items() if s in SECTOR_NAMES}
    district = relational.others(F.col("region"), list(DISTRICT_NAMES))
    out = kept.select(
        "id",
        relational.recode(F.col("industry"), sectors).alias("industry"),
        "education",
        "management",
        relational.experience_bin(F.col("experience")).alias("min_experience"),
        relational.recode(district, DISTRICT_NAMES).alias("district"),
    )
    return relational.lookup(out, categories, "id", "category", "id", "row", "category")


def monthly_salary(low: Column, label: Column) -> Column:
    """0 means unknown; yearly pay becomes monthly."""
    return F.when(low == 0, F.lit(None).cast("double")).otherwise(F.when(label.contains(YEARLY), low / 12).otherwise(low))


def job_summary(info: DataFrame, topic: DataFrame, salaries: DataFrame) -> DataFrame:
    """One row per job with its first description, topic lists as JSON text, and salary."""
    first = topic.groupBy("id").agg(F.min_by("desc", "first_index").alias("desc"))
    pair = topic.select("id", "first_index", "topic_name", F.struct("topic_name", "topic_category").alias("_p"))
    lists = relational.ordered_lists(pair, ["id"], ["first_index", "topic_name"], "_p", "_l")
    lists = lists.select(
        "id",
        F.to_json(F.array(F.transform("_l", lambda p: p["topic_name"]))).alias("topic_name"),
        F.to_json(F.array(F.transform("_l", lambda p: p["topic_category"]))).alias("topic_category"),
    )
    return info.join(first, "id").join(lists, "id").join(_pay(salaries), "id")


def _pay(salaries: DataFrame) -> DataFrame:
    return salaries.select("id", monthly_salary(F.col("salary_min"), F.col("salary")).alias("salary"))


def job_pay(info: DataFrame, topic: DataFrame, salaries: DataFrame) -> DataFrame:
    """One row per job that has topics, with its salary: what profiles are counted from."""
    return relational.keep_matching(info, topic, ["id"]).join(_pay(salaries), "id")


def job_labels(topic: DataFrame, column: str) -> DataFrame:
    """Distinct (id, label) with labels cleaned as in the list text of a job."""
    one = F.to_json(F.array(F.array(F.col(column))))
    return topic.select("id", F.explode(text.label_items(one)).alias("label")).distinct()


def category_overlap(info: DataFrame, topic: DataFrame) -> DataFrame:
    """Jobs per region of the three merged category sets."""
    tagged = attach(topic.select("id", "topic_category"), info.select("id"), ["id"], "inner")
    tagged = tagged.withColumn("set", relational.recode(F.col("topic_category"), CATEGORY_SETS))
    return relational.overlap_regions(tagged, "id", "set", ["A", "B", "C"])


def category_keywords(topic: DataFrame) -> DataFrame:
    """Distinct topic names of a category as one text (names come from a fixed topic model)."""
    names = topic.groupBy("topic_category", "topic_name").agg(F.min("first_index").alias("_o"))
    lists = names.groupBy("topic_category").agg(F.array_sort(F.collect_list(F.struct("_o", "topic_name"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda s: s["topic_name"]), ", ")
    return lists.select(F.concat("topic_category", F.lit(": "), joined).alias("text"))


def salary_profile(data: DataFrame, dims: list[str], flags: dict[str, tuple[str, str]]) -> DataFrame:
    """Salary profile by each dimension and each indicator, with report labels.

    ``flags`` maps an indicator column to its (group, label); only its true rows
    are kept. Empty education reads ``None`` and management reads Yes or No.
    """
    from ..operators.profiles import profile_by_each

    stacked = profile_by_each(data, [*dims, *flags], "salary")
    is_flag = F.col("class").isin(*flags) if flags else F.lit(False)
    group = relational.recode(F.col("class"), {c: g for c, (g, _) in flags.items()}, F.col("class"))
    label = relational.recode(F.col("class"), {c: n for c, (_, n) in flags.items()}, F.col("type"))
    name = (
        F.when((F.col("class") == "education") & (F.col("type") == ""), F.lit("None"))
        .when((F.col("class") == "management") & (F.col("type") == "false"), F.lit("No"))
        .when((F.col("class") == "management") & (F.col("type") == "true"), F.lit("Yes"))
        .otherwise(label)
    )
    kept = stacked.where(~is_flag | (F.col("type") == "true"))
    return kept.select(
        group.alias("group"), text.replace_first(name, "\\n", "/").alias("name"), "n", "mean", "q25", "q50", "q75"
    )
