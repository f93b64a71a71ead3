"""Lookups, memberships, rankings, shares and profiles over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles, relational
from ..operators.skew import attach
from .tables import longs, r6, rounded, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _orders(spark, d):
    """Orders with their customer's columns."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    return attach(o.withColumnRenamed("o_custkey", "c_custkey"), c, ["c_custkey"], "inner")


def inner_join(spark, d):
    o = _orders(spark, d)
    return rounded(
        o.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total"
    ).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def full_join(spark, d):
    """Orders per customer and segment on both sides of a full join; keys are shifted, so both have unmatched ones."""
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") + 7).alias("key")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return n.join(c, "key", "full_outer")


def first_match_lookup(spark, d):
    """Name of the first customer of the next nation on each supplier; the last one's next gives null."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("nation"))
    c = table(spark, d, "customer")
    return relational.lookup(s, c, "nation", "c_name", "c_nationkey", "c_custkey", "first_customer").select(
        "s_suppkey", "first_customer"
    )


def two_hop_lookup(spark, d):
    """Region name of the next nation; the last one has none."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("nk"))
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    one = relational.lookup(c, n, "nk", "n_regionkey", "n_nationkey", "n_nationkey", "rk")
    two = relational.lookup(one, r, "rk", "r_name", "r_regionkey", "r_regionkey", "region")
    return two.select("c_custkey", "region")


def matching_customers(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.keep_matching(table(spark, d, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


def unmatched_customers(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.drop_matching(table(spark, d, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


def dense_grid(spark, d):
    p = table(spark, d, "part")
    n = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return relational.densify(n, ["p_brand"], "p_type", [*PART_TYPES, "NONE"], ["n"])


def status_pivot(spark, d):
    o = _orders(spark, d)
    wide = o.groupBy("c_mktsegment").pivot("o_orderstatus", STATUSES).agg(F.count(F.lit(1)))
    return relational.map_columns(wide, STATUSES, lambda c: F.coalesce(c, F.lit(0)))


def pivot_round_trip(spark, d):
    return status_pivot(spark, d).unpivot(["c_mktsegment"], STATUSES, "o_orderstatus", "n")


def lumped_brands(spark, d):
    p = table(spark, d, "part")
    return relational.lump_n(p, "p_brand", 5, name="brand").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


def top_brands_per_type(spark, d):
    n = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return longs(relational.top_k(n, ["p_type"], [F.desc("n"), F.asc("p_brand")], 5), "rank")


def top_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


def first_names(spark, d):
    return table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(17)


def share_within(spark, d):
    n = _orders(spark, d).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rounded(relational.share_of(n, ["c_mktsegment"], "n"), "share")


def share_overall(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rounded(relational.share_of(n, [], "n"), "share")


def brand_order(spark, d):
    return relational.category_order(table(spark, d, "part"), "p_brand", F.count(F.lit(1)))


def brand_order_by_price(spark, d):
    p = table(spark, d, "part")
    return relational.category_order(p, "p_brand", F.max("p_retailprice"), descending=False)


def rows_with_group_total(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    out = relational.with_total(li, ["l_suppkey"], F.lit(1), "supplier_lines")
    return out.groupBy("l_orderkey").agg(
        F.sum("supplier_lines").alias("s"), F.max("supplier_lines").alias("m")
    )


def order_with_customer_mean(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = relational.group_stat(o, ["o_custkey"], F.avg("o_totalprice"), "mean")
    return rounded(out.select("o_orderkey", (F.col("o_totalprice") - F.col("mean")).alias("above_mean")), "above_mean")


def days_from_first_order(spark, d):
    from ..operators.sessions import offset_from_start

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"))
    return offset_from_start(o, ["o_custkey"], "day", "offset").select("o_orderkey", "offset")


def scaled_balance(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    both = relational.scaled(relational.scaled(c, "c_acctbal", "unit"), "c_acctbal", "signed", signed=True)
    return rounded(both.select("c_custkey", "unit", "signed"), "unit", "signed")


def distinct_per_group(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")
    )


def last_and_first(spark, d):
    o = table(spark, d, "orders")
    when = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.min_by("o_orderstatus", when).alias("first_status"),
        F.max_by("o_orderstatus", when).alias("last_status"),
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
    )


def customer_status_list(spark, d):
    """Statuses of a customer's orders in order, as JSON text."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    lists = relational.ordered_lists(o, ["o_custkey"], ["o_orderkey"], "o_orderstatus", "v")
    return lists.select("o_custkey", F.to_json(F.array("v")).alias("statuses"))


def status_set(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()
    s = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("v"))  # three levels at most
    return s.select("o_custkey", F.concat_ws(", ", "v").alias("statuses"))


def price_quantiles(spark, d):
    q = profiles.quantile_summary(_orders(spark, d), ["c_mktsegment", "o_orderpriority"], "o_totalprice")
    return rounded(q, "mean", "q25", "q50", "q75")


def price_profile_by_each(spark, d):
    dims = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]
    q = profiles.profile_by_each(_orders(spark, d), dims, "o_totalprice")
    return rounded(q, "mean", "q25", "q50", "q75")


def price_macro_mean(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    return rounded(profiles.macro_mean(o, "month", ["o_totalprice"]), "o_totalprice")


def summary_numeric(spark, d):
    t = profiles.table_one_numeric(_orders(spark, d), ["o_totalprice", "c_acctbal"], "o_orderstatus")
    return longs(rounded(profiles.with_p_value(t, "f_stat", "df1", "df2"), "mean", "sd", "f_stat", "p"), "df1", "df2")


def summary_categorical(spark, d):
    t = profiles.table_one_categorical(_orders(spark, d), ["c_mktsegment", "o_orderpriority"], "o_orderstatus")
    return longs(rounded(profiles.with_p_value(t, "chi2", "df"), "percent", "chi2", "p"), "df")


def name_sets(spark, d):
    """Union, intersection and difference of two name lists."""
    a = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), F.col("k").cast("long").alias("k"))
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "both")).union(tag(a.subtract(b), "only"))


def stacked_tables(spark, d):
    """Two tables with different columns stacked, missing cells null."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


def row_numbers(spark, d):
    from ..operators.skew import numbered

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return numbered(o, [F.desc("o_totalprice"), "o_orderkey"], "rn").select("o_orderkey", "rn")


def scalar_math(spark, d):
    """Logarithm, rounding, floor division and modulo, and shifted values below zero."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        r6(F.ln("o_totalprice")).alias("log_price"),
        r6(F.abs(F.col("o_totalprice") - 250000)).alias("far"),
        F.floor((k - 20) / 50).cast("long").alias("bucket"),
        F.pmod(k - 20, F.lit(50)).cast("long").alias("rest"),
        r6(F.exp(F.col("o_totalprice") / 1e6)).alias("grown"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        inner_join, full_join, first_match_lookup, two_hop_lookup, matching_customers, unmatched_customers,
        dense_grid, status_pivot, pivot_round_trip, lumped_brands, top_brands_per_type, top_orders, first_names,
        share_within, share_overall, brand_order, brand_order_by_price, rows_with_group_total,
        order_with_customer_mean, days_from_first_order, scaled_balance, distinct_per_group, last_and_first,
        customer_status_list, status_set, price_quantiles, price_profile_by_each, price_macro_mean,
        summary_numeric, summary_categorical, name_sets, stacked_tables, row_numbers, scalar_math,
    )
}

_OC = "oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


def _profile_sql(group: str, rows: str) -> str:
    return f"""SELECT {group}, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS q25,
        round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM ({rows}) GROUP BY {group}"""


SQL = {
    "inner_join": f"""WITH {_OC} SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n,
        round(sum(o_totalprice), 6) AS total FROM oc GROUP BY 1""",
    "full_join": """SELECT coalesce(o.k, c.c_custkey) AS key, n_orders, c_mktsegment FROM
        (SELECT o_custkey + 7 AS k, count(*) AS n_orders FROM orders GROUP BY 1) o
        FULL JOIN customer c ON o.k = c.c_custkey""",
    "first_match_lookup": """SELECT s_suppkey, (SELECT arg_min(c_name, c_custkey) FROM customer
        WHERE c_nationkey = s_nationkey + 1) AS first_customer FROM supplier""",
    "two_hop_lookup": """SELECT c_custkey, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey + 1 = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "matching_customers": """SELECT c_custkey, c_name FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
    "unmatched_customers": """SELECT c_custkey, c_name FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
    "dense_grid": """SELECT b.p_brand, t.p_type, count(p_partkey) AS n
        FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN
        (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'NONE']) AS p_type) t
        LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_type = t.p_type GROUP BY 1, 2""",
    "status_pivot": f"""WITH {_OC} SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS F,
        count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM oc GROUP BY 1""",
    "pivot_round_trip": f"WITH {_OC} SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM oc GROUP BY 1, 2",
    "lumped_brands": """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
        r AS (SELECT p_brand, rank() OVER (ORDER BY n DESC) AS k FROM c)
        SELECT CASE WHEN k <= 5 THEN p_brand ELSE 'Other' END AS brand, count(*) AS n
        FROM part JOIN r USING (p_brand) GROUP BY 1""",
    "top_brands_per_type": """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
        SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM c
        QUALIFY rank <= 5""",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "first_names": "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 17",
    "share_within": f"""WITH {_OC}, c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM oc GROUP BY 1, 2)
        SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share FROM c""",
    "share_overall": """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
        SELECT *, round(n * 1.0 / sum(n) OVER (), 6) AS share FROM c""",
    "brand_order": """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
        SELECT p_brand, row_number() OVER (ORDER BY n DESC, p_brand) AS position FROM c""",
    "brand_order_by_price": """WITH c AS (SELECT p_brand, max(p_retailprice) AS n FROM part GROUP BY 1)
        SELECT p_brand, row_number() OVER (ORDER BY n, p_brand) AS position FROM c""",
    "rows_with_group_total": """WITH t AS (SELECT l_orderkey, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
        SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS s, max(c) AS m FROM t GROUP BY 1""",
    "order_with_customer_mean": """SELECT o_orderkey,
        round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS above_mean FROM orders""",
    "days_from_first_order": """SELECT o_orderkey, date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate)
        AS "offset" FROM orders""",
    "scaled_balance": """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
        SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS unit,
               round((c_acctbal - lo) / (hi - lo) * 2 - 1, 6) AS signed FROM customer, e""",
    "distinct_per_group": """SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers,
        count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2""",
    "last_and_first": """SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status,
        arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status, min(o_totalprice) AS low,
        max(o_totalprice) AS high FROM orders GROUP BY 1""",
    "customer_status_list": """SELECT o_custkey,
        '[[' || string_agg('"' || o_orderstatus || '"', ',' ORDER BY o_orderkey) || ']]' AS statuses
        FROM orders GROUP BY 1""",
    "status_set": """SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses
        FROM orders GROUP BY 1""",
    "price_quantiles": f"WITH {_OC} "
    + _profile_sql("c_mktsegment, o_orderpriority", "SELECT *, o_totalprice AS x FROM oc"),
    "price_profile_by_each": f"WITH {_OC} "
    + _profile_sql(
        '"class", type',
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"class\", {c} AS type, o_totalprice AS x FROM oc"
            for c in ("c_mktsegment", "o_orderpriority", "o_orderstatus")
        ),
    ),
    "price_macro_mean": """SELECT round(avg(m), 6) AS o_totalprice FROM
        (SELECT month(o_orderdate), avg(o_totalprice) AS m FROM orders GROUP BY 1)""",
    "summary_numeric": f"""WITH {_OC}, l AS (
          SELECT 'o_totalprice' AS variable, o_orderstatus, o_totalprice AS x FROM oc
          UNION ALL SELECT 'c_acctbal', o_orderstatus, c_acctbal FROM oc),
        g AS (SELECT variable, o_orderstatus, count(*) AS n, avg(x) AS mean, var_samp(x) AS v FROM l GROUP BY 1, 2),
        a AS (SELECT variable, avg(x) AS gm, count(*) AS nn FROM l GROUP BY 1),
        f AS (SELECT variable, count(*) AS k, max(nn) AS nn, sum(n * (mean - gm) * (mean - gm)) AS sb, sum((n - 1) * v) AS sw
              FROM g JOIN a USING (variable) GROUP BY 1)
        SELECT variable, o_orderstatus, n, round(mean, 6) AS mean, round(sqrt(v), 6) AS sd,
          round((sb / (k - 1)) / (sw / (nn - k)), 6) AS f_stat, k - 1 AS df1, nn - k AS df2,
          round(pow(1 + 2 * (sb / (k - 1)) / (sw / (nn - k)) / (nn - k), -(nn - k) / 2.0), 6) AS p
        FROM g JOIN f USING (variable)""",
    "summary_categorical": f"""WITH {_OC}, l AS (
          SELECT 'c_mktsegment' AS variable, c_mktsegment AS level, o_orderstatus AS s FROM oc
          UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderstatus FROM oc),
        r AS (SELECT variable, level, count(*) AS r FROM l GROUP BY 1, 2), k AS (SELECT variable, s, count(*) AS k FROM l GROUP BY 1, 2),
        g AS (SELECT variable, level, s, r * 1.0 * k / sum(r) OVER (PARTITION BY variable, s) AS ex, k FROM r JOIN k USING (variable)),
        c AS (SELECT variable, level, s, count(*) AS n FROM l GROUP BY 1, 2, 3),
        e AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (variable, level, s)),
        t AS (SELECT variable, sum((n - ex) * (n - ex) / ex) AS chi2,
                (count(DISTINCT level) - 1) * (count(DISTINCT s) - 1) AS df FROM e GROUP BY 1),
        p AS (SELECT variable, sum(exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1))) AS p
              FROM (SELECT *, unnest(range(0, CAST(df // 2 AS BIGINT))) AS i FROM t) GROUP BY 1)
        SELECT variable, level, s AS o_orderstatus, n, round(n * 100.0 / k, 6) AS percent, round(chi2, 6) AS chi2,
          CAST(df AS BIGINT) AS df, round(p, 6) AS p FROM e JOIN t USING (variable) JOIN p USING (variable) WHERE n > 0""",
    "name_sets": """WITH a AS (SELECT DISTINCT CAST(c_custkey * 2 AS BIGINT) AS k FROM customer),
        b AS (SELECT DISTINCT CAST(s_suppkey * 3 AS BIGINT) AS k FROM supplier)
        SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
        UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
        UNION ALL SELECT 'only', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
    "stacked_tables": """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "scalar_math": """SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price, round(abs(o_totalprice - 250000), 6) AS far,
        CAST(floor((o_orderkey - 20) / 50) AS BIGINT) AS bucket, ((o_orderkey - 20) % 50 + 50) % 50 AS rest,
        round(exp(o_totalprice / 1e6), 6) AS grown FROM orders""",
}
