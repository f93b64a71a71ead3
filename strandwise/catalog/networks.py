"""Term graphs (orders as documents, suppliers as terms), free-text hits and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, hits
from ..operators.skew import attach, cut_lineage, dealt
from ..plans import chapters
from .tables import r6, rounded, table


def _hits(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("term"))
    return dealt(rows, ["doc_id"]).distinct()


def _n_docs(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1))).scalar()


def term_hits(spark, d):
    """Benchmark words of two or more characters found anywhere in document texts."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("term")).distinct()
    found = hits.term_hits(table(spark, d, "documents"), "doc_id", "text", words.where(F.char_length("term") > 1))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("doc_sum"))


def doc_freq(spark, d):
    return rounded(hits.doc_freq(_hits(spark, d)), "log_docs")


def cooccurrence(spark, d):
    return hits.cooccurrence(_hits(spark, d))


def pair_mean(spark, d):
    """Mean order price over the orders that hold both suppliers."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("price"))
    out = hits.cooccurrence(attach(_hits(spark, d), o, ["doc_id"], "inner"), "price")
    return rounded(out, "mean_price")


def term_correlation(spark, d):
    return rounded(hits.term_correlation(_hits(spark, d), _n_docs(spark, d)), "r")


def _graph(spark, d):
    """Correlation edges between suppliers of at least 100 orders, weak ones dropped."""
    kept = hits.frequent_only(_hits(spark, d), 100)
    corr = hits.term_correlation(kept, _n_docs(spark, d))
    edges = corr.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("r").alias("weight"))
    return graphs.filter_edges(edges, 0.01)


def correlation_graph(spark, d):
    return rounded(graphs.simplify_edges(graphs.filter_vertices(_graph(spark, d), 2)), "weight")


def _count_edges(spark, d):
    co = hits.cooccurrence(_hits(spark, d))
    return co.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def median_edges(spark, d):
    return graphs.filter_edges_quantile(_count_edges(spark, d), 0.5)


def degree_filter(spark, d):
    return graphs.filter_vertices(graphs.filter_edges_quantile(_count_edges(spark, d), 0.95), 5)


def vertex_degree(spark, d):
    return graphs.degree(graphs.filter_edges_quantile(_count_edges(spark, d), 0.95))


def simple_edges(spark, d):
    """Loops and parallel edges merged: suppliers against part numbers as one id space."""
    li = table(spark, d, "lineitem")
    raw = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1).alias("weight"))
    return graphs.simplify_edges(raw)


def _communities(spark, d):
    edges = cut_lineage(graphs.filter_edges_quantile(_count_edges(spark, d), 0.9))
    return edges, graphs.communities(edges)


def communities(spark, d):
    return _communities(spark, d)[1]


def community_modularity(spark, d):
    edges, groups = _communities(spark, d)
    return graphs.modularity(edges, groups)


def region_modularity(spark, d):
    """Modularity of grouping suppliers by region on the co-occurrence graph."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    groups = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("n_regionkey").alias("community"))
    return rounded(graphs.modularity(_count_edges(spark, d), groups), "modularity")


def node_table(spark, d):
    edges = graphs.filter_edges_quantile(_count_edges(spark, d), 0.9)
    sizes = hits.doc_freq(_hits(spark, d)).select(F.col("term").alias("id"), F.col("n_docs").alias("size"))
    s = table(spark, d, "supplier")
    groups = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("long").alias("community"))
    return graphs.node_table(edges, sizes, groups)


def link_table(spark, d):
    """Edges with an attribute joined on and weights scaled to [0, 1]."""
    from ..operators.relational import scaled

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("price"))
    edges = cut_lineage(hits.cooccurrence(attach(_hits(spark, d), o, ["doc_id"], "inner"), "price"))
    return rounded(scaled(edges, "weight", "width").select("a", "b", "width", "mean_price"), "width", "mean_price")


def pair_evidence(spark, d):
    """Order notes of the five supplier pairs that meet most often."""
    o = table(spark, d, "orders")
    notes = o.select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("note"))
    return hits.pair_evidence(_hits(spark, d), notes, "o_orderkey", "note", 5)


def _segment(spark, d):
    """Orders up to the first change of the mean daily price, and their suppliers that are in credit."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    o = table(spark, d, "orders").withColumns({"day": day, "all_rows": F.lit(1), "sure": F.col("o_orderstatus") == "F"})
    o = o.withColumn("note", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    daily = o.groupBy("all_rows", "day").agg(F.avg("o_totalprice").alias("price"))
    end = chapters.first_segment_end(daily, "all_rows", "day", "price", q=1, penalty=-1e9)
    people = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("term"))
    last = end.select("last_chapter").scalar()
    return chapters.segment_terms(_hits(spark, d), o, "o_orderkey", "day", last, F.col("sure"), people)


def segment_terms(spark, d):
    """Orders of the first segment that hold each of its suppliers."""
    return hits.doc_freq(cut_lineage(_segment(spark, d)[1])).select("term", "n_docs")


def segment_evidence(spark, d):
    """The completed orders of the first segment behind its five heaviest pairs, row by row."""
    chosen, found = _segment(spark, d)
    return hits.pair_evidence(cut_lineage(found), chosen, "o_orderkey", "note", 5, F.col("sure"))


def segment_evidence_text(spark, d):
    """The same evidence as one string a pair."""
    return hits.evidence_texts(cut_lineage(segment_evidence(spark, d)))


def _tree(spark, d):
    """A binary tree over part numbers: node k has children 2k and 2k + 1."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") + 1
    size = p.agg(F.count(F.lit(1))).scalar()
    return p.select(
        k.alias("parent"), (k * 2).alias("left"), (k * 2 + 1).alias("right"), F.col("p_retailprice").alias("distance"),
        F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("]")).alias("topics"),
    ).where(F.col("right") <= size)


def hierarchy_edges(spark, d):
    return graphs.hierarchy_edges(_tree(spark, d), "parent", "left", "right")


def region_edges(spark, d):
    """Regions, nations and customers as one parent-child edge list."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("target"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("source"), F.concat(F.lit("c"), F.col("c_custkey")).alias("target"))
    r = table(spark, d, "region").select(F.lit("root").alias("source"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("target"))
    return r.union(n).union(c)


def region_depth(spark, d):
    out = graphs.depth_from(region_edges(spark, d), F.lit("root"))
    return out.withColumn("depth", F.col("depth").cast("long"))


def hierarchy_depth(spark, d):
    out = graphs.depth_from(hierarchy_edges(spark, d), F.lit(1))
    return out.withColumn("depth", F.col("depth").cast("long"))


def _members(spark, d, depth=4):
    depths = graphs.depth_from(hierarchy_edges(spark, d), F.lit(1), max_depth=depth)
    return graphs.members_at_depth(_tree(spark, d), depths, "parent", "topics", depth)


def words_at_depth(spark, d):
    p = table(spark, d, "part")
    words = p.groupBy(F.col("p_size").cast("long").alias("topic_id")).agg(F.min("p_name").alias("w"))
    words = words.select("topic_id", F.concat("w", F.lit(" - "), F.col("topic_id").cast("string")).alias("top_words"))
    return graphs.words_at_depth(_members(spark, d), words)


def topic_share(spark, d):
    """Cluster shares per run of 50 part numbers."""
    docs = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("chapter"), F.col("p_size").cast("long").alias("topic"))
    return rounded(graphs.topic_share(docs, cut_lineage(_members(spark, d)), "chapter", "topic", 50), "share")


def topic_share_bands(spark, d):
    """Cluster shares per part, filled with zeros, and the band of 437 parts it belongs to."""
    lines = table(spark, d, "lineitem")
    docs = lines.select((F.col("l_partkey") + 1).alias("chapter"), F.col("l_quantity").cast("long").alias("topic"))
    return rounded(graphs.dense_topic_share(docs, cut_lineage(_members(spark, d)), "chapter", "topic", 437), "share")


def hierarchy_layout(spark, d):
    out = graphs.hierarchy_layout(_tree(spark, d), "parent", "left", "right", "distance")
    return rounded(out, "x", "xend", "y", "yend")


QUERIES = {
    f.__name__: f
    for f in (
        term_hits, doc_freq, cooccurrence, pair_mean, term_correlation, correlation_graph, median_edges, degree_filter,
        vertex_degree, simple_edges, communities, community_modularity, region_modularity, node_table, link_table,
        pair_evidence, segment_terms, segment_evidence, segment_evidence_text, hierarchy_edges, region_edges, region_depth, hierarchy_depth, words_at_depth, topic_share,
        topic_share_bands,
        hierarchy_layout,
    )
}

_HITS = "hits AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_suppkey AS VARCHAR) AS term FROM lineitem)"
_CO = (
    _HITS
    + """, co AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM hits x JOIN hits y
  ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2)"""
)
_DF = "df AS (SELECT term, count(*) AS n FROM hits GROUP BY 1)"
_CORR = f"""{_CO}, {_DF}, nn AS (SELECT count(*) * 1.0 AS nn FROM orders), corr AS (
  SELECT a, b, weight, x.n AS na, y.n AS nb, (nn * weight - x.n * y.n) / nullif(sqrt(x.n * (nn - x.n) * y.n * (nn - y.n)), 0) AS r
  FROM co JOIN df x ON x.term = a JOIN df y ON y.term = b, nn)"""
_COST = "{n} * (ln(2 * pi()) + ln(({s2} - ({s1}) * ({s1}) / ({n})) / ({n})) + 1)"
_SEG = f"""dy AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, avg(o_totalprice) AS price
    FROM orders GROUP BY 1),
  x AS (SELECT day, price - avg(price) OVER () AS v FROM dy),
  rs AS (SELECT day, row_number() OVER w AS n, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2,
    count(*) OVER () AS m, sum(v) OVER () AS t1, sum(v * v) OVER () AS t2 FROM x WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)),
  cp AS (SELECT arg_max(day, {_COST.format(n="m", s1="t1", s2="t2")} - {_COST.format(n="n", s1="s1", s2="s2")}
    - {_COST.format(n="(m - n)", s1="(t1 - s1)", s2="(t2 - s2)")}) AS last FROM rs WHERE n >= 2 AND n <= m - 2),
  ch AS (SELECT o_orderkey, o_orderstatus = 'F' AS sure, o_orderpriority || ' ' || o_orderstatus AS note FROM orders
    WHERE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) <= (SELECT last FROM cp)),
  ah AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_suppkey AS VARCHAR) AS term FROM lineitem JOIN ch ON o_orderkey = l_orderkey),
  kw AS (SELECT DISTINCT term FROM ah JOIN ch ON o_orderkey = doc_id WHERE sure
    AND term IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)),
  hits AS (SELECT doc_id, term FROM ah JOIN kw USING (term)),
  co AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM hits x JOIN hits y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2),
  top AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS rank FROM co ORDER BY rank LIMIT 5),
  ev AS (SELECT rank, a, b, weight, x.doc_id, note AS text FROM top JOIN hits x ON x.term = a JOIN hits y ON y.term = b AND x.doc_id = y.doc_id
    JOIN ch ON o_orderkey = x.doc_id WHERE sure)"""
_MED = "med AS (SELECT * FROM co WHERE weight >= (SELECT quantile_cont(weight, {q}) FROM co))"
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM {t} UNION ALL SELECT b FROM {t}) GROUP BY 1)"
_TREE = """tree AS (SELECT p_partkey + 1 AS parent, 2 * (p_partkey + 1) AS l, 2 * (p_partkey + 1) + 1 AS r, p_retailprice AS h, p_size
  FROM part WHERE 2 * (p_partkey + 1) + 1 <= (SELECT count(*) FROM part))"""
_MEM = (
    _TREE
    + """, mem AS (SELECT DISTINCT parent AS cluster, unnest([p_size, p_size + 1])::BIGINT AS topic_id FROM tree
  WHERE parent BETWEEN 16 AND 31)"""
)
_PRICED = (
    _HITS
    + """, pr AS (SELECT doc_id, term, o_totalprice AS price FROM hits JOIN orders ON o_orderkey = doc_id),
  pc AS (SELECT x.term AS a, y.term AS b, count(*) AS weight, avg(x.price) AS mean_price FROM pr x JOIN pr y
  ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2)"""
)
_REG = """reg AS (SELECT 'root' AS source, 'r' || r_regionkey AS target FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""

SQL = {
    "term_hits": """WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS term FROM benchmark)
        SELECT term, count(*) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS doc_sum FROM documents JOIN w ON contains(text, term)
        WHERE length(term) > 1 GROUP BY 1""",
    "doc_freq": f"WITH {_HITS} SELECT term, count(*) AS n_docs, round(ln(count(*)), 6) AS log_docs FROM hits GROUP BY 1",
    "cooccurrence": f"WITH {_CO} SELECT * FROM co",
    "pair_mean": f"WITH {_PRICED} SELECT a, b, weight, round(mean_price, 6) AS mean_price FROM pc",
    "term_correlation": f"WITH {_CORR} SELECT a, b, weight, round(r, 6) AS r FROM corr",
    "correlation_graph": f"""WITH {_CORR}, e AS (SELECT a, b, r FROM corr WHERE na >= 100 AND nb >= 100 AND r >= 0.01 AND r <> 1),
        {_DEG.format(t="e")} SELECT a AS src, b AS dst, round(r, 6) AS weight FROM e
        JOIN deg x ON x.id = a JOIN deg y ON y.id = b WHERE x.degree >= 2 AND y.degree >= 2""",
    "median_edges": f"WITH {_CO}, {_MED.format(q=0.5)} SELECT a AS src, b AS dst, weight FROM med",
    "degree_filter": f"""WITH {_CO}, {_MED.format(q=0.95)}, {_DEG.format(t="med")} SELECT a AS src, b AS dst, weight FROM med
        JOIN deg x ON x.id = a JOIN deg y ON y.id = b WHERE x.degree >= 5 AND y.degree >= 5""",
    "vertex_degree": f"WITH {_CO}, {_MED.format(q=0.95)}, {_DEG.format(t='med')} SELECT id, degree FROM deg",
    "simple_edges": """SELECT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst,
        count(*) AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2""",
    "region_modularity": f"""WITH {_CO}, g AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, n_regionkey AS c FROM supplier
          JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT sum(weight) AS m FROM co),
        e AS (SELECT x.c AS ca, y.c AS cb, weight FROM co JOIN g x ON x.id = a JOIN g y ON y.id = b),
        i AS (SELECT ca AS c, sum(weight) AS w FROM e WHERE ca = cb GROUP BY 1),
        t AS (SELECT c, sum(weight) AS w FROM (SELECT ca AS c, weight FROM e UNION ALL SELECT cb, weight FROM e) GROUP BY 1)
        SELECT round(sum(coalesce(i.w, 0) / m - (t.w / (2 * m)) * (t.w / (2 * m))), 6) AS modularity
        FROM t LEFT JOIN i ON i.c = t.c, m""",
    "node_table": f"""WITH {_CO}, {_MED.format(q=0.9)}, {_DEG.format(t="med")}, {_DF}
        SELECT id, degree, n AS size, CAST(s_nationkey AS BIGINT) AS community FROM deg JOIN df ON term = id
        JOIN supplier ON CAST(s_suppkey AS VARCHAR) = id""",
    "link_table": f"""WITH {_PRICED} SELECT a, b, round((weight - lo) * 1.0 / (hi - lo), 6) AS width, round(mean_price, 6) AS mean_price
        FROM pc, (SELECT min(weight) AS lo, max(weight) AS hi FROM pc)""",
    "pair_evidence": f"""WITH {_CO}, top AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS rank FROM co
          ORDER BY rank LIMIT 5)
        SELECT rank, a, b, weight, x.doc_id, o_orderpriority || ' ' || o_orderstatus AS text FROM top
        JOIN hits x ON x.term = a JOIN hits y ON y.term = b AND x.doc_id = y.doc_id JOIN orders ON o_orderkey = x.doc_id""",
    "segment_terms": f"WITH {_SEG} SELECT term, count(*) AS n_docs FROM hits GROUP BY 1",
    "segment_evidence": f"WITH {_SEG} SELECT * FROM ev",
    "segment_evidence_text": f"""WITH {_SEG} SELECT rank, a, b, weight, max(n) AS n_texts,
        string_agg(text, chr(10) ORDER BY doc_id, text) FILTER (k <= 1000) AS text
        FROM (SELECT *, count(*) OVER (PARTITION BY rank) AS n, row_number() OVER (PARTITION BY rank ORDER BY doc_id, text) AS k FROM ev) GROUP BY 1, 2, 3, 4""",
    "hierarchy_edges": f"WITH {_TREE} SELECT parent AS source, l AS target FROM tree UNION ALL SELECT parent, r FROM tree",
    "region_edges": f"WITH {_REG} SELECT * FROM reg",
    "region_depth": f"""WITH RECURSIVE {_REG}, walk AS (SELECT 'root' AS id, CAST(0 AS BIGINT) AS depth
        UNION ALL SELECT target, depth + 1 FROM walk JOIN reg ON source = id) SELECT * FROM walk""",
    "hierarchy_depth": f"""WITH RECURSIVE {_TREE}, e AS (SELECT parent, unnest([l, r]) AS child FROM tree),
        walk AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth
        UNION ALL SELECT child, depth + 1 FROM walk JOIN e ON parent = id) SELECT * FROM walk""",
    "words_at_depth": f"""WITH {_MEM}, w AS (SELECT p_size AS topic_id, min(p_name) || ', ' || p_size AS t FROM part GROUP BY 1)
        SELECT cluster, string_agg(t, ', ' ORDER BY t) AS words FROM mem JOIN w USING (topic_id) GROUP BY 1""",
    "topic_share": f"""WITH {_MEM}, d AS (SELECT p_partkey // 50 AS chapter, p_size AS topic_id FROM part),
        j AS (SELECT chapter, coalesce(cluster, -1) AS cluster, count(*) AS n FROM mem FULL JOIN d USING (topic_id) GROUP BY 1, 2)
        SELECT CAST(chapter AS BIGINT) AS chapter, CAST(cluster AS BIGINT) AS cluster, n,
          round(n * 1.0 / sum(n) OVER (PARTITION BY chapter), 6) AS share FROM j""",
    "topic_share_bands": f"""WITH {_MEM}, d AS (SELECT l_partkey + 1 AS chapter, CAST(l_quantity AS BIGINT) AS topic_id FROM lineitem),
        j AS (SELECT chapter, coalesce(cluster, -1) AS cluster, count(*) AS n FROM mem FULL JOIN d USING (topic_id) GROUP BY 1, 2),
        s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY chapter) AS share FROM j),
        g AS (SELECT chapter, cluster FROM (SELECT DISTINCT chapter FROM j WHERE chapter IS NOT NULL), (SELECT DISTINCT cluster FROM j))
        SELECT CAST(chapter AS BIGINT) AS chapter, CAST(cluster AS BIGINT) AS cluster, coalesce(n, 0) AS n,
          round(coalesce(share, 0), 6) AS share, CAST((chapter - 1) // 437 + 1 AS BIGINT) AS band FROM g LEFT JOIN s USING (chapter, cluster)""",
    "hierarchy_layout": f"""WITH RECURSIVE {_TREE}, e AS (SELECT parent, unnest([l, r]) AS child, h FROM tree),
        leaf AS (SELECT child AS id, row_number() OVER (ORDER BY h, child) * 1.0 AS y FROM e
                 WHERE child NOT IN (SELECT parent FROM tree)),
        walk AS (SELECT DISTINCT child AS node, child AS at, CAST(1.0 AS DOUBLE) AS w FROM e
          UNION ALL SELECT 1, 1, 1.0
          UNION ALL SELECT node, child, w / 2 FROM walk JOIN e ON e.parent = walk.at),
        pos AS (SELECT node, sum(w * y) AS y FROM walk JOIN leaf ON leaf.id = walk.at GROUP BY 1)
        SELECT e.child AS p, e.parent AS pend, round(coalesce(t.h, 0), 6) AS x, round(e.h, 6) AS xend,
          round(a.y, 6) AS y, round(b.y, 6) AS yend
        FROM e JOIN pos a ON a.node = e.child JOIN pos b ON b.node = e.parent LEFT JOIN tree t ON t.parent = e.child""",
}
