"""Text cleaning and entity tables over documents, conversations, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..plans import entities
from .tables import longs, table

FENCE = "```"


def list_text(spark, d):
    """List text to clean text, size, first and last element, and back to JSON."""
    p = table(spark, d, "part")
    listed = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    items = text.split_list(listed)
    return p.select(
        "p_partkey",
        text.strip_list(listed).alias("clean"),
        F.size(items).cast("long").alias("n"),
        F.element_at(items, 1).alias("head"),
        F.element_at(items, -1).alias("tail"),
        F.to_json(items).alias("as_json"),
        F.array_join(text.sorted_distinct(items), "|").alias("sorted"),
    )


def snake_names(spark, d):
    p = table(spark, d, "part")
    label = F.concat_ws(" / ", "p_name", "p_brand", "p_type")
    return p.select(
        "p_partkey",
        F.concat(F.lit("tn_"), text.snake_case(label)).alias("snake"),
        text.replace_first(label, " / ", "~").alias("one"),
        F.element_at(text.split_words(F.regexp_replace(label, " / ", " - ")), 2).alias("second"),
        F.element_at(text.split_pair(F.concat_ws("|", "p_name", "p_brand")), 2).alias("right"),
        text.without_spaces(F.col("p_name")).alias("packed"),
        F.char_length("p_name").cast("long").alias("length"),
    )


def json_values(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k long")["k"]
    return e.groupBy("user_id").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def formatted_numbers(spark, d):
    """Grouped thousands and percent text, turned back to numbers."""
    o = table(spark, d, "orders")
    price = text.comma(F.col("o_totalprice"), 0, 1.0, "$")
    return o.select("o_orderkey", F.regexp_replace(price, "[$,]", "").cast("long").alias("price"))


def answer_labels(spark, d):
    """Marked label inside a longer text."""
    p = table(spark, d, "part")
    marked = F.concat(F.lit("x 詞彙："), F.col("p_name"), F.lit("\nmore"))
    answer = F.when(F.col("p_size") > 10, marked).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.labelled_answer(answer, "詞彙：").alias("label"))


def text_characters(spark, d):
    """Documents per character, and whether it is a Latin letter or digit."""
    docs = table(spark, d, "documents")
    chars = docs.select("doc_id", F.explode(F.array_distinct(text.characters(F.lower("text")))).alias("c"))
    out = chars.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return out.select("c", "n", text.has_latin_or_digit(F.col("c")).alias("latin"))


def illegal_characters(spark, d):
    """First characters in sort order over all part names."""
    p = table(spark, d, "part")
    chars = p.select(F.explode(text.characters(F.concat("p_name", "p_brand"))).alias("c")).distinct()
    return chars.orderBy("c").limit(4)


def _turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.split("text", r"\s+").alias("words"))


def _listed(spark, d):
    t = _turns(spark, d)
    kind = F.when(F.col("role") == "user", F.lit("PERSON")).otherwise(F.upper("role"))
    pairs = F.transform(F.filter("words", lambda w: w != ""), lambda w: F.array(w, kind))
    return entities.entities_from_lists(t.select(pairs.alias("ents")), "ents")


def listed_entities(spark, d):
    return _listed(spark, d)


def _fenced(spark, d):
    """Fenced JSON of two lists from part names; those of one part type are broken."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    body = F.to_json(F.array(F.slice(words, 1, 1), F.array(F.col("p_type"), F.element_at(words, 2))))
    good = F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}"))
    return p.select(F.when(F.col("p_type") == "PROMO", F.lit(f"{FENCE}json\n[[\"oops")).otherwise(good).alias("response"))


def json_entities(spark, d):
    return entities.entities_from_json(_fenced(spark, d), "response")


def merged_entities(spark, d):
    both = entities.merged_entities(_listed(spark, d), entities.entities_from_json(_fenced(spark, d), "response"))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


def people(spark, d):
    removable = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    both = entities.merged_entities(_listed(spark, d), entities.entities_from_json(_fenced(spark, d), "response"), illegal=0)
    return entities.people(both, 2, removable)


def entity_counts(spark, d):
    """Words of conversation turns in a Greek spelling as entity names."""
    t = _turns(spark, d)
    name = F.translate("word", "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωάέ")
    kind = F.when(F.col("role") == "user", F.lit("PERSON")).when(F.col("role") == "assistant", F.lit("EVENT"))
    words = t.select("role", F.explode("words").alias("word"))
    return entities.entity_counts(words.select(name.alias("name"), kind.alias("type")))


def frame_entities(spark, d):
    """Nested frames flattened to one table."""
    from ..sources import flatten_frames

    t = _turns(spark, d)
    frames = t.select("conv_id", F.transform("words", lambda w: F.struct(w.alias("name"), F.char_length(w).cast("long").alias("size"))).alias("entities"))
    flat = flatten_frames(frames, "entities", ["conv_id"])
    return longs(flat.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "n")


QUERIES = {
    f.__name__: f
    for f in (
        list_text, snake_names, json_values, formatted_numbers, answer_labels, text_characters, illegal_characters,
        listed_entities, json_entities, merged_entities, people, entity_counts, frame_entities,
    )
}

_WORDS = """wrd AS (SELECT conv_id, role, unnest(string_split_regex(text, '\\s+')) AS word FROM conversations)"""
_ENT = (
    _WORDS
    + """, listed AS (SELECT DISTINCT replace(word, ' ', '') AS term, CASE role WHEN 'user' THEN 'PERSON' ELSE upper(role) END AS type
  FROM wrd WHERE word <> ''), good AS (SELECT string_split(p_name, ' ') AS w, p_type FROM part WHERE p_type <> 'PROMO'),
  js AS (SELECT DISTINCT w[1] AS term, 'PERSON' AS type FROM good UNION SELECT p_type, 'LOC' FROM good UNION SELECT w[2], 'LOC' FROM good),
  both_ AS (SELECT * FROM listed UNION SELECT * FROM js)"""
)

SQL = {
    "list_text": """WITH s AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)
        SELECT p_partkey, replace(p_name, ' ', ', ') AS clean, len(w) AS n, w[1] AS head, w[-1] AS tail,
          '["' || array_to_string(w, '","') || '"]' AS as_json, array_to_string(list_sort(list_distinct(w)), '|') AS sorted FROM s""",
    "snake_names": """SELECT p_partkey, 'tn_' || lower(regexp_replace(p_name || '_' || p_brand || '_' || p_type, '[^A-Za-z0-9]+', '_', 'g')) AS snake,
        p_name || '~' || p_brand || ' / ' || p_type AS one, p_brand AS second, p_brand AS "right",
        replace(p_name, ' ', '') AS packed, length(p_name) AS length FROM part""",
    "json_values": """SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
        max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1""",
    "formatted_numbers": "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS price FROM orders",
    "answer_labels": "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS label FROM part",
    "text_characters": """WITH c AS (SELECT unnest(list_distinct(string_split(lower(text), ''))) AS c FROM documents)
        SELECT c, count(*) AS n, regexp_matches(c, '[a-z]|[0-9]') AS latin FROM c WHERE c <> '' GROUP BY 1""",
    "illegal_characters": """SELECT DISTINCT c FROM (SELECT unnest(string_split(p_name || p_brand, '')) AS c FROM part)
        ORDER BY c LIMIT 4""",
    "listed_entities": f"WITH {_ENT} SELECT * FROM listed",
    "json_entities": f"WITH {_ENT} SELECT * FROM js",
    "merged_entities": f"""WITH {_ENT}, ch AS (SELECT DISTINCT unnest(string_split(term, '')) AS c FROM both_),
        bad AS (SELECT c FROM ch ORDER BY c LIMIT 4)
        SELECT type, count(*) AS n, min(term) AS first, max(term) AS last FROM both_
        WHERE NOT EXISTS (SELECT 1 FROM bad WHERE contains(term, c)) GROUP BY 1""",
    "people": f"""WITH {_ENT} SELECT DISTINCT term AS name FROM both_ WHERE type = 'PERSON' AND length(term) >= 2
        AND term NOT IN (SELECT string_split(p_name, ' ')[1] FROM part)""",
    "entity_counts": f"""WITH {_WORDS}, n AS (SELECT translate(word, 'abcdefghijklmnopqrstuvwxyz', 'αβγδεζηθικλμνξοπρστυφχψωάέ') AS name
        FROM wrd WHERE role IN ('user', 'assistant'))
        SELECT name, count(*) AS n FROM n WHERE length(name) > 1 AND NOT regexp_matches(lower(name), '[a-z]|[0-9]') GROUP BY 1""",
    "frame_entities": f"WITH {_WORDS} SELECT conv_id, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS size FROM wrd GROUP BY 1",
}
