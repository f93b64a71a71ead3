"""Entity cleaning: recognised lists, model-written JSON, merging, counting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.relational import drop_matching

# Entity types that are kept.
ENTITY_TYPES = ["EVENT", "PERSON", "CONSUMER_GOOD", "LOCATION", "ORGANIZATION", "OTHER"]


def entities_from_lists(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Lists of [term, type] to distinct rows, spaces removed from terms."""
    pair = df.select(*(keys or []), F.explode(col).alias("_e")).where(F.size("_e") > 1)
    term = text.without_spaces(F.col("_e")[0])
    return pair.select(*(keys or []), term.alias("term"), F.col("_e")[1].alias("type")).distinct()


def entities_from_json(df: DataFrame, col: str) -> DataFrame:
    """Fenced JSON text holding a people and a place list to distinct rows.

    Text that is not valid JSON gives no rows.
    """
    parsed = F.from_json(text.strip_fences(F.col(col)), "array<array<string>>")
    lists = df.select(F.get(parsed, 0).alias("PERSON"), F.get(parsed, 1).alias("LOC"))
    long = lists.unpivot([], ["PERSON", "LOC"], "type", "_terms")
    return long.select(F.explode("_terms").alias("term"), "type").where(F.col("term").isNotNull()).distinct()


def first_characters(df: DataFrame, col: str, n: int) -> list[str]:
    """The first n distinct characters in sort order (n values reach the driver)."""
    chars = df.select(F.explode(text.characters(F.col(col))).alias("c")).distinct()
    return [r["c"] for r in chars.orderBy("c").limit(n).collect()]


def without_characters(df: DataFrame, col: str, chars: list[str]) -> DataFrame:
    """Drop rows whose text holds any of the characters."""
    if not chars:
        return df
    return df.where(~F.col(col).rlike("[" + "".join(re.escape(c) for c in chars) + "]"))


def merged_entities(*parts: DataFrame, illegal: int = 4) -> DataFrame:
    """Distinct union of entity tables, less terms with one of the first characters."""
    out = parts[0].select("term", "type")
    for p in parts[1:]:
        out = out.unionByName(p.select("term", "type"))
    out = out.distinct()
    return without_characters(out, "term", first_characters(out, "term", illegal))


def people(entities: DataFrame, least: int = 1, removable: DataFrame | None = None) -> DataFrame:
    """Distinct person names of at least this length, without the removable ones."""
    names = entities.where((F.col("type") == "PERSON") & (F.char_length("term") >= least))
    names = names.select(F.col("term").alias("name")).distinct()
    return names if removable is None else drop_matching(names, removable, ["name"])


def entity_counts(frames: DataFrame) -> DataFrame:
    """Mentions per entity name: longer than one character, typed as one of the kept
    types, and free of Latin letters and digits."""
    name = F.col("name")
    kept = frames.where(
        (F.char_length(name) > 1) & F.col("type").isNotNull() & ~text.has_latin_or_digit(name) & F.col("type").isin(*ENTITY_TYPES)
    )
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
