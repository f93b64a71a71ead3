"""Text cleaning, splitting, naming and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_list(col: Column) -> Column:
    """Remove brackets and single quotes: ``['a', 'b']`` to ``a, b``."""
    return F.regexp_replace(col, r"[\[\]']", "")


def split_list(col: Column) -> Column:
    """List text to an array."""
    return F.split(strip_list(col), ", ")


def split_words(col: Column) -> Column:
    """``a - b - c`` to an array."""
    return F.split(col, " - ")


def split_pair(col: Column) -> Column:
    """``a|b`` to an array."""
    return F.split(col, r"\|")


def replace_first(col: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match of a pattern (no groups in it)."""
    return F.regexp_replace(col, f"^((?s).*?)(?:{pattern})", f"$1{replacement}")


def without_spaces(col: Column) -> Column:
    return F.regexp_replace(col, " ", "")


def strip_fences(col: Column) -> Column:
    """Drop Markdown fences, line breaks and spaces around model-written JSON."""
    return F.regexp_replace(col, "`|json|\\n| ", "")


def snake_case(col: Column) -> Column:
    joined = F.regexp_replace(F.trim(col), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(joined, "^_+|_+$", ""))


def label_items(col: Column) -> Column:
    """Nested list text ``[["A","B\\n C"]]`` to distinct snake-case labels."""
    items = F.split(col, ",")
    clean = F.transform(items, lambda v: snake_case(replace_first(F.regexp_replace(v, r"[\[\]\"]", ""), r"\\n", "/")))
    return F.array_distinct(clean)


def characters(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def has_latin_or_digit(col: Column) -> Column:
    return F.lower(col).rlike("[a-z]|[0-9]")


def sorted_distinct(col: Column) -> Column:
    return F.array_sort(F.array_distinct(col))


def comma(col: Column, digits: int = 0, scale: float = 1.0, prefix: str = "", suffix: str = "") -> Column:
    """Grouped thousands, for example ``NT$45.3K``."""
    return F.concat(F.lit(prefix), F.format_number(col * F.lit(scale), digits), F.lit(suffix))


def percent(col: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(col * 100, digits), F.lit("%"))


def labelled_answer(col: Column, marker: str) -> Column:
    """Text after ``marker`` up to the line end, null when absent."""
    found = F.regexp_extract(col, f"{marker}(.*)\\n", 1)
    return F.when(col.rlike(f"{marker}(.*)\\n"), found)


def occurs(col: Column, term: Column) -> Column:
    """1 when the literal term occurs, however often."""
    return F.contains(col, term).cast("int")
