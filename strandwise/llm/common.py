"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import written

#: White space between words, as the word pattern excludes it.
SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words: a word starts where a non-space follows the start or a space."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.split(F.btrim(t, F.lit(SPACES)), GAP)).cast("long") - F.when(
        F.btrim(t, F.lit(SPACES)) == "", 1
    ).otherwise(0)


#: What separates the words of the lexical operators, and the letters they lower.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lexical_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased, in order; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def bucket_of(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def settled(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read from there."""
    return written(df)



#: A side is broadcast up to this many rows and characters of text, and joined by shuffle beyond.
SMALL_ROWS, SMALL_CHARS = 100_000, 4_000_000


def lookup(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``df`` with a settled table of one row a key, broadcast only if its size is small.

    The size is measured, not guessed. Beyond it the join is shuffled and Spark's own skew
    handling splits hot keys of ``df``.
    """
    text = [F.coalesce(F.length(c), F.lit(0)) for c, kind in side.dtypes if kind == "string"]
    rows, chars = side.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(sum(text, F.lit(0)).cast("long")), F.lit(0))
    ).first()
    return df.join(F.broadcast(side) if rows <= SMALL_ROWS and chars <= SMALL_CHARS else side, keys, how)
