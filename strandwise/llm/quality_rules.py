"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data; ``compile_rules`` turns it into one boolean column. Ratios come from
``measures``, which uses built-in functions only, one row at a time, so nothing is
shuffled and a hot source or a group of copies changes nothing.

Defined cases: a null text is an empty text; an empty text has zero words and fails the
base test; repeated rows are judged alike; an empty table gives an empty table; other
columns, whatever their names, are kept untouched by ``keep`` and ignored by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the supported languages.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by this are from or an at "
    "der die das und ist von mit den im zu nicht ein eine auf für als auch dem sich des "
    "de la le et les des en un une que est pour dans qui sur par pas au du avec "
    "el los y del se las por con no para su al lo como más una es"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` lies outside [low, high]; ``None`` is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios are taken per word or per line.
RULES = (
    Rule("n_words", low=50),
    Rule("word_length", low=2.0, high=16.0),
    Rule("symbol_ratio", high=0.1),
    Rule("exclaimed_ratio", high=0.3),
    Rule("upper_ratio", high=0.5),
    Rule("letter_ratio", low=0.6),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_ratio", high=0.5),
)


def _dropped(text: Column, chars: str) -> Column:
    return F.length(text).cast("long") - F.length(F.translate(text, chars, ""))


def _covered(found: Column) -> Column:
    """Words covered by repeated three-word windows, from the sorted window starts."""
    n = F.size(found)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0).cast("long"),
        lambda total, i: total
        + F.when(i == n - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(found, i + 1) - F.get(found, i))).cast("long"),
    )


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    Windows are sorted by a 64-bit hash, so equal windows are neighbours: n log n per text.
    """
    n = F.size(w)

    def starts(marks: Column) -> Column:
        last = F.size(marks) - 1
        twin = F.filter(
            F.transform(
                marks,
                lambda m, i: F.when(
                    ((i > 0) & (F.get(marks, i - 1)["h"] == m["h"]))
                    | ((i < last) & (F.get(marks, i + 1)["h"] == m["h"])),
                    m["at"],
                ),
            ),
            lambda at: at.isNotNull(),
        )
        return let(F.sort_array(twin), lambda s: F.when(F.size(s) > 0, _covered(s)).otherwise(F.lit(0).cast("long")))

    marks = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")),
        )
    )
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(marks, starts))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(text: Column) -> Column:
    """All measures of a text as one struct; the text and its words are bound once."""

    def of(t: Column, w: Column) -> Column:
        ends = F.transform(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:?"))))
        squeezed = F.translate(t, SPACES, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(squeezed).cast("long").alias("word_chars"),
            _dropped(t, SYMBOLS).alias("n_symbols"),
            _dup_lines(t).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long").alias("n_lines"),
            F.size(F.filter(ends, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_exclaimed"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of(t, w)))


def _ratios(m: Column) -> dict[str, Column]:
    per = lambda a, b: m[a] / F.greatest(m[b], F.lit(1).cast("long"))
    return {
        "n_words": m["n_words"],
        "word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "exclaimed_ratio": per("n_exclaimed", "n_words"),
        "upper_ratio": per("n_upper", "n_letters"),
        "letter_ratio": per("n_letters", "word_chars"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean: every rule of the table holds."""
    ratio, ok = _ratios(m), F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (ratio[r.measure] >= r.low)
        if r.high is not None:
            ok = ok & (ratio[r.measure] <= r.high)
    return ok


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict per document: doc_id, the measures, base_failed, kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_lines", "n_stop", "n_exclaimed", "n_upper", "n_letters")
    m = F.col("m")
    return docs.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id", *[m[n].alias(n) for n in names], base_failed(m).alias("base_failed"),
        (~base_failed(m) & compile_rules(m, rules)).alias("kept"),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    verdict = let(measures(F.col("text")), lambda m: ~base_failed(m) & compile_rules(m, rules))
    return docs.where(verdict)
