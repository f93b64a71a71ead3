"""Fill-in-the-middle transformation with a learned rank index.

A text is cut between lines, so a cut is asked for as a rank (how many lines lie before it) and
answered as an offset (how many code points). ``RankIndex`` learns that mapping from all line
boundaries of the text: straight segments that miss no boundary by more than ``ERROR`` code
points, found by narrowing the cone of slopes that still fit, and the residual of every boundary
in one byte. A cut is predicted by the segment of its rank and corrected by its residual, which
is exact. Rows stay where they are: nothing is shuffled, and a task holds one batch.

Defined cases: a null text counts as empty, a null doc_id as the empty text in the draw; a text
without lines, or one that holds a marker, stays as it is (``plain``); rows of equal doc_id draw
equal numbers; a text of one line is cut before or behind it, so parts may be empty; repeated
rows give repeated results; texts are taken whole, whatever their length; an empty table gives
an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of prefix, suffix and middle, and the forms that use them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
#: Percent of texts that are transformed, and of these in suffix-first form.
RATE, SPM_SHARE = 100, 50
#: Largest distance of a boundary from its segment, in code points.
ERROR = 100
#: Boundaries that a segment tries first; doubled while it still fits.
FIRST_TRY = 64


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, before the first line, between lines and behind the last one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    tail = [len(points)] if len(points) and (not len(ends) or ends[-1] < len(points)) else []
    return np.concatenate([np.zeros(1, np.int64), ends, np.array(tail, np.int64)]).astype(np.int64)


def _reach(offsets: np.ndarray, first: int, error: int) -> tuple[int, float]:
    """First rank that a segment from ``first`` cannot take in, and a slope that fits the others."""
    width, low, high = FIRST_TRY, -np.inf, np.inf
    at = first + 1
    while at < len(offsets):
        stop = min(at + width, len(offsets))
        run = np.arange(at - first, stop - first)
        rise = offsets[at:stop] - offsets[first]
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        apart = np.flatnonzero(lows > highs)
        if len(apart):
            k = int(apart[0])
            if k:
                low, high = lows[k - 1], highs[k - 1]
            return at + k, (low + high) / 2 if np.isfinite(low) else 0.0
        low, high, at, width = lows[-1], highs[-1], stop, width * 2
    return len(offsets), (low + high) / 2 if np.isfinite(low) else 0.0


class RankIndex:
    """Offset of each rank: segments (first rank, offset there, slope) and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        firsts, slopes, at = [], [], 0
        while at < len(offsets):
            after, slope = _reach(offsets, at, error)
            firsts.append(at)
            slopes.append(slope)
            at = after
        self.firsts, self.slopes = np.array(firsts), np.array(slopes)
        self.starts = offsets[self.firsts]
        missed = offsets - self.predict(np.arange(len(offsets)))
        self.residuals = missed.astype(np.int8 if error < 127 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets by the segments alone, within the error (and rounding) of the true ones."""
        seg = np.searchsorted(self.firsts, ranks, side="right") - 1
        return self.starts[seg] + np.rint(self.slopes[seg] * (ranks - self.firsts[seg])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets."""
        return self.predict(ranks) + self.residuals[ranks]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, text (the transformed one), n (lines), form, prefix_chars and middle_chars of every row."""
    marks = (PREFIX, SUFFIX, MIDDLE)

    def cut(text: str, n: int, index: RankIndex, h: tuple) -> tuple:
        if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
            return text, n, PLAIN, None, None
        a, b = index.offset(np.sort(np.array([h[0] % (n + 1), h[1] % (n + 1)])))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_share:
            return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, n, SPM, int(a), int(b - a)
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, n, PSM, int(a), int(b - a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, *h in zip(batch["text"], batch["h1"], batch["h2"], batch["h3"], batch["h4"]):
                offsets = boundaries(text)
                out.append(cut(text, len(offsets) - 1, RankIndex(offsets), tuple(h)))
            frame = pd.DataFrame(out, columns=["text", "n", "form", "prefix_chars", "middle_chars"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *_draws(F.col("doc_id"), seed)
    )
    return rows.mapInPandas(run, "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long")


def restored(text: Column, form: Column) -> Column:
    """The text that was transformed, from the result and its form alone."""
    part = F.split(text, "<[PSM]>", -1)
    return (
        F.when(form == PSM, F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
        .when(form == SPM, F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
        .otherwise(text)
    )


def digests(docs: DataFrame) -> DataFrame:
    """The transformation of every text, with digests of the result and of the text rebuilt from it."""
    out = transform(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
