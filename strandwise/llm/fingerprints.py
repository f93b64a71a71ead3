"""Document fingerprints from prefix polynomial hashes.

The code points of a text are the coefficients of a polynomial; its prefix sums modulo two
primes are kept as arrays. Any span's hash follows from two prefix values, so span equality
takes constant time and the longest common extension of two places a binary search.

A fingerprint is the hash of the whole text, its length, and the ``SKETCH`` least hashes of
all spans of ``SPAN`` code points (every span is hashed; the least ones are a uniform sample
of the set). Likeness of two fingerprints is 1 if texts are equal, else the estimated
Jaccard coefficient of their span sets.

Defined cases: a null text is an empty text; a text shorter than a span is one span; two empty
texts are alike (1), an empty and another one are not (0); a null doc_id comes last; rows with
equal doc_id follow by text; the only document is its own next one; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two primes below 2^31 and the bases of the polynomials.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
SPAN = 16
SKETCH = 64
#: Bytes of text that one block of neighbouring documents is planned for.
BLOCK_BYTES = 4_000_000
MAX_BLOCKS = 100_000
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shared_prefix bigint, shared_suffix bigint"
)

_powers: dict[tuple[int, int], np.ndarray] = {}


def _powers_of(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, grown by doubling and kept."""
    have = _powers.get((base, prime), np.ones(1, dtype=np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), prime))
        have = np.concatenate([have, have * step % np.uint64(prime)])
    _powers[base, prime] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Prefixes:
    """Prefix arrays of a text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        coefficients = points.astype(np.uint64) + np.uint64(1)
        for base, prime in zip(BASES, PRIMES):
            p = np.uint64(prime)
            terms = coefficients * _powers_of(base, prime, self.n) % p
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % p]))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the spans of one length at all the starts."""
        out = np.zeros(len(starts), np.uint64)
        last = int(starts[-1]) + 1 if len(starts) else 0
        for s, base, prime in zip(self.sums, BASES, PRIMES):
            p = np.uint64(prime)
            back = _powers_of(pow(base, -1, prime), prime, last)
            diff = (s[starts + length] + p - s[starts]) % p * back[starts] % p
            out = (out << np.uint64(31)) | diff
        return out

    def span(self, start: int, length: int) -> int:
        value = 0
        for s, base, prime in zip(self.sums, BASES, PRIMES):
            diff = (int(s[start + length]) - int(s[start])) % prime
            value = value << 31 | diff * pow(base, -start, prime) % prime
        return value


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest length at which the spans from ``i`` in a and from ``j`` in b agree."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal_spans(a, i, b, j, mid) else (low, mid - 1)
    return low


def common_suffix(a: Prefixes, b: Prefixes) -> int:
    low, high = 0, min(a.n, b.n)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal_spans(a, a.n - mid, b, b.n - mid, mid) else (low, mid - 1)
    return low


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread hashes over 64 bits, so that the least ones are a uniform sample."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(p: Prefixes) -> np.ndarray:
    """The least ``SKETCH`` distinct span hashes, 32 bits each, in order."""
    if not p.n:
        return np.zeros(0, np.uint64)
    length = min(SPAN, p.n)
    h = _mixed(p.spans(np.arange(p.n - length + 1), length)) >> np.uint64(32)
    if len(h) > 8 * SKETCH:  # the least lie below this bound but for rare texts
        low = np.unique(h[h < np.uint64(2**32 * 4 * SKETCH // len(h))])
        if len(low) >= SKETCH:
            return low[:SKETCH]
    return np.unique(h)[:SKETCH]


class Fingerprint:
    """Fingerprint of one text; ``str`` gives it as text, equal for equal texts."""

    def __init__(self, text: str):
        self.prefixes = Prefixes(code_points(text))
        self.whole = (self.prefixes.span(0, self.prefixes.n), self.prefixes.n)
        self.sketch = sketch(self.prefixes)

    def __str__(self) -> str:
        return f"{self.whole[0]:016x}-{self.whole[1]:x}-" + self.sketch.astype(">u4").tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.whole == b.whole:
        return 1.0
    union = np.union1d(a.sketch, b.sketch)[:SKETCH]
    if not len(a.sketch) or not len(b.sketch):
        return 0.0
    both = np.intersect1d(a.sketch, b.sketch, assume_unique=True)
    return float(np.isin(union, both).sum() / len(union))


def edit(text: str, after: str) -> str:
    """The last half of the code points replaced by as many of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id, text: str, mine: Fingerprint, after: str, theirs: Fingerprint) -> tuple:
    other = edit(text, after)
    edited = Fingerprint(other)
    return (
        doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), str(mine), str(edited),
        likeness(mine, edited), likeness(mine, theirs),
        common_extension(mine.prefixes, 0, edited.prefixes, 0), common_suffix(mine.prefixes, edited.prefixes),
    )


def _blocks(docs: DataFrame) -> list[int]:
    """First doc_id of each block of neighbouring documents; block sizes follow the text."""
    total, low = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))), F.min("doc_id")).first()
    if low is None:
        return []
    n = int(min(MAX_BLOCKS, max(128, (total or 0) // BLOCK_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted({low, *cuts})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the start of the next document's text.

    Texts move once, to blocks of neighbouring doc_ids. The first row of a block is also sent
    to the block before it (the first of all to the last), so every row meets its next one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    heads = _blocks(docs)
    firsts = np.array(heads, dtype=np.int64)
    n = max(1, len(firsts))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy(np.int64)
        at = np.where(known, np.searchsorted(firsts, values, side="right") - 1, n - 1)
        head = known & np.isin(values, firsts)
        return pd.Series([[int(b), int((b - 1) % n)] if h else [int(b)] for b, h in zip(at, head)])

    dealt = docs.withColumn("_places", places("doc_id")).select("doc_id", "text", F.posexplode("_places").alias("_tail", "_block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, block, first, done = None, None, None, False
        for b in batches:
            out = []
            for doc_id, text, tail, at in zip(b["doc_id"], b["text"], b["_tail"], b["_block"]):
                if at != block:
                    if held and not done:  # only ids that are all null leave a block without a tail
                        out.append(_row(*held, *first))
                    held, block, done = None, at, False
                    first = None
                elif done:
                    continue
                text = text or ""
                mark = Fingerprint(text)
                first = first or (text, mark)
                if held:
                    out.append(_row(*held, text, mark))
                held, done = (None if pd.isna(doc_id) else int(doc_id), text, mark), bool(tail)
                if tail:
                    held = None
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        if held and not done:
            frame = pd.DataFrame([_row(*held, *first)], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    order = [F.col("_block"), F.col("_tail"), F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    return dealt.repartition("_block").sortWithinPartitions(*order).mapInPandas(run, SCHEMA)
