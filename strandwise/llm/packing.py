"""Best-fit packing of token pieces into sequences of a fixed capacity.

1. Texts are tokenized in tasks and cut into pieces; only a document longer than the capacity
   is cut, and its first piece may be the short one.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver. A
   configuration linear program over it is solved by multiplicative weights, with an
   unbounded-knapsack dynamic programme as pricing, until every length is covered, and rounded;
   what rounding leaves is packed longest first, best fit next.
   All of this depends on the histogram only, so it costs the same at every input size.
3. Each piece gets its rank among the pieces of its length. The plan says which sequence and
   offset a rank has. Ranks are counted in cells of a length, so a length that a third of
   all documents share is spread.

Defined cases: a null text is an empty text, one piece that is the closing id alone; rows that
repeat are packed as often as they occur; rows whose doc_id is null are packed too; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

CAPACITY = 2048
END_ID = 0
#: Step of the weights, part of the best worth within which a configuration is used, accuracy of
#: the program's cost, and covers of every length at most (more of them are finer steps).
STEP, NEAR, ACCURACY, MOST_UNITS = 0.5, 0.05, 0.001, 8
#: Cells of one length, and rows that a cell may grow to before more are made.
CELLS, CELL_ROWS = 256, 4_000_000
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Up to here both tokenizer libraries class characters alike; other texts use the first one.
_FAR = re.compile("[^\x00-ɏ‐-‧]")


def tokenizer_files() -> tuple[str, str]:
    """The public vocabulary, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(files: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files[0])
    special = tuple(t.content for t in exact.get_added_tokens_decoder().values())
    with open(files[1], "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _FAR.search(text) or any(s in text for s in special):
            ids = exact.encode(text, add_special_tokens=False).ids
        else:
            ids = quick.encode_ordinary(text)
        return np.array([*ids, END_ID], dtype="<u4")

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    pieces = max(1, -(-n // capacity))
    first = n - (pieces - 1) * capacity
    return [(0, first)] + [(first + i * capacity, capacity) for i in range(pieces - 1)]


def token_pieces(
    docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds the ids themselves as an array."""
    files = files or tokenizer_files()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(files)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = encode(text or "")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (None if pd.isna(doc_id) else int(doc_id), k, start, length, zlib.crc32(part.tobytes()))
                    out.append((*row, part.astype("int32")) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = PIECE_SCHEMA + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def _priced(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over all rooms: the greatest worth that fits, and the piece added last (0: none)."""
    lengths = np.flatnonzero(worth[: capacity + 1] > 0)[::-1]  # longest first, ties go to it
    value = worth[lengths]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fits = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k < len(lengths):
            sums = value[k:] + best[c - lengths[k:]]
            i = int(sums.argmax())
            if sums[i] > best[c]:
                best[c], last[c] = sums[i], lengths[k + i]
    return best, last


def _filled(room: int, last: np.ndarray) -> dict[int, int]:
    """The multiset of lengths that ``_priced`` found for a room."""
    found: dict[int, int] = {}
    while room > 0:
        n = int(last[room])
        if n:
            found[n] = found.get(n, 0) + 1
        room -= n or 1
    return found


def price(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of lengths that fits: ``value[l]`` per piece of length l (0: none)."""
    return _filled(capacity, _priced(value, capacity)[1])


def _covering(counts: np.ndarray, capacity: int, units: int) -> tuple[dict[tuple, float], float, float]:
    """Configurations that cover every length ``units`` times, their cost for one cover, and a lower bound.

    One knapsack a round prices the best configuration around every length. All that are
    within ``NEAR`` of the best are used, a length growing by at most one cover a round; then
    worths fall with the growth. A length that is covered ``units`` times has no worth any more.
    """
    lengths = np.flatnonzero(counts)
    worth, covered, found = np.zeros(len(counts)), np.zeros(len(counts)), {}
    worth[lengths] = lengths
    cost = bound = 0.0
    while len(lengths):
        live = np.zeros(len(counts))
        live[lengths] = worth[lengths]
        best, last = _priced(live, capacity)
        bound = max(bound, float(counts @ live) / best[capacity])
        unit = np.minimum(1.0, units - covered) * counts
        left = unit.copy()
        around = live[lengths] + best[capacity - lengths]
        for i in np.argsort(-around, kind="stable"):
            n = int(lengths[i])
            if around[i] < (1 - NEAR) * best[capacity]:
                break
            if left[n] <= 0:
                continue
            config = _filled(capacity - n, last)
            config[n] = config.get(n, 0) + 1
            times = min(left[m] / k for m, k in config.items())
            if times <= 0:
                continue
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + times
            cost += times
            for m, k in config.items():
                left[m] -= k * times
                if left[m] < 1e-9 * counts[m]:
                    left[m] = 0.0
        grown = np.zeros(len(counts))
        grown[lengths] = (unit[lengths] - left[lengths]) / counts[lengths]
        covered += grown
        worth *= np.exp(-STEP * grown)
        worth /= worth[lengths].max()
        lengths = lengths[covered[lengths] < units - 1e-9]
    return found, cost / units, bound


def configurations(counts: np.ndarray, capacity: int, most_units: int = MOST_UNITS) -> list[tuple[dict[int, int], float]]:
    """Fractional solution of the configuration program by multiplicative weights.

    It covers every length exactly. More units mean smaller steps: they are doubled until the
    cost is within ``ACCURACY`` of the best lower bound (from the weights) or ``most_units``
    is reached; the cheapest solution is returned.
    """
    if not counts.any():
        return []
    units, bound, found = 1, 0.0, []
    while units <= most_units:
        used, cost, lower = _covering(counts, capacity, units)
        bound = max(bound, lower)
        found.append((cost, units, used))
        if cost <= (1 + ACCURACY) * bound:
            break
        units *= 2
    _, units, used = min(found, key=lambda f: f[:2])
    return [(dict(k), x / units) for k, x in used.items()]


def _best_fit(room: int, lengths: list[int], left: np.ndarray) -> dict[int, int]:
    """The multiset of remaining lengths (longest first) that fills the room best; sums are bit sets."""
    parts, sums, mask = [], [1], (1 << (room + 1)) - 1
    for n in lengths:
        copies, many = int(min(left[n], room // n)), 1
        while copies > 0 and not sums[-1] >> room:
            k = min(many, copies)
            parts.append((n, k))
            sums.append((sums[-1] | sums[-1] << n * k) & mask)
            copies, many = copies - k, 2 * many
        if sums[-1] >> room:
            break
    total, found = sums[-1].bit_length() - 1, {}
    for (n, k), before in zip(reversed(parts), reversed(sums[:-1])):
        if not before >> total & 1:
            found[n] = found.get(n, 0) + k
            total -= n * k
    return found


def fill(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack what is left: the longest piece, then the best fit for its gap; many bins at a time."""
    plan, present = [], [int(n) for n in np.flatnonzero(left)[::-1]]
    while present:
        n = present[0]
        left[n] -= 1
        config = _best_fit(capacity - n, [m for m in present if m <= capacity - n], left)
        left[n] += 1
        config[n] = config.get(n, 0) + 1
        times = min(int(left[m]) // k for m, k in config.items())
        plan.append((config, times))
        for m, k in config.items():
            left[m] -= k * times
        present = [m for m in present if left[m]]
    return plan


def rounded(counts: np.ndarray, solution: list[tuple[dict[int, int], float]], capacity: int) -> tuple[list, np.ndarray]:
    """Whole configurations, largest shares first, and the pieces left over.

    Shares of configurations that fill their sequence are rounded to the nearest number, others
    down; never beyond the pieces there are.
    """
    left, plan = counts.copy(), []
    for config, x in sorted(solution, key=lambda c: -c[1]):
        full = sum(n * k for n, k in config.items()) == capacity
        times = int(min(np.floor(x + (0.5 if full else 1e-9)), min(left[n] // k for n, k in config.items())))
        if times:
            plan.append((config, times))
            for n, k in config.items():
                left[n] -= k * times
    return plan, left


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, most_units: int = MOST_UNITS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences use each; every piece is placed exactly once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    full = [({capacity: 1}, int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    plan, left = rounded(counts, configurations(counts, capacity, most_units), capacity)
    return full + plan + fill(left, capacity)


def _slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Per configuration and length: key of the first rank, pieces a sequence, first sequence, offset."""
    rows, used, base = [], {}, 0
    for config, times in plan:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            rows.append((n, used.get(n, 0), k, base, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        base += times
    n, first, k, seq, off = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return (n << 50) + first, k, seq, off


def _ranked(pieces: DataFrame, cells: int) -> DataFrame:
    """``rank`` from 0 of each piece among those of its length."""
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, ["length", "_cell"]).withColumn(
        "rank", F.col("_before") + F.col("_at")
    )


def pack(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    pieces = settled(token_pieces(docs, files, capacity, with_ids))
    histogram = {n: c for n, c in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(histogram.values())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = PIECE_SCHEMA + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    if not total:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(packing_plan(histogram, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, per, seq, off = slots.value
        for b in batches:
            n, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            at = np.searchsorted(key, (n << 50) + rank, side="right") - 1
            r = rank - (key[at] - (n << 50))
            out = b[names].copy()
            out["sequence_id"] = seq[at] + r // per[at]
            out["offset"] = off[at] + (r % per[at]) * n
            yield out

    ranked = _ranked(pieces, max(CELLS, total // CELL_ROWS))
    return ranked.select(*names, "rank").mapInPandas(place, schema)
