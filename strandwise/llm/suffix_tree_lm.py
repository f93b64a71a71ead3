"""Language model scores from a probabilistic suffix tree.

Symbols are the UTF-8 bytes of a text (A-Z lower-cased) and one text boundary. Over all training
texts every run of ``DEPTH`` + 1 symbols is counted. A context is a candidate if it occurs at least
``LEAST`` times, and is kept if the likelihood of its next symbols gains at least ``MIN_GAIN`` nats
over those of the next shorter context (its count times the Kullback-Leibler divergence); with a
context, all its suffixes are kept. Both limits are absolute, so the tree grows with the corpus.
Counting, the divergence test and the closure are Spark aggregates and joins. Each distribution,
with all symbols of its context, is smoothed towards that of its suffix.

For scoring the tree is dealt to parts by the last two symbols of a context. A part holds at most
``PART_NODES`` contexts (or those of a single pair of symbols) and scores the positions after its
pairs, whose longest kept suffix it holds. Parts are collected and broadcast one at a time; the
first goes over all rows, further ones add a pass each, and partial sums meet by text.

The base score is a word unigram model. Words that reach ``WORD_SHARE`` of all tokens (at most
1 / ``WORD_SHARE`` words) are looked up from a broadcast table; the tokens of all other words
are joined with their counts.

Defined cases: a null text is an empty text, which has the end alone; repeated rows each count;
a null doc_id is held out, as crc32 of the empty text is 0; repeated texts score alike; without training rows the root is
uniform; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, settled

DEPTH = 5
LEAST = 256
MIN_GAIN = 60.0
PART_NODES = 25_000
SMOOTH = 8.0
WORD_SHARE = 2e-6
N_SYMBOLS = 257
BITS = 9
#: Symbols that one counting or scoring step takes.
STEP_SYMBOLS = 4_000_000
#: Distinct words that a task gathers before it passes them on.
MOST_WORDS = 400_000
HOLD_OUT_MOD = 10


def symbols(raw: bytes) -> np.ndarray:
    """Boundary symbols, the bytes, and the end."""
    out = np.zeros(DEPTH + len(raw) + 1, dtype=np.int64)
    out[DEPTH : DEPTH + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    out[DEPTH : DEPTH + len(raw)] += 1
    return out


def _grams(parts: list[np.ndarray]) -> np.ndarray:
    """Codes of all runs of DEPTH + 1 symbols that end at a byte or an end."""
    line = np.concatenate(parts)
    code = np.zeros(len(line) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        code = (code << BITS) | line[k : k + len(code)]
    real = np.ones(len(line), dtype=bool)
    at = np.cumsum([0] + [len(p) for p in parts[:-1]])
    for k in range(DEPTH):
        real[at + k] = False
    return code[real[DEPTH:]]


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return code, np.bincount(back, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """code, n: how often each run of symbols occurs in ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, parts, size = [], [], 0

        def take():
            nonlocal found, parts, size
            if parts:
                found.append(np.unique(_grams(parts), return_counts=True))
                parts, size = [], 0
            if len(found) > 8:
                found = [_merged(found)]

        for b in batches:
            for text in b["text"]:
                s = symbols((text or "").encode("utf-8", "surrogatepass").lower())
                parts.append(s)
                size += len(s)
                if size >= STEP_SYMBOLS:
                    take()
        take()
        if found:
            code, n = _merged(found)
            yield pd.DataFrame({"code": code, "n": n})

    return docs.select("text").mapInPandas(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Part:
    """Contexts as a trie that reads backwards; ``child`` has the rows of inner nodes only.

    ``classes`` maps symbols to columns; symbols without a count share the last one, evenly.
    ``owned`` marks the pairs of last symbols whose positions the part scores (None: all).
    """

    classes: np.ndarray
    extra: np.ndarray
    child: np.ndarray
    logp: np.ndarray
    owned: np.ndarray | None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of the part's positions in each text, its end included."""
        out = np.zeros(len(texts))
        part, size, first = [], 0, 0
        for i, raw in enumerate(texts):
            part.append(raw)
            size += len(raw)
            if size >= STEP_SYMBOLS or i + 1 == len(texts):
                out[first : i + 1] = self._score(part)
                part, size, first = [], 0, i + 1
        return out

    def _score(self, texts: list[bytes]) -> np.ndarray:
        lines = [symbols(raw) for raw in texts]
        sizes = np.array([len(x) - DEPTH for x in lines])
        line = np.concatenate(lines)
        c = self.classes[line]
        at = np.arange(sizes.sum()) + np.repeat(DEPTH * np.arange(1, len(lines) + 1), sizes)
        owner = np.repeat(np.arange(len(lines)), sizes)
        if self.owned is not None:
            mine = self.owned[(line[at - 2] << BITS) | line[at - 1]]
            at, owner = at[mine], owner[mine]
        inner, width = self.child.shape
        child, logp = self.child.ravel(), self.logp.ravel()
        node, live = np.zeros(len(at), dtype=np.int32), np.arange(len(at))
        here = node
        for k in range(1, DEPTH + 1):
            here = child[here * np.int64(width) + c[at[live] - k]]
            found = here > 0
            live, here = live[found], here[found]
            node[live] = here
            deeper = here < inner
            live, here = live[deeper], here[deeper]
        return np.bincount(owner, weights=logp[node * np.int64(width) + c[at]] + self.extra[line[at]], minlength=len(lines))


def _key(k: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return (k.astype(np.int64) << BITS * DEPTH) | ctx


def build(rows: pd.DataFrame, owned: np.ndarray | None = None) -> Part:
    """Trie from all counts (k, context code, symbol, n, n_context) of kept contexts and the root."""
    k, ctx, sym, n, n_ctx = (rows[x].to_numpy() for x in ("k", "ctx", "sym", "n", "n_ctx"))
    root = np.full(N_SYMBOLS, 0.5)
    root[sym[k == 0]] += n[k == 0]
    common = np.unique(np.concatenate([[0], sym[k == 0]]))
    classes = np.full(N_SYMBOLS, len(common), dtype=np.int32)
    classes[common] = np.arange(len(common))
    width = len(common) + 1
    extra = np.where(classes == width - 1, -np.log10(max(1, N_SYMBOLS - len(common))), 0.0)
    keys, first, row_node = np.unique(np.concatenate([[0], _key(k, ctx)]), return_index=True, return_inverse=True)
    level = keys >> BITS * DEPTH
    code = keys & ((1 << BITS * DEPTH) - 1)
    shorter = np.maximum(level - 1, 0)
    suffix = np.searchsorted(keys, _key(shorter, code & ((1 << BITS * shorter) - 1)))
    is_inner = np.zeros(len(keys), dtype=bool)
    is_inner[0] = True
    is_inner[suffix[1:]] = True
    number = np.empty(len(keys), dtype=np.int32)
    number[np.argsort(~is_inner, kind="stable")] = np.arange(len(keys))  # inner nodes first, the root is 0
    child = np.zeros((int(is_inner.sum()), width), dtype=np.int32)
    oldest = classes[code[1:] >> BITS * shorter[1:]]
    child[number[suffix[1:]], oldest] = number[1:]
    p = np.zeros((len(keys), width), dtype=np.float32)
    p[0] = np.maximum(np.bincount(classes, weights=root / root.sum(), minlength=width), 1e-12)
    sums = np.ones(len(keys))
    sums[row_node[1:]] = n_ctx
    for depth in range(1, DEPTH + 1):
        nodes = np.flatnonzero(level == depth)
        p[number[nodes]] = p[number[suffix[nodes]]] * (SMOOTH / (sums[nodes] + SMOOTH)).astype(np.float32)[:, None]
        mine = k == depth
        p[number[row_node[1:][mine]], classes[sym[mine]]] += n[mine] / (n_ctx[mine] + SMOOTH)
    return Part(classes, extra, child, np.log10(p, out=p), owned)


def _last(k: int) -> str:
    """SQL of the last ``k`` symbols of ``ctx``."""
    return f"ctx & (shiftleft(1L, CAST({BITS} * ({k}) AS INT)) - 1)"


def kept_contexts(grams: DataFrame) -> DataFrame:
    """k, ctx, sym, n, n_ctx: all next-symbol counts of the kept contexts and of the root."""
    level = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.shiftright("code", BITS).bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("ctx")) for k in range(DEPTH + 1)
    ]))
    sums = grams.select(level.alias("x"), F.col("code").bitwiseAND(F.lit(2**BITS - 1)).alias("sym"), "n").groupBy("x.k", "x.ctx", "sym").agg(F.sum("n").alias("n"))
    rows = settled(
        sums.withColumn("n_ctx", F.sum("n").over(Window.partitionBy("k", "ctx")))  # at most 257 rows a context
        .where((F.col("n_ctx") >= LEAST) | (F.col("k") == 0))
    )
    shorter = rows.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("suffix"), "sym", F.col("n").alias("n_s"), F.col("n_ctx").alias("n_ctx_s"))
    gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("n_ctx_s") / (F.col("n_ctx") * F.col("n_s"))))
    passed = (
        rows.where("k > 0").withColumn("suffix", F.expr(_last("k - 1"))).join(shorter, ["k", "suffix", "sym"])
        .groupBy("k", "ctx").agg(gain.alias("gain")).where(F.col("gain") >= MIN_GAIN)
    )
    closed = (
        passed.select(F.explode(F.sequence(F.lit(1), "k")).alias("j"), "ctx")
        .select(F.col("j").alias("k"), F.expr(_last("j")).alias("ctx")).distinct()
    )
    return rows.where("k > 0").join(closed, ["k", "ctx"], "left_semi").unionByName(rows.where("k = 0"))


@dataclass
class Tree:
    """Kept counts with the part of each context (null: in all parts)."""

    rows: DataFrame
    pairs: pd.DataFrame
    n_parts: int

    def part(self, i: int) -> Part:
        """Part ``i``; at most ``PART_NODES`` contexts with 257 symbols each come to the driver."""
        small = ["cast(k as smallint) k", "ctx", "cast(sym as smallint) sym", "n", "n_ctx"]
        if self.n_parts == 1:
            return build(self.rows.selectExpr(*small).toPandas())
        owned = np.full(1 << 2 * BITS, i == 0)  # pairs that no kept context ends with fall to the first
        owned[self.pairs["pair"]] = (self.pairs["part"] == i).to_numpy()
        mine = self.rows.where(F.col("part").isNull() | (F.col("part") == i))
        return build(mine.selectExpr(*small).toPandas(), owned)


def learn(train: DataFrame) -> Tree:
    """Count over all training texts, test, close, and deal the contexts to parts."""
    rows = settled(kept_contexts(settled(gram_counts(train))).withColumn("pair", F.when(F.col("k") > 1, F.expr(_last("2")))))
    pairs = (
        rows.where("k > 1").select("k", "ctx", "pair").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("pair").toPandas()  # at most 257 x 257 rows
    )
    part, filled = [], 0
    for n in pairs["n"]:
        if part and filled + n > PART_NODES:
            part.append(part[-1] + 1)
            filled = 0
        else:
            part.append(part[-1] if part else 0)
        filled += n
    pairs["part"] = np.array(part, dtype=np.int32)
    n_parts = part[-1] + 1 if part else 1
    if n_parts > 1:
        table = train.sparkSession.createDataFrame(pairs[["pair", "part"]], "pair bigint, part int")
        rows = settled(rows.join(F.broadcast(table), "pair", "left"))
    return Tree(rows, pairs, n_parts)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (training tokens), n (all tokens); the end is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, train = Counter(), Counter()

        def out():
            frame = pd.DataFrame({"word": list(every), "n": list(every.values())})
            frame["c"] = [train[w] for w in every]
            every.clear()
            train.clear()
            return frame

        for b in batches:
            for text, held in zip(b["text"], b["held_out"]):
                ws = [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]
                every.update(ws)
                if not held:
                    train.update(ws)
                if len(every) > MOST_WORDS:
                    yield out()
        if every:
            yield out()

    return (
        docs.select("text", "held_out").mapInPandas(run, "word binary, n bigint, c bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    )


def _further(texts: DataFrame, tree: Tree) -> DataFrame:
    """_h1, _h2, _more: what the parts after the first add to the score of each distinct text."""
    passes = []
    for i in range(1, tree.n_parts):
        held = texts.sparkSession.sparkContext.broadcast(tree.part(i))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            part = held.value
            for b in batches:
                frame = b[["_h1", "_h2"]].copy()
                frame["x"] = part.score([(t or "").encode("utf-8", "surrogatepass").lower() for t in b["text"]])
                yield frame

        found = texts.select("_h1", "_h2", "text").mapInPandas(run, "_h1 bigint, _h2 bigint, x double")
        passes.append(settled(found.groupBy("_h1", "_h2").agg(F.max("x").alias("x"))))
        held.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    return every.groupBy("_h1", "_h2").agg(F.sum("x").alias("_more"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document."""
    marked = docs.select("doc_id", "text", (bucket_of(F.col("doc_id"), HOLD_OUT_MOD) == 0).alias("held_out"))
    text = F.coalesce("text", F.lit(""))
    marked = marked.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(1))})
    tree = learn(marked.where(~F.col("held_out")))
    counts = settled(word_counts(marked))
    n_all, n_train, n_words = counts.agg(F.sum("n"), F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n_all, n_train = n_all or 0, n_train or 0
    often = F.col("n") >= WORD_SHARE * n_all
    common = counts.where(often).select("word", "c").toPandas()  # at most 1 / WORD_SHARE rows
    known = dict(zip(map(bytes, common["word"]), common["c"].tolist()))
    bottom = float(np.log10(n_train + 0.1 * (n_words + 1)))
    held = docs.sparkSession.sparkContext.broadcast((tree.part(0), known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, known = held.value
        log = {w: float(np.log10(c + 0.1)) for w, c in known.items()}
        for b in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in b["text"]]
            frame = b[["doc_id", "held_out", "_h1", "_h2"]].copy()
            frame["score"] = part.score(raws)
            n_tokens, n_known, base, rare = [], [], [], []
            for raw in raws:
                ws = [*raw.split(), b""]
                values = [log.get(w) for w in ws]
                rest = [w for w, v in zip(ws, values) if v is None]
                n_tokens.append(len(ws))
                n_known.append(sum(1 for w in ws if known.get(w, 0)))
                base.append(sum(v for v in values if v is not None))
                rare.append(rest)
            frame["n_tokens"], frame["n_known"], frame["base"], frame["rare"] = n_tokens, n_known, base, rare
            yield frame

    scored = settled(
        marked.mapInPandas(run, "doc_id bigint, held_out boolean, _h1 bigint, _h2 bigint, score double, n_tokens bigint, n_known bigint, base double, rare array<binary>")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    if tree.n_parts > 1:
        scored = scored.join(_further(marked, tree), ["_h1", "_h2"], "left").withColumn("score", F.col("score") + F.col("_more")).drop("_more")
    rest = (
        scored.select("_row", F.explode("rare").alias("word"))
        .join(counts.where(~often).select("word", "c"), "word", "left")
        .groupBy("_row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("_log"), F.count(F.when(F.col("c") > 0, 1)).alias("_known"))
    )
    return scored.drop("rare").join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score",
    )
