"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces of the product of their
probabilities; a forward pass gives it without listing segmentations. A text scores the sum
of its words' log probabilities, and the prediction is the language of greatest posterior.

Piece probabilities are learned by expectation maximisation (forward-backward over the same
lattice) from a bounded sample of labelled texts: about ``MAX_DOCS`` whole texts a language,
chosen by a hash of doc_id. Every text is scored whole.

Words are runs of letters, lower-cased, each led by the vocabulary's word mark. A run of more
than ``LONGEST`` letters is scored in parts of that length. All letters outside the vocabulary are
one and the same unknown piece; byte pieces are not used.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the first
language by code point; repeated rows are alike; without labelled rows every text is ``und``;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, lookup, settled

MAX_DOCS = 400
ROUNDS = 3
#: Added to the expected count of every piece.
PRIOR = 0.05
LONGEST = 48
HOLD_OUT_MOD, HOLD_OUT_REST = 4, 2
UNKNOWN, NONE = 0, -1
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Lattice:
    """A trie over the lower-case letter pieces, and the piece that ends at a node.

    ``first`` has the node of each letter at the root. Few letters of the vocabulary stand
    further inside a piece: ``inner`` numbers them, and ``step`` is node x inner letter.
    """

    letters: dict[str, int]
    first: np.ndarray
    inner: np.ndarray
    step: np.ndarray
    piece: np.ndarray
    n_pieces: int
    longest: int

    def coded(self, words: list[str]) -> np.ndarray:
        """Letter numbers of words of one length, the word mark first; 0: not in the vocabulary."""
        get = self.letters.get
        return np.array([[get("▁", 0), *(get(c, 0) for c in w)] for w in words], dtype=np.int64)

    def edges(self, coded: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece) of every piece in every word, starts and ends in order."""
        width = coded.shape[1]
        for i in range(width):
            rows = np.arange(len(coded))
            for j in range(i, min(width, i + self.longest)):
                node = self.first[coded[:, i]] if j == i else self.step[node, self.inner[coded[rows, j]]]
                if j == i:
                    yield i, j + 1, rows, np.where((node > 0) & (self.piece[node] >= 0), self.piece[node], UNKNOWN)
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                if j > i and (hit := self.piece[node] >= 0).any():
                    yield i, j + 1, rows[hit], self.piece[node[hit]]


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and not model.is_control(i)
                     and not model.is_byte(i) and not model.is_unknown(i)
                     and p == p.lower() and (p == "▁" or p.removeprefix("▁").isalpha())})
    letters = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
    nodes: dict[str, int] = {"": 0}
    for p in pieces:
        for k in range(1, len(p) + 1):
            nodes.setdefault(p[:k], len(nodes))
    first, inner = np.zeros(len(letters) + 1, dtype=np.int32), np.zeros(len(letters) + 1, dtype=np.int32)
    within = sorted({letters[c] for p in pieces for c in p[1:]})
    inner[within] = np.arange(1, len(within) + 1)
    step = np.zeros((len(nodes), len(within) + 1), dtype=np.int32)
    piece = np.full(len(nodes), NONE, dtype=np.int32)
    for s, k in nodes.items():
        if len(s) == 1:
            first[letters[s]] = k
        elif s:
            step[nodes[s[:-1]], inner[letters[s[-1]]]] = k
    for k, p in enumerate(pieces):
        piece[nodes[p]] = k + 1
    return Lattice(letters, first, inner, step, piece, len(pieces) + 1, max(map(len, pieces), default=1))


def words_of(text: str | None) -> list[str]:
    found = _LETTERS.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def _by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), most):
            part = at[i : i + most]
            yield part, [words[k] for k in part]


def word_scores(net: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language; ``p`` is pieces x languages."""
    out = np.zeros((len(words), p.shape[1]))
    for at, group in _by_length(words):
        coded = net.coded(group)
        forward = np.zeros((coded.shape[1] + 1, len(group), p.shape[1]))
        forward[0] = 1.0
        for i, j, rows, piece in net.edges(coded):
            forward[j, rows] += forward[i, rows] * p[piece]
        out[at] = np.log(np.maximum(forward[-1], 1e-300))
    return out


def expected_counts(net: Lattice, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations, for one language."""
    out = np.zeros(net.n_pieces)
    for at, group in _by_length(words):
        edges = list(net.edges(net.coded(group)))
        width = len(group[0]) + 1
        forward, backward = np.zeros((width + 1, len(group))), np.zeros((width + 1, len(group)))
        forward[0], backward[-1] = 1.0, 1.0
        for i, j, rows, piece in edges:
            forward[j, rows] += forward[i, rows] * p[piece]
        for i, j, rows, piece in reversed(edges):
            backward[i, rows] += backward[j, rows] * p[piece]
        weight = counts[at] / np.maximum(forward[-1], 1e-300)
        for i, j, rows, piece in edges:
            out += np.bincount(piece, weights=forward[i, rows] * p[piece] * backward[j, rows] * weight[rows], minlength=net.n_pieces)
    return out


@dataclass
class Model:
    path: str
    langs: list[str]
    p: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) for t in texts]
        distinct = list({w for ws in found for w in ws})
        number = {w: i for i, w in enumerate(distinct)}
        if not distinct or not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        table = word_scores(lattice(self.path), self.p, distinct)
        langs, scores = [], []
        for ws in found:
            if not ws:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.prior + table[[number[w] for w in ws]].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def _training_words(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Word counts per language over a bounded sample of whole labelled texts, and texts per language."""
    known = docs.where(F.col("lang").isNotNull() & (bucket_of(F.col("doc_id"), HOLD_OUT_MOD) != HOLD_OUT_REST)).select("doc_id", "text", "lang")
    sizes = settled(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = lookup(known, sizes, ["lang"], "inner").where(draw * F.col("_docs") < MAX_DOCS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                counts = Counter(w for t in texts for w in words_of(t))
                if counts:
                    yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})

    words = sample.select("lang", "text").mapInPandas(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return settled(words), {r["lang"]: r["_docs"] for r in sizes.collect()}


def learn(docs: DataFrame, path: str | None = None) -> Model:
    """Piece probabilities of each language from the labelled rows that are not held out."""
    path = path or vocabulary_file()
    net = lattice(path)
    words, sizes = _training_words(docs)
    langs = sorted(sizes)
    p = np.full((net.n_pieces, len(langs)), 1.0 / net.n_pieces)
    for _ in range(ROUNDS if langs else 0):
        held = docs.sparkSession.sparkContext.broadcast((langs, p))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            langs, p = held.value
            net = lattice(path)
            for b in batches:
                for lang, g in b.groupby("lang", sort=False):
                    n = expected_counts(net, np.ascontiguousarray(p[:, langs.index(lang)]), g["word"].tolist(), g["n"].to_numpy(float))
                    used = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "piece": used, "n": n[used]})

        found = words.mapInPandas(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        p = np.full((net.n_pieces, len(langs)), PRIOR)  # the table has a row a piece and language at most
        np.add.at(p, (found["piece"].to_numpy(int), np.searchsorted(langs, found["lang"].to_numpy(str)) if len(found) else []), found["n"].to_numpy())
        p /= p.sum(axis=0)
    total = sum(sizes.values())
    return Model(path, langs, p, np.log(np.array([sizes[k] / total for k in langs])) if langs else np.zeros(0))


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, path))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = held.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.select(
        "doc_id", (bucket_of(F.col("doc_id"), HOLD_OUT_MOD) == HOLD_OUT_REST).alias("held_out"), predict("text").alias("_p")
    ).select("doc_id", "held_out", "_p.lang_pred", "_p.score")
