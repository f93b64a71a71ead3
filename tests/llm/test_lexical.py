"""Phrase and proximity matches, ranked search and fill-in-middle against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import decontamination, fill_in_middle, ranked_search
from strandwise.llm.common import lexical_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "term string, tid long, rid long, pos long, n long, words string, pid long, start long, h1 long, form string, item string, score long"


def terms(text):
    return WORD.findall((text or "").translate(LOWERED))


def with_clash(spark, rows, first):
    rows = [(*r, "t", 1, 2, 3, 4, "w", 5, 6, 7, "f", "i", 8) for r in rows]
    return spark.createDataFrame(rows, f"{first}, {CLASH}")


def documents(spark, rows):
    return with_clash(spark, rows, "doc_id long, text string")


def items(spark, rows):
    return with_clash(spark, rows, "item_id long, text string")


def random_text(rng, n, words=40):
    return " ".join(rng.choice([f"W{int(rng.paretovariate(0.7)) % words}", "é", "a-b"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    asked = [(i, random_text(rng, rng.choice([1, 3, 9, 10, 14, 30]))) for i in range(12)]
    asked += [(3, "again of the same item, W1 W2"), (None, "no id W1"), (50, None), (51, " .. "), (52, asked[0][1]), (52, asked[0][1])]
    docs = []
    for i in range(60):
        text = random_text(rng, rng.choice([0, 5, 60, 200]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            text += ". " + (rng.choice(asked)[1] or "").upper() + " ! " + random_text(rng, 4)
        docs.append((i, text))
    docs += [(100 + i % 3, asked[2][1] + " tail") for i in range(40)]  # a group of copies
    docs += [(None, asked[4][1]), (None, asked[4][1]), (200, None), (201, ""), (202, "\n .. "), (203, "the W1 " * 20_000), (7, docs[7][1])]
    return documents(spark, docs), items(spark, asked), docs, asked


def by_id(rows):
    return sorted(rows, key=repr)


def test_words(spark):
    text = "Àb CD\x00e9-ÉéZ" + chr(0x1F600) + "ſ K"
    assert spark.createDataFrame([(text,)], "t string").select(lexical_words(F.col("t"))).first()[0] == terms(text)


def plain_windows(asked):
    out = {}
    for item, text in asked:
        w = terms(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            out.setdefault(tuple(w[s : s + k]), set()).add("" if item is None else str(item))
    return out


def test_contamination(corpus):
    docs, asked, rows, plain = corpus
    wanted, sizes = plain_windows(plain), {len(w) for w in plain_windows(plain)}
    expected = []
    for doc_id, text in rows:
        w, hit, found = terms(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                owners = wanted.get(tuple(w[s : s + k]))
                if owners:
                    hit.update(range(s, s + k))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    got = [tuple(r) for r in decontamination.contamination(docs, asked).collect()]
    assert by_id(got) == by_id(expected) and any(r[2] for r in expected) and any(not r[2] for r in expected)


def test_spans_cover_the_hits(corpus):
    docs, asked, _, _ = corpus
    hits = decontamination.contamination(docs, asked).agg(F.sum("n_hit")).first()[0]
    joined = decontamination.spans(docs, asked).collect()
    assert sum(r["end"] - r["start"] for r in joined) == hits
    ends = {}
    for r in sorted(joined, key=lambda r: (r["rid"], r["start"])):
        assert r["start"] > ends.get(r["rid"], -1)
        ends[r["rid"]] = r["end"]


def test_phrases_by_either_join(corpus, monkeypatch):
    """The same matches whether sides are broadcast or shuffled."""
    docs, asked, _, _ = corpus
    broadcast = decontamination.contamination(docs, asked).collect()
    monkeypatch.setattr("strandwise.llm.common.SMALL_ROWS", -1)
    assert by_id(decontamination.contamination(docs, asked).collect()) == by_id(broadcast)


def test_proximity(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 60])))) for i in range(40)]
    docs = documents(spark, rows)
    queries = [(1, ["a", "b", "c"]), (2, ["d"]), (3, ["e", "zz"]), (4, ["g", "h", "g"])]
    index = decontamination.build_index(docs, spark.createDataFrame([(t,) for _, q in queries for t in q], "term string"))
    asked = spark.createDataFrame(queries, "pid long, words array<string>")
    found = decontamination.proximity_matches(index, asked, 5).join(index.rows, "rid")
    got = sorted((r["pid"], r["doc_id"], r["at"], r["start"]) for r in found.collect())
    freq = Counter(w for _, t in rows for w in t.split())
    expected = []
    for pid, q in queries:
        q = list(dict.fromkeys(q))
        anchor = min(q, key=lambda t: (freq[t], q.index(t)))
        for doc_id, text in rows:
            w = text.split()
            for at in [i for i, x in enumerate(w) if x == anchor]:
                fits = [s for s in range(max(0, at - 4), at + 1) if set(q) <= set(w[s : s + 5])]
                if fits:
                    expected.append((pid, doc_id, at, fits[0]))
    assert got == sorted(expected) and expected


def plain_ranks(rows, plain, top):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    freq = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in plain:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * freq[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return out


@pytest.mark.parametrize("top", [3, 50])
def test_search(corpus, top):
    docs, asked, rows, plain = corpus
    got = [tuple(r) for r in ranked_search.search(docs, asked, top).collect()]
    assert by_id(got) == by_id(plain_ranks(rows, plain, top))


def test_search_in_blocks_of_items(corpus, monkeypatch):
    docs, asked, rows, plain = corpus
    monkeypatch.setattr(ranked_search, "ITEM_CHARS", 60)
    got = [tuple(r) for r in ranked_search.search(docs, asked, 5).collect()]
    assert by_id(got) == by_id(plain_ranks(rows, plain, 5))


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_bounds_and_results(monkeypatch, leaf):
    """Bounds hold for every node, leaves hold every document once, and pruning changes nothing."""
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    sizes = rng.integers(1, 12, 700)
    sizes[:200] = 5  # a group of copies
    terms = [np.arange(5) if i < 200 else rng.choice(60, s, replace=False) for i, s in enumerate(sizes)]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    tfs, m, ids = rng.integers(1, 9, ptr[-1]), rng.integers(50, 300, 700), rng.permutation(700)
    tree = ranked_search.DocumentTree(ids, m, ptr, np.concatenate(terms), tfs, 60)
    leaves = sorted((a, b) for a, b, c in zip(tree.low, tree.high, tree.children) if not c)
    assert leaves[0][0] == 0 and leaves[-1][1] == 700 and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
    assert len(tree.low) > 3
    for _ in range(20):
        asked = np.sort(rng.choice(60, 6, replace=False))
        weights = rng.integers(1, 3000, 6)
        plain = {}
        for i, t in enumerate(terms):
            tf = dict(zip(t.tolist(), tfs[ptr[i] : ptr[i + 1]].tolist()))
            plain[int(ids[i])] = sum(int(w) * (10**9 * tf[q] // (1000 * tf[q] + 20 * int(m[i]))) for q, w in zip(asked.tolist(), weights) if q in tf)
        limits = tree.bounds(np.arange(len(tree.low)), asked, weights)
        for low, high, limit in zip(tree.low, tree.high, limits):
            assert max(plain[int(d)] for d in tree.ids[low:high]) <= limit
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        score, got = tree.search(asked, weights, none, 10)
        assert list(zip(score.tolist(), got.tolist())) == [(s, d) for s, d in sorted(((s, d) for d, s in plain.items() if s), key=lambda x: (-x[0], x[1]))[:10]]


def test_lexical_empty_tables(corpus):
    docs, asked, _, _ = corpus
    none, nothing = docs.where("false"), asked.where("false")
    assert decontamination.contamination(none, asked).count() == 0
    assert decontamination.contamination(docs, nothing).where("contaminated or n_items > 0").count() == 0
    assert ranked_search.search(none, asked).count() == 0 and ranked_search.search(docs, nothing).count() == 0
    assert fill_in_middle.digests(none).count() == 0


@pytest.mark.parametrize("error", [1, 100, 5000])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(error)
    for n in (0, 1, 2, 63, 64, 65, 500, 5_000):
        steps = np.where(rng.random(n) < 0.1, rng.integers(1, 9_000, n), rng.integers(1, 80, n))
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        index = fill_in_middle.RankIndex(offsets, error)
        ranks = rng.permutation(n + 1)
        assert (index.offset(ranks) == offsets[ranks]).all()
        assert abs(index.residuals.astype(int)).max() <= error + 1
    even = fill_in_middle.RankIndex(np.arange(0, 80_000, 8))
    assert len(even.firsts) == 1 and not even.residuals.any()


TEXTS = [
    None, "", "\n", "one", "one\n", "a\nb\nc", "\n\n\n", "é\n" + chr(0x1F600) + "x\n\r\nlast", "has <P> inside\nx", "a <S\n<P\n<\nM>\n", "<M>",
    "line of text\n" * 30_000, "x" * 300_000,
]


def test_fill_in_middle(spark):
    rows = [(i % 40, t) for i, t in enumerate(TEXTS * 8)] + [(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd")]
    out = fill_in_middle.transform(documents(spark, rows))
    back = out.withColumn("back", fill_in_middle.restored(F.col("text"), F.col("form"))).collect()
    expected, seen = [], set()
    for doc_id, text in rows:
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        if not text or "<P>" in text or "<S>" in text or "<M>" in text:
            expected.append((doc_id, text, len(lines), "plain", None, None))
        elif h[3] % 100 < 50:
            expected.append((doc_id, f"<S>{s}<P>{p}<M>{m}", len(lines), "spm", len(p), len(m)))
        else:
            expected.append((doc_id, f"<P>{p}<S>{s}<M>{m}", len(lines), "psm", len(p), len(m)))
        seen.add(expected[-1][3])
    assert by_id([tuple(r)[:6] for r in back]) == by_id(expected) and seen == {"plain", "psm", "spm"}
    assert Counter(r["back"] for r in back) == Counter(t or "" for _, t in rows)


def test_fill_in_middle_rate(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_in_middle.transform(docs, rate=30, spm_share=10).groupBy("form").count().collect()}
    assert 0.66 < forms["plain"] / 4_000 < 0.74 and 0.06 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.14
