"""Operators against plain Python on the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from strandwise.llm import (
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    suffix_tree_lm,
    url_filters,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))


def query(spark, name):
    return entry.queries()[name](spark, SF).collect()


# near duplicates


def brute_classes(rows):
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, wa)), (j, (b, wb)) in itertools.combinations(sets.items(), 2):
        if len(a) and len(b) and len(np.intersect1d(a, b)) and near_dedup.similarity(a, wa, b, wb) >= 0.8:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, rows):
    found = {r["doc_id"]: r["class_id"] for r in query(spark, "op1_near_dedup")}
    assert found == brute_classes(rows)


def test_near_group_hangs_together_by_its_base_alone(spark):
    """Copies of a base are near the base, but often not near each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = [(0, " ".join(base))]
    for k in range(1, 60):
        w = list(base)
        for at in rng.integers(0, 300, 7):
            w[at] = f"x{k}_{at}"
        texts.append((k, " ".join(w)))
    texts += [(100 + k, " ".join(f"y{k}_{i}" for i in range(80))) for k in range(20)]
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute_classes(texts)


def test_copies_that_do_not_all_link_equal_brute_force(spark, monkeypatch):
    """Copies of one base with few to many changes share buckets and are in part not near anything; several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(160):
        w = [f"w{i}" for i in range(100)]
        for at in rng.integers(0, 100, k % 8):
            w[at] = f"x{k}_{at}"
        texts.append((k, " ".join(w)))
    calls = []
    whole = near_dedup._by_blocks
    monkeypatch.setattr(near_dedup, "_by_blocks", lambda *a: calls.append(1) or whole(*a))
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    expected = brute_classes(texts)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == expected
    assert calls and 2 < len(set(expected.values())) < 160


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(1, 2**63, 400, dtype=np.uint64))
    wa, wb = rng.integers(0, 4, len(ids)), rng.integers(0, 4, len(ids))
    a, b = ids[wa > 0], ids[wb > 0]
    true = near_dedup.similarity(a, wa[wa > 0], b, wb[wb > 0])
    x, y = (near_dedup.registers(i, w, 4000) for i, w in ((a, wa[wa > 0]), (b, wb[wb > 0])))
    assert abs((x == y).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4000)


def test_keep_leaves_one_of_each_class(spark, docs, rows):
    classes = brute_classes(rows)
    kept = [r["doc_id"] for r in near_dedup.keep(docs.unionByName(docs)).collect()]
    assert sorted(kept) == sorted(set(classes.values()))


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (99, 99)]
    found = near_dedup.components(spark.createDataFrame(links, "u long, v long"))
    assert {r["nid"]: r["root"] for r in found.collect()} == {i: 0 for i in range(31)} | {50: 50, 60: 50, 55: 50}


# fingerprints


def test_fingerprints(spark, rows):
    found = {r["doc_id"]: r for r in query(spark, "op2_fingerprints")}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["shared_prefix"] == len(next((text[:k] for k in range(min(len(text), len(edited)), -1, -1) if text[:k] == edited[:k])))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        spans = lambda t: {t[k : k + 16] for k in range(max(1, len(t) - 15))} if t else set()
        a, b = spans(text), spans(edited)
        true = 1.0 if text == edited else len(a & b) / max(1, len(a | b))
        assert abs(r["near_edited"] - true) < 0.3
    texts = defaultdict(set)
    for i, t in rows:
        texts[t].add(found[i]["fingerprint"])
    assert all(len(s) == 1 for s in texts.values()) and len({f for s in texts.values() for f in s}) == len(texts)


def test_spans_and_extensions():
    a, b = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in ("xxabcdéfgh", "abcdéfgz"))
    assert fingerprints.common_extension(a, 2, b, 0) == 7 and fingerprints.common_extension(a, 0, b, 0) == 0
    assert fingerprints.equal_spans(a, 3, b, 1, 5) and not fingerprints.equal_spans(a, 3, b, 2, 5)
    assert list(a.spans(np.arange(3), 4)) == [a.span(k, 4) for k in range(3)]


# pages


def test_main_text_of_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    good = 0
    for r in query(spark, "op3_html_text"):
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html_text.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        good += r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])
    assert good >= 0.99 * len(pages)


def test_held_out_layouts():
    field, right, n = html_text.trained(), 0, 0
    for page in html_text.labelled_pages(60, seed=1234):
        blocks = html_text.blocks(page)
        for b, main in zip(blocks, field.decode(blocks)):
            if b.label:
                n += 1
                right += (b.label == "main") == main
    assert right / n > 0.98


def test_viterbi_is_the_best_of_all_labellings():
    field = html_text.trained()
    blocks = html_text.blocks("<nav><a href=x>a</a></nav><div><p>One, two. Three, four.</p><p>Five</p></div><footer>© x</footer><p>z")
    gain = [field.weights["bias"] + sum(field.weights.get(f, 0) for f in b.features) for b in blocks]

    def total(y):
        return field.start[y[0]] + sum(g for g, k in zip(gain, y) if k) + sum(field.change[a, b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
    assert [bool(k) for k in best] == field.decode(blocks)


def test_parser():
    text = lambda h: [b.text for b in html_text.blocks(h)]
    assert text("<p><b>A&amp;B.<br><p>c <i>d</i>e<ul><li>x<li>y</ul>z") == ["A&B.", "c de", "x", "y", "z"]
    assert text("<p>a<script>'</p>'</script>b</p><!-- <p>no --><style>p{}</style><p>&eacute;&#233;&nbsp;&nbsp;x") == ["ab", "éé x"]
    assert text("<title>t</title><p>a<textarea>no</textarea><p title='a>b'>c</p") == ["a", "c"]


def test_parser_keeps_formulas_drawings_and_fallback_text():
    text = lambda h: [b.text for b in html_text.blocks(h)]
    assert text("<p>so <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds</p><p>b") == ["so x=2 holds", "b"]
    assert text("<article><svg class='i'/><p>a</p><p>b</p><math/>c</article>") == ["a", "b", "c"]
    assert text("<p>a <svg width=1/ ><g><title>t</title><text>u</text><text>v</text><style/></g></svg> b") == ["a t u v b"]
    assert text("<p>a <svg><title/><script/><path d=''/></svg> b</p><p>c") == ["a b", "c"]
    assert text("<p>a <object>b</object> <noscript>c <i>d</i></noscript> <canvas>e</canvas> <iframe>f</iframe></p>g") == ["a b c d e f", "g"]
    assert text("<div><noscript><p>a</p></noscript></div><svg><g>b<p>c</p><my-x>d</my-x>") == ["a", "b", "c", "d"]
    assert text("<p><math><mtext><![CDATA[a>b &amp;]]></mtext></math><svg href=x/>c</svg>d<svg/><title>no</title>") == ["a>b &amp;cd"]
    assert text("<head><noscript>no</noscript><svg><text>no</text></svg></head><p>a<![CDATA[no]]>") == ["a"]
    field = html_text.trained()
    page = f"<nav><a href=x>menu</a></nav><article><svg class=\"i\"/>{'<p>Some words, then more of them. And others follow.</p>' * 4}</article>"
    assert sum(field.decode(html_text.blocks(page))) == 4


# language


def test_language_on_held_out_rows(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = query(spark, "op4_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_forward_pass_sums_all_segmentations():
    net = language_id.lattice(language_id.vocabulary_file())
    rng = np.random.default_rng(0)
    p = rng.random((net.n_pieces, 2)) / 100
    for word in ("haus", "the", "ézx", "ж"):
        marked = "▁" + word
        edges = defaultdict(list)
        for i, j, rows, piece in net.edges(net.coded([word])):
            edges[i].append((j, int(piece[0])))

        def total(i, k):
            return 1.0 if i == len(marked) else sum(p[piece, k] * total(j, k) for j, piece in edges[i])

        assert np.allclose(language_id.word_scores(net, p, [word])[0], [np.log(total(0, k)) for k in (0, 1)])
    counts = language_id.expected_counts(net, p[:, 0], ["haus", "maus"], np.array([2.0, 1.0]))
    assert 3.0 <= counts.sum() <= 15.0 + 1e-9


# language model


def test_base_score_and_model(spark, rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for r in query(spark, "op6_suffix_tree_lm"):
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(train[w] > 0 for w in ws) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


@pytest.mark.parametrize("part_nodes", [40_000, 30])
def test_tree_equals_brute_force(spark, docs, monkeypatch, part_nodes):
    monkeypatch.setattr(suffix_tree_lm, "LEAST", 12)
    monkeypatch.setattr(suffix_tree_lm, "MIN_GAIN", 8.0)
    monkeypatch.setattr(suffix_tree_lm, "PART_NODES", part_nodes)
    texts = [(i, (t or "")[:400]) for i, t in docs.select("doc_id", "text").orderBy("doc_id").limit(25).collect()]
    texts += [(900, None), (901, ""), (902, "\u00e9\u4e2d new"), texts[0]]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    depth = suffix_tree_lm.DEPTH

    def padded(text):
        return [0] * depth + [x + 1 for x in (text or "").encode().lower()] + [0]

    counts = {}
    for i, text in texts:
        if zlib.crc32(str(i).encode()) % 10:
            line = padded(text)
            for at in range(depth, len(line)):
                for k in range(depth + 1):
                    counts.setdefault(tuple(line[at - k : at]), Counter())[line[at]] += 1
    size = {ctx: sum(c.values()) for ctx, c in counts.items()}
    kept = {()}
    for ctx, own in counts.items():
        if ctx and size[ctx] >= 12:
            shorter = counts[ctx[1:]]
            gain = sum(n * math.log(n * size[ctx[1:]] / (size[ctx] * shorter[a])) for a, n in own.items())
            if gain >= 8.0:
                kept.update(ctx[i:] for i in range(len(ctx)))

    def chance(ctx, a):
        if not ctx:
            return (counts[()][a] + 0.5) / (size[()] + 0.5 * 257)
        return (counts[ctx][a] + 8.0 * chance(ctx[1:], a)) / (size[ctx] + 8.0)

    tree = suffix_tree_lm.learn(table.where("crc32(cast(cast(doc_id as string) as binary)) % 10 != 0"))
    found = set()
    for r in tree.rows.select("k", "ctx").distinct().collect():
        found.add(tuple((r["ctx"] >> 9 * (r["k"] - 1 - i)) & 511 for i in range(r["k"])))
    assert found == kept and (tree.n_parts > 2) == (part_nodes == 30)
    scores = {(r["doc_id"], r["n_tokens"]): r["score"] for r in suffix_tree_lm.score(table).collect()}
    for i, text in texts:
        line, want = padded(text), 0.0
        for at in range(depth, len(line)):
            ctx = next(tuple(line[at - k : at]) for k in range(depth, -1, -1) if tuple(line[at - k : at]) in kept)
            want += math.log10(chance(ctx, line[at]))
        assert math.isclose(scores[i, len(WORD.findall(text or "")) + 1], want, rel_tol=1e-4), i


# classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = entry.queries()["op8_quality_classifier"](spark, sf).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_prior_estimate():
    rng = np.random.default_rng(2)
    positive, negative = rng.normal(2, 1, 3000), rng.normal(-2, 1, 6000)
    mixed = np.concatenate([rng.normal(2, 1, 4200), negative[:1800]])
    assert abs(quality_classifier.estimate_prior(positive, mixed) - 0.7) < 0.06


# mixing and url filters beyond their SQL


def test_targets_refill_until_none_is_above(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 300), ("d", 5), (None, 40)])]
    found = {r["doc_id"]: r for r in mixing.shares(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size, weight, cap = {}, {}, {}
    for i, r in found.items():
        size[i], weight[i] = r["size"], i % 3 + 1
        cap[i] = 3 * size[i]
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(cap[i] for i in capped)) / sum(weight[i] for i in size if i not in capped)
        over = {i for i in size if i not in capped and level * weight[i] > cap[i]}
        if not over:
            break
        capped |= over
    for i in size:
        want = cap[i] if i in capped else level * weight[i]
        assert math.isclose(found[i]["target"], want) and abs(found[i]["taken"] - want) <= size[i] / 2 + 1e-9


def test_mix_repeats_documents_as_taken(spark, docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.shares(docs).collect()}
    found = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert found == Counter({i: n for i, n in taken.items() if n})


def test_url_rules_against_all_rules(spark):
    rng = np.random.default_rng(5)
    labels, parts = ["a", "b", "c-d", ""], ["", "/", "/x", "/x/", "/x/y", "/xy"]
    host = lambda: ".".join(labels[k] for k in rng.integers(0, 4, rng.integers(1, 4)))
    rules = sorted({(host(), parts[rng.integers(0, 6)]) for _ in range(25)})
    verdict = {r: ("block", "allow")[k % 2] for k, r in enumerate(rules)}
    pages = [(k, f"http://{host()}{parts[rng.integers(1, 6)]}?q") for k in range(400)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    found = url_filters.judge(frame, url_filters.rule_table(spark, [(v, h, p) for (h, p), v in verdict.items()]))
    for r in found.collect():
        fits = [x for x in rules if (r["host"] == x[0] or r["host"].endswith("." + x[0])) and r["path"].startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert r["rule"] == (best and "".join(best)) and r["verdict"] == (verdict[best] if best else "allow"), r


# packing


def check_packing(rows, tokens):
    texts = defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(r)
    for i, ids in tokens.items():
        pieces = sorted(texts[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1]
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    room = defaultdict(list)
    for r in rows:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(room)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_files()[0]).encode
    tokens = {i: [*encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    found = query(spark, "op10_packing")
    least = -(-sum(map(len, tokens.values())) // 2048)
    assert check_packing(found, tokens) <= least * 1.02 + 1


def test_both_tokenizers_agree_where_the_quick_one_is_used():
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    exact, quick = Tokenizer.from_file(files[0]), packing._encoder(files)
    near = [chr(c) for c in itertools.chain(range(0x250), range(0x2010, 0x2028))]
    texts = [f"a{c}b {c} {c}{c}1{c}\n {c}" for c in near] + ["x<|endoftext|>y", "日本語 テキスト", " \u2028\u3000x", "\U0001f600 z"]
    for t in texts:
        assert quick(t).tolist() == [*exact.encode(t, add_special_tokens=False).ids, 0], repr(t)


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(1, 101, 500).tolist())
    plan = packing.packing_plan(histogram, 100, 60)
    used = Counter()
    for config, times in plan:
        assert sum(n * k for n, k in config.items()) <= 100 and times > 0
        used.update({n: k * times for n, k in config.items()})
    assert used == histogram
    total = sum(t for _, t in plan)
    least = max(math.ceil(sum(n * c for n, c in histogram.items()) / 100), sum(c for n, c in histogram.items() if n > 50))
    assert total <= least * 1.02 + 1


@pytest.mark.parametrize("seed", range(2))
def test_program_covers_every_length_exactly(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 255), minlength=257)
    solution = packing.configurations(counts, 256)
    covered = np.zeros(257)
    for config, x in solution:
        assert sum(n * k for n, k in config.items()) <= 256 and x > 0
        for n, k in config.items():
            covered[n] += k * x
    assert np.allclose(covered, counts, rtol=1e-6)
    plan, left = packing.rounded(counts, solution, 256)
    assert (left >= 0).all() and left.sum() < 0.1 * counts.sum()
    assert packing.configurations(np.zeros(257, dtype=int), 256) == []


def test_price_is_the_best_multiset():
    value = np.zeros(13)
    value[[3, 5, 7]] = [2.0, 3.6, 5.1]
    best = max(2.0 * a + 3.6 * b + 5.1 * c for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 12)
    assert math.isclose(sum(value[n] * k for n, k in packing.price(value, 12).items()), best)


# pipeline


def test_pipeline_equals_its_stages_by_plain_means(spark):
    sf = "/root/testdata/sf0.01"
    found = entry.queries()["pipeline"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in entry.queries()["op8_quality_classifier"](spark, sf).collect() if r["predicted"]}
    ruled = {r["doc_id"] for r in entry.queries()["op5_quality_rules"](spark, sf).collect() if r["kept"]}
    left = docs.where(docs["doc_id"].isin(sorted(good & ruled)))
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(left).collect()}
    left = left.where(left["doc_id"].isin(sorted(set(classes.values()))))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.shares(left).collect()}
    assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter({i: n for i, n in taken.items() if n})
    room = defaultdict(int)
    for r in found:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048
