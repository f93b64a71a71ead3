"""A round of the search for communities reads the links once."""

import random

from pyspark.sql import functions as F

from strandwise.operators import graphs


def links_of(spark):
    """Both directions, loops as the merged levels have them, and vertices without other links."""
    rng = random.Random(8)
    rows = {}
    for _ in range(60):
        a, b, w = rng.randrange(12), rng.randrange(12), float(rng.randint(1, 9))
        rows[a, b] = rows[b, a] = w
    rows[20, 20] = 4.0
    return rows, spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src int, dst int, weight double").cache()


def test_modularity_and_wishes_from_one_reading(spark, monkeypatch):
    rows, links = links_of(spark)
    whole = sum(rows.values())
    k = {a: sum(w for (x, _), w in rows.items() if x == a) for a, _ in rows}
    label = {a: a % 4 for a in k}
    labels = spark.createDataFrame([(a, v, label[a]) for a, v in k.items()], "id int, k double, label int").cache()
    total = {c: sum(v for a, v in k.items() if label[a] == c) for c in set(label.values())}
    share = sum(w for (a, b), w in rows.items() if label[a] == label[b]) / whole - sum((t / whole) ** 2 for t in total.values())
    read, attach = [], graphs.attach
    monkeypatch.setattr(graphs, "attach", lambda df, *a, **b: read.append("weight" in df.columns) or attach(df, *a, **b))
    votes = graphs._votes(links, labels, None)
    assert abs(graphs._share_within(votes, labels, whole) - share) < 1e-12

    def score(a, c):
        near = sum(w for (x, y), w in rows.items() if y == a != x and label[x] == c)
        return near - k[a] * (total[c] - (k[a] if c == label[a] else 0)) / whole

    expected = {}
    for a in k:
        near = {label[x] for x, y in rows if y == a != x} - {label[a]}
        best = min(near, key=lambda c: (-round(score(a, c), 9), c), default=None)
        if best is not None and round(score(a, best), 9) - round(score(a, label[a]), 9) > 0:
            expected[a] = (best, round(score(a, best) - score(a, label[a]), 6))
    got = {r["id"]: (r["_new"], round(r["gain"], 6)) for r in graphs._wishes(votes, labels, whole).collect()}
    assert got == expected and len(got) > 3
    assert read == [True]


def test_links_are_joined_once_a_round(spark, monkeypatch):
    """Two rounds of one level: the start and each round read the links once, before it was three times."""
    _, links = links_of(spark)
    links = links.where("src <> dst")
    start = links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).withColumn("label", F.col("id"))
    read, attach = [], graphs.attach
    monkeypatch.setattr(graphs, "attach", lambda df, *a, **b: read.append("weight" in df.columns) or attach(df, *a, **b))
    graphs._risen(links, start, links.agg(F.sum("weight")).first()[0], None, 2)
    assert read == [True] * 3


def test_few_links_take_no_round_over_tables(spark, monkeypatch):
    """Rounds of a small graph cost no jobs; before, each took several."""
    rows = [(f"{c}{i}", f"{c}{j}", 2) for c in "pqr" for i in range(5) for j in range(i)] + [("p0", "q0", 1), ("q1", "r1", 1), ("s0", "s0", 9)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    monkeypatch.setattr(graphs, "_risen", lambda *a: 1 / 0)
    got = {r["id"]: r["community"] for r in graphs.communities(edges).collect()}
    assert got == {f"{c}{i}": f"{c}0" for c in "pqr" for i in range(5)}


def test_rounds_over_arrays_and_tables_agree(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)]
    edges = spark.createDataFrame([(str(a), str(b), rng.randint(1, 9)) for a, b in pairs], "src string, dst string, weight long").cache()
    here = sorted(map(tuple, graphs.communities(edges, 2, 2).collect()))
    for bound in (-1, 100):  # tables only, and arrays from the second level on
        monkeypatch.setattr(graphs, "HERE_LINKS", bound)
        assert sorted(map(tuple, graphs.communities(edges, 2, 2).collect())) == here
