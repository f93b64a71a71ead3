"""Neighbours, types and difference tables of sequences against plain Python."""

import itertools
import random

import numpy as np
import pytest

from strandwise.operators import sequence_search as search
from strandwise.operators import sequences, sessions

STATES = ["a", "b", "c", "d"]
SPELLS = "start int, state string, length int"


def random_spells(rng, base=None):
    runs = []
    for state, length in base or [(rng.choice(STATES), rng.choice([1, 2, 5, 20])) for _ in range(rng.choice([1, 2, 3, 6]))]:
        length = max(1, length + rng.choice([0, 0, 0, 1, -1]))
        if runs and runs[-1][0] == state:
            runs[-1] = (state, runs[-1][1] + length)
        else:
            runs.append((state, length))
    at, out = 0, []
    for state, length in runs:
        out.append((at, state, length))
        at += length
    return out


def cost_rows(rng, metric=True):
    rows = []
    for i, j in itertools.combinations(range(4), 2):
        c = rng.choice([1.5, 1.7, 2.0]) if metric else rng.choice([0.2, 1.0, 5.0])
        rows += [(STATES[i], STATES[j], c), (STATES[j], STATES[i], c)]
    return rows


def plain_distance(x, y, costs, slen):
    sub = {(a, b): c for a, b, c in costs}
    indel = max(sub.values()) / 2
    xs = [(s, n**-0.5 if slen else 1.0) for _, s, n in x for _ in range(n)]
    ys = [(s, n**-0.5 if slen else 1.0) for _, s, n in y for _ in range(n)]
    row = [0.0]
    for _, t in ys:
        row.append(row[-1] + indel * t)
    for s, t in xs:
        new = [row[0] + indel * t]
        for j, (q, u) in enumerate(ys):
            change = 0.0 if s == q else sub[s, q]
            new.append(min(row[j + 1] + indel * t, new[-1] + indel * u, row[j] + change * (t + u) / (2 if slen else 2)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(3)
    bases = [random_spells(rng) for _ in range(60)]
    found = {}
    while len(found) < 300:
        base = rng.choice(bases)
        s = random_spells(rng, [(state, n) for _, state, n in base])
        found.setdefault(tuple(s), f"s{len(found)}")
    rows = [(i, list(s)) for s, i in found.items()]
    return rows, spark.createDataFrame(rows, f"id string, spells array<struct<{SPELLS.replace(' ', ':').replace(',:', ',')}>>").cache()


@pytest.mark.parametrize("metric", [True, False])
@pytest.mark.parametrize("measure,radius", [("om", 3.0), ("om_slen", 0.9)])
def test_near_by_edits_equals_all_pairs(spark, seqs, measure, radius, metric):
    rows, df = seqs
    costs = cost_rows(random.Random(metric + 5), metric)
    table = spark.createDataFrame(costs, "a string, b string, cost double")
    got = {(r["a"], r["b"]): r["distance"] for r in search.near_by_edits(df, "id", table, radius, measure).collect()}
    prices = search.EditCosts.of(table)
    pairs = list(itertools.combinations(rows, 2))
    d = search.distances([(prices.coded([dict(zip(("start", "state", "length"), s)) for s in x]), prices.coded([dict(zip(("start", "state", "length"), s)) for s in y])) for (_, x), (_, y) in pairs], prices, measure)
    checked = random.Random(1).sample(range(len(pairs)), 150)
    for k in checked:
        assert abs(d[k] - plain_distance(pairs[k][0][1], pairs[k][1][1], costs, measure == "om_slen")) < 1e-9
    expected = {tuple(sorted((x[0], y[0]))): v for (x, y), v in zip(pairs, d) if v <= radius}
    assert got.keys() == expected.keys() and len(expected) > 50
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    report = search.pruning(df, "id", table, radius, measure).first()
    assert report["sequences"] == 300 and report["pairs"] == 300 * 299 // 2
    assert len(got) <= report["aligned"] and (report["pruned_share"] > 0.6 or not metric)


def test_crowded_cells_of_neighbours(spark, seqs, monkeypatch):
    _, df = seqs
    table = spark.createDataFrame(cost_rows(random.Random(5)), "a string, b string, cost double")
    whole = sorted(map(tuple, search.near_by_edits(df, "id", table, 3.0).collect()))
    monkeypatch.setattr(sequences, "TILE", 3)
    assert sorted(map(tuple, search.near_by_edits(df, "id", table, 3.0).collect())) == whole


def test_medoids_recover_planted_types(spark):
    rng = random.Random(11)
    bases = [[("a", 30)], [("b", 10), ("c", 25)], [("d", 12), ("a", 8), ("d", 14)]]
    found, kind = {}, {}
    for i in range(240):
        t = rng.randrange(3)
        s = tuple(random_spells(rng, [(q, n + rng.randrange(-4, 5)) for q, n in bases[t]]))
        if s not in found:
            found[s], kind[f"s{i}"] = f"s{i}", t
    rows = [(i, list(s), 1 + rng.randrange(3)) for s, i in found.items()]
    df = spark.createDataFrame(rows, f"id string, spells array<struct<{SPELLS.replace(' ', ':').replace(',:', ',')}>>, copies long")
    costs = cost_rows(random.Random(2))
    table = spark.createDataFrame(costs, "a string, b string, cost double")
    prices = search.EditCosts.of(table)
    coded = [prices.coded([{"state": q, "length": n} for _, q, n in s]) for _, s, _ in rows]
    n, weight = len(rows), np.array([r[2] for r in rows], float)
    d = np.zeros((n, n))
    for i in range(n):
        d[i] = search.distances([(coded[i], c) for c in coded], prices, "om_slen")
    best = min((weight * d[:, list(c)].min(axis=1)).sum() for c in itertools.combinations(range(0, n, 3), 3))
    swapped = search.partition_around_medoids(d, weight, 3)
    best = min(best, (weight * d[:, swapped].min(axis=1)).sum())
    for sample in (300, 120):  # all sequences, and a draw with rounds after it
        out = search.medoid_types(df, "id", "copies", table, 3, sample=sample).collect()
        assert len(out) == n
        place = {r[0]: k for k, r in enumerate(rows)}
        cost = sum(weight[place[r["id"]]] * r["distance"] for r in out)
        assert cost <= best * (1.0 + (1e-9 if sample == 300 else 0.02)), (cost, best)
        types = {}
        for r in out:
            types.setdefault(r["type"], set()).add(kind[r["id"]])
            assert abs(r["distance"] - d[place[r["id"]], [place[m] for m in {q["medoid"] for q in out}]].min()) < 1e-9
        assert len(types) == 3 and all(len(t) == 1 for t in types.values())
        heavy = {t: sum(weight[place[r["id"]]] for r in out if r["type"] == t) for t in types}
        assert [t for t in sorted(heavy, key=lambda t: -heavy[t])] == ["Type 1", "Type 2", "Type 3"]


def test_medoids_of_small_tables(spark, seqs):
    _, df = seqs
    table = spark.createDataFrame(cost_rows(random.Random(2)), "a string, b string, cost double")
    from pyspark.sql import functions as F

    one = df.limit(1).withColumn("copies", F.lit(9))
    assert [r["type"] for r in search.medoid_types(one, "id", "copies", table, 4).collect()] == ["Type 1"]
    assert search.medoid_types(one.where("false"), "id", "copies", table, 4).count() == 0
    assert search.near_by_edits(one, "id", table, 1.0).count() == 0 and search.near_by_edits(one.where("false"), "id", table, 1.0).count() == 0


@pytest.mark.parametrize("floor", [None, "4"])
def test_record_spells_equal_minutes(spark, floor):
    """Overlaps, equal starts, records inside others, gaps, empty and crowded minutes."""
    rng = random.Random(21)
    minute = 60_000_000
    rows = []
    for k in range(400):
        start = rng.randrange(0, 90 * minute)
        if rng.random() < 0.3:
            start -= start % minute
        rows.append((k % 9, start, start + rng.choice([-5, 0, 1, minute - 1, minute, 5 * minute, rng.randrange(30 * minute)]), rng.choice(STATES), k))
    rows += [(99, 5, 5, "a", 500), (98, 0, 3 * minute, "a", 501), (98, 50 * minute, 51 * minute, "a", 502), (98, 3 * minute + 5, 9 * minute, "a", 503)]
    rows += [(97, 0, 10 * minute, STATES[i % 2], 600 + i) for i in range(300)]  # a third of all rows in one minute
    df = spark.createDataFrame(rows, "id int, s long, e long, state string, tie int").where("e >= s - 5")
    if floor:
        spark.conf.set("strandwise.hot.minRows", floor)
    try:
        minutes = sessions.minute_states(df, ["id"], "s", "e", "state", "tie").cache()
        expected = sequences.spells(minutes, ["id"])
        got = sessions.record_spells(df, ["id"], "s", "e", "state", "tie").cache()

        def norm(out):
            return sorted((r["id"], r["start"], r["state"], r["length"]) for r in out.collect())

        assert norm(got) == norm(expected)

        def table(out):
            return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(out.columns))) for r in out.collect())

        assert table(sequences.spell_distribution(got)) == table(sequences.state_distribution(minutes))
        assert table(sequences.spell_distribution(got, ["id"])) == table(sequences.state_distribution(minutes, ["id"]))
        assert table(sequences.spell_modal_state(got)) == table(sequences.modal_state(minutes))
        assert table(sequences.spell_transitions(got, ["id"])) == table(sequences.transition_rates(minutes, ["id"]))
        assert table(sequences.spell_shares(got, ["id"], STATES)) == table(sequences.state_shares(minutes, ["id"], STATES))
    finally:
        spark.conf.unset("strandwise.hot.minRows")


def test_only_what_histograms_leave_meets_the_pivots(spark, monkeypatch):
    """400 sequences of unlike lengths and two close ones: two are aligned with the pivots, before it was all."""
    kind = "id string, spells array<struct<start:int,state:string,length:int>>"
    rows = [(f"s{i}", [(0, "a", 50 * i + 1), (50 * i + 1, "b", 7)]) for i in range(400)]
    df = spark.createDataFrame([*rows, ("t", [(0, "a", 102), (102, "b", 7)])], kind)
    table = spark.createDataFrame(cost_rows(random.Random(6)), "a string, b string, cost double")
    asked, far = [], search._far
    monkeypatch.setattr(search, "_far", lambda lists, *a: asked.append(lists.count()) or far(lists, *a))
    got = search.near_by_edits(df, "id", table, 3.0).collect()
    assert [(r["a"], r["b"]) for r in got] == [("s2", "t")] and asked == [2]


def test_spells_and_holes_from_one_pass(spark):
    """The records of a session are sorted and cut once, not once for spells and once for holes."""
    rows = [(1, 0, 120, "x", 1), (1, 60, 90, "y", 2), (1, 600, 660, "y", 3), (1, 660, 900, "y", 4), (2, 0, 10, "x", 5), (2, 90, 91, "x", 6)]
    df = spark.createDataFrame([(k, s * 10**6, e * 10**6, v, t) for k, s, e, v, t in rows], "k int, s long, e long, v string, t int")
    out = sessions.record_spells(df, ["k"], "s", "e", "v", "t")
    got = sorted((r["k"], r["start"], r["state"], r["length"]) for r in out.collect())
    assert got == [(1, 0, "x", 3), (1, 3, "missing", 7), (1, 10, "y", 6), (2, 0, "x", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_sessions_are_found_once(spark, monkeypatch):
    """The typed queries take records, spells and types from one set of sessions."""
    from strandwise.catalog import neighbours, sleep

    made, find = [], sleep._sessions
    for place in (neighbours, sleep):
        monkeypatch.setattr(place, "_sessions", lambda *a: made.append(1) or find(*a))
    monkeypatch.setattr(neighbours.sequence_search, "medoid_types", lambda distinct, *a: distinct.selectExpr("rep", "'Type 1' type", "rep medoid", "0D distance"))
    events = [(i, i // 4, "view" if i % 3 else "click", i % 4 * 20, 5.0 + i % 7) for i in range(40)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, state string, at long, value double").selectExpr(
        "user_id", "event_id", "state", "at * 60000000 start_us", "cast((at + value) * 60000000 as long) end_us")
    for place in (neighbours, sleep):
        monkeypatch.setattr(place, "event_records", lambda *a: frame, raising=False)
    for name in ("state_distribution_by_cluster", "cluster_profile"):
        made.clear()
        assert neighbours.QUERIES[name](spark, "").count() > 0 and made == [1]
