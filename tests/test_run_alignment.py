"""Alignments by runs against alignments position by position."""

import random
import time

import numpy as np
import pytest

from strandwise.operators import run_alignment, sequence_search, sequences

STATES = 4


def spells(rng, longest):
    states = [rng.randrange(STATES) for _ in range(rng.choice([1, 1, 2, 3, 6]))]
    return np.array(states), np.array([rng.randint(1, longest) for _ in states])


def by_positions(x, y, costs, slen):
    """One line for each position, as the distance is defined."""
    xs, ys = ([(s, n**-0.5 if slen else 1.0) for s, n in zip(*v) for _ in range(n)] for v in (x, y))
    row = np.concatenate([[0.0], np.cumsum([costs.indel * u for _, u in ys])])
    for s, t in xs:
        new = [row[0] + costs.indel * t]
        for j, (q, u) in enumerate(ys):
            new.append(min(row[j + 1] + costs.indel * t, new[-1] + costs.indel * u, row[j] + costs.sub[s, q] * (t + u) / 2))
        row = new
    return row[-1]


@pytest.mark.parametrize("measure", ["om", "om_slen"])
@pytest.mark.parametrize("cheap", [0.0, 3.0])
def test_runs_equal_positions(measure, cheap, monkeypatch):
    """Equal neighbours, dear and cheap substitutions, costs that differ by direction, few pairs a step."""
    rng = random.Random(4)
    sub = np.array([[0.0 if i == j else rng.uniform(cheap, 8) for j in range(STATES)] for i in range(STATES)])
    costs = sequence_search.EditCosts(tuple("abcd"), sub, float(sub.max()) / 2)
    pairs = [(spells(rng, n), spells(rng, m)) for n in (1, 4, 25) for m in (2, 30) for _ in range(40)]
    pairs += [(x, x) for x, _ in pairs[:20]]
    expected = np.array([by_positions(x, y, costs, measure == "om_slen") for x, y in pairs])
    for places in (run_alignment.BORDER_PLACES, 50):
        monkeypatch.setattr(run_alignment, "BORDER_PLACES", places)
        got = sequence_search.distances(pairs, costs, measure)
        assert np.abs(got - expected).max() < 1e-9 and not got[-20:].any()


def test_long_runs_are_not_worked_through_by_positions():
    """Two spells of 20,000 positions each have 400 million pairs of positions, but few borders."""
    costs = sequence_search.EditCosts(("a", "b"), np.array([[0.0, 3.0], [3.0, 0.0]]), 2.0)
    x, y = (np.array([0, 1]), np.array([20_000, 20_000])), (np.array([1, 0]), np.array([20_000, 20_000]))
    at = time.process_time()
    assert sequence_search.distances([(x, y)] * 8, costs, "om").tolist() == [80_000.0] * 8
    assert time.process_time() - at < 10


def test_four_distances_of_long_spells(spark):
    costs = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 3.0)], "a string, b string, cost double")
    kind = "array<struct<start int, state string, length int>>".replace(" int", ":int").replace(" string", ":string")
    x, y = [(0, "a", 15_000), (15_000, "b", 15_000)], [(0, "a", 15_000), (15_000, "b", 14_998)]
    df = spark.createDataFrame([(1, x, y), (2, x, x), (3, [(0, "a", 1)], [(0, "b", 1)])], f"id int, a {kind}, b {kind}")
    at = time.time()
    got = {r["id"]: r for r in sequences.edit_distances(df, ["id"], costs).collect()}
    assert time.time() - at < 60
    assert got[2]["om"] == got[2]["om_spell"] == 0 and abs(got[2]["om_slen"]) < 1e-9 and abs(got[2]["om_stran"]) < 1e-9
    # two positions of b go: at 1.5 each for om, half of it for stran, which has no move to pay; by the root of a long spell for slen
    assert abs(got[1]["om"] - 3.0) < 1e-9 and abs(got[1]["om_stran"] - 1.5) < 1e-9 and got[1]["om_spell"] == 1.0
    assert abs(got[1]["om_slen"] - 2 * 1.5 / 15_000**0.5) < 1e-6
    # apart by the state only: 0.5 * 3 and no move of either
    assert got[3]["om"] == 3.0 and got[3]["om_stran"] == 1.5


def test_borders_of_first_and_last_runs_take_no_windows(monkeypatch):
    """Two sequences of two runs: before, six borders were found by windows; the first are straight, the last are not needed."""
    seen, window = [], run_alignment._window_min
    monkeypatch.setattr(run_alignment, "_window_min", lambda *a: seen.append(1) or window(*a))
    costs = sequence_search.EditCosts(("a", "b"), np.array([[0.0, 3.0], [3.0, 0.0]]), 2.0)
    x, y = (np.array([0, 1]), np.array([5, 9])), (np.array([1, 0]), np.array([4, 8]))
    assert abs(sequence_search.distances([(x, y)], costs, "om")[0] - by_positions(x, y, costs, False)) < 1e-9 and not seen
