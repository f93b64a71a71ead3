"""Terms found where the texts are read."""

from strandwise.operators import hits

ROWS = [(1, "alpha beta beta alphabet"), (2, None), (1, "gamma ray"), (3, "two  words, two words"), (None, "beta")]
TERMS = ["al", "beta", "amm", "two words", "phab", "", "zeta"]
FOUND = [(None, "beta"), (1, "al"), (1, "amm"), (1, "beta"), (1, "phab"), (3, "two words")]


def found(spark):
    docs = spark.createDataFrame(ROWS, "id long, text string")
    out = hits.term_hits(docs, "id", "text", spark.createDataFrame([(t,) for t in TERMS], "term string"))
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0] or 0, r[1]))


def test_a_small_vocabulary_moves_hits_only(spark, monkeypatch):
    """Neither pieces nor their matches are written or joined with the documents; before, both were."""
    for name in ("cut_lineage", "attach"):
        monkeypatch.setattr(hits, name, lambda *a: 1 / 0)
    assert found(spark) == FOUND


def test_a_large_vocabulary_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(hits, "BROADCAST_ROWS", 0)
    assert found(spark) == FOUND
