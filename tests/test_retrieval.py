"""Outcomes of retrieval on a few chunks."""

import pytest

from lectern.plans.retrieval import Constraints, retrieve

CHUNKS = [
    ("a", 0, 2015, "The rebate is paid."), ("a", 1, 2015, "Caregivers ask for it."), ("b", 0, 2016, "A permit for caregivers, as in 1999."), ("c", 0, 2016, "The rebate was wrong: it should be ten. Caregivers, caregivers."),
    ("d", 0, 2017, "The rebate is ten."), ("e", 0, 2017, None), ("f", 0, 2017, ""),
]
PAIRS = [("c", "d"), ("c", "d"), ("b", None)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(CHUNKS, "turn_key string, part int, year int, cite_text string"), spark.createDataFrame(PAIRS, "announce_turn string, supersede_turn string")


@pytest.mark.parametrize(
    ("question", "status", "turns"),
    [
        ("What rebate did caregivers get between 2015 and 2017?", "answered", ["d", "c", "a"]), ("What was the rebate in 2015?", "answered", ["a"]), ("What of the permit in 1999?", "answered", ["b"]), ("What of caregivers in 1905?", "fell_back", None),
        ("Was there a permit in 2015?", "refused_conjunction", []), ("Why caregivers?", "fell_back", None), ("Did zebras outrun quasars?", "refused_no_terms", []), ("What rebate of zebras in 2015?", "answered", ["a"]), ("Zebras in 2015?", "refused_no_terms", []),
    ],
)
def test_outcomes(tables, question, status, turns):
    rows = retrieve(*tables, question).orderBy("place").collect()
    assert {r.status for r in rows} == {status}
    if turns is not None:
        found = [r.turn_key for r in rows if r.turn_key]
        assert (found == turns) if len(turns) < 3 else set(found) == set(turns)
    if status == "fell_back":
        assert {r.turn_key for r in rows} == {"a", "b", "c", "d", "f"}
    if question.startswith("What rebate did"):  # the correction stands directly above what it corrects
        order = [r.turn_key for r in rows]
        assert order.index("d") == order.index("c") - 1


def test_no_chunks_at_all(tables):
    assert [(r.status, r.turn_key) for r in retrieve(tables[0].limit(0), tables[1], "What was the rebate in 2015?").collect()] == [("refused_no_terms", None)]


def test_constraints():
    c = Constraints("What rebate, and which permit, between 2015 and 2017 or in 1999?")
    assert c.years == [1999, 2015, 2016, 2017] and c.subject == "rebate" and "permit," in c.terms and "permit" in c.tokens
