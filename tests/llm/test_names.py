import random

import pytest

from lectern.llm.names import CONNECTORS, SHORT_FORMS, deletes, distance, label_cost, name_words, needed_forms, parse_label, reach, resolve_labels, speaker_members

ROSTER = [
    ("m:alex", "Alexander Chuay Rui Jin", "Mr", "Holm Green"), ("m:hoe", "Chuay Rui Hoe", "Ms", "Marsh Hill"), ("m:suhaidan", "Nur Suhaidan binte Karimun", "Ms", "Bukit Dara"), ("m:kirthanan", "Kirthanan s/o Sockalan", "Er Dr", "Kampong Awan"),
    ("m:peggy", "Margaret Zhouli Ming Hui", "Ms", "Teluk Mas"), ("m:hamdeen", "Muhammad Hamdeen bin Jafrudin", "Dr", "Pasir Intan"), ("m:seetow", "Seetow Choo Zhen", "Dr", "Teluk Mas"), ("m:seetow2", "Seetow Cho Zhan", "Mr", "Upper Serai"),
]
CASES = {
    "Mr Alexander Chuay Rui Jin (Holm Green)": "m:alex", "CHUAY RUI JIN, ALEXANDER": "m:alex", "Alex Chuay Rui Jin": "m:alex", "Mr Chuay Rui Jin (Alex)": "m:alex", "mr aelxander chuay riu jin": "m:alex", "Mr A. Chuay R.J.": "m:alex", "Chuay Ruijin": "m:alex",
    "[2.03 pm] Ms Chuay Rui-Hoe:": "m:hoe", "Rui Hoe Chuay": "m:hoe", "Chuay R H": "m:hoe", "﻿Ms  Nur Suhaidan bte Karimun": "m:suhaidan", "KARIMUN, NUR SUHAIDAN": "m:suhaidan", "Nur Suhaidan bnite Krimun": "m:suhaidan",
    "Er Dr Kirthanan son of Sockalan": "m:kirthanan", "K Sockalan": "m:kirthanan", "The Minister for Health (Ms Peggy Zhouli Ming Hui)": "m:peggy", "Mohd Hamdeen bin Jafrudin (for the Minister for Trade)": "m:hamdeen", "Margaret Zhouli": "m:peggy", "Seetow Choo Zhen": "m:seetow", "Dr Seetow Cho Zhan": "m:seetow2",
}
NOBODY = ["Mr Speaker", "Mdm Deputy Speaker (Ms Chuay Rui Hoe)", "The Chairman:", "Hon Members", "The Minister for Health", "", "  ", None, "Chuay Hoe Rui", "Hamdeen bin Karimun", "Ms Zhouli Rui Hoe", "Robert Chuay Rui Jin", "[Interruption]"]


def test_labels(spark):
    roster = spark.createDataFrame(ROSTER, "member_id string, full_name string, honorific string, constituency string")
    turns = spark.createDataFrame([(x, x) for x in [*CASES, *NOBODY, *CASES]], "speaker string, member_id string")
    assert {r.speaker: r.member_id for r in speaker_members(turns, roster).collect()} == CASES
    kinds = {r.label: r.kind for r in resolve_labels(turns.select("speaker"), roster).collect()}
    assert kinds["Mr Speaker"] == kinds["The Chairman:"] == kinds["Mdm Deputy Speaker (Ms Chuay Rui Hoe)"] == "chair"
    assert speaker_members(turns.limit(0), roster).count() == 0
    assert speaker_members(turns, roster.limit(0)).count() == 0


def test_the_index_finds_all_that_brute_force_does(spark):
    roster = spark.createDataFrame(ROSTER, "member_id string, full_name string, honorific string, constituency string")
    labels = [*CASES, *[x for x in NOBODY if x]]
    got = {r.label: r.member_id for r in resolve_labels(spark.createDataFrame([(x,) for x in labels], "s string"), roster).collect()}
    known = {w for r in ROSTER for w in name_words(r[1])}
    for label in labels:
        kind, words, nick, _ = parse_label(label)
        costs = {m: c for m, n, *_ in ROSTER if kind == "name" and (c := label_cost(words, nick, n, frozenset(w for w in words if w in known))) is not None}
        best = [m for m, c in costs.items() if c == min(costs.values())]
        assert got[label] == (best[0] if len(best) == 1 else None)


def written(rng, name):
    """A way in which someone might write a name: other order, initials, split and joined words, slips."""
    words = name_words(name)
    at = next((i for i, w in enumerate(words) if w in CONNECTORS), None)
    if len(words) > 1 and rng.random() < 0.5:
        k = rng.randrange(1, len(words)) if at is None else at + 1
        words = words[k:] + ([words[at]] if at is not None and rng.random() < 0.7 else []) + words[: k if at is None else at]
    out = []
    for w in words:
        kind = rng.randrange(9)
        if w in CONNECTORS:
            out.append(rng.choice([w, "bte", "bni", w]))
        elif kind == 0:
            out.append(w[0] + rng.choice([".", ""]))
        elif kind == 1 and len(w) > 3:
            k = rng.randrange(1, len(w) - 1)
            out += [w[:k], w[k:]]
        elif kind == 2 and len(w) > 2:
            k = rng.randrange(len(w) - 1)
            out.append(rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + rng.choice("aeknt") + w[k:]]))
        elif kind == 3 and out and out[-1] not in CONNECTORS:
            out[-1] += w
        elif kind == 4 and w in SHORT_FORMS:
            out.append(rng.choice(SHORT_FORMS[w].split()))
        else:
            out.append(w)
    return " ".join(out) + rng.choice(["", "", " (Bedok)", " (Alex)", ":"])


def test_the_index_is_exact_on_generated_labels(spark):
    """Whatever brute force reads as a member is found through the index, with initials, splits, joins and slips."""
    rows = spark.read.parquet("/root/testdata/sf0.01/roster.parquet").select("member_id", "full_name", "constituency").collect()
    odd = [("x1", "Tan Wei Siong", "A"), ("x2", "Tan Sri", "B"), ("x3", "Ban Low", "C"), ("x4", "Ong", "D"), ("x5", "Anna Maria Lopez De Cruz Lim", "E"), ("x6", "Li Bo", "F")]
    people = [tuple(r) for r in rows] + odd
    rng = random.Random(5)
    labels = {written(rng, rng.choice(people if rng.random() < 0.8 else odd)[1]) for _ in range(700)}
    for _, name, _ in rows[:60]:  # initials before the name that is written
        w = name_words(name)
        if len(w) > 2 and not set(w) & CONNECTORS:
            labels |= {f"{' '.join(x[0].upper() + '.' for x in w[1:])} {w[0]}", f"{w[0]} {'.'.join(x[0] for x in w[1:])}", f"{w[0]} {w[1][0]}{w[2][0]}"}
    labels |= {"Wei Siong Tan", "Tan Sri Tan Wei Siong", "A. Ban", "B Low", "Ban L.", "J. K. L. Ong", "Lim Anna Maria Lopez De Cruz", "L. Bo (Bedok)"}
    table = spark.createDataFrame(people, "member_id string, full_name string, constituency string")
    got = {r.label: r.member_id for r in resolve_labels(spark.createDataFrame([(x,) for x in labels], "s string"), table).collect()}
    vocabulary = {w for _, n, _ in people for w in name_words(n)}
    expected = {}
    for label in labels:
        kind, words, nick, seat = parse_label(label)
        known = frozenset(w for w in words if w in vocabulary)
        cost = {m: round(c, 3) - 0.05 * bool(seat and p.lower() in seat) for m, n, p in people if kind == "name" and (c := label_cost(words, nick, n, known)) is not None}
        best = [m for m, c in cost.items() if round(c - min(cost.values()), 6) == 0]
        expected[label] = best[0] if len(best) == 1 else None
    assert got == expected
    assert sum(v is not None for v in expected.values()) > 300
    assert expected["Wei Siong Tan"] == expected["Tan Sri Tan Wei Siong"] == "x1" and expected["A. Ban"] is None and expected["B Low"] == "x3" and expected["L. Bo (Bedok)"] == "x6"


def test_forms_of_must_read_places():
    assert {i for i, _ in needed_forms(["r", "j", "y", "chuay"])} == {3} and (3, "=ychuay") in needed_forms(["r", "j", "y", "chuay"])
    assert needed_forms(["ban", "l"]) == [(0, "=banl"), (0, "ban")] and needed_forms(["j", "k"]) == []


@pytest.mark.parametrize(("a", "b", "n"), [("chuay", "chuay", 0), ("chuay", "cuhay", 1), ("abc", "ab", 1), ("kitten", "sitting", 3), ("", "ab", 2)])
def test_distance(a, b, n):
    assert distance(a, b) == distance(b, a) == n


def test_words_near_each_other_share_a_key():
    for a, b in (("soongan", "sonogan"), ("velupathi", "veulpathii"), ("kiat", "kit")):
        assert distance(a, b) <= reach(a) and deletes(a, reach(a)) & deletes(b, reach(b))
    assert "s/o" in CONNECTORS
