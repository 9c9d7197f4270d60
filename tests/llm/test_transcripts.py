import datetime as dt
import time

import pytest

from lectern.llm import transcripts
from lectern.llm.transcripts import clean_turns, speeches

D = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize(
    ("speaker", "text", "expected"),
    [
        (None, "<15:50> Mdm Speaker: Er Dr Richard Chuay.", [("Mdm Speaker", "Er Dr Richard Chuay.")]),
        (None, "(3:50 PM) Er Dr Richard Chuay: A flat eh... fee um, is *laughs* not, mm, \"fickle\".", [("Er Dr Richard Chuay", 'A flat fee is not, "fickle".')]),
        ("Mr A Tan:", "It [16:08:28] closed at 8.29 p.m. (see Table hmm, 3.1) [a [nested] note]. MDM SPEAKER: Order.", [("Mr A Tan:", "It closed at 8.29 p.m. (see Table 3.1)."), ("MDM SPEAKER", "Order.")]),
        (None, "MR A TAN (LORONG BATIK) - It opened. Mr Speaker :\nOrder.", [("MR A TAN (LORONG BATIK)", "It opened."), ("Mr Speaker", "Order.")]),
        ("X", "(In English): I ask for three things: (a) one; (b) two.", [("X", "I ask for three things: (a) one; (b) two.")]),
        (None, "Order. Ms Lee Hui: She put it plainly: \"No.\"", [(None, "Order."), ("Ms Lee Hui", 'She put it plainly: "No."')]),
        (None, "(Interjections from the floor.)", []), (None, "[(proc text) Clause 2 ordered to stand part. (proc text)]", []), (None, "(Order read for 3 items.)", []), ("A", "[Applause]", []), ("A", None, []), ("A", "", []), ("A", "Um, er...", []),
        # a label doesn't reach back over the end of a sentence
        ("Mdm Speaker", "Order. The Minister for Health (Ms Lee): Yes.", [("Mdm Speaker", "Order."), ("The Minister for Health (Ms Lee)", "Yes.")]),
        ("X", "There are others waiting. THE MINISTER FOR HEALTH (MS LEE HUI) - Yes.", [("X", "There are others waiting."), ("THE MINISTER FOR HEALTH (MS LEE HUI)", "Yes.")]),
        ("X", "I met Dr. Quahn of the Select Committee last July. MR A B TAN: No.", [("X", "I met Dr. Quahn of the Select Committee last July."), ("MR A B TAN", "No.")]),
        (None, "Mdm Deputy Speaker (Ms Lee): Mr. Tan Wei (Bedok): One. Kirthanan s/o Sockalan: two.", [("Mr. Tan Wei (Bedok)", "One."), ("Kirthanan s/o Sockalan", "two.")]),
        ("A", "Er Dr Tan said er, this. Er, The end.", [("A", "Er Dr Tan said this. The end.")]),
        ("The Minister for Health (Ms Lee)", "Und​er section 3A(45), ok. [unclosed", [("The Minister for Health (Ms Lee)", "Under section 3A(45), ok. [unclosed")]),
    ],
)
def test_rows(speaker, text, expected):
    assert [(label, said) for label, _, said in speeches(speaker, text)] == expected


@pytest.mark.parametrize("text", ["[" * 1_000_000, "[" * 500_000 + "x" + "]" * 500_000, "(" * 300_000, "<" * 200_000 + " word", "[a (b {c " * 50_000, "A. " * 100_000, "Mr A B: " * 20_000, "*" * 100_001])
def test_deep_and_unclosed_brackets_end(text):
    start = time.perf_counter()
    speeches("A", text)
    assert time.perf_counter() - start < 30


def test_nested_notes_are_left_out():
    assert speeches("A", "One " + "[" * 500 + "x" + "]" * 500 + " two [ three.") == [("A", False, "One two [ three.")]


def test_long_row():
    assert len(speeches("A", "word [note] um, " * 20_000)[0][2].split()) == 20_000


def test_turns(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 2)
    roster = spark.createDataFrame([("m:a", "Tan Hui Ann", "Mr", "X"), ("m:b", "Lee Kow Boon", "Ms", "Y")], "member_id string, full_name string, honorific string, constituency string")
    rows = [
        (0, "Mr Speaker", "Order."), (1, None, "Mr Tan Hui Ann."), (2, "Mr Tan Hui Ann", "One two."), (3, None, "[Applause]"), (4, None, "Three. Mr Speaker: Order. Ms Lee Kow Boon: Four five."), (5, "TAN HUI ANN:", "Um, six."), (6, None, None), (7, None, "Seven."),
        (8, "Ms Lee Kow Boon", "(Laughter)"), (9, None, "Eight."), (10, "Hon Members", "Nay!"), (11, None, "Still they."), (12, "Mdm Speaker", "Out: Big Words: here."), (12, "Mdm Speaker", "Out: Big Words: here."),
    ]
    turns = spark.createDataFrame([(f"d#t{n}", "d", n, s, t, D, "x") for n, s, t in rows] + [("f#t0", "f", 0, "Mr Tan Hui Ann", "Final.", D, "x"), ("d2#t0", "d2", 0, None, "Nobody yet.", D, "x")], "key string, report_id string, turn int, speaker string, text string, loaded_at timestamp, who string")
    reports = spark.createDataFrame([("d", "draft", D), ("d2", "draft", D), ("f", "sprs3", D)], "report_id string, report_version string, loaded_at timestamp")
    got = sorted((r.report_id, r.first_turn, r.nth, r.speaker_id, r.n_words, r.text) for r in clean_turns(turns, reports, roster).collect())
    assert got == [
        ("d", 0, 0, "chair", 5, "Order. Mr Tan Hui Ann."), ("d", 2, 0, "m:a", 3, "One two. Three."), ("d", 4, 0, "chair", 1, "Order."), ("d", 4, 1, "m:b", 2, "Four five."), ("d", 5, 0, "m:a", 3, "six. Seven. Eight."),
        ("d", 10, 0, None, 3, "Nay! Still they."), ("d", 12, 0, "chair", 4, "Out: Big Words: here."), ("d2", 0, 0, None, 2, "Nobody yet."),
    ]
    assert clean_turns(turns.limit(0), reports, roster).count() == 0
