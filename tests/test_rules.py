"""Rules on texts that the stored tables don't have: what is expected, and the same rows by SQL."""

import datetime as dt
import json

import duckdb
import pytest

from lectern.functions.recovery import closed_objects, recover
from lectern.plans.rules import R
from test_oracles import rows_of

D = dt.datetime(2024, 1, 1)
BACK = "Yes, Speaker. I misspoke earlier. I said that the statutory minimum annual leave goes up to a cap of 14 years. I meant to say so."
TURNS = [
    # report, turn, speaker, is_procedural, text
    ("r1", 0, "Mr Speaker", False, "Order, order. Ms Lee, you have a clarification to make?"),
    ("r1", 1, "Ms Lee Hui", False, BACK),
    ("r1", 2, "Ms Lee Hui", False, "I said that the resale grant is up to $180,000 from this year on for all first-timer families. As I said, this is known to everyone in this place."),
    ("r1", 3, "Ms Lee Hui", False, "We talk of it today. As I mentioned earlier, the cap is $500. i was wrong. I stated it here."),
    ("r1", 4, None, False, "I meant to say 14 days. As mentioned, nothing follows from that."),
    ("r1", 5, None, None, "The Ministry will subsidise 40 per cent of the cost by 2027, and we intend to fund 3 million dollars of relief for it. Sir, this is a courtesy that nobody needs to read in full."),
    ("r1", 6, "Mr Tan", True, "The Government will introduce a scheme for every resident who has asked for one until today."),
    ("r1", 7, "Mr Tan", False, "The Ministry will subsidise 40 per cent of the cost by 2027, and we intend to fund 3 million dollars of relief for it. A cap of $500 will be effective by 2027 for the whole of the eligible group."),
    ("r2", 0, "Mr Tan (for the Minister for Health)", False, "I beg to move, That the Bill be now read a second time."),
    ("r2", 1, "Mr Speaker", False, 'There are 72 "Ayes", 9 "Noes", and no "Abstentions". There are 72 "Ayes", 9 "Noes", and no "Abstentions". There are 71 "Ayes", 10 "Noes".'),
    ("r2", 2, "Mr Speaker", False, 'There are 77 "Ayes", six "Noes", and zero "Abstentions". There are 80 "Ayes, zero "Noes". There are many "Ayes", 3 "Noes". There are twenty-one "Ayes", 3 "Noes". There is one "Aye", Nine "Noes" and three "Abstentions".'),
    ("r3", 0, "Ms Lee Hui", False, "asked the Minister for Health what is done."),
    ("r3", 1, "The Minister for Health (Mr Tan Wei)", False, "May I have your permission to answer Question Nos 1 to 3 together?"),
    ("r3", 2, "The Minister for Health (Mr Tan Wei)", False, "We do all that can be done and more than that in every year."),
    ("r3", 3, "Mr Speaker", False, "Ms Lee."),
    ("r3", 4, "Ms Lee Hui", False, "I ask again whether anything at all is done about it."),
    ("r3", 5, "Mr Tan Wei", False, "It is done, as I have said it is done, and so on."),
    ("r3", 6, "Mr Tan Wei", False, "Yes."),
    ("r4", 0, "Mr Ong", False, "There will be a sitting from 24 February to 6 March 2026. And a sitting on 9 April 2026."),
    ("r4", 1, "Mr Ong", False, "A sitting from 29  December to 2 January 2026 is announced."),
    ("r4", 2, "Mr Ong", False, "The sitting on 3 May 2024 and the sitting on 3 May 2024 and the sitting on 31 June 2024."),
    ("r4", 3, "Mr Ong", False, "The House is adjourned to 7 OCTOBER 2024. It stands adjourned to 8 October 2024."),
    ("r4", 4, "Mr Ong", False, "Adjourned to a date to be fixed."), ("r4", 5, "Mr Ong", False, "adjourned to some day"), ("r4", 6, "Mr Ong", False, "No sitting."),
    ("r4", 7, "Mr Ong", False, "sitting from 31 February to 6 March 2026"), ("r4", 8, "Mr Ong", False, "sitting from 2 March 2026 to 1 March 2026"), ("r4", 9, "", False, ""), ("r4", 10, None, False, None),
]
ROSTER = [("m:1", "Tan Wei", "former"), ("m:2", "Tan  Wei", "current"), ("m:3", "Lee Hui Ann", "current"), ("m:4", "Ong Kim", "current"), ("m:5", "Ong Bee Kim", "current"), ("m:6", None, "current")]
SPEAKERS = ["Mr Tan Wei (Bedok)", "The Minister for Health (Mr Tan Wei)", "Tan Wei (for the Minister)", "​Lee Hui Ann", "Lee X Ann", "Ong Y Kim", "Hon Members", "[Mr Speaker in the Chair]", "Mdm Deputy Speaker (Ms Lee Hui Ann)", "The Chairman", "", "Nobody Known", "(Ms Lee Hui Ann)"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rules"))
    rows = [(f"{r}#t{n:02}", r, n, s, p, t, len((t or "").split()), 2024, D) for r, n, s, p, t in TURNS]
    rows += [(f"s{i}#t0", f"s{i}", 0, s, False, None, 0, 2024, D) for i, s in enumerate(SPEAKERS)]
    spark.createDataFrame(rows, "key string, report_id string, turn int, speaker string, is_procedural boolean, text string, words int, year int, loaded_at timestamp_ntz").write.parquet(f"{d}/turn.parquet")
    reports = [("r1", "motion", "Motions", None), ("r2", "bill", "Second Reading Bills", "A B, C D"), ("r3", "oral", "Oral Answers to Questions", None), ("r5", "bill", "Bills Introduced", " Mr Ong, Ms Lee"), ("r6", "bill", "Bills Introduced", "")]
    spark.createDataFrame([(*r, D) for r in reports], "report_id string, group_name string, report_type string, mp_names string, loaded_at timestamp_ntz").write.parquet(f"{d}/report.parquet")
    spark.createDataFrame(ROSTER, "member_id string, full_name string, status string").write.parquet(f"{d}/roster.parquet")
    spark.createDataFrame([("c", D)], "id string, loaded_at timestamp_ntz").write.parquet(f"{d}/chunk.parquet")
    for t in ("summary_item", "summary_item_report", "supersession"):
        spark.createDataFrame([("i",)], "item_id string").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def duck_of(folder):
    con = duckdb.connect()
    for t in ("turn", "report", "roster", "chunk", "summary_item", "summary_item_report", "supersession"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", list(R.sql))
def test_rules_give_the_rows_of_their_sql(spark, folder, duck_of, name):
    df = R.plans[name](spark, folder)
    cur = duck_of.execute(R.sql[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    rows = rows_of(df.columns, df.collect())
    assert rows and rows == rows_of(names, cur.fetchall())


def result(spark, folder, name, *cols):
    return {tuple(r[c] for c in cols) for r in R.plans[name](spark, folder).collect()}


def test_what_a_turn_takes_back(spark, folder):
    got = {k: [r for _, r in sorted(v)] for k, v in group(result(spark, folder, "significance_turn", "key", "i", "reason")).items()}
    assert got["r1#t00"] == ["chair_housekeeping", "chair_housekeeping"]
    # the claim with a figure goes with the correction beside it, and only beside it
    assert got["r1#t01"] == [None, "self_correction", "self_correction", "self_correction"]
    assert got["r1#t02"] == [None, "restatement"]
    # a correction only the finer split sees: what points back goes by it
    assert got["r1#t03"] == [None, "self_correction", "restatement"]
    # fourteen days is substance: it stays, and what stands beside it is judged by itself
    assert got["r1#t04"] == [None, "restatement"]
    single = {k: [r for _, r in sorted(v)] for k, v in group(result(spark, folder, "significance_single", "key", "i", "reason")).items()}
    assert single["r1#t01"] == [None, "self_correction", None, "self_correction"]
    assert result(spark, folder, "correction_pairs", "key", "i", "anchor") == {("r1#t01", 2, 1), ("r1#t01", 2, 3)}


def group(rows):
    out: dict = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


def test_selection(spark, folder):
    got = sorted((r["pass"], r.key, r.i) for r in R.plans["select_two_pass"](spark, folder).where("report_id = 'r1'").collect())
    # the procedural turn gives nothing, a courtesy neither; words that are taken don't come again from elsewhere
    assert ("r1#t06", 0) not in {x[1:] for x in got} and (0, "r1#t05", 0) in got and ("r1#t05", 1) not in {x[1:] for x in got}
    assert len([x for x in got if x[1] == "r1#t07"]) == 2


def test_divisions(spark, folder):
    got = result(spark, folder, "divisions_extract", "key", "pos", "ayes", "noes", "abstentions")
    assert got == {("r2#t01", 0, 72, 9, 0), ("r2#t01", 1, 72, 9, 0), ("r2#t01", 2, 71, 10, None), ("r2#t02", 0, 77, 6, 0), ("r2#t02", 1, 80, 0, None), ("r2#t02", 3, 1, 9, 3)}
    assert result(spark, folder, "divisions_dedup", "key", "ayes", "n") == {("r2#t01", 72, 2), ("r2#t01", 71, 1), ("r2#t02", 77, 1), ("r2#t02", 80, 1), ("r2#t02", 1, 1)}


def test_announced_days(spark, folder):
    got = group(result(spark, folder, "announce_dates", "key", "day", "note"))
    assert sorted(x for x, _ in got["r4#t00"]) == ["2026-02-24", "2026-02-25", "2026-02-26", "2026-02-27", "2026-03-02", "2026-03-03", "2026-03-04", "2026-03-05", "2026-03-06"]
    assert sorted(x for x, _ in got["r4#t01"]) == ["2025-12-29", "2025-12-30", "2025-12-31", "2026-01-01", "2026-01-02"]
    assert got["r4#t02"] == [("2024-05-03", None)] and got["r4#t03"] == [("2024-10-07", None)]
    assert got["r4#t04"] == [(None, "to_be_fixed")] and got["r4#t05"] == [(None, "not_read")] and "r4#t06" not in got
    assert got["r4#t07"] == [(None, "not_read")] and got["r4#t08"] == [("2026-03-02", None)]


def test_members(spark, folder):
    got = {r.speaker: (r.kind, r.member_id) for r in R.plans["resolve_members"](spark, folder).collect()}
    assert got["Mr Tan Wei (Bedok)"] == got["The Minister for Health (Mr Tan Wei)"] == got["Tan Wei (for the Minister)"] == ("MEMBER", "m:2")
    assert got["​Lee Hui Ann"] == got["Lee X Ann"] == ("MEMBER", "m:3") and got["Ong Y Kim"] == ("UNRESOLVED", None)
    assert got["Hon Members"] == got["[Mr Speaker in the Chair]"] == got["(Ms Lee Hui Ann)"] == ("NON_PERSON", None)
    assert got["Mdm Deputy Speaker (Ms Lee Hui Ann)"] == got["The Chairman"] == ("OFFICER", None) and got[""] == got["Nobody Known"] == ("UNRESOLVED", None)


def test_questions_and_sponsors(spark, folder):
    assert result(spark, folder, "qa_mapping", "report_id", "answerer", "question", "response", "more_answers", "more_questions") == {("r3", "Mr Tan Wei", "r3#t00", "r3#t02", 1, 1)}
    assert result(spark, folder, "sponsor_of", "report_id", "sponsor") == {("r1", None), ("r2", "Mr Tan (for the Minister for Health)"), ("r5", "Mr Ong"), ("r6", None)}
    assert ("r3", "r3#t00", True) in result(spark, folder, "question_open", "report_id", "key", "is_question")


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"k": 1}', [{"k": 1}]), ('```json\n{"k": {"a": [1, "}"]}}\n```', [{"k": {"a": [1, "}"]}}]), ('Here it is: {"k": 2} and {"k": 3}.', [{"k": 2}, {"k": 3}]), ('{"k": 1},\n{"k": 2}\nnot this\n{broken', [{"k": 1}, {"k": 2}]),
        ('{"what": "x", "points": [{"a": 1}, {"a": "}\\"{"}, {"a": 3', [{"points": [{"a": 1}, {"a": '}"{'}], "cut_off": True}]), ('{"points": [{"a"', []), ("[1, 2]", []), ("nothing", []), ("", []), (None, []), ('{"a": 1', []), ("}{", []),
    ],
)
def test_recovered_replies(reply, expected):
    assert recover(reply) == expected


def test_recovery_of_long_replies_ends():
    assert recover("{" * 200_000) == [] and recover('{"a":' * 100_000) == []
    assert len(closed_objects('x {"a": 1} ' * 50_000)) == 50_000
    assert json.loads(json.dumps(recover('text {"é": "ü"}')[0])) == {"é": "ü"}
