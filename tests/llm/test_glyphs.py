import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.glyphs import flat_form, same_look, transducer, look_classes

look = transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｍr．  Sее​tοw", "Mr. Seetow"), ("café", "café"), ("“fine”…", '"fine"...'), ("⼩⼈", "小人"), ("e­nd", "end"), ("a – b‑c", "a - b-c"),
        ("ﬁve ﬀ", "five ff"), ("  x \n\n y ", "x y"), ("கொ", "கொ"), ("Ａ１％", "A1%"), ("é", "e​́"),
    ],
)
def test_same_look(a, b):
    assert look(a) == look(b)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("cafe", "café"), ("a.b", "a,b"), ("x2", "x²"), ("there fore", "therefore")])
def test_other_look(a, b):
    assert look(a) != look(b)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_one_pass_is_enough(t):
    assert look(look(t)) == look(t)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_flat_form_keeps_places(t):
    flat, at = flat_form(t)
    assert len(flat) == (len(t) if at is None else len(at))


TURN = "key string, report_id string, text string, loaded_at timestamp, look string, t string"
CHUNK = "id string, turn_key string, cite_text string, key string"
D = lambda n: dt.datetime(2020, 1, n)


def found(spark, turns, chunks, reports=(("r", "final"), ("d", "draft"))):
    t = spark.createDataFrame(turns, TURN)
    c = spark.createDataFrame(chunks, CHUNK)
    r = spark.createDataFrame([(a, b, D(1)) for a, b in reports], "report_id string, report_version string, loaded_at timestamp")
    return sorted(map(tuple, same_look(t, c, r).collect()))


def test_pairs(spark):
    t = lambda key, rid, text, n=1: (key, rid, text, D(n), "", "")
    turns = [
        t("r#t0", "r", "Order."), t("r#t1", "r", "Order."), t("r#t2", "r", "Оrder."), t("r#t3", "r", "order."), t("r#t4", "r", None), t("r#t5", "r", ""), t("r#t6", "r", " "),
        t("d#t0", "d", "Order."), t("d#t1", "d", "Оrder."), t("x#t1", "x", "Order."), t("r#t7", "r", "old text"), t("r#t7", "r", "He said “no” to it.", 2), t("r#t2", "r", "Оrder."),
    ]
    chunks = [("c0", "R#T7 ", 'said "no"', "k"), ("c0", "R#T7 ", 'said "no"', "k"), ("c1", "r#t7", "said “no”", "k"), ("c2", "r#t7", "other", "k"), ("c3", "none", 'x"', "k"), ("c4", "r#t7", None, "k"), ("c5", "r#t7", "", "k"), ("c6", "d#t0", "Оrder.", "k"), ("c7", None, "x", "k")]
    assert found(spark, turns, chunks) == [("c0", "r#t7"), ("r#t0", "r#t2"), ("r#t1", "r#t2"), ("r#t5", "r#t6")]


def test_empty_tables_and_long_text(spark):
    assert found(spark, [], []) == []
    long = "word " * 200_000
    assert found(spark, [("r#t0", "r", long, None, "", ""), ("r#t1", "r", long.replace(" ", "\u00a0"), None, "", "")], []) == [("r#t0", "r#t1")]


def test_clusters_are_compiled_and_agree():
    t = transducer()
    # Latin and Cyrillic letters, composed or not, marks in either order
    assert t("ё") == t("ё") == t("ë") == t("ë") == "ë"
    assert t("ệ") == t("ệ") == t("ệ") == t("ệ") == t("ệ") == "ệ"
    assert t("e‍́") == "é" and t("q̣́") == t("q̣́")
    assert len(t.clusters) > 1000 and all(t(v) == v for v in t.clusters.values())
    with pytest.raises(ValueError, match="two images"):
        t._agree({"é": "é"}, "é", "e")


def test_classes(spark):
    rows = [("r", "a", "x y"), ("r", "b", "x  y"), ("r", "c", "x  y"), ("r", "d", "z"), ("s", "e", "x y"), ("r", "f", None)]
    got = look_classes(spark.createDataFrame(rows, "__report string, key string, text string")).collect()
    assert sorted((r["__report"], r.n, r.key) for r in got) == [("r", 1, "a"), ("r", 2, "b")] and len({r.look for r in got}) == 1
