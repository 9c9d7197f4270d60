import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.pieces import RANGE, range_borders, stitched_units, text_ranges
from lectern.llm.sentences import sentence_units, units


def cut(t):
    return [t[a:b] for a, b in units(t)]


@pytest.mark.parametrize(
    "parts",
    [
        ["I met Dr. Tan and Prof. Lee.", "It opened at 10.01 a.m.", "2016 was hard."],
        ["It closes at 8.41 p.m. on weekdays.", "eServices were re-opened."],
        ['They were told "No." and left.', "Why should they wait?", '"We cannot wait," he said, "because it ends."', "Next."],
        ["The firm, Serai Works Sdn. Bhd., has time.", "A tender by Marine Pte. Ltd. came in at S$3.5 million, vs. 2.1.", "See Annex No. 5, i.e. the list."],
        ["J. K. Tan kept it.", "The queue grew... and grew.", 'She said: "It helps."', "Good!"],
        ["En. Ali dan Pn. Siti setuju.", 'Dia bertanya, "Siapa?" tetapi diam.'],
        ['"யார்?" என்று கேட்டார்.', "திரு. அருள் வந்தார்."],
        ["Three things: (a) one; (b) vol. 102 too; and (c) a reply."],
    ],
)
def test_units(parts):
    assert cut(" ".join(parts)) == parts
    assert cut(" ".join(parts).replace(" ", "\u00a0")) == [p.replace(" ", "\u00a0") for p in parts]


def test_mandarin():
    parts = ["“谁来支付？”一位居民这样问我。", "比例从46.28%升到47.1%，并不轻松。", "“等不了，”小贩说，“请降低。”", "教育部表示，会公布。", "这是不够的！"]
    assert cut("".join(parts)) == parts
    plain = [p.replace("“", '"').replace("”", '"') for p in parts]
    assert cut("".join(plain)) == plain
    assert cut("A reply. 这是。 Next one.") == ["A reply.", "这是。", "Next one."]


def test_lines_and_nothing():
    assert cut("No end mark here\nSecond line\n\n Third.") == ["No end mark here", "Second line", "Third."]
    assert units(None) == units("") == units(" \n\t ") == []
    assert cut("Ｍr． Tan cаme. Μr. Lee​. Left.")[0] == "Ｍr． Tan cаme."


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. \n!?\"'”“。中é​1(,", max_size=80))
def test_units_cover_all_but_blanks(t):
    seen, end = set(), 0
    for a, b in units(t):
        assert end <= a < b and not t[a].isspace() and not t[b - 1].isspace()
        seen.update(range(a, b))
        end = b
    hidden = "​"
    assert all(i in seen for i, ch in enumerate(t) if not ch.isspace() and ch != hidden)


def test_on_rows(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1), ("b", None, 2), ("c", "", 3)], "key string, text string, char_start int")
    assert [tuple(r) for r in sentence_units(df).collect()] == [("a", 0, 4), ("a", 5, 9)]


def test_ranges_give_the_same_units(spark):
    base = "It opened at 1.25 a.m. He said \"no\" twice. 人民“需要”的。\"谁来?\"一位居民问我。比例从4.2升。 Dr. Tan left...\nline without end\n\n"
    texts = [(f"k{n}", (base * 40)[n : n + 2500]) for n in range(0, 60, 7)] + [("blank", " " * 1000), ("odd", "​x. " * 300)]
    df = spark.createDataFrame(texts, "key string, text string")
    got: dict = {}
    for r in stitched_units(range_borders(text_ranges(df, "key", "text", 600, 320))).collect():
        got.setdefault(r.key, []).append((r.char_start, r.char_end))
    assert {k: sorted(v) for k, v in got.items()} == {k: units(t) for k, t in texts if units(t)}
    assert RANGE > 320


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("यह एक वाक्य है। यह दूसरा है। डॉ. शर्मा आए।", ["यह एक वाक्य है।", "यह दूसरा है।", "डॉ. शर्मा आए।"]), ("هل هذا سؤال؟ نعم. هذه جملة أخرى.", ["هل هذا سؤال؟", "نعم.", "هذه جملة أخرى."]),
        ("ဒါဟာ ပထမ ဝါကျ။ ဒုတိယ ဝါကျ။", ["ဒါဟာ ပထမ ဝါကျ။", "ဒုတိယ ဝါကျ။"]), ("นี่คือประโยคแรกครับ นี่คือประโยค ที่สอง", ["นี่คือประโยคแรกครับ", "นี่คือประโยค ที่สอง"]), ("នេះជាប្រយោគទីមួយ។ ផ្លែឈើ។ល។", ["នេះជាប្រយោគទីមួយ។", "ផ្លែឈើ។ល។"]),
        ("ዓረፍተ ነገር።ሁለተኛ።", ["ዓረፍተ ነገር።", "ሁለተኛ።"]), ("See www.a.org or v2.1 now. He said.\"No\"", ["See www.a.org or v2.1 now.", "He said.\"No\""]), ("你好。abc.def是。", ["你好。", "abc.def是。"]), ("Tuan Hj. Ali hadir. Dll. tidak.", ["Tuan Hj. Ali hadir.", "Dll. tidak."]),
    ],
)
def test_languages_and_scripts(text, expected):
    assert [text[a:b] for a, b in units(text)] == expected
