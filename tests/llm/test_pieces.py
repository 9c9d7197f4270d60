import datetime as dt
import random

from lectern.llm import pieces
from lectern.llm.pieces import HIGH, LIMIT, LOW, cut_files, cut_pieces, faulty_splits, file_ranges, natural_pieces, running_sum, text_ranges
from lectern.llm.queries import p6_files
from lectern.llm.sentences import units

D = dt.datetime(2020, 1, 1)
NATURAL = "".join(f"Sentence number {i} is about something or other. " for i in range(400)).strip()
LONG = "word " * 2500 + "end."
SOLID = "x" * 15_000


def checked(text, rows):
    rows = sorted(rows, key=lambda r: r.part)
    s, e = {a for a, _ in units(text)}, {b for _, b in units(text)}
    assert [r.part for r in rows] == list(range(len(rows))) and {r.n_parts for r in rows} == {len(rows)}
    assert rows[0].char_start == 0 and rows[-1].char_end == len(text)
    for i, r in enumerate(rows):
        assert text[r.char_start : r.char_end] == r.piece and len(r.piece) <= LIMIT
        if i:
            assert LOW <= rows[i - 1].char_end - r.char_start <= HIGH
        if r.natural:
            assert (r.char_start in s or r.char_start == 0) and (r.char_end in e or r.char_end == len(text))
    return rows


def test_pieces_of_texts(spark):
    texts = {"n": NATURAL, "l": LONG, "x": SOLID, "s": "Short one.", "z": "中文句子很短。" * 2000}
    df = spark.createDataFrame([*texts.items(), ("e", ""), ("u", None)], "key string, text string")
    got: dict = {}
    for r in cut_pieces(text_ranges(df, "key", "text")).collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == set(texts)
    for k, t in texts.items():
        rows = checked(t, got[k])
        assert rows[0].natural == (k not in "lx")
    small = cut_pieces(text_ranges(df.where("key = 'n'"), "key", "text", LIMIT, 7000))
    assert len(checked(NATURAL, small.collect())) == len(got["n"])


def test_pieces_of_a_file(spark, tmp_path):
    text = NATURAL + " 中文“句子”很短。é" * 900
    path = tmp_path / "giant.txt"
    path.write_text(text)
    rows = cut_pieces(file_ranges(spark, str(path), LIMIT, 9000)).collect()
    checked(text, rows)
    (tmp_path / "b.txt").write_text(LONG)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.txt").write_text("")
    both: dict = {}
    for r in cut_pieces(file_ranges(spark, str(tmp_path), LIMIT, 9000)).collect():
        both.setdefault(r.key.rsplit("/", 1)[1], []).append(r)
    assert set(both) == {"giant.txt", "b.txt"}
    checked(text, both["giant.txt"])
    checked(LONG, both["b.txt"])


def test_files_by_blocks_of_ranges(spark, tmp_path, monkeypatch):
    """Ranges and blocks far smaller than in use, against the units of the whole text."""
    rng = random.Random(8)
    mixed = " ".join(rng.choice(["中文“句子”很短。\"好不好?\"他问。", "One sentence is here.", "Dr. Tan paid $3.50, i.e. less.", "A line\n", "Is it? " + "very " * rng.randrange(60) + "long."]) for _ in range(2500))
    texts = {"a": mixed, "b": NATURAL, "c": LONG * 3, "d": SOLID, "e": "Short one.", "f": NATURAL + " " + SOLID + " " + NATURAL, "g": "中文“句子很长" * 900 + "。”" + mixed}
    for k, t in texts.items():
        (tmp_path / k).write_text(t)
    monkeypatch.setattr(pieces, "RANGE_BLOCK", 3)
    ranges = file_ranges(spark, str(tmp_path), 600, 3000)
    states = {(r.key[-1], r.r): r.inside for r in pieces.range_states(pieces.range_borders(ranges), 3).collect()}
    assert all(states[k, 0] is False for k in texts)
    got: dict = {}
    for r in cut_files(spark, str(tmp_path), 600, 20, 90, 3000).collect():
        got.setdefault(r.key[-1], []).append(r)
    assert set(got) == set(texts)
    for k, t in texts.items():
        rows = sorted(got[k], key=lambda r: r.part)
        s, e = {a for a, _ in units(t)}, {b for _, b in units(t)}
        assert [r.part for r in rows] == list(range(len(rows))) and {r.n_parts for r in rows} == {len(rows)}
        assert rows[0].char_start == 0 and rows[-1].char_end == len(t)
        for i, r in enumerate(rows):
            assert t[r.char_start : r.char_end] == r.piece and 0 < len(r.piece) <= 600
            if i:
                assert 20 <= rows[i - 1].char_end - r.char_start <= 90, (k, i)
            if r.natural:
                assert (r.char_start in s or r.char_start == 0) and (r.char_end in e or r.char_end == len(t)), (k, i)
        assert any(r.natural for r in rows) == (k not in "cd")


def test_pieces_of_written_texts(spark):
    folder = "/root/testdata/sf0.001"
    rows = p6_files(spark, folder).collect()
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL").collect()]
    ends = {r.file: r.char_end for r in rows if r.part == r.n_parts - 1}
    assert sum(ends.values()) == sum(len(t) + 1 for t in texts)
    assert all(sorted(r.part for r in rows if r.file == f) == list(range(next(r.n_parts for r in rows if r.file == f))) for f in ends)


def test_natural_pieces_say_when_there_are_none():
    assert natural_pieces([0, 7000], [7000, 9000], 9000) is None
    assert natural_pieces([0], [10], 10) == [(0, 10)]


def test_running_sum(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(50)] + [("b", 0, 5)], "k string, part int, v int")
    got = {(r.k, r.part): r.s for r in running_sum(df, "k", "part", "v", "s", 8).collect()}
    assert all(got["a", i] == i * (i - 1) // 2 for i in range(50)) and got["b", 0] == 0


def test_faulty_splits(spark):
    base = natural_pieces([a for a, _ in units(NATURAL)], [b for _, b in units(NATURAL)], len(NATURAL))
    good = [NATURAL[a:b] for a, b in base]
    spot = base[1][0] + 30
    gap = [good[0], NATURAL[base[0][1] : base[0][1] + 5500], good[2]]
    twice = ("So it is. " * 900).strip()
    rows = {
        "ok": good, "ok2": good, "word": [good[0], NATURAL[spot : base[1][1]], *good[2:]], "changed": [good[0].replace("other", "otter", 1), *good[1:]], "short": good[:-1], "gap": gap, "none": [],
    }
    turns = [(f"{k}#t0", "r", NATURAL, D, 1) for k in rows] + [("rep#t0", "r", twice, D, 1), ("d#t0", "d", NATURAL, D, 1), ("small#t0", "r", "Small.", D, 1)]
    chunks = [(f"{k}{i}", f"{k}#t0", i, len(v), p) for k, v in rows.items() for i, p in enumerate(v)]
    chunks += [chunks[0], ("ok2x", " OK2#T0", 0, len(good), good[0] + " "), ("d0", "d#t0", 0, 9, "x"), ("s0", "small#t0", 3, 9, "x"), ("m", None, 0, 1, "x")]
    u = units(twice)
    a = max(b for _, b in u if b <= LIMIT)
    s = next(x for x, _ in u if a - HIGH <= x <= a - LOW)
    chunks += [("rep0", "rep#t0", 0, 2, twice[:a]), ("rep1", "rep#t0", 1, 2, twice[s:])]
    t = spark.createDataFrame(turns, "key string, report_id string, text string, loaded_at timestamp, part int")
    c = spark.createDataFrame(chunks, "id string, turn_key string, part int, n_parts int, cite_text string")
    r = spark.createDataFrame([("r", "final", D), ("d", "draft", D)], "report_id string, report_version string, loaded_at timestamp")
    assert sorted(x.turn_key for x in faulty_splits(t, c, r).collect()) == ["changed#t0", "gap#t0", "ok2#t0", "short#t0", "word#t0"]
    assert faulty_splits(t.limit(0), c, r).count() == 0
    nulls = spark.createDataFrame([("n0", "ok#t0", None, None, None)], c.schema)
    assert [x.turn_key for x in faulty_splits(t, nulls, r).collect()] == ["ok#t0"]
