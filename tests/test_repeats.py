"""Sentences that repeat earlier ones: reports in many blocks and without a name give the rows of the SQL, and no pairs are written."""

import datetime as dt
import random
from functools import partial

import duckdb
import pytest

from lectern.operators.repeats import repeated_sets, repeats
from lectern.plans import texts
from test_oracles import rows_of

NAME, D = "near_duplicates", dt.datetime(2024, 1, 1)
WORDS = [f"{a}{b}{c}{a}" for a in "bdfg" for b in "aeiou" for c in "lrst"][:60]


def sentence(rng, words, n):
    return " ".join(rng.sample(words, n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A report of 1,500 sentences with words of a few, reports that are small, and turns without a report."""
    d, rng = str(tmp_path_factory.mktemp("repeats")), random.Random(3)
    rows = [("large", n, " ".join(sentence(rng, WORDS, rng.choice((3, 4, 8, 12, 12, 12))) for _ in range(10))) for n in range(150)]
    rows += [(f"small{k}", n, " ".join(sentence(rng, WORDS[:20], rng.randint(2, 6)) for _ in range(4))) for k in range(5) for n in range(5)]
    rows += [(None, n, "The panel will review the permit. The panel will review the permit. And the panel will review the permit again.") for n in range(2)]
    rows += [("small0", 9, None), ("small0", 10, ""), ("small0", 11, "  ... Yes.  [No] \n "), ("small0", 12, "　Order for the second reading. ÉCOLE Kelvin Kelvin words.")]
    rows = [(f"{r}#t{n}", r, n, t, D) for r, n, t in rows]
    spark.createDataFrame(rows, "key string, report_id string, turn int, text string, loaded_at timestamp_ntz").withColumns({"speaker": texts.F.lit("x"), "year": texts.F.lit(2024)}).write.parquet(f"{d}/turn.parquet")
    for t, k in (("report", "report_id"), ("chunk", "id"), ("summary_item", "item_id"), ("summary_item_report", "item_id"), ("supersession", "item_id")):
        spark.createDataFrame([("x", D)], f"{k} string, loaded_at timestamp_ntz").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def expected(folder):
    con = duckdb.connect()
    for t in ("turn", "report", "chunk", "summary_item", "summary_item_report", "supersession"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(texts.R.sql[NAME])
    return rows_of([x[0] for x in cur.description], cur.fetchall())


@pytest.mark.parametrize("chars", [None, 12000, 40])
def test_blocks_give_the_rows_of_the_sql(spark, folder, expected, monkeypatch, chars):
    if chars:
        monkeypatch.setattr(texts, "repeated_sets", partial(repeated_sets, block_chars=chars))
    df = texts.R.plans[NAME](spark, folder)
    flags = {r.repeats_earlier for r in df.where("report_id = 'large'").collect()}
    assert rows_of(df.columns, df.collect()) == expected and flags == {False, True}


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_no_pairs_are_written(spark, tmp_path):
    """4,000 sentences with 12 of 40 words are nearly all pairs of each other's words."""
    rng = random.Random(5)
    rows = [(f"r#t{n}", "r", n, " ".join(sentence(rng, WORDS[:40], 12) for _ in range(20)), "x", 2024, D) for n in range(200)]
    spark.createDataFrame(rows, "key string, report_id string, turn int, text string, speaker string, year int, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/turn.parquet")
    before = shuffled(spark)
    assert len(texts.R.plans[NAME](spark, str(tmp_path)).collect()) == 4000
    wrote = shuffled(spark) - before
    assert 0 < wrote < 4 * sum(len(r[3]) for r in rows)


def test_levels_find_what_pairs_find():
    rng = random.Random(7)
    sets = list({" ".join(sorted(rng.sample(WORDS, rng.choice((3, 5, 11, 12))))): 0 for _ in range(2500)})
    words = [set(s.split(" ")) for s in sets]
    pairs = [any(4 * len(w & v) >= 3 * min(len(w), len(v)) for v in words[:n]) for n, w in enumerate(words)]
    assert repeats(sets) == pairs and True in pairs and False in pairs
    assert repeats(sets[:300]) == pairs[:300] and repeats(["aaaa bbbb cccc"]) == [False]
