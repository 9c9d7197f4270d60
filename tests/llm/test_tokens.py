import base64
import random

import pytest

from lectern.llm.packing import SumOfSquares, pack, shards_of
from lectern.llm.tokens import PATTERN, VOCABULARY, Tokenizer, byte_letters, model_bytes, read_ranks, token_ids

TEXTS = ["Hello world", "", " ", "a" * 5000, "  two  blanks \n\n", "水费、电费 2.5%", "உதவித்தொகை", "🙂👍🏽 é", "<|endoftext|>", "don't we'll", "\t\x00\x7f"]


@pytest.fixture(scope="module")
def ours():
    return Tokenizer(model_bytes(read_ranks()))


def test_ids_are_those_of_the_vocabulary(ours):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})
    rng = random.Random(1)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(60)) for _ in range(200)]
    for t in TEXTS + more:
        assert ours.encode(t) == enc.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t
    assert ours.encode(None) == []


def test_ranks_must_have_no_gap():
    with pytest.raises(ValueError, match="gap"):
        model_bytes({b"a": 0, b"b": 2})
    assert len(set(byte_letters())) == 256


def test_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in token_ids(df).collect()}
    assert got[1] == got[len(TEXTS)] == [] and all(got[i] for i, t in enumerate(TEXTS) if t)
    assert token_ids(df.limit(0)).count() == 0
    small = {bytes([b]): b for b in range(256)} | {b"he": 256}
    path = tmp_path / "small"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in small.items()))
    assert token_ids(df.where("doc_id = 0"), vocabulary=str(path)).first().ids[:2] == [72, 101]
    assert VOCABULARY


def test_sum_of_squares_places_where_the_squares_are_least():
    rng = random.Random(3)
    s = SumOfSquares(30)
    counts = [0] * 31
    for _ in range(500):
        n = rng.randrange(1, 31)
        best = None
        for level in range(0, 31 - n):
            if level and not counts[level]:
                continue
            after = counts[:]
            after[level] -= level > 0
            after[level + n] += level + n < 30
            cost = sum(c * c for c in after[1:30])
            if best is None or cost < best[0]:
                best = (cost, None)
        if n == 30:
            best = (sum(c * c for c in counts[1:30]), None)
        _, level = s.place(n)
        counts[level] -= level > 0
        counts[level + n] += level + n < 30
        assert sum(c * c for c in counts[1:30]) == best[0]


def test_packing_is_whole(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 300), "x") for i in range(3000)] + [(9001, 250, ""), (9002, 100, ""), (9003, None, ""), (9004, 0, ""), (9005, 1050, "")]
    df = spark.createDataFrame(rows, "doc_id long, n int, container string")
    got = pack(df, "doc_id", "n", 3, 100).collect()
    by, per = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            per.setdefault(r.container, []).append((r.start, r.start + r.n))
    assert set(by) == {r[0] for r in rows}
    for i, n, _ in rows:
        parts = sorted(by[i], key=lambda r: r.part)
        assert sum(r.n for r in parts) == (n or 0) and [r.part for r in parts] == list(range(parts[0].n_parts))
        assert len(parts) == max(1, -(-(n or 0) // 100))
    for spans in per.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(n or 0 for _, n, _ in rows)
    assert total / 100 / len(per) > 0.97
    assert pack(df.limit(0), "doc_id", "n", 2).count() == 0
    assert shards_of(spark.createDataFrame([(10,), (None,)], "n int"), "n", capacity=2, shard_containers=2) == 3
