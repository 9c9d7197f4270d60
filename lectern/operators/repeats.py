"""Sets of words that repeat an earlier set of their group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources import scratch_folder

#: Characters of a group's texts for which it has a block.
BLOCK_CHARS = 1 << 22
#: Sets of a block up to which all are counted at once, and words that pairs of them have in common.
AT_ONCE, AT_ONCE_WORDS = 512, 1 << 21
#: Sets of a block that are searched first, for as long as a set has not met its like: ends of the levels.
LEVELS = (1024, 8192)
#: Rows given out at a time.
ROWS = 8192

_CLASS = "report_id string, blocks int, block int, turn int, i int, key string, copies long, repeats_earlier boolean, ws string"
_HIT = "report_id string, key string, i int, copies long, repeats_earlier boolean"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _list(c: pa.Array) -> list:
    return c.to_pylist() if c.null_count and not pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False).tolist()


def _least(sizes: np.ndarray | int, other: np.ndarray | int) -> np.ndarray:
    """Words in common that are three quarters of the smaller set, at least."""
    return (3 * np.minimum(sizes, other) + 3) // 4


def coded(sets: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all sets as numbers, the sizes of the sets, and the words by number. A set is its words with blanks between them."""
    words = pc.split_pattern(pa.array(sets, pa.string()), " ")
    numbers = words.values.dictionary_encode()
    return numbers.indices.to_numpy().astype(np.int64), np.diff(words.offsets.to_numpy()).astype(np.int64), numbers.dictionary


class Index:
    """For each word the sets that it is in, as numbers in their order."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, n_words: int):
        order = np.argsort(words, kind="stable")
        self.sets = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.starts = np.searchsorted(words[order], np.arange(n_words + 1)).tolist()
        self.sizes, self.least = sizes, {}

    def meets(self, words: list[int], size: int, upto: int) -> bool:
        """Whether a set of `size` words, of which `words` are known here, has enough in common with one of the first `upto` sets."""
        if not words or upto <= 0:
            return False
        if size not in self.least:
            self.least[size] = _least(self.sizes, size)
        common = np.bincount(np.concatenate([self.sets[self.starts[w] : self.starts[w + 1]] for w in words]), minlength=len(self.sizes))
        return bool((common[:upto] >= self.least[size][:upto]).any())


def _in_common(words: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """For each two sets the number of words in common, if these are few enough to be counted at once."""
    n, of = len(sizes), np.bincount(words)
    total = int((of * of).sum())
    if total > AT_ONCE_WORDS:
        return None
    order = np.argsort(words, kind="stable")
    sets, times = np.repeat(np.arange(n), sizes)[order], of[words[order]]
    begins = np.repeat((np.cumsum(of) - of)[words[order]] - (np.cumsum(times) - times), times)
    return np.bincount(np.repeat(sets, times) * n + sets[begins + np.arange(total)], minlength=n * n).reshape(n, n)


def repeats(sets: list[str]) -> list[bool]:
    """For each of different sets in order, whether it has three quarters of the smaller one's words in common with an earlier one."""
    words, sizes, known = coded(sets)
    n = len(sets)
    if n <= AT_ONCE and (common := _in_common(words, sizes)) is not None:
        return np.tril(common >= _least(sizes[:, None], sizes), -1).any(axis=1).tolist()
    found, ends = [False] * n, np.concatenate([[0], np.cumsum(sizes)]).tolist()
    listed, level = words.tolist(), 0
    for to in [*(x for x in LEVELS if x < n), n]:
        index = Index(words[ends[level] : ends[to]], sizes[level:to], len(known))
        for at in range(level + 1, n):
            if not found[at]:
                found[at] = index.meets(listed[ends[at] : ends[at + 1]], ends[at + 1] - ends[at], min(at, to) - level)
        level = to
    return found


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different sets of each block with their number, and whether they repeat one of the same block. Rows of a block come in order."""
    now, sets, out = None, {}, []

    def close() -> None:
        flags = repeats(list(sets)) if now[0] is not None else [False] * len(sets)
        out.extend((*now, *first, copies, flag, s if now[1] > 1 else None) for (s, (first, copies)), flag in zip(sets.items(), flags))

    for batch in batches:
        for group, blocks, block, turn, i, key, s in zip(*map(_list, batch.columns)):
            if now != (group, blocks, block):
                if sets:
                    close()
                    if len(out) >= ROWS:
                        yield _batch(out, _CLASS)
                        out.clear()
                now, sets = (group, blocks, block), {}
            if s in sets:
                sets[s][1] += 1
            else:
                sets[s] = [(turn, i, key), 1]
    if sets:
        close()
    if out:
        yield _batch(out, _CLASS)


def _place(turn: int | None, i: int, key: str | None) -> tuple:
    """Nulls come first."""
    return (turn is not None, turn or 0, i, key is not None, key or "")


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sets that come after a block's own, those that repeat an earlier one of the block. Only the block's own are kept."""
    now, own, index, vocabulary, places, out = None, [], None, {}, [], []
    for batch in batches:
        for group, block, asks, turn, i, key, copies, s in zip(*map(_list, batch.columns)):
            if now != (group, block):
                now, own, index, vocabulary, places = (group, block), [], None, {}, []
            if not asks:
                own.append(s)
                places.append(_place(turn, i, key))
                continue
            if index is None:
                words, sizes, known = coded(own)
                vocabulary, index, own = {w: n for n, w in enumerate(known.to_pylist())}, Index(words, sizes, len(known)), []
            words = s.split(" ")
            if index.meets([vocabulary[w] for w in words if w in vocabulary], len(words), bisect_left(places, _place(turn, i, key))):
                out.append((group, key, i, copies, True))
        if out:
            yield _batch(out, _HIT)
            out = []


def repeated_sets(rows: DataFrame, chars: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """report_id, key, i, copies, repeats_earlier: the different sets of words of each report, at their first place.

    `rows` has report_id, turn, i, key and ws, words in order with blanks between them; `chars` report_id and chars, the
    length of each report's texts. No pair is written: a set looks for any earlier one, first in its own block of the report
    (of about `block_chars` characters, by hash), and only a set that found none there goes to the other blocks, of which a
    task holds one. Rows without a report have no earlier ones.
    """
    spark = rows.sparkSession
    # a row for each `block_chars` characters at most
    large = F.broadcast(chars.select(F.col("report_id").alias("__r"), F.ceil(F.col("chars") / block_chars).cast("int").alias("blocks")).where("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = rows.join(large, F.col("report_id").eqNullSafe(F.col("__r")), "left").select("report_id", blocks.alias("blocks"), F.pmod(F.xxhash64("ws"), blocks).cast("int").alias("block"), "turn", "i", "key", "ws")
    folder = scratch_folder(spark, "sets")
    placed.repartition("report_id", "block").sortWithinPartitions("report_id", "block", "turn", "i", "key").mapInArrow(_first, _CLASS).write.parquet(folder)
    sets = spark.read.schema(_CLASS).parquet(folder)

    many = sets.where("blocks > 1 AND report_id IS NOT NULL")
    open_ = many.where("NOT repeats_earlier")
    own = many.select("report_id", "block", F.lit(False).alias("asks"), "turn", "i", "key", "copies", "ws")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))).alias("block")
    asking = open_.select("report_id", other, F.lit(True).alias("asks"), "turn", "i", "key", "copies", "ws")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # little to read, much to do: not merged
    hits = own.union(asking).repartition(parts, "report_id", "block").sortWithinPartitions("report_id", "block", "asks", "turn", "i", "key").mapInArrow(_others, _HIT)

    out = ["report_id", "key", "i", "copies"]
    settled = sets.where("blocks = 1 OR repeats_earlier OR report_id IS NULL").select(*out, "repeats_earlier")
    return settled.union(open_.select(*out, "repeats_earlier").union(hits).groupBy(*out).agg(F.max("repeats_earlier").alias("repeats_earlier")))
