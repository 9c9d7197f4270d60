"""A blocked Bloom filter in segments, built and probed by built-in functions.

A key's hash picks a segment, a word of 64 bits in it, and four of the word's bits. A segment is one row
with its words as an array. A filter that is small enough is broadcast; a larger one stays divided, and
what is probed meets its segment by a shuffle. Both probe the same bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a segment, and keys that share a word on average: 8 bits a key, of which about one in twenty
#: absent keys is taken for a present one.
SEGMENT_WORDS, KEYS_PER_WORD = 1 << 12, 8
#: Bytes of a filter that is broadcast at most.
BROADCAST_BYTES = 16 << 20
#: Parts into which what is probed in a segment is divided, so that a key that most rows have is no one's alone.
SALTS = 8


def segments_for(n_keys: int) -> int:
    """Segments for n_keys keys; at least one."""
    return max(1, -(-n_keys // (SEGMENT_WORDS * KEYS_PER_WORD)))


def filter_bytes(n_segments: int) -> int:
    return n_segments * SEGMENT_WORDS * 8


def _segment(key: Column, n_segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(n_segments))


def _word(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(SEGMENT_WORDS - 1)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(4)
    ]
    return reduce(Column.bitwiseOR, bits)


def bloom_segments(keys: DataFrame, key: str, n_segments: int) -> DataFrame:
    """(segment, words): each key sets four bits of one word of its segment. Null keys set none.

    Bits are combined by word before they move, then words by segment.
    """
    k = F.col(key)
    set_ = keys.where(k.isNotNull()).select(_segment(k, n_segments).alias("segment"), _word(k).alias("word"), _mask(k).alias("bits"))
    words = set_.groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    none = F.array_repeat(F.lit(0).cast("long"), SEGMENT_WORDS)
    held = words.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x"))
    # the sorted words, each with the empty ones before it
    gap = lambda x, i: F.col("x")[i]["word"] - F.when(i > 0, F.col("x")[F.greatest(i - 1, F.lit(0))]["word"]).otherwise(F.lit(-1)) - 1
    filled = F.flatten(F.transform("x", lambda x, i: F.concat(F.slice(none, F.lit(1), gap(x, i)), F.array(x["bits"]))))
    return held.select("segment", filled.alias("words"))


def maybe_in(rows: DataFrame, key: str, segments: DataFrame, n_segments: int, out: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`rows` with a boolean column: False proves that the key is not in the filter.

    A filter of at most `broadcast_bytes` is broadcast. Otherwise rows and segments meet by a shuffle; a
    segment's rows are divided among SALTS parts, for each of which it is repeated.
    """
    k = F.col(key)
    marked = rows.withColumn("__segment", _segment(k, n_segments))
    held = segments.select(F.col("segment").alias("__segment"), F.col("words").alias("__words"))
    on = ["__segment"]
    if filter_bytes(n_segments) <= broadcast_bytes:
        held = F.broadcast(held)
    else:
        on.append("__salt")
        marked = marked.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
        held = held.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    mask = _mask(k)
    # words behind the last one set are empty, as is a segment without keys
    there = F.coalesce(F.get("__words", _word(k)), F.lit(0).cast("long")).bitwiseAND(mask) == mask
    return marked.join(held, on, "left").withColumn(out, F.coalesce(there, F.lit(False))).drop("__segment", "__words", "__salt")
