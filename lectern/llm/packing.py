"""Filling containers of fixed capacity by the sum-of-squares rule.

Each item goes to the fill level that leaves the least sum of squared numbers of partly filled containers
at each level. The numbers stand in a level array; of the open containers at a level any will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.tokens import VOCABULARY, token_ids
from lectern.sources import checkpointed

CAPACITY = 2048
#: Containers that a shard fills on average: what one task packs, a part of the corpus that doesn't grow with it.
SHARD_CONTAINERS = 1 << 15


class SumOfSquares:
    """The open containers of one shard."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The container's number and the offset in it for an item of 1 to `capacity`; the fuller of equally good levels."""
        n, level = self.count, 0
        if size < self.capacity:
            top = self.capacity - size
            cost = 2 * n[size:]
            cost[-1] = -1  # a container that is filled counts no more
            cost = cost[1:] - 2 * n[1 : top + 1] + 1
            cost[n[1 : top + 1] == 0] = np.iinfo(np.int64).max
            i = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[i] <= 2 * n[size]:
                level = i + 1
        if level:
            container = self.open[level].pop()
            n[level] -= 1
        else:
            container = self.made
            self.made += 1
        if (now := level + size) < self.capacity:
            self.open[now].append(container)
            n[now] += 1
        return container, level


def pack(sizes: DataFrame, key: str, size: str, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """`key`, part, n_parts, container, start, n: where each item, or each part of an oversized one, lies.

    Items spread over `shards` by a hash of their key and are packed in the hash's order, one stream a
    shard. An item beyond the capacity fills whole containers and leaves its rest to be packed like any
    item. An item of size 0 or null takes no room: container and start are null. Rows that repeat a key are
    packed each.
    """
    cols = [sizes.schema[key].dataType]
    h = F.xxhash64(F.col(key))
    rows = (
        sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("__n"), h.alias("__h"), F.pmod(h, F.lit(shards)).cast("int").alias("__shard"))
        .repartitionById(shards, "__shard")  # a shard a task
        .sortWithinPartitions("__shard", "__h", key)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for batch in batches:
            at, part, parts, container, start, taken = ([] for _ in range(6))
            for i, (n, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if s != shard:
                    shard, state = s, SumOfSquares(capacity)
                pieces = [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0) or [0]
                for p, x in enumerate(pieces):
                    c, o = state.place(x) if x else (None, None)
                    at.append(i)
                    part.append(p)
                    parts.append(len(pieces))
                    container.append(None if c is None else (s << 40) + c)
                    start.append(o)
                    taken.append(x)
            i32 = [pa.array(x, pa.int32()) for x in (part, parts, start, taken)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), i32[0], i32[1], pa.array(container, pa.int64()), i32[2], i32[3]], [key, "part", "n_parts", "container", "start", "n"])

    schema = T.StructType([T.StructField(key, cols[0]), *(T.StructField(c, t) for c, t in (("part", T.IntegerType()), ("n_parts", T.IntegerType()), ("container", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType())))])
    return rows.mapInArrow(run, schema)


def shards_of(sizes: DataFrame, size: str, capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS) -> int:
    """How many shards the sizes fill."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-total // (capacity * shard_containers)))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents by doc_id, sized in tokens, assigned to containers. Texts are read once: their sizes are written down."""
    sizes = checkpointed(token_ids(documents, vocabulary=vocabulary).select("doc_id", F.size("ids").alias("n")))
    return pack(sizes, "doc_id", "n", shards_of(sizes, "n", capacity, shard_containers), capacity)
