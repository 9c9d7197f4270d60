"""Cutting oversized texts into overlapping pieces at the ends of sentence units.

Texts are worked on in ranges. A worker finds the unit borders of its range, seeing a little of the
neighbouring ones; borders are stitched, prefix sums of the ranges' lengths give their offsets, and pieces
are chosen by offset alone and cut out of the ranges. The borders of a text that is a row meet in one task,
as its characters did; those of a file only a few ranges at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.keys import key_form
from lectern.llm.domain import by_draft, holding
from lectern.llm.sentences import _SCRIPTS, _break_ends, _opening, _spans, flat_form
from lectern.operators.sequences import neighbours
from lectern.sources import checkpointed

LIMIT, LOW, HIGH = 6000, 200, 800
#: Characters of a range, and how many of its neighbours a worker sees when it looks for borders.
RANGE, HALO = 1 << 16, 256
#: Tasks among which the ranges of files are divided at most.
FILE_TASKS = 20_000

_RANGES = T.StructType([T.StructField("key", T.StringType()), T.StructField("r", T.IntegerType()), T.StructField("left", T.IntegerType()), T.StructField("core", T.IntegerType()), T.StructField("slice", T.StringType())])
_INTS = T.ArrayType(T.IntegerType())
_BORDERS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        *(T.StructField(c, T.IntegerType()) for c in ("r", "core")),
        *(T.StructField(c, _INTS) for c in ("starts0", "ends0", "starts1", "ends1", "grid")),
        *(T.StructField(c, T.BooleanType()) for c in ("fresh0", "closed0", "out0", "fresh1", "closed1", "out1")),
    ]
)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield flush()
            held.clear()
    if held:
        yield flush()


def text_ranges(texts: DataFrame, key: str, text: str, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """key, r, left, core, slice: each text in ranges of `size` characters, with HALO before and `limit` + HALO after."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                for r in range(-(-len(t) // size)):
                    a, b = r * size, min(len(t), (r + 1) * size)
                    low = max(0, a - HALO)
                    yield k, r, a - low, b - a, t[low : b + limit + HALO]

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("string"), F.col(text))
    return rows.mapInArrow(lambda it: _batches(cut(it), _RANGES.names, types), _RANGES)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The address and length of a file, or of each file of a folder but hidden ones, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName()[0] not in "._")


def _opened(address: str) -> pa.NativeFile:
    """A file of any system that Arrow knows (file, hdfs, s3 and others), to be read at any place."""
    fs, name = pa_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))
    return fs.open_input_file(name)


def file_ranges(spark: SparkSession, path: str, limit: int = LIMIT, size: int = 4 * RANGE) -> DataFrame:
    """The same for each UTF-8 file of a folder, or one, that all workers see, in ranges of `size` bytes. A worker
    reads its range and halos alone; no file is read as a whole. key is the file's address. For many or large
    files there is `cut_files`, through which no text passes but the pieces."""
    files = _files(spark, path)
    # one row a file: where its ranges begin among all
    starts = [0, *accumulate(-(-n // size) for _, n in files)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                which = bisect_right(starts, n) - 1
                yield files[which][0], n - starts[which], *_read_range(*files[which], n - starts[which], limit, size)

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return _range_numbers(spark, starts[-1]).mapInArrow(lambda it: _batches(cut(it), _RANGES.names, types, 1), _RANGES)


def _range_numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, FILE_TASKS)))


def _read_range(address: str, total: int, r: int, limit: int, size: int) -> tuple[int, int, str]:
    """Characters before a range's core, its own, and both with those behind it, of a UTF-8 file of so many bytes."""

    def char_start(data: bytes, i: int) -> int:
        while i < len(data) and data[i] & 0xC0 == 0x80:
            i += 1
        return i

    a, b = r * size, min(total, (r + 1) * size)
    low = max(0, a - 4 * HALO)
    with _opened(address) as f:
        data = f.read_at(min(total, b + 4 * (limit + HALO)) - low, low)
    i, j, k = (char_start(data, x) for x in (0, a - low, b - low))
    left, core = data[i:j].decode(), data[j:k].decode()
    return len(left), len(core), left + core + data[k:].decode("utf-8", "ignore")


def _core_units(flat: str, at: list[int] | None, opens: set[int], left: int, core: int) -> tuple[list[int], list[int], bool, bool]:
    """Units cut to the core, whether a break stands before the first, and whether one stands after the last."""
    last = left + core
    ends = _break_ends(flat, opens)
    where = [e if at is None else at[e - 1] + 1 for e in ends]
    kept = [e for e, w in zip(ends, where) if left < w <= last]
    first = bisect_left(at, left) if at is not None else left
    stop = bisect_left(at, last) if at is not None else last
    if first >= stop:
        return [], [], False, False
    spans = _spans(flat[first:stop], at[first:stop] if at is not None else None, [e - first for e in kept])
    shift = -left if at is not None else first - left
    starts, stops = [s + shift for s, _ in spans], [e + shift for _, e in spans]
    broke = [w - left for w in where if left < w <= last]
    if not starts:
        return [], [], bool(broke), bool(broke)
    return starts, stops, bool(broke) and broke[0] <= starts[0], bool(broke) and broke[-1] >= stops[-1]


def _snap(text: str, x: int, reach: int) -> int:
    """The last border of a word at or up to `reach` before place x; x itself if there is none."""
    for i in range(x, max(0, x - reach), -1):
        if text[i - 1 : i].isspace() or text[i : i + 1].isspace() or i == len(text):
            return i
    return x


def _grid_step(limit: int, low: int, high: int) -> tuple[int, int, int]:
    """Step, overlap and reach of pieces that are cut at blanks."""
    reach, overlap = (high - low) // 3, (low + high) // 2
    return limit - overlap - reach, overlap, reach


def range_borders(ranges: DataFrame) -> DataFrame:
    """The unit borders of each range's core, from its first character on: once as if no quotation were open
    there (…0) and, in later ranges, once as if one were (…1)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _borders_of(*(c[i].as_py() for c in batch.columns))

    return ranges.mapInArrow(lambda it: _batches(find(it), _BORDERS.names, _BORDER_TYPES), _BORDERS)


_BORDER_TYPES = [pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 5, *[pa.bool_()] * 6]


def _borders_of(key: str, r: int, left: int, core: int, text: str) -> tuple:
    """A row of borders."""
    flat, at = flat_form(text[: left + core + HALO])
    quoted = '"' in flat and _SCRIPTS["mandarin"].search(flat)
    first = bisect_left(at, left) if at is not None else left
    stop = bisect_left(at, left + core) if at is not None else left + core
    found = []
    for inside in (False, True) if quoted and r else (False,):
        opens = {first + i for i in _opening(flat[first:], inside)[0]} if quoted else set()
        found.append((*_core_units(flat, at, opens, left, core), _opening(flat[first:stop], inside)[1]))
    (s0, e0, f0, c0, o0), (s1, e1, f1, c1, o1) = found if len(found) == 2 else (found[0], (*found[0][:4], _opening(flat[first:stop], True)[1]))
    return key, r, core, s0, e0, s1, e1, [], f0, c0, o0, f1, c1, o1


def stitch(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One text's units (starts, ends) from its ranges' borders, with the ranges' numbers and offsets."""
    rows = rows.sort_values("r")
    offsets = np.concatenate([[0], np.cumsum(rows["core"].to_numpy(np.int64))])
    starts, ends, inside, closed = [], [], False, True
    for x, base in zip(rows.itertuples(index=False), offsets):
        s, e, fresh, shut, out = (x.starts1, x.ends1, x.fresh1, x.closed1, x.out1) if inside else (x.starts0, x.ends0, x.fresh0, x.closed0, x.out0)
        s, e = [np.asarray(v, np.int64) + base for v in (s, e)]
        if len(s) and not closed and not fresh and ends:
            ends[-1][-1] = e[0]
            s, e = s[1:], e[1:]
            if len(s):
                starts.append(s)
                ends.append(e)
            closed = shut
        elif len(s):
            starts.append(s)
            ends.append(e)
            closed = shut
        else:
            closed = closed or shut
        inside = out
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none]), rows["r"].to_numpy(np.int64), offsets


def natural_pieces(starts: list[int], ends: list[int], total: int, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> list[tuple[int, int]] | None:
    """Pieces from unit starts to unit ends, each as long as can be; None where the units allow none.

    The overlap with the next piece is the least that units allow. The first piece begins at 0, the last
    ends at `total`.
    """
    out, a = [], 0
    while total - a > limit:
        j = bisect_right(ends, a + limit) - 1
        while j >= 0 and ends[j] > a:
            i = bisect_right(starts, ends[j] - low) - 1
            if i >= 0 and starts[i] >= ends[j] - high and starts[i] > a:
                break
            j -= 1
        else:
            return None
        out.append((a, int(ends[j])))
        a = int(starts[i])
    return [*out, (a, total)]


def blank_pieces(total: int, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> list[tuple[int, int]]:
    """Pieces on a fixed grid, whose borders are to be moved back to blanks."""
    step, overlap, _ = _grid_step(limit, low, high)
    n = max(1, -(-(total - overlap) // step))
    return [(k * step, total if k == n - 1 else (k + 1) * step + overlap) for k in range(n)]


def _per_text(borders: DataFrame, f: Callable[[str, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    return borders.groupBy("key").applyInPandas(lambda key, rows: f(key[0], rows), schema)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def stitched_units(borders: DataFrame) -> DataFrame:
    """key, char_start, char_end of all units."""

    def f(key: str, rows: pd.DataFrame) -> pd.DataFrame:
        s, e, _, _ = stitch(rows)
        return pd.DataFrame({"key": pd.Series([key] * len(s), dtype=object), "char_start": s, "char_end": e})

    return _per_text(borders, f, _struct(key=T.StringType(), char_start=T.LongType(), char_end=T.LongType()))


def plan_pieces(borders: DataFrame, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> DataFrame:
    """key, part, n_parts, char_start, char_end, r, local, natural: a text's pieces by offset, and the range each begins in."""

    def f(key: str, rows: pd.DataFrame) -> pd.DataFrame:
        s, e, rs, offsets = stitch(rows)
        total = int(offsets[-1])
        found = natural_pieces(s.tolist(), e.tolist(), total, limit, low, high) if not len(s) or (e - s).max() <= limit else None
        pieces = found or blank_pieces(total, limit, low, high)
        a = np.array([x for x, _ in pieces])
        at = np.searchsorted(offsets, a, "right") - 1
        at = np.minimum(at, len(rs) - 1)
        return pd.DataFrame({"key": key, "part": range(len(a)), "n_parts": len(a), "char_start": a, "char_end": [x for _, x in pieces], "total": total, "r": rs[at], "local": a - offsets[at], "natural": found is not None})

    i, n = T.IntegerType(), T.LongType()
    return _per_text(borders, f, _struct(key=T.StringType(), part=i, n_parts=i, char_start=n, char_end=n, total=n, r=i, local=i, natural=T.BooleanType()))


def _emitted(plan: DataFrame, ranges: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """The pieces of a plan (…, r, local, n, snap_start, snap_end) cut out of their ranges; borders to snap go back to a blank."""
    _, _, reach = _grid_step(limit, low, high)

    @F.pandas_udf(_struct(s=T.IntegerType(), e=T.IntegerType(), piece=T.StringType()))
    def emit(text: pd.Series, left: pd.Series, local: pd.Series, n: pd.Series, snap_start: pd.Series, snap_end: pd.Series) -> pd.DataFrame:
        out = []
        for t, x, a, k, begins, ends in zip(text, left, local, n, snap_start, snap_end):
            a, b = x + a, x + a + k
            s = _snap(t, a, reach) if begins else a
            e = _snap(t, b, reach) if ends else b
            out.append((s - a, e - b, t[s:e]))
        return pd.DataFrame(out, columns=["s", "e", "piece"])

    cut = plan.join(ranges.select("key", "r", "left", "slice"), ["key", "r"])
    done = cut.withColumn("x", emit("slice", "left", "local", (F.col("char_end") - F.col("char_start")).cast("int"), "snap_start", "snap_end"))
    return done.select("key", "part", "n_parts", (F.col("char_start") + F.col("x.s")).alias("char_start"), (F.col("char_end") + F.col("x.e")).alias("char_end"), "natural", "x.piece")


def cut_pieces(ranges: DataFrame, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> DataFrame:
    """key, part, n_parts, char_start, char_end, natural, piece of every text given in ranges.

    A text within the limit is one piece. Otherwise pieces have at most `limit` characters, begin and end
    with sentence units, and share `low` to `high` characters with the one before. Where units don't allow
    that (one is longer than the limit, or there is no border where one is needed), all of the text's
    pieces end at blanks, or in a long word if there is none near. Joined without their overlaps, the
    pieces are the text. Empty and null texts have none. The borders of a text, numbers, meet in one task:
    this is for texts that are rows of a table; for files there is `cut_files`.
    """
    plan = plan_pieces(range_borders(ranges), limit, low, high)
    snap = {"snap_start": ~F.col("natural") & (F.col("char_start") > 0), "snap_end": ~F.col("natural") & (F.col("char_end") != F.col("total"))}
    return _emitted(plan.withColumns(snap), ranges, limit, low, high)


#: Ranges of a file whose states are followed in one task.
RANGE_BLOCK = 1024


def range_states(borders: DataFrame, block: int = RANGE_BLOCK) -> DataFrame:
    """key, r, inside, joined of each range: whether a quotation is open where it begins, and whether its first unit goes
    on with the last one before.

    What a range does to the two states it is entered in (a quotation open, the last unit closed) is a table of four;
    blocks of ranges give the product of theirs, one row a block is followed from block to block, and the states are
    then known within each block.
    """
    narrow = borders.select("key", "r", F.floor(F.col("r") / block).cast("int").alias("block"), *((F.size(f"starts{v}") > 0).alias(f"some{v}") for v in (0, 1)), *(f"{c}{v}" for v in (0, 1) for c in ("fresh", "closed", "out")))

    def follow(rows: pd.DataFrame, state: int) -> tuple[list[tuple[int, bool, bool]], int]:
        out = []
        for x in rows.sort_values("r").itertuples(index=False):
            inside, closed = bool(state & 1), bool(state & 2)
            some, fresh, shut, opens = (x.some1, x.fresh1, x.closed1, x.out1) if inside else (x.some0, x.fresh0, x.closed0, x.out0)
            out.append((x.r, inside, bool(some and not closed and not fresh)))
            state = int(opens) | (2 if (shut if some else closed or shut) else 0)
        return out, state

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "block": key[1], "to": [[follow(rows, s)[1] for s in range(4)]]})

    def entered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = 2, []
        for x in rows.sort_values("block").itertuples(index=False):
            out.append((key[0], x.block, state))
            state = int(x.to[state])
        return pd.DataFrame(out, columns=["key", "block", "state"])

    def known(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found, _ = follow(rows, int(rows["state"].iloc[0]))
        return pd.DataFrame([(key[0], *x) for x in found], columns=["key", "r", "inside", "joined"])

    i, flag, text = T.IntegerType(), T.BooleanType(), T.StringType()
    products = narrow.groupBy("key", "block").applyInPandas(product, _struct(key=text, block=i, to=_INTS))
    entries = products.groupBy("key").applyInPandas(entered, _struct(key=text, block=i, state=i))
    return narrow.join(entries, ["key", "block"]).groupBy("key", "block").applyInPandas(known, _struct(key=text, r=i, inside=flag, joined=flag))


def plan_files(borders: DataFrame, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The pieces of files by offset, planned range by range; see `cut_files`."""
    borders = checkpointed(borders)
    b = borders.join(range_states(borders), ["key", "r"])
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    b = b.select("key", "r", "core", "joined", pick("starts").alias("starts"), pick("ends").alias("ends"))
    some = neighbours(b.where(F.size("ends") > 0).select("key", "r", "joined"), "key", "r", ["joined"], before=False).select("key", "r", F.coalesce("__joined", F.lit(False)).alias("goes_on"))
    b = b.join(some, ["key", "r"], "left")
    # what is no border, because the unit goes on over the range's, is left out
    starts = F.when(F.col("joined"), F.slice("starts", F.lit(2), F.size("starts"))).otherwise(F.col("starts"))
    ends = F.when(F.coalesce("goes_on", F.lit(False)), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))).otherwise(F.col("ends"))
    b = running_sum(b.select("key", "r", "core", starts.alias("starts"), ends.alias("ends")), "key", "r", "core", "offset")
    head = F.struct("core", F.filter("starts", lambda x: x <= limit).alias("starts"), F.filter("ends", lambda x: x <= limit).alias("ends"))
    tail = F.struct("core", F.filter("starts", lambda x: x >= F.col("core") - 2 * high).alias("starts"))
    b = b.withColumns({"head": head, "tail": tail})
    b = neighbours(b, "key", "r", ["tail"], before=True).withColumnRenamed("__tail", "before")
    b = neighbours(b, "key", "r", ["head"], before=False).withColumnRenamed("__head", "after")
    kinds = _struct(a=T.IntegerType(), b=T.IntegerType(), natural=T.BooleanType(), snap_start=T.BooleanType(), snap_end=T.BooleanType())

    def own(core: int, starts: list[int], ends: list[int], before: dict | None, after: dict | None) -> list[tuple]:
        def entry(core: int, starts: list[int], ends: list[int], before: list[int]) -> tuple[int, int, bool]:
            """Where the pieces of a range begin, up to where those before it go, and whether both are unit borders."""
            first = next((e for e in ends if e <= limit // 2), None)
            if first is not None:
                begin = [x for x in (*before, *(y for y in starts if y < first)) if first - high <= x <= first - low]
                if begin:
                    return max(begin), first, True
            return -((low + high) // 2), 0, False

        begin, _, whole = (0, 0, True) if before is None else entry(core, starts, ends, [x - before["core"] for x in before["starts"]])
        stop, real = core, True
        if after is not None:
            _, last, real = entry(after["core"], list(after["starts"]), list(after["ends"]), [x - core for x in starts])
            stop = core + last
        s = [x for x in ([y - before["core"] for y in before["starts"]] if before else []) if x >= begin] + [x for x in starts if x >= begin] + ([x + core for x in after["starts"]] if after else [])
        e = [x for x in ends if x > begin] + ([x + core for x in after["ends"]] if after else [])
        e = [x for x in e if x <= stop]
        borders = [begin, *e]
        found = natural_pieces([x - begin for x in s], [x - begin for x in e], stop - begin, limit, low, high) if whole and real and max((y - x for x, y in zip(borders, e)), default=0) <= limit else None
        pieces = found or blank_pieces(stop - begin, limit, low, high)
        last = len(pieces) - 1
        return [
            (x + begin, y + begin, found is not None, found is None and (k > 0 or not whole), found is None and (k < last or not real))
            for k, (x, y) in enumerate(pieces)
        ]

    @F.pandas_udf(T.ArrayType(kinds))
    def planned(core: pd.Series, starts: pd.Series, ends: pd.Series, before: pd.DataFrame, after: pd.DataFrame) -> pd.Series:
        def side(x: pd.DataFrame, i: int) -> dict | None:
            row = x.iloc[i]
            return None if pd.isna(row["core"]) else {k: int(v) if k == "core" else [int(y) for y in v] for k, v in row.items()}

        out = []
        for i, (c, s, e) in enumerate(zip(core, starts, ends)):
            out.append([dict(zip(kinds.names, x)) for x in own(int(c), [int(x) for x in s], [int(x) for x in e], side(before, i), side(after, i))])
        return pd.Series(out)

    p = b.select("key", "r", "core", "offset", F.size("starts").alias("units"), planned("core", "starts", "ends", "before", "after").alias("p"))
    p = checkpointed(p)
    counts = running_sum(p.select("key", "r", F.size("p").alias("n")), "key", "r", "n", "base").select("key", "r", "base")
    total = p.groupBy("key").agg(F.sum(F.size("p")).cast("int").alias("n_parts"))
    x = p.join(counts, ["key", "r"]).join(total, "key").select("key", "r", "core", "offset", "base", "n_parts", F.posexplode("p").alias("k", "x"))
    # a piece that begins before its range is cut out of the one before
    early = F.col("x.a") < 0
    sizes = neighbours(p.select("key", "r", "core"), "key", "r", ["core"], before=True).select("key", "r", F.col("__core").alias("prior"))
    x = x.join(sizes, ["key", "r"])
    return x.select(
        "key", (F.col("base") + F.col("k")).cast("int").alias("part"), "n_parts", (F.col("offset") + F.col("x.a")).alias("char_start"), (F.col("offset") + F.col("x.b")).alias("char_end"),
        F.when(early, F.col("r") - 1).otherwise(F.col("r")).alias("r"), F.when(early, F.col("x.a") + F.col("prior")).otherwise(F.col("x.a")).cast("int").alias("local"), "x.natural", "x.snap_start", "x.snap_end",
    )


def cut_files(spark: SparkSession, path: str, limit: int = LIMIT, low: int = LOW, high: int = HIGH, size: int = 4 * RANGE) -> DataFrame:
    """key, part, n_parts, char_start, char_end, natural, piece of each UTF-8 file of a folder, or of one, of any size.

    Files are read by byte ranges, once for their borders and once for the pieces; their text is never
    shuffled, and no task has more of it than a range. A file's pieces end where the first unit that ends in
    a range does, so that each range is planned by itself, with the borders near it of its neighbours;
    quotation states and offsets come from blocks of ranges. Only in ranges where units don't allow natural
    pieces do they end at blanks. Ranges must be longer than twice the limit. An empty file has no pieces.
    """
    files = _files(spark, path)
    starts = [0, *accumulate(-(-n // size) for _, n in files)]
    sizes = dict(files)
    _, _, reach = _grid_step(limit, low, high)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                which = bisect_right(starts, n) - 1
                address, r = files[which][0], n - starts[which]
                yield _borders_of(address, r, *_read_range(*files[which], r, limit, size))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for address, r, todo in zip(*(c.to_pylist() for c in batch.columns)):
                left, _, text = _read_range(address, sizes[address], r, limit, size)
                for x in todo:
                    a = left + x["local"]
                    b = a + x["char_end"] - x["char_start"]
                    s, e = _snap(text, a, reach) if x["snap_start"] else a, _snap(text, b, reach) if x["snap_end"] else b
                    yield address, x["part"], x["n_parts"], x["char_start"] + s - a, x["char_end"] + e - b, x["natural"], text[s:e]

    borders = _range_numbers(spark, starts[-1]).mapInArrow(lambda it: _batches(find(it), _BORDERS.names, _BORDER_TYPES, 4), _BORDERS)
    plan = plan_files(borders, limit, low, high)
    by_range = plan.groupBy("key", "r").agg(F.collect_list(F.struct("part", "n_parts", "char_start", "char_end", "local", "natural", "snap_start", "snap_end")).alias("x"))
    schema = _struct(key=T.StringType(), part=T.IntegerType(), n_parts=T.IntegerType(), char_start=T.LongType(), char_end=T.LongType(), natural=T.BooleanType(), piece=T.StringType())
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return by_range.mapInArrow(lambda it: _batches(emit(it), schema.names, types), schema)


@F.pandas_udf(_INTS)
def overlaps(before: pd.Series, after: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Every length from low to high by which the end of one piece is the beginning of the next; null if there is none."""
    out = []
    for a, b, lo, hi in zip(before, after, low, high):
        if a is None or b is None:
            out.append(None)
            continue
        tail = a[-hi:]
        head, j, found = b[:lo], 0, []
        while len(head) == lo and (j := tail.find(head, j)) >= 0:
            if b.startswith(tail[j:]):
                found.append(len(tail) - j)
            j += 1
        out.append(found)
    return pd.Series(out)


def running_sum(rows: DataFrame, key: str, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """The sum of `value` before each row in the order of an integer column, by blocks, so that no key is one task's."""
    b = F.floor(F.col(order) / block).alias("__block")
    rows = rows.withColumn("__block", b)
    sums = rows.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    base = sums.select(key, "__block", F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(base, [key, "__block"]).withColumn(out, F.col("__base") + within).drop("__block", "__base")


def _blanks(c: Column, at_end: bool) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"(?U)\s+$" if at_end else r"(?U)^\s+", ""))


def _chain(text: str, pieces: list[str], starts: set[int], ends: set[int], long: bool, low: int, high: int) -> bool:
    """Whether pieces in order can lie in a text by all terms; for those that overlap in several ways."""
    blank = lambda i: i <= 0 or i >= len(text) or text[i].isspace() or text[i - 1].isspace()
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    at: set[int] = set()
    for n, p in enumerate(pieces):
        s, e = len(p) - len(p.lstrip()), len(p.rstrip())
        tries = range(first + 1) if n == 0 else {x - o for x in at for o in range(low, high + 1)}
        fits = {
            x + len(p)
            for x in tries
            if x >= 0
            and text.startswith(p, x)
            and (n or x + s == first)
            and (n + 1 < len(pieces) or x + e == last)
            and ((blank(x + s) and blank(x + e)) if long else (x + s in starts and x + e in ends))
        }
        if not fits:
            return False
        at = fits
    return True


def faulty_splits(turns: DataFrame, chunks: DataFrame, reports: DataFrame, limit: int = LIMIT, low: int = LOW, high: int = HIGH) -> DataFrame:
    """turn_key of each oversized turn outside draft reports whose stored pieces break the terms of `cut_pieces`.

    Where a piece lies follows from the lengths before it and the overlaps between neighbours, found from
    the pieces alone; then it is compared with its range of the text and with the unit borders. Where
    neighbours overlap in several ways (a passage that repeats itself), the turn's pieces, whose lengths
    are then known to be those of its text, are tried together. Turns without chunk are left out; a null
    part, n_parts or cite_text breaks the terms.
    """
    own = by_draft(holding(turns.select("key", "report_id", "text", "loaded_at"), "key").where(F.length("text") > limit), reports, draft=False)
    # what is used several times is written once: the long texts, their pieces, the borders, the overlaps
    own = checkpointed(own.select(F.col("__key").alias("k"), "key", "text"))
    names = own.select("k", F.col("key").alias("turn_key"), F.length("text").alias("total"))
    stored = chunks.select(key_form("turn_key").alias("k"), "id", "part", "n_parts", "cite_text").join(names.select("k"), "k", "left_semi").distinct()
    stored = checkpointed(stored)
    n = F.length("cite_text")
    by_part = stored.groupBy("k", "part").agg(F.count("*").alias("n"), F.max(F.coalesce(n, F.lit(limit + 1))).alias("most"), F.min(F.coalesce("n_parts", F.lit(-1))).alias("low"), F.max("n_parts").alias("high"))
    shape = by_part.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("part").alias("first"), F.max("part").alias("last"), F.count_if(F.col("part").isNull()).alias("none"))
    fits = (F.col("same") == 1) & (F.col("most") <= limit) & (F.col("low") == F.col("n")) & (F.col("high") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("none") == 0)
    shape = shape.select("k", "n", F.coalesce(fits, F.lit(False)).alias("fits"))
    bad_shape = shape.where("NOT fits").select("k")
    good = stored.join(shape.where("fits").select("k"), "k", "left_semi").select("k", "part", "n_parts", "cite_text")

    after = good.select("k", (F.col("part") - 1).alias("part"), F.col("cite_text").alias("next"))
    pairs = good.select("k", "part", "n_parts", F.length("cite_text").alias("n"), F.col("cite_text").alias("this")).join(after, ["k", "part"], "left")
    shared = F.when(F.col("next").isNotNull(), overlaps("this", "next", F.lit(low), F.lit(high)))
    pairs = checkpointed(pairs.select("k", "part", F.col("n"), shared.alias("o")))
    ways = pairs.groupBy("k").agg(F.min(F.size("o")).alias("least"), F.max(F.size("o")).alias("most"))
    bad_pair = ways.where("least = 0").select("k")
    unclear = ways.where("least > 0 AND most > 1").select("k")
    clear = ways.where("least IS NULL OR least > 0").where("most IS NULL OR most <= 1").select("k")

    ranges = text_ranges(own, "k", "text", limit)
    borders = range_borders(ranges)
    units = checkpointed(stitched_units(borders))
    long = units.groupBy(F.col("key").alias("k")).agg((F.max(F.col("char_end") - F.col("char_start")) > limit).alias("long"), F.min("char_start").alias("first"), F.max("char_end").alias("last"))
    steps = pairs.join(clear, "k", "left_semi").select("k", "part", (F.col("n") - F.coalesce(F.element_at("o", 1), F.lit(0))).alias("step"))
    placed = running_sum(steps, "k", "part", "step", "begin").select("k", "part", "begin")
    placed = placed.join(good, ["k", "part"]).join(long, "k").withColumn("r", F.floor(F.col("begin") / RANGE).cast("int"))
    seen = placed.join(ranges.select(F.col("key").alias("k"), "r", "left", "slice"), ["k", "r"], "left")
    at = (F.col("begin") - F.col("r") * RANGE + F.col("left")).cast("int")
    s, e = F.col("begin") + _blanks(F.col("cite_text"), False), F.col("begin") + F.length("cite_text") - _blanks(F.col("cite_text"), True)
    around = F.substring(F.col("slice"), at + (s - F.col("begin")).cast("int"), F.lit(1)), F.substring(F.col("slice"), at + (e - F.col("begin")).cast("int") + 1, F.lit(1))
    edge = lambda c, border: border | c.rlike(r"(?U)^\s$")
    checked = seen.select(
        "k", "part", s.alias("s"), e.alias("e"), "long",
        F.coalesce(F.substring(F.col("slice"), at + 1, F.length("cite_text")) == F.col("cite_text"), F.lit(False)).alias("same"),
        (((F.col("part") > 0) | (s == F.col("first"))) & ((F.col("part") < F.col("n_parts") - 1) | (e == F.col("last")))).alias("whole"),
        (edge(around[0], s == F.col("first")) & edge(around[1], e == F.col("last"))).alias("spaced"),
    )
    starts = units.select(F.col("key").alias("k"), F.col("char_start").alias("s"), F.lit(True).alias("is_start"))
    ends = units.select(F.col("key").alias("k"), F.col("char_end").alias("e"), F.lit(True).alias("is_end"))
    held = checked.join(starts, ["k", "s"], "left").join(ends, ["k", "e"], "left")
    natural = F.coalesce("is_start", F.lit(False)) & F.coalesce("is_end", F.lit(False))
    bad_place = held.where(~(F.col("same") & F.col("whole") & F.when(F.col("long"), F.col("spaced")).otherwise(natural))).select("k")

    @F.pandas_udf(T.BooleanType())
    def lies(text: pd.Series, pieces: pd.Series, starts: pd.Series, ends: pd.Series, long: pd.Series) -> pd.Series:
        return pd.Series([_chain(t, list(p), set(a), set(b), x, low, high) for t, p, a, b, x in zip(text, pieces, starts, ends, long)])

    lists = good.join(unclear, "k", "left_semi").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "cite_text"))), lambda x: x["cite_text"]).alias("pieces"))
    marks = units.withColumnRenamed("key", "k").join(unclear, "k", "left_semi").groupBy("k").agg(F.collect_list("char_start").alias("starts"), F.collect_list("char_end").alias("ends"))
    bad_chain = own.join(lists, "k").join(marks, "k").join(long, "k").where(~lies("text", "pieces", "starts", "ends", "long")).select("k")
    bad = bad_shape.unionByName(bad_pair).unionByName(bad_place).unionByName(bad_chain).distinct()
    return names.join(bad, "k").select("turn_key")
